"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerflow.llm import ann, decontaminate, katz, language, licences, packing, pii, queries, repair, simhash, tokens

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

BYTE, WORD = queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.WORD_BPE)
DOCS = "doc_id long, text string, lang string, source string, n_tokens string, score string, fp string"
RNG = random.Random(5)
WORDS = ["the", "cat", "sat", "on", "a", "mat.", "Émile", "über", "x1", "don't", "MIT", "licence,", "日本語", "end!\n"]
TEXTS = [None, "", " ", "\n\t ", "a", "A  b\n\nc ", "<|endoftext|> x  <|endoftext|>", "<|ENDOFTEXT|> y", "x" * 5000, "0 " * 4000, "Σας ΣΑΣ é É\x1c z"] + [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 120))) for _ in range(60)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(170, TEXTS[20]), (170, TEXTS[20]), (None, TEXTS[21]), (190, TEXTS[20] + " tail")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", "s", "n", "s", "f") for i, t in rows], DOCS)


def by(rows):
    return sorted(map(tuple, rows), key=str)


def encoded(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (tokens.count_tokens(none, BYTE), language.identify(none), simhash.near_duplicates(none), pii.find(none), packing.pack(none, BYTE), decontaminate.decontaminate(none, bench), repair.encode_and_read_back(none, WORD), licences.scan_licences(none), ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")), katz.score_folds(none)):
        assert out.count() == 0


def test_token_counts(spark):
    got = tokens.count_tokens(docs(spark), BYTE, limit=50).collect()
    want = [(i, len((t or "").encode()), len(e), len(e) > 50) for (i, t), e in zip(ROWS, encoded(BYTE, [t for _, t in ROWS]), strict=True)]
    assert by(got) == by(want)


def test_packing(spark):
    cap = 64
    got = packing.pack(docs(spark), BYTE, capacity=cap).collect()
    want = []
    for (i, _), ids in zip(ROWS, encoded(BYTE, [t for _, t in ROWS]), strict=True):
        ids, at = [*ids, 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), cap)):
            want.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert by(tuple(r)[:5] for r in got) == by(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    assert len(places) <= packing.lower_bound(Counter(w[3] for w in want), cap) + 2


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(2)

    def best(items, cap):  # fewest sequences, by search
        items = sorted(items, reverse=True)
        for n in range(1, len(items) + 1):
            bins = [cap] * n

            def fits(k, bins=bins):
                if k == len(items):
                    return True
                for b in {x: j for j, x in enumerate(bins)}.values():
                    if bins[b] >= items[k]:
                        bins[b] -= items[k]
                        if fits(k + 1):
                            return True
                        bins[b] += items[k]
                return False

            if fits(0):
                return n
        return 0

    over, emptied = 0, 0
    for _ in range(400):
        cap = rng.randint(1, 30)
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 9))]
        fewest = best(items, cap)
        plan = packing.solve(Counter(items), cap)
        assert sum(plan.used.values()) == len(items)
        over += plan.sequences - fewest
        fixed = packing.Plan()
        left = packing.reduced(Counter(items), cap, fixed)
        assert fixed.fixed + sum(left.values()) == len(items)
        # what is fixed costs nothing: the rest still packs into the fewest
        assert fixed.sequences + best([k for k, n in left.items() for _ in range(n)], cap) == fewest, (items, cap)
        emptied += not left
    assert 0 <= over <= 3 and emptied > 100
    for counts, cap, want in (({7: 3, 3: 2}, 10, 3), ({1000: 1, 500: 1}, 2048, 1), ({1000: 3, 500: 1}, 2048, 2), ({1024: 1, 1000: 1}, 2048, 1)):
        assert packing.solve(counts, cap).sequences == want


def test_repair(spark, tmp_path):
    folder = str(tmp_path / "shards")
    repair.write_shards(docs(spark), WORD, folder, shards=3, block_ids=500, min_count=2)
    got = by(repair.read_shards(spark, folder).collect())
    order = sorted(zip(ROWS, encoded(WORD, [t for _, t in ROWS]), strict=True), key=lambda r: (r[0][0] is not None, r[0][0] or 0))
    at, want = 0, []
    for (i, _), ids in order:
        ids = [*ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == by(want)
    payloads = [r["payload"] for r in spark.read.parquet(folder).collect()]
    assert any(len(repair.Block(bytes(p)).rules) for p in payloads)
    for p in payloads[:4]:
        block = repair.Block(bytes(p))
        whole, ends = block.all_ids(), np.cumsum(block.lengths)
        for d, (e, n) in enumerate(zip(ends.tolist(), block.lengths.tolist(), strict=True)):
            a, b = sorted((RNG.randint(0, n), RNG.randint(0, n)))
            assert block.ids(d, a, b).tolist() == whole[e - n : e][a:b].tolist() and block.ids(d).tolist() == whole[e - n : e].tolist()


def plain_repair(docs, base, min_count):
    """One pair at a time, counted anew each time, from the left."""
    docs, rules = [list(d) for d in docs], []

    def places(d, pair):
        out, i = [], 0
        while i + 1 < len(d):
            hit = (d[i], d[i + 1]) == pair
            out += [i] if hit else []
            i += 2 if hit else 1
        return out

    while True:
        counts = {pair: sum(len(places(d, pair)) for d in docs) for pair in {p for d in docs for p in zip(d, d[1:], strict=False)}}
        top = min(counts, key=lambda p: (-counts[p], p), default=None)
        if top is None or counts[top] < min_count:
            return docs, rules
        for d in docs:
            for i in reversed(places(d, top)):
                d[i : i + 2] = [base + len(rules)]
        rules.append(top)


def test_repair_grammar():
    rng = random.Random(12)
    for case in range(60):
        docs = [[rng.choice([1, 2, 3, rng.randint(1, 9)]) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(1, 6))] + [[7] * rng.randint(1, 40)] + [[1, 2, 3, 4, 5]] * (case % 5)
        ids, lengths = np.concatenate([np.array(d, "<u4") for d in docs]), np.array([len(d) for d in docs])
        for min_count in (2, 3):
            symbols, parts, rules = repair.compress(ids, lengths, 10, min_count, None)
            want, want_rules = plain_repair(docs, 10, min_count)
            assert [tuple(r) for r in rules.tolist()] == want_rules and symbols.tolist() == [x for d in want for x in d] and parts.tolist() == [len(d) for d in want]
            symbols, parts, rules = repair.compress(ids, lengths, 10, min_count, 0.5)
            cut = np.split(symbols, np.cumsum(parts)[:-1])
            assert plain_repair([c.tolist() for c in cut], 10 + len(rules), min_count)[1] == []  # nothing frequent is left
            again = repair.Block(repair.write_block(list(range(len(docs))), [np.array(d, "<u4").tobytes() for d in docs], 10, min_count, 0.5))
            assert again.all_ids().tolist() == ids.tolist()


def test_language(spark):
    rng = random.Random(3)
    made = {"aa": ["bato", "kilu", "moner", "talo"], "bb": ["schrift", "zwölf", "streng", "weiß"], "cc": ["queja", "niño", "llave", "corazón"]}
    rows = [(i, " ".join(rng.choice(made[k]) for _ in range(40)), k) for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(500, None, "aa"), (501, "12 34 !!", "aa"), (502, "bato", None), (None, "kilu talo", "aa"), (503, "ж", "bb"), (504, "bato kilu " * 3000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.identify(df).collect()
    known = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(known[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows if i is not None)
    assert all(known[i]["lang_pred"] == k for i, _, k in rows[:240])
    assert [known[i]["lang_pred"] for i in (500, 501, 502, 504)] == ["und", "und", "aa", "aa"] and known[503]["lang_pred"] in made and known[503]["score"] == 0
    assert {r["doc_id"] for r in language.keep_identified(df).collect()} == {i for i, _, _ in rows} - {500, 501, 503}


def test_language_filter_masks():
    grams = {k: np.random.default_rng(k).integers(0, 1 << 63, 500).astype(np.uint64) for k in range(70)}  # more languages than bits in a word
    f = language.BitmaskFilter.build([f"l{k:02d}" for k in range(70)], grams)
    for k in (0, 1, 63, 64, 69):
        assert (f.masks(grams[k])[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()
        assert int(np.argmax(f.counts(grams[k]))) == k


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """id -> smallest id reachable over links of at most two bits."""
    out = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and out[b] > out[a]:
                    out[b], changed = out[a], True
    return out


def test_simhash(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert by((r["doc_id"], r["fingerprint"]) for r in got) == by((i, f"{plain_fingerprint(t):016x}") for i, t in ROWS)
    want = linked({i: plain_fingerprint(t) for i, t in ROWS if i is not None})
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("max_pairs", [0, 3, 256])
def test_simhash_links(spark, max_pairs):
    rng = random.Random(max_pairs)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {i: base[i % 4] ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([0, 1, 2, 2]))) % (1 << 64) for i in range(60)}
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    own = simhash.classes(df, max_pairs)
    got = {r["doc_id"]: r["component_id"] for r in df.join(own, "fp").collect()}
    assert got == linked(fps)


def plain_pii(text):
    """Straight from the patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(["a", ".", "@", "-", "1", "25", " ", "+", "é", "4539", "(", ")", "%", "\n", "0000"]) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_pii(text), text
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == [] and len(pii.base_spans("a@b.cc " * 20_000)) == 20_000


def test_pii(spark):
    told = [(i, f"on tuesday {w} wrote to ann@example.com about tea") for i, w in enumerate(["Zyxxo"] * 5 + ["someone"] * 2)]
    rows = told + [(10 + i, f"someone likes tea on tuesday and wrote about cats {i}") for i in range(60)] + [(100, None), (101, ""), (None, "x@y.zz"), (102, "call +1 (555) 555-0199 now"), (102, "call +1 (555) 555-0199 now")]
    found = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    first = found[0]
    base = plain_pii(rows[0][1])
    assert first["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() and first["n_email"] == 1
    assert "term:11:16" in first["spans"] and "term:3:" not in first["spans"] and "term" not in found[5]["spans"]
    assert found[100]["spans"] == "" and found[None]["n_email"] == 1 and found[102]["n_phone"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "ann@" not in clean[0] and "Zyxxo" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[7][1] and clean[100] is None and clean[102] == "call [PHONE] now"


def test_pii_whole_documents(spark):
    filler = "tea and cats on tuesday, yours by mail " * 12
    rows = [(i, f"Zyxxo {filler} mail ann@example.com {filler} yours zyxxo") for i in range(5)] + [(10 + i, f"{filler} {i}") for i in range(60)] + [(90, "ann@example.com met someone")]
    rows += [(91, f"{filler} ZYXXO {filler} zyxxo@example.org")]  # another value's document: the term stays there
    found = {r["doc_id"]: r["spans"].split(",") for r in pii.find(docs(spark, rows)).collect()}
    text = rows[0][1]
    assert [s for s in found[0] if s.startswith("term")] == ["term:0:5", f"term:{len(text) - 5}:{len(text)}"]
    assert not any(s.startswith("term") for i in (10, 90, 91) for s in found[i])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "zyxxo" not in clean[0].lower() and clean[10] == rows[5][1] and "ZYXXO" in clean[91]


def test_pii_blocks(spark, monkeypatch):
    rows = [(i, f"{w} met bob@example.org here {w}{w}") for i in range(8) for w in [("Qwert", "Asdfg")[i % 2]]] + [(50 + i, f"met here nobody {i}") for i in range(90)]
    one = by(pii.find(docs(spark, rows)).collect())
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert by(pii.find(docs(spark, rows)).collect()) == one and any("term" in r[6] for r in one)


def test_pii_sanitise_blocks(spark, monkeypatch):
    names = ["Qwert", "Asdfg", "Yxcvb"]
    rows = [(i, f"{w} met bob@example.org here, +49 {w} 555 555 0199 {w}{w} term") for i in range(9) for w in [names[i % 3]]] + [(50 + i, f"met here nobody {i}") for i in range(90)]
    one = by(pii.sanitise(docs(spark, rows)).collect())
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert by(pii.sanitise(docs(spark, rows)).collect()) == one and any("[EMAIL]" in r[1] and "Qwert" not in r[1] for r in one)


def plain_hits(rows, bench, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    known = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            known[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if own := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= own
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_windows", [500_000, 12])
def test_decontamination(spark, block_windows):
    rng = random.Random(6)
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta eps Zeta, eta. theta é9 x_y".split()) for _ in range(n))
    items = [word(n) for n in (3, 5, 13, 14, 30, 60)] + ["solo", "", "!!", None]
    bench = [*enumerate(items), (2, items[2]), (None, word(20)), (11, items[4])]
    rows = [(i, word(rng.randint(0, 40)) + " " + rng.choice([x for x in items if x] + [""]).upper() + " " + word(rng.randint(0, 300))) for i in range(50)] + [(60, None), (61, ""), (62, items[3]), (62, items[3]), (None, items[4])]
    got = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_windows=block_windows)
    want = plain_hits(rows, bench)
    assert by(tuple(r)[:6] for r in got.collect()) == by(want)
    if block_windows > 100:
        kept = decontaminate.keep_clean(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])


@pytest.mark.parametrize("block_windows", [500_000, 12])
def test_keep_clean(spark, block_windows):
    rng = random.Random(11)
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    bench = [(i, word(20)) for i in range(5)]
    rows = [(1, bench[0][1]), (1, "clean words of the same id"), (None, bench[1][1]), (None, "clean words without an id"), (2, bench[2][1] + " tail"), (3, None), (3, ""), (4, "plain"), (4, "plain")]
    kept = decontaminate.keep_clean(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_windows=block_windows)
    assert kept.columns == docs(spark).columns
    assert by((r["doc_id"], r["text"]) for r in kept.collect()) == by([rows[1], rows[3], *rows[5:]])


def test_licences(spark):
    rows = [(0, None), (1, "mit MIT license, apache License. x mit\nlicense"), (2, licences.TEMPLATES[1].text), (3, "z " * 5000 + licences.TEMPLATES[8].text + " tail"), (4, "the license of the software"), (5, "GNU general public license version 3")]
    got = {r["doc_id"]: r for r in licences.scan_licences(docs(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["n_words"]) == (3, 1, 6, "apache,mit", 8)
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == "" and got[0]["score"] == 0
    assert got[2]["labels"] == "mit" and got[2]["base_labels"] == "" and got[2]["score"] == 1 and got[3]["labels"] == "bsd" and got[3]["spans"][0]["first_word"] == 5000
    assert got[4]["labels"] == "" and "gpl" in got[5]["labels"].split(",")


def test_licences_of_long_files(spark):
    every = [t.label for t in licences.TEMPLATES]
    rng = random.Random(7)
    english = sorted({w.decode() for t in licences.TEMPLATES for w in t.words})
    prose = lambda n: " ".join(rng.choice(english) for _ in range(n))
    rows = [(0, f" {'zz ' * 30}".join(t.text for t in licences.TEMPLATES))]
    rows += [(10 + k, f"{prose(3000)} {'zz ' * 9}{t.text} {'zz ' * 9}{prose(3000)}") for k, t in enumerate(licences.TEMPLATES)] + [(50 + k, t.text) for k, t in enumerate(licences.TEMPLATES)]
    got = {r["doc_id"]: [s["label"] for s in r["spans"] if s["score"] == 1] for r in licences.scan_licences(docs(spark, rows)).collect()}
    assert set(got[0]) == set(every)
    assert all(label in got[10 + k] and label in got[50 + k] for k, label in enumerate(every))


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 8))).astype(np.float32)
    x[500:900] = x[300]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3100, None), (3200, [0.0] * 8), (3300, [float("nan")] * 8), (3400, [1.0] * 3), (None, [1.0] * 8), (3500, [None] * 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf_rows=100, block_rows=64)
    own = defaultdict(list)
    for r in got.collect():
        own[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(own) == set(range(0, 3000, 100))
    hits = 0
    x = x.astype(float)
    for q, found in own.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found) and found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len(set(want.tolist()) & {v for _, v, _ in found})
    assert hits / (10 * len(own)) >= 0.95
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 2), (2, 1)]


def good_turing(counts):
    """Katz's discounts from their definition; one half is taken off where they are not in (0, 1)."""
    n = Counter(counts.values())
    out = {}
    for r in range(1, 6):
        out[r] = (r - 0.5) / r
        if n[1] and n[r] and n[6] and 6 * n[6] < n[1]:
            k = 6 * n[6] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - k) / (1 - k)
            out[r] = d if 0 < d < 1 else out[r]
    return lambda c: out.get(c, 1) * c


class PlainKatz:
    """From the definition, one token at a time."""

    def __init__(self, texts, order):
        self.order, self.c = order, [Counter() for _ in range(order)]
        for words in texts:
            for t, w in enumerate(words):
                for h in self.histories(words, t):
                    self.c[len(h)][(*h, w)] += 1
        self.starts = len(texts)
        self.d = [good_turing(c) for c in self.c]
        self.total = sum(self.c[0].values())
        lost = sum(c - self.d[0](c) for c in self.c[0].values())
        self.unseen, self.scale = (lost / self.total, 1) if lost > 1e-12 else (1 / (self.total + 1), self.total / (self.total + 1))
        self.followers = defaultdict(list)
        for c in self.c[1:]:
            for g in c:
                self.followers[g[:-1]].append(g[-1])

    def histories(self, words, t):
        """What precedes a token, from nothing to order - 1 tokens, no further back than the start."""
        padded = [katz.BOS, *words[:t]]
        return [tuple(padded[len(padded) - n :]) for n in range(min(self.order - 1, len(padded)) + 1)]

    def p(self, h, w):
        if not h:
            c = self.c[0][(w,)]
            return self.scale * self.d[0](c) / self.total if c else self.unseen
        seen = self.followers[h]
        if not seen:
            return self.p(h[1:], w)
        n = sum(self.c[len(h)][(*h, x)] for x in seen)
        left, keep = 1 - sum(self.d[len(h)](self.c[len(h)][(*h, x)]) for x in seen) / n, 1
        if left <= 1e-12:
            left, keep = 1 / (n + 1), n / (n + 1)
        c = self.c[len(h)][(*h, w)]
        return keep * self.d[len(h)](c) / n if c else left / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)


@pytest.mark.parametrize(("block_tokens", "order"), [(3_000_000, 2), (60, 2), (60, 3), (3_000_000, 3), (200, 4)])
def test_katz(spark, block_tokens, order):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d e", f"w{rng.randint(0, 60)}", f"x{i // 9} always y{i // 9}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(200, None), (201, " \n"), (202, "A\x0bb"), (202, "A\x0bb"), (None, "a b")]
    got = {(r["doc_id"], r["n_tokens"]): r for r in katz.score_folds(docs(spark, rows), order=order, block_tokens=block_tokens).collect()}
    split = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] + [katz.END]
    model = PlainKatz([split(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2], order)
    uni = model.c[0]
    some = list(model.followers)
    for h in [(katz.BOS,), *rng.sample(some, 6), (b"nowhere",), (b"always",)]:
        assert sum(model.p(h, w) for (w,) in uni) + model.p(h, b"?") == pytest.approx(1)
    for i, t in rows:
        w = split(t)
        r = got[i, len(w)]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2) and r["n_known"] == sum(uni[x,] > 0 for x in w) and r["train_tokens"] == model.total
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[x,] + 1) / (model.total + len(uni) + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(model.p(model.histories(w, k)[-1], x)) for k, x in enumerate(w)))


CLASHES = ("fp", "root", "low", "gone", "contaminated_text", "term_spans", "e", "t", "n", "row", "hits", "__fp", "a.b")


def odd_table(spark, rows):
    """Documents with extra columns named like those that operators make."""
    df = docs(spark, rows).drop("fp")
    for name in CLASHES:
        df = df.withColumn(name, F.lit(f"kept {name}"))
    return df


@pytest.mark.parametrize("rows", [[], ROWS, [(None, None), (None, ""), (None, "a b c"), (5, None), (5, "a b c")]])
def test_filters_keep_all_columns(spark, rows, monkeypatch):
    df = odd_table(spark, rows)
    bench = spark.createDataFrame([(1, "the cat sat on a mat the cat sat on a mat the cat")], "item_id long, text string")
    for blocks in (500_000, 12):
        out = decontaminate.keep_clean(df, bench, block_windows=blocks)
        assert out.columns == df.columns and all(r["fp"] == "kept fp" and r["a.b"] == "kept a.b" for r in out.collect())
    for size in (1_000_000, 1):
        monkeypatch.setattr(pii, "BLOCK", size)
        out = pii.sanitise(df)
        assert out.columns == df.columns and out.count() == len(rows)
    out = language.keep_identified(df)
    assert out.columns == df.columns and out.count() <= len(rows)
    out = simhash.keep_one(df)
    kept = out.collect()
    assert out.columns == df.columns and all(r["__fp"] == "kept __fp" for r in kept)
    known = linked({i: plain_fingerprint(t) for i, t in rows if i is not None and [x for x, _ in rows].count(i) == 1})
    assert len(kept) == len({(plain_fingerprint(r["text"]), r["doc_id"]) for r in kept}) and (len(kept) > 0) == (len(rows) > 0)
    assert all(known[i] == i or i not in known for i in (r["doc_id"] for r in kept) if i in known)


def test_batches_are_bounded():
    import pyarrow as pa

    from ledgerflow.llm import common

    texts = ["x" * n for n in [10, 9 << 20, 5, 3 << 20, 3 << 20, 3 << 20] + [100] * 2500]
    parts = list(common.bounded([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"])]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= common.BATCH_ROWS and p.nbytes <= common.BATCH_BYTES) for p in parts)


def test_shared_folder_needs_a_name_on_a_cluster(monkeypatch):
    from ledgerflow.llm import common

    class Absent:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Absent()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, key, default: default})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
