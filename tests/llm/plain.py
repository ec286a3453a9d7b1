"""Plain versions of operators, straight from their definitions: one document, one pair, one place at a time."""

import math
import re
import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from ledgerflow.llm import licences, pii


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


# -- languages -----------------------------------------------------------------------------------------------------------


def grams(text):
    """Substrings of 2 to 4 characters of the words with an edge on either side, none across an edge."""
    spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return [spaced[i : i + n] for n in (2, 3, 4) for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1 : i + n - 1] and spaced[i : i + n] != "  "]


def language_model(rows, min_count=3, share=0.5):
    """rows: (id, text, lang) of all documents -> languages by frequency, and the n-grams of each."""
    rows = [(t, k) for i, t, k in rows if i is not None and t is not None and k is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    n = Counter(k for _, k in rows)
    counts = defaultdict(Counter)
    for t, k in rows:
        counts[k].update(grams(t))
    rate = {k: {g: c / sum(own.values()) for g, c in own.items()} for k, own in counts.items()}
    best = Counter()
    for own in rate.values():
        for g, r in own.items():
            best[g] = max(best[g], r)
    return sorted(n, key=lambda k: (-n[k], k)), {k: {g for g, c in own.items() if c >= min_count and rate[k][g] >= share * best[g]} for k, own in counts.items()}


def language(model, text):
    """(language, its share of the hits, share of the n-grams it explains, by how many n-grams it leads)."""
    order, known = model
    if not any(c.isalpha() for c in text or "") or not order:
        return "und", 0.0, 0.0, math.inf
    own = grams(text)
    hits = [sum(g in known[k] for g in own) for k in order]
    best = max(range(len(order)), key=lambda i: (hits[i], -i))
    rest = max((h for i, h in enumerate(hits) if i != best), default=-math.inf)
    return order[best], hits[best] / sum(hits) if sum(hits) else 0.0, hits[best] / len(own), hits[best] - rest


# -- personal data -------------------------------------------------------------------------------------------------------


def pii_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def value(kind, text):
    return kind, text.lower() if kind == "email" else text if kind == "ip" else re.sub(r"\D", "", text)


def disclosures(texts, support=3, generalise=0.9):
    """{(value, term): disclosure} of the pairs at or above the threshold; repeated texts count each."""
    docs = [({value(k, t[a:b]) for k, a, b in pii_spans(t)}, {w for w in words(t) if len(w.encode()) >= 3 and not w.encode().isdigit()}) for t in (x or "" for x in texts)]
    n_e, n_t, n = Counter(e for es, _ in docs for e in es), Counter(t for _, ts in docs for t in ts), Counter((e, t) for es, ts in docs for e in es for t in ts)
    out = {}
    for (e, t), both in n.items():
        if n_e[e] >= support and both >= support:
            pmi = math.log2(both / len(docs) / (n_e[e] / len(docs) * (n_t[t] / len(docs))))
            x = pmi / max(-math.log2(n_e[e] / len(docs)), 1e-9)
            if x >= generalise:
                out[e, t] = x
    return out


def all_spans(text, flagged):
    """Base spans and term spans of a text."""
    base = pii_spans(text)
    own = {value(k, text[a:b]) for k, a, b in base}
    terms = []
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        covered = any(a < m.end() and m.start() < b for _, a, b in base)
        if not covered and any((e, lower_az(m[0])) in flagged for e in own):
            terms.append(("term", *m.span()))
    return base, terms


def sanitised(text, flagged, remove=0.98):
    base, terms = all_spans(text, flagged)
    if not base:
        return text
    own = {value(k, text[a:b]) for k, a, b in base}
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in base]
    spans += [(a, b, "" if max(x for (e, t), x in flagged.items() if e in own and t == lower_az(text[a:b])) >= remove else "[TERM]") for _, a, b in terms]
    out, at = [], 0
    for a, b, put in sorted(spans):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


# -- licences ------------------------------------------------------------------------------------------------------------


def base_licences(text):
    own = words(text)
    return [(i, label) for i in range(len(own)) for phrase, label in licences.BASE_PHRASES.items() if own[i : i + len(phrase.split())] == phrase.split()]


def holds(text, template):
    """Whether a stretch of the text has all key phrases and most of the template's words in order."""
    own, want = words(text), words(template.text)
    size = len(want) + 12
    for i in range(max(1, len(own) - size + 1)):
        stretch = own[i : i + size]
        joined = " " + " ".join(stretch) + " "
        if all(f" {p} " in joined for p in template.key_phrases) and sum(b.size for b in SequenceMatcher(None, want, stretch, autojunk=False).get_matching_blocks()) / len(want) >= 0.6:
            return True
    return False
