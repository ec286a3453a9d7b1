"""Token ids of whole texts by the tokenizers library, fast on repetitive corpora.

A text is cut where the pre-tokenizer of the file always starts a new piece, so its ids are the ids of the parts, one after
the other. Parts repeat, so the ids of each distinct part are asked from the library once for each worker and
kept as little-endian unsigned 32-bit bytes.

Byte-level files: a part starts at a space before a non-space. Files that lower-case and drop white space: parts
are the lower-cased words. In both, a new part that is words and closing punctuation, or has a line break between words, is put together
from its own parts, so "word", "word," and "word." cost one call. Texts that hold a special string, or
characters whose folding depends on their neighbours, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .common import hold

CUT = re.compile(r" (?=\S)")
#: Where none of these stands, cutting at every space is the same, and faster.
ASCII_RUNS = tuple(" " + c for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters, then ASCII punctuation without apostrophes: always two pieces.
TAIL = re.compile(r"(.*[A-Za-z])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
#: The characters of its second piece.
TAIL_MARKS = "".join(c for c in map(chr, range(128)) if TAIL.fullmatch("a" + c))
#: Separators that the libraries' white space and Python's judge differently.
ODD = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: A worker's cache of parts gives up its long parts (short ones are the frequent ones), or all, beyond so many MB, estimated with OVERHEAD bytes an
#: entry. The default leaves room for workers that have run other stages.
CACHE_MB, OVERHEAD, SHORT = 110, 200, 7


def cut_at_spaces(text: str) -> list[str]:
    """CUT.split(text)."""
    if text.endswith(" ") or any(run in text for run in ASCII_RUNS) or (not text.isascii() and WIDE_SPACE.search(text)):
        return CUT.split(text)
    return text.split(" ")


class PartEncoder:
    def __init__(self, path: str, cache_mb: int = CACHE_MB):
        self.limit = cache_mb << 20
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.folds = any(n["type"] == "Lowercase" for n in steps)  # and then white space is dropped
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a word (or, byte-level, start one)
        ends = spec["model"].get("end_of_word_suffix")
        for token, i in vocab.items():
            self.edge[i] = token.endswith(ends) if ends else token.startswith("Ġ")
        self.ends = bool(ends)
        #: part -> ids; "\n" + part: the part without the space before it
        self.cache: dict[str, bytes] = {}
        self.size = 0

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Words of letters only, each after a space, many in a call: word edges show in the ids."""
        out = []
        for lo in range(0, len(words), 2000):
            own = words[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode(" " + " ".join(own), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(own):
                out += self._encoded([" " + w for w in own])
                continue
            at = 4 * (at + 1 if self.ends else np.append(at[1:], len(ids)))
            data, first = ids.tobytes(), 0
            for last in at.tolist():
                out.append(data[first:last])
                first = last
        return out

    def _cut(self, text: str) -> list[str] | None:
        """Parts of a text, the first without a space before it; None: the library takes it whole."""
        if self.folds:
            text = text.lower() if text.isascii() or (unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text) else None
            if text is None or ODD.search(text) or any(s in text for s in self.special):
                return None
            return text.split()
        if any(s in text for s in self.special):
            return None
        parts = cut_at_spaces(text)
        parts[0] = "\n" + parts[0]
        return parts

    def _pieces(self, part: str) -> list[str]:
        """A part's own parts; a part that stays as it is, is its only one."""
        if self.folds and "\n" not in part:  # nearly all of these files' parts
            head = part.rstrip(TAIL_MARKS)
            return [head, part[len(head) :]] if head and len(head) < len(part) and head[-1].isascii() and head[-1].isalpha() else [part]
        spaced = "" if self.folds else "\n"
        raw = part.startswith("\n")
        lines = (part[1:] if raw else part).split("\n")
        if len(lines) > 1 and not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return [part]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n\n")
            before = spaced if i or raw else ""
            m = TAIL.fullmatch(line)
            out += [before + m[1], spaced + m[2]] if m else [before + line]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if self.size > self.limit:
            self.cache = {k: v for k, v in self.cache.items() if len(k) <= SHORT}
            self.size = (OVERHEAD + SHORT) * len(self.cache)
            if self.size > self.limit // 2:
                self.cache, self.size = {}, 0
        cache = self.cache
        cut = [self._cut(t) if t else [] for t in texts]
        found = [list(map(cache.get, parts)) if parts else [] for parts in cut]
        holes = [_places(own, None) for own in found]
        new = {parts[i] for parts, own in zip(cut, holes, strict=True) for i in own}
        if new:
            self._learn(new)
            for parts, own, ids in zip(cut, holes, found, strict=True):
                for i in own:
                    ids[i] = cache[parts[i]]
        whole = iter(self._encoded([t for t, parts in zip(texts, cut, strict=True) if parts is None]))
        return [next(whole) if parts is None else b"".join(own) for parts, own in zip(cut, found, strict=True)]

    def _learn(self, new: set[str]) -> None:
        cache = self.cache
        words = set(filter(str.isalpha, new))
        made = {part: self._pieces(part) for part in new - words}
        asked = {p for own in made.values() for p in own if p not in cache}
        words |= set(filter(str.isalpha, asked))
        ordered, rest = list(words), list(asked - words)
        cache.update(zip(ordered, self._encoded_words(ordered), strict=True))
        cache.update(zip(rest, self._encoded([p if self.folds else p[1:] if p[0] == "\n" else " " + p for p in rest]), strict=True))
        cache.update({part: b"".join(map(cache.__getitem__, own)) for part, own in made.items() if part not in cache})
        self.size += sum(map(len, words)) + sum(map(len, made)) + OVERHEAD * (len(words) + len(made))


def _places(values: list, wanted) -> list[int]:
    """Where `wanted` stands in the list, found without a Python step for each other value."""
    out, at = [], -1
    try:
        while True:
            at = values.index(wanted, at + 1)
            out.append(at)
    except ValueError:
        return out


_encoders: dict[tuple[str, int], PartEncoder] = {}


def encoder(path: str, cache_mb: int = CACHE_MB) -> PartEncoder:
    """One for each worker process and file."""
    hold("encoding", _encoders.clear)
    if (path, cache_mb) not in _encoders:
        _encoders[path, cache_mb] = PartEncoder(path, cache_mb)
    return _encoders[path, cache_mb]


def groups_of(texts: list[str], chars: int = 1 << 20):
    """Ranges of texts of about so many characters, so that a batch of long texts takes bounded memory."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
