"""Licence scans by a positional rare-token index.

The index holds, for each licence template, the positions of its words, and for each word its inverse
document frequency over the templates. A file is scanned once: its rare licence words are looked up, all of them,
every (word position, template position) pair votes for the template at the difference of the two
positions, and alignments with enough votes are candidates. Templates with a key-phrase word that stands nowhere
in the file cannot be verified and take no votes. A candidate counts when every mandatory key
phrase of the template stands in the aligned stretch of the file; its score is the share of the template's
words found in order there.

Besides, three base phrases are found wherever their words stand consecutively; their labels always stay.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned each;
a null doc_id stays null; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, column, id_text, texts_of, words_of

#: Phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, score: double>>"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]
    words: list[bytes] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", words_of(self.text))


#: Public licence notices and opening grants; labels are SPDX-like identifiers.
TEMPLATES = (
    Template("mit-notice", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "sublicense")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "compliance with the license")),
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    Template("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2")),
    Template("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3")),
    Template("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("lesser general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software released into the public domain",)),
)


class RareTokenIndex:
    """min_votes: share of a template's rare words
    that must agree on a position. slack: words that may be missing or added between agreeing words. A word is rare
    if at most `max_share` of the templates hold it."""

    def __init__(self, templates=TEMPLATES, min_votes: float = 0.6, slack: int = 4, min_score: float = 0.6, max_share: float = 0.35):
        self.templates, self.min_votes, self.slack, self.min_score = templates, min_votes, slack, min_score
        df = Counter(w for t in templates for w in set(t.words))
        self.idf = {w: math.log(len(templates) / n) for w, n in df.items() if n <= max(1, max_share * len(templates))}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(templates):
            for q, w in enumerate(t.words):
                if w in self.idf:
                    self.postings[w].append((k, q))
        self.n_rare = [len({w for w in t.words if w in self.idf}) for t in templates]
        self.keys = [[p.encode() for p in t.key_phrases] for t in templates]
        self.key_words = [{w for p in keys for w in p.split()} for keys in self.keys]
        self.base = {p.encode(): label for p, label in BASE_PHRASES.items()}
        self.base_tail = {p.split()[-1] for p in self.base}

    def base_places(self, words: list[bytes], text: bytes) -> list[tuple[int, str]]:
        if not any(w in text for w in self.base_tail):
            return []
        out = []
        for i, w in enumerate(words):
            if w in self.base_tail:
                for phrase, label in self.base.items():
                    own = phrase.split()
                    if i + 1 >= len(own) and words[i + 1 - len(own) : i + 1] == own:
                        out.append((i + 1 - len(own), label))
        return out

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, score) of every verified alignment, best for each label and place."""
        present = set(words)
        able = {k for k, own in enumerate(self.key_words) if own <= present}
        if not able:
            return []
        chosen = {w: places for w in present & self.idf.keys() if (places := [(k, q) for k, q in self.postings[w] if k in able])}
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for p, w in enumerate(words):
            if w in chosen:
                for k, q in chosen[w]:
                    votes[k, (p - q) // self.slack].add(w)
        found = []
        for (k, at), own in votes.items():
            agree = own | votes.get((k, at + 1), set())
            if len(agree) < max(2, self.min_votes * self.n_rare[k]) and len(agree) < self.n_rare[k]:
                continue
            t = self.templates[k]
            lo, hi = max(0, at * self.slack - self.slack), min(len(words), at * self.slack + len(t.words) + 3 * self.slack)
            stretch = words[lo:hi]
            joined = b" " + b" ".join(stretch) + b" "
            if not all(b" " + key + b" " in joined for key in self.keys[k]):
                continue
            blocks = [b for b in SequenceMatcher(None, t.words, stretch, autojunk=False).get_matching_blocks() if b.size]
            score = sum(b.size for b in blocks) / len(t.words)
            if score >= self.min_score:
                found.append((t.label, lo + blocks[0].b, lo + blocks[-1].b + blocks[-1].size - 1, score))
        best: dict[tuple[str, int], tuple[str, int, int, float]] = {}
        for x in sorted(found, key=lambda x: (-x[3], x[1])):
            best.setdefault((x[0], x[2]), x)
        return sorted(best.values(), key=lambda x: (x[1], x[0]))


_index: RareTokenIndex | None = None


def index() -> RareTokenIndex:
    global _index
    _index = _index or RareTokenIndex()
    return _index


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One map over the scan, no shuffle."""

    def run(batch):
        ix, rows = index(), []
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
            words = words_of(text)
            places = ix.base_places(words, text.encode().lower())
            spans = ix.scan(words)
            base = {label for _, label in places}
            starts = [p for p, _ in places]
            score = 1.0 if base and not spans else max((s[3] for s in spans), default=0.0)
            rows.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, [dict(zip(("label", "first_word", "last_word", "score"), s, strict=True)) for s in spans]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
        types = (pa.int64(),) * 5 + (pa.string(), pa.string(), pa.float64(), span)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return arrow_map(id_text(docs, id_col, text_col), run, SCHEMA)
