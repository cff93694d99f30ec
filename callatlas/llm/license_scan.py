"""License scans with template markup.

A template is wording with markup: [[ ]] holds a part that may be left out, | divides
alternatives in it, {{a-b}} stands for a to b words of any kind (a name, a year, a version),
and {{not a b}} at the end says which words must not come next. Each template is compiled
into an automaton over words. A text is accepted where the automaton reads its mandatory
wording exactly, from any word on; the longest reading counts.

Word hashes decide first, for a whole batch at once, where base phrases stand and which
texts hold a template's rarest word; only those are read by the automata, whole.

The score is 1 - 2**-k, where k counts the templates that accept, and one more if a base
phrase stands in the text.

Defined results: a null text is empty: no words, no labels, score 0. Repeated rows are
scanned each alone, and very long texts whole. Where readings of several templates overlap,
each counts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, load, record
from .grams import joined, span_hashes

SCANNED = [("doc_id", "long"), ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]

#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed values: (label, template). Wording of well-known public licenses and of lines that name them.
TEMPLATES = [
    ("mit", "[[this {{1-3}} is]] [[released|licensed|distributed|available]] under the [[terms of the]] mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of {{1-8}} to deal in the software without restriction "
        "[[including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software]]",
    ),
    ("apache-2", "licensed under the apache license version 2 [[0]]"),
    ("apache-2", "[[released|distributed|available]] under the [[terms of the]] apache license [[version]] 2 [[0]]"),
    ("gpl-2", "[[this {{1-3}} is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 2"),
    ("gpl-3", "[[this {{1-3}} is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 3"),
    ("lgpl", "licensed under the gnu lesser general public license [[version {{1-2}}]]"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version {{1-2}}"),
    ("agpl-3", "licensed under the gnu affero general public license [[version 3]]"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation [[either]] version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the [[{{1-1}} clause]] bsd license"),
    ("bsd-3", "neither the name of {{1-8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [[provided that the above copyright notice and this permission notice appear in all copies]]"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely [[subject to the following restrictions]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software]]"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mpl-2", "[[this source code form is]] subject to the terms of the mozilla public license [[v|version]] 2 0"),
    ("cc0", "licensed under [[a]] [[the]] [[creative commons]] cc0 [[1 0]]"),
    ("cc-by", "licensed under [[a]] [[the]] [[creative commons]] cc by {{1-1}} 0"),
    ("cc-by-sa", "licensed under [[a]] [[the]] [[creative commons]] cc by sa [[{{1-1}} 0]]"),
    ("cc-by-nd", "licensed under [[a]] [[the]] [[creative commons]] cc by nd [[{{1-1}} 0]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[{{1-1}} 0]] {{not sa nd}}"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial [[{{1-1}} 0]] [[international]] license"),
    ("cc-by-nc-sa", "cc by nc sa [[{{1-1}} 0]]"),
    ("cc-by-nc-nd", "cc by nc nd [[{{1-1}} 0]]"),
]


# --- automata -----------------------------------------------------------------------------------


class Automaton:
    """A nondeterministic automaton. word[s]: what state s reads (None: any word); then[s]: the states after it."""

    def __init__(self, template: str):
        self.word: list[str | None] = []
        self.then: list[frozenset[int]] = []
        self.mandatory: list[str] = []
        ending = re.search(r"\{\{not ([^}]+)\}\}\s*$", template)
        self.not_next = frozenset(ending[1].split()) if ending else frozenset()
        parts = re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\||[^\s\[\]{}|]+", template[: ending.start()] if ending else template)
        tree, rest = self._parse(parts, 0, True)
        assert rest == len(parts), f"unbalanced markup in {template!r}"
        self.accept = self._state("", frozenset())
        self.start = self._build(tree, frozenset([self.accept]))
        self.first = {self.word[s] for s in self.start}
        assert self.mandatory and None not in self.first and self.accept not in self.start, f"nothing to start from in {template!r}"

    def _state(self, word, then) -> int:
        self.word.append(word)
        self.then.append(then)
        return len(self.word) - 1

    def _parse(self, parts, at, must):
        """A list of alternatives, each a list of words, (low, high) or nested optional parts."""
        alternatives: list[list] = [[]]
        while at < len(parts) and parts[at] != "]]":
            p = parts[at]
            if p == "[[":
                inner, at = self._parse(parts, at + 1, False)
                assert at < len(parts), "an optional part isn't closed"
                alternatives[-1].append(("optional", inner))
            elif p == "|":
                alternatives.append([])
            elif p.startswith("{{"):
                alternatives[-1].append(tuple(map(int, p[2:-2].split("-"))))
            else:
                alternatives[-1].append(p)
                if must:
                    self.mandatory.append(p)
            at += 1
        return alternatives, at

    def _build(self, alternatives, after: frozenset) -> frozenset:
        """The states to be in before reading these alternatives, if `after` comes next."""
        out: frozenset = frozenset()
        for sequence in alternatives:
            now = after
            for item in reversed(sequence):
                if isinstance(item, str):
                    now = frozenset([self._state(item, now)])
                elif item[0] == "optional":
                    now |= self._build(item[1], now)
                else:
                    low, high = item
                    end = now
                    for i in range(high, 0, -1):
                        any_word = frozenset([self._state(None, now)])
                        now = any_word | (end if i > low else frozenset())
            out |= now
        return out

    def longest(self, words: list[str], at: int) -> int:
        """Where the longest reading from `at` on ends; `at` if there is none."""
        states, end = self.start, at
        for i in range(at, len(words)):
            states = frozenset().union(*(self.then[s] for s in states if self.word[s] is None or self.word[s] == words[i]))
            if self.accept in states and (i + 1 == len(words) or words[i + 1] not in self.not_next):
                end = i + 1
            if not states:
                break
        return end

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        found, at = [], 0
        while at < len(words):
            if words[at] in self.first and (end := self.longest(words, at)) > at:
                found.append((at, end))
                at = end
            else:
                at += 1
        return found


# --- scanning -------------------------------------------------------------------------------------


def word_bytes() -> np.ndarray:
    """Which lower-cased bytes are part of words."""
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def hashes(texts: list[bytes]):
    """(hash, first byte, end byte, text number) of each word of lower-cased texts"""
    buf, at = joined(texts)
    edge = np.diff(np.concatenate([[0], word_bytes()[buf].view(np.int8), [0]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(buf, first, end), first, end, np.searchsorted(at, first, "right") - 1


class Scanner:
    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        self.base = [(hashes([p.encode()])[0], p.encode().split(), label) for p, label in base.items()]
        self.templates = [(label, Automaton(t)) for label, t in templates]
        rare = [max(a.mandatory, key=lambda w: (len(w), w)) for _, a in self.templates]
        self.rare = [hashes([w.encode()])[0][0] for w in rare]

    def scan(self, texts: list[bytes]) -> list[tuple]:
        texts = [t.lower() for t in texts]
        h, first, end, text = hashes(texts)
        n = len(texts)
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int64)
        places, labels, extra = [[] for _ in texts], [set() for _ in texts], [[] for _ in texts]
        offset = lambda i: sum(len(t) + 1 for t in texts[:i])
        for phrase, words, label in self.base:
            m = len(h) - len(phrase) + 1
            if m > 0:
                hit = h[:m] == phrase[0]
                for i in range(1, len(phrase)):
                    hit &= h[i : m + i] == phrase[i]
                hit &= text[:m] == text[len(phrase) - 1 :]
                for at in np.flatnonzero(hit).tolist():
                    i = int(text[at])
                    t0, span = offset(i), slice(at, at + len(phrase))
                    if [texts[i][a - t0 : b - t0] for a, b in zip(first[span].tolist(), end[span].tolist(), strict=True)] == words:
                        places[i].append(at - int(starts[i]))
                        labels[i].add(label)
        read: dict[int, list[str]] = {}
        for (label, automaton), rare in zip(self.templates, self.rare, strict=True):
            for i in np.unique(text[h == rare]).tolist():
                if i not in read:
                    at, t0 = slice(starts[i], starts[i + 1]), offset(i)
                    read[i] = [texts[i][a:b].decode() for a, b in zip((first[at] - t0).tolist(), (end[at] - t0).tolist(), strict=True)]
                if automaton.spans(read[i]):
                    extra[i].append(label)
        return [
            (int(starts[i + 1] - starts[i]), len(p), min(p, default=None), max(p, default=None), ",".join(sorted(labels[i])), ",".join(sorted(labels[i] | {*extra[i]})), 1 - 0.5 ** (len(extra[i]) + bool(p)))
            for i, p in enumerate(places)
        ]


def scanned(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates

    def each(batches):
        scanner = Scanner(base, templates)
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), b.column("text")
            at = 0
            while at < len(ids):
                held, size = [], 0
                while at + len(held) < len(ids) and size < 1 << 20:
                    held.append(rows[at + len(held)].as_py() or b"")
                    size += len(held[-1])
                got = scanner.scan(held)
                yield record(SCANNED, ids[at : at + len(held)], *map(list, zip(*got, strict=True)))
                at += len(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(each, ddl(SCANNED))


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(load(spark, sf_dir, "documents"))
