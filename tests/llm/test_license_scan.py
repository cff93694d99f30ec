"""Labels of templates against regular expressions made from the same markup."""

import random
import re

from callatlas.llm.license_scan import BASE, TEMPLATES, Automaton, Scanner


def pattern(template):
    """The markup as a regular expression over words that each end with a space."""
    out = ""
    ending = re.search(r"\{\{not ([^}]+)\}\}$", template)
    for t in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\||[^\s\[\]{}|]+", template[: ending.start()] if ending else template):
        out += {"[[": "(?:", "]]": ")?", "|": "|"}.get(t) or ("(?:[^ ]+ ){%s}" % t[2:-2].replace("-", ",") if t[0] == "{" else f"{t} ")
    return "(?<![^ ])" + out + (f"(?!(?:{ending[1].replace(' ', '|')}) )" if ending else "")


def by_pattern(words):
    text = "".join(f"{w} " for w in words)
    return [label for label, t in TEMPLATES if re.search(pattern(t), text)]


def test_against_patterns():
    rng = random.Random(2)
    scanner = Scanner(BASE, TEMPLATES)
    vocabulary = [w for _, t in TEMPLATES for w in re.findall(r"[a-z0-9]+", re.sub(r"\{\{[^}]*\}\}", "", t))]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(200)]
    for _, t in TEMPLATES:
        for _ in range(12):
            made = re.sub(r"\{\{not [^}]+\}\}$", lambda _: rng.choice(["", "sa", "nd", "x"]), t)
            made = re.sub(r"\{\{(\d+)-(\d+)\}\}", lambda m: " ".join(rng.choices("4 acme the".split(), k=rng.randint(max(0, int(m[1]) - 1), int(m[2]) + 1))), made)
            while "[[" in made:
                made = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: rng.choice(["", *m[1].split("|")]), made)
            words = made.split()
            if rng.random() < 0.3 and words:
                words.pop(rng.randrange(len(words)))
            texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(0, 4)), *words, *rng.choices(vocabulary, k=rng.randint(0, 4))]))
    accepted = 0
    for text, got in zip(texts, scanner.scan([t.encode() for t in texts]), strict=True):
        expect = by_pattern(text.split())
        accepted += bool(expect)
        base = {label for p, label in BASE.items() if f" {p} " in f" {text} "}
        assert got[5] == ",".join(sorted({*expect} | base)), text
        assert got[6] == 1 - 0.5 ** (len(expect) + bool(base))
    assert accepted > 150


def test_real_notices():
    scanner = Scanner(BASE, TEMPLATES)
    cases = {
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
        "subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        "subject to the terms of the Mozilla Public License, version 2.0": "mpl-2",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
        "Licensed under CC BY-SA 4.0": "cc-by-sa",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    }
    assert {t: scanner.scan([t.encode()])[0][5] for t in cases} == cases
    assert Automaton("a [[b|c d]] e").spans("x a c d e a e a b".split()) == [(1, 5), (5, 7)]
