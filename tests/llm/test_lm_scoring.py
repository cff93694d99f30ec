"""The automaton's score against brute force over several shards and ranges of hashes."""

import math
import random
import zlib
from collections import Counter

import pytest

from callatlas.llm.lm_scoring import PRIOR, scored


def model(read, held):
    """p(token | tokens before it) of a model of these texts, each with an end, by counting."""
    n = Counter()
    for tokens, out in zip(read, held, strict=True):
        if not out:
            t = ("<s>", *tokens)
            n.update(t[i - k + 1 : i + 1] for i in range(1, len(t)) for k in (1, 2, 3) if i - k + 1 >= 0)
    singles = {k: v for k, v in n.items() if len(k) == 1}
    below = sum(singles.values()) + len(singles) + 1
    starts = held.count(False)

    def p(before, token):
        if not before:
            return (n[token,] + 1) / below
        seen = starts if before == ("<s>",) else n[before]
        prior = PRIOR[len(before) + 1]
        return (n[*before, token] + prior * p(before[1:], token)) / (seen + prior)

    return p, [k[0] for k in singles]


def made():
    rng = random.Random(4)
    texts = [None, ""] + [" ".join(f"w{int(rng.paretovariate(0.3)) % 20000}" for _ in range(rng.randint(1, 120))) for _ in range(400)]
    read = [[*(t or "").split(), "</s>"] for t in texts]
    return texts, read, [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]


def test_score(spark):
    texts, read, held = made()
    p, _ = model(read, held)
    expect = {i: sum(math.log10(p(tuple(["<s>", *r][max(0, j - 1) : j + 1]), x)) for j, x in enumerate(r)) for i, r in enumerate(read)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in scored(docs, size=20_000, range_bytes=9_000).collect()}
    assert got == pytest.approx(expect, rel=1e-9)


def test_mass_of_states():
    _, read, held = made()
    p, tokens = model(read, held)
    for before in (), ("<s>",), ("w1",), ("w1", "w1"), ("<s>", "w1"), ("w1", "never seen"):
        assert sum(p(before, t) for t in [*tokens, "unknown"]) == pytest.approx(1)


def test_held_out_is_better_than_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    score, base = scored(docs).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert score > 0.9 * base
