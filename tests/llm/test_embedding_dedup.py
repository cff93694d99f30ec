"""Links against brute force: many nodes, extreme sizes of components, odd ids, clashing columns."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from callatlas.llm.embedding_dedup import near_duplicates

from .test_operators import components


def cosine(x, y):
    x, y = ([Fraction(float(a)) for a in v] for v in (x, y))
    dot, xx, yy = (sum(a * b for a, b in zip(p, q, strict=True)) for p, q in ((x, y), (x, x), (y, y)))
    return math.sqrt(dot * dot / (xx * yy)) * (-1 if dot < 0 else 1)


def expected(rows):
    usable = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for n, i in enumerate(usable) for j in usable[n + 1 :] if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.98]
    n, of = Counter(x for p in links for x in p), components(len(rows), links)
    last = 2**63 - 1
    smallest = {}
    for i, r in enumerate(rows):
        smallest[of[i]] = min(smallest.get(of[i], last), last if r[0] is None else r[0])
    shown = lambda x: None if x == last else x
    return sorted([(r[0], n[i], shown(smallest[of[i]]), r[0] is not None and r[0] == smallest[of[i]]) for i, r in enumerate(rows)], key=repr)


def made():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        base = rng.normal(size=12)
        for _ in range(rng.integers(1, 14)):
            rows.append([base + rng.normal(size=12) * rng.choice([0.0, 0.03, 0.06, 0.1]), i % 2])
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(rows)]
    more = [[1e-200, 2e-200, 3e-200], [9.0, 1.0, 1.0], [1.0, 2.0, 3.0], [5e-324, 1e-323, 1.5e-323], [1e200] * 3, [2e200] * 3, [1e308, 1e308, 9.9e307], [-1e200, -1e200, -1e200], [0.0, 0.0, 0.0], [float("inf"), 1.0, 1.0], [float("nan"), 1.0, 1.0], [None, 1.0, 1.0], [], None, [1.0, 1.0], [-0.0, 0.0, 1.0], [0.0, 0.0, 2.0]]
    rows += [(1000 + i, v, 7) for i, v in enumerate(more)]
    rows += [(None, [1.0, 1.0, 1.0], 7), (None, [3.0, -1.0, 0.0], 8), (None, [3.0, -1.0, 0.001], 8), (3, [0.0, 1.0, 0.0], 9), (3, [1.0, 0.0, 0.0], 9), (50, [1.0, 1.0], None)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk": 8, "children": 3}, {"chunk": 2, "children": 2}])
def test_against_brute_force(spark, sizes):
    rows = made()
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "vec_id long, embedding array<double>, label int, node string, member boolean")
    got = near_duplicates(df, **sizes).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_many_within_reach(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 1e-4).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r)[1:] for r in near_duplicates(df, chunk=7, children=4).collect()} == {(59, 0, True), (59, 0, False)}
