"""Repeated bytes over several shards against brute force."""

import random
from collections import Counter

from callatlas.llm.suffix_dedup import remove_repeated_bytes


def test_copies_in_one_shard(spark):
    """Rows with one id and text share a shard; the start of each text is also that of other texts, before other bytes."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        heading = "".join(rng.choices("abcdefghij ", k=120))
        for _ in range(4):
            texts.append(heading + "".join(rng.choices("klmnopqrst ", k=400)))
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(1000 + i, t[:120] + "".join(rng.choices("uvwxyz ", k=400))) for i, t in enumerate(texts)]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    expect = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        expect.append((d, sum(gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in remove_repeated_bytes(docs, size=8000).select("doc_id", "n_removed").collect()]
    assert sorted(got) == sorted(expect)
