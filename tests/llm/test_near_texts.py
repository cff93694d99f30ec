"""Near copies against brute force where false candidates and oversized buckets are common."""

import random

from callatlas.llm.near_texts import representatives

from .test_operators import near_groups


def left(spark, texts, **options):
    return representatives(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), (), **options).count()


def test_shared_boilerplate(spark):
    """Four fifths of each text are the same, so that false candidates are far more than true ones."""
    rng = random.Random(11)
    boilerplate, texts = [f"b{i}" for i in range(165)], []
    for i in range(300):
        own = [f"o{rng.randrange(10**6)}" for _ in range(35)]
        texts.append(" ".join(boilerplate + own))
        if i % 3 == 0:
            texts.append(" ".join(boilerplate + own[: -rng.randint(1, 30)] + [f"n{i}"]))
    rng.shuffle(texts)
    n = len(set(near_groups(texts).values()))
    assert n <= len(texts) - 50
    assert left(spark, texts) == n


def test_oversized_buckets(spark):
    """Each pair shares two buckets, which are over the size for one part."""
    rng = random.Random(12)
    texts = []
    for i in range(150):
        w = [f"v{i}x{rng.randrange(1000)}" for _ in range(9)]
        texts += [" ".join(w), " ".join([*w, "tail"])]
    assert len(set(near_groups(texts).values())) == 150
    assert left(spark, texts, part=1) == 150
