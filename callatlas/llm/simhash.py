"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are made without a shuffle. Equal fingerprints become one class at once. If
two fingerprints differ in at most `radius` of 64 bits, then of any `radius` + g blocks of
bits at least g agree, so every set of g blocks is a table in which such pairs share a
bucket. A bucket with more than CHUNK members is divided by its remaining bits in the same
way: of `radius` + 1 blocks of these at least one agrees. Within buckets, bit planes are
stored vertically, 64 fingerprints to a word, and all distances at one shift are counted at
once by carry-save counters, plane by plane; words in which every lane is over the radius
are abandoned. What is still larger than CHUNK after LEVELS divisions is compared by pairs
of chunks. Only a forest of links leaves a bucket.

Defined results: a null or blank text has fingerprint zero, which links like any other. A
null doc_id counts as the largest; a component of such rows only has component null. Rows
with equal doc_ids stay separate rows. A bit that half of the hashes have is 0. Very long
texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, by_run, ddl, id_or_last, keep, load, record, run_starts
from .components import components, unite
from .grams import SIZE_1, mix

CHUNK, LEVELS = 2048, 2
LINKS = [("a", "long"), ("b", "long")]
BIT_COUNT_EVERY = 8


# --- fingerprints ----------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    h = np.array([xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), last, strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, carried columns)"""
    import pyarrow as pa

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column("text_bytes")], np.uint64)
            made = record([("doc_id", "long"), ("fp", "long")], b.column("doc_id"), fp)
            yield pa.RecordBatch.from_arrays([*made.columns, *(b.column(c) for c in carry)], names=["doc_id", "fp", *carry])

    rows = docs.select(id_or_last().alias("doc_id"), F.col("text").cast("binary").alias("text_bytes"), *carry)
    carried = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(each, f"doc_id long, fp long{carried}")


# --- comparison ----------------------------------------------------------------------------------


def planes(fp: np.ndarray) -> np.ndarray:
    """Row b, word w: bit b of fingerprints 64 w to 64 w + 63; with a word of zeros at the end. fp: a row of words for each, or one word."""
    words = fp if fp.ndim == 2 else fp[:, None]
    n = -(-len(words) // 64) * 64
    padded = np.zeros((n, words.shape[1]), np.uint64)
    padded[: len(words)] = words
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], n // 64 + 1), np.uint64)
    out[:, :-1] = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
    return out


def lanes_within(differing, n_planes: int, at: np.ndarray, open_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the lanes open_ in the words `at`, those with at most `radius` differing bits, and their words. differing(b, at): plane b of the differences."""
    counter = np.zeros((max(1, radius.bit_length()), len(at)), np.uint64)
    over = np.zeros(len(at), np.uint64)
    for b in range(n_planes):
        carry = differing(b, at)
        for c in counter:
            c[:], carry = c ^ carry, c & carry
        over |= carry
        if b % BIT_COUNT_EVERY == BIT_COUNT_EVERY - 1:
            stay = open_ & ~(over | above(counter, radius)) != 0
            if not stay.all():
                at, open_, over, counter = at[stay], open_[stay], over[stay], counter[:, stay]
                if not len(at):
                    break
    return at, open_ & ~(over | above(counter, radius))


def near_at_shift(sliced: np.ndarray, shift: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Of the lanes set in `lanes` (bit i: fingerprint i), those within the radius of the one `shift` later."""
    q, r = divmod(shift, 64)
    at, full = np.flatnonzero(lanes), sliced.shape[1] - 1
    at = at[at + q < sliced.shape[1]]

    def differing(b, at):
        later = sliced[b][at + q] >> np.uint64(r)
        if r:
            later |= sliced[b][np.minimum(at + q + 1, full)] << np.uint64(64 - r)
        return sliced[b][at] ^ later

    at, live = lanes_within(differing, len(sliced), at, lanes[at], radius)
    out = np.zeros(len(lanes), np.uint64)
    out[at] = live
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs of fingerprints, given as rows of words, are within the radius."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 17):
        x = a[lo : lo + (1 << 17)] ^ b[lo : lo + (1 << 17)]
        sliced = planes(x)
        lanes = np.zeros(sliced.shape[1], np.uint64)
        lanes[:-1] = as_lanes(np.ones(len(x), bool))
        every = np.flatnonzero(lanes)
        at, live = lanes_within(lambda k, at: sliced[k][at], len(sliced), every, lanes[every], radius)  # noqa: B023
        lanes[:] = 0
        lanes[at] = live
        out[lo : lo + len(x)] = np.unpackbits(lanes[:-1].view(np.uint8), bitorder="little")[: len(x)]
    return out


def wide_fingerprints(shingles: np.ndarray, of: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Fingerprints of 64 n_words bits for n texts. shingles: hashes of each text's, one after the other; of: the text of each"""
    size, out = np.bincount(of, minlength=n), np.zeros((n, n_words), np.uint64)
    for w in range(n_words):
        count = np.zeros((n, 64), np.int64)
        for lo in range(0, len(of), 1 << 17):
            x, text = mix(shingles[lo : lo + (1 << 17)] + np.uint64(w) * SIZE_1), of[lo : lo + (1 << 17)]
            at = run_starts(text)
            count[text[at]] += np.add.reduceat(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, axis=0, dtype=np.int32)
        out[:, w] = np.packbits(2 * count > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose binary counter is over the radius, from the highest bit down."""
    more = np.zeros(counter.shape[1], np.uint64)
    equal = ~more
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            more |= equal & counter[i]
            equal &= ~counter[i]
    return more


def as_lanes(which: np.ndarray) -> np.ndarray:
    n = -(-len(which) // 64) * 64
    padded = np.zeros(n, bool)
    padded[: len(which)] = which
    return np.packbits(padded, bitorder="little").view(np.uint64)


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """group: sorted. For each row, the first row that it reaches by links within its group."""
    n = len(fp)
    parent = np.arange(n)
    at = run_starts(group)
    sizes = np.diff(np.append(at, n))
    sliced = planes(fp)
    longest = int(sizes.max(initial=0))
    for shift in range(1, longest):
        ask = np.zeros(n, bool)
        ask[:-shift] = (group[:-shift] == group[shift:]) & (parent[:-shift] != parent[shift:])
        if not ask.any():
            continue
        near = near_at_shift(sliced, shift, as_lanes(ask), radius)
        x = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        if len(x):
            parent = unite(parent, x, x + shift)
    return parent


def link_buckets(batches, radius: int):
    """Links of a forest for every bucket, or pair of chunks of one."""
    held: list[dict] = []
    total = 0

    def flush():
        v = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        at = run_starts(v["bucket"], v["part"])
        size = np.diff(np.append(at, len(v["part"])))
        group = np.repeat(np.arange(len(at)), size)
        several = size[group] > 1
        fp, rep = v["fp"][several].view(np.uint64), v["rep"][several]
        parent = forest(group[several], fp, radius)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        yield record(LINKS, rep[child], rep[parent[child]])

    for v in by_run(batches, "bucket", ["bucket", "part", "fp", "rep"]):
        held.append(v)
        total += len(v["fp"])
        if total > 30_000:
            yield from flush()
            held, total = [], 0
    if held:
        yield from flush()


def mask_of(bits) -> int:
    """These bits, as a signed 64-bit number."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def tables(radius: int, n: int) -> list[int]:
    """For each table the mask of the bits that agree in it, so that a random bucket has about one member or few."""
    need = max(8.0, math.log2(max(n, 2)) - 3)
    blocks = next(b for b in range(radius + 1, 65) if 64 // b * (b - radius) >= need or b >= radius + 6)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [mask_of(b for i in which for b in range(edges[i], edges[i + 1])) for which in combinations(range(blocks), blocks - radius)]


def finer(mask: int, radius: int) -> list[int]:
    """Masks that each add one of radius + 1 blocks of the remaining bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cut = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
    had = [b for b in range(64) if mask >> b & 1]
    return [mask_of(had + rest[cut[i] : cut[i + 1]]) for i in range(radius + 1)]


def bucketed(classes: DataFrame, radius: int, n: int, chunk: int, levels: int) -> DataFrame:
    """(bucket, fp, rep, n_chunks): n_chunks is null but for buckets that are over `chunk` after all levels."""
    masks, done = tables(radius, n), []
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))).alias("bucket")) for t, m in enumerate(masks)]
    rows = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.*")
    for level in range(levels + 1):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > chunk)
        hot = keep(sizes.select(F.col("bucket").alias("hot"), F.ceil(F.col("size") / chunk).cast("int").alias("n_chunks")))
        if hot.isEmpty():
            break
        rows = rows.join(hot, rows.bucket == hot.hot, "left").drop("hot")
        if level == levels:
            return union([*done, rows.select("bucket", "fp", "rep", "n_chunks")])
        done.append(rows.filter("n_chunks IS NULL").select("bucket", "fp", "rep", "n_chunks"))
        next_ = [(t, t * (radius + 1) + i, m) for t, mask in enumerate(masks) for i, m in enumerate(finer(mask, radius))]
        masks = [m for *_, m in next_]
        by = rows.sparkSession.createDataFrame(next_, "t int, t2 int, mask long")  # as many rows as masks: hundreds
        rows = rows.filter("n_chunks IS NOT NULL").join(F.broadcast(by), "t")
        rows = rows.select("fp", "rep", F.col("t2").alias("t"), F.xxhash64("bucket", "t2", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    return union([*done, rows.select("bucket", "fp", "rep", F.lit(None).cast("int").alias("n_chunks"))])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linked(classes: DataFrame, radius: int, n: int, chunk: int = CHUNK, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) between classes (fp, rep), each a rep, that join all classes within the radius of each other."""
    rows = bucketed(classes, radius, n, chunk, levels)
    mine = F.pmod(F.xxhash64("fp"), F.col("n_chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda j: F.least(mine, j) * F.lit(1 << 24) + F.greatest(mine, j))
    rows = rows.select("bucket", "fp", "rep", F.explode(F.when(F.col("n_chunks").isNull(), F.array(F.lit(-1))).otherwise(pairs)).alias("part"))
    schema = ddl(LINKS)
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "fp").mapInArrow(lambda b: link_buckets(b, radius), schema)


def classified(each: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(fp, rep, component_id): each fingerprint with its smallest doc_id, and that of all it is linked to."""
    classes = keep(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    of = components(linked(classes, radius, classes.count(), chunk))
    return classes.join(of, classes.rep == of.id, "left").select("fp", "rep", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id)"""
    each = keep(fingerprints(docs, shingle))
    classes = classified(each, radius, chunk).select(F.col("fp").alias("class"), "component_id")
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return each.join(classes, F.col("fp") == F.col("class")).select(no_id("doc_id"), "fp", no_id("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
