"""Near copies of texts by the similarity of their word shingles: SimHash within the buckets of a prefix filter, then an exact check.

Similarity is that of the sets of five-word shingles (A-Z lower-cased; shared ones over all).
Texts with equal sets are one class at once. All sets are sorted in one order, shingles that
are rare in a sample first. Two sets at the threshold share a shingle among the first
fifth of each (and one more), so these are the buckets; where their first shared one stands
bounds what they share in all. Pairs within the bound are compared by SimHash fingerprints
of BITS bits, bit planes stored vertically (see simhash). RADIUS lets through all but a few
in a million of the pairs at the threshold, which differ in 19 to 24 bits on average with a
deviation of 4.5. What is near is checked on whole texts, texts near in size first. A bucket
of more than PART classes is dealt into parts, and each part is compared with each. Only
links that passed the check join parts, and a pair is left out only if such links join it
already; so the groups are those of all pairs at the threshold, but for what RADIUS loses.

Defined results: null and blank texts have no shingles and are one class. A text of fewer
than five words has one shingle, all its words. The row with the smallest doc_id of a group
stays, null counting as the largest; of rows that share it, that with the smallest hash.
Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_run, ddl, discard, id_or_last, keep, record, run_starts
from .components import components
from .grams import SIZE_2, Windows, mix, words
from .simhash import near_pairs as near_fingerprints
from .simhash import wide_fingerprints

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS = 128, 46
#: For the order of shingles, which any sample gives right results with.
SAMPLE, FREQUENT = 20_000, 100_000
#: Each round compares rows so far apart in their bucket; from the second on, also across parts.
ROUNDS = ((1, 2), (2, 6), (6, 48), (48, 1 << 62))
PART = 2048
BROADCAST_ROWS = 500_000
DESCRIBED = [("digest", "long")]
PREFIXES = [("bucket", "long"), ("digest", "long"), ("size", "int"), ("rest", "int"), *((f"fp{w}", "long") for w in range(BITS // 64))]
PRINTS = [c for c, _ in PREFIXES[4:]]
COUNTS = [("token", "long"), ("n", "long")]
LINKS = [("a", "long"), ("b", "long")]


# --- shingles ---------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles and the text's number, sorted by text and hash."""
    h, _, _, text, _ = words([t.lower() for t in texts])
    n_words = np.bincount(text, minlength=len(texts))
    count = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    of = np.repeat(np.arange(len(texts)), count)
    start = np.cumsum(n_words) - n_words
    first = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(first + size, (start + n_words)[of])
    g = Windows(h).hash(first, end)
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = run_starts(of, g)
    return g[new], of[new]


def described(texts: list[bytes]) -> list[np.ndarray]:
    """digest: a hash of the set of shingles"""
    g, of = shingle_sets(texts)
    digest = np.zeros(len(texts), np.uint64)
    np.add.at(digest, of, mix(g + SIZE_2))
    return [mix(digest)]


def pieces(rows, size: int = 1 << 20):
    held, total = [], 0
    for t in rows:
        held.append(t.as_py() or b"")
        total += len(held[-1])
        if total > size:
            yield held
            held, total = [], 0
    if held:
        yield held


def describe(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(doc_id, text, carried columns, digest, row_hash)"""
    import pyarrow as pa

    columns = ["doc_id", "text", *carry]

    def each(batches):
        for b in batches:
            parts = [described(p) for p in pieces(b.column("text").cast(pa.binary()))]
            got = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * len(DESCRIBED)
            made = record(DESCRIBED, *got)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made.columns], names=[*columns, *made.schema.names])

    rows = docs.select(id_or_last().alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(each, f"{schema}, {ddl(DESCRIBED)}").withColumn("row_hash", F.xxhash64("text", *carry))


# --- candidates ---------------------------------------------------------------------------------


def sample_counts(batches):
    import pyarrow as pa

    for b in batches:
        for texts in pieces(b.column("text").cast(pa.binary())):
            token, n = np.unique(shingle_sets(texts)[0], return_counts=True)
            yield record(COUNTS, token, n)


def frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and how many have them."""
    some = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(max(1, n // SAMPLE))) == 0)
    counts = some.select("text").mapInArrow(sample_counts, ddl(COUNTS)).groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    got = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token, n_of = got.token.to_numpy(np.int64).view(np.uint64), got.n.to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n_of[order]


def prefixes(g: np.ndarray, of: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(shingle, text, size of its set, shingles of the set from this one on) of the first shingles of each set"""
    weight = np.zeros(len(g), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        weight = np.where(known[at] == g, counts[at], 0)
    order = np.lexsort((g, weight, of))
    g, of = g[order], of[order]
    at = run_starts(of)
    sizes = np.diff(np.append(at, len(of)))
    size, rest = np.repeat(sizes, sizes), np.repeat(at + sizes, sizes) - np.arange(len(of))
    least = Fraction(SIMILARITY).limit_denominator(1000)
    first = least.denominator * rest >= least.numerator * size
    return g[first], of[first], size[first], rest[first]


def bucketed(texts: DataFrame, n: int) -> DataFrame:
    """(bucket, digest, size, rest, fingerprint): each class once for every shingle of its prefix"""
    import pyarrow as pa

    order = texts.sparkSession.sparkContext.broadcast(frequent(texts, n))

    def each(batches):
        for b in batches:
            digest, at = b.column("digest").to_numpy(), 0
            for some in pieces(b.column("text").cast(pa.binary())):
                every, text = shingle_sets(some)
                fp = wide_fingerprints(every, text, len(some), BITS // 64)
                g, of, size, rest = prefixes(every, text, *order.value)
                yield record(PREFIXES, g, digest[at + of], size, rest, *np.ascontiguousarray(fp[of].T))
                at += len(some)

    return texts.select("digest", "text").mapInArrow(each, ddl(PREFIXES))


def of_first(shifts: tuple[int, int]) -> bool:
    return shifts == ROUNDS[0]


def across(shifts: tuple[int, int]) -> int:
    """The first shift between two parts, which the first round leaves out."""
    return 1 if shifts == ROUNDS[1] else shifts[0]


def near_pairs(v: dict[str, np.ndarray], shifts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """v: sorted by bucket and part. Pairs of rows so far apart that may be at the threshold and aren't joined."""
    at = run_starts(v["bucket"], v["part"])
    size = np.diff(np.append(at, len(v["part"])))
    last = np.repeat(at + size, size)
    least = Fraction(SIMILARITY).limit_denominator(1000)
    n_words, rest = v["size"].astype(np.int64), v["rest"].astype(np.int64)
    found = [(np.zeros(0, np.int64),) * 2]
    x = np.arange(len(last))
    two = v["part"] >> 31 != v["part"] & ((1 << 31) - 1)
    for shift in range(across(shifts), min(shifts[1], int(size.max(initial=0)))):
        x = x[x + shift < last[x]]
        # sizes ascend, so that one too large for x ends its comparisons
        x = x[least.denominator * n_words[x] >= least.numerator * n_words[x + shift]]
        if not len(x):
            break
        y = x + shift
        fits = (least.numerator + least.denominator) * np.minimum(rest[x], rest[y]) >= least.numerator * (n_words[x] + n_words[y])
        fits &= v["group"][x] != v["group"][y]
        fits &= np.where(two[x], v["mine"][x] != v["mine"][y], shift >= shifts[0])
        found.append((x[fits], y[fits]))
    x, y = (np.concatenate(f) for f in zip(*found, strict=True))
    fp = np.stack([v[c].view(np.uint64) for c in PRINTS], axis=1)
    near = near_fingerprints(fp[x], fp[y], RADIUS)
    return x[near], y[near]


def link_parts(batches, shifts: tuple[int, int]):
    held: list[dict] = []
    total = 0

    def flush():
        v = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        x, y = near_pairs(v, shifts)
        a, b = np.minimum(v["digest"][x], v["digest"][y]), np.maximum(v["digest"][x], v["digest"][y])
        order = np.lexsort((b, a))
        once = order[run_starts(a[order], b[order])]
        yield record(LINKS, a[once], b[once])

    for v in by_run(batches, "bucket", ["bucket", "part", "mine", "digest", "size", "rest", "group", *PRINTS]):
        held.append(v)
        total += len(v["part"])
        if total > 30_000:
            yield from flush()
            held, total = [], 0
    if held:
        yield from flush()


def shared(rows: DataFrame, part: int) -> DataFrame:
    """(bucket, digest, size, rest, fingerprint, n_parts) of the buckets that several classes share; n_parts is null up to `part` of them"""
    sizes = keep(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    n_parts = F.when(F.col("n") > part, F.ceil(F.col("n") / part).cast("int"))
    by = sizes.select("bucket", n_parts.alias("n_parts"))
    return rows.join(F.broadcast(by) if sizes.count() <= BROADCAST_ROWS else by, "bucket")


def candidates(rows: DataFrame, of: DataFrame | None, shifts: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of digests, each once. of: the (id, component) of classes that are joined so far"""
    if of is None:
        rows = rows.withColumn("group", F.col("digest"))
    else:
        rows = rows.join(of.withColumnRenamed("id", "digest"), "digest", "left").withColumn("group", F.coalesce("component", "digest")).drop("component")
        open_ = rows.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"))
        rows = rows.join(open_.filter((F.col("lo") != F.col("hi")) & (F.col("n") > across(shifts))).select("bucket"), "bucket", "left_semi")
    mine = F.coalesce(F.pmod(F.xxhash64("digest", "bucket"), F.col("n_parts")), F.lit(0)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda j: F.least(mine, j) * F.lit(1 << 31) + F.greatest(mine, j))
    own = mine * F.lit(1 << 31) + mine
    parts = F.when(F.col("n_parts").isNull() | F.lit(of_first(shifts)), F.array(own)).otherwise(pairs)
    rows = rows.select("bucket", F.explode(parts).alias("part"), mine.alias("mine"), "digest", "size", "rest", "group", *PRINTS)
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "size", "digest")
    return dealt.mapInArrow(lambda b: link_parts(b, shifts), ddl(LINKS)).distinct()


# --- exact check ----------------------------------------------------------------------------------


def similarity(a: bytes, b: bytes) -> float:
    g, of = shingle_sets([a, b])
    first = int((of == 0).sum())
    shared = len(np.intersect1d(g[:first], g[first:], assume_unique=True))
    return shared / (len(g) - shared) if len(g) else 1.0


def check_pairs(batches):
    import pyarrow as pa

    for b in batches:
        texts = zip(*(b.column(c).cast(pa.binary()) for c in ("text_a", "text_b")), strict=True)
        near = pa.array([similarity(x.as_py() or b"", y.as_py() or b"") >= SIMILARITY for x, y in texts], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(near)


def representatives(docs: DataFrame, carry: tuple[str, ...], part: int = PART) -> DataFrame:
    """(doc_id, text, carried columns) of one row for each group of linked texts"""
    each = keep(describe(docs, carry))
    classes = keep(each.groupBy("digest").agg(F.min(F.struct("doc_id", "row_hash")).alias("first")))
    # all three keys, so that many copies of one text are spread; the same three tell repeated rows
    keys = ["digest", "doc_id", "row_hash"]
    texts = keep(each.join(classes.select("digest", "first.*"), keys).dropDuplicates(keys))
    discard(each)
    all_rows = keep(bucketed(texts, classes.count()))
    rows = keep(shared(all_rows, part))
    discard(all_rows)
    side = lambda c: texts.select(F.col("digest").alias(c), F.col("text").alias(f"text_{c}"))
    links, of = None, None
    for shifts in ROUNDS:
        pairs = keep(candidates(rows, of, shifts))
        if pairs.isEmpty():
            discard(pairs)
            continue
        found = keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check_pairs, ddl(LINKS)))
        discard(pairs)
        links = found if links is None else links.union(found)
        of = keep(components(links))
    discard(rows)
    if of is not None:
        group = F.coalesce("component", "digest").alias("group")
        grouped = classes.join(of, classes.digest == of.id, "left").select(group, F.struct("first", "digest").alias("which"))
        texts = texts.join(grouped.groupBy("group").agg(F.min("which").alias("which")).select("which.digest"), "digest", "left_semi")
    return texts.select("doc_id", "text", *carry)
