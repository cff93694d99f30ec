"""Scores of texts by a weighted backoff automaton, learned from the corpus itself.

The model is a smoothed trigram. States are contexts of up to two tokens: the root (none),
every word and the start of a text, and every pair of them that training saw. A state's arc
for a token w weighs

    p(w | state) = (count(state, w) + PRIOR * p(w | shorter state)) / (count(state) + PRIOR),

and its failure arc, for tokens that it has no arc for, leads to the state without the
oldest token and weighs PRIOR / (count(state) + PRIOR). The root weighs the add-one unigram
probability. So each state's probabilities add up to one, with one token that training
never saw. A text is read once, left to right: the state carries its last two tokens, each
token takes an arc after as many failure arcs as it needs, and logarithms add up.

States and arcs grow with the corpus, so they stay tables. n-grams are 64-bit hashes. A
shard of texts adds up its n-grams and sends them as sorted blocks, one for each range of
hashes; a range adds up what all shards have sent and returns the totals in the order of
each block, so that no hash travels twice. Single tokens and pairs go first. A triple of
which a pair stands in no other shard can't either, so its own shard's count is the total,
and only the others are sent. A block holds one n-gram or more: memory is that of a shard or
of a range at any size of the corpus.

Defined results: a null text is empty; it has one token, its end. Rows with equal or null
doc_ids are separate texts; a null doc_id isn't held out. Very long texts are read whole, in
the shard they fall into. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, chunks, ddl, keep, load, record, run_starts, sharded, text_bytes
from .grams import SIZE_2, both, mix, words

FOLDS, HELD_OUT = 7, 2
PRIOR = {2: 400.0, 3: 5.0}
SHARD_BYTES, RANGE_BYTES = 6 << 20, 5 << 20
#: The end of a text, and its start as a state; no word's hashes but by chance.
END, START = mix(np.array([2, 3], np.uint64) * SIZE_2)
BLOCKS = [("part", "int"), ("shard", "int"), ("size", "int"), ("grams", "binary"), ("n", "binary")]
#: totals of a block, each doubled, and one more if several shards have the n-gram; n_tokens, n_words: of the range, beside its first block of single tokens.
FOUND = [("part", "int"), ("shard", "int"), ("size", "int"), ("totals", "binary"), ("n_tokens", "long"), ("n_words", "long")]
SCORES = [("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def to_block(x: np.ndarray) -> bytes:
    """Numbers by byte planes, without those that are zero in all."""
    import zstandard

    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def from_block(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8")[:, 0].astype(np.uint64)


class Read:
    """Texts as tokens (A-Z lower-cased, as bytes do), and the n-grams that end at each."""

    def __init__(self, blobs):
        parts = [(words([t.lower() for t in texts]), len(texts), row) for row, texts in chunks(blobs)]
        n = np.concatenate([np.bincount(w[3], minlength=m) for w, m, _ in parts]) if parts else np.zeros(0, np.int64)
        self.size = n.astype(np.int64) + 1
        self.of = np.repeat(np.arange(len(n)), self.size)
        self.token = np.full(self.size.sum(), END, np.uint64)
        if parts:
            self.token[np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)] = np.concatenate([w[0] for w, _, _ in parts])
        self.first = np.zeros(len(self.token), bool)
        self.first[np.cumsum(self.size) - self.size] = True
        before = np.concatenate([self.token[:1], self.token[:-1]])
        before[self.first] = START
        self.pair = both(before, self.token)

    def grams(self, size: int) -> np.ndarray:
        """Of this size; a text's first token ends none of three."""
        if size < 3:
            return self.token if size == 1 else self.pair
        later = np.flatnonzero(~self.first)
        return both(self.pair[later - 1], self.token[later])


def range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def blocks_of(gram: np.ndarray, n: np.ndarray, shard: int, size: int, ranges: int) -> list[tuple]:
    if not len(gram):
        return []
    part = range_of(gram, ranges)
    at = run_starts(part)
    return [(part[a], shard, size, to_block(np.concatenate([gram[a : a + 1], np.diff(gram[a:b])])), to_block(n[a:b])) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(gram)], strict=True)]


def shard_blocks(docs: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """A shard's single tokens and pairs with their training counts; a count of 0 only asks for the total."""
    read, out = Read(docs.z), []
    train = ~docs.out.to_numpy(bool)[read.of]
    for size in (1, 2):
        gram, which = np.unique(read.grams(size), return_inverse=True)
        out += blocks_of(gram, np.bincount(which, train, len(gram)).astype(np.uint64), docs.shard.iloc[0], size, ranges)
    return pd.DataFrame(out, columns=[c for c, _ in BLOCKS])


def triples(read: Read, train: np.ndarray, in_others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(triples in order, their number for each token but a text's first, own counts, which ones other shards may have). in_others: of each pair"""
    gram, one, which = np.unique(read.grams(3), return_index=True, return_inverse=True)
    later = np.flatnonzero(~read.first)
    return gram, which, np.bincount(which, train[later], len(gram)).astype(np.uint64), (in_others[later] & in_others[later - 1])[one]


def returned(found: pd.DataFrame, size: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *map(from_block, found.totals[found["size"] == size])])


def pairs_in_others(read: Read, found: pd.DataFrame) -> np.ndarray:
    return (returned(found, 2) & np.uint64(1)).astype(bool)[np.unique(read.pair, return_inverse=True)[1]]


def triple_blocks(docs: pd.DataFrame, found: pd.DataFrame, ranges: int) -> pd.DataFrame:
    out = []
    if len(docs):
        read = Read(docs.z)
        gram, _, n, sent = triples(read, ~docs.out.to_numpy(bool)[read.of], pairs_in_others(read, found.sort_values(["size", "part"])))
        out = blocks_of(gram[sent], n[sent], docs.shard.iloc[0], 3, ranges)
    return pd.DataFrame(out, columns=[c for c, _ in BLOCKS])


def added_up(rows: list[tuple]) -> list[tuple]:
    """rows: the blocks (part, shard, size, grams, n) of one range and size."""
    grams, n = [np.cumsum(from_block(r[3]), dtype=np.uint64) for r in rows], np.concatenate([from_block(r[4]) for r in rows])
    ends, every = np.cumsum([len(g) for g in grams]), np.concatenate(grams)
    order = np.argsort(every)
    at = run_starts(every[order])
    sums = np.add.reduceat(n[order], at)
    totals, many = np.empty_like(n), np.diff(np.append(at, len(n)))
    totals[order] = np.repeat(sums * np.uint64(2) + (many > 1), many)
    counts = (int(sums.sum()), int((sums > 0).sum())) if rows[0][2] == 1 else (0, 0)
    return [(*r[:3], to_block(t), *(counts if i == 0 else (0, 0))) for i, (r, t) in enumerate(zip(rows, np.split(totals, ends[:-1]), strict=True))]


def range_totals(batches):
    """batches: blocks, sorted by range and size."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c, _ in BLOCKS), strict=True):
            if held and (held[0][0], held[0][2]) != (row[0], row[2]):
                yield record(FOUND, *map(list, zip(*added_up(held), strict=True)))
                held = []
            held.append(row)
    if held:
        yield record(FOUND, *map(list, zip(*added_up(held), strict=True)))


def probabilities(read: Read, count: dict[int, np.ndarray], n_tokens: int, n_words: int, n_starts: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each token at the root, and in its state). count: of the n-grams that end at each token"""
    root = (count[1] + 1) / (n_tokens + n_words + 1)
    of_state = np.concatenate([[0.0], count[1][:-1]])
    of_state[read.first] = n_starts
    p = (count[2] + PRIOR[2] * root) / (of_state + PRIOR[2])
    later = np.flatnonzero(~read.first)
    p[later] = (count[3] + PRIOR[3] * p[later]) / (count[2][later - 1] + PRIOR[3])
    return root, p


def score_shard(docs: pd.DataFrame, found: pd.DataFrame, n_tokens: int, n_words: int, n_starts: int) -> pd.DataFrame:
    if not len(docs):
        return pd.DataFrame({n: [] for n, _ in SCORES})
    read = Read(docs.z)
    found = found.sort_values(["size", "part"])
    count = {size: (returned(found, size) >> np.uint64(1))[np.unique(read.grams(size), return_inverse=True)[1]].astype(np.float64) for size in (1, 2)}
    _, which, n, sent = triples(read, ~docs.out.to_numpy(bool)[read.of], pairs_in_others(read, found))
    n[sent] = returned(found, 3) >> np.uint64(1)
    root, p = probabilities(read, count | {3: n[which].astype(np.float64)}, n_tokens, n_words, n_starts)
    add = lambda x: np.bincount(read.of, x, len(docs))
    made = pd.DataFrame({"doc_id": docs.doc_id.to_numpy(), "held_out": docs.out.to_numpy(bool), "n_tokens": read.size, "n_known": add(count[1] > 0).astype(np.int64), "base_score": add(np.log10(root)), "score": add(np.log10(p))})
    return made.assign(doc_id=made.doc_id.astype("Int64").mask(made.doc_id == NO_ID))


def scored(docs: DataFrame, size: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). size: of a shard; range_bytes: text for a range of hashes"""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("out", held_out())
    n_bytes = text_bytes(d)
    ranges = min(1 << 30, 1 + n_bytes // range_bytes)
    s = sharded(d, ("out",), size, n_bytes)
    added = lambda blocks: keep(blocks.repartition("part").sortWithinPartitions("part", "size").mapInArrow(range_totals, ddl(FOUND)))
    found = added(s.groupBy("shard").applyInPandas(lambda rows: shard_blocks(rows, ranges), ddl(BLOCKS)))
    n_tokens, n_words = found.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_starts = d.filter(~F.col("out")).count()
    totals = found.select("shard", "part", "size", "totals")
    more = added(s.groupBy("shard").cogroup(totals.filter("size = 2").groupBy("shard")).applyInPandas(lambda a, b: triple_blocks(a, b, ranges), ddl(BLOCKS)))
    totals = totals.unionByName(more.select("shard", "part", "size", "totals"))
    out = s.groupBy("shard").cogroup(totals.groupBy("shard")).applyInPandas(lambda a, b: score_shard(a, b, n_tokens, n_words, n_starts), ddl(SCORES))
    return out.withColumn("train_tokens", F.lit(n_tokens).cast("long"))


def op9_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir, "documents"))
