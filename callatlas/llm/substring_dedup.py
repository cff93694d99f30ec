"""Substring dedup by compaction of the de Bruijn graph of words.

Nodes of the graph are runs of `window` - 1 words, and every window of `window` words is an
edge. Edges are dealt by the anchor they choose (see grams), which both ends of the dealing
compute alike, so a segment of windows with one anchor is a path of the graph.

1. A bucket whose segments are all equal is a nonbranching path, compacted to one row. In
   others the graph branches: their edges stay apart, one row for each edge and shard.
2. Paths are compacted further by Spark joins. A path's next and previous path in the texts
   give the out- and in-degree of the node between them; where both are one, in all their
   occurrences, the two are joined, and heads of longer paths are found by joins that double
   the distance they look back. Every COMPACTED-th path begins anew, so a few joins do; paths
   that are left over stay by themselves.
3. A head comes back to each shard that has it, with how many paths follow, the smallest
   document they occur in, and a digest of their source words. The shard has the path's
   source coordinates; it verifies that its own words there give the same digest, and takes
   all words of the path in one span.

Digests are of the words' bytes themselves, joined by one space: equal hashes of words or
windows decide nothing alone.

Defined results: a null text has no words. A null doc_id sorts after every other. Rows
with equal doc_ids are separate documents that remove nothing from each other; of equal
windows in several documents, those of the smallest doc_id stay. Very long texts are read
whole, in the shard they fall into. An empty table gives no rows. Columns not named in
`carry` are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, by_run, chunks, ddl, discard, keep, load, record, run_starts, sharded, trim
from .grams import BLANK, SIZE_1, Segments, Windows, digests, mix, words

PATHS = [("h", "long"), ("sh", "long"), ("shard", "int")]
#: kind 0: a path k with digest w, between the paths `before` and `after` (0: none, or not the same everywhere); 2: the edge (k, w).
EDGES = [("kind", "int"), ("k", "long"), ("w", "long"), ("shard", "int"), ("lo", "long"), ("before", "long"), ("after", "long")]
#: kind 0: anchor k is a path; 1: it branches; 2: the edge (k, w) is in documents from `lo` on; 3: so are the n paths from k on, with digest w.
FOUND = [("shard", "int"), ("kind", "int"), ("k", "long"), ("w", "long"), ("lo", "long"), ("n", "long")]
COMPACTED, ROUNDS = 4, 3


def first_of_each(*keys_and_lo: np.ndarray) -> list[np.ndarray]:
    """The smallest last array for each combination of the others, sorted."""
    order = np.lexsort(keys_and_lo[::-1])
    out = [a[order] for a in keys_and_lo]
    return [a[run_starts(*out[:-1])] for a in out] if len(order) else out


class Read:
    """Texts with their segments, and the bytes of words joined by one space."""

    def __init__(self, row: int, texts: list[bytes], window: int, gram: int):
        self.row, self.texts, self.window = row, texts, window
        h, first, end, self.text, buf = words(texts)
        self.s = Segments(Windows(h).all(gram), self.text, window, gram)
        # every word is followed by white space, of which the first byte stays, as a space
        blank = BLANK[buf]
        stay = ~blank
        stay[1:] |= ~blank[:-1]
        self.plain = np.where(blank, np.uint8(0x20), buf)[stay]
        size = end - first
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size

    def digests(self, which) -> np.ndarray:
        """Of segments."""
        first, end = self.s.first[which], self.s.end[which]
        return digests(self.plain, self.start[first], self.end[end - 1])

    def window_digests(self, start: np.ndarray) -> np.ndarray:
        return digests(self.plain, self.start[start], self.end[start + self.window - 1])


def reads(blobs, window: int, gram: int):
    for row, texts in chunks(blobs):
        yield Read(row, texts, window, gram)


def edge_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h + w * SIZE_1)


def member(values: np.ndarray, of_sorted: np.ndarray) -> np.ndarray:
    if not len(of_sorted):
        return np.zeros(len(values), bool)
    return of_sorted[np.minimum(np.searchsorted(of_sorted, values), len(of_sorted) - 1)] == values


def shard_paths(batches, window: int, gram: int):
    """For each anchor and shard: its segment's digest, 0 if there are several."""
    held, total = [], 0

    def flush():
        shard, h, sh = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((sh, h, shard))
        shard, h, sh = shard[order], h[order], sh[order]
        at = run_starts(shard, h, sh)
        shard, h, sh = shard[at], h[at], sh[at]
        at = run_starts(shard, h)
        one = np.diff(np.append(at, len(h))) == 1
        return record(PATHS, h[at], np.where(one, sh[at], np.uint64(0)), shard[at])

    for b in batches:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        for r in reads(b.column("z").to_pylist(), window, gram):
            if len(r.s.h):
                held.append((shard[r.row + r.s.text], r.s.h, r.digests(slice(None))))
                total += len(r.s.h)
        if total > 1_500_000:
            yield flush()
            held, total = [], 0
    if held:
        yield flush()


def joined_paths(batches):
    """Anchors in several shards: one path, or a bucket that branches."""
    for v in by_run(batches, "h", ["h", "sh", "shard"]):
        at = run_starts(v["h"])
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(v["h"]))))
        both = lambda c: (np.minimum.reduceat(v[c], at), np.maximum.reduceat(v[c], at))  # noqa: B023, E731
        (s0, s1), (p0, p1) = both("shard"), both("sh")
        some = (s0 != s1)[run]
        none = np.zeros(some.sum(), np.int64)
        yield record(FOUND, v["shard"][some], ((p0 != p1) | (p0 == 0))[run][some].astype(np.int32), v["h"][some], none, none, none)


def neighbours(r: Read, on_path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the path before and after it, 0 where there is none."""
    s, before, after = r.s, np.zeros(len(r.s.h), np.uint64), np.zeros(len(r.s.h), np.uint64)
    meet = on_path[:-1] & on_path[1:] & (s.text[:-1] == s.text[1:]) & (s.first[1:] == s.first[:-1] + s.count[:-1])
    at = np.flatnonzero(meet)
    after[at], before[at + 1] = s.h[at + 1], s.h[at]
    return before, after


def shard_edges(docs: pd.DataFrame, found: pd.DataFrame, window: int, gram: int) -> pd.DataFrame:
    """The edges of branching buckets, and paths with their neighbours, with the shard's smallest document for each."""
    kind, fk = found.kind.to_numpy(), found.k.to_numpy(np.int64).view(np.uint64)
    paths, branching = np.sort(fk[kind == 0]), np.sort(fk[kind == 1])
    edges, nodes = [], []
    ids = docs.doc_id.to_numpy(np.int64)
    if len(fk) and len(docs):
        for r in reads(docs.z, window, gram):
            which = np.flatnonzero(member(r.s.h, branching))
            at, start = r.s.windows(which)
            w = r.window_digests(start)
            edges.append(first_of_each(edge_keys(r.s.h[which][at], w), w, ids[r.row + r.s.text[which][at]]))
            on_path = member(r.s.h, paths)
            before, after = neighbours(r, on_path)
            which = np.flatnonzero(on_path)
            h, one, times = np.unique(r.s.h[which], return_inverse=True, return_counts=True)
            order = np.argsort(one, kind="stable")
            at = np.cumsum(times) - times
            if len(h):
                same = lambda x: np.where(np.minimum.reduceat(x, at) == np.maximum.reduceat(x, at), x[at], np.uint64(0))  # noqa: B023, E731
                doc = ids[r.row + r.s.text[which]][order]
                nodes.append((h, r.digests(which[order[at]]), np.minimum.reduceat(doc, at), same(before[which][order]), same(after[which][order])))
    shard = docs.shard.iloc[0] if len(docs) else 0
    out = []
    if edges:
        k, w, lo = first_of_each(*(np.concatenate(x) for x in zip(*edges, strict=True)))
        out.append(pd.DataFrame({"kind": 2, "k": k.view(np.int64), "w": w.view(np.int64), "shard": shard, "lo": lo, "before": 0, "after": 0}))
    if nodes:
        k, w, lo, before, after = (np.concatenate(x) for x in zip(*nodes, strict=True))
        out.append(pd.DataFrame({"kind": 0, "k": k.view(np.int64), "w": w.view(np.int64), "shard": shard, "lo": lo, "before": before.view(np.int64), "after": after.view(np.int64)}))
    trim()
    return pd.concat(out) if out else pd.DataFrame({n: np.zeros(0, np.int64) for n, _ in EDGES})


def joined_edges(batches):
    """Of edges in several shards: the smallest document, for shards that have it only later."""
    for v in by_run(batches, "k", ["k", "w", "shard", "lo"]):
        at = run_starts(v["k"], v["w"])
        lo = np.repeat(np.minimum.reduceat(v["lo"], at), np.diff(np.append(at, len(v["k"]))))
        some = v["lo"] > lo
        n = some.sum()
        yield record(FOUND, v["shard"][some], np.full(n, 2, np.int32), v["k"][some], v["w"][some], lo[some], np.zeros(n, np.int64))


def compacted(paths: DataFrame) -> DataFrame:
    """(head, w, lo, n): n paths from `head` on that always stand together, joined where the node between two has degree one on both sides."""
    ends = [f(c).alias(f"{c}_{name}") for c in ("before", "after") for name, f in (("lo", F.min), ("hi", F.max))]
    nodes = paths.groupBy("k").agg(F.min("lo").alias("lo"), F.min("w").alias("w"), *ends)
    only = lambda c: F.when((F.col(f"{c}_lo") == F.col(f"{c}_hi")) & (F.col(f"{c}_lo") != 0), F.col(f"{c}_lo")).alias(c)
    nodes = keep(nodes.select("k", "lo", "w", only("before"), only("after")))
    follows = nodes.filter("after IS NOT NULL").select(F.col("k").alias("a"), F.col("after").alias("b"))
    begins = F.pmod(F.xxhash64("k"), F.lit(COMPACTED)) == 0
    back = nodes.filter("before IS NOT NULL").filter(~begins).join(follows, (F.col("k") == F.col("b")) & (F.col("before") == F.col("a")) & (F.col("a") != F.col("b"))).select(F.col("b").alias("k"), F.col("a").alias("up"))
    up = keep(nodes.select("k").join(back, "k", "left").select("k", F.coalesce("up", "k").alias("up")))
    for _ in range(ROUNDS):
        last, next_ = up, up.select(F.col("k").alias("up"), F.col("up").alias("further"))
        up = keep(up.join(next_, "up").select("k", F.col("further").alias("up")))
        discard(last)
    heads = up.filter("k = up").select(F.col("k").alias("head"))
    of = up.join(heads, F.col("up") == F.col("head"), "left").select("k", F.coalesce("head", "k").alias("head"))
    return nodes.join(of, "k").groupBy("head").agg(F.bit_xor("w").alias("w"), F.min("lo").alias("lo"), F.count("*").alias("n"))




def covered(r: Read, head: np.ndarray, digest: np.ndarray, lo: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words of the paths in r that earlier documents have; each is verified by the digest of its own words. head: sorted"""
    s = r.s
    which = np.flatnonzero(member(s.h, head))
    place = np.searchsorted(head, s.h[which])
    last = which + n[place] - 1
    fits = last < len(s.h)
    fits[fits] &= s.text[last[fits]] == s.text[which[fits]]
    which, place, last = which[fits], place[fits], last[fits]
    own = np.zeros(len(which), np.uint64)
    if len(which):
        size = last - which + 1
        every = np.repeat(which, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.bitwise_xor.reduceat(r.digests(every), np.cumsum(size) - size)
    gone = (own == digest[place]) & (doc[which] > lo[place])
    return s.first[which[gone]], s.end[last[gone]]


def cut_words(docs: pd.DataFrame, found: pd.DataFrame, window: int, gram: int, carry: tuple[str, ...], whole: bool) -> pd.DataFrame:
    n = len(docs)
    ids = docs.doc_id.to_numpy(np.int64)
    kind, fk = found.kind.to_numpy(), found.k.to_numpy(np.int64).view(np.uint64)
    flo, fw, fn = found.lo.to_numpy(np.int64), found.w.to_numpy(np.int64).view(np.uint64), found.n.to_numpy(np.int64)
    heads = np.flatnonzero(kind == 3)
    heads = heads[np.argsort(fk[heads])]
    paths, branching = np.sort(fk[kind == 0]), np.sort(fk[kind == 1])
    every = list(reads(docs.z, window, gram))
    known, times = np.unique(np.concatenate([r.s.h for r in every]) if every else np.zeros(0, np.uint64), return_counts=True)
    here = known[times > 1]
    edges, parts, spans = [(fk[kind == 2], fw[kind == 2], flo[kind == 2])], [], []
    for r in every:
        s, doc = r.s, ids[r.row + r.s.text]
        spans.append([covered(r, fk[heads], fw[heads], flo[heads], fn[heads], doc)])
        which = np.flatnonzero(~member(s.h, paths) & (member(s.h, branching) | member(s.h, here)))
        at, start = s.windows(which)
        w = r.window_digests(start)
        k, d = edge_keys(s.h[which][at], w), doc[which][at]
        edges.append((k, w, d))
        parts.append((k, w, d, start))
    k, w, lo = first_of_each(*(np.concatenate(x) for x in zip(*edges, strict=True)))
    if len(k):
        # k is a hash of w and h, so k alone finds the edge but for a collision, which w then shows
        one = run_starts(k)
        for i, (pk, pw, d, start) in enumerate(parts):
            at = one[np.minimum(np.searchsorted(k[one], pk), len(one) - 1)]
            while len(bad := np.flatnonzero((w[at] != pw) & (at + 1 < len(k)) & (k[np.minimum(at + 1, len(k) - 1)] == pk))):
                at[bad] += 1
            start = start[(d > lo[at]) & (w[at] == pw) & (k[at] == pk)]
            spans[i].append((start, start + window))
    kept, n_words, n_removed = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r, some in zip(every, spans, strict=True):
        change = np.zeros(len(r.text) + 1, np.int32)
        for first, end in some:
            np.add.at(change, first, 1)
            np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1]) > 0
        m = len(r.texts)
        rows = slice(r.row, r.row + m)
        n_words[rows] = np.bincount(r.text, minlength=m)
        n_removed[rows] = np.bincount(r.text[gone], minlength=m)
        end = np.cumsum(n_words[rows])
        for i, t in enumerate(r.texts):
            if not n_removed[r.row + i]:
                kept.append(t if whole else b" ".join(t.split()))
            else:
                stay = ~gone[end[i] - n_words[r.row + i] : end[i]]
                kept.append(b" ".join(compress(t.split(), stay.tolist())))
    out = {"doc_id": pd.Series(ids).astype("Int64").mask(ids == NO_ID), **{c: docs[c] for c in carry}, "n_words": n_words, "n_removed": n_removed, "kept": kept}
    del every, spans, parts, edges
    trim()
    return pd.DataFrame(out)


def remove_repeated_words(docs: DataFrame, window: int = 13, gram: int = 5, carry: tuple[str, ...] = (), whole: bool = False, size: int | None = None) -> DataFrame:
    """(doc_id, carried columns, n_words, n_removed, kept binary). size: of a shard

    kept: the words that stay, joined by one space; with `whole`, a text that loses nothing stays as it is.
    """
    d = sharded(docs, carry, size)
    paths = d.mapInArrow(lambda b: shard_paths(b, window, gram), ddl(PATHS))
    found = keep(paths.repartition("h").sortWithinPartitions("h").mapInArrow(joined_paths, ddl(FOUND)))
    edges = keep(d.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(lambda a, b: shard_edges(a, b, window, gram), ddl(EDGES)))
    later = edges.filter("kind = 2").select("k", "w", "shard", "lo").repartition("k").sortWithinPartitions("k", "w").mapInArrow(joined_edges, ddl(FOUND))
    nodes = edges.filter("kind = 0")
    glued = nodes.select("k", "shard").join(compacted(nodes), F.col("k") == F.col("head"))
    glued = glued.select("shard", F.lit(3).alias("kind"), "k", "w", "lo", "n")
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return (
        d.groupBy("shard")
        .cogroup(found.unionByName(later).unionByName(glued).groupBy("shard"))
        .applyInPandas(lambda a, b: cut_words(a, b, window, gram, carry, whole), f"doc_id long{carried}, n_words long, n_removed long, kept binary")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_words(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
