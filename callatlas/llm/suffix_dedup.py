"""Dedup of repeated byte strings with longest-previous-factor arrays.

Windows of `window` bytes are dealt by the anchor they choose (see grams). Segments of an
anchor are gathered, each text once for an anchor and shard, and twice in the array if it
occurs more than once; over a batch of them a suffix array is sorted, and previous and next
smaller positions in suffix order give the longest earlier match of every window start. The
same with positions reversed gives the longest later match, as here every copy goes, the
first included. A window goes where one of the two is `window` bytes or more.

Two kinds of anchors need no array. One that has one and the same segment everywhere, in
several shards, is compared by a digest of its bytes. One with more than HOT different
segments isn't brought together: its windows are counted one by one, by a digest of their
bytes, so that no task gathers an unbounded group.

Defined results: a null text is empty. Rows with equal or null doc_ids are separate
documents. Very long texts are read whole, in the shard they fall into. An empty table gives
no rows. Columns not named in `carry` are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, by_run, chunks, ddl, load, record, run_starts, sharded
from .grams import Segments, Spans, byte_values, digests, mix
from .substring_dedup import edge_keys, member

PATHS = [("h", "long"), ("sh", "long"), ("shard", "int"), ("texts", "long")]
#: n: window starts of the segment `body`; 0 for a single window, which (k, w) then names.
BODIES = [("k", "long"), ("w", "long"), ("shard", "int"), ("times", "long"), ("n", "int"), ("body", "binary")]
#: kind 0: the segment of anchor k is the same in several shards; 1: anchor k has unequal segments; 2: so many that windows
#: are counted; 3: `bits` tells which windows of segment (k, w) repeat; 4: the window (k, w) repeats.
FOUND = [("shard", "int"), ("kind", "int"), ("k", "long"), ("w", "long"), ("bits", "binary")]
HOT = 4096
BATCH = 1 << 20


def segments_of(blobs, window: int, gram: int):
    for row, texts in chunks(blobs):
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        buf = b"".join(texts)
        grams = mix(Spans(byte_values()[np.frombuffer(buf, np.uint8)]).all(gram))
        yield row, texts, buf, text, Segments(grams, text, window, gram)


# --- suffix arrays -----------------------------------------------------------------------------


def ranks(buf: np.ndarray, window: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For sizes 8, 16, 32, ... the rank of the string of that size at each position, by doubling; and the eight bytes themselves."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    eight, out, size = key, {}, 8
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0)]))
        out[size] = rank
        if size * 2 > window:
            return out, eight
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        key = (rank * (n + 2) + after).astype(np.uint64)
        size *= 2


def suffix_order(start: np.ndarray, ranked: tuple[dict[int, np.ndarray], np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window starts in the order of their suffixes, and the common prefix with the one before, both up to `window`."""
    level, eight = ranked
    parts, at = [], 0
    for size in sorted(level, reverse=True):
        while at + size <= window:
            parts.append((at, size))
            at += size
    if at < window:  # a last part that overlaps
        parts.append((window - 8, 8))
    sa = start[np.lexsort([level[size][start + at] for at, size in reversed(parts)])]
    common, a, b = np.zeros(len(sa), np.int64), sa[1:], sa[:-1]
    length = common[1:]
    for size in sorted(level, reverse=True):
        for _ in range(2 if size == max(level) else 1):
            more = np.flatnonzero(length < window)
            x, y = a[more] + length[more], b[more] + length[more]
            length[more[level[size][x] == level[size][y]]] += size
    more = np.flatnonzero(length < window)
    apart = eight[a[more] + length[more]] ^ eight[b[more] + length[more]]
    length[more] += sum((apart >> np.uint64(64 - 8 * j) == 0).astype(np.int64) for j in range(1, 8))
    return sa, np.minimum(common, window)


def previous_factor(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order: the longest match that starts at a smaller position.

    It is the longer of the matches with the previous and the next suffix of smaller
    position. All suffixes look for these at once: one whose candidate has a larger position
    goes on to that one's own candidate, as everything in between is larger still.
    """
    return np.maximum(_smaller_before(position, common), _smaller_before(position[::-1], np.append(common[1:], 0)[::-1])[::-1])


def _smaller_before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The match with the last suffix before of smaller position. common: each one's match with the one before it."""
    place = np.concatenate([[np.iinfo(np.int64).min], position])
    candidate = np.arange(-1, len(position))
    candidate[0] = 0
    length = np.concatenate([[0], common])
    length[1:2] = 0
    open_ = np.arange(1, len(place))
    while len(open_):
        open_ = open_[(place[candidate[open_]] > place[open_]) & (length[open_] > 0)]
        over = candidate[open_]
        length[open_], candidate[open_] = np.minimum(length[open_], length[over]), candidate[over]
    return length[1:]


def repeated_windows(bodies: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """For the window starts of all bodies, one after the other: does the window occur elsewhere in them?"""
    counts = np.asarray(counts, np.int64)
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]]).astype(np.int64)
    start = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    position, common = suffix_order(start, ranks(buf, window), window)
    longest = np.zeros(len(buf), np.int64)
    longest[position] = np.maximum(previous_factor(position, common), previous_factor(-position, common))
    return longest[start] >= window


def in_batches(keys: np.ndarray, sizes: np.ndarray):
    """Ranges of rows of about BATCH bytes that don't divide a run of equal keys."""
    at = run_starts(keys)
    ends = np.append(at[1:], len(keys))
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(keys):
        base = total[lo - 1] if lo else 0
        e = ends[np.searchsorted(ends, max(np.searchsorted(total, base + BATCH), lo) + 1)] if total[-1] - base > BATCH else len(keys)
        yield lo, int(e)
        lo = int(e)


# --- the passes over shards -----------------------------------------------------------------------


def shard_paths(batches, window: int, gram: int):
    """For each anchor and shard: its segment (0 if there are several) and how many."""
    found: dict[str, list] = {"shard": [], "h": [], "sh": []}
    for b in batches:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        for row, _, buf, _, s in segments_of(b.column("z").to_pylist(), window, gram):
            found["shard"].append(shard[row + s.text])
            found["h"].append(s.h)
            found["sh"].append(digests(buf, s.first, s.end))
    if found["h"]:
        shard, h, sh = (np.concatenate(v) for v in found.values())
        order = np.lexsort((sh, h, shard))
        shard, h, sh = shard[order], h[order], sh[order]
        at = run_starts(shard, h, sh)
        shard, h, sh = shard[at], h[at], sh[at]
        at = run_starts(shard, h)
        texts = np.diff(np.append(at, len(h)))
        yield record(PATHS, h[at], np.where(texts == 1, sh[at], np.uint64(0)), shard[at], texts)


def joined_paths(batches):
    for v in by_run(batches, "h", ["h", "sh", "shard", "texts"]):
        at = run_starts(v["h"])
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(v["h"]))))
        lo, hi = np.minimum.reduceat(v["shard"], at), np.maximum.reduceat(v["shard"], at)
        p0, p1 = np.minimum.reduceat(v["sh"], at), np.maximum.reduceat(v["sh"], at)
        kind = np.where((p0 == p1) & (p0 != 0), 0, np.where(np.add.reduceat(v["texts"], at) > HOT, 2, 1))[run]
        keep = (lo != hi)[run]
        n = keep.sum()
        yield record(FOUND, v["shard"][keep], kind[keep].astype(np.int32), v["h"][keep], np.zeros(n, np.int64), [None] * n)


def columns_of(found: pd.DataFrame):
    return found.kind.to_numpy(), found.k.to_numpy(np.int64).view(np.uint64), found.w.to_numpy(np.int64).view(np.uint64), found.bits.to_numpy()


def shard_bodies(docs: pd.DataFrame, found: pd.DataFrame, window: int, gram: int) -> pd.DataFrame:
    kind, fk, _, _ = columns_of(found)
    mixed, hot = np.sort(fk[kind == 1]), np.sort(fk[kind == 2])
    h, sh, n, times, bodies, k, w = [], [], [], [], [], [], []
    if len(docs) and len(mixed) + len(hot):
        for _, _, buf, _, s in segments_of(docs.z, window, gram):
            which = np.flatnonzero(member(s.h, mixed))
            mine, one, many = np.unique(digests(buf, s.first[which], s.end[which]), return_index=True, return_counts=True)
            which = which[one]
            h.append(s.h[which])
            sh.append(mine)
            n.append(s.count[which])
            times.append(many)
            bodies += [buf[a:b] for a, b in zip(s.first[which].tolist(), s.end[which].tolist(), strict=True)]
            which = np.flatnonzero(member(s.h, hot))
            at, start = s.windows(which)
            x = digests(buf, start, start + window)
            k.append(edge_keys(s.h[which][at], x))
            w.append(x)
    if not h:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c, _ in BODIES[:-1]} | {"body": []})
    shard = docs.shard.iloc[0]
    out = pd.DataFrame({"k": np.concatenate(h).view(np.int64), "w": np.concatenate(sh).view(np.int64), "shard": shard, "times": np.concatenate(times), "n": np.concatenate(n), "body": bodies})
    out["times"] = out.groupby(["k", "w"])["times"].transform("sum")
    out = out.drop_duplicates(["k", "w"])
    single = pd.DataFrame({"k": np.concatenate(k).view(np.int64), "w": np.concatenate(w).view(np.int64)})
    if len(single):
        single = single.groupby(["k", "w"], as_index=False).size().rename(columns={"size": "times"}).assign(shard=shard, n=0, body=None)
        out = pd.concat([out, single[out.columns]]) if len(out) else single[out.columns]
    return out


def bits_of(windows: np.ndarray, counts: np.ndarray) -> list[bytes]:
    at = np.concatenate([[0], np.cumsum(counts)])
    return [np.packbits(windows[at[i] : at[i + 1]]).tobytes() for i in range(len(counts))]


def joined_bodies(batches, window: int):
    for v in by_run(batches, "k", [c for c, _ in BODIES]):
        single = v["n"] == 0
        k, w, shard, times = (v[c][single] for c in ("k", "w", "shard", "times"))
        if len(k):
            at = run_starts(k, w)
            keep = np.repeat(np.add.reduceat(times, at), np.diff(np.append(at, len(k)))) > 1
            n = keep.sum()
            yield record(FOUND, shard[keep], np.full(n, 4, np.int32), k[keep], w[keep], [None] * n)
        k, w, shard, times, n, body = (v[c][~single] for c in ("k", "w", "shard", "times", "n", "body"))
        if not len(k):
            continue
        at = run_starts(k, w)
        size = np.array([len(x) for x in body[at]], np.int64)
        for lo, hi in in_batches(k[at], size):
            rows = at[lo:hi]
            n_of = n[rows].astype(np.int64)
            end = np.append(at, len(k))[lo + 1 : hi + 1]
            many = end - rows
            again = np.flatnonzero(np.add.reduceat(times, at)[lo:hi] > 1)  # these are in the array twice
            got = repeated_windows([*body[rows], *body[rows[again]]], np.concatenate([n_of, n_of[again]]), window)
            bits = bits_of(got, n_of)
            pick = np.repeat(np.arange(len(rows)), many)
            yield record(FOUND, shard[rows[0] : end[-1]], np.full(len(pick), 3, np.int32), k[rows[0] : end[-1]], w[rows[0] : end[-1]], [bits[i] for i in pick.tolist()])


def local_windows(h: np.ndarray, sh: np.ndarray, count: np.ndarray, body, window: int) -> np.ndarray:
    """Which windows of these segments of one shard repeat among them; body(i): the i-th segment's bytes."""
    order = np.lexsort((sh, h))
    at = run_starts(h[order], sh[order])
    one, times = order[at], np.diff(np.append(at, len(order)))
    where = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    out = np.zeros(where[-1], bool)
    bucket = run_starts(h[one])
    alone = np.repeat(np.diff(np.append(bucket, len(one))) == 1, np.diff(np.append(bucket, len(one))))
    part: dict[int, np.ndarray] = {}
    todo = one[~alone | (times > 1)]
    again = dict(zip(one.tolist(), (times > 1).tolist(), strict=True))
    for lo, hi in in_batches(h[todo], count[todo] + window - 1) if len(todo) else ():
        rows = todo[lo:hi]
        twice = np.array([i for i in rows.tolist() if again[i]], np.int64)
        got = repeated_windows([body(int(i)) for i in [*rows, *twice]], np.concatenate([count[rows], count[twice]]), window)
        cut = np.concatenate([[0], np.cumsum(count[rows])])
        part |= {i: got[cut[j] : cut[j + 1]] for j, i in enumerate(rows.tolist())}
    for j in range(len(at)):
        if (p := part.get(int(one[j]))) is not None:
            for i in order[at[j] : at[j] + times[j]].tolist():
                out[where[i] : where[i + 1]] = p
    return out


def cut_bytes(docs: pd.DataFrame, found: pd.DataFrame, window: int, gram: int, carry: tuple[str, ...]) -> pd.DataFrame:
    total = len(docs)
    ids = docs.doc_id.to_numpy(np.int64)
    kind, fk, fw, fbits = columns_of(found)
    paths = np.sort(fk[kind == 0])
    elsewhere = np.sort(fk[kind < 3])
    bits = {(k, w): b for k, w, b in zip(fk[kind == 3].tolist(), fw[kind == 3].tolist(), fbits[kind == 3], strict=True)}
    single, hot = np.sort(fk[kind == 4] ^ fw[kind == 4]), np.sort(fk[kind == 2])
    per, local = [], []
    for row, texts, buf, text, s in segments_of(docs.z, window, gram):
        starts = [s.windows(np.flatnonzero(member(s.h, paths)))[1]]
        which = np.flatnonzero(member(s.h, hot))
        at, start = s.windows(which)
        w = digests(buf, start, start + window)
        starts.append(start[member(edge_keys(s.h[which][at], w) ^ w, single)])
        if bits:
            mixed = np.flatnonzero(member(s.h, np.sort(fk[kind == 1])))
            for i, k, w1 in zip(mixed.tolist(), s.h[mixed].tolist(), digests(buf, s.first[mixed], s.end[mixed]).tolist(), strict=True):
                if (b := bits.get((k, w1))) is not None:
                    starts.append(s.first[i] + np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))))
        rest = np.flatnonzero(~member(s.h, elsewhere))
        local.append((s.h[rest], s.count[rest], s.first[rest]))
        per.append((row, texts, buf, text, starts))
    if per:
        h, count, first = (np.concatenate(x) for x in zip(*local, strict=True))
        chunk = np.repeat(np.arange(len(local)), [len(x[0]) for x in local])
        known, times = np.unique(h, return_counts=True)
        pick = np.flatnonzero(member(h, known[times > 1]))
        h, count, first, chunk = (a[pick] for a in (h, count, first, chunk))
        sh = np.zeros(len(h), np.uint64)
        for c in np.unique(chunk).tolist():
            sh[chunk == c] = digests(per[c][2], first[chunk == c], (first + count + window - 1)[chunk == c])
        got = local_windows(h, sh, count, lambda i: per[chunk[i]][2][first[i] : first[i] + count[i] + window - 1], window)
        at = np.repeat(np.arange(len(h)), count)
        start = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        for c in range(len(per)):
            per[c][4].append(start[got & (chunk[at] == c)])
    n_bytes, n_removed, n_spans, kept = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64), []
    for row, texts, _, text, starts in per:
        change = np.zeros(len(text) + 1, np.int64)
        for x in starts:
            np.add.at(change, x, 1)
            np.add.at(change, x + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        m = len(texts)
        opens = gone.copy()
        opens[1:] &= ~(gone[:-1] & (text[1:] == text[:-1]))
        n_bytes[row : row + m] = [len(t) for t in texts]
        n_removed[row : row + m] = np.bincount(text[gone], minlength=m)
        n_spans[row : row + m] = np.bincount(text[opens], minlength=m)
        end = np.cumsum(n_bytes[row : row + m])
        for i, t in enumerate(texts):
            kept.append(t if not n_removed[row + i] else np.frombuffer(t, np.uint8)[~gone[end[i] - len(t) : end[i]]].tobytes())
    out = {"doc_id": pd.Series(ids).astype("Int64").mask(ids == NO_ID), **{c: docs[c] for c in carry}, "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept": kept}
    return pd.DataFrame(out)


def remove_repeated_bytes(docs: DataFrame, window: int = 200, gram: int = 48, carry: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """(doc_id, carried columns, n_bytes, n_removed, n_spans, kept binary). size: of a shard"""
    d = sharded(docs, carry, size)
    paths = d.mapInArrow(lambda b: shard_paths(b, window, gram), ddl(PATHS))
    found = paths.repartition("h").sortWithinPartitions("h").mapInArrow(joined_paths, ddl(FOUND))
    bodies = d.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(lambda a, b: shard_bodies(a, b, window, gram), ddl(BODIES))
    more = bodies.repartition("k").sortWithinPartitions("k", "w").mapInArrow(lambda b: joined_bodies(b, window), ddl(FOUND))
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return (
        d.groupBy("shard")
        .cogroup(found.unionByName(more).groupBy("shard"))
        .applyInPandas(lambda a, b: cut_bytes(a, b, window, gram, carry), f"doc_id long{carried}, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
