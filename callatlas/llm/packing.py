"""Sum-of-squares packing of tokenized documents into sequences.

Documents are tokenized without a shuffle; longer ones than a sequence are cut. Pieces are
dealt at random to groups of about GROUP, and each group is packed by itself: a piece goes
where the sum, over the gaps that open sequences have left, of the squared number of
sequences with that gap becomes smallest. Sequences that a group leaves open go on: their
pieces are dealt to fewer groups and packed again, until one group is left or a turn fills
less than a tenth. No task's work grows with the input, and the last groups alone leave gaps.

Defined results: a null text is empty and so is one id 0. Rows with equal or null doc_ids
are packed each for itself. Very long texts are tokenized whole; pieces of equal length are
placed in the order of a hash of their ids. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, keep, load, record, trim
from .grams import BLANK, joined, span_hashes

LENGTH = 2048
GROUP, TURNS = 8192, 40
PIECES = [("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
#: A worker forgets what it has learned once it knows so many different units.
CACHE = 800_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def worker_state() -> types.ModuleType:
    """What a Python worker keeps from one task to the next."""
    return sys.modules.setdefault("_callatlas_worker", types.ModuleType("_callatlas_worker"))


#: Byte classes for cuts: 1 letters, 2 digits, 3 ASCII punctuation but the apostrophe, which may begin an ending such as 's.
KIND = np.zeros(256, np.int8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[0x30:0x3A] = 2
KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 3


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, text number) of each unit, and the bytes.

    This vocabulary drops white space and never joins letters with digits, digits with each
    other, or either with punctuation; cuts there and at ASCII white space leave the ids as
    they are. It lower-cases, so ASCII units count as lower case; other units stay, since
    composing accents comes before lower-casing.
    """
    buf, at = joined(texts)
    kind, blank = KIND[buf], BLANK[buf]
    cut = np.ones(len(buf) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (blank[1:] != blank[:-1]) | ((a > 0) & (b > 0) & ((a != b) | (a == 2)))
    edge = np.flatnonzero(cut)
    some = ~blank[edge[:-1]]
    first, end = edge[:-1][some], edge[1:][some]
    foreign = np.concatenate([[0], np.cumsum(buf >= 0x80)])
    plain = foreign[first] == foreign[end]
    lower = np.frombuffer(buf.tobytes().lower(), np.uint8)
    h = np.empty(len(first), np.uint64)
    h[plain] = span_hashes(lower, first[plain], end[plain])
    h[~plain] = span_hashes(buf, first[~plain], end[~plain])
    return h, first, end, np.searchsorted(at, first, "right") - 1, buf


class Tokens:
    """Ids of texts. What different units give is learned once, in arrays sorted by their hashes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = self.whole(" \x01 ")
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learned(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each unit. Many go in one call, with a character between them that has one id of its own."""
        out: list[np.ndarray] = []
        for lo in range(0, len(new), 2000):
            part = new[lo : lo + 2000]
            cut = ids = np.zeros(0, np.int64)
            if len(self.between) == 1 and not any("\x01" in u for u in part):
                ids = self.whole(" \x01 ".join(part))
                cut = np.flatnonzero(ids == self.between[0])
            out += np.split(ids, np.ravel([[c, c + 1] for c in cut]).astype(int))[::2] if len(cut) == len(part) - 1 else map(self.whole, part)
        return out

    def learn(self, hashes: np.ndarray, new: list[str]) -> None:
        """hashes: sorted, of units not known yet."""
        got = self.learned(new)
        n = np.array([len(x) for x in got], np.int64)
        at = len(self.ids) + np.cumsum(n) - n
        place = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.n = np.insert(self.hash, place, hashes), np.insert(self.at, place, at), np.insert(self.n, place, n)
        self.ids = np.concatenate([self.ids, *got]).astype(np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = {i: self.whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        h, first, end, of, buf = units([b"" if i in odd else t.encode() for i, t in enumerate(texts)])
        unit, one, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(unit) > CACHE:
            self.forget()
        place = np.searchsorted(self.hash, unit)
        fresh = np.flatnonzero(self.hash[np.minimum(place, len(self.hash) - 1)] != unit) if len(self.hash) else np.arange(len(unit))
        if len(fresh):
            raw = buf.tobytes()
            self.learn(unit[fresh], [raw[a:b].decode() for a, b in zip(first[one[fresh]].tolist(), end[one[fresh]].tolist(), strict=True)])
            place = np.searchsorted(self.hash, unit)
        n = self.n[place][which]
        before = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.at[place][which] - before, n) + np.arange(n.sum())]
        ends = np.cumsum(np.bincount(of, n, len(texts)).astype(np.int64))
        return [odd.get(i, x) for i, x in enumerate(np.split(ids, ends[:-1]))] if texts else []


def tokens(path: str) -> Tokens:
    kept = worker_state().__dict__.setdefault("tokens", {})
    if path not in kept:
        kept[path] = Tokens(path)
    return kept[path]


def cut_pieces(batches, path: str, length: int):
    import os

    import pyarrow.compute as pc

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = tokens(path)
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20))) + 1
            part = b.slice(at, end - at)
            texts = [t or "" for t in part.column("text").to_pylist()]
            out: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(texts), strict=True):
                data = memoryview(ids.astype("<u4").tobytes() + b"\0\0\0\0")
                for piece, start in enumerate(range(0, len(data) // 4, length)):
                    part_of = data[4 * start : 4 * (start + length)]
                    out.append((doc_id, piece, start, len(part_of) // 4, zlib.crc32(part_of)))
            at = end
            yield record(PIECES, *map(list, zip(*out, strict=True)))
    trim()


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) for each size in turn, and the number of sequences."""
    open_ = np.zeros(length + 1, np.int64)  # sequences by the gap they have left
    with_gap: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    impossible = 1 << 40
    for i, s in enumerate(sizes.tolist()):
        # what the sum of squares changes by, for a sequence with gap s, s+1, ..., length - 1
        change = 2 * (open_[: length - s] - open_[s:length]) + 2
        best, gap = 2 * open_[length - s] + 1 if s < length else 0, length
        if len(change):
            change[0] = 1 - 2 * open_[s]
            change[open_[s:length] == 0] = impossible
            k = int(change.argmin())
            if change[k] <= best:
                gap = s + k
        if gap < length:
            at = with_gap[gap].pop()
            open_[gap] -= 1
        else:
            at = n
            n += 1
        sequence[i], offset[i] = at, length - gap
        if gap > s:
            with_gap[gap - s].append(at)
            open_[gap - s] += 1
    return sequence, offset, n


def pack_group(rows: pd.DataFrame, length: int, turn_no: int) -> pd.DataFrame:
    """Packs a group in falling order of length and in hash order, and keeps what takes fewer sequences."""
    order = np.lexsort((rows.start, rows.doc_id.fillna(-1), rows.ids_crc32))
    rows = rows.iloc[order].reset_index(drop=True)
    sizes = rows.length.to_numpy(np.int64)
    best = None
    for turn in (np.argsort(-sizes, kind="stable"), np.arange(len(sizes))):
        sequence, offset, n = sum_of_squares(sizes[turn], length)
        if best is None or n < best[2]:
            back = np.empty(len(turn), np.int64)
            back[turn] = np.arange(len(turn))
            best = sequence[back], offset[back], n
    gap = length - np.bincount(best[0], sizes).astype(np.int64)
    number = (turn_no << 56) + rows.group.to_numpy(np.int64) * (1 << 24) + best[0]
    return rows.assign(sequence_id=number, offset=best[1], gap=gap[best[0]]).drop(columns="group")


def packer(length: int, turn_no: int):
    return lambda rows: pack_group(rows, length, turn_no)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)"""
    at = path or vocabulary()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: cut_pieces(b, at, length), ddl(PIECES))


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, size: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. size: pieces in a group"""
    all_pieces = keep(pieces(docs, path, length))
    # a full piece is a sequence of its own; ids below zero are theirs
    full = all_pieces.filter(F.col("length") == length)
    done = [full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    todo, before = all_pieces.filter(F.col("length") < length), None
    schema = ddl([*PIECES, ("sequence_id", "long"), ("offset", "long"), ("gap", "long")])
    for turn in range(TURNS):
        n = todo.count()
        groups = max(1, -(-n // size))
        group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.lit(turn)), F.lit(groups)).cast("long")
        placed = todo.withColumn("group", group).groupBy("group").applyInPandas(packer(length, turn), schema)
        if groups == 1 or turn == TURNS - 1 or (before is not None and 10 * n > 9 * before):
            done.append(placed.drop("gap"))
            break
        placed, before = keep(placed), n
        done.append(placed.filter("gap = 0").drop("gap"))
        todo = placed.filter("gap > 0").drop("sequence_id", "offset", "gap")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"))
