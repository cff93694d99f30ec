"""Quality rules with a bitmask ledger.

Every rule is evaluated once for each document, in one pass without a shuffle. The ledger
keeps the measurements and a bit for each rule that failed, and is stored. A policy is a
version and a mask of the rules that reject; applying one, or asking what each rule alone
rejects, reads the ledger's bits and no text.

Rule bits are numbered by RULES and never reused; a new rule takes the next bit.

Defined results: a null text has no words, and so fails the base. Repeated rows are judged
each alone. Very long texts are measured whole. Measures at a threshold pass. An empty table gives an empty ledger. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, keep, load, record, run_starts
from .grams import Windows, span_hashes, words

#: In this order; n_chars counts code points, n_digits the digits 0-9, n_letter_words the words with an ASCII letter or a character beyond ASCII.
MEASURES = [
    *((m, "long") for m in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")),
    *((m, "long") for m in ("n_letter_words", "longest_word", "n_digits", "n_bullet_lines", "n_ellipsis_lines", "n_bad_chars")),
]
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: (name, fails when). Fractions are written as products, so integers decide.
RULES: list[tuple[str, Column | str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("mean_word_short", "word_chars < 2 * n_words"),
    ("mean_word_long", "word_chars > 16 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("too_many_words", "n_words > 1000000"),
    ("few_letters", "10 * n_letter_words < 6 * n_words"),
    ("very_long_word", "longest_word > 1000"),
    ("digits", "10 * n_digits > 4 * word_chars"),
    ("bullets", "n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "n_lines >= 4 AND 10 * n_ellipsis_lines > 5 * n_lines"),
    ("broken_encoding", "100 * n_bad_chars > word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Each version's rejecting rules. A published version is never changed.
POLICIES = {1: BASE, 2: BASE | BIT["mean_word_short"] | BIT["mean_word_long"] | BIT["symbols"] | BIT["duplicate_lines"]}
POLICIES[3] = POLICIES[2] | BIT["few_letters"] | BIT["very_long_word"] | BIT["digits"] | BIT["bullets"] | BIT["ellipses"] | BIT["broken_encoding"]
LATEST = 3
BULLETS = tuple(x.encode() for x in ("- ", "* ", "•"))


def measured(texts: list[bytes]) -> list[np.ndarray]:
    n = len(texts)
    h, first, end, text, buf = words(texts)
    count = lambda which: np.bincount(which, minlength=n).astype(np.int64)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
    chars = np.bincount(text, weights=total[end] - total[first], minlength=n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = count(np.searchsorted(at, np.flatnonzero(symbol[buf]), "right") - 1)
    # lines: joined texts end with a line feed, so each text's lines end at one of these
    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    has_word = np.searchsorted(first, line_end) > np.searchsorted(first, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_text = np.searchsorted(at, line_start, "right") - 1
    whole = buf.tobytes()
    line_hash = span_hashes(buf, line_start, line_end)
    order = np.lexsort((line_hash, line_text))
    again = np.ones(len(order), bool)
    again[run_starts(line_text[order], line_hash[order])] = False
    for i in np.flatnonzero(again).tolist():  # the bytes decide
        x, y = order[i - 1], order[i]
        if whole[line_start[x] : line_end[x]] != whole[line_start[y] : line_end[y]]:
            t = texts[line_text[y]].split(b"\n")
            t = [x for x in t if x.strip(b" \t\r\v\f")]
            again[line_text[order] == line_text[y]] = np.arange((line_text == line_text[y]).sum()) >= len(set(t))
    dup = count(line_text[order][again])
    first_word = np.searchsorted(first, line_start)
    last_word = np.searchsorted(end, line_end, "right") - 1
    bullet = np.array([whole.startswith(BULLETS, x) for x in first[first_word].tolist()], bool)
    ellipsis = np.array([whole.endswith((b"...", "…".encode()), max(x - 3, 0), x) for x in end[last_word].tolist()], bool)
    letter = (((buf | 0x20) >= 0x61) & ((buf | 0x20) <= 0x7A)) | (buf >= 0x80)
    letters = np.concatenate([[0], np.cumsum(letter)])
    digits = count(np.searchsorted(at, np.flatnonzero((buf >= 0x30) & (buf <= 0x39)), "right") - 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, total[end] - total[first])
    bad = (buf[:-2] == 0xEF) & (buf[1:-1] == 0xBF) & (buf[2:] == 0xBD) if len(buf) > 2 else np.zeros(0, bool)
    more = [count(text[letters[end] > letters[first]]), longest, digits, count(line_text[bullet]), count(line_text[ellipsis]), count(np.searchsorted(at, np.flatnonzero(bad), "right") - 1)]
    # words in windows that are found twice or more in their text
    m = max(0, len(h) - WINDOW + 1)
    start = np.flatnonzero(text[:m] == text[WINDOW - 1 :]) if m else np.zeros(0, np.int64)
    w = Windows(h).all(WINDOW)[start]
    order = np.lexsort((w, text[start]))
    runs = run_starts(text[start][order], w[order])
    times = np.repeat(np.diff(np.append(runs, len(order))), np.diff(np.append(runs, len(order))))
    again = start[order][times > 1]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return [count(text), chars, symbols, count(line_text), dup, count(text[np.cumsum(change[:-1]) > 0]), *more]


def _measure_batches(batches):
    import pyarrow as pa

    for b in batches:
        rows = b.column("bytes").to_pylist()
        parts, held, size = [], [], 0
        for t in rows:
            held.append(t or b"")
            size += len(held[-1])
            if size > 1 << 20:
                parts.append(measured(held))
                held, size = [], 0
        if held:
            parts.append(measured(held))
        got = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
        made = record(MEASURES, *got)
        keep = [n for n in b.schema.names if n != "bytes"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *made.columns], names=[*keep, *made.schema.names])


def ledger(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, the measurements, failed): bit i of failed is set if rule i failed."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("binary").alias("bytes"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields if f.name != "bytes")
    m = raw.mapInArrow(_measure_batches, f"{kept}, {ddl(MEASURES)}")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return m.withColumn("failed", failed.cast("long"))


def apply_policy(entries: DataFrame, version: int = LATEST) -> DataFrame:
    mask = POLICIES[version]
    return entries.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablations(entries: DataFrame, version: int = LATEST) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail no other, and how many it would keep if dropped.

    Documents are first counted by what they failed, of which there are as many kinds as rule sets at most.
    """
    mask = POLICIES[version]
    kinds = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n_docs"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask)))
    hit = F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n_docs")).otherwise(0)
    only = F.when(F.col("failed") == F.col("bit"), F.col("n_docs")).otherwise(0)
    per = kinds.select("failed", "n_docs", rules.alias("r")).select("failed", "n_docs", "r.*")
    return per.groupBy("rule").agg(F.sum(hit).alias("n_failed"), F.sum(only).alias("n_failed_alone"))


def judged(docs: DataFrame, version: int = LATEST, carry: tuple[str, ...] = ()) -> DataFrame:
    """The stored ledger with a policy's verdict. Other policies and ablations can read the same ledger."""
    return apply_policy(keep(ledger(docs, carry)), version)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    return judged(load(spark, sf_dir, "documents")).select(*columns)
