"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes the table of the one before, which is written as Parquet in the shared
folder and read again, so that a lost executor costs no earlier stage. All but the last
return the columns of documents; other columns of the input pass through unchanged.

Defined results: a null text fails the quality rules. Rows whose
texts have the same shingles are copies; one stays. A document whose words all go in substring dedup goes.
Of copies the row with the smallest doc_id stays, of rows that share it that with the smallest
hash. n_chars follows the text where a stage changes it. Very long texts are read whole. An
empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callatlas.llm.common import keep, load
from callatlas.llm.mixing import mixed, sizes, take
from callatlas.llm.near_texts import representatives
from callatlas.llm.packing import packed
from callatlas.llm.quality_rules import apply_policy, ledger
from callatlas.llm.substring_dedup import remove_repeated_words


def _with_row(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, and the whole row apart from the text under one name that clashes with none."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row"))


def _rebuilt(rows: DataFrame, like: DataFrame, changed: bool) -> DataFrame:
    """The columns of `like` from (row, text)"""
    length = F.length("text").cast("long") if changed else F.col("row.n_chars")
    of = {"text": F.col("text")} | ({"n_chars": length} if "n_chars" in like.columns else {})
    return rows.select(*(of.get(c, F.col(f"row.`{c}`")).cast(like.schema[c].dataType).alias(c) for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy rejects go."""
    judged = apply_policy(ledger(_with_row(docs), carry=("text", "row")))
    return _rebuilt(judged.filter("kept"), docs, changed=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return _rebuilt(representatives(_with_row(docs), carry=("row",)), docs, changed=False)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has go; a text that loses none stays as it is."""
    kept = remove_repeated_words(_with_row(docs), carry=("row",), whole=True)
    rows = kept.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", F.decode("kept", "UTF-8"))
    return _rebuilt(rows, docs, changed=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: documents are left out, cut at a source's budget, or repeated."""
    got = take(docs, mixed(keep(sizes(docs))))
    return got.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else got


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents, placed in sequences."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express SimHash links or sum-of-squares placement. Tests hold the first three stages' decisions and the placement against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
