"""Mixing sources to target weights.

Documents get a hash-random key and are range-sorted within their source: equal ranges of
the key are buckets of about BUCKET documents, since hashes are spread evenly. Prefix sums
over the buckets' token counts, then within each bucket, give every document the tokens of
its source that come before it. A source's budget is cut exactly: whole epochs first, then
documents in key order, the last one in part.

Sources are in code point order, null last, and weigh WEIGHTS, repeating. Together they
get as many tokens as there are. Targets stop at MOST times what the source has; the
excess goes to the others by weight until none is above.

Defined results: a null text has size 0; null is a source of its own. Rows with equal ids
and sizes share a key and take their turns in any order, with the same results as a whole.
An empty table gives no rows. Other columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, id_or_last, keep, load

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET = 1024
SEED = "mix-1"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), key.alias("key"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, target). One row a source, so these windows see no document.

    Sources reach their cap in the order of size per weight. If those before a source have
    theirs, the rest is shared by weight; the first source that this keeps below its cap
    gives the share of all that follow.
    """
    each = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("long")
    each = each.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    each = (
        each.withColumn("rank", F.row_number().over(order))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("free", F.col("cap") * F.col("weights") > F.col("left") * F.col("weight"))
    )
    first = F.min(F.when(F.col("free"), F.struct("rank", "left", "weights"))).over(everything)
    shared = F.col("weight") * F.col("first.left") / F.col("first.weights")
    each = each.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("cap").cast("double")).otherwise(shared)
    return each.select("source", "n_docs", "source_size", target.alias("target"))


def mixed(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken)

    sized: (doc_id, source, size, key), which should be cheap to read twice.
    """
    t = targets(sized).withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET)).withColumnRenamed("source", "of")
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2.0**32)).cast("long")
    rows = sized.join(t, sized.source.eqNullSafe(t.of)).withColumn("bucket", at).drop("of")
    sums = rows.groupBy(F.col("source").alias("of"), F.col("bucket").alias("range")).agg(F.sum("size").alias("tokens"))
    ahead = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).drop("tokens")
    order = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, rows.source.eqNullSafe(sums.of) & (rows.bucket == sums.range)).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0))
    part = F.least(F.greatest(budget - F.col("whole") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    return rows.withColumn("whole", whole).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def take(docs: DataFrame, amounts: DataFrame) -> DataFrame:
    """The documents of the mix: as many whole copies as are taken, then the part that the budget cuts.

    amounts: (doc_id, size, taken). Rows that share a doc_id, null included, share what they
    take in proportion to their sizes, rounded down.
    """
    a = amounts.groupBy(id_or_last().alias("of")).agg(F.sum("taken").alias("all_taken"), F.sum("size").alias("all_size"), F.count("*").alias("n_rows")).filter("all_taken > 0")
    rows = docs.select(id_or_last().alias("mix_id"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(a, rows.mix_id == a.of)
    size = F.when(F.col("n_rows") == 1, F.col("all_size")).otherwise(word_count("row.text"))
    share = F.when(F.col("n_rows") == 1, F.col("all_taken")).otherwise(F.floor(F.col("all_taken") * F.col("size") / F.col("all_size")).cast("long"))
    rows = rows.withColumn("size", size).withColumn("share", share).filter("share > 0")
    rest = F.col("share") - F.col("nth") * F.col("size")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("share") / F.col("size")) - 1)))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), 1, rest.cast("int")), " ")
    text = F.when(rest >= F.col("size"), F.col("row.text")).otherwise(cut)
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(keep(sizes(load(spark, sf_dir, "documents"))))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
each_source AS (
  SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight,
         {MOST} * source_size AS cap
  FROM each_source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST) AS rank FROM weighed),
filled AS (
  SELECT a.*, (SELECT sum(source_size) FROM ranked) - coalesce((SELECT sum(cap) FROM ranked b WHERE b.rank < a.rank), 0) AS lft,
         (SELECT sum(weight) FROM ranked) - coalesce((SELECT sum(weight) FROM ranked b WHERE b.rank < a.rank), 0) AS weights
  FROM ranked a),
first_free AS (
  SELECT rank AS first_rank, lft AS first_left, weights AS first_weights FROM filled
  WHERE cap * weights > lft * weight ORDER BY rank LIMIT 1),
target_of AS (
  SELECT source, source_size,
         CASE WHEN first_rank IS NULL OR rank < first_rank THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * first_left AS DOUBLE) / CAST(first_weights AS DOUBLE) END AS target
  FROM filled LEFT JOIN first_free ON true),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN target_of t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) END AS BIGINT) AS taken
FROM placed
"""
