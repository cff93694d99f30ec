"""The functions under names that SQL can call: temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .stats import Z
from .text import STOPWORDS

_WILSON = "CASE WHEN n = 0 THEN {none} ELSE greatest(0.0D, least(1.0D, (hits / n + {z2} / (2 * n) {sign} {z} * sqrt((hits / n * (1 - hits / n) + {z2} / (4 * n)) / n)) / (1 + {z2} / n))) END"


def register(spark: SparkSession) -> list[str]:
    """slug_normal(s), slug_tokens(s), slug_similarity(a, b), wilson_low(hits, n), wilson_high(hits, n)"""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    made = {
        "slug_normal(s STRING) RETURNS STRING": "regexp_replace(regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', '_'), '^_+|_+$', '')",
        "slug_tokens(s STRING) RETURNS ARRAY<STRING>": f"array_distinct(transform(filter(split(slug_normal(s), '_'), t -> t <> '' AND t NOT IN ({stop})), t -> CASE WHEN length(t) > 4 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END))",
        "slug_similarity(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN size(slug_tokens(a)) = 0 OR size(slug_tokens(b)) = 0 THEN 0.0D ELSE size(array_intersect(slug_tokens(a), slug_tokens(b))) / size(array_union(slug_tokens(a), slug_tokens(b))) END",
        **{f"wilson_{end}(hits BIGINT, n BIGINT) RETURNS DOUBLE": _WILSON.format(none=none, z=Z, z2=Z * Z, sign=sign) for end, none, sign in (("low", "0.0D", "-"), ("high", "1.0D", "+"))},
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in made]
