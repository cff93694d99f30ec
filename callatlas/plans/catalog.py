"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs, stats, text
from ..operators import coverage as cov
from ..operators import agreement as agr
from ..operators import graders, versions
from ..operators import labels as lab
from ..sources.conversations import said, transcript, turn_count
from . import inputs
from .inputs import LABELS, TURNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked gaps in coverage."""
    return QUERIES["ranked_gaps"](spark, sf_dir)


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- conversations --------------------------------------------------------------------------------


@query(f"WITH {TURNS} SELECT role, count(*) AS n FROM turn_v GROUP BY role")
def role_map(spark, sf_dir):
    return inputs.turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS} SELECT conv_id AS id, CAST(count(*) FILTER (WHERE role IN ('agent', 'caller')) AS INT) AS turn_count,
  coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'agent'), '') AS agent_text,
  coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'caller'), '') AS caller_text,
  coalesce(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS transcript
  FROM turn_v GROUP BY conv_id""")
def conversation_text(spark, sf_dir):
    c, t = inputs.conversations(spark, sf_dir), F.col("turns")
    return c.select("id", turn_count(t).alias("turn_count"), said(t, "agent").alias("agent_text"), said(t, "caller").alias("caller_text"), transcript(t).alias("transcript"))


def _any(words):
    return " OR ".join(f"contains(t, '{w}')" for w in words)


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'caller'), '')) AS t FROM turn_v GROUP BY conv_id)
  SELECT conv_id AS id, CASE {' '.join(f"WHEN {_any(k)} THEN '{s}'" for s, k in inputs.RULES.items())} ELSE 'unclassified' END AS situation,
    concat_ws(',', {', '.join(f"CASE WHEN {_any(k)} THEN '{s}' END" for s, k in inputs.CONDITIONS.items())}) AS conditions FROM c""")
def label_keywords(spark, sf_dir):
    c = inputs.conversations(spark, sf_dir).select("id", said(F.col("turns"), "caller").alias("t"))
    return c.select("id", lab.first_match(F.col("t"), inputs.RULES).alias("situation"), F.array_join(lab.all_matches(F.col("t"), inputs.CONDITIONS), ",").alias("conditions"))


def _graded(spark, sf_dir):
    return inputs.conversations(spark, sf_dir), inputs.expectations(spark)


CHECKS = f"""WITH {TURNS}, t AS (
  SELECT *, conv_id % 7 AS o, (conv_id + turn) % 5 AS k, lag(lower(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS prior FROM turn_v),
c AS (SELECT conv_id AS id, any_value(o) AS o, conv_id % 2 = 0 AS is_a, count(*) FILTER (WHERE role <> 'system') AS n,
  coalesce(bool_or(k = 0 AND turn % 2 = 0), false) AS verified, coalesce(bool_or(k = 1), false) AS transferred,
  min(turn) FILTER (WHERE k = 0 AND turn % 2 = 0) AS v_at,
  min(turn) FILTER (WHERE role = 'agent' AND regexp_matches(text, '(₹|\\bRs\\.?\\s*)\\s*\\d{{3,}}\\b|\\b\\d{{1,3}}(?:,\\d{{2,3}})+\\b|\\b\\d{{3,}}\\s*rupaye\\b', 'i')) AS amount_at,
  coalesce(bool_or(role = 'agent' AND regexp_matches(text, '\\d{{9}}|@')), false) AS pii,
  coalesce(regexp_matches(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'agent'), 'que', 'i'), false) AS asks,
  coalesce(bool_or(role = 'agent' AND regexp_matches(text, 'tion le|der die', 'i')), false) AS says,
  coalesce(bool_or(role = 'agent' AND lower(text) = prior), false) AS repeats,
  bool_or(role = 'agent') AS has_agent, bool_or(role = 'caller') AS has_caller, conv_id % 3 AS l
  FROM t GROUP BY conv_id),
e AS (
  SELECT id, 'a' AS scenario_id, unnest([
    {{'ord': 0, 'type': 'tool_called', 'passed': verified, 'severity': 'major'}}, {{'ord': 1, 'type': 'verify_before_disclosure', 'passed': amount_at IS NULL OR coalesce(v_at <= amount_at, false), 'severity': 'critical'}},
    {{'ord': 2, 'type': 'no_amount_disclosed', 'passed': amount_at IS NULL, 'severity': 'critical'}}, {{'ord': 3, 'type': 'no_pii_disclosed', 'passed': NOT pii, 'severity': 'critical'}},
    {{'ord': 4, 'type': 'outcome_in', 'passed': o IN (0, 1, 2), 'severity': 'major'}}, {{'ord': 5, 'type': 'max_turns', 'passed': n <= 6, 'severity': CASE WHEN n <= 6 THEN 'minor' ELSE 'major' END}}]) AS x
  FROM c WHERE is_a
  UNION ALL SELECT id, 'b', unnest([
    {{'ord': 0, 'type': 'agent_must_ask_for', 'passed': asks, 'severity': 'major'}}, {{'ord': 1, 'type': 'must_not_say', 'passed': NOT says, 'severity': 'critical'}},
    {{'ord': 2, 'type': 'no_repeated_agent_turn', 'passed': NOT repeats, 'severity': 'major'}},
    {{'ord': 3, 'type': 'must_respond_in_caller_language', 'passed': NOT (coalesce(has_agent, false) AND coalesce(has_caller, false)) AND l <> 0 OR l IN (0, 1), 'severity': 'major'}},
    {{'ord': 4, 'type': 'must_escalate', 'passed': transferred OR o = 2, 'severity': 'major'}}])
  FROM c WHERE NOT is_a),
checks AS (SELECT id, scenario_id, CAST(x.ord AS INT) AS ord, x.type AS type, x.passed AS passed, x.severity AS severity FROM e)"""


@query(f"{CHECKS} SELECT * FROM checks")
def grade_checks(spark, sf_dir):
    return graders.checks(*_graded(spark, sf_dir))


@query(f"{CHECKS} SELECT id, scenario_id, bool_and(passed) AS passed, bool_or(severity = 'critical' AND NOT passed) AS critical FROM checks GROUP BY id, scenario_id")
def grade_summary(spark, sf_dir):
    return graders.grades(*_graded(spark, sf_dir))


@query(f"""{CHECKS}, g AS (SELECT id, scenario_id, bool_and(passed) AS passed FROM checks GROUP BY id, scenario_id)
  SELECT scenario_id, count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pass_rate FROM g GROUP BY scenario_id""")
def suite_pass_rate(spark, sf_dir):
    rate = F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6)
    return graders.grades(*_graded(spark, sf_dir)).groupBy("scenario_id").agg(F.count("*").alias("n"), rate.alias("pass_rate"))


USAGE = f"""WITH {TURNS}, c AS (SELECT conv_id AS id, count(*) FILTER (WHERE role <> 'system') AS n, coalesce(length(string_agg(text, ' ') FILTER (WHERE role = 'agent')), 0) AS a,
  coalesce(length(string_agg(text, ' ') FILTER (WHERE role = 'caller')), 0) AS b, sum(length(text)) / 15.0 AS secs FROM turn_v GROUP BY conv_id),
u AS (SELECT id, a AS tts_characters, greatest(1, a // 4) AS out_tokens, 1400 * greatest(0, n - 1) AS cached_tokens, 1400 + b // 4 AS in_tokens, greatest(1, n) AS turns, secs FROM c),
k AS (SELECT *, secs / 3600 * 30 AS stt, in_tokens / 1e6 * 29.28 AS llm_in, cached_tokens / 1e6 * 10.98 AS llm_cached, out_tokens / 1e6 * 73.2 AS llm_out, tts_characters / 1e4 * 15 AS tts, secs / 60 * 0.36 AS telephony FROM u)"""
PARTS = ["stt", "llm_in", "llm_cached", "llm_out", "tts", "telephony"]


def _usage(spark, sf_dir):
    c, t = inputs.conversations(spark, sf_dir), F.col("turns")
    chars = F.aggregate(t, F.lit(0), lambda acc, x: acc + F.length(x["text"]))
    e = costs.estimated(F.length(said(t, "agent")), F.length(said(t, "caller")), turn_count(t))
    return c.select("id", *(v.cast("long").alias(k) for k, v in e.items()), (chars / 15.0).alias("secs"))


def _costed(spark, sf_dir):
    c = F.col
    return _usage(spark, sf_dir).withColumns(costs.components(c("secs"), c("secs"), c("tts_characters"), c("in_tokens"), c("cached_tokens"), c("out_tokens")))


@query(f"{USAGE} SELECT id, CAST(tts_characters AS BIGINT) AS tts_characters, CAST(out_tokens AS BIGINT) AS out_tokens, CAST(cached_tokens AS BIGINT) AS cached_tokens, CAST(in_tokens AS BIGINT) AS in_tokens, CAST(turns AS BIGINT) AS turns FROM u")
def usage_estimate(spark, sf_dir):
    return _usage(spark, sf_dir).drop("secs")


@query(f"{USAGE} SELECT id, {', '.join(f'round({p}, 6)::DOUBLE AS {p}' for p in PARTS)}, round(secs / 60 * 3.86, 6)::DOUBLE AS platform FROM k")
def component_cost(spark, sf_dir):
    c = _costed(spark, sf_dir)
    return c.select("id", *(F.round(p, 6).alias(p) for p in PARTS), F.round(costs.platform(F.col("secs"), F.col("secs")), 6).alias("platform"))


@query(f"""{USAGE}, s AS (SELECT count(*) AS n, {' + '.join(f'sum({p})' for p in PARTS)} AS total, sum(tts) AS tts FROM k)
  SELECT n, round(total, 4)::DOUBLE AS total, round(total / n, 6)::DOUBLE AS per_call, round(tts / total, 6)::DOUBLE AS tts_share, round((1 - total / n / 42) * 100, 4)::DOUBLE AS savings_pct FROM s""")
def corpus_economics(spark, sf_dir):
    s = _costed(spark, sf_dir).agg(F.count("*").alias("n"), sum((F.sum(p) for p in PARTS), F.lit(0.0)).alias("total"), F.sum("tts").alias("tts"))
    per = F.col("total") / F.col("n")
    return s.select("n", F.round("total", 4).alias("total"), F.round(per, 6).alias("per_call"), F.round(F.col("tts") / F.col("total"), 6).alias("tts_share"), F.round(costs.savings_percent(per), 4).alias("savings_pct"))


# --- slugs and personal data ------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""WITH n AS (SELECT p_partkey, {NORM.format("p_name || ' Requests, the '")} AS slug FROM part),
  k AS (SELECT *, list_filter(string_split(slug, '_'), lambda t: t <> '' AND t NOT IN ({STOP})) AS w FROM n)
  SELECT p_partkey, slug, array_to_string(list_sort(list_distinct(list_transform(w, lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' THEN left(t, -1) ELSE t END))), ' ') AS tokens FROM k""")
def slug_tokens(spark, sf_dir):
    slug = F.concat(F.col("p_name"), F.lit(" Requests, the "))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", text.normalise(slug).alias("slug"), F.array_join(F.array_sort(text.tokens(slug)), " ").alias("tokens"))


def _span_sql(i: int, tag: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    spans = f"list_transform(range(1, len(m{i}) + 1), lambda i: {{'r': {i}, 'less': -length(m{i}[i]), 'st': CAST(list_sum(list_transform(g{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'hit': m{i}[i], 'tag': '{tag}'}})"
    if tag == "CARD":
        digits = "string_split(regexp_replace(s.hit, '[ -]', '', 'g'), '')"
        luhn = f"list_sum(list_transform(list_reverse({digits}), lambda d, j: CASE WHEN j % 2 = 1 THEN CAST(d AS INT) WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)) % 10 = 0"
        spans = f"list_filter({spans}, lambda s: {luhn})"
    return spans


PII_SQL = f"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t, {', '.join(f"regexp_extract_all(coalesce(text, ''), '{p}') AS m{i}, string_split_regex(coalesce(text, ''), '{p}') AS g{i}" for i, (_, p) in enumerate(text.PII))} FROM documents),
s AS (SELECT doc_id, t, list_sort(list_concat({', '.join(_span_sql(i, *x) for i, x in enumerate(text.PII))})) AS spans FROM m),
x AS (SELECT doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS ord FROM s),
-- a span is kept if no kept span before it overlaps; two passes settle chains of three
c AS (SELECT doc_id, ord, s.r AS r, s.st AS st, s.st - s.less AS en, s.tag AS tag FROM x),
a AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.ord < c.ord AND b.st < c.en AND c.st < b.en)),
z AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_id = c.doc_id AND b.ord < c.ord AND b.st < c.en AND c.st < b.en))"""


def _pii(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", "text", text.pii_spans(F.coalesce("text", F.lit(""))).alias("spans"))


@query(f"{PII_SQL} SELECT doc_id, tag, count(*) AS n, CAST(min(st) AS BIGINT) AS first, CAST(max(en) AS BIGINT) AS last FROM z GROUP BY doc_id, tag")
def pii_found(spark, sf_dir):
    rows = _pii(spark, sf_dir).filter(F.size("spans") > 0).select("doc_id", F.explode("spans").alias("s"))
    return rows.groupBy("doc_id", F.col("s.tag").alias("tag")).agg(F.count("*").alias("n"), F.min("s.st").cast("long").alias("first"), F.max("s.en").cast("long").alias("last"))


@query(f"""{PII_SQL}, p AS (SELECT *, coalesce(lag(en) OVER (PARTITION BY doc_id ORDER BY st), 0) AS before FROM z),
  j AS (SELECT doc_id, string_agg(substring(t, before + 1, st - before) || '[' || tag || ']', '' ORDER BY st) AS head, max(en) AS en FROM p JOIN m USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, coalesce(head, '') || substring(t, coalesce(en, 0) + 1) AS redacted FROM m LEFT JOIN j USING (doc_id)""")
def redact_pii(spark, sf_dir):
    return _pii(spark, sf_dir).select("doc_id", text.redacted(F.col("text"), F.col("spans")).alias("redacted"))


# --- clusters and coverage --------------------------------------------------------------------------


def _clustered(spark, sf_dir):
    return cov.clustered(inputs.labels(spark, sf_dir))


@query(f"WITH {LABELS} SELECT DISTINCT slug, cluster FROM keyed")
def cluster_fold(spark, sf_dir):
    return cov.cluster_keys(inputs.labels(spark, sf_dir))


@query(f"""WITH {LABELS} SELECT cluster, count(*) AS volume, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE pii_exposure OR intimidation) AS compliance_hits,
  round(sum(cost), 4)::DOUBLE AS cost, min(id) AS first FROM keyed GROUP BY cluster""")
def cluster_rollup(spark, sf_dir):
    return cov.rollup(_clustered(spark, sf_dir)).select("cluster", "volume", "failures", "compliance_hits", F.round("cost", 4).alias("cost"), "first")


COUNTS = f"""WITH {LABELS}, counts AS (
  SELECT cluster, condition, count(*) AS n FROM (SELECT cluster, unnest(list_filter([CASE WHEN hardship THEN 'hardship' END, CASE WHEN poor_audio THEN 'poor_audio' END,
    CASE WHEN pii_exposure THEN 'compliance:pii_exposure' END, CASE WHEN intimidation THEN 'compliance:intimidation' END], lambda x: x IS NOT NULL)) AS condition FROM keyed) GROUP BY ALL)"""


@query(f"{COUNTS} SELECT * FROM counts")
def condition_counts(spark, sf_dir):
    return cov.condition_counts(_clustered(spark, sf_dir))


COVERAGE = f"""{COUNTS}, main AS (SELECT cluster, kind, count(*) AS volume, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE pii_exposure OR intimidation) AS hits FROM keyed GROUP BY cluster, kind HAVING count(*) >= 3),
declared AS (SELECT * FROM (VALUES ('click', ['hardship']), ('view', ['hardship', 'poor_audio']), ('error', ['hardship', 'poor_audio']), ('purchase', ['hardship'])) AS v(kind, declared)),
seen AS (SELECT m.cluster, list_sort(coalesce(list(condition) FILTER (WHERE NOT condition LIKE 'compliance:%' AND n >= 0.25 * volume), [])) AS observed,
  list_sort(coalesce(list(condition) FILTER (WHERE condition LIKE 'compliance:%' AND n >= 2 AND n >= 0.15 * volume), [])) AS critical,
  list_sort(coalesce(list(condition) FILTER (WHERE condition LIKE 'compliance:%' AND NOT (n >= 2 AND n >= 0.15 * volume)), [])) AS suppressed FROM main m LEFT JOIN counts c USING (cluster) GROUP BY m.cluster),
j AS (SELECT m.*, s.*, declared, CASE WHEN declared IS NULL THEN [] ELSE list_filter(observed, lambda x: NOT list_contains(declared, x)) END AS missing FROM main m JOIN seen s USING (cluster) LEFT JOIN declared USING (kind)),
cov AS (SELECT *, CASE WHEN declared IS NULL THEN 'uncovered' WHEN len(missing) > 0 OR len(critical) > 0 THEN 'partial' ELSE 'covered' END AS status,
  CASE WHEN len(critical) > 0 THEN 3.0 WHEN hits > 0.1 * volume THEN 2.0 ELSE 1.0 END AS weight, sum(volume) OVER () AS total FROM j)"""
RANKED = f"{COVERAGE} SELECT cluster, volume, failures, status, array_to_string(missing, ',') AS missing, array_to_string(critical, ',') AS critical_flags, array_to_string(suppressed, ',') AS suppressed_flags, round(CASE WHEN status = 'covered' THEN 0 ELSE CAST(failures AS DOUBLE) / total * weight END, 6)::DOUBLE AS priority FROM cov"


def _coverage(spark, sf_dir):
    return cov.coverage(_clustered(spark, sf_dir), inputs.scenarios(spark), inputs.CRITICAL)


def _shown(c):
    joined = [F.array_join(F.array_sort(x), ",").alias(x) for x in ("missing", "critical_flags", "suppressed_flags")]
    return c.select("cluster", "volume", "failures", "status", *joined, F.round("priority", 6).alias("priority"))


@query(RANKED)
def coverage_rows(spark, sf_dir):
    return _shown(_coverage(spark, sf_dir))


@query(f"SELECT * FROM ({RANKED}) WHERE status <> 'covered' ORDER BY priority DESC, cluster")
def ranked_gaps(spark, sf_dir):
    return _shown(_coverage(spark, sf_dir)).filter("status <> 'covered'").orderBy(F.desc("priority"), "cluster")


SUMMARY = f"""{COVERAGE}, total AS (SELECT 100.0 * sum(volume) FILTER (WHERE status <> 'uncovered') / sum(volume) AS declared_pct, 100.0 * coalesce(sum(volume) FILTER (WHERE status = 'covered'), 0) / sum(volume) AS coverage_pct,
  100.0 * coalesce(sum(volume) FILTER (WHERE status = 'uncovered'), 0) / sum(volume) AS undeclared_pct, count(*) FILTER (WHERE status <> 'covered' AND len(critical) > 0) AS critical_gaps, count(*) AS n_clusters FROM cov)"""


@query(f"{SUMMARY} SELECT round(declared_pct, 4)::DOUBLE AS declared_pct, round(coverage_pct, 4)::DOUBLE AS coverage_pct, round(undeclared_pct, 4)::DOUBLE AS undeclared_pct, critical_gaps, n_clusters FROM total")
def coverage_summary(spark, sf_dir):
    s = cov.summary(_coverage(spark, sf_dir))
    return s.select(*(F.round(c, 4).alias(c) for c in ("declared_pct", "coverage_pct", "undeclared_pct")), "critical_gaps", "n_clusters")


@query(f"{SUMMARY} SELECT 'declared' AS name, declared_pct >= 85 AS passed FROM total UNION ALL SELECT 'coverage', coverage_pct >= 60 FROM total UNION ALL SELECT 'critical_gaps', critical_gaps = 0 FROM total")
def gate_checks(spark, sf_dir):
    return cov.gate(cov.summary(_coverage(spark, sf_dir)))


# --- versions and agreement ---------------------------------------------------------------------------


def _wilson(f, n, sign):
    p = f"({f}::DOUBLE / {n})"
    return f"round(greatest(0, least(1, ({p} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}))), 6)::DOUBLE"


def _fisher(k, n, k2, n2):
    lc = lambda a, b: f"(lgamma({a} + 1.0) - lgamma({b} + 1.0) - lgamma({a} - {b} + 1.0))"
    return f"list_sum(list_transform(range({k}, least({n}, {k} + {k2}) + 1), lambda x: exp({lc(n, 'x')} + {lc(n2, f'({k} + {k2} - x)')} - {lc(f'({n} + {n2})', f'({k} + {k2})')})))"


@query(f"""WITH {LABELS}, t AS (SELECT cluster, count(*) FILTER (WHERE version = 'v2') AS n_base, count(*) FILTER (WHERE version = 'v2' AND failed) AS f_base,
  count(*) FILTER (WHERE version = 'v3') AS n_cand, count(*) FILTER (WHERE version = 'v3' AND failed) AS f_cand FROM keyed GROUP BY cluster),
p AS (SELECT *, f_cand::DOUBLE / n_cand - f_base::DOUBLE / n_base AS delta, {_fisher('f_cand', 'n_cand', 'f_base', 'n_base')} AS worse, {_fisher('f_base', 'n_base', 'f_cand', 'n_cand')} AS better FROM t),
v AS (SELECT *, CASE WHEN n_base < 8 OR n_cand < 8 THEN 'insufficient_data' WHEN worse < 0.05 AND delta > 0 THEN 'regression' WHEN better < 0.05 AND delta < 0 THEN 'improvement' ELSE 'unchanged' END AS verdict FROM p)
SELECT cluster, n_base, f_base, n_cand, f_cand, verdict, round(CASE verdict WHEN 'regression' THEN worse WHEN 'improvement' THEN better WHEN 'unchanged' THEN least(worse, better) END, 5)::DOUBLE AS p,
  round(delta, 6)::DOUBLE AS delta, {_wilson('f_cand', 'n_cand', '-')} AS cand_low, {_wilson('f_cand', 'n_cand', '+')} AS cand_high FROM v""")
def version_diff(spark, sf_dir):
    d = versions.compare(_clustered(spark, sf_dir), "v2", "v3")
    return d.select("cluster", "n_base", "f_base", "n_cand", "f_cand", "verdict", F.round("p", 5).alias("p"), *(F.round(c, 6).alias(c) for c in ("delta", "cand_low", "cand_high")))


@query("""WITH t AS (SELECT count(*) AS n, avg(CASE WHEN (quality = 1) = (toxic = 1) THEN 1.0 ELSE 0.0 END) AS po, avg(quality::DOUBLE) AS a, avg(toxic::DOUBLE) AS b FROM labels),
  k AS (SELECT n, round(po, 6)::DOUBLE AS agreement, round(CASE WHEN a * b + (1 - a) * (1 - b) >= 1 THEN 1 ELSE (po - a * b - (1 - a) * (1 - b)) / (1 - a * b - (1 - a) * (1 - b)) END, 6)::DOUBLE AS kappa FROM t), r AS (SELECT n, agreement, kappa FROM k)
  SELECT *, CASE WHEN kappa > 0.8 THEN 'almost perfect' WHEN kappa > 0.6 THEN 'substantial' WHEN kappa > 0.4 THEN 'moderate' WHEN kappa > 0.2 THEN 'fair' ELSE 'poor' END AS reading FROM r""")
def kappa(spark, sf_dir):
    pairs = inputs.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), F.expr("toxic = 1").alias("b"))
    pairs = pairs.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    return versions.agreement(pairs).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"), stats.kappa_reading(F.col("kappa")).alias("reading"))


@query("SELECT doc_id, quality = 1 AS a, toxic = 1 AS b FROM labels WHERE (quality = 1) <> (toxic = 1)")
def disagreements(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return rows.filter("a <> b")


@query(f"WITH {LABELS} SELECT DISTINCT slug, 'GEN-' || lpad(CAST(CAST('0x' || left(sha256(slug), 6) AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS scenario_id FROM keyed")
def scenario_ids(spark, sf_dir):
    slugs = inputs.labels(spark, sf_dir).select(text.normalise(F.col("situation")).alias("slug")).distinct()
    number = F.conv(F.left(F.sha2("slug", 256), F.lit(6)), 16, 10).cast("int") % 10000
    return slugs.select("slug", F.concat(F.lit("GEN-"), F.lpad(number.cast("string"), 4, "0")).alias("scenario_id"))


@query(f"""WITH {LABELS}, n AS (SELECT cluster, CASE WHEN id % 3 = 0 THEN 'slow' WHEN id % 3 = 1 THEN 'rude' ELSE 'lost' END || id % 4 AS mode, min(id) AS first FROM keyed WHERE failed GROUP BY ALL)
  SELECT cluster, mode, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY first, mode) AS place FROM n) WHERE place <= 6""")
def failure_modes_top(spark, sf_dir):
    kind = F.when(F.col("id") % 3 == 0, "slow").when(F.col("id") % 3 == 1, "rude").otherwise("lost")
    return cov.failure_modes(_clustered(spark, sf_dir).withColumn("mode", F.concat(kind, (F.col("id") % 4).cast("string"))))


@query(f"WITH {LABELS} SELECT cluster, version, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, round(sum(cost), 4)::DOUBLE AS cost FROM keyed GROUP BY cluster, version")
def version_counts(spark, sf_dir):
    return cov.version_counts(_clustered(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@query(f"{COUNTS} SELECT cluster, condition, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, condition) AS place FROM counts) WHERE place <= 4")
def top_conditions(spark, sf_dir):
    return cov.top_conditions(cov.condition_counts(_clustered(spark, sf_dir)))


@query(f"""WITH {LABELS}, c AS (SELECT cluster, count(*) AS volume FROM (SELECT CASE WHEN id % 1000 = 7 THEN 'rare' || id % 3000 ELSE cluster END AS cluster FROM keyed) GROUP BY cluster)
  SELECT cluster, volume, volume < 5 AS tail FROM c""")
def tail_split(spark, sf_dir):
    rare = F.when(F.col("id") % 1000 == 7, F.concat(F.lit("rare"), (F.col("id") % 3000).cast("string"))).otherwise(F.col("cluster"))
    main, tail = cov.main_and_tail(cov.rates(cov.rollup(_clustered(spark, sf_dir).withColumn("cluster", rare))), 5)
    return main.select("cluster", "volume", F.lit(False).alias("tail")).unionByName(tail.select("cluster", "volume", F.lit(True).alias("tail")))


@query(f"""WITH {LABELS}, c AS (SELECT cluster, count(*) AS volume, count(*) FILTER (WHERE failed) AS failures, sum(cost) AS cost FROM keyed GROUP BY cluster)
  SELECT cluster, round(failures / volume, 6)::DOUBLE AS fail_rate, round(0.55, 6)::DOUBLE AS mean_confidence, round(cost * failures / volume, 4)::DOUBLE AS failed_cost FROM c""")
def cluster_rates(spark, sf_dir):
    c = cov.rates(cov.rollup(_clustered(spark, sf_dir)))
    return c.select("cluster", F.round("fail_rate", 6).alias("fail_rate"), F.round("mean_confidence", 6).alias("mean_confidence"), F.round("failed_cost", 4).alias("failed_cost"))


@query(f"""WITH {LABELS} SELECT count(*) FILTER (WHERE version = 'v2') AS n_base, count(*) FILTER (WHERE version = 'v2' AND failed) AS f_base, count(*) FILTER (WHERE version = 'v3') AS n_cand,
  count(*) FILTER (WHERE version = 'v3' AND failed) AS f_cand,
  round(count(*) FILTER (WHERE version = 'v3' AND failed) / count(*) FILTER (WHERE version = 'v3') - count(*) FILTER (WHERE version = 'v2' AND failed) / count(*) FILTER (WHERE version = 'v2'), 6)::DOUBLE AS delta FROM keyed""")
def version_overall(spark, sf_dir):
    o = versions.overall(versions.compare(_clustered(spark, sf_dir), "v2", "v3"))
    return o.select("n_base", "f_base", "n_cand", "f_cand", F.round("delta", 6).alias("delta"))


RATERS = """a AS (SELECT event_id AS id, event_type AS situation, value > 10 AS failed, event_id % 5 = 0 AS is_new FROM events WHERE event_id % 4 <> 1),
b AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'other_' || event_id % 3 ELSE event_type END AS situation, value > 11 AS failed, event_id % 6 = 0 AS is_new FROM events WHERE event_id % 4 <> 2),
j AS (SELECT id, a.situation AS sa, b.situation AS sb, a.failed AS fa, b.failed AS fb, a.is_new AS na, b.is_new AS nb FROM a JOIN b USING (id))"""


def _raters(spark, sf_dir):
    e, n = inputs.table(spark, sf_dir, "events"), F.col("event_id")
    other = F.when(n % 7 == 0, F.concat(F.lit("other "), (n % 3).cast("string"))).otherwise(F.col("event_type"))
    side = lambda s, most, new: e.select(n.alias("id"), s.alias("situation"), (F.col("value") > most).alias("failed"), (n % new == 0).alias("is_new"))
    return agr.both(side(F.initcap("event_type"), 10, 5).filter("id % 4 <> 1"), side(other, 11, 6).filter("id % 4 <> 2"))


@query(f"""WITH {RATERS}, k AS (SELECT count(*) AS n, avg((sa = sb)::INT) AS s, avg((fa = fb)::INT) AS po, avg(fa::INT) AS p, avg(fb::INT) AS q, avg(na::INT) AS na, avg(nb::INT) AS nb,
  count(*) FILTER (WHERE sa <> sb AND fa = fb) AS situation_only, count(*) FILTER (WHERE sa = sb AND fa <> fb) AS failure_only, count(*) FILTER (WHERE sa <> sb AND fa <> fb) AS in_both FROM j)
  SELECT n, round(s, 6)::DOUBLE AS situation_agreement, round(po, 6)::DOUBLE AS agreement, round((po - p * q - (1 - p) * (1 - q)) / (1 - p * q - (1 - p) * (1 - q)), 6)::DOUBLE AS kappa,
    round(p, 6)::DOUBLE AS rate_a, round(q, 6)::DOUBLE AS rate_b, round(na, 6)::DOUBLE AS new_rate_a, round(nb, 6)::DOUBLE AS new_rate_b, situation_only, failure_only, in_both FROM k""")
def agreement_report(spark, sf_dir):
    r = agr.report(_raters(spark, sf_dir))
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("situation_agreement", "agreement", "kappa", "rate_a", "rate_b", "new_rate_a", "new_rate_b")), "situation_only", "failure_only", F.col("both").alias("in_both"))


@query(f"WITH {RATERS} SELECT DISTINCT sb AS situation FROM j WHERE sb NOT IN (SELECT sa FROM j)")
def only_in_second(spark, sf_dir):
    return agr.only_in(_raters(spark, sf_dir), "b")


@query(f"""WITH {TURNS}, t AS (SELECT *, (conv_id + turn) % 5 AS k, lag(lower(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS prior FROM turn_v),
c AS (SELECT conv_id AS id, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'caller'), '')) AS t, coalesce(bool_or(role = 'agent' AND lower(text) = prior), false) AS looped,
  coalesce(bool_or(k = 0 AND turn % 2 = 1), false) AS broke, any_value(conv_id % 7) AS o FROM t GROUP BY conv_id),
l AS (SELECT *, CASE {' '.join(f"WHEN {_any(k)} THEN '{s}'" for s, k in inputs.RULES.items())} ELSE 'unclassified' END AS situation FROM c)
SELECT id, situation, CASE situation WHEN 'unclassified' THEN 'Unclassified' WHEN 'billing' THEN 'Billing' WHEN 'delivery' THEN 'Delivery' WHEN 'account' THEN 'Account' ELSE 'General' END AS situation_label,
  situation NOT IN ('billing', 'general') AS is_new, looped OR broke OR o IN (5, 6) AS failed,
  CASE WHEN looped THEN 'the agent repeats a turn' WHEN broke THEN 'a tool call fails' WHEN o IN (5, 6) THEN 'the outcome is a failure of the agent' END AS mode, CASE situation WHEN 'unclassified' THEN 0.2 ELSE 0.55 END::DOUBLE AS confidence FROM l""")
def label_record(spark, sf_dir):
    made = lab.keyword_labels(inputs.conversations(spark, sf_dir), inputs.RULES, inputs.CONDITIONS, {}, ["billing", "general"])
    return made.select("id", "situation", "situation_label", "is_new", "failed", "mode", "confidence")
