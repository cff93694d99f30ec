"""SQL for queries whose operators a relational plan can state, for tables of any size a single node can sort.

Each reads whole tables. Rows are told apart by a number, as ids may be null or repeated.
"""

import re

from .license_scan import BASE, TEMPLATES
from .quality_rules import BIT, LATEST, POLICIES, RULES
from .quality_rules import BASE as BASE_BITS

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 2**63 - 1
NUMBERED = "SELECT row_number() OVER () AS r, * FROM {}"

#: Links by all pairs within a label, components by walking from each vector.
OP1 = f"""
WITH RECURSIVE rows_of AS MATERIALIZED ({NUMBERED.format("embeddings")}),
finite AS (
  SELECT r, label, len(embedding) AS n, CAST(embedding AS DOUBLE[]) AS v FROM rows_of
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scaled AS MATERIALIZED (
  SELECT r, label, n, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM finite),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM scaled a JOIN scaled b ON a.label = b.label AND a.n = b.n AND a.r <> b.r
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
reached AS (
  SELECT a AS r, a AS at FROM links UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.at),
least AS (
  SELECT reached.r, min(coalesce(rows_of.vec_id, {NO_ID})) AS least FROM reached JOIN rows_of ON rows_of.r = reached.at GROUP BY reached.r),
counted AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, nullif(coalesce(least, vec_id, {NO_ID}), {NO_ID}) AS component_id,
       coalesce(vec_id = coalesce(least, vec_id), false) AS kept
FROM rows_of LEFT JOIN least USING (r) LEFT JOIN counted USING (r)
"""

#: Every 200-byte string is counted; removed runs are unions of the strings found twice.
OP2 = f"""
WITH d AS MATERIALIZED (SELECT r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM ({NUMBERED.format("documents")})),
windows AS (SELECT r, i, md5(b[i:i + 199]) AS k FROM (SELECT r, b, unnest(range(1, n - 198)) AS i FROM d)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM windows SEMI JOIN twice USING (k)),
numbered AS (SELECT r, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM gone),
spans AS MATERIALIZED (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY r, span),
edges AS (SELECT r, lo, hi FROM spans UNION ALL SELECT r, n + 1, n + 1 FROM d),
gaps AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo, hi), 1) AS since FROM edges),
kept AS (
  SELECT r, string_agg(CASE WHEN lo > since THEN hex(b[since:lo - 1]) ELSE '' END, '' ORDER BY lo, since) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r),
removed AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

#: The smallest document of every window of 13 words decides.
OP3 = f"""
WITH d AS MATERIALIZED (
  SELECT r, doc_id, coalesce(doc_id, {NO_ID}) AS place, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM ({NUMBERED.format("documents")})),
windows AS (SELECT r, place, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, place, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first_of AS (SELECT k, min(place) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM windows JOIN first_of USING (k) WHERE least < place),
each_word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (
  SELECT r, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone.j IS NULL) AS kept
  FROM each_word LEFT JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def failed_bits() -> str:
    return " | ".join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES)


#: Every measure by regular expressions and lists.
OP5 = f"""
WITH d AS MATERIALIZED (
  SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM (SELECT r, doc_id, coalesce(text, '') AS t FROM ({NUMBERED.format("documents")}))),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM windows JOIN twice USING (r, k)) GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS n_letter_words,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*(?:[-*] |•)'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
         len(regexp_extract_all(t, '\\x{{FFFD}}')) AS n_bad_chars
  FROM d LEFT JOIN repeated USING (r)),
judged AS (SELECT *, CAST({failed_bits()} AS BIGINT) AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {BASE_BITS} <> 0 AS base_failed,
       failed & {POLICIES[LATEST]} = 0 AS kept, failed
FROM judged
"""


def expression(template: str) -> str:
    """A template's markup as a regular expression over words that each end with a space.

    Words that must not follow are marked by a ! before them in the text that is matched.
    """
    out = ""
    ending = re.search(r"\{\{not ([^}]+)\}\}\s*$", template)
    for t in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\||[^\s\[\]{}|]+", template[: ending.start()] if ending else template):
        if t[0] == "{":
            out += "(?:[^ ]+ ){%s}" % t[2:-2].replace("-", ",")
        else:
            out += {"[[": "(?:", "]]": ")?", "|": "|"}.get(t, f"{t} ")
    return f"(?:^| ){out}" + ("(?:[^!]|$)" if ending else "")


def matched(template: str) -> str:
    ending = re.search(r"\{\{not ([^}]+)\}\}\s*$", template)
    text = "s"
    for word in ending[1].split() if ending else ():
        text = f"regexp_replace({text}, '(^| )({word} )', '\\1!\\2', 'g')"
    return f"regexp_matches({text}, '{expression(template)}')"


def phrase_places(phrase: str) -> str:
    words = phrase.split()
    return f"list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(words)}] = {words!r})"


#: Templates as regular expressions, base phrases by comparing words at every place.
OP8 = rf"""
WITH d AS MATERIALIZED (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM ({NUMBERED.format("documents")})),
spaced AS (SELECT *, array_to_string(w, ' ') || CASE WHEN len(w) > 0 THEN ' ' ELSE '' END AS s FROM d),
found AS (
  SELECT doc_id, len(w) AS n, list_concat({", ".join(phrase_places(p) for p in BASE)}) AS places,
         list_filter([{", ".join(f"CASE WHEN len({phrase_places(p)}) > 0 THEN '{label}' END" for p, label in BASE.items())}], lambda x: x IS NOT NULL) AS base,
         list_filter([{", ".join(f"CASE WHEN {matched(t)} THEN '{label}' END" for label, t in TEMPLATES)}], lambda x: x IS NOT NULL) AS more
  FROM spaced)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
       CAST(list_max(places) AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
       1 - pow(0.5, len(more) + CASE WHEN len(base) > 0 THEN 1 ELSE 0 END) AS score
FROM found
"""

ORACLE = {
    "op1_cover_tree_dedup": OP1,
    "op2_suffix_dedup": OP2,
    "op3_substring_dedup": OP3,
    "op5_quality_rules": OP5,
    "op8_license_templates": OP8,
}
