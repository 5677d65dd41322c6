"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import DIGITS, SEED
from .quality_rules import ALPHA, COST, DELTA, LEVELS
from .url_rules import CONFIDENCE, LEAST, LIFT, RULES, SOURCES, SUPPORT

#: Blank characters as a regular-expression class body (space, TAB to CR).
_B = r"\x20\x09-\x0D"


def words(text: str) -> str:
    return rf"regexp_extract_all(coalesce({text}, ''), '[^{_B}]+')"


_OP9 = rf"""
WITH slim AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len({words("text")}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, {DIGITS}) AS BIGINT) AS key
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM slim GROUP BY source),
fill AS (
  SELECT *, 2 * source_size AS cap,
         (SELECT sum(source_size) FROM per_source) * 1.5::DOUBLE
           - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         (SELECT sum(weight) FROM per_source)
           - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM per_source),
levels AS (SELECT arg_min(rest / open_weight, cap / weight::DOUBLE) AS level FROM fill WHERE cap > rest / open_weight * weight),
target AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM fill, levels),
placed AS (
  SELECT s.*, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM slim s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST(epochs * size + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - start, 0), size) AS BIGINT) AS taken
FROM taken
"""


def _op1() -> str:
    rules = {"symbols": "n_symbols / greatest(word_chars, 1)::DOUBLE", "dup_lines": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeats": "n_repeat_words / greatest(n_words, 1)::DOUBLE", "word_length": "word_chars / greatest(n_words, 1)::DOUBLE"}
    columns = ", ".join(f"c_{r}" for r in rules)
    cutoffs = ", ".join(f"({j}, {', '.join(f'{LEVELS[r][j]}::DOUBLE' for r in rules)})" for j in range(len(LEVELS["symbols"])))
    above = " OR ".join(f"{x} > c_{r}" for r, x in rules.items())
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, 'unknown') AS stratum, coalesce(text, '') AS text, {words("text")} AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_B}]')) AS l FROM w),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twins AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twins, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, stratum, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[{_B}]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
labelled AS (SELECT f.*, y.quality FROM failed f JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) y USING (doc_id) WHERE NOT base_failed),
levels AS (SELECT * FROM (VALUES {cutoffs}) v(j, {columns})),
counts AS (
  SELECT stratum, j, sum(quality) AS n, count(*) FILTER (WHERE quality = 1 AND ({above})) AS k, count(*) FILTER (WHERE quality = 0 AND ({above})) AS bad
  FROM labelled, levels GROUP BY ALL),
least AS (SELECT ln({DELTA} / count(*)) AS least FROM (SELECT DISTINCT stratum FROM counts)),
certified AS (
  SELECT stratum, j, bad - {COST} * k AS gain FROM counts, least
  WHERE bad > {COST} * k AND k <= n * {ALPHA!r}
    AND ln(list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA!r}) + (n - i) * ln(1 - {ALPHA!r}))))) <= least),
best AS (SELECT stratum, j FROM certified QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, j) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({above}, false) AS kept
FROM failed m LEFT JOIN best USING (stratum) LEFT JOIN levels USING (j)
"""


_OP5 = rf"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[{_B}]+', ''), '[{_B}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN owners o USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _op6() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules AS (SELECT * FROM (VALUES {rules}) r(name, start, verdict)),
fits AS (
  SELECT DISTINCT ON (host, path) host, path, name || start AS rule, verdict FROM (SELECT DISTINCT host, path FROM split) JOIN rules
  ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) ORDER BY host, path, length(name || start) DESC),
parts AS (
  SELECT s.*, f.rule, f.verdict, list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')) AS labels,
         string_split(regexp_extract(path, '^/(.*)/', 1), '/') AS dirs, regexp_extract(path, '([^/]*)$', 1) AS file,
         string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&') AS query
  FROM split s LEFT JOIN fits f USING (host, path)),
sets AS (
  SELECT page_id, host, path, rule, verdict, CAST(substr(md5(url), 1, 1) >= '8' AS INT) AS fold, list_sort(list_distinct(list_transform(labels, lambda x, i: 'h' || i || '=' || x)
    || list_transform(list_filter(flatten(list_transform(labels, lambda x: CASE WHEN contains(x, '-') THEN string_split(x, '-') ELSE [] END)), lambda w: w <> ''), lambda w: 'word=' || w)
    || list_filter(list_transform(dirs, lambda x, i: CASE WHEN x <> '' THEN 'dir' || i || '=' || x END), lambda x: x IS NOT NULL)
    || list_transform(regexp_extract_all(lower(regexp_replace(file, '\.[A-Za-z0-9]{{1,5}}$', '')), '[a-z]{{2,}}'), lambda x: 'file=' || x)
    || list_transform(list_filter([regexp_extract(file, '\.([A-Za-z0-9]{{1,5}})$', 1)], lambda x: x <> ''), lambda x: 'end=' || x)
    || list_transform(list_filter(list_transform(query, lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> ''), lambda x: 'key=' || x))) AS t
  FROM parts),
subsets AS (
  SELECT page_id, rule, verdict, fold, list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items
  FROM (SELECT page_id, rule, verdict, fold, t, unnest(range(1, 1 << len(t))) AS m FROM sets)),
n AS (SELECT count(*) FILTER (WHERE fold = 0) AS n, avg(CAST(verdict = 'block' AS INT)) FILTER (WHERE fold = 1) AS share FROM sets WHERE verdict IS NOT NULL AND len(t) > 0),
counted AS (
  SELECT items, count(*) FILTER (WHERE fold = 0) AS n0, count(*) FILTER (WHERE fold = 0 AND verdict = 'block') AS b0, count(*) FILTER (WHERE fold = 1) AS n1,
         count(*) FILTER (WHERE fold = 1 AND verdict = 'block') AS b1, count(DISTINCT rule) FILTER (WHERE verdict = 'block') AS sources
  FROM subsets WHERE verdict IS NOT NULL GROUP BY items),
mined AS (
  SELECT items FROM counted, n WHERE b0 >= greatest(ceil({SUPPORT} * n), {LEAST}) AND n0 > 0 AND n1 > 0 AND b0 / n0::DOUBLE >= {CONFIDENCE}
    AND b1 / n1::DOUBLE >= {CONFIDENCE} AND b1 / n1::DOUBLE >= {LIFT} * share AND sources >= {SOURCES}),
blocked AS (SELECT DISTINCT page_id FROM subsets JOIN mined USING (items))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN page_id IN (SELECT page_id FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM sets
"""


_OP2 = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"

ORACLES = {"op1_quality_rules": _op1(), "op2_sharding": _OP2, "op5_line_dedup": _OP5, "op6_url_rules": _op6(), "op9_mixing": _OP9}
