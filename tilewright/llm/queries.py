"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, html_text, id_store, language_id, near_dedup, packing, quality_rules, suffix_dedup, token_counts, url_filters
from tilewright.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def _rule_sql(r: quality_rules.Rule) -> str:
    sides = [f"{r.numerator} * 100 >= {r.denominator} * {r.low}"] * (r.low is not None) + [f"{r.numerator} * 100 <= {r.denominator} * {r.high}"] * (r.high is not None)
    return f"(n_words < {r.from_words} OR ({' AND '.join(sides)}))"


_WS = r"[\x20\x09-\x0D]"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, [x for x in regexp_split_to_array(t, '{_WS}+') if x <> ''] AS words,
             [x for x in string_split(t, chr(10)) if regexp_replace(x, '{_WS}', '', 'g') <> ''] AS lines FROM d),
wins AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len([x for x in words if lower(x) IN ({_STOPS})]) AS BIGINT) AS n_stop_words,
             CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts
      FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(map(_rule_sql, quality_rules.RULES))} AS kept
FROM m
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return decontaminate.overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(documents(spark, sf_dir, "pages"))


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = id_store.write(documents(spark, sf_dir), id_store.new_root(spark))
    return id_store.digest_rows(spark, root)


def _day(text: Column, first: int = 1) -> Column:
    """A day of the year that a text stands for."""
    return (F.conv(F.substring(F.md5(text), first, 4), 16, 10).cast("int") % 366).cast("int")


def url_events(pages: DataFrame) -> DataFrame:
    """Three dated lists over everything that the pages link to: hosts blocked for 30 days, sites blocked, allowed and removed, and one verdict for each path."""
    url = F.col("url")
    hosts = pages.select(url_filters.host(url).alias("h")).where("h <> ''").distinct()
    sites = hosts.select(F.regexp_replace("h", r"^[^.]*\.", "").alias("s")).where("s <> ''").distinct()
    paths = pages.select(F.element_at(url_filters.keys(url), -1).alias("p")).where("p LIKE '%/%'").distinct()
    row = lambda name, pattern, action, at: F.struct(F.lit(name).alias("list"), F.col(pattern).alias("pattern"), action.alias("action"), at.cast("int").alias("at"))
    block, allow, remove = map(F.lit, ("block", "allow", "remove"))
    h, s, p = _day(F.col("h")), _day(F.col("s")), _day(F.col("p"))
    logs = (
        hosts.select(F.inline(F.array(row("hosts", "h", block, h), row("hosts", "h", remove, h + 30)))),
        sites.select(F.inline(F.array(row("sites", "s", block, s), row("sites", "s", allow, s + 20), row("sites", "s", remove, s + 90)))),
        paths.select(F.inline(F.array(row("paths", "p", F.when(_day(F.col("p"), 5) < 183, block).otherwise(allow), p)))),
    )
    return logs[0].unionByName(logs[1]).unionByName(logs[2])


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures, against dated lists of all their hosts, sites and paths; the day of a capture is fixed by its id."""
    pages = documents(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int").alias("fetched_at"))
    return url_filters.evaluate(captures, url_events(pages))


_DAY = "(('0x' || substr(md5({0}), {1}, 4))::BIGINT % 366)"
OP9_SQL = rf"""
WITH captures AS (
  SELECT page_id, url, CAST((page_id * 37) % 366 AS INT) AS fetched_at,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
places AS (SELECT *, host || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS place FROM captures),
hosts AS (SELECT DISTINCT host AS p FROM places WHERE host <> ''),
sites AS (SELECT DISTINCT regexp_replace(p, '^[^.]*\.', '') AS p FROM hosts WHERE p LIKE '%.%' AND p NOT LIKE '%.' UNION SELECT p FROM hosts WHERE p NOT LIKE '%.%'),
paths AS (SELECT DISTINCT place AS p FROM places WHERE place LIKE '%/%'),
events(list_name, pattern, action, on_day) AS (
  SELECT 'hosts', p, unnest(['block', 'remove']), {_DAY.format("p", 1)} + unnest([0, 30]) FROM hosts
  UNION ALL SELECT 'sites', p, unnest(['block', 'allow', 'remove']), {_DAY.format("p", 1)} + unnest([0, 20, 90]) FROM sites
  UNION ALL SELECT 'paths', p, CASE WHEN {_DAY.format("p", 5)} < 183 THEN 'block' ELSE 'allow' END, {_DAY.format("p", 1)} FROM paths),
valid AS (
  SELECT * FROM (SELECT list_name, pattern, action, on_day AS valid_from, lead(on_day) OVER (PARTITION BY list_name, pattern ORDER BY on_day) AS valid_to FROM events)
  WHERE action <> 'remove'),
hits AS (
  SELECT c.page_id, c.url, c.fetched_at, v.pattern, v.action,
         row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at ORDER BY length(v.pattern) DESC, v.action DESC, v.pattern DESC) AS nth,
         count(*) OVER (PARTITION BY c.page_id, c.url, c.fetched_at) AS n
  FROM (SELECT DISTINCT * FROM places) c JOIN valid v
    ON (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern) OR contains(v.pattern, '/') AND starts_with(c.place || '/', v.pattern || '/'))
   AND c.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to))
SELECT c.page_id, c.url, coalesce(h.n, 0) AS n_matches, h.pattern, h.action, coalesce(h.action <> 'block', TRUE) AS kept
FROM captures c LEFT JOIN hits h ON h.page_id IS NOT DISTINCT FROM c.page_id AND h.url = c.url AND h.fetched_at = c.fetched_at AND h.nth = 1
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs)
    return language_id.predict(docs.withColumn("held_out", language_id.held_out()), model, keep=("doc_id", "held_out"))


def queries() -> dict:
    found = (op1_suffix_dedup, op2_token_counts, op3_near_dedup, op4_quality_rules, op5_best_fit_packing, op6_decontamination, op7_html_extraction, op8_id_store, op9_url_filters, op10_language_id)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op9_url_filters": OP9_SQL}
