"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import ann, bpe, chat, decontaminate, html_text, language_id, line_dedup, near_dedup, token_counts, url_filter
from weirflow.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool calls, so that every user's turn is made one and the turn behind it its result."""
    return chat.format_chats(chat.question_calls(table(spark, sf_dir, "conversations")), chat.ANSWER)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the row of ``labels`` with their id; toxic or low quality counts as bad."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = language_id.identify(docs, language_id.train_profiles(docs), min_margin=language_id.MIN_MARGIN)
    return got.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["item_id"])))
    return got.select("doc_id", (F.size("found") > 0).alias("contaminated"), items.alias("item_ids"), F.array_min(F.transform("found", lambda f: f["edits"])).alias("least_edits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_token_counts, op3_chat_format, op4_line_dedup, op5_nearest, op6_near_dedup, op7_url_filter, op8_language_id, op9_html_text, op10_decontamination)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
own AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
said AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE toxic = 1 OR quality = 0 OR (toxic IS NOT NULL AND quality IS NOT NULL) GROUP BY doc_id),
named AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM own),
h0 AS (
  SELECT name, cast(coalesce(sum(n), 0) AS DOUBLE) AS n, cast(coalesce(sum(bad), 0) AS DOUBLE) AS bad, string_split(name, '.') AS l,
    regexp_matches(name, '^\\[.*\\]$|^[0-9]+(\\.[0-9]+){3}$') AS address
  FROM named LEFT JOIN said USING (page_id) GROUP BY name),
h1 AS (SELECT *, CASE WHEN len(l) > 1 AND regexp_matches(l[-1], '^[a-z][a-z]$') AND l[-2] IN (SECOND) THEN 2 ELSE 1 END AS k FROM h0),
h AS (
  SELECT name, n, bad, CASE WHEN address THEN '<address>' ELSE array_to_string(l[-k:], '.') END AS suffix,
    CASE WHEN address THEN name ELSE array_to_string(l[-(k + 1):], '.') END AS domain
  FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT 0 AS lv, n, bad FROM s UNION ALL SELECT 1, n, bad FROM d UNION ALL SELECT 2, n, bad FROM h),
m AS (SELECT lv, sum(n) AS t, sum(bad) AS b, sum(bad * bad / n) AS q, cast(count(*) AS DOUBLE) AS k, sum(n * n) AS nn FROM g WHERE n > 0 GROUP BY lv),
v AS (SELECT lv, b / t AS r, q - t * (b / t) * (b / t) - (k - 1) * (b / t) * (1 - b / t) AS spread, t - nn / t - (k - 1) AS room FROM m),
w AS (SELECT lv, r, greatest(2.0, least(200.0, CASE WHEN spread > 0 AND room > 0 THEN r * (1 - r) / (spread / room) - 1 ELSE 200.0 END)) AS w FROM v),
x AS (
  SELECT l.lv, coalesce(w.r, 0.0) AS r, coalesce(w.w, 200.0) AS w FROM (VALUES (0), (1), (2)) l(lv) LEFT JOIN w USING (lv)),
x0 AS (SELECT * FROM x WHERE lv = 0), x1 AS (SELECT * FROM x WHERE lv = 1), x2 AS (SELECT * FROM x WHERE lv = 2),
ps AS (SELECT suffix, (bad + x0.w * x0.r) / (n + x0.w) AS r1 FROM s, x0),
pd AS (SELECT domain, (bad + x1.w * r1) / (n + x1.w) AS r2 FROM d JOIN ps USING (suffix), x1),
ph AS (SELECT name, n, bad + x2.w * r2 AS a, n - bad + x2.w * (1 - r2) AS b FROM h JOIN pd USING (domain), x2),
post AS (
  SELECT name, n, a, b, exp((a + b) * ln(0.5) + lgamma(a + b) - lgamma(a + 1) - lgamma(b)) * (1 + list_sum(list_transform(range(4000),
    lambda i: exp(lgamma(a + b + i + 1) + lgamma(a + 1) - lgamma(a + b) - lgamma(a + i + 2) + (i + 1) * ln(0.5))))) AS below
  FROM (SELECT name, n, greatest(a, 1e-9) AS a, greatest(b, 1e-9) AS b FROM ph)),
rep AS (SELECT name, cast(n AS BIGINT) AS n_labelled, a / (a + b) AS bad_rate, 1 - below AS bad_odds FROM post),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
pairs AS (SELECT DISTINCT host, path FROM own),
fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, own.host AS host, own.path AS path, fit.rule AS rule,
  coalesce(fit.action, CASE WHEN bad_odds > 0.95 THEN 'block' ELSE 'allow' END) AS verdict,
  n_labelled, round(bad_rate, 6) AS bad_rate, round(bad_odds, 6) AS bad_odds
FROM named AS own LEFT JOIN fit ON own.host = fit.host AND own.path = fit.path JOIN rep ON own.name = rep.name
""".replace("SECOND", ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL))


def oracle_sql() -> dict[str, str]:
    own = {"op3_chat_format": chat.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op7_url_filter": OP7_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
