"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, embeddings, html_text, jaccard, languages, licenses, media, packing, suffixes, urls

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = (urls.Rule("net/", False), urls.Rule("example.net/en/", True), urls.Rule("example.com/de/", False), urls.Rule("org/fr/", True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the quality in `labels` of its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return urls.judged(table(spark, sf_dir, "pages"), outcomes, RULES)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = languages.fit(documents.filter("not held_out"))
    return languages.predict(documents, model, keep=("doc_id", "held_out"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_RULE = """CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""


def _level(name: str, units: str, mu: str) -> str:
    """CTEs that shrink the units (n, k, mu) of a level; see urls._shrunk."""
    return f"""
{name}_m AS (SELECT *, {mu} AS mu FROM {units}),
{name}_s AS (SELECT 1 / round(least(greatest(CASE WHEN sum(mu * (1 - mu) * (n - 1)) <> 0 THEN (sum(pow(k - n * mu, 2) / n) - sum(mu * (1 - mu))) / sum(mu * (1 - mu) * (n - 1)) ELSE 0.5 END, 0.001), 0.5), 9) - 1 AS m FROM {name}_m WHERE n > 0),
{name}_p AS (SELECT *, k + m * mu AS a, n - k + m * (1 - mu) AS b FROM {name}_m, {name}_s)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_reputation": f"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
l AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, regexp_extract(host, '[^.]*[.][^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM r LEFT JOIN l ON doc_id = page_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
{_level('s', 's', '(SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM h)')},
{_level('d', 'd', '(SELECT a / (a + b) FROM s_p WHERE s_p.suffix = d.suffix)')},
{_level('h', 'h', '(SELECT a / (a + b) FROM d_p WHERE d_p.domain = h.domain)')},
v AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h_p),
j AS (SELECT page_id, r.host, path, {_RULE.replace('host', 'r.host')} AS rule, bound FROM r LEFT JOIN v ON r.host = v.host)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END END AS verdict, round(bound, 6) AS bound FROM j""",
    }
