"""A corpus pipeline over `documents`: language ID, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the last return the
columns of documents. run() writes each stage's rows to the shared folder and rereads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, languages, packing, suffixes
from tidemark.llm.common import numbered, removed, stored
from tidemark.llm.queries import TOKENIZER, table

#: A text is in one of the languages if that one is so many times as likely as the others on the average, however many there are.
ODDS = 9 / 7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages stay; a missing label is filled in. Texts without letters go.
    Without any label there is nothing to judge by, and all other texts stay."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))  # so that rows without a doc_id are sampled too
    model = languages.fit(docs.withColumn("_key", key), key="_key")
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = ODDS / (ODDS + (len(model.languages) - 1))
    judged = languages.predict(rows, model, keep=("row",)).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return judged.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else f"row.{c}" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates exactly one row stays: that of the smallest doc_id (rows without one come last, and a
    digest of the row decides between those of one doc_id)."""
    rows, odd = numbered(docs, "doc_id")
    found = jaccard.similar_components(rows, key="_row").select("_row", "component_id")
    rank = F.struct(F.lit(False).alias("none"), F.col("_row").alias("id"), F.lit(0).cast("bigint").alias("digest"))
    if odd is not None:
        of_odd = odd.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(*docs.columns).alias("digest")).alias("rank"))
        found, rank = found.join(of_odd, "_row", "left"), F.coalesce("rank", rank)
    found = found.withColumn("rank", rank)
    kept = found.groupBy("component_id").agg(F.min(F.struct("rank", "_row")).alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 and more that are met elsewhere are removed; documents of which nothing is left go."""
    rows, _ = numbered(docs, "doc_id")
    kept = suffixes.repeats(rows, key="_row", with_text=True).filter("kept <> ''").select("_row", F.col("kept").alias("text"))
    return rows.drop("text").join(kept, "_row").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents with their sequences of at most 1024 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("best_fit", best_fit)]
#: No stage can be written in SQL that ends on whole tables; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = ""
    for i, (_, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), path
        if i < len(STAGES) - 1:
            docs, path = stored(docs)
            removed(spark, before)
    return docs
