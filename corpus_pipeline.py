"""Documents to a training mix of token ids, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.llm import langid, linededup, mixing, pieces, simhash
from doctables.llm.work import apart, saved
from doctables.session import ship


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without one go.

    The text model is fitted on a bounded sample of each of the documents' own labels.
    Rows without id stay; an id goes only if none of its rows is accepted and none
    declares a language that the model has never seen.
    """
    ship(spark)
    model = langid.fit_text_model(docs)
    found = langid.identify_documents(docs, model)
    unseen = docs.filter(F.col("lang").isNotNull() & ~F.col("lang").cast("string").isin(model.labels)).select("doc_id")
    refused = saved(
        found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("accepted").alias("ok")).filter("not ok").select("doc_id")
        .join(unseen, "doc_id", "left_anti")
    )
    return docs.join(refused, "doc_id", "left_anti").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each group of near-equal lines; n_chars follows the text."""
    ship(spark)
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash group; rows without id stay.

    Repeated ids leave one row, that of least hash of text and then of the other columns.
    """
    ship(spark)
    groups = simhash.simhash_groups(docs)
    kept = saved(groups.filter("doc_id = component_id").select("doc_id").distinct())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(F.struct(*columns))))
    chosen = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), least).alias("row"))
    return chosen.select("row.*").union(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of one id equally often, as the most taken of them."""
    ship(spark)
    of_doc, times, copy = apart(docs, "id", "passes", "copy")
    passes = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(of_doc)).agg(F.max("passes").cast("int").alias(times))
    taken = saved(passes.filter(F.col(times) > 0))
    return docs.join(taken, docs["doc_id"].eqNullSafe(F.col(of_doc))).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(times)))
    ).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their SentencePiece ids."""
    ship(spark)
    return pieces.encode_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
