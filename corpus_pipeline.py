"""The corpus pipeline: five stages over ``documents``, each reading what the
one before it wrote.

Every stage works on all rows that its predecessor kept. All but the last
return the columns of ``documents``, and any others that came with them;
n_chars follows the text. Rows with a null text, or one without a letter, go in the
first stage. Of rows that repeat id and text one stays, whatever their other
columns hold; a null id is smaller than any other and stands for itself. An
empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.llm.common import remainder, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learnt language; those without text or without
    any letter (``und``) go."""
    from galvanite.llm.language_id import predict, train

    learnt = docs.where(F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False)))
    found = predict(docs, train(learnt), carry=docs.columns)
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    from galvanite.llm.exact_dedup import exact_dedup

    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    named = docs.withColumn("_own", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    return found.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word
    shingles, similarity 0.8 or more, the smallest doc_id."""
    from galvanite.llm.near_dedup import near_dedup

    named = docs.withColumn("_own", F.sha2("text", 256))
    gone = near_dedup(named, carry=["_own"]).where(~F.col("kept")).select("doc_id", "_own").distinct()
    return named.join(gone, ["doc_id", "_own"], "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words covered by 20-word windows that also start earlier. A
    document that loses all its words goes."""
    from galvanite.llm.substring_dedup import substring_dedup

    cut = substring_dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    return cut.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    from galvanite.llm.queries import packed

    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language),
    ("exact dedup", exact),
    ("minhash near dedup", near),
    ("substring dedup", substrings),
    ("packing", packing),
]
#: SQL can express neither the language model nor the tokens; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
