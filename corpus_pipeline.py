"""The corpus pipeline: five operators of rillwork.llm in turn, from documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of documents as they came.

A row is known within a stage by a hash of its doc_id and text (64 bits), so that
rows that share a doc_id are told apart by their texts, and rows without one are
judged like all others.

Cases: rows that repeat both doc_id and text leave one row; documents without
words have no near copies and no leaks; an empty table passes through; further
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import decontaminate, jaccard_join, language_id, secret_scan, vector_packing
from rillwork.llm.common import fresh_path, may_hold, numbered, pick, place_of, remove, scratch, settle, table
from rillwork.llm.tokens import default_vocabulary

#: Probability below which a language counts as not identified.
LEAST_SCORE = 0.5


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that stands for a row of ``docs``, whose columns are named as ``numbered`` names them."""
    return F.xxhash64(f"c{place_of(docs, doc_id)}", f"c{place_of(docs, text)}")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as the operators take them, with the row's key as its id."""
    own = pick(docs, "doc_id", "text")
    return own.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` but for rows whose key is in ``gone`` (one column); of rows of a key in ``repeated`` one stays.

    Only rows that a Bloom filter of fixed size takes for such ones move to the joins that decide.
    """
    gone = settle(gone.toDF("gone").distinct(), "dropped")
    named = gone if repeated is None else gone.union(repeated)
    plain, key = numbered(docs), row_key(docs)
    some = may_hold(named)(key)
    left = plain.filter(some).withColumn("key", key).join(gone, F.col("key") == F.col("gone"), "left_anti")
    if repeated is not None:
        left = left.dropDuplicates(["key"])
    return plain.filter(~some).unionByName(left.drop("key")).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of one that the model is not sure of, go."""
    plain = numbered(docs)
    found = language_id.identify(
        plain.withColumnRenamed(f"c{place_of(docs, 'text')}", "text"), language_id.train(docs), into=("lang_pred", "lang_score")
    )
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)
    return found.filter(sure).drop("lang_pred", "lang_score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays, and of rows that repeat id and text, one."""
    rows = keyed(docs)
    # a component is named after a key; the row that stays is the one with the smallest doc_id, null last
    parts = jaccard_join.jaccard_components(rows).filter("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct()
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"))
    named = settle(own.distinct().join(parts, "key"), "named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stays = settle(named.groupBy("component_id").agg(F.min(order)["key"].alias("stays")), "stays")
    again = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    return without(docs, named.join(stays, "component_id").filter("key <> stays").select("key"), settle(again, "repeated"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    leaks = decontaminate.find_leaks(keyed(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select("doc_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced by a mark; n_chars follows the text."""
    text = f"c{place_of(docs, 'text')}"
    found = secret_scan.scan(numbered(docs).withColumnRenamed(text, "text"), into="spans")
    clean = F.when(F.size("spans") > 0, secret_scan.redacted(F.col("text"), F.col("spans")))
    found = found.withColumn("clean", clean)
    changed = {text: F.coalesce("clean", "text")}
    if "n_chars" in docs.columns:
        place = place_of(docs, "n_chars")
        changed[f"c{place}"] = F.coalesce(F.length("clean").cast(docs.schema[place].dataType), f"c{place}")
    names = [f"c{k}" for k in range(len(docs.columns))]
    return found.select(*[changed.get(c, F.col(c)).alias(c) for c in names]).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    return vector_packing.pack_vectors(docs, default_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the tokenizer and the packing cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's table is removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    with scratch(spark, "pipeline") as result:
        for name, stage in STAGES[:-1]:
            path = fresh_path(spark, f"pipeline-{name}")
            docs = settle(stage(spark, docs, sf_dir), name, path)
            if before:
                remove(spark, before)
            before = path
        return result(STAGES[-1][1](spark, docs, sf_dir))
