import glob
import importlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm import decontaminate, jaccard_join, queries, vector_packing
from rillwork.llm.common import shared_dir
from rillwork.llm.tokens import default_vocabulary


def test_stages(spark, small, edges, empty):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]
    for df in (edges, empty):
        own = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, small)
            assert own.schema.simpleString() == df.schema.simpleString()
            own = spark.createDataFrame(own.collect(), df.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, own, small)
        assert (last.count() == 0) == (df is empty)


@pytest.fixture
def exact_names(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


def test_columns_come_through(spark, small, edge_rows, edges, exact_names):
    """Further columns keep their values, one that differs from text by case only as well."""
    schema = T.StructType([*edges.schema.fields, T.StructField("Text", T.StringType())])
    rows = [(*r, "T") for r in edge_rows]
    df = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, df, small)
        assert kept.columns == df.columns
        for r in kept.collect():
            own = tuple(r)
            assert own[5:] in {x[5:] for x in rows if x[0] == own[0]}


def test_rows_that_share_an_id(spark, small):
    """Rows of one id are told apart by their texts; rows without one are judged too."""
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, a), (None, b), (None, c), (None, c), (3, c + " more"), (1, a), (None, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, small).collect()
    want = [(None, None), (1, a), (1, b), (3, c + " more"), (4, "")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
    rows = [(5, a), (5, item), (None, item), (None, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], df.schema)
    kept = corpus_pipeline.decontaminate_benchmark(spark, df, small).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, a), (None, b)], key=str)


def test_nothing_is_left_behind(spark, small):
    """What a run stages is gone when it ends, but for its result."""
    before = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/*"))
    rows = corpus_pipeline.run(spark, small)
    left = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/*")) - before
    assert len(left) == 1 and "pipeline-result" in left.pop() and rows.count()


def test_language_stage(spark, small, docs):
    kept = corpus_pipeline.identify_language(spark, docs, small)
    assert kept.count() == docs.count()
    none = spark.createDataFrame([(10**6, "123 456 ...", None, "s", 11), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.union(none), small)
    assert kept.filter(F.col("doc_id") >= 10**6).count() == 0 and kept.count() == docs.count()


def test_run(spark, small, docs):
    """Which documents are left, and what is packed, by hand from the operators' own results."""
    rows = corpus_pipeline.run(spark, small).collect()
    parts = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    first = docs.filter(F.col("doc_id").isin([i for i, c in parts.items() if i == c]))
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.find_leaks(first, bench).collect()}
    left = {i for i, c in parts.items() if i == c} - leaks
    assert {r.doc_id for r in rows} == left and leaks
    clean = corpus_pipeline.redact_secrets(spark, docs, small)
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == docs.filter(F.length("text") != F.col("n_chars")).count()
    again = vector_packing.pack_vectors(clean.filter(F.col("doc_id").isin(list(left))), default_vocabulary()).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert corpus_pipeline.ORACLE_SQL is None


def test_repeated_rows_leave_one(spark, small, edges):
    kept = corpus_pipeline.drop_near_duplicates(spark, edges, small)
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert None in ids and 9 in ids and 10 not in ids and 7 not in ids


def test_one_query_for_each_operator():
    for n in range(1, 11):
        assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in importlib.import_module("__spark_entry__").queries()


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_task_holds_one_python_worker(spark, small, edges):
    """Workers live on, so each one more that a task needs is memory for the whole run."""
    ids = spark.range(3).toDF("doc_id")
    own = edges.select("doc_id", "text")
    sets = jaccard_join.sorted_sets(own, ids)
    assert "ArrowEvalPython" not in plan_of(sets)
    assert {0, 1, 2} <= {r.doc_id for r in sets.collect()} <= {r[0] for r in own.collect()} - {None}
    # these need none but for the work itself: rows of the driver's go to the JVM as they are
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert "ExistingRDD" not in plan_of(decontaminate.find_leaks(spark.read.parquet(f"{small}/documents.parquet"), benchmark))
    packed = vector_packing.pack_vectors(spark.read.parquet(f"{small}/documents.parquet"), default_vocabulary())
    assert "ExistingRDD" not in plan_of(packed)
