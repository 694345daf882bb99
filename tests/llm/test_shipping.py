import os
import subprocess
import sys

import rillwork


def test_operators_reach_workers_that_lack_the_package(tmp_path):
    """In a process whose workers can't import the package by themselves."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(rillwork.__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import corpus_pipeline
from rillwork.llm import queries
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
assert corpus_pipeline.identify_language(spark, docs, "/root/testdata/sf0.001").count() == docs.count()
for name in ("op6_language_id", "op8_warc", "op9_decontamination"):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count(), name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=400)
