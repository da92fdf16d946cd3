"""The pipeline over a given table, stage by stage, and every query against its SQL."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
import __spark_entry__ as contract  # noqa: E402
from velomart.llm import quality, registry  # noqa: E402
from velomart.llm.common import stage  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = stage(apply(spark, docs, SF), name)
        assert docs.columns == columns
        now = Counter(r.doc_id for r in docs.collect())
        assert set(now) <= seen and max(now.values()) == 1
        assert 0.5 * len(seen) < len(now)
        seen = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == seen


def test_run_and_no_documents(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_with_odd_rows_and_clashing_names(spark):
    """Null and empty texts, repeated rows, and columns that stages use names of: kept rows come back as they were."""
    names = ["score", "predicted", "kept", "n_words", "measures", "row", "failed_rules", "text_key", "class_id", "bands", "key"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("text", F.lit("")))
    docs = docs.unionByName(docs.limit(5).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    docs = stage(docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names]), "odd")
    own = Counter(map(tuple, docs.collect()))
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = stage(apply(spark, docs, SF), name)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = Counter(map(tuple, after.collect()))
        assert rows and all(n <= own[r] for r, n in rows.items())
        if name != "near_dedup":  # equal rows are judged alike
            before = Counter(map(tuple, docs.collect()))
            assert all(n == before[r] for r, n in rows.items())
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_passing_is_judged_and_splits_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("measures", F.lit(1))
    found = quality.passing(docs)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, quality.judged(docs).where("kept").select(docs.columns).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("xxhash64") <= 2


def test_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(any(q.startswith(n) for q in registry.all_queries()) for n in names)
    assert {"pipeline", *registry.all_queries()} <= set(contract.queries())
    assert set(registry.all_sql()) <= set(registry.all_queries())


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.all_sql()[name])
    columns = [d[0] for d in found.description]
    mine = registry.all_queries()[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    assert Counter(map(tuple, mine.select(columns).collect())) == Counter(found.fetchall())
