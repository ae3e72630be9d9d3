"""The programs for ``spark-submit``, run in this process."""

from __future__ import annotations

import runpy
import sys

import pytest
from pyspark.sql import functions as F

from millrace.plans.questions import ask
from millrace.sources import facts


def run(monkeypatch, job, *arguments):
    monkeypatch.setattr(sys, "argv", [job, *map(str, arguments)])
    runpy.run_module(f"millrace.jobs.{job}", run_name="__main__")


def test_generate_and_aggregate(spark, monkeypatch, folder):
    run(monkeypatch, "generate", f"{folder}/raw", 1000)
    run(monkeypatch, "aggregate", f"{folder}/raw", f"{folder}/agg")
    assert spark.read.parquet(f"{folder}/agg").count() == 5


@pytest.mark.parametrize("arguments", [(50_000,), (50_000, "--slices", 2), (50_000, "--seed", 1)])
def test_pi(spark, monkeypatch, capsys, arguments):
    run(monkeypatch, "pi", *arguments)
    assert "|3.1" in capsys.readouterr().out


def test_mart(spark, monkeypatch, capsys, database):
    run(monkeypatch, "mart", database, "--generate", "--top", 2)
    assert spark.table(f"{database}.mart_top_countries").count() == 2


def test_flows_of_one_database(spark, monkeypatch, capsys, database, folder):
    run(monkeypatch, "flow", database, "stage", "--generate")
    assert spark.table(f"{database}.stg_customers_enriched").count() == 100
    run(monkeypatch, "flow", database, "stats")
    assert spark.table(f"{database}.agg_customer_stats").count() > 0
    run(monkeypatch, "flow", database, "enriched", "--modulus", 60)
    assert spark.table(f"{database}.customer_orders_enriched").count() == 500
    capsys.readouterr()
    run(monkeypatch, "flow", database, "schemas")
    assert capsys.readouterr().out.splitlines()[-1] == "id, full_name, country"
    run(monkeypatch, "flow", database, "summary")
    assert "100 100 100" in capsys.readouterr().out
    run(monkeypatch, "flow", database, "repeated", "--runs", 2)
    run(monkeypatch, "flow", database, "drift", "--path", f"{folder}/drift")
    assert spark.read.option("mergeSchema", "true").parquet(f"{folder}/drift").count() == 500
    with pytest.raises(SystemExit):
        run(monkeypatch, "flow", database, "drift")


def test_mart_by_batches(spark, monkeypatch, database):
    run(monkeypatch, "flow", database, "batches", "--generate")
    found = {r.country: r.orders_count for r in spark.table(f"{database}.mart_by_batches").collect()}
    totals = {r.country: r.orders for r in spark.table(f"{database}.raw_customers").alias("c").join(
        spark.table(f"{database}.raw_orders").alias("o"), F.col("c.id") == F.col("o.customer_id")
    ).groupBy("country").agg(F.count(F.lit(1)).alias("orders")).collect()}
    assert found == totals


def test_lineage_questions_of_fact_tables(spark, monkeypatch, folder, rows):
    def put(name, found):
        spark.createDataFrame(found, facts.TABLES[name]).write.parquet(f"{folder}/facts/{name}")

    put("dataset_edges", [("mart", "stage"), ("stage", "raw"), ("other", "raw")])
    put("job_versions", [("j", "1", "SELECT  a"), ("j", "2", "SELECT a"), ("j", "3", "SELECT b"), ("k", "1", None)])
    put("job_io", [("j", "1", "INPUT", "raw"), ("j", "1", "OUTPUT", "stage")])

    def asked(question, *more):
        run(monkeypatch, "lineage", f"{folder}/facts", question, f"{folder}/{question}", *more)
        return rows(spark.read.parquet(f"{folder}/{question}"))

    assert asked("upstream", "--start", "mart") == [("mart", "raw", 2), ("mart", "stage", 1)]
    assert asked("upstream", "--start", "mart", "--depth", 1) == [("mart", "stage", 1)]
    assert asked("downstream", "--start", "raw", "--depth", 1) == [("raw", "other", 1), ("raw", "stage", 1)]
    assert asked("lineage_graph", "--start", "raw") == [
        ("raw", "j", "JOB", "DOWNSTREAM", 1), ("raw", "stage", "DATASET", "DOWNSTREAM", 2),
    ]
    assert asked("levels") == [("mart", 2), ("other", 1), ("raw", 0), ("stage", 1)] and asked("cycles") == []
    assert asked("rerun_order", "--start", "stage") == [("mart", 2), ("stage", 1)]
    assert asked("versions_by_query") == [("j", 2, 3), ("k", 0, 1)]
    with pytest.raises(ValueError, match="given data sets"):
        ask(spark, f"{folder}/facts", "upstream")


def test_fact_tables_are_held_to_their_columns(spark):
    found = spark.sql("SELECT 1 AS more, 'raw' AS in_dataset, 'mart' AS out_dataset")
    assert facts.checked(found, "dataset_edges").columns == ["out_dataset", "in_dataset"]
    with pytest.raises(ValueError, match="out_dataset: missing, not string; in_dataset: int, not string"):
        facts.checked(spark.sql("SELECT 1 AS in_dataset"), "dataset_edges")
