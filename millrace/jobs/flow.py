"""spark-submit millrace/jobs/flow.py DATABASE FLOW [--generate] [--runs N] [--modulus N] [--path FOLDER --second ID --third ID]

Run one flow over the raw tables of a database; ``--generate`` writes these first. Flows:

stage      two staging tables of customers          enriched   wide table of orders, customers and products
stats      metrics of every customer                schemas    one table in three schemas
summary    one target by three queries              repeated   one query, written ``--runs`` times
drift      three batches of events with three schemas in ``--path``, cut at two order ids, and their null profile
batches    the country mart, merged batch by batch (the same cuts)
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import money
from millrace.operators import marts, measures
from millrace.operators import orders as order_ops
from millrace.plans import flows, staging


def drift(spark: SparkSession, database: str, path: str, second: int, third: int) -> DataFrame:
    raw = spark.table(f"{database}.raw_orders"), spark.table(f"{database}.raw_customers")
    return measures.null_profile(flows.append_batches(staging.drift_batches(*raw, second, third), path))


def batches(spark: SparkSession, database: str, second: int, third: int) -> DataFrame:
    orders = spark.table(f"{database}.raw_orders").withColumn("amount", money(F.col("amount")))
    wide, key, kept = order_ops.with_customer(orders, spark.table(f"{database}.raw_customers")), F.col("order_id"), None
    for batch in (key < second, key.between(second, third - 1), key >= third):
        kept = marts.merged_mart(wide.where(batch), "country", kept)
    return flows.overwrite_table(marts.mart(kept, "country"), f"{database}.mart_by_batches")


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("database")
    parser.add_argument(
        "flow", choices=["stage", "stats", "enriched", "schemas", "summary", "repeated", "drift", "batches"]
    )
    parser.add_argument("--generate", action="store_true")
    parser.add_argument("--runs", type=int, default=5)
    parser.add_argument("--modulus", type=int, default=60)
    parser.add_argument("--path")
    parser.add_argument("--second", type=int, default=200)
    parser.add_argument("--third", type=int, default=400)
    given = parser.parse_args()
    if given.flow == "drift" and not given.path:
        parser.error("drift needs --path")
    session = SparkSession.builder.appName(f"flow_{given.flow}").getOrCreate()
    session.sql(f"CREATE DATABASE IF NOT EXISTS {given.database}")
    if given.generate:
        flows.load_generated(session, given.database)
    if given.flow == "stage":
        for staged in flows.stage_customers(session, given.database):
            staged.show()
    elif given.flow == "stats":
        flows.customer_stats(session, given.database).show()
    elif given.flow == "enriched":
        flows.enriched_orders(session, given.database, given.modulus).show()
    elif given.flow == "schemas":
        for fields in flows.schema_history(session, given.database):
            print(", ".join(fields))
    elif given.flow == "summary":
        flows.customer_stats(session, given.database)
        print(*flows.summary_versions(session, given.database))
    elif given.flow == "repeated":
        flows.repeated_totals(session, given.database, given.runs).show()
    elif given.flow == "drift":
        drift(session, given.database, given.path, given.second, given.third).show()
    else:
        batches(session, given.database, given.second, given.third).show()
