"""spark-submit millrace/jobs/aggregate.py SOURCE TARGET: totals by region as parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.plans import flows

if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    arguments = parser.parse_args()
    flows.aggregate(SparkSession.builder.appName("aggregate_sales").getOrCreate(), arguments.source, arguments.target)
