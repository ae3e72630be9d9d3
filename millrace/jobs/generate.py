"""spark-submit millrace/jobs/generate.py PATH ROWS: write generated sales as parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.plans import flows

if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path")
    parser.add_argument("rows", type=int)
    arguments = parser.parse_args()
    flows.generate(SparkSession.builder.appName("generate_sales").getOrCreate(), arguments.path, arguments.rows)
