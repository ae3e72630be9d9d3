"""spark-submit millrace/jobs/mart.py DATABASE [--generate] [--top K]: the country mart of a database.

Reads ``raw_customers`` and ``raw_orders`` of the database; ``--generate`` writes them first.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.plans import flows

if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("database")
    parser.add_argument("--generate", action="store_true")
    parser.add_argument("--top", type=int, default=3)
    arguments = parser.parse_args()
    session = SparkSession.builder.appName("country_mart").getOrCreate()
    session.sql(f"CREATE DATABASE IF NOT EXISTS {arguments.database}")
    if arguments.generate:
        flows.load_generated(session, arguments.database)
    flows.country_mart(session, arguments.database, arguments.top).show()
