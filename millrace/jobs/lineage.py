"""spark-submit millrace/jobs/lineage.py FACTS QUESTION OUTPUT [--start DATASET ...] [--depth N]: ask fact tables.

FACTS is a folder with a parquet table for each kind of fact that the question needs, OUTPUT the
folder of the answer. Questions from given data sets need ``--start``; a depth is the most hops.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.plans.questions import FROM_STARTS, QUESTIONS, ask

if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("facts")
    parser.add_argument("question", choices=[*QUESTIONS, *FROM_STARTS])
    parser.add_argument("output")
    parser.add_argument("--start", nargs="+")
    parser.add_argument("--depth", type=int)
    arguments = parser.parse_args()
    session = SparkSession.builder.appName("lineage").getOrCreate()
    found = ask(session, arguments.facts, arguments.question, arguments.start, arguments.depth)
    found.write.mode("overwrite").parquet(arguments.output)
