"""spark-submit millrace/jobs/pi.py [POINTS] [--seed SEED] [--slices SLICES]: estimate pi.

Points follow a fixed sequence; with a seed they are drawn at random.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.operators.measures import circle_estimate

if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("points", type=int, nargs="?", default=100_000)
    parser.add_argument("--seed", type=int)
    parser.add_argument("--slices", type=int)
    arguments = parser.parse_args()
    session = SparkSession.builder.appName("estimate_pi").getOrCreate()
    circle_estimate(session, arguments.points, arguments.slices, arguments.seed).show()
