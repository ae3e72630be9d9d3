"""Job names and job versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prefix of jobs whose application name was not known in time.
UNKNOWN_PREFIX = "unknown."

JOB_NAME = r"^([^.]*)\.([^.]*)\.(.*)$"


def known_job(job: Column) -> Column:
    """Job name without the prefix of a late application name."""
    return F.when(
        F.startswith(job, F.lit(UNKNOWN_PREFIX)), F.substr(job, F.lit(len(UNKNOWN_PREFIX) + 1))
    ).otherwise(job)


def job_part(job: Column, part: int) -> Column:
    """Application (1), plan node (2) or output (3) of a job name; the empty string if it has no such part."""
    return F.regexp_extract(known_job(job), JOB_NAME, part)


def query_version(query: Column) -> Column:
    """Version of a job by its query text. Spacing outside quotes does not count, literals do."""
    pieces = F.transform(
        F.split(query, "'"),
        lambda piece, at: F.when(at % 2 == 0, F.regexp_replace(piece, "[ \\t\\n\\r\\f]+", " ")).otherwise(piece),
    )
    return F.sha2(F.btrim(F.array_join(pieces, "'")), 256)
