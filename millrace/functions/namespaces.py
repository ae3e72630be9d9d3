"""Data set namespaces: normalise, judge and split them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a stored namespace may look like.
LEGAL_CHARACTERS = "a-zA-Z0-9_@+:;=/.-"
MAX_LENGTH = 1024
HOST_SEPARATOR = "+"

# scheme with "://" | authority up to the first "/" | rest
URI = r"(?s)^(.*?://)([^/]*)(.*)$"

_BLANKS = "".join(chr(code) for code in range(33))


def normalise_namespace(namespace: Column, separator: str | None = HOST_SEPARATOR) -> Column:
    """Legal, host-order-independent form of a namespace. NULL and the empty string stay as they are."""
    authority = F.regexp_extract(namespace, URI, 2)
    hosts = F.filter(
        F.transform(F.split(authority, ","), lambda host: F.btrim(host, F.lit(_BLANKS))),
        lambda host: host != "",
    )
    one_authority = F.concat(
        F.regexp_extract(namespace, URI, 1),
        F.array_join(F.array_sort(hosts), separator or HOST_SEPARATOR),
        F.regexp_extract(namespace, URI, 3),
    )
    collapsed = F.when(F.contains(authority, F.lit(",")), one_authority).otherwise(namespace)
    return F.substring(F.regexp_replace(collapsed, f"[^{LEGAL_CHARACTERS}]", "_"), 1, MAX_LENGTH)


def namespace_fault(namespace: Column) -> Column:
    """Why a namespace cannot be stored: ``missing``, ``empty``, ``illegal`` or ``long``; NULL if it can."""
    return (
        F.when(namespace.isNull(), "missing")
        .when(namespace == "", "empty")
        .when(~namespace.rlike(f"^[{LEGAL_CHARACTERS}]+\\z"), "illegal")
        .when(F.length(namespace) > MAX_LENGTH, "long")
    )


def dataset_namespace(location: Column, job_namespace: str) -> Column:
    """Scheme and authority of a path; a catalog table belongs to the namespace of its job."""
    return F.when(
        location.rlike(URI),
        F.concat(F.regexp_extract(location, URI, 1), F.regexp_extract(location, URI, 2)),
    ).when(location.isNotNull(), job_namespace)


def dataset_name(location: Column) -> Column:
    """Path of a location; a catalog table keeps its name."""
    return F.when(location.rlike(URI), F.regexp_extract(location, URI, 3)).otherwise(location)
