"""Schema history of data sets and the difference between neighbouring versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import whole_quotient
from millrace.workspace import materialise

# Versions of a data set that one window may hold. Larger histories are cut into spans of this
# many version numbers, whose last versions are then linked to the next span.
SPAN = 4096

# Positions of a schema that one row of its history holds.
FIELDS_PER_ROW = 10_000

DATASET = ("namespace", "name")


def schema_history(schema_fields: DataFrame) -> DataFrame:
    """``namespace, name, version, part, fields``: ordered field names of every version.

    Facts reported repeatedly are merged first. A schema wider than ``FIELDS_PER_ROW`` continues
    in further parts, cut by position, so no array grows without bound.
    """
    part = whole_quotient(F.col("pos"), FIELDS_PER_ROW)
    return (
        schema_fields.groupBy(*DATASET, "version", "field")
        .agg(F.min("pos").alias("pos"))
        .groupBy(*DATASET, "version", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("ordered"))
        .select(*DATASET, "version", "part", F.col("ordered.field").alias("fields"))
    )


def version_links(versions: DataFrame) -> DataFrame:
    """Every version with ``next_version`` (NULL for the last) and ``is_first``.

    Two levels keep each window small however long the history of one data set is: inside a
    span of version numbers, and between the spans, where there is one row per span.
    """
    spanned = versions.withColumn("span", whole_quotient(F.col("version"), SPAN))
    in_span = Window.partitionBy(*DATASET, "span").orderBy("version")
    across = Window.partitionBy(*DATASET).orderBy("span")
    spans = (
        spanned.groupBy(*DATASET, "span")
        .agg(F.min("version").alias("first"))
        .select(
            *DATASET,
            "span",
            F.lead("first").over(across).alias("first_of_next"),
            F.lag("first").over(across).isNull().alias("first_span"),
        )
    )
    return (
        spanned.withColumns(
            {"next_in_span": F.lead("version").over(in_span), "previous": F.lag("version").over(in_span)}
        )
        .join(spans, [*DATASET, "span"])
        .select(
            *DATASET,
            "version",
            F.coalesce("next_in_span", "first_of_next").alias("next_version"),
            (F.col("previous").isNull() & F.col("first_span")).alias("is_first"),
        )
    )


def schema_changes(schema_fields: DataFrame) -> DataFrame:
    """Fields added to, dropped from and retyped in each version, compared with the version before.

    Every field is counted once under its own version and once, as what was there before, under
    the next version. A field that is on one side only, or with another type, has changed. A field
    reported with several types in one version has the first of them by name. The facts are scanned
    once. The links, a row per version, are written down so that they are broadcast only if their
    measured size allows it; then a shuffle by (data set, version, field) gives the answer.
    """
    typed = schema_fields.groupBy(*DATASET, "version", "field").agg(F.min("type").alias("type"))
    fields, _ = materialise(typed, "fields")
    links, _ = materialise(version_links(fields.select(*DATASET, "version").distinct()), "links")
    before, now = 1, 2
    sides = F.array(
        F.struct(F.col("next_version").alias("at"), F.when(F.col("next_version").isNotNull(), before).alias("side")),
        F.struct(F.col("version").alias("at"), F.when(~F.col("is_first"), now).alias("side")),
    )
    counted = (
        fields.join(links, [*DATASET, "version"])
        .select(*DATASET, "field", "type", F.inline(sides))
        .where(F.col("side").isNotNull())
        .groupBy(*DATASET, "at", "field")
        .agg(
            F.sum("side").alias("sides"),
            *[F.min(F.when(F.col("side") == side, F.col("type"))).alias(f"type_{side}") for side in (before, now)],
        )
    )
    change = (
        F.when(F.col("sides") == now, "added")
        .when(F.col("sides") == before, "dropped")
        .when(~F.col(f"type_{before}").eqNullSafe(F.col(f"type_{now}")), "retyped")
    )
    found = counted.select(*DATASET, F.col("at").alias("version"), "field", change.alias("change"))
    return found.where(F.col("change").isNotNull())


def renamed_fields(changes: DataFrame, upstream: DataFrame) -> DataFrame:
    """Renames: the one field dropped and the one field added that share a declared upstream column.

    ``upstream`` holds ``namespace, name, field, source``. Field lists alone do not show a rename.
    """
    dropped = F.col("change") == "dropped"
    return (
        changes.where(F.col("change") != "retyped")
        .join(upstream.select(*DATASET, "field", "source").distinct(), [*DATASET, "field"])
        .groupBy(*DATASET, "version", "source")
        .agg(
            F.count(F.when(dropped, 1)).alias("gone"),
            F.count(F.when(~dropped, 1)).alias("new"),
            F.min(F.when(dropped, F.col("field"))).alias("old_field"),
            F.min(F.when(~dropped, F.col("field"))).alias("new_field"),
        )
        .where((F.col("gone") == 1) & (F.col("new") == 1))
        .select(*DATASET, "version", "source", "old_field", "new_field")
    )
