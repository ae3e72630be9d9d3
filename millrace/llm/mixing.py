"""Mixing sources to target weights, to the word, by subset sums.

A source takes its documents whole: first all of them as often as they fit into its target, then a
subset whose sizes add up to the rest. Only the number of documents of each exact size matters for
the sum, so the fitting works on counts by size: an equal share of every size, the largest sizes
that still fit, and a bounded knapsack by dynamic programming over the last words. Sizes of one
source that differ are fewer than the square root of twice its words, which bounds the one group
that a task sees. Which documents of a size are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import carried, identified, if_small
from millrace.workspace import materialise

#: Words that the dynamic programme fits exactly.
EXACT = 1 << 16
#: Parts that a size's documents are ranked in; each is a range of the hash.
PARTS = 256


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many of each size to take so that the sum comes nearest to ``budget``.

    ``sizes`` are distinct and positive, ``budget`` is at most their sum. Up to ``exact`` words no other choice
    comes nearer; above, none that takes the same share of all sizes first.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int(sum(int(s) * int(c) for s, c in zip(sizes, counts, strict=True)))
    budget = max(0, min(int(budget), total))
    if not total or budget == total:
        return counts.copy() if total else np.zeros_like(counts)
    # What exceeds the last words is shared by all sizes alike; every size stays open for these.
    above = max(0, budget - exact)
    taken = np.array([int(c) * above // total for c in counts], np.int64)
    rest = budget - sum(int(s) * int(t) for s, t in zip(sizes, taken, strict=True))
    order = np.argsort(-sizes)
    for most in (1, None):  # one more of each size, then as many as it takes
        for k in order:
            if rest <= exact:
                break
            more = min(int(counts[k] - taken[k]), (rest - exact // 2) // int(sizes[k]))
            more = max(0, more if most is None else min(more, most))
            taken[k] += more
            rest -= more * int(sizes[k])
    if rest > exact:  # every size that is left is so large that none or one document comes nearest
        left = [k for k in order if counts[k] > taken[k]]
        best = min(left, key=lambda k: abs(int(sizes[k]) - rest), default=None)
        if best is not None and abs(int(sizes[best]) - rest) < rest:
            taken[best] += 1
        return taken
    # Bounded knapsack: the number of documents of a size is split into powers of two.
    limit = 2 * rest  # a sum above that is farther than none
    first = np.full(limit + 1, -1, np.int32)
    first[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k in order[::-1]:
        left, power = int(counts[k] - taken[k]), 1
        while left > 0 and int(sizes[k]) * power <= limit and first[rest] < 0:
            many = min(power, left)
            weight = int(sizes[k]) * many
            if weight <= limit:
                items.append((int(k), many))
                reached = (first[:-weight] >= 0) & (first[weight:] < 0)
                first[weight:][reached] = len(items) - 1
            left -= many
            power *= 2
    sums = np.flatnonzero(first >= 0)
    goal = int(sums[np.argmin(np.abs(sums - rest))])
    while goal > 0:
        k, many = items[first[goal]]
        taken[k] += many
        goal -= int(sizes[k]) * many
    return taken


def _ranked(sources: DataFrame) -> DataFrame:
    """``source, source_size, rank``: from 0 by code point, null last, ranked in ranges."""
    ranges, _ = materialise(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("within", within).join(starts, "part").select(
        "source", "source_size", (F.col("start") + F.col("within") - 1).alias("rank")
    )


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """``source, source_size, rank, target`` of ``source, source_size``.

    The sources, by code point with null last, get the weights in turn and share ``share`` of all words.
    A target stops at ``most`` times its source; the excess goes to the others by weight until no
    target is above. Each round needs three totals of the driver. No words: all targets are 0.
    """
    ranked, _ = materialise(_ranked(sources), "ranked")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    top = (F.col("source_size") * most).cast("double")
    ranked = ranked.withColumn("weight", weight)
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, fixed, free = whole * share, 0.0, None
    while True:
        stopped = F.lit(False) if free is None else top * F.lit(free[1]) <= F.lit(free[0]) * F.col("weight")
        row = ranked.select("weight", top.alias("top"), stopped.alias("stopped")).agg(
            F.sum(F.when(F.col("stopped"), F.col("top"))), F.sum(F.when(~F.col("stopped"), F.col("weight")))
        ).first()
        now = (budget - (row[0] or 0.0), row[1] or 0.0)
        if now == free or not now[1]:
            break
        free = now
    if free is None:
        return ranked.select("source", "source_size", "rank", top.alias("target"))
    return ranked.select(
        "source", "source_size", "rank", F.least(top, F.lit(free[0]) * F.col("weight") / F.lit(free[1])).alias("target")
    )


def _fitted(exact: int):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        taken = fit(group["size"].to_numpy(), group["docs"].to_numpy(), int(group["rest"].iloc[0]), exact)
        return pd.DataFrame({"rank": group["rank"], "size": group["size"], "extra": taken})

    return one


def _mixed(seed: int, key: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in key])


def _aimed(table: DataFrame, aims: DataFrame) -> DataFrame:
    """Rows with what is aimed at for their ``source``."""
    of_source = aims.withColumnRenamed("source", "aimed")
    return table.join(of_source, table.source.eqNullSafe(of_source.aimed)).drop("source", "aimed")


def _part(mixed: str) -> Column:
    """The range of the hash that a row lies in."""
    return F.shiftrightunsigned(mixed, 64 - (PARTS - 1).bit_length()).cast("int")


def _chosen(
    rows: DataFrame, weights: Sequence[float], share: float, most: int, exact: int
) -> tuple[DataFrame, DataFrame, int]:
    """What is aimed at for each source, and ``number, rank, size, mixed`` of the rows
    taken once more than their source as a whole, and how many they are.

    ``rows`` has ``source, size, mixed, number``. Of a size those with the smallest ``mixed``, then ``number``, are taken.
    """
    counts, _ = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "sizes")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    aims, _ = materialise(targets(sources, weights, share, most), "targets")
    full = F.when(
        F.col("source_size") > 0, F.least(F.floor(F.round("target") / F.col("source_size")), F.lit(most))
    ).otherwise(0)
    aims = aims.withColumn("full", full.cast("long")).withColumn(
        "rest", F.round("target").cast("long") - F.col("full") * F.col("source_size")
    )
    plan = (
        _aimed(counts.filter("size > 0"), aims)
        .select("rank", "size", "docs", "rest")
        .groupBy("rank")
        .applyInPandas(_fitted(exact), "rank long, size long, extra long")
        .filter("extra > 0")
    )
    plan, _ = materialise(plan, "plan")

    # The first `extra` rows of a size by hash: whole ranges of the hash, then a rank within one range.
    part = _part("mixed")
    wanted = _aimed(rows.select("number", "source", "size", "mixed"), aims).join(plan, ["rank", "size"])
    wanted, _ = materialise(wanted.select("number", "rank", "size", "mixed", "extra", part.alias("part")), "wanted")
    ranges = wanted.groupBy("rank", "size", "part").agg(F.count(F.lit(1)).alias("docs"), F.first("extra").alias("extra"))
    before = F.sum("docs").over(
        Window.partitionBy("rank", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("docs")
    ranges = ranges.select("rank", "size", "part", (F.col("extra") - before).alias("open"), "docs").filter("open > 0")
    open_rows = wanted.join(ranges, ["rank", "size", "part"])
    within = F.row_number().over(Window.partitionBy("rank", "size", "part").orderBy("mixed", "number"))
    of_row = ["number", "rank", "size", "mixed"]
    chosen = open_rows.filter("docs <= open").select(*of_row).union(
        open_rows.filter("docs > open").withColumn("within", within).filter("within <= open").select(*of_row)
    )
    return aims, *materialise(chosen, "chosen")


def mix(
    df: DataFrame,
    size: Column,
    source: str = "source",
    key: Sequence[str] = ("doc_id", "text"),
    carry: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: int = 7,
    exact: int = EXACT,
) -> DataFrame:
    """``row, size, source_size, target, copies`` for every input row.

    ``copies`` is how often the mix takes the row, 0 to ``most``. Rows of equal ``key`` columns are
    interchangeable, so a rerun takes equal rows however the table is split. A row without words
    is never taken. A null source is a source of its own. An empty table gives an empty result.
    """
    rows, _ = materialise(
        df.select(
            carried(list(carry)),
            F.col(f"`{source}`").cast("string").alias("source"),
            size.cast("long").alias("size"),
            _mixed(seed, key).alias("mixed"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "sized",
    )
    aims, chosen, _ = _chosen(rows, weights, share, most, exact)
    sized = _aimed(rows.select("row", "number", "source", "size"), aims)
    return sized.join(chosen.select(F.col("number").alias("chosen")), F.col("number") == F.col("chosen"), "left").select(
        "row",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("full") + F.col("chosen").isNotNull().cast("long")).otherwise(0).alias("copies"),
    )


def mixed_rows(
    df: DataFrame,
    size: Column,
    source: str = "source",
    key: Sequence[str] = ("doc_id", "text"),
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: int = 7,
    exact: int = EXACT,
    scan: bool = False,
) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it; other columns and their order as in ``df``.

    The rows are those of ``mix``. What is written and shuffled are sizes and hashes; the texts only meet
    small tables: what a source aims at, and for each size of a source the last row by hash that is taken. ``scan`` says that ``df`` is a scan
    of files, whose rows need not be written to be told apart.
    """
    rows = identified(df, scan).select(
        "*",
        F.col(f"`{source}`").cast("string").alias("_source"),
        size.cast("long").alias("_size"),
        _mixed(seed, key).alias("_mixed"),
    )
    slim, _ = materialise(
        rows.select(
            F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_mixed").alias("mixed"),
            F.struct("_file", "_place").alias("number"),
        ),
        "sized",
    )
    aims, chosen, _ = _chosen(slim, weights, share, most, exact)
    last = chosen.groupBy(F.col("rank").alias("_rank"), F.col("size").alias("_cut_size")).agg(
        F.max(F.struct(_part("mixed").alias("part"), "mixed", "number")).alias("_last")
    )
    last, sizes = materialise(last, "last")
    aims, sources = materialise(aims.select(F.col("source").alias("_aimed"), F.col("rank").alias("_rank"), F.col("full").alias("_full")), "aims")
    own = F.struct(_part("_mixed").alias("part"), F.col("_mixed").alias("mixed"), F.struct("_file", "_place").alias("number"))
    with_aims = rows.join(if_small(aims, sources), F.col("_source").eqNullSafe(F.col("_aimed")))
    cut = if_small(last.withColumnRenamed("_rank", "_of"), sizes)
    found = with_aims.join(cut, (F.col("_rank") == F.col("_of")) & (F.col("_size") == F.col("_cut_size")), "left")
    extra = F.coalesce(own <= F.col("_last"), F.lit(False)).cast("long")
    copies = F.when(F.col("_size") > 0, F.col("_full") + extra).otherwise(0).cast("long")
    again = F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_copy")
    return found.filter(copies > 0).select(*[f"`{name}`" for name in df.columns], again).drop("_copy")
