"""Quality rules: fixed rules, then robust multivariate outliers.

Statistics of a document are transformed to a short vector. For each language and source the location
and scatter of the vectors are minimum-covariance-determinant estimates: from several starts, the half of
the rows with the smallest distances gives the next estimate until it stands still, and the start with the
smallest determinant wins. A document far from its group by Mahalanobis distance goes. Starts are medians
with spreads that up to half of the rows cannot move, so a group may hold copies of one junk text by the third.

A concentration step is one aggregation: distances fall into fixed narrow bins, sums of the vectors and
of their products are made for each bin, and the bins up to the half are added up. So no group is ever
gathered or sorted, and its largest part in one place is a row for each bin. Rows count towards their
(language, source), their language and all documents; a group of fewer than ``MIN_ROWS`` good rows
takes the estimate of its language, or else of all, which a table of ``LEAST_ROWS`` good rows has.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.counts import FIELDS, text_counts
from millrace.llm.text import carried
from millrace.workspace import materialise

#: Parts of a group by number of rows, between which the shortest half of each statistic is looked for.
CUTS = 20
#: Rows below which a group is too sparse for an estimate of its own.
MIN_ROWS = 200
#: Rows that the estimate of all documents needs; with so few, the smallest spreads are most of it.
LEAST_ROWS = 12
#: Concentration steps at most; they end when no determinant changes any more.
STEPS = 20
#: Bins of the squared distance: so many for each doubling.
BINS = 16
#: A document of the modelled shape is rejected with this probability, were the vectors normal.
REJECTED = 1e-3
#: Words that every share is smoothed with, so a short text has no extreme share by chance.
SMOOTHING = 60.0
#: The smallest spread that counts for each part of the vector: what differs by less is alike.
SPREAD = (0.04, 0.03, 0.05, 0.03, 0.02, 0.03, 0.03, 0.03)
#: Parts of the vector that are about shape; those of digits and of distinct words follow.
SIZE = 6


def _upper(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def vector(counts: str = "counts") -> list[Column]:
    """The transformed statistics; shares are smoothed by ``SMOOTHING`` words of ordinary text."""
    c = {name: F.col(f"{counts}.{name}").cast("double") for name in FIELDS}
    words, k = c["n_words"], SMOOTHING
    chars = c["word_chars"]
    return [
        F.log((chars + 5 * k) / (words + k)),
        F.log1p(c["n_symbols"] / (words + k)),
        c["n_dup_lines"] / (c["n_lines"] + 10),
        c["n_repeat_words"] / (words + k),
        c["n_upper"] / (chars + 5 * k),
        F.log1p(c["n_marks"] / (words + k)),
        c["n_digits"] / (chars + 5 * k),
        F.log(c["n_distinct"] + k) / F.log(words + k),
    ]


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


def _parts(columns: list[str], letter: str = "x") -> list[str]:
    """The names of the parts among the columns, ``x0`` and on."""
    return [f"{letter}{i}" for i in range(sum(f"{letter}{i}" in columns for i in range(len(SPREAD))))]


def half(rows: int, size: int) -> int:
    """So many rows of a group are covered: the least number that no smaller share of junk can move."""
    return min(rows, (rows + size + 1) // 2)


@cache
def consistency(rows: int, size: int) -> float:
    """What makes the scatter of the covered rows right for normal vectors."""
    share = half(rows, size) / rows
    return share / chi_square(quantile(share, size), size + 2) if share < 1 else 1.0


def _estimate(means: np.ndarray, products: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse scatter and log determinant of each row of second moments, with the smallest spreads kept."""
    size = means.shape[1]
    scatter = np.zeros((len(means), size, size))
    for k, (i, j) in enumerate(_upper(size)):
        scatter[:, i, j] = scatter[:, j, i] = products[:, k] - means[:, i] * means[:, j]
    scatter = factor[:, None, None] * scatter + np.diag(np.square(SPREAD[:size]))
    return np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]


_MODEL = "level int, lang string, source string, start int, rows long, mean array<double>, inverse array<double>, logdet double"


def _modelled(batches):
    for frame in batches:
        if not len(frame):
            continue
        n = frame["covered"].to_numpy(float)[:, None]
        sums = _parts(list(frame.columns), "s")
        means = frame[sums].to_numpy(float) / n
        products = frame[[f"p{i}_{j}" for i, j in _upper(len(sums))]].to_numpy(float) / n
        inverse, logdet = _estimate(means, products, np.array([consistency(int(x), len(sums)) for x in frame["rows"]]))
        yield pd.DataFrame(
            {
                "level": frame["level"], "lang": frame["lang"], "source": frame["source"], "start": frame["start"],
                "rows": frame["rows"], "mean": list(means), "inverse": list(inverse.reshape(len(frame), -1)), "logdet": logdet,
            }
        )


def distance(mean: Column, inverse: Column, size: int) -> Column:
    """Squared Mahalanobis distance of the columns ``x0`` and on."""
    from_mean = [F.col(f"x{i}") - mean[i] for i in range(size)]
    total = F.lit(0.0)
    for i, j in _upper(size):
        total = total + from_mean[i] * from_mean[j] * inverse[i * size + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


KEYS = ["level", "lang", "source"]


def _same(left: DataFrame, right: DataFrame) -> Column:
    return (
        (left.level == right.level) & left.lang.eqNullSafe(right.lang) & left.source.eqNullSafe(right.source)
    )


def _moments(rows: DataFrame, groups: list[str]) -> DataFrame:
    size = len(_parts(rows.columns))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(size)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _upper(size)],
    )


def _step(rows: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step of every group and start."""
    size = len(_parts(rows.columns))
    model = models.select(*[F.col(k).alias(f"m_{k}") for k in KEYS], "start", "mean", "inverse")
    joined = rows.join(
        model,
        (rows.level == model.m_level) & rows.lang.eqNullSafe(model.m_lang) & rows.source.eqNullSafe(model.m_source),
    )
    binned = joined.withColumn("bin", F.floor(F.log2(distance(F.col("mean"), F.col("inverse"), size) + 1e-6) * BINS))
    binned = _moments(binned, [*KEYS, "start", "bin"])
    whole = Window.partitionBy(*KEYS, "start")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = binned.withColumn("all", F.sum("rows").over(whole)).withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
    covered = covered.filter(F.col("before") < F.least(F.col("all"), F.floor((F.col("all") + size + 1) / 2)))
    sums = covered.groupBy(*KEYS, "start").agg(
        F.sum("rows").alias("covered"),
        F.first("all").alias("rows"),
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)],
        *[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in _upper(size)],
    )
    return sums.mapInPandas(_modelled, _MODEL)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``level, lang, source, rows, mean, inverse`` of rows ``lang, source, x0, ...``.

    Starts: the median with the width of the shortest half of each part, and the median with the smallest
    spreads. Neither follows junk that is less than half of a group, as the mean and the quartiles do.
    """
    parts = _parts(rows.columns)
    size = len(parts)
    levels = [
        F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")),
    ]
    rows, _ = materialise(rows.select(F.explode(F.array(*levels)).alias("g"), *parts).select("g.*", *parts), "vectors")
    cuts = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.percentile_approx(x, [k / CUTS for k in range(CUTS + 1)], 1000).alias(x) for x in parts],
    )

    def start(number: int, widths: list[Column]) -> DataFrame:
        diagonal = [1 / (widths[i] ** 2 + SPREAD[i] ** 2) if i == j else F.lit(0.0) for i in range(size) for j in range(size)]
        return cuts.select(
            *KEYS, F.lit(number).alias("start"), "rows", F.array(*[F.col(x)[CUTS // 2] for x in parts]).alias("mean"),
            F.array(*diagonal).alias("inverse"), F.lit(0.0).alias("logdet"),
        )

    shortest = [F.least(*[F.col(x)[k + CUTS // 2] - F.col(x)[k] for k in range(CUTS // 2 + 1)]) / 1.349 for x in parts]
    cuts, _ = materialise(cuts, "cuts")
    models, _ = materialise(start(0, shortest).unionByName(start(1, [F.lit(0.0)] * size)), "starts")
    before = None
    for _ in range(steps):
        models, _ = materialise(_step(rows, models), "step")
        now = models.agg(F.sum("logdet")).first()[0] or 0.0
        if before is not None and abs(now - before) <= 1e-6 * max(1.0, abs(now)):
            break
        before = now
    best = models.groupBy(*KEYS).agg(F.min_by(F.struct("rows", "mean", "inverse"), F.struct("logdet", "start")).alias("best"))
    return best.select(*KEYS, "best.*")


def judged(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None,
    rejected: float = REJECTED, steps: int = STEPS, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``row, counts, base_failed, distance, kept`` for every input row.

    ``row`` holds the ``carry`` columns. A null text counts as empty and fails the fixed rules, as does
    every text of fewer than 10 words. A null language or source is a group of its own. Repeated rows
    count as often as they come and get equal verdicts. With fewer than ``LEAST_ROWS`` good rows in all
    there is no estimate, and only the fixed rules decide. An empty table gives an empty result.
    """
    carry = carry or ["doc_id"]
    counted = df.select(
        carried(carry),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{source}`").cast("string").alias("source"),
        text_counts(F.col(f"`{text}`")).alias("counts"),
    )
    # Texts are not written once more: where they are carried, they are counted again at the end.
    again = text in carry
    rows, _ = materialise(counted.drop("row") if again else counted, "counted")
    failed = base_failed(F.col("counts.n_words"), F.col("counts.n_repeat_words"))
    more = {"failed": failed} | {f"x{i}": x for i, x in enumerate(vector())}
    rows = rows.withColumns(more)
    good = rows.filter(~F.col("failed")).select("lang", "source", *[f"x{i}" for i in range(len(SPREAD))])
    models, _ = materialise(estimates(good, steps).filter(F.col("rows") >= F.when(F.col("level") == 0, LEAST_ROWS).otherwise(min_rows)), "estimates")

    def of(level: int, prefix: str) -> DataFrame:
        names = {"lang": f"{prefix}_lang", "source": f"{prefix}_source", "mean": f"{prefix}_mean", "inverse": f"{prefix}_inverse"}
        return models.filter(F.col("level") == level).select(*[F.col(k).alias(v) for k, v in names.items()])

    # The estimates of every group, with those of sparse groups filled in from the wider ones.
    groups = rows.select("lang", "source").distinct()
    language, own = of(1, "l"), of(2, "o")
    whole = models.filter("level = 0").select("mean", "inverse").first()  # one row
    widest = [F.lit(None if whole is None else list(part)).cast("array<double>") for part in (whole or (None, None))]
    groups = (
        groups.join(own, groups.lang.eqNullSafe(own.o_lang) & groups.source.eqNullSafe(own.o_source), "left")
        .join(language, groups.lang.eqNullSafe(language.l_lang), "left")
        .select(
            F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
            F.coalesce("o_mean", "l_mean", widest[0]).alias("mean"),
            F.coalesce("o_inverse", "l_inverse", widest[1]).alias("inverse"),
        )
    )
    groups, _ = materialise(groups, "groups")
    rows = counted.withColumns(more) if again else rows
    placed = rows.join(groups, rows.lang.eqNullSafe(groups.g_lang) & rows.source.eqNullSafe(groups.g_source))
    placed = placed.withColumn("distance", distance(F.col("mean"), F.col("inverse"), len(SPREAD)))
    cutoff = quantile(1 - rejected, len(SPREAD))
    kept = ~F.col("failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return placed.select("row", "counts", F.col("failed").alias("base_failed"), "distance", kept.alias("kept"))
