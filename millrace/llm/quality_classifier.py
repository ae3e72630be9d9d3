"""Quality classifier: a document's own evidence and what is known of its site, by empirical Bayes.

A logistic regression on counts of the text gives a log odds of being good against the labelled rows'
odds: the evidence. The posteriors of all documents are then added up by site, a host and a path below
it. A path's rate is shrunk towards its host's and a host's towards the rate of all, as strongly as
the spread between sites says (a beta prior fitted by moments), so a sparse site falls back to the
wider one. The final odds are the evidence times the odds of the path without the document itself.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.counts import text_counts
from millrace.llm.text import carried
from millrace.workspace import materialise

#: Labelled rows that the regression is fitted to at most, the first by hash of the id.
FIT_ROWS = 50_000
#: Largest weight of a prior, in documents: a site of more has a rate of its own.
MAX_PRIOR = 1000.0


def features(counts: str = "counts") -> Column:
    """Logarithms and shares that tell ordinary prose from the rest."""
    c = {
        name: F.col(f"{counts}.{name}").cast("double")
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
    }
    words, chars = c["n_words"] + 1, c["word_chars"] + 5
    return F.array(
        F.log(words),
        F.log(chars / words),
        F.log1p(c["n_symbols"] / words),
        c["n_dup_lines"] / (c["n_lines"] + 1),
        c["n_repeat_words"] / words,
        c["n_distinct"] / words,
        c["n_upper"] / chars,
        c["n_digits"] / chars,
        F.log1p(c["n_marks"] / words),
    )


def _logit(rate: Column) -> Column:
    held = F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(held / (1 - held))


def _sigmoid(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _prior_weight(sites: DataFrame, rate: Column, prior: Column, rows: Column) -> float:
    """Documents that a prior counts for, from the spread of the sites' rates around it."""
    row = sites.agg(
        F.sum(rows * F.pow(rate - prior, F.lit(2))).alias("spread"),
        F.sum(rows * prior * (1 - prior)).alias("single"),
        F.sum(rows).alias("rows"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not row.rows or row.sites < 2 or not row.single:
        return MAX_PRIOR
    single = row.single / row.rows  # variance of one document
    between = row.spread / row.rows - single * row.sites / row.rows
    return MAX_PRIOR if between <= 0 else min(MAX_PRIOR, max(1.0, single / between - 1))


def fitted(labelled: DataFrame, rows: int = FIT_ROWS):
    """Coefficients, intercept and log odds of the labelled rows (columns ``id, good, x``), or None."""
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(rows).select(
        array_to_vector("x").alias("features"), F.col("good").cast("double").alias("label")
    )
    sample, _ = materialise(sample, "labelled")
    seen = sample.agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("rows")).first()
    if not seen.rows or not 0 < seen.good < seen.rows:
        return None
    model = LogisticRegression(maxIter=50, regParam=1e-4, elasticNetParam=0.0).fit(sample)
    odds = seen.good / (seen.rows - seen.good)
    return [float(x) for x in model.coefficients], float(model.intercept), odds


def classified(
    df: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_column: str = "doc_id",
    text: str = "text",
    good: str = "quality",
    carry: list[str] | None = None,
    threshold: float = 0.3,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``row, host, path, evidence, host_rate, path_rate, posterior, kept`` for every input row.

    ``row`` holds the ``carry`` columns (default: the id). ``labels`` has the ids and 0 or 1 in ``good``;
    rows with a null are ignored, and an id labelled more than once is good if most of its labels are.
    Null hosts and paths are sites of their own. A null or empty text has evidence like any other.
    Equal rows get equal results. Without labels of both kinds the evidence is 0 and everything is
    kept; an empty table gives an empty result.
    """
    carry = carry or [id_column]
    counted = df.select(
        carried(carry),
        F.col(f"`{id_column}`").alias("id"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        text_counts(F.col(f"`{text}`")).alias("counts"),
    ).withColumn("x", features())
    # Texts are not written once more: where they are carried, they are counted again at the end.
    again = text in carry
    rows, _ = materialise(counted.drop("row") if again else counted, "counted")
    known = labels.filter(F.col(id_column).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(id_column).alias("known"))
    known = known.agg((F.avg(F.col(good).cast("double")) >= 0.5).alias("good"))
    # Equal ids may hold different texts; each of them is a labelled row.
    labelled = rows.select("id", "x").join(known, F.col("id") == F.col("known")).select("id", "x", "good")
    model = fitted(labelled, fit_rows)
    if model is None:
        evidence, start = F.lit(0.0), F.lit(0.0)
    else:
        weights, intercept, odds = model
        evidence = F.lit(intercept) - F.log(F.lit(odds))
        for k, weight in enumerate(weights):
            evidence = evidence + F.lit(weight) * F.col("x")[k]
        start = F.log(F.lit(odds))

    def believed(table: DataFrame) -> DataFrame:
        return table.withColumn("evidence", evidence).withColumn("belief", _sigmoid(F.col("evidence") + start))

    scored = believed(rows)
    paths, _ = materialise(
        scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"), F.sum("belief").alias("good")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("rows").alias("host_rows"), F.sum("good").alias("host_good"))
    hosts, _ = materialise(hosts, "hosts")
    total = hosts.agg(F.sum("host_good"), F.sum("host_rows")).first()
    overall = F.lit(float(total[0]) / total[1] if total[1] else 0.5)
    weight = _prior_weight(hosts, F.col("host_good") / F.col("host_rows"), overall, F.col("host_rows"))
    hosts = hosts.withColumn(
        "host_rate", (F.col("host_good") + weight * overall) / (F.col("host_rows") + weight)
    ).withColumnRenamed("host", "of")
    sites, _ = materialise(
        paths.join(hosts, paths.host.eqNullSafe(hosts.of)).select(
            F.col("host").alias("site_host"), F.col("path").alias("site_path"), "rows", "good", "host_rate"
        ),
        "sites",
    )
    weight = _prior_weight(sites, F.col("good") / F.col("rows"), F.col("host_rate"), F.col("rows"))
    scored = believed(counted if again else rows).select("row", "host", "path", "evidence", "belief")
    placed = scored.join(sites, scored.host.eqNullSafe(sites.site_host) & scored.path.eqNullSafe(sites.site_path))
    # The document's own belief is taken out again, else its evidence would count twice.
    without = (F.col("good") - F.col("belief") + weight * F.col("host_rate")) / (F.col("rows") - 1 + weight)
    posterior = _sigmoid(F.col("evidence") + _logit(F.col("path_rate")))
    kept = F.lit(True) if model is None else F.col("posterior") >= threshold
    return (
        placed.withColumn("path_rate", without)
        .withColumn("posterior", posterior)
        .select("row", "host", "path", "evidence", "host_rate", "path_rate", "posterior", kept.alias("kept"))
    )
