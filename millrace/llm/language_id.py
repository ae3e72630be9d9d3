"""Language identification: four pieces of evidence fused by Bayes' rule.

* the text: byte trigrams under a model of each language, learnt from all labelled documents;
* the language that the markup declares, and the suffix of the address (the host's last label and a
  language-like first segment of the path): how often each goes with each language is counted over all
  pages by the text's posteriors, so a site that declares nonsense teaches how little that says;
* the host: its pages' posteriors added up, shrunk to those of its domain and further to those of all.

All counts are grouped aggregations of one number for each language, so nothing but totals is gathered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import as_bytes, carried
from millrace.llm.url_filter import url_host, url_path
from millrace.workspace import materialise

#: Places that trigrams are hashed to, and languages that a model may have: its size is their product.
BUCKETS, LANGUAGES = 1 << 16, 256
#: Trigrams that a text counts for at most: neighbours are not independent.
EVIDENCE = 200.0
#: Pages that a host's prior and a table's row start with.
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 5.0, 20.0, 1.0

_LETTER = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32
)


def trigrams(text: bytes) -> np.ndarray:
    """Places of the byte trigrams of a text: A-Z lower-cased, everything that is no letter a space."""
    data = _LETTER[np.frombuffer(text, np.uint8)]
    if len(data) < 3:
        return np.empty(0, np.int64)
    codes = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    codes = codes[codes != 0x202020]
    return ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and languages to counts of trigrams, one set of rows for a batch."""
    for batch in batches:
        totals: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(trigrams(text.as_buffer().to_pybytes()), minlength=BUCKETS)
            totals[lang] = totals[lang] + found if lang in totals else found
        for lang, found in totals.items():
            place = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(place), pa.string()), pa.array(place), pa.array(found[place])], ["lang", "place", "n"]
            )


def trained(documents: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by code point and the log probability of each place in each of them, from all documents.

    Rows without a language or text teach nothing. More than ``LANGUAGES`` languages are an error.
    """
    rows = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = [r[0] for r in rows.select(F.col(lang).cast("string")).distinct().orderBy(lang).limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"a model holds at most {LANGUAGES} languages")
    counts = rows.select(as_bytes(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(
        _counted, "lang string, place long, n long"
    )
    table = counts.groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()  # LANGUAGES x BUCKETS rows
    model = np.full((len(names), BUCKETS), 0.5)
    at = np.array([names.index(x) for x in table.column(0).to_pylist()], int)
    np.add.at(model, (at, table.column(1).to_numpy().astype(int)), table.column(2).to_numpy())
    return names, np.log(model / model.sum(axis=1, keepdims=True))


_HIDDEN = re.compile(rb"<(script|style|nav|footer|aside|head)\b")
_ENTITY = re.compile(rb"&[#A-Za-z0-9]+;")
_SPACES = re.compile(rb"\s*>")


def visible(html: bytes) -> bytes:
    """Text of a page without scripts, styles, comments, menus, footers, tags and entities.

    One pass over the tags. An element or a comment that is not closed hides nothing but its tag, and what is no tag
    because no ``>`` follows stays.
    """
    lower, out, at = html.lower(), [], 0
    unclosed: set[bytes] = set()  # what nothing closes from here on: it is not looked for again

    def end_of(name: bytes, start: int) -> int:
        while name not in unclosed:
            start = lower.find(b"</" + name, start)
            if start < 0:
                unclosed.add(name)
                break
            start += len(name) + 2
            closing = _SPACES.match(lower, start)
            if closing:
                return closing.end()
        return -1

    while True:
        tag = lower.find(b"<", at)
        end = lower.find(b">", tag) + 1 if tag >= 0 else 0
        if not end:
            out.append(html[at:])
            break
        out.append(html[at:tag])
        hidden = _HIDDEN.match(lower, tag)
        if lower.startswith(b"<!--", tag):
            close = lower.find(b"-->", tag + 4) if b"--" not in unclosed else -1
            if close < 0:
                unclosed.add(b"--")
            end = close + 3 if close >= 0 else end
        elif hidden:
            end = max(end, end_of(hidden[1], end))
        at = end
    return _ENTITY.sub(b" ", b" ".join(out))


def _likelihoods(shared):
    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        out = np.zeros((len(texts), len(model)))
        for k, text in enumerate(texts):
            places = trigrams(visible(text.as_buffer().to_pybytes()))
            if len(places):
                found = np.array([row[places].sum() for row in model])
                out[k] = found * min(1.0, EVIDENCE / len(places))
        offsets = np.arange(0, out.size + 1, len(model), dtype=np.int32) if len(model) else np.zeros(len(texts) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return score


def declared(html: Column) -> Column:
    """The primary language tag of the ``html`` element, lower-case; empty if it has none."""
    tag = F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?\s*([a-z]+)", 1)
    return F.lower(tag)


def suffix(url: Column) -> Column:
    """The host's last label, and the first path segment if it looks like a language."""
    label = F.regexp_extract(url_host(url), r"([^.]*)$", 1)
    segment = F.lower(F.regexp_extract(url_path(url), r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2,4})?(?:/|$)", 1))
    return F.concat(label, F.lit("/"), segment)


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    shares = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(shares, F.lit(0.0), lambda a, s: a + s)
    return F.transform(shares, lambda s: s / total)


def _plus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def identified(
    pages: DataFrame, documents: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html",
    text: str = "text", lang: str = "lang", carry: list[str] | None = None,
) -> DataFrame:
    """``row, host, declared, suffix, text_lang, lang, posterior`` for every row of ``pages``.

    ``row`` holds the ``carry`` columns (default: the id). ``lang`` is the language of the largest
    ``posterior`` (ties: the first by code point), ``text_lang`` that of the text alone. A null or empty
    page has no text evidence, pages of any length are read whole in one pass, a null url an empty host that is shared with other such rows. Repeated rows
    count as often as they come. Without a labelled document ``lang`` and ``posterior`` are null.
    """
    spark = pages.sparkSession
    names, model = trained(documents, text, lang)
    parts = pages.select(
        carried(carry or [id_column]),
        url_host(F.col(f"`{url}`").cast("string")).alias("host"),
        declared(F.col(f"`{html}`")).alias("declared"),
        suffix(F.col(f"`{url}`").cast("string")).alias("suffix"),
        as_bytes(f"`{html}`").alias("html"),
    )
    if not names:
        nothing = F.lit(None).cast("string")
        return parts.select(
            "row", "host", "declared", "suffix", nothing.alias("text_lang"), nothing.alias("lang"),
            F.lit(None).cast("double").alias("posterior"),
        )
    shared = spark.sparkContext.broadcast(model.astype(np.float32))
    size = len(names)
    rows, count = materialise(
        parts.withColumn("likelihood", _likelihoods(shared)(F.col("html"))).drop("html").withColumn("domain", domain(F.col("host"))),
        "pages",
    )

    def totals(column: str) -> list[Column]:
        return [F.sum(F.col(column)[k]).alias(f"n{k}") for k in range(size)]

    def sums(table: DataFrame, key: str, column: str) -> DataFrame:
        """``of_<key>, n_<key>``: expected pages of each language for every value of ``key``."""
        added = table.groupBy(F.col(key).alias(f"of_{key}")).agg(*totals(column))
        return added.select(f"of_{key}", F.array(*[f"n{k}" for k in range(size)]).alias(f"n_{key}"))

    rows = rows.withColumn("by_text", _softmax(F.col("likelihood")))
    whole = rows.agg(*totals("by_text")).first()
    expected = [float(x or 0.0) + 1.0 for x in whole]
    prior = F.lit([x / sum(expected) for x in expected])
    # How often a value goes with each language, by what the texts say.
    for key in ("declared", "suffix"):
        table, values = materialise(sums(rows, key, "by_text"), key)
        logs = F.zip_with(
            F.col(f"n_{key}"), F.lit(expected), lambda n, all_: F.log((n + TABLE_WEIGHT) / (all_ + TABLE_WEIGHT * max(1, values)))
        )
        table = table.select(f"of_{key}", logs.alias(f"log_{key}"))
        rows = rows.join(table, F.col(key) == F.col(f"of_{key}")).drop(f"of_{key}")
    evidence = _plus(_plus(F.col("likelihood"), F.col("log_declared")), F.col("log_suffix"))
    rows = rows.withColumn("evidence", evidence)
    rows = rows.withColumn("by_page", _softmax(_plus(F.col("evidence"), F.transform(prior, lambda p: F.log(p)))))
    rows, _ = materialise(rows.drop("log_declared", "log_suffix", "likelihood"), "evidence")
    domains, _ = materialise(sums(rows, "domain", "by_page"), "domains")
    hosts, _ = materialise(sums(rows, "host", "by_page"), "hosts")
    rows = rows.join(domains, F.col("domain") == F.col("of_domain")).join(hosts, F.col("host") == F.col("of_host"))

    def shrunk(own: Column, rest: Column, weight: float) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, rest, lambda a, r: (a + weight * r) / (n + weight))

    # A page does not count towards the prior that it is judged with.
    def others(own: str) -> Column:
        return F.zip_with(F.col(own), F.col("by_page"), lambda a, b: F.greatest(a - b, F.lit(0.0)))

    rows = rows.withColumn("p_domain", shrunk(others("n_domain"), prior, DOMAIN_WEIGHT))
    rows = rows.withColumn("p_host", shrunk(others("n_host"), F.col("p_domain"), HOST_WEIGHT))
    final = _softmax(_plus(F.col("evidence"), F.transform("p_host", lambda p: F.log(F.greatest(p, F.lit(math.exp(-50)))))))
    rows = rows.withColumn("final", final)

    def best(column: str) -> Column:
        return F.get(F.lit(names), F.array_position(F.col(column), F.array_max(column)).cast("int") - 1)

    return rows.select(
        "row", "host", "declared", "suffix", best("by_text").alias("text_lang"), best("final").alias("lang"),
        F.array_max("final").alias("posterior"),
    )
