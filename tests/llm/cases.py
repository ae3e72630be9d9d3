"""Rows that every operator must take, and brute-force helpers."""

from __future__ import annotations

import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")

#: Columns whose names operators use inside.
CLASHES = "row STRING, number LONG, size LONG, counts LONG, kept LONG, fp LONG, x LONG, id LONG, host LONG, mean LONG"

PROSE = "It was a plain day and nothing much went on in the small town by the river until noon came. "


def documents(spark, rows):
    """``doc_id, text, lang, source`` with further columns of clashing names."""
    schema = f"doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, {CLASHES}"
    filled = [(*row, len(row[1] or ""), "r", *range(9)) for row in rows]
    return spark.createDataFrame(filled, schema)


def messy(spark):
    """Nulls, empty and very long texts, repeated rows and equal ids."""
    return documents(
        spark,
        [
            (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (1, PROSE + "End.", "en", "a"), (None, PROSE, None, None),
            (None, None, "en", None), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n", "en", "b"),
            (5, " ".join(f"w{k}" for k in range(120_000)), "en", "b"), (6, "x" * 50_000, "de", "c"),
            (7, "Ünïcödé wörter 日本語 ▁ mark", "de", "c"), (8, PROSE * 30, "en", "c"),
        ],
    )


def words(text) -> list[bytes]:
    return WORDS.findall((text or "").encode())
