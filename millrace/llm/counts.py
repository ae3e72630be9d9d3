"""Counts of whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.llm.text import as_bytes, duplicate_lines, repeated_window_words

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks",
)
WINDOW = 5


def _among(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(characters, np.uint8))


_SPACE = _among(b" \t\n\r\x0b\x0c")
_FOLLOWING = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = _among(b"#*$%&|<>")
_UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
_DIGIT = (np.arange(256) >= ord("0")) & (np.arange(256) <= ord("9"))
_MARK = _among(b"!?;:=@^_~+/\\{}[]()\"`")
#: One column for each count that is a sum over bytes; a code point is a byte that follows none.
_SUMS = np.column_stack([~_SPACE & ~_FOLLOWING, _SYMBOL, _UPPER, _DIGIT, _MARK]).astype(np.int64)


def count(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``FIELDS``."""
    words = text.split()
    chars, symbols, upper, digits, marks = (
        np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SUMS if text else np.zeros(5, np.int64)
    )
    lines = sum(1 for line in text.split(b"\n") if line.strip())
    return (
        len(words), chars, symbols, duplicate_lines(text), repeated_window_words(words, WINDOW),
        lines, len(set(words)), upper, digits, marks,
    )


def _counts(texts: pa.Array) -> pa.Array:
    made = np.array([count(x.as_buffer().to_pybytes()) for x in texts], np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(made[:, k]) for k in range(len(FIELDS))], names=list(FIELDS))


def text_counts(text: str | Column) -> Column:
    """A struct of ``FIELDS`` of the whole text; a null text counts as empty."""
    kind = "struct<" + ", ".join(f"{name}: long" for name in FIELDS) + ">"
    # Else a filter on the counts is moved below them, and they are made twice.
    return F.arrow_udf(_counts, kind).asNondeterministic()(as_bytes(text))
