"""Language-model scores from a log-frequency Bloom filter.

The filter holds words and pairs of neighbours with quantised counts: an item whose count has level
``j`` (``BASE`` to the power of ``j - 1``) is put in ``j`` times, as the events ``(item, 1) .. (item, j)``. A
reader probes the events one after the other; the first that is missing gives the level, and so the count
within a factor of ``BASE``. An event sets a few bits of one 64-bit word of the filter, so a probe is one access.

Every word and every pair of the training documents is held, those seen once too, however many there are.
The filter is cut into slices, ranges of the items' hashes, whose number follows the tokens; a slice is made and
probed by one task and never leaves it. Documents are gathered in blocks of about ``BLOCK_TOKENS`` tokens, which
are written once. A block sends each slice its distinct items of that range with their counts in training
documents. The slice adds the counts of all blocks, fills its part of the filter, probes it for the items
of each block and sends the levels back in their order, for words the exact counts too, which the base score
needs. A block then meets its answers, and its documents are scored.

Probabilities are interpolated: ``p(v | u) = W c(uv) / c(u) + (1 - W) p(v)``, ``p(v)`` add-one smoothed, all
counts from probes. An end follows the last word, a start precedes the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, LongType, StructField, StructType

from millrace.llm.text import SEED, as_bytes, carried
from millrace.workspace import materialise

#: Ratio of neighbouring levels.
BASE = 1.25
#: Bits of the filter for each event, and bits that an event sets.
EVENT_BITS, PROBE_BITS = 12, 5
#: The smallest count of a pair that is held: every pair is.
LEAST_PAIR = 1
#: Weight of the pair's share.
WEIGHT = 0.1
#: Tokens that a block gathers, and tokens of all documents for each slice of the filter.
BLOCK_TOKENS, SLICE_TOKENS = 1 << 20, 1 << 21
#: The hashes of the end and of the start of a text.
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes) -> np.ndarray:
    """XXH64 of each word of a text with A-Z lower-cased, then the end."""
    words = text.lower().split()
    found = np.empty(len(words) + 1, np.uint64)
    found[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    found[-1] = END
    return found


def _before(words: np.ndarray) -> np.ndarray:
    """The token before each; the texts of ``words`` all end, and a start precedes each of them."""
    before = np.concatenate([[START], words[:-1]])
    before[1:][words[:-1] == END] = START
    return before


def pair_codes(words: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it."""
    return _mix(_before(words) * np.uint64(0x9E3779B97F4A7C15) ^ _mix(words))


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, by weight: first the lowest of all, then the next."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(data: pa.Buffer, kind: type) -> np.ndarray:
    """The numbers that ``_planes`` took."""
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pressed(values: np.ndarray) -> bytes:
    """How many bytes, then the numbers compressed."""
    return values.nbytes.to_bytes(8, "little") + pa.compress(_planes(values), "zstd", asbytes=True)


def _restored(data: pa.BinaryScalar, kind: type) -> np.ndarray:
    """The numbers that ``_pressed`` took."""
    data = data.as_buffer()
    return _numbers(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), kind)


def _restored_codes(differences: np.ndarray) -> np.ndarray:
    """Sorted codes from their differences."""
    return np.cumsum(differences, dtype=np.uint64)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and their total counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts[order], first)


def _block_type(row: DataType) -> StructType:
    parts = [StructField(name, BinaryType()) for name in ("lengths", "learned", "words", "places")]
    return StructType([StructField("rows", ArrayType(row)), *parts, StructField("tokens", LongType())])


def _blocks(block_tokens: int):
    """Rows ``row, learned, text`` to blocks: their rows, tokens, and whether the model learns from them.

    Tokens are kept as the distinct words of the block, sorted, and the place of each token among them.
    """

    def packed(rows: list[pa.Array], learned: list[bool], found: list[np.ndarray]) -> pa.RecordBatch:
        words, places = np.unique(np.concatenate(found), return_inverse=True)
        held = pa.concat_arrays(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array([_pressed(np.array([len(x) for x in found], np.uint32))], pa.binary()),
                pa.array([_pressed(np.array(learned, np.uint8))], pa.binary()),
                pa.array([_pressed(np.diff(words, prepend=np.uint64(0)))], pa.binary()),
                pa.array([_pressed(places.astype(np.uint32))], pa.binary()),
                pa.array([len(places)], pa.int64()),
            ],
            ["rows", "lengths", "learned", "words", "places", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []
        learned: list[bool] = []
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            row, learns, texts = batch.columns
            begin = 0
            for k, text in enumerate(texts):
                found.append(tokens(text.as_buffer().to_pybytes()))
                learned.append(learns[k].as_py())
                size += len(found[-1])
                if size >= block_tokens:
                    yield packed([*rows, row.slice(begin, k + 1 - begin)], learned, found)
                    rows, learned, found, size, begin = [], [], [], 0, k + 1
            if begin < len(row):
                rows.append(row.slice(begin))
        if found:
            yield packed(rows, learned, found)

    return run


_ASKED = "block long, slice int, order int, codes binary, counts binary"


def _asked(slices: int):
    """Blocks to what they ask of each slice: their distinct items, with the counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, learned, words, places in zip(*batch.columns, strict=True):
                learns = np.repeat(_restored(learned, np.uint8), _restored(lengths, np.uint32))
                codes, at = _restored_codes(_restored(words, np.uint64)), _restored(places, np.uint32)
                yield asked(block.as_py(), 1, codes, at, learns)
                codes, at = np.unique(pair_codes(codes[at]), return_inverse=True)
                yield asked(block.as_py(), 2, codes, at, learns)

    def asked(block: int, order: int, codes: np.ndarray, at: np.ndarray, learns: np.ndarray) -> pa.RecordBatch:
        counts = np.bincount(at[learns > 0], minlength=len(codes)).astype(np.uint32)
        cuts = np.searchsorted(_slice_of(codes, slices), np.arange(slices + 1))
        used = np.flatnonzero(np.diff(cuts))
        differences = np.diff(codes, prepend=np.uint64(0))
        differences[cuts[used]] = codes[cuts[used]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(used), block, np.int64)),
                pa.array(used.astype(np.int32)),
                pa.array(np.full(len(used), order, np.int32)),
                pa.array([_planes(differences[cuts[k] : cuts[k + 1]]) for k in used], pa.binary()),
                pa.array([counts[cuts[k] : cuts[k + 1]].tobytes() for k in used], pa.binary()),
            ],
            ["block", "slice", "order", "codes", "counts"],
        )

    return run


def _slice_of(codes: np.ndarray, slices: int) -> np.ndarray:
    """Slices are ranges of the upper half of a hash, in its order."""
    return ((codes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["codes"]]
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["counts"]]
    return np.concatenate(codes), np.concatenate(counts).astype(np.int64)


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    """Level of each count: 0 below ``least``, else 1 and one more for each factor of ``BASE``."""
    found = np.floor(np.log(np.maximum(counts, least) / least) / np.log(BASE) + 1e-9).astype(np.int64) + 1
    return np.where(counts < least, 0, found)


def middle(level: np.ndarray, least: int) -> np.ndarray:
    """The count that a level stands for: the middle, by ratio, of the whole numbers in it; 0 for level 0."""
    low = np.ceil(least * BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(least * BASE**level.astype(float) - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64).tobytes()


def _totals(codes: np.ndarray, data: pa.Buffer) -> np.ndarray:
    """The totals of a slice, one for each code."""
    return np.frombuffer(data, np.int64 if data.size == 8 * len(codes) else np.uint32).astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    """One slice of one order: distinct items with their counts.

    A block's counts have 32 bits, which a block cannot exceed; the totals of a slice have 64 where one of
    them needs more than 32.
    """
    codes, counts = _summed(*_joined(table))
    return pa.table(
        {
            "order": pa.array([table["order"][0].as_py()], pa.int32()),
            "slice": pa.array([table["slice"][0].as_py()], pa.int32()),
            "codes": pa.array([codes.tobytes()], pa.binary()),
            "counts": pa.array([_packed(counts)], pa.binary()),
            "items": pa.array([len(codes)], pa.int64()),
            "total": pa.array([int(counts.sum())], pa.int64()),
        }
    )


def _probe(codes: np.ndarray, level: np.ndarray | int, words: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Place within the filter and the bits of the events ``(code, level)``."""
    event = _mix(codes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    place = (event >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)
    bits = np.zeros(len(codes), np.uint64)
    for k in range(PROBE_BITS):
        bits |= np.uint64(1) << (event >> np.uint64(6 * k) & np.uint64(63))
    return _slice_of(codes, slices) * words + place.astype(np.int64), bits


def _filled(words: int, slices: int, least: dict[int, int]):
    """The part of the filter of one slice, ``words`` words of 64 bits; ``least`` is by order."""

    def run(table: pa.Table) -> pa.Table:
        number = table["slice"][0].as_py()
        bits = np.zeros(words, np.uint64)
        for order, codes, counts in zip(table["order"].to_pylist(), table["codes"], table["counts"], strict=True):
            codes = np.frombuffer(codes.as_buffer(), np.uint64) ^ _SALT[order]
            level = levels(_totals(codes, counts.as_buffer()), least[order])
            for k in range(1, int(level.max(initial=0)) + 1):
                held = codes[level >= k]
                place, mask = _probe(held, k, words, slices)
                np.bitwise_or.at(bits, place % words, mask)
        return pa.table({"slice": pa.array([number], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


#: Words and pairs share the filter; the lower half of the hash tells them apart, the slice stays.
_SALT = {1: np.uint64(0), 2: np.uint64(0x5BD1E995)}


#: The smallest counts that are held, by order.
LEAST = {1: 1, 2: LEAST_PAIR}


class Model:
    """The filter, or one slice of it, with its totals: the tokens and the distinct words of the training documents."""

    def __init__(self, bits: np.ndarray, slices: int, least: dict[int, int], total: int, distinct: int):
        self.bits, self.slices, self.least = bits, slices, least
        self.words = len(bits) // max(1, slices)
        self.total, self.distinct = total, distinct

    def level(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Levels by probes, of distinct or repeated codes."""
        level = np.zeros(len(codes), np.int64)
        if not self.words:
            return level
        open_ = np.arange(len(codes))
        codes = codes ^ _SALT[order]
        k = 1
        while len(open_):
            place, mask = _probe(codes[open_], k, self.words, self.slices)
            open_ = open_[self.bits[place] & mask == mask]
            level[open_] = k
            k += 1
        return level

    def count(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Counts by probes, of distinct or repeated codes."""
        return middle(self.level(codes, order), self.least[order])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of words to rows ``code, n``."""
    for batch in batches:
        for codes, counts in zip(batch.column(0), batch.column(1), strict=True):
            codes = np.frombuffer(codes.as_buffer(), np.uint64).view(np.int64)
            counts = _totals(codes, counts.as_buffer())
            for k in range(0, len(codes), 65536):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[k : k + 65536]), pa.array(counts[k : k + 65536])], ["code", "n"]
                )


def trained(parts: pa.Table) -> Model:
    """The filter of one slice from its items, a row for each order, with as many bits as they need."""
    events = sum(
        int(levels(_totals(codes, counts.as_buffer()), LEAST[order]).sum())
        for order, codes, counts in zip(
            parts["order"].to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for x in parts["codes"]), parts["counts"], strict=True
        )
    )
    words = max(1, -(-events * EVENT_BITS // 64))
    bits = np.frombuffer(_filled(words, 1, LEAST)(parts)["bits"][0].as_buffer(), np.uint64)
    first = pc.equal(parts["order"], 1)
    return Model(bits, 1, LEAST, pc.sum(parts["total"].filter(first)).as_py(), pc.sum(parts["items"].filter(first)).as_py())


_ANSWERED = "block long, slice int, order int, levels binary, counts binary, total long, distinct long"


def _answered(table: pa.Table) -> pa.Table:
    """One slice: its filter is made, and probed for what each block asks of it.

    A block gets a row for each order: the levels of its items, and of words the exact counts. A row without
    a block has the totals of the slice.
    """
    number = table["slice"][0].as_py()
    asked, parts = {}, []
    for order in (1, 2):
        own = table.filter(pc.equal(table["order"], order))
        codes = [np.empty(0, np.uint64), *(_restored_codes(_numbers(x.as_buffer(), np.uint64)) for x in own["codes"])]
        counts = [np.empty(0, np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x in own["counts"])]
        asked[order] = own["block"].to_pylist(), np.cumsum([len(x) for x in codes]), np.concatenate(codes)
        learned = np.concatenate(counts)
        held = learned > 0
        part = {"codes": [asked[order][2][held].tobytes()], "counts": [learned[held].tobytes()]}
        parts.append(_added(pa.table({"order": [order], "slice": [number], **part})))
    held = pa.concat_tables(parts)
    model = trained(held)
    rows: list[tuple] = [(None, number, 0, None, None, model.total, model.distinct)]
    for order, (blocks, cuts, codes) in asked.items():
        distinct, at = np.unique(codes, return_inverse=True)
        level = model.level(distinct, order).astype(np.uint8)[at]
        exact = _exact(held, distinct)[at] if order == 1 else None
        for block, begin, end in zip(blocks, cuts, cuts[1:], strict=False):
            counts = _planes(exact[begin:end]) if order == 1 else None
            rows.append((block, number, order, level[begin:end].tobytes(), counts, None, None))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["block", "slice", "order", "levels", "counts", "total", "distinct"]
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _exact(held: pa.Table, codes: np.ndarray) -> np.ndarray:
    """Exact counts of words of a slice; 0 for those that are not held."""
    listed = pa.Table.from_batches(
        _listed(held.filter(pc.equal(held["order"], 1)).select(["codes", "counts"]).to_batches()),
        pa.schema([("code", pa.int64()), ("n", pa.int64())]),
    )
    known, n = listed["code"].to_numpy().view(np.uint64), listed["n"].to_numpy()
    found = np.zeros(len(codes), np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        found = np.where(known[place] == codes, n[place], 0)
    return found


def _log10s(words: np.ndarray, own: np.ndarray, pair: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Log10 probability of each of the tokens of texts that all end, by the counts of the tokens and of their pairs."""
    texts = max(1.0, float(own[words == END][0]))
    context = np.concatenate([[texts], own[:-1]])
    context[_before(words) == START] = texts
    single = (own + 1) / (total + distinct + 1)
    share = np.where(context > 0, np.minimum(1.0, pair / np.maximum(context, 1.0)), 0.0)
    return np.log10(WEIGHT * share + (1 - WEIGHT) * single)


def _scored(total: int, distinct: int, kind: pa.DataType):
    """A block and its answers to a row for each document; ``kind`` is the Arrow type of ``row``."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (rows,), (words,), (places,), (lengths,) = (blocks[x] for x in ("rows", "words", "places", "lengths"))
        at = _restored(places, np.uint32)
        words = _restored_codes(_restored(words, np.uint64))[at]
        _, pair_at = np.unique(pair_codes(words), return_inverse=True)
        answers = answers.sort_by("slice")  # slices are in the order of the codes
        single, double = (answers.filter(pc.equal(answers["order"], order)) for order in (1, 2))
        own, pair = (
            middle(np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in own["levels"]]).astype(np.int64), LEAST[order])
            for order, own in ((1, single), (2, double))
        )
        exact = np.concatenate([_numbers(x.as_buffer(), np.int64) for x in single["counts"]])[at]
        size = _restored(lengths, np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        scores = _log10s(words, own[at], pair[pair_at], total, distinct)
        return pa.table(
            {
                "row": rows.values.cast(kind),  # times come in the session's zone and go back in UTC
                "tokens": pa.array(size),
                "known": pa.array(np.add.reduceat((exact > 0).astype(np.int64), begin)),
                "total": pa.array(np.full(len(size), total, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10((exact + 1) / float(total + distinct + 1)), begin)),
                "score": pa.array(np.add.reduceat(scores, begin)),
            }
        )

    return run


def scored(
    df: DataFrame,
    is_training: Column,
    text: str = "text",
    carry: list[str] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    slice_tokens: int = SLICE_TOKENS,
) -> DataFrame:
    """``row, tokens, known, total, base_score, score`` for every input row.

    The model learns from the rows for which ``is_training`` holds (a null condition does not). ``row``
    holds the ``carry`` columns (default: the text), of any type but intervals of months. A null or empty text has one token, the end.
    ``known`` tokens occur in training; ``total`` is the number of all training tokens, ``base_score``
    the add-one smoothed log10 probability by exact counts of words, ``score`` that of the model. Repeated
    rows count as often as they come. An empty table gives an empty result; without training rows each
    token has probability 1. ``block_tokens`` and ``slice_tokens`` bound what one task holds at a time, not the model.
    """
    made = df.select(
        carried(carry or [text]), F.coalesce(is_training, F.lit(False)).alias("learned"), as_bytes(F.col(f"`{text}`")).alias("text")
    )
    packed = made.mapInArrow(_blocks(block_tokens), _block_type(made.schema["row"].dataType))
    blocks, _ = materialise(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    row = blocks.schema["rows"].dataType.elementType  # as read back: everything in it may be null
    size = blocks.agg(F.sum("tokens")).first()[0] or 0
    asked = blocks.select("block", "lengths", "learned", "words", "places").mapInArrow(
        _asked(max(8, -(-size // slice_tokens))), _ASKED
    )
    answers, _ = materialise(asked.groupBy("slice").applyInArrow(_answered, _ANSWERED), "answers")
    sums = answers.filter("block is null").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    numbers = [StructField(x, LongType()) for x in ("tokens", "known", "total")]
    return (
        blocks.drop("learned", "tokens")
        .groupBy("block")
        .cogroup(answers.filter("block is not null").drop("total", "distinct").groupBy("block"))
        .applyInArrow(
            _scored(sums["total"] or 0, sums["distinct"] or 0, to_arrow_type(row)),
            StructType([StructField("row", row), *numbers, StructField("base_score", DoubleType()), StructField("score", DoubleType())]),
        )
    )
