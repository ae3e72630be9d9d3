"""Phrases whose words stand together more often than their parts would have it.

Level by level: words are counted first; the frequent ones are the candidates of length 1. For each
length the candidates go to the workers as double-array tries by broadcast, and every worker advances
the states of all positions of its texts at once; the accepting states, added up by ``bincount``, are the
counts of the candidates. The same pass finds the candidates of the next length: a sequence seen in a
text whose two parts without the last and without the first word are candidates of this length. Its
next word is carried as a hash; hashes that meet only add candidates, whose counts come from the tries,
by the words themselves. So every count is exact.

A trie holds at most ``group`` candidates (and about ``GROUP_BYTES`` of words). More candidates are dealt
by hash over several tries, each broadcast and searched in a job of its own, and the counts are added up;
that bounds what is broadcast at any size. Workers tally up to ``TALLY`` codes before they send them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import double_array
from millrace.llm.text import as_bytes, hashes
from millrace.workspace import materialise

#: Candidates and bytes of words of one trie.
GROUP, GROUP_BYTES = 1 << 19, 64 << 20
#: Bytes of text that are gathered by language, and that are cut into words at once.
GATHER, CHUNK = 16 << 20, 2 << 20
#: Positions that are searched at once, and codes that are held.
POSITIONS, TALLY = 1 << 20, 1 << 21
#: Bits of a code that hold the hash of the next word; 0 there stands for the candidate itself.
NEXT_BITS = 40
NEXT_MASK = (1 << NEXT_BITS) - 1
#: Parts that a language's phrases are ranked in.
PARTS = 64
UNDETERMINED = "und"

_SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: What stands for no word and for the end of a piece among the words of a text.
_NONE, _END = b"", b"\n"


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts as numbers, and the words numbered; 1 ends a piece, and 0 does not occur."""
    numbered = defaultdict(count().__next__)
    numbered[_NONE], numbered[_END]
    made = []
    for text in texts:
        text = text.translate(_SIGNS).replace(b"\n", b" \n ")
        start = 0
        while start < len(text):
            end = text.find(b" ", start + CHUNK)
            end = len(text) if end < 0 else end
            cut = text[start:end].split(b" ")
            found = np.fromiter(map(numbered.__getitem__, cut), np.int32, len(cut))
            made.append(found[found > 0])
            start = end
        made.append(np.ones(1, np.int32))
    return np.concatenate(made) if made else np.zeros(0, np.int32), list(numbered)


def _next_hashes(words: list[bytes]) -> np.ndarray:
    """The low bits of the hash that Spark's ``xxhash64`` has, but never 0."""
    return np.maximum(1, hashes(words, len(words)).astype(np.int64) & NEXT_MASK)


def _texts_by_language(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts of a batch by language, at most about ``GATHER`` bytes at once besides one longer text."""
    gathered: dict[bytes, list[bytes]] = defaultdict(list)
    held: Counter[bytes] = Counter()
    for language, text in zip(batch.column(0), batch.column(1), strict=True):
        name = language.as_buffer().to_pybytes()
        gathered[name].append(text.as_buffer().to_pybytes())
        held[name] += len(gathered[name][-1])
        if held[name] > GATHER:
            yield name, gathered.pop(name)
            held[name] = 0
    yield from gathered.items()


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, text`` to ``lang, word, f``: counts of the texts of one task."""
    tally: dict[bytes, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for language, words in tally.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(words), pa.binary()), pa.array(list(words), pa.binary()),
                 pa.array(list(words.values()), pa.int64())],
                ["lang", "word", "f"],
            )
        tally.clear()

    for batch in batches:
        for language, texts in _texts_by_language(batch):
            numbers, words = word_numbers(texts)
            found = np.bincount(numbers, minlength=len(words))
            tally[language].update(dict(zip(words[2:], found[2:].tolist(), strict=True)))
            if sum(map(len, tally.values())) > TALLY // 8:
                yield from sent()
    yield from sent()


class _Codes:
    """Counts of codes, merged when they become many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged = 0

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            self.parts.append(np.unique(codes, return_counts=True))
            self.held += len(self.parts[-1][0])

    def full(self) -> bool:
        if self.held > 2 * max(self.merged, TALLY // 4):
            self.merge()
        return self.held > TALLY

    def merge(self) -> None:
        codes, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.parts = [(codes[firsts], np.add.reduceat(counts, firsts))]
        self.held = self.merged = len(firsts)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.merge()
            for codes, counts in self.parts:
                yield _rows(codes, counts)
        self.parts, self.held, self.merged = [], 0, 0


def _rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["code", "f"]
    )


def _searched(broadcast, length: int, alone: bool, last: bool):
    """Rows ``lang, text`` to ``code, f``: counts of candidates and of what may be one of the next length.

    ``alone`` says that the trie has all candidates of its length, so a part that it lacks is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = double_array.Trie(*broadcast.value)
        accepted = np.zeros(trie.sequences, np.int64)
        seen = _Codes()
        for batch in batches:
            for language, texts in _texts_by_language(batch):
                first = int(trie.numbers([language])[0])
                if first < 0:
                    continue
                numbers, words = word_numbers(texts)
                symbols = trie.numbers(words)
                symbols[:2] = -1
                symbols = symbols[numbers]
                if not last:
                    next_words = _next_hashes(words)
                    next_words[:2] = 0
                for start in range(0, len(numbers), POSITIONS):
                    stop = min(start + POSITIONS, len(numbers))
                    # One position more, for the part without the first word.
                    found = trie.found(first, symbols[start : stop + length], length)
                    own = found[: stop - start]
                    accepted += np.bincount(own[own >= 0], minlength=trie.sequences)
                    if last:
                        continue
                    at = np.flatnonzero(own >= 0)
                    at = at[at + start + length < len(numbers)]
                    after = next_words[numbers[at + start + length]]
                    fits = after > 0
                    if alone:
                        fits &= found[at + 1] >= 0
                    seen.add(own[at[fits]].astype(np.int64) << NEXT_BITS | after[fits])
                if seen.full():
                    yield from seen.sent()
        yield from seen.sent()
        some = np.flatnonzero(accepted)
        yield _rows(some << NEXT_BITS, accepted[some])

    return run


def _trie_of(candidates: DataFrame) -> tuple[double_array.Trie, pa.Table]:
    """The trie of one group of candidates ``lang, phrase``, and the group numbered as its trie numbers it."""
    rows = candidates.select(F.col("lang").cast("binary"), F.col("phrase").cast("binary")).toArrow()
    sequences = [
        [language, *phrase.split(b" ")]
        for language, phrase in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)
    ]
    return double_array.build(sequences), rows.append_column("id", pa.array(np.arange(len(rows)), pa.int64()))


def _level(
    texts: DataFrame, candidates: DataFrame, length: int, rows: int, words: DataFrame, least: int, last: bool, group: int
) -> tuple[DataFrame, DataFrame | None]:
    """Counts ``lang, phrase, f`` of the frequent candidates, and the candidates of the next length."""
    spark = texts.sparkSession
    size = candidates.agg(F.sum(F.octet_length("phrase"))).first()[0]
    groups = max(-(-rows // group), -(-size // GROUP_BYTES))
    counted, longer = [], []
    for k in range(groups):
        trie, numbered = _trie_of(candidates.filter(F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups)) == k))
        sent = spark.sparkContext.broadcast(trie.parts())
        search = _searched(sent, length, groups == 1, last)
        sums = texts.mapInArrow(search, "code long, f long").groupBy("code").agg(F.sum("f").alias("f"))
        sums, _ = materialise(sums.filter(F.col("f") >= least), "codes")
        of = spark.createDataFrame(numbered).select(
            F.col("lang").cast("string"), F.col("phrase").cast("string"), "id"
        )
        of, _ = materialise(of, "candidates")
        sent.unpersist()
        coded = sums.select(
            F.shiftrightunsigned("code", NEXT_BITS).alias("id"), F.col("code").bitwiseAND(NEXT_MASK).alias("next"), "f"
        )
        counted.append(coded.filter("next = 0").join(of, "id").select("lang", "phrase", "f"))
        if not last:
            after = coded.filter("next <> 0").join(of, "id").join(words, ["lang", "next"])
            longer.append(after.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase")))

    def joined(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole

    return joined(counted), None if last else joined(longer)


def frequent_phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, group: int = GROUP
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, f`` of every phrase found ``least`` times or more, and ``lang, n`` of all words."""
    texts = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).cast("binary").alias("lang"), as_bytes(text).alias("text")
    )
    words = texts.mapInArrow(_words_counted, "lang binary, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words, _ = materialise(words.select(F.col("lang").cast("string"), F.col("word").cast("string"), "f"), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))

    next_hash = F.greatest(F.xxhash64("word").bitwiseAND(NEXT_MASK), F.lit(1).cast("long"))
    hashed = words.filter(F.col("f") >= least).select("lang", "word", "f", next_hash.alias("next"))
    frequent, rows = materialise(hashed, "frequent")
    found = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("length"), "f")
    candidates, next_words = frequent.select("lang", F.col("word").alias("phrase")), frequent.select("lang", "word", "next")
    for length in range(1, longest + 1):
        if not rows:
            break
        counts, candidates = _level(
            texts, candidates, length, rows, next_words, least, length == longest, group
        )
        if length > 1:
            found = found.union(counts.select("lang", "phrase", F.lit(length).alias("length"), "f"))
        if candidates is not None:
            candidates, rows = materialise(candidates, "candidates")
    return materialise(found, "phrases")[0], totals


def _part(first: Column, many: Column) -> Column:
    """``many`` words of a phrase from the one at position ``first`` (from 1)."""
    return F.array_join(F.slice(F.split("phrase", " "), first, many), " ")


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 30,
    longest: int = 4,
    top: int = 2000,
    cover: int = 80,
    group: int = GROUP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of each language.

    A-Z is lower-cased; ``.,;:!?`` and line ends cut a text into pieces, spaces and tabs cut these into
    words. A phrase of 2 to ``longest`` words found ``least`` times or more scores, at its weakest cut (of
    equal ones the first), ``floor(2000000 a / (l + r))``. One that a longer phrase contains, found at least
    ``cover`` in a hundred times as often, is dropped. Equal scores go by ``a``, then by the bytes of the phrase.

    A null text is empty, a null language is ``und``; texts without a frequent phrase add to ``n`` alone.
    Repeated rows count as often as they occur, other columns are not read, and an empty table gives an
    empty result. Texts of any length are searched whole: they are cut into words in chunks.
    """
    found, totals = frequent_phrases(df, text, lang, least, longest, group)
    phrases = found.filter("length > 1")
    # Both parts of every cut as rows, so one join brings all their counts.
    cut = phrases.select(
        "lang", "phrase", F.col("f").alias("a"), "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    )
    first = F.struct(F.lit(True).alias("first"), _part(F.lit(1), F.col("k")).alias("part"))
    rest = F.struct(F.lit(False).alias("first"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("part"))
    sides = cut.select("lang", "phrase", "a", "k", F.explode(F.array(first, rest)).alias("side"))
    sides = sides.select("lang", "phrase", "a", "k", "side.first", "side.part")
    of = found.select("lang", F.col("phrase").alias("part"), "f")
    both = sides.join(of, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")
    )
    exact = "decimal(38,0)"
    score = F.expr(f"CAST(2000000 * CAST(a AS decimal(20,0)) AS {exact}) div (CAST(l AS {exact}) + CAST(r AS {exact}))")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = phrases.filter("length > 2").select(
        "lang", "phrase", "length", "f", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("many")
    )
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("many") + 1)).alias("at"))
    longer = inner.groupBy("lang", _part(F.col("at"), F.col("many")).alias("phrase")).agg(F.max("f").alias("longer"))
    wide = "CAST({} AS decimal(38,0))"
    covered = F.expr(f"100 * {wide.format('longer')} >= {cover} * {wide.format('a')}")
    left = weakest.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered)
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    # A language is ranked in parts first, so no task sees more of one than the first rows of its parts.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for group in ([F.col("lang"), part], [F.col("lang")]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= top)
    return left.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
