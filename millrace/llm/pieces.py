"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text is marked (a mark for every space and one in front) and cut into marked words, the places
that no piece of the vocabulary goes across. The distinct words of a batch are sorted, which is the
depth-first order of their trie: the search goes back to the node shared with the word before and keeps
its forward states, so a common prefix is searched once.

The state at a node is the best segmentation of the word up to there. For a unigram vocabulary that is
the largest sum of scores. For a merge vocabulary (byte-pair encoding) the scores are ranks of merges and
their sum means nothing; there a segmentation is right if and only if each pair of neighbours is what
merging the two alone gives, and a prefix has one such segmentation. So the only candidate that counts at
a node is the piece that may follow the state it starts from. Results equal the library's.
"""

from __future__ import annotations

import re
import struct
from array import array
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import as_bytes, carried

MARK = "▁"
#: Pieces that a vocabulary may have, since it is broadcast.
MAX_PIECES = 1_000_000
#: Bytes of text whose words are sorted at once; words and pairs that a worker remembers.
BATCH_BYTES, WORDS, PAIRS = 2 << 20, 200_000, 400_000
#: Characters without a piece are tokens below 0; ``START`` stands before a word.
CHARACTERS, START = 0x110000, -1 - 0x110000
#: Fixed values of the model format: kinds of model and of piece.
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary(NamedTuple):
    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    front: bool  # a mark is put in front of a text


def _fields(data: bytes):
    """Field numbers and values of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            length, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = data[at : at + length], at + length
        yield tag >> 3, value


def load(path: str) -> Vocabulary:
    """Read a model file. Only vocabularies that leave the text as it is, but for marks, are taken."""
    kind, front, pieces, scores, types = UNIGRAM, True, [], [], []
    with open(path, "rb") as file:
        data = file.read()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
            front = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                raise ValueError("the vocabulary changes texts before it cuts them")
    if kind not in (UNIGRAM, MERGES) or USER in types:
        raise ValueError("only unigram and merge vocabularies without fixed symbols are supported")
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces is too large to broadcast")
    return Vocabulary(kind, pieces, scores, types, front)


class Encoder:
    """Encodes marked words; remembers words and pairs up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.kind, self.front = vocabulary.kind, vocabulary.front
        usable = (NORMAL, UNUSED)
        self.ids = {p: k for k, (p, t) in enumerate(zip(vocabulary.pieces, vocabulary.types, strict=True)) if t in usable}
        self.pieces, self.scores = vocabulary.pieces, vocabulary.scores
        self.ends = {p[k:] for p in self.ids for k in range(len(p))}
        byte = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(vocabulary.pieces, vocabulary.types, strict=True)) if t == BYTE}
        unknown = vocabulary.types.index(UNKNOWN) if UNKNOWN in vocabulary.types else 0
        self.bytes = [byte.get(k, unknown) for k in range(256)] if byte else None
        self.unknown = unknown
        self.lowest = min((vocabulary.scores[k] for k in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self._forget()
        # A word ends where a mark follows another character, and at a line end, if no piece goes across.
        self.across = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cut = re.compile(r"(?s).+" if self.across else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _forget(self) -> None:
        """The known words and their tokens, one after the other."""
        self.words: dict[str, int] = {}
        self.tokens, self.starts = array("i"), array("q", [0])

    def marked(self, text: str) -> list[str]:
        """The marked words of a text: each a run of marks and what follows it."""
        if not text:
            return []
        if self.front and not self.across and text[0] != " " and "  " not in text and MARK not in text:
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        text = text.replace(" ", MARK)
        return self.cut.findall(MARK + text if self.front else text)

    def merged(self, text: str) -> list[int]:
        """Merge neighbours of the best score, leftmost first; a character without a piece is below 0."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                piece = self.ids.get(symbols[k] + symbols[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return [self.ids.get(s, -1 - ord(s[0])) for s in symbols]

    def _text(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-1 - token)

    def follows(self, before: int, token: int) -> bool:
        """Whether merging leaves the two pieces as they are; ``START`` comes before a word."""
        pair = [token] if before == START else [before, token]
        found = self.merged("".join(map(self._text, pair))) == pair
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[before << 32 | token + CHARACTERS] = found
        return found

    def search(self, words: list[str]) -> None:
        """Add the tokens of sorted distinct words: a walk through their trie, depth first."""
        ids, ends, pairs, scores, merges = self.ids, self.ends, self.pairs, self.scores, self.kind == MERGES
        last, start, total = [START], [0], [0.0]  # the states from the root down to the node
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, origin, score = None, 0, 0.0
                for begin in range(end - 1, -1, -1):
                    piece = word[begin:end]
                    token = ids.get(piece)
                    if token is None and begin == end - 1:
                        token = -1 - ord(piece)
                    if token is not None:
                        if merges:
                            known = pairs.get(last[begin] << 32 | token + CHARACTERS)
                            if known or (known is None and self.follows(last[begin], token)):
                                best, origin = token, begin
                                break
                        else:
                            sum_ = total[begin] + (scores[token] if token >= 0 else self.lowest)
                            if best is None or sum_ > score:
                                best, origin, score = token, begin, sum_
                    if piece not in ends:
                        break
                last.append(best)
                start.append(origin)
                total.append(score)
            before = word
            found: list[int] = []
            end = len(word)
            while end:
                token = last[end]
                if token >= 0:
                    found.append(token)
                elif self.bytes:
                    found.extend([self.bytes[b] for b in reversed(chr(-1 - token).encode("utf-8", "replace"))])
                else:
                    found.append(self.unknown)
                end = start[end]
            found.reverse()
            self.words[word] = len(self.words)
            self.tokens.extend(found)
            self.starts.append(len(self.tokens))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.words) > WORDS:
            self._forget()
        cut = [self.marked(text) for text in texts]
        words = list(chain.from_iterable(cut))
        self.search(sorted(set(words).difference(self.words)))
        places = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        tokens, starts = np.array(self.tokens, np.int32), np.array(self.starts, np.int64)
        lengths = (starts[1:] - starts[:-1])[places] if len(words) else np.empty(0, np.int64)
        ends = np.cumsum(lengths)
        shift = starts[places] - (ends - lengths)
        ids = tokens[np.repeat(shift, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(upto)


def _encoder(shared):
    """``shared`` is a broadcast dict; a worker that is used again goes on with the encoder it has put there."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        if "encoder" not in shared.value:
            shared.value["encoder"] = Encoder(Vocabulary(*shared.value["vocabulary"]))
        encoder = shared.value["encoder"]
        ids, lengths, batch, size = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], [], 0
        for k, text in enumerate(texts):
            data = text.as_buffer().to_pybytes()
            batch.append(data.decode("utf-8", "replace"))
            size += len(data)
            if size >= BATCH_BYTES or k == len(texts) - 1:
                some, counts = encoder.encode(batch)
                ids.append(some)
                lengths.append(counts)
                batch, size = [], 0
        offsets = np.cumsum(np.concatenate(lengths)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    # Else a plan that uses the ids twice, say to store and to decode them, would encode twice.
    return encode.asNondeterministic()


def surfaces(vocabulary: Vocabulary) -> list[bytes]:
    """What each id stands for in a text."""

    def one(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    return [one(p, t) for p, t in zip(vocabulary.pieces, vocabulary.types, strict=True)]


def _decoder(shared, front: bool):
    """``shared`` is a broadcast list of what each id stands for."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        table = shared.value
        texts = []
        for one in lists:
            if not one.is_valid:
                texts.append(None)
                continue
            ids = one.values.drop_null().to_numpy(zero_copy_only=False)
            ids = ids[(ids >= 0) & (ids < len(table))]
            data = b"".join(map(table.__getitem__, ids.tolist()))
            data = data[1:] if front and data[:1] == b" " else data
            texts.append(data.decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    return decode


def encoded(df: DataFrame, model: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row, ids`` for every input row; ``model`` is the path of a model file on the driver.

    ``row`` holds the ``carry`` columns (default: the text). A null or empty text has no ids. Malformed
    UTF-8 counts as replacement characters. A word of any length is encoded whole, its states being one
    for each character. Repeated rows stay; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast({"vocabulary": tuple(load(model))})
    return df.select(carried(carry or [text]), _encoder(shared)(as_bytes(F.col(f"`{text}`"))).alias("ids"))


def decoded(df: DataFrame, model: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``row, text`` for every input row: the text that the ids stand for.

    Encoding and decoding give back every well-formed text, but a mark character in it comes back as a
    space, as with the library. Null ids give a null text, no ids an empty one; null and unknown ids in a
    list are left out.
    """
    vocabulary = load(model)
    shared = df.sparkSession.sparkContext.broadcast(surfaces(vocabulary))
    return df.select(carried(carry or [ids]), _decoder(shared, vocabulary.front)(F.col(f"`{ids}`")).alias("text"))

