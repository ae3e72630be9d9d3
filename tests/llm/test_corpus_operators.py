"""Phrases, MinHash copies and whitening against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import messy, words

from millrace.llm import double_array, minhash, phrases, whitening

pytestmark = pytest.mark.filterwarnings("ignore")


# Phrases


def plain_collocations(rows, least, top=2000, longest=4):
    """The contract, phrase by phrase."""
    upper, signs = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").encode().translate(bytes.maketrans(upper, upper.lower()))
        for sign in signs:
            text = text.replace(bytes([sign]), b"\n")
        for piece in text.split(b"\n"):
            own = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
            totals[lang] += len(own)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    found = []
    for lang, f in counts.items():
        kept = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            longer = [
                b for other, b in f.items() if len(other) > len(phrase) and b >= least
                and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
            ]
            if longer and 100 * max(longer) >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, b" ".join(phrase), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def some_texts(seed, rows=120):
    draw = random.Random(seed)
    vocabulary = ["the", "New", "york", "city", "hall", "Ünïc", "of", "x", "日本", "a", "\x1f", "é"]
    for k in range(rows):
        text = ""
        for _ in range(draw.randrange(60)):
            text += draw.choice(["new york city hall", "of the", draw.choice(vocabulary)]) + draw.choice([" ", " ", "\t", "  ", ". ", "\n", "\r", ", "])
        yield text, draw.choice(["en", "en", "de", None, "und", ""])


@pytest.mark.parametrize("group", [1 << 19, 7])
def test_phrases_as_the_plain_count(spark, group, monkeypatch):
    """Also with tries too small for all candidates, texts cut into small chunks, and codes sent early."""
    if group == 7:
        monkeypatch.setattr(phrases, "CHUNK", 16)
        monkeypatch.setattr(phrases, "POSITIONS", 32)
        monkeypatch.setattr(phrases, "TALLY", 64)
    rows = list(some_texts(1))
    df = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text STRING, lang STRING, f INT, phrase INT").repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(df, least=5, group=group).collect())
    assert found == plain_collocations(rows, 5) and len(found) > 20


def test_phrases_of_messy_rows(spark):
    df = messy(spark)
    rows = [(r.text, r.lang) for r in df.select("text", "lang").collect()]
    found = sorted(tuple(r) for r in phrases.collocations(df, least=3).collect())
    assert found == plain_collocations(rows, 3) and found
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df, least=10**9).count() == 0


def test_equal_scores_go_by_bytes_and_the_top_is_a_limit(spark):
    rows = [("b c. é f. a b. " * 4, "en")]
    df = spark.createDataFrame(rows, "text STRING, lang STRING")
    found = sorted(tuple(r) for r in phrases.collocations(df, least=2, top=2).collect())
    assert found == plain_collocations(rows, 2, top=2) and len(found) == 2


@pytest.mark.parametrize("vocabulary,many,length", [(3, 10, 2), (400, 2000, 3), (70_000, 3000, 1), (1, 1, 1)])
def test_tries_find_every_sequence(vocabulary, many, length):
    draw = random.Random(vocabulary)
    word = lambda: b"w%d" % int(vocabulary * draw.random() ** 2)
    sequences = list({(draw.choice([b"en", b"de"]), *(word() for _ in range(length))) for _ in range(many)})
    trie = double_array.build([list(s) for s in sequences])
    at = {s: k for k, s in enumerate(sequences)}
    text = [word() for _ in range(3000)]
    for language in (b"en", b"de"):
        first = int(trie.numbers([language])[0])
        if first >= 0:
            found = trie.found(first, trie.numbers(text), length)
            assert found.tolist() == [at.get((language, *text[i : i + length]), -1) for i in range(len(text))]
    assert double_array.build([]).numbers([b"x"]).tolist() == [-1]


# MinHash


def plain_copies(texts, percent=85, width=5):
    """Number of shingles and root of each text, by all pairs."""
    sets = []
    for text in texts:
        own = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]
        sets.append({tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [len(s) for s in sets], [top(k) for k in range(len(texts))]


def families(seed, bases=6, size=25):
    """Copies of some texts with few to many changed words."""
    draw = random.Random(seed)
    texts = []
    for b in range(bases):
        base = [f"b{b}w{draw.randrange(400)}" for _ in range(draw.choice([4, 9, 60, 300]))]
        for _ in range(size):
            changed = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                changed[draw.randrange(len(changed))] = f"n{draw.randrange(10**9)}"
            texts.append(" ".join(changed))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("cap,tokens", [(minhash.CAP, minhash.TOKENS), (6, minhash.TOKENS), (minhash.CAP, 700)])
def test_copies_are_those_of_all_pairs(spark, cap, tokens):
    """Small bounds send components to their buckets and buckets to pairs of blocks; no link is lost."""
    texts = families(cap)
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "doc_id LONG, text STRING, node INT, mark INT")
    found = {r.row.doc_id: (r.n_shingles, r.component) for r in minhash.near_copies(df, cap=cap, tokens=tokens).collect()}
    sizes, roots = plain_copies(texts)
    assert found == {k: (sizes[k], roots[k]) for k in range(len(texts))}
    assert 10 < len(set(roots)) < len(texts) - 10


def test_a_chain_beside_its_star_is_whole(spark):
    """Neighbours of a chain are linked though the ends have little in common."""
    parts = [f"p{k}" for k in range(400)]
    texts = [" ".join(parts[k : k + 200]) for k in range(0, 200, 10)]
    df = spark.createDataFrame([(50 - k, t) for k, t in enumerate(texts)], "doc_id LONG, text STRING")
    found = {r.row.doc_id: r.component for r in minhash.near_copies(df, cap=3).collect()}
    assert set(found.values()) == {50 - len(texts) + 1}


def test_copies_of_messy_rows(spark):
    df = messy(spark)
    found = [(r.row.doc_id, r.n_shingles, r.component) for r in minhash.near_copies(df).collect()]
    ids, texts = zip(*df.select("doc_id", "text").collect(), strict=True)
    sizes, roots = plain_copies(texts)
    lowest = {}
    for k, root in enumerate(roots):
        lowest.setdefault(root, []).append(ids[k])
    lowest = {root: min((i for i in group if i is not None), default=None) for root, group in lowest.items()}
    expected = [(ids[k], sizes[k], lowest[roots[k]]) for k in range(len(ids))]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert minhash.near_copies(df.limit(0)).count() == 0


def test_bins_agree_as_often_as_sets_do():
    draw = np.random.default_rng(3)
    for size in (7, 40, 3000):
        shares = []
        for _ in range(60 if size < 1000 else 20):
            pool = draw.integers(0, 2**63, size + size // 6, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[-size:])
            same = minhash.signature(a) == minhash.signature(b)
            shares.append(same.mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(shares)) < 0.05, size


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, component INT, x STRING, n INT")


def plain_whitening(kept):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in kept]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[a - s / n for a, s in zip(row, sums, strict=True)] for row in x])
    return deviations, centred, centred.T @ centred / n


def test_whitening_against_a_full_decomposition(spark):
    draw = np.random.default_rng(5)
    data = (draw.standard_normal((400, 12)) @ draw.standard_normal((12, 12))).astype(np.float32)
    data[7] = data[6]
    rows = [(k, [float(c) for c in v], 1, "x", 2) for k, v in enumerate(data)]
    odd = [(900, None, 1, "x", 2), (901, [1.0] * 11 + [float("nan")], 1, "x", 2), (902, [None] * 12, 1, "x", 2),
           (903, [float("inf")] * 12, 1, "x", 2), (904, [], 1, "x", 2), (905, [1.0], 1, "x", 2)]
    deviations, centred, covariance = plain_whitening(data)
    values = np.linalg.eigvalsh(covariance)[::-1]
    for parts in (1, 5):
        found = whitening.whitened(vectors(spark, rows + odd).repartition(parts), most=8).collect()
        assert len(found) == 400 * 8 and {r.n for r in found} == {400}
        assert all(r.deviation == deviations[r.row.vec_id] for r in found)
        assert max(r.identity_error for r in found) < 1e-9
        white = np.zeros((400, 8))
        for r in found:
            white[r.row.vec_id, r.component - 1] = r.whitened
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        assert np.abs(white.T @ white / 400 - np.eye(8)).max() < 1e-9
        # The projection's residual vanishes: the directions are eigenvectors.
        directions = np.linalg.lstsq(centred, white, rcond=None)[0]
        assert np.abs(covariance @ directions - directions * values[:8]).max() < 1e-7 * values[0]


def test_whitening_of_few_equal_and_no_vectors(spark):
    same = [(k, [1.5, 2.5], 1, "x", 2) for k in range(4)]
    assert whitening.whitened(vectors(spark, same)).count() == 0
    assert whitening.whitened(vectors(spark, same[:1])).count() == 0
    empty = whitening.whitened(vectors(spark, []))
    assert empty.count() == 0 and empty.columns == whitening.whitened(vectors(spark, same)).columns
    two = whitening.whitened(vectors(spark, [*same, (9, [3.0, 0.0], 1, "x", 2)])).collect()
    assert {r.component for r in two} == {1} and len(two) == 5  # one direction has no spread
    large = whitening.whitened(vectors(spark, [(1, [1e9, 0.0], 1, "x", 2), (2, [-1e9, 1.0], 1, "x", 2)]))
    with pytest.raises(Exception, match="CAST_OVERFLOW|NUMERIC_VALUE_OUT_OF_RANGE"):
        large.filter("deviation > 0").collect()


@pytest.mark.parametrize(
    "matrix",
    [np.eye(20) * 3, np.diag([5.0] * 6 + [3.0] * 6 + [0.0] * 8), np.ones((9, 9)), np.array([[2.0]]),
     np.diag([1.0, 1 + 1e-13, 1 - 1e-13, 0.5])],
)
def test_equal_and_close_eigenvalues(matrix):
    values, units = whitening.leading_pairs(matrix, 32)
    exact = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == (exact > 1e-10 * exact[0]).sum()
    assert np.allclose(values, exact[: len(values)], rtol=1e-12)
    assert np.abs(matrix @ units - units * values).max() < 1e-12 * exact[0]
    assert np.abs(units.T @ units - np.eye(len(values))).max() < 1e-12


def test_counts_of_the_spectrum():
    draw = np.random.default_rng(1)
    a = draw.standard_normal((30, 30))
    a += a.T
    diagonal, off = whitening.tridiagonal(a)
    exact = np.linalg.eigvalsh(a)
    for shift in draw.uniform(exact[0] - 1, exact[-1] + 1, 50):
        assert whitening.count_below(diagonal, off, shift) == (exact < shift).sum()
