from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import documents, messy, words
from pyspark.sql import functions as F

from millrace.llm import links, lm_score, mixing, pieces, queries, simhash, text, url_filter

pytestmark = pytest.mark.filterwarnings("ignore")


def test_rows_have_places(spark, folder):
    """Scans are not written again, other frames are; the place of a row stays."""
    spark.range(100).repartition(4).write.parquet(folder)
    scan = spark.read.parquet(folder).withColumn("more", F.col("id") * 2).filter("id > 3")
    both = text.identified(scan, scan=True)
    assert both.columns == ["id", "more", "_file", "_place"] and both.count() == both.select("_file", "_place").distinct().count() == 96
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in text.identified(scan, scan=True).collect()}
    joined = text.identified(scan.crossJoin(spark.range(3).select(F.col("id").alias("k"))))
    assert joined.count() == joined.select("_file", "_place").distinct().count() == 3 * 96


# URL filters


def test_urls_against_every_rule(spark):
    rules = [("block", "net/"), ("block", "example.com/de/"), ("allow", "example.net/en/"), ("allow", "org/fr/"),
             ("block", "example.net/en/bad"), ("allow", "b.c"), ("block", "b.c")]
    draw = random.Random(1)
    hosts = ["a.example.net", "EXAMPLE.net", "notexample.net", "x.org", "org", "example.com", "b.c", "a.b.c", "net", "e.net:80"]
    paths = ["", "/", "/en/", "/en", "/en/bad1", "/en/x/y", "/fr/1", "/de/2", "//en/", "/EN/"]
    urls = [f"http://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '?q=/en/', '#/fr/'])}" for _ in range(400)]
    urls += [None, "", "no scheme/en/", "://", "https://", "a://b://net/"]
    df = spark.createDataFrame([(u, "clash", 1) for u in urls], "url STRING, host STRING, row INT")
    found = url_filter.judged(df, [r for v, r in rules if v == "block"], [r for v, r in rules if v == "allow"], rules_at_once=3)

    def expected(url):
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = rest[:end].lower(), rest[end:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = []
        for verdict, rule in rules:
            of, slash, under = rule.partition("/")
            if ("." + host).endswith("." + of) and path.startswith(slash + under):
                fits.append((of.count("."), len(slash + under), verdict == "block", rule))
        best = max(fits, default=None)
        return host, path, best and best[3], "allow" if best is None or not best[2] else "block"

    for row in found.collect():
        assert (row.host, row.path, row.rule, row.verdict) == expected(row.row.url), row
    assert urlsplit(urls[0]).scheme == "http"
    assert url_filter.judged(df.limit(0), ["net/"], []).count() == 0


# SimHash


def fingerprint(value) -> int:
    own = words((value or "").encode().lower().decode())
    spans = [b" ".join(own[k : k + 3]) for k in range(len(own) - 2)] or ([b" ".join(own)] if own else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in spans) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(spans))


def test_fingerprints_and_spark_hashes(spark):
    df = messy(spark).filter("doc_id IS NULL OR doc_id <> 5")
    found = df.select("text", simhash.hex_digits(simhash.fingerprint("text")).alias("digits")).collect()
    for row in found:
        assert row.digits == f"{fingerprint(row.text):016x}"
    spans = spark.createDataFrame([("one two three",)], "s STRING").select(F.xxhash64("s")).first()[0]
    assert spans % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(tuple(range(64)), 3)
    assert len(masks) == 15
    draw = random.Random(2)
    for _ in range(3000):
        difference = sum(1 << bit for bit in draw.sample(range(64), 3))
        assert any(not mask & difference for mask in masks)
    assert all(30 <= mask.bit_count() <= 36 for mask in masks)


@pytest.mark.parametrize("cap", [1024, 4, 1])
def test_near_links_lose_nothing(spark, cap):
    """Small caps send buckets down the levels; the components stay those of all pairs."""
    draw = random.Random(cap)
    fps = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(25):
            base ^= sum({1 << draw.randrange(64) for _ in range(draw.choice([1, 2, 3, 4]))})
            fps.add(base)
    fps |= {0, 7, 15, 2**64 - 1}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    found = links.components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp LONG"), 3, cap))
    root = {x: x for x in signed} | {r.node: r.root for r in found.collect()}
    parent = {x: x for x in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                one, two = top(signed[i]), top(signed[j])
                parent[max(one, two)] = min(one, two)
    assert root == {x: top(x) for x in signed}


def test_components_of_chains_hubs_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3), (61, 60)]
    found = links.components(spark.createDataFrame(pairs, "p LONG, q LONG"))
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(1, 62)} | {(k, 1000) for k in range(1001, 1100)}
    assert links.components(spark.createDataFrame([], "p LONG, q LONG")).count() == 0


def test_copies_of_messy_rows(spark):
    df = messy(spark)
    found = simhash.near_copies(df).collect()
    assert len(found) == df.count()
    texts = df.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in texts if r.doc_id != 5]
    near = [(a ^ b).bit_count() <= 3 for a in prints for b in prints]
    assert any(near)
    by_id = {}
    for row in found:
        by_id.setdefault(row.row.doc_id, set()).add(row.component)
    assert by_id[2] == by_id[3] == by_id[4] == {2}  # no words: fingerprint zero
    assert 1 in by_id[None] and 2 in by_id[None] and by_id[5] == {5}
    kept = simhash.without_copies(df)
    assert kept.columns == df.columns
    kept = [r.doc_id for r in kept.collect()]
    assert len(kept) == len({r.root for r in found})
    assert 2 in kept and not {3, 4} & set(kept)  # one of the rows without words
    assert simhash.near_copies(df.limit(0)).count() == 0


# Mixing


def best_sum(sizes, counts, budget):
    reach = {0}
    for size, count in zip(sizes, counts, strict=True):
        reach = {s + size * k for s in reach for k in range(count + 1)}
    return min(abs(s - budget) for s in reach)


def test_fit_is_as_near_as_a_full_search_allows():
    draw = np.random.default_rng(3)
    for _ in range(1000):
        sizes = np.sort(draw.choice(np.arange(1, 30), draw.integers(1, 5), replace=False))
        counts = draw.integers(1, 4, len(sizes))
        budget = int(draw.integers(0, int(sizes @ counts) + 1))
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int(sizes @ taken) - budget) == best_sum(sizes, counts, budget)
    sizes, counts = np.arange(1, 400), np.full(399, 50)
    for budget in (1, 12345, 1_234_567, 3_900_001):
        assert int(sizes @ mixing.fit(sizes, counts, budget, exact=5000)) == budget
    # Sizes far above what the programme holds: none or one comes nearest.
    assert mixing.fit([10**9], [3], 5 * 10**8 + 1).tolist() == [1] and mixing.fit([10**9], [3], 5 * 10**8 - 1).tolist() == [0]
    assert mixing.fit([3, 10**9], [5, 3], 15 * 10**8).tolist() in ([5, 1], [5, 2])


def test_mix_reaches_its_targets_and_repeats(spark):
    draw = random.Random(4)
    rows = [(k, " ".join(["w"] * draw.randrange(0, 60)), "en", draw.choice(["a", "a", "a", "b", "é", None])) for k in range(900)]
    df = documents(spark, rows).unionByName(messy(spark).filter("doc_id <> 5 OR doc_id IS NULL"))
    found = mixing.mix(df, mixing.word_count("text"), carry=["doc_id", "source"]).collect()
    assert len(found) == df.count()
    total = sum(r.size for r in found)
    by_source = {}
    for r in found:
        assert 0 <= r.copies <= 3
        by_source.setdefault(r.row.source, []).append(r)
    sources = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(r.size for r in by_source[s]) for s in sources}
    target, open_, left = {}, set(sources), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= share
    for s in sources:
        assert by_source[s][0].source_size == size[s]
        assert by_source[s][0].target == pytest.approx(target[s])
        assert abs(sum(r.size * r.copies for r in by_source[s]) - target[s]) <= 12
    again = mixing.mix(df.repartition(7), mixing.word_count("text"), carry=["doc_id", "source"]).collect()
    assert Counter((r.row.doc_id, r.size, r.copies) for r in again) == Counter((r.row.doc_id, r.size, r.copies) for r in found)
    taken = mixing.mixed_rows(df, size=mixing.word_count("text"))
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in found)
    copies = mixing.mix(df, mixing.word_count("text"), carry=["doc_id", "text", "source"]).collect()
    wanted = Counter()
    for r in copies:
        wanted[tuple(r.row)] += r.copies
    assert Counter(tuple(r) for r in taken.select("doc_id", "text", "source").collect()) == +wanted
    assert mixing.mixed_rows(df.limit(0), size=mixing.word_count("text")).count() == 0
    assert mixing.mix(df.limit(0), mixing.word_count("text")).count() == 0


def test_components_of_documents_are_those_of_all_pairs(spark):
    draw = random.Random(8)
    rows = []
    for base in range(8):
        words_ = [f"b{base}w{draw.randrange(500)}" for _ in range(draw.choice([0, 2, 40, 200]))]
        for _ in range(12):
            changed = list(words_)
            for _ in range(draw.choice([0, 1, 2, 5])):
                if changed:
                    changed[draw.randrange(len(changed))] = f"n{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed), "en", "s"))
    prints = [fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    found = {r.row.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_copies(documents(spark, rows)).collect()}
    assert found == {k: (prints[k], top(k)) for k in range(len(rows))}
    kept = sorted(r.doc_id for r in simhash.without_copies(documents(spark, rows)).collect())
    assert kept == sorted({top(k) for k in range(len(rows))}) and 1 < len(kept) < len(rows)


# Pieces


MODEL = Path(queries.model_file())
needs_model = pytest.mark.skipif(not MODEL.exists(), reason="no vocabulary file here")


@needs_model
def test_pieces_equal_the_library_and_come_back(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    texts = ["  a  b", "a\nb", "a\n b ", "", " ", "\ta <s> 日本語😀\x00z", "<0x41>", "x" * 500, " " * 40, "⁇ � é́", None]
    texts += [r.text for r in messy(spark).collect()]
    df = spark.createDataFrame([(t, 1) for t in texts], "text STRING, ids INT")
    found = pieces.encoded(df, str(MODEL))
    for row in found.collect():
        assert row.ids == library.encode(row.row.text or "")
    back = pieces.decoded(found, str(MODEL), carry=["row"])
    for row in back.collect():
        assert row.text == (row.row.row.text or "").replace("▁", " ")
    assert pieces.encoded(df.limit(0), str(MODEL)).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([None, -1, 10**9],)], "ids ARRAY<INT>")
    assert [r.text for r in pieces.decoded(odd, str(MODEL)).collect()] == [None, "", ""]


def test_unigram_search_finds_the_best_sum():
    draw = random.Random(5)
    alphabet = ["<unk>", *"ab▁", *{"".join(draw.choice("ab▁") for _ in range(draw.randrange(2, 5))) for _ in range(12)}]
    scores = [0.0, *[-draw.random() * 5 - 1 for _ in alphabet[1:]]]
    vocabulary = pieces.Vocabulary(pieces.UNIGRAM, alphabet, scores, [pieces.UNKNOWN, *[pieces.NORMAL] * (len(alphabet) - 1)], True)
    encoder = pieces.Encoder(vocabulary)
    of = dict(zip(alphabet[1:], scores[1:], strict=True))

    def best(value):
        states = [0.0] + [-math.inf] * len(value)
        for end in range(1, len(value) + 1):
            for begin in range(end):
                piece = value[begin:end]
                score = of.get(piece, encoder.lowest if len(piece) == 1 else None)
                if score is not None:
                    states[end] = max(states[end], states[begin] + score)
        return states[-1]

    for _ in range(100):
        value = "".join(draw.choice("aabb  c") for _ in range(draw.randrange(1, 20)))
        ids, lengths = encoder.encode([value])
        assert lengths.tolist() == [len(ids)]
        total = sum(scores[i] if i else encoder.lowest for i in ids)
        marked = "▁" + value.replace(" ", "▁")
        assert total == pytest.approx(best(marked) if encoder.across else sum(best(w) for w in encoder.marked(value)))


# Language model


def test_scores_against_exact_counts(spark):
    draw = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=draw.randrange(0, 80))), "en", "s") for k in range(400)]
    rows += [(1000 + k, rows[k][1], "en", "s") for k in range(50)]
    df = documents(spark, rows).unionByName(messy(spark))
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    found = lm_score.scored(df, training, carry=["doc_id", "text"]).collect()
    assert len(found) == df.count()
    counts, pairs, contexts = Counter(), Counter(), Counter()

    def tokens(value):
        return [*words((value or "").encode().lower().decode()), None]

    for r in df.select("doc_id", "text").collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            own = tokens(r.text)
            counts.update(own)
            pairs.update(zip([0, *own[:-1]], own, strict=True))
            contexts.update([0, *own[:-1]])
    n, v = sum(counts.values()), len(counts)
    difference = []
    for r in found:
        own = tokens(r.row.text)
        assert (r.tokens, r.known, r.total) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        exact = 0.0
        for before, w in zip([0, *own[:-1]], own, strict=True):
            pair = pairs[before, w] if pairs[before, w] >= lm_score.LEAST_PAIR else 0
            share = pair / contexts[before] if contexts[before] else 0.0
            exact += math.log10(lm_score.WEIGHT * share + (1 - lm_score.WEIGHT) * (counts[w] + 1) / (n + v + 1))
        difference.append((r.score - exact) / len(own))
    assert abs(np.mean(difference)) < 0.05 and np.abs(difference).max() < 0.5
    assert lm_score.scored(df.limit(0), training).count() == 0


def test_pairs_seen_once_are_held_however_the_filter_is_cut(spark):
    # 2,000 documents of words of their own: every pair is seen once, or twice where a held-out copy is scored.
    rows = [(k, " ".join(f"w{(k * 31 + j) % 1999}x{k % 7 * j}" for j in range(8)), "en", "s") for k in range(2000)]
    df = documents(spark, rows + [(5000 + k, rows[k][1], "en", "s") for k in range(100)]).repartition(3)
    training = F.col("doc_id") < 5000
    counts, pairs, contexts = Counter(), Counter(), Counter()
    for _, value, *_ in rows:
        own = [0, *value.split(), None]
        counts.update(own[1:])
        pairs.update(zip(own, own[1:], strict=False))
        contexts.update(own[:-1])
    n, v = sum(counts.values()), len(counts)
    assert sum(k == 1 for k in pairs.values()) > 0.5 * len(pairs)

    def exact(value):
        own = [0, *value.split(), None]
        return sum(
            math.log10(lm_score.WEIGHT * pairs[a, b] / contexts[a] + (1 - lm_score.WEIGHT) * (counts[b] + 1) / (n + v + 1))
            for a, b in zip(own, own[1:], strict=False)
        )

    plain = lm_score.scored(df, training, carry=["doc_id", "text"])
    cut = lm_score.scored(df, training, carry=["doc_id", "text"], block_tokens=300, slice_tokens=500)
    held = []
    for found in (plain, cut):
        found = {r.row.doc_id: r for r in found.collect()}
        assert len(found) == 2100
        difference = [(r.score - exact(r.row.text)) / r.tokens for r in found.values()]
        assert abs(np.mean(difference)) < 0.03 and np.abs(difference).max() < 0.3
        held.append({k: (r.row.text, r.tokens, r.known, r.total, round(r.base_score, 9)) for k, r in found.items()})
    assert held[0] == held[1]


def test_scored_rows_carry_columns_of_any_type(spark):
    df = spark.range(30).selectExpr(
        "id", "concat('a b ', id % 3) text", "timestamp'2024-03-10 12:30:00' at", "map(id, named_struct('q', id, 'z', null)) m",
        "if(id = 3, null, cast(1.5 as decimal(38, 10))) d", "cast(X'ff00c3' as string) malformed", "array(id, null) a",
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = lm_score.scored(df, F.col("id") % 5 != 2, carry=df.columns, block_tokens=40)
        kept = F.to_json(F.struct("id", "text", "at", "m", "d", F.hex("malformed"), "a"))
        expected = sorted(r[0] for r in df.select(kept).collect())
        assert sorted(r[0] for r in found.select("row.*").select(kept).collect()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_filter_has_no_false_negatives_and_few_false_positives():
    draw = np.random.default_rng(7)
    codes = draw.integers(0, 2**64, 20_000, dtype=np.uint64)
    counts = draw.geometric(0.3, len(codes)).astype(np.uint32)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    events = int(lm_score.levels(counts.astype(np.int64), 1).sum())
    size = -(-events * lm_score.EVENT_BITS // 64 // 4)
    import pyarrow as pa

    bits = np.zeros(size * 4, np.uint64)
    place = lm_score._slice_of(codes, 4)
    for k in range(4):
        own = place == k
        part = pa.table({"slice": [k], "order": [1], "codes": [codes[own].tobytes()], "counts": [counts[own].tobytes()]})
        bits[k * size : (k + 1) * size] = np.frombuffer(lm_score._filled(size, 4, {1: 1})(part)["bits"][0].as_py(), np.uint64)
    model = lm_score.Model(bits, 4, {1: 1, 2: 2}, 1, 1)
    found = model.count(codes, 1)
    true = lm_score.middle(lm_score.levels(counts.astype(np.int64), 1), 1)
    assert (found >= true - 1e-9).all() and (found > true + 1e-9).mean() < 0.05
    other = draw.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert (model.count(other, 1) > 0).mean() < 0.05


def test_totals_above_32_bits_are_exact():
    codes = np.array([3, 9], np.uint64)
    block = {
        "order": pa.array([1, 1], pa.int32()),
        "slice": pa.array([0, 0], pa.int32()),
        "codes": pa.array([codes.tobytes()] * 2, pa.binary()),
        "counts": pa.array([np.array([2**32 - 1, 5], np.uint32).tobytes()] * 2, pa.binary()),
    }
    added = lm_score._added(pa.table(block))
    assert added["total"].to_pylist() == [2 * (2**32 - 1) + 10]
    (found,) = lm_score._listed(iter(added.select(["codes", "counts"]).to_batches()))
    assert found.to_pydict() == {"code": [3, 9], "n": [2 * (2**32 - 1), 10]}


def test_repeated_windows_and_lines():
    draw = random.Random(8)
    for _ in range(200):
        own = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(0, 40))]
        seen = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        marked = {k + j for k in range(len(own) - 4) if seen[tuple(own[k : k + 5])] > 1 for j in range(5)}
        assert text.repeated_window_words(own) == len(marked)
    assert text.duplicate_lines(b"a\nb\na\n\n \n \na ") == 1
