from __future__ import annotations

import re
import time
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from cases import PROSE, documents, messy, words
from oracle_check import difference, oracle
from pyspark.sql import functions as F

from millrace.llm import chat, counts, language_id, oracles, quality_classifier, quality_rules, queries, topk

DIRECTORY = "/root/testdata/sf0.001"


def test_quality_rules_on_messy_rows_and_outliers(spark):
    rows = [(k, PROSE + " ".join(f"word{k}x{j}" for j in range(k % 50 + 5)), "en", f"s{k % 2}") for k in range(10, 700)]
    odd = [(k, " ".join(f"w{k}{j}###" for j in range(80)), "en", "s1") for k in range(700, 705)]
    df = documents(spark, rows + odd).unionByName(messy(spark))
    found = quality_rules.judged(df, carry=["doc_id", "text"], steps=3).collect()
    assert len(found) == df.count()
    for r in found:
        own = words(r.row.text)
        assert r.counts.n_words == len(own)
        assert r.counts.word_chars == sum(len(w.decode()) for w in own)
        assert r.counts.n_symbols == sum(c in "#*$%&|<>" for c in r.row.text or "")
        failed = len(own) < 10 or 100 * r.counts.n_repeat_words > 20 * len(own)
        assert r.base_failed == failed and not (failed and r.kept)
        if r.row.doc_id is not None and 10 <= r.row.doc_id < 705:
            assert r.kept == (r.row.doc_id < 700), r
    assert quality_rules.judged(df.limit(0), steps=1).count() == 0
    few = quality_rules.judged(messy(spark), steps=1)  # too few rows for an estimate
    assert few.filter("kept = base_failed").count() == 0


def test_chi_square():
    for freedom, p, x in ((2, 0.95, 5.991), (6, 0.95, 12.592), (8, 0.75, 10.219)):
        assert quality_rules.quantile(p, freedom) == pytest.approx(x, abs=1e-3)


def test_concentration_finds_the_bulk(spark):
    draw = np.random.default_rng(9)
    bulk = draw.normal(0, 1, (3000, quality_rules.SIZE)) @ np.diag([1, 2, 0.5, 1, 3, 1])
    far = draw.normal(8, 0.1, (600, quality_rules.SIZE))
    rows = [("en", "s", *map(float, x)) for x in np.vstack([bulk, far])]
    names = [f"x{i}" for i in range(quality_rules.SIZE)]
    df = spark.createDataFrame(rows, ["lang", "source", *names])
    best = quality_rules.estimates(df, 10).filter("level = 2").first()
    assert np.abs(best.mean).max() < 0.3
    scatter = np.linalg.inv(np.array(best.inverse).reshape(quality_rules.SIZE, -1))
    assert 0.5 < scatter[0, 0] < 1.5 and 2.5 < scatter[1, 1] < 5.5


def prose(k):
    def word(n, size):
        return "".join(chr(97 + n // 26**i % 26) for i in range(size))

    return PROSE + " ".join(word(101 * k + j, 3 + j % 4) for j in range(k % 50 + 5))


def test_a_third_of_a_group_may_be_copies_of_junk(spark):
    rows = [(k, prose(k), "en", "s") for k in range(400)]
    junk = " ".join(f"w{j}###" for j in range(80))
    df = documents(spark, rows + [(k, junk, "en", "s") for k in range(400, 600)])
    found = quality_rules.judged(df, steps=5).select("row.doc_id", "base_failed", "kept").collect()
    assert not any(r.base_failed for r in found) and len(found) == 600
    assert {r.doc_id for r in found if r.kept} == set(range(400))


def test_texts_of_digits_are_outliers(spark):
    rows = [(k, prose(k), "en", "s") for k in range(400)]
    digits = [(k, " ".join(str(1000 + 37 * k + 7 * j) for j in range(60)), "en", "s") for k in range(400, 405)]
    found = quality_rules.judged(documents(spark, rows + digits), steps=5).select("row.doc_id", "base_failed", "kept").collect()
    assert not any(r.base_failed for r in found) and len(found) == 405
    assert {r.doc_id for r in found if r.kept} == set(range(400))


def test_few_rows_are_judged_by_the_estimate_of_all(spark):
    rows = [(k, prose(k), "en", f"s{k % 3}") for k in range(40)]
    odd = [(k, " ".join(f"w{k}{j}###" for j in range(80)), "en", "s1") for k in range(40, 43)]
    found = quality_rules.judged(documents(spark, rows + odd), steps=5).select("row.doc_id", "base_failed", "kept").collect()
    assert not any(r.base_failed for r in found) and len(found) == 43
    assert {r.doc_id for r in found if r.kept} == set(range(40))


def test_classifier_learns_and_shrinks(spark):
    good = [(k, PROSE * (k % 4 + 1) + f"Tail {k}.", "en", f"h{k % 7}") for k in range(100, 400)]
    bad = [(k, f"BUY!! {k} NOW!! " * (k % 4 + 2), "en", "junk" if k % 3 else "h1") for k in range(400, 520)]
    df = documents(spark, good + bad).unionByName(messy(spark))
    labels = [(k, int(k < 400), None) for k in range(100, 520, 2)] + [(None, 0, 0), (101, None, 0), (100, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    found = quality_classifier.classified(df, labels, F.col("source"), F.col("lang")).collect()
    assert len(found) == df.count()
    for r in found:
        if r.row.doc_id is not None and r.row.doc_id >= 100:
            assert r.kept == (r.row.doc_id < 400), r
        assert 0 <= r.posterior <= 1
    rates = {r.host: r.path_rate for r in found if r.row.doc_id and r.row.doc_id >= 100}
    assert rates["junk"] < rates["h2"]
    nothing = quality_classifier.classified(df, labels.limit(0), F.col("source"), F.col("lang"))
    assert nothing.filter("NOT kept").count() == 0
    assert quality_classifier.classified(df.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_top_products_against_all(spark):
    draw = np.random.default_rng(10)
    vectors = [list(map(float, x)) for x in draw.normal(0, 1, (600, 12))] + [[0.5] * 12] * 60 + [[0.25, -3.0], [], [0.0] * 12]
    rows = [(k, v, "clash") for k, v in enumerate(vectors)]
    rows += [(50, vectors[50], "again"), (None, vectors[3], "x"), (100, None, "x"), (150, [float("nan")] * 12, "x"),
             (200, [None, 1.0], "x"), (250, [float("inf")], "x")]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, number STRING")
    usable = [
        (i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), (0, 12 - len(v))))
        for i, v, _ in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    expected = []
    for at, (i, q) in enumerate(usable):
        if i is not None and i % 50 == 0:
            near = sorted((-int(q @ x), j is None, j or 0) for k, (j, x) in enumerate(usable) if k != at)[:5]
            expected += [(i, rank, None if null else j, -score) for rank, (score, null, j) in enumerate(near, 1)]
    for page in (2048, 40):
        found = topk.nearest(df, F.col("vec_id") % 50 == 0, page=page)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert topk.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.nearest(df, F.lit(False)).count() == 0


def _clusters(spark, many=1500, groups=40):
    draw = np.random.default_rng(6)
    middle = draw.normal(0, 30, (groups, 8))
    vectors = middle[np.arange(many) % groups] + draw.normal(0, 0.2, (many, 8))
    vectors[5::7] = vectors[5]  # a vector that many rows share
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(vectors)], "vec_id LONG, embedding ARRAY<FLOAT>")


def test_the_tree_covers_its_rows(spark):
    df = _clusters(spark).select(F.col("vec_id").alias("number"), F.col("vec_id").alias("id"), topk.whole_numbers("embedding").alias("v"))
    routing, pages = topk._tree(df, 1500, 8, page=20)
    nodes = {r.node: r for r in routing.collect()}
    found = defaultdict(list)
    for r in pages.collect():
        found[r.node, r.part].append(r)
    assert sorted(r.number for rows in found.values() for r in rows) == list(range(1500))
    assert len({r.parent for r in nodes.values()}) > 1  # more than one level
    for (node, part), rows in found.items():
        entry = nodes[node]
        assert 0 <= part < entry.parts and (len(rows) <= 20 or entry.radius == 0)
        for r in rows:
            distance = np.linalg.norm(np.array(r.v, float) - np.array(entry.o))
            assert distance == pytest.approx(r.distance, abs=1e-6) and r.distance <= entry.radius
            above = node  # every object on the way up covers the row
            while above:
                assert np.linalg.norm(np.array(r.v, float) - np.array(nodes[above].o)) <= nodes[above].radius + 1e-6
                above = nodes[above].parent
    for r in nodes.values():
        if r.parent:
            assert r.above == pytest.approx(np.linalg.norm(np.array(r.o) - np.array(nodes[r.parent].o)))
        assert r.node // topk.FAN - (r.node % topk.FAN == 0) == r.parent


def test_bounds_pass_pages_over(spark, monkeypatch):
    """On clustered vectors the pages that are read hold far fewer entries than there are pairs."""
    looked, sizes, plain = [], {}, topk.materialise

    def seen(df, label):
        found = plain(df, label)
        if label == "ranked":
            wave = 4 ** sum(1 for _ in looked)
            looked.append([(r.node, r.part) for r in found[0].filter(F.col("rank") <= wave).collect() if r.part >= 0])
        if label == "pages":
            sizes.update({(r.node, r.part): r["count"] for r in found[0].groupBy("node", "part").count().collect()})
        return found

    monkeypatch.setattr(topk, "materialise", seen)
    df = _clusters(spark)
    hits = topk.nearest(df, F.col("vec_id") % 50 == 0, page=20).collect()
    read = sum(sizes[x] for wave in looked for x in wave)
    assert len(hits) == 30 * 5 and 0 < read < 0.4 * 30 * 1500
    data = {r.vec_id: np.floor(256 * np.array(r.embedding)).astype(int) for r in df.collect()}
    for r in hits:
        assert r.score == int(data[r.query_id] @ data[r.id])


@pytest.mark.parametrize(("turns", "rows"), [(256, 1024), (2, 2), (256, 3)])
def test_perspectives(spark, turns, rows):
    """Every turn stands in its place, repeated ones too, whatever the parts and pieces."""
    said = [(1, 0, "system", "Be nice."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé"), (1, 3, "cat", None), (1, 3, "ann", "yes"),
            (1, 2, "bob", "Hé"), (2, 0, "system", "alone"), (None, 5, "ann", "x"), (None, None, None, "y"),
            (4, 1, "", ""), (4, None, "ann", "again"), (4, None, "ann", "again"),
            *[(3, 7, "ann", f"t{k % 15}") for k in range(20)]]
    df = spark.createDataFrame([(*r, 1) for r in said], "conv_id LONG, turn LONG, role STRING, text STRING, part INT")
    found = defaultdict(list)
    for r in chat.rotated(df.repartition(3), turns=turns, rows=rows).collect():
        found[r.conversation, r.perspective].append(r)
    turns_of = [(c, t, role or "unknown", text or "") for c, t, role, text in said]
    assert set(found) == {(c, role) for c, _, role, _ in turns_of if role != "system"}
    for (conversation, me), parts in found.items():
        parts.sort(key=lambda r: (r.part is None, r.part or 0, r.piece))
        order = sorted((x for x in turns_of if x[0] == conversation), key=lambda x: (x[1] is None, x[1] or 0, x[2], x[3]))
        head = {"system": "system", me: "assistant"}
        whole = "".join(r.text for r in parts)
        assert whole == "".join(f"<|im_start|>{head.get(r, f'user name={r}')}\n{t}<|im_end|>\n" for _, _, r, t in order)
        assert [r.text[s.start : s.end] for r in parts for s in r.mask] == [t for _, _, r, t in order if r == me]
        assert sum(r.n_turns for r in parts) == len(order) and all(r.n_turns <= rows or r.piece == 0 for r in parts)
    assert chat.rotated(df.limit(0)).count() == 0


def test_five_thousand_rows_in_one_turn(spark):
    said = [(1, None if k % 2 else 3, ("ann", "bob")[k % 3 % 2], f"t{k * 7919 % 4001:05}") for k in range(5000)]
    df = spark.createDataFrame(said, "conv_id LONG, turn LONG, role STRING, text STRING").repartition(5)
    order = sorted(said, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[3]))
    for me in ("ann", "bob"):
        parts = chat.rotated(df).filter(f"perspective = '{me}'").collect()
        parts.sort(key=lambda r: (r.part is None, r.part or 0, r.piece))
        assert len(parts) > 2 and max(r.n_turns for r in parts) <= chat.ROWS
        assert [r.text[s.start : s.end] for r in parts for s in r.mask] == [t for _, _, r, t in order if r == me]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a<b>c</b>d", "a c d"), ("x<script>hidden <b>y</b></SCRIPT >z", "x z"), ("<!-- c --><p>t", "  t"),
        ("<nav>open", " open"), ("a<nav>b<nav>c</nav>d", "a d"), ("1 < 2", "1 < 2"), ("a&amp;b&#39;c & d;", "a b c & d;"),
        ("<navigation>seen</navigation>", " seen "), ("a<!-- b", "a<!-- b"), ("a<!-- b > c", "a  c"), ("", ""),
        ("<style>a</styles></style>b", " b"), ("é<i>ß", "é ß"),
    ],
)
def test_visible_text(html, text):
    assert language_id.visible(html.encode()).decode() == text


@pytest.mark.parametrize("piece", ["<nav>", "<nav ", "<", "<!--", "</nav", "<script></nav>", "<html ", "&", "<nav></navx>"])
def test_long_pages_of_unclosed_tags_take_linear_time(spark, piece):
    html = piece * (5_000_000 // len(piece))
    started = time.perf_counter()
    language_id.visible(html.encode())
    assert time.perf_counter() - started < 20
    df = spark.createDataFrame([(html[:1_000_000],)], "html STRING")
    started = time.perf_counter()
    assert df.select(language_id.declared(F.col("html"))).first()[0] == ""
    assert time.perf_counter() - started < 20


def test_languages_of_pages(spark):
    english, german = PROSE, "Es war ein schöner Tag und nichts geschah in der kleinen Stadt am Fluss bis zum Mittag. "
    docs = [(k, (english if k % 2 else german) * 3, "en" if k % 2 else "de", "s") for k in range(20)]
    docs += [(90, None, "fr", "s"), (91, "x", None, "s")]

    def page(k, lang, words_):
        return (k, f"http://h{lang}.example.org/{lang}/{k}", f'<html lang="{lang}"><script>{german}</script><p>{words_}</p></html>', 1)

    pages = [page(k, "en", english) for k in range(10)] + [page(k, "de", german) for k in range(10, 20)]
    pages += [page(20, "de", ""), page(21, "en", german * 5), (22, None, None, 1), (None, "no url", "", 1), page(0, "en", english)]
    df = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING, lang INT")
    found = language_id.identified(df, documents(spark, docs)).collect()
    assert len(found) == len(pages)
    lang = {r.row.page_id: (r.text_lang, r.lang) for r in found}
    assert all(lang[k] == ("en", "en") for k in range(10)) and all(lang[k] == ("de", "de") for k in range(10, 20))
    assert lang[20][1] == "de" and lang[21] == ("de", "de")
    assert all(r.lang in ("en", "de") and 0 < r.posterior <= 1 for r in found)
    assert language_id.identified(df.limit(0), documents(spark, docs)).count() == 0
    unknown = language_id.identified(df, documents(spark, docs).limit(0))
    assert unknown.filter("lang IS NOT NULL OR posterior IS NOT NULL").count() == 0


def test_counts_of_an_empty_text():
    assert counts.count(b"") == (0,) * len(counts.FIELDS)


@pytest.mark.parametrize("name", oracles.SQL)
def test_queries_against_sql(spark, name):
    result = queries.QUERIES[name](spark, DIRECTORY)
    assert difference(result, oracle(DIRECTORY).sql(oracles.SQL[name])) is None


def test_stages_keep_the_columns_and_pass_on_what_they_keep(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").withColumns({"number": F.lit(1), "kept": F.lit("k")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIRECTORY)
        assert out.columns == columns, name
        assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    labels = spark.read.parquet(f"{DIRECTORY}/labels.parquet").filter("quality = 1")
    kept = corpus_pipeline.quality_classifier_stage(spark, docs, DIRECTORY).join(labels, "doc_id", "left_semi").count()
    assert kept >= 0.97 * docs.join(labels, "doc_id", "left_semi").count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY)
    assert ids.columns == ["doc_id", "source", "lang", "ids"] and ids.count() == docs.count()
    assert corpus_pipeline.run(spark, DIRECTORY).count() > 0



def plain_languages(docs, pages):
    """The fusion, page by page: text, declared language and suffix, then domain and host without the page itself."""
    names = sorted({lang for _, text, lang, _ in docs if lang is not None and text is not None})
    model = np.full((len(names), language_id.BUCKETS), 0.5)
    for _, text, lang, _ in docs:
        if text is not None and lang is not None:
            np.add.at(model[names.index(lang)], language_id.trigrams(text.encode()), 1)
    model = np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)

    def softmax(x):
        shares = np.exp(x - x.max())
        return shares / shares.sum()

    def sums(keys, rows):
        found = defaultdict(lambda: np.zeros(len(names)))
        for key, row in zip(keys, rows, strict=True):
            found[key] = found[key] + row
        return found

    def shrunk(own, rest, weight):
        return (own + weight * rest) / (own.sum() + weight)

    likelihood, hosts, marks, suffixes = [], [], [], []
    for _, url, html, _ in pages:
        places = language_id.trigrams(language_id.visible((html or "").encode()))
        found = np.array([row[places].sum() for row in model]) if len(places) else np.zeros(len(names))
        likelihood.append(found * min(1.0, language_id.EVIDENCE / max(1, len(places))))
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        hosts.append(rest.split("/")[0])
        mark = re.search(r"<html[^<>]*\slang=\"([a-z]+)", html or "")
        marks.append(mark[1] if mark else "")
        first = rest.split("/")[1] if rest.count("/") > 1 else ""
        suffixes.append(hosts[-1].split(".")[-1] + "/" + (first if len(first) == 2 else ""))
    by_text = [softmax(x) for x in likelihood]
    expected = sum(by_text) + 1
    prior = expected / expected.sum()
    evidence = [x.copy() for x in likelihood]
    for keys in (marks, suffixes):
        found = sums(keys, by_text)
        for k, key in enumerate(keys):
            evidence[k] += np.log((found[key] + 1) / (expected + len(found)))
    by_page = [softmax(x + np.log(prior)) for x in evidence]
    domains = [".".join(h.split(".")[-2:]) for h in hosts]
    of_host, of_domain = sums(hosts, by_page), sums(domains, by_page)
    final = []
    for k in range(len(pages)):
        wide = shrunk(np.maximum(of_domain[domains[k]] - by_page[k], 0), prior, language_id.DOMAIN_WEIGHT)
        own = shrunk(np.maximum(of_host[hosts[k]] - by_page[k], 0), wide, language_id.HOST_WEIGHT)
        final.append(softmax(evidence[k] + np.log(own)))
    return names, final


def test_languages_against_the_plain_fusion(spark):
    texts = {"en": PROSE, "de": "Es war ein schöner Tag und nichts geschah am Fluss. ", "fr": "Il faisait beau et rien ne bougeait. "}
    docs = [(k, text * 2, lang, "s") for k, (lang, text) in enumerate(texts.items())] + [(9, None, "es", "s"), (8, "x", None, "s")]
    pages = []
    for k in range(24):
        lang = ("en", "de", "fr")[k % 3]
        said = lang if k % 4 else "en"
        words_ = texts[lang] * (k % 5) if k % 7 else texts[lang][:9]
        pages.append((k, f"http://h{k % 5}.site{k % 2}.org/{said}/x{k}", f'<html lang="{said}"><p>{words_}</p></html>', 1))
    pages += [(30, None, None, 1), (31, "http://h1.site1.org/", "", 1), pages[4], pages[4]]
    names, final = plain_languages(docs, pages)
    df = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING, lang INT")
    wanted = sorted((p[0], names[int(f.argmax())], float(f.max())) for p, f in zip(pages, final, strict=True))
    found = sorted((r.row.page_id, r.lang, r.posterior) for r in language_id.identified(df, documents(spark, docs)).collect())
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert np.allclose([x[2] for x in found], [x[2] for x in wanted], rtol=1e-4)


#: Queries without SQL, and the test that holds them against a plain version, a round trip or held-out rows.
PLAIN = {
    "op2_lm_score": "test_scores_against_exact_counts",
    "op3_quality_rules": "test_quality_rules_on_messy_rows_and_outliers",
    "op4_quality_classifier": "test_classifier_learns_and_shrinks",
    "op5_sentencepiece": "test_pieces_equal_the_library_and_come_back",
    "op6_mixing": "test_mix_reaches_its_targets_and_repeats",
    "op7_language_id": "test_languages_against_the_plain_fusion",
    "op8_chat_formatting": "test_perspectives",
    "op9_simhash_dedup": "test_components_of_documents_are_those_of_all_pairs",
    "op13_whitening": "test_whitening_against_a_full_decomposition",
}


def test_every_query_is_held_against_something():
    assert set(queries.QUERIES) == set(oracles.SQL) | set(PLAIN) and not set(oracles.SQL) & set(PLAIN)
    code = "".join(path.read_text() for path in Path(__file__).parent.glob("test_*.py"))
    assert all(f"def {test}(" in code for test in PLAIN.values())
