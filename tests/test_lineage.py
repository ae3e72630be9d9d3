from __future__ import annotations

import random
from collections import Counter, defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.lineage import audits, catalog, edges, graph, runs, versions
from millrace.plans import declared
from millrace.sources import facts

DAY = datetime(2024, 1, 1)


# Declared steps


@pytest.fixture(scope="module")
def declared_edges(spark):
    direct = declared.column_edges(spark)
    return direct.unionByName(edges.indirect_edges(declared.job_outputs(spark), declared.job_keys(spark)))


def _counts(declared_edges):
    found = declared_edges.groupBy("job", "version", "subtype").count().collect()
    return {(row[0], row[1], row[2]): row[3] for row in found}


def test_declared_edges(declared_edges):
    assert _counts(declared_edges) == {
        ("projections", "1", "IDENTITY"): 3,
        ("expressions", "1", "IDENTITY"): 1,
        ("expressions", "1", "TRANSFORMATION"): 6,
        ("aggregations", "1", "IDENTITY"): 1,
        ("aggregations", "1", "AGGREGATION"): 4,
        ("aggregations", "1", "GROUP_BY"): 6,
        ("joins", "1", "IDENTITY"): 8,
        ("joins", "1", "JOIN"): 32,
        ("schema", "1", "IDENTITY"): 3,
        ("schema", "2", "IDENTITY"): 4,
        ("schema", "3", "IDENTITY"): 3,
        ("summary", "1", "IDENTITY"): 2,
        ("summary", "2", "IDENTITY"): 2,
        ("summary", "2", "TRANSFORMATION"): 1,
        ("summary", "3", "IDENTITY"): 2,
        ("summary", "3", "TRANSFORMATION"): 2,
        ("summary", "3", "JOIN"): 8,
        ("repeated", "1", "IDENTITY"): 1,
        ("repeated", "1", "AGGREGATION"): 1,
        ("repeated", "1", "JOIN"): 6,
        ("repeated", "1", "GROUP_BY"): 3,
        ("chain_join", "1", "IDENTITY"): 6,
        ("chain_join", "1", "JOIN"): 12,
        ("chain_metrics", "1", "IDENTITY"): 1,
        ("chain_metrics", "1", "AGGREGATION"): 3,
        ("chain_metrics", "1", "GROUP_BY"): 5,
        ("chain_mart", "1", "IDENTITY"): 4,
        ("chain_mart", "1", "TRANSFORMATION"): 2,
        ("chain_mart", "1", "SORT"): 5,
        ("drift", "1", "IDENTITY"): 3,
        ("drift", "1", "FILTER"): 3,
        ("drift", "2", "IDENTITY"): 4,
        ("drift", "2", "JOIN"): 8,
        ("drift", "2", "FILTER"): 4,
        ("drift", "3", "IDENTITY"): 2,
        ("drift", "3", "TRANSFORMATION"): 1,
        ("drift", "3", "FILTER"): 3,
    }


def test_declared_columns_are_those_of_the_flows(spark, database):
    """The declarations name the columns the flows really write, last version of each."""
    from millrace.plans import flows

    flows.load_generated(spark, database)
    flows.stage_customers(spark, database)
    flows.customer_stats(spark, database)
    flows.enriched_orders(spark, database)
    flows.schema_history(spark, database)
    flows.summary_versions(spark, database)
    flows.repeated_totals(spark, database, 1)
    flows.country_mart(spark, database)
    latest = {step.output: set(step.columns) for step in declared.STEPS}
    for output in set(latest) - {"events_parquet"}:
        assert set(spark.table(f"{database}.{output}").columns) == latest[output], output


def test_job_io(spark, rows):
    found = rows(catalog.job_io_counts(declared.job_io(spark)).where("job IN ('joins', 'summary')"))
    assert found == [("joins", "1", 3, 1), ("summary", "1", 1, 1), ("summary", "2", 1, 1), ("summary", "3", 2, 1)]


def test_longest_column_path(spark, rows):
    found = graph.column_sources(declared.column_edges(spark)).where("out_dataset = 'mart_top_countries'")
    assert rows(found.select("out_column", "in_dataset", "in_column", "subtype", "hops")) == [
        ("country", "raw_customers", "country", "IDENTITY", 3),
        ("orders_count", "tmp_country_metrics", "orders_count", "IDENTITY", 1),
        ("revenue", "raw_orders", "amount", "AGGREGATION", 3),
        ("revenue_per_customer", "raw_customers", "id", "AGGREGATION", 3),
        ("revenue_per_customer", "raw_orders", "amount", "AGGREGATION", 3),
        ("unique_customers", "raw_customers", "id", "AGGREGATION", 3),
    ]


def test_mart_without_written_steps(spark, rows):
    """Steps kept as views leave one edge from the mart to each raw table."""
    hidden = spark.createDataFrame([("tmp_orders_with_customer",), ("tmp_country_metrics",)], "dataset STRING")
    found = graph.without_hidden(declared.dataset_edges(spark), hidden).where("out_dataset = 'mart_top_countries'")
    assert rows(found) == [("mart_top_countries", "raw_customers"), ("mart_top_countries", "raw_orders")]


def test_dataset_graph_of_the_mart(spark, rows):
    start = spark.createDataFrame([("mart_top_countries",)], "dataset STRING")
    found = graph.upstream(declared.dataset_edges(spark), starts=start)
    assert rows(found.select("upstream", "hops")) == [
        ("raw_customers", 3),
        ("raw_orders", 3),
        ("tmp_country_metrics", 1),
        ("tmp_orders_with_customer", 2),
    ]


# Graphs against brute force


def _graph(seed, nodes=14, links=22):
    """Random links with cycles, self-links and diamonds."""
    draw = random.Random(seed)
    return sorted({(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(links)})


def _distances(links, depth):
    out = defaultdict(list)
    for a, b in links:
        out[a].append(b)
    found = []
    for start in {a for a, _ in links}:
        hops, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            for following in out[node]:
                if following not in hops and hops[node] < depth:
                    hops[following] = hops[node] + 1
                    queue.append(following)
        found += [(start, node, n) for node, n in hops.items() if node != start]
    return sorted(found, key=repr)


@pytest.mark.parametrize(("seed", "depth"), [(1, 1), (1, 2), (2, 3), (3, 5), (3, 6), (4, 50)])
def test_upstream(spark, rows, seed, depth):
    links = _graph(seed)
    facts_ = spark.createDataFrame(links, facts.DATASET_EDGES)
    wanted = _distances(links, depth)
    assert rows(graph.upstream(facts_, depth)) == wanted
    starts = spark.createDataFrame([("n1",), ("n2",), ("n2",), ("absent",)], "dataset STRING")
    assert rows(graph.upstream(facts_, depth, starts)) == [row for row in wanted if row[0] in ("n1", "n2")]


def test_downstream_turns_the_edges(spark, rows):
    links = _graph(5)
    turned = _distances([(b, a) for a, b in links], 4)
    assert rows(graph.downstream(spark.createDataFrame(links, facts.DATASET_EDGES), 4)) == turned


def test_deeper_walks_find_more(spark, rows):
    df = spark.createDataFrame(_graph(6), facts.DATASET_EDGES)
    shallow, deep = rows(graph.upstream(df, 2)), rows(graph.upstream(df, 3))
    assert set(shallow) < set(deep)


def test_long_chains_are_followed_to_their_end(spark, rows):
    """Thirty edges, without a depth: every walk ends by itself."""
    chain = [(f"t{k:02}", f"t{k + 1:02}") for k in range(30)]
    links = spark.createDataFrame(chain, facts.DATASET_EDGES)
    start = spark.createDataFrame([("t00",)], "dataset STRING")
    assert rows(graph.upstream(links, starts=start)) == [("t00", f"t{k:02}", k) for k in range(1, 31)]
    columns = [("j", "1", a, "c", b, "c", "DIRECT", "IDENTITY") for a, b in chain]
    assert rows(graph.column_sources(spark.createDataFrame(columns, facts.COLUMN_EDGES))) == [
        ("t00", "c", "t30", "c", "IDENTITY", 30)
    ]
    hidden = spark.createDataFrame([(f"t{k:02}",) for k in range(1, 30)], "dataset STRING")
    assert rows(graph.without_hidden(links, hidden)) == [("t00", "t30")]


def test_graph_of_a_node_holds_jobs_and_data_sets(spark, rows):
    io = [("load", "1", "INPUT", "raw"), ("load", "1", "OUTPUT", "stage"), ("load", "2", "OUTPUT", "stage"),
          ("sum", "1", "INPUT", "stage"), ("sum", "1", "OUTPUT", "mart")]
    found = graph.lineage_graph(
        spark.createDataFrame(io, facts.JOB_IO), spark.createDataFrame([("stage", "DATASET")], "id STRING, type STRING")
    )
    assert rows(found) == [
        ("stage", "load", "JOB", "UPSTREAM", 1), ("stage", "mart", "DATASET", "DOWNSTREAM", 2),
        ("stage", "raw", "DATASET", "UPSTREAM", 2), ("stage", "sum", "JOB", "DOWNSTREAM", 1),
    ]


def test_only_the_last_version_has_edges(spark, rows):
    old = ("j", "1", "out", "c", "raw_a", "x", "DIRECT", "IDENTITY")
    new = ("j", "2", "out", "c", "raw_b", "x", "DIRECT", "IDENTITY")
    versions = spark.createDataFrame([("j", "1", 5), ("j", "2", 7), ("j", "1", 6)], "job STRING, version STRING, ts INT")
    kept = edges.latest_edges(spark.createDataFrame([old, new], facts.COLUMN_EDGES), versions)
    assert rows(graph.column_sources(kept)) == [("out", "c", "raw_b", "x", "IDENTITY", 1)]


def test_an_event_delivered_twice_counts_once(spark):
    event = (1, 1, "j", "1", "START", None)
    events = spark.createDataFrame([event, event], facts.RUN_EVENTS)
    assert runs.fold_events(runs.different_events(events)).first().events == 1


def test_empty_graph(spark):
    empty = spark.createDataFrame([], facts.DATASET_EDGES)
    assert graph.upstream(empty).count() == 0
    assert graph.without_hidden(empty, spark.createDataFrame([], "dataset STRING")).count() == 0
    assert graph.column_sources(spark.createDataFrame([], facts.COLUMN_EDGES)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_without_hidden(spark, rows, seed):
    links = _graph(seed)
    hidden = {f"n{i}" for i in range(0, 14, 2)}
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
    wanted = set()
    for start in set(out) - hidden:
        seen, queue = set(), deque(out[start])
        while queue:
            node = queue.popleft()
            if node in seen:
                continue
            seen.add(node)
            if node in hidden:
                queue.extend(out[node])
            else:
                wanted.add((start, node))
    names = spark.createDataFrame([(name,) for name in hidden], "dataset STRING")
    found = rows(graph.without_hidden(spark.createDataFrame(links, facts.DATASET_EDGES), names))
    assert found == sorted(wanted, key=repr)


@pytest.mark.parametrize(("seed", "raws_fewer"), [(1, True), (2, False), (7, True)])
def test_column_sources(spark, rows, seed, raws_fewer):
    """Layers with diamonds; few raw columns make the walk begin at the other end."""
    draw = random.Random(seed)
    widths = [3, 5, 5, 8] if raws_fewer else [8, 5, 5, 3]
    strength = dict(zip(facts.DIRECT_SUBTYPES, (1, 2, 3)))
    links = sorted(
        {
            (level, draw.randrange(widths[level]), level - 1, draw.randrange(widths[level - 1]), draw.choice(facts.DIRECT_SUBTYPES))
            for level in (1, 2, 3)
            for _ in range(14)
        }
    )
    df = spark.createDataFrame(
        [("j", "1", f"d{a}", f"c{b}", f"d{c}", f"c{d}", "DIRECT", s) for a, b, c, d, s in links]
        + [("j", "1", "d3", "c0", "other", "key", "INDIRECT", "JOIN")],
        facts.COLUMN_EDGES,
    )
    written, read = {(a, b) for a, b, *_ in links}, {(c, d) for _, _, c, d, _ in links}
    step = defaultdict(set)
    for a, b, c, d, s in links:
        step[a, b].add((c, d, strength[s]))
    best = {}
    for mart in written - read:
        queue = deque([(mart, 0, 0)])
        while queue:
            node, worst, hops = queue.popleft()
            for c, d, s in step[node]:
                state = (mart, (c, d), max(worst, s))
                if (c, d) not in written and hops + 1 < best.get(state, 99):
                    best[state] = hops + 1
                queue.append(((c, d), max(worst, s), hops + 1))
    wanted = sorted(
        (
            (f"d{m[0]}", f"c{m[1]}", f"d{r[0]}", f"c{r[1]}", facts.DIRECT_SUBTYPES[s - 1], hops)
            for (m, r, s), hops in best.items()
        ),
        key=repr,
    )
    assert rows(graph.column_sources(df)) == wanted


def test_column_cycle_ends(spark, rows):
    def edge(out, into, subtype):
        return ("j", "1", *out.split("."), *into.split("."), "DIRECT", subtype)

    df = spark.createDataFrame(
        [
            edge("m.a", "x.a", "IDENTITY"),
            edge("x.a", "y.a", "IDENTITY"),
            edge("y.a", "x.a", "AGGREGATION"),
            edge("x.a", "raw.a", "IDENTITY"),
        ],
        facts.COLUMN_EDGES,
    )
    assert rows(graph.column_sources(df)) == [
        ("m", "a", "raw", "a", "AGGREGATION", 4),
        ("m", "a", "raw", "a", "IDENTITY", 2),
    ]


# Edges


def _edges(spark, pairs):
    return spark.createDataFrame(
        [("j", "1", "out", f"o{o}", "in", f"i{i}", "DIRECT", "IDENTITY") for o, i in pairs], facts.COLUMN_EDGES
    )


@pytest.mark.parametrize(("outputs", "inputs"), [(2, 5), (20, 5), (500, 100)])
def test_dataset_form_and_back(spark, rows, outputs, inputs):
    """The same shape for 10 and for 50,000 pairs: a row for each output column."""
    df = _edges(spark, [(o, i) for o in range(outputs) for i in range(inputs)] * 2)
    form = edges.to_dataset_form(df)
    assert form.columns == ["out_dataset", "in_dataset", "out_column", "pairs"]
    assert [row[0] for row in form.select(F.size("pairs")).collect()] == [inputs] * outputs
    assert rows(edges.from_dataset_form(form)) == rows(df.select(*edges.EDGE).distinct())


def test_indirect_edges_follow_repeated_facts_once(spark):
    outputs, keys = declared.job_outputs(spark), declared.job_keys(spark)
    once = edges.indirect_edges(outputs, keys).count()
    assert edges.indirect_edges(outputs.union(outputs), keys.union(keys)).count() == once


def test_fan_in(spark, declared_edges, rows):
    found = edges.fan_in(declared_edges).where("out_dataset = 'mart_top_countries'")
    assert rows(found.select("out_column", "edges", "direct", "indirect", "transformation")) == [
        ("country", 2, 1, 1, 0),
        ("orders_count", 2, 1, 1, 0),
        ("revenue", 2, 1, 1, 0),
        ("revenue_per_customer", 3, 2, 1, 2),
        ("unique_customers", 2, 1, 1, 0),
    ]


# Versions


def _fields(spark, history, name="t"):
    return spark.createDataFrame(
        [
            ("ns", name, version, pos, field, "string")
            for version, fields in history.items()
            for pos, field in enumerate(fields.split())
        ],
        facts.SCHEMA_FIELDS,
    )


STAGE = {1: "id name email", 2: "id name email country", 3: "id full_name country"}


def test_schema_history(spark, rows):
    df = _fields(spark, STAGE)
    found = versions.schema_history(df.union(df)).select("version", F.array_join("fields", " "))
    assert rows(found) == list(STAGE.items())


def test_wide_schema_continues_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(versions, "FIELDS_PER_ROW", 2)
    found = versions.schema_history(_fields(spark, {1: "a b c d e"})).select("part", F.array_join("fields", " "))
    assert rows(found) == [(0, "a b"), (1, "c d"), (2, "e")]


def test_schema_changes_and_rename(spark, rows):
    changes = versions.schema_changes(_fields(spark, STAGE))
    assert rows(changes.select("version", "change", "field")) == [
        (2, "added", "country"),
        (3, "added", "full_name"),
        (3, "dropped", "email"),
        (3, "dropped", "name"),
    ]
    sources = {"id": "id", "name": "name", "email": "email", "full_name": "name", "country": "country"}
    upstream = spark.createDataFrame(
        [("ns", "t", field, source) for field, source in sources.items()],
        "namespace STRING, name STRING, field STRING, source STRING",
    )
    assert rows(versions.renamed_fields(changes, upstream)) == [("ns", "t", 3, "name", "name", "full_name")]


def test_retyped_fields(spark, rows):
    """A changed type is a change, and no rename; the first of several types counts, a null is a type of its own."""
    facts_of = {1: {"a": "int", "b": "int", "c": None, "d": "int"}, 2: {"a": "string", "b": "int", "c": "int", "e": "int"}}
    found = [("ns", "t", v, p, f, kind) for v, fs in facts_of.items() for p, (f, kind) in enumerate(fs.items())]
    found += [("ns", "t", 1, 1, "b", "string"), ("ns", "t", 2, 1, "b", "long")]
    changes = versions.schema_changes(spark.createDataFrame(found, facts.SCHEMA_FIELDS))
    assert rows(changes.select("version", "change", "field")) == [
        (2, "added", "e"), (2, "dropped", "d"), (2, "retyped", "a"), (2, "retyped", "c"),
    ]
    upstream = spark.createDataFrame(
        [("ns", "t", field, "s") for field in "acde"], "namespace STRING, name STRING, field STRING, source STRING"
    )
    assert rows(versions.renamed_fields(changes, upstream)) == [("ns", "t", 2, "s", "d", "e")]


@pytest.mark.parametrize("span", [1, 2, 3, 4096])
def test_changes_across_spans_and_gaps(spark, rows, monkeypatch, span):
    monkeypatch.setattr(versions, "SPAN", span)
    draw = random.Random(span)
    numbers = sorted(draw.sample(range(1, 40), 12))
    history = {n: " ".join(draw.sample("a b c d e f".split(), 3)) for n in numbers}
    wanted = []
    for before, now in zip(numbers, numbers[1:]):
        old, new = set(history[before].split()), set(history[now].split())
        wanted += [(now, "added", f) for f in new - old] + [(now, "dropped", f) for f in old - new]
    found = versions.schema_changes(_fields(spark, history).union(_fields(spark, {5: "x"}, "other")))
    assert rows(found.select("version", "change", "field")) == sorted(wanted, key=repr)


# Runs


def _events(spark, events):
    return spark.createDataFrame(
        [(i, run, "job", "v", state, DAY + timedelta(seconds=second)) for i, (run, state, second) in enumerate(events)],
        facts.RUN_EVENTS,
    )


EVENTS = [
    (1, "START", 0), (1, "COMPLETE", 5), (2, "START", 1), (2, "FAIL", 4), (3, "START", 2), (4, "COMPLETE", 9),
    (5, "START", 3), (5, "COMPLETE", 3), (6, "RUNNING", 1), (6, "START", 2),
]


def test_run_states(spark, rows):
    states = runs.run_states(runs.fold_events(_events(spark, EVENTS)))
    assert rows(states.select("run_id", "state", "duration_us", "events")) == [
        (1, "COMPLETE", 5_000_000, 2),
        (2, "FAIL", 3_000_000, 2),
        (3, "START", 0, 1),
        (4, "COMPLETE", 0, 1),
        (5, "COMPLETE", 0, 2),
        (6, "START", 0, 2),
    ]
    assert rows(runs.failed_runs(states).select("run_id")) == [(2,)]


def test_folds_can_be_merged_in_any_order(spark, rows):
    events = _events(spark, EVENTS * 3)
    whole = rows(runs.run_states(runs.fold_events(events)))
    for split in ("event_id % 2 = 0", "event_id < 7", "run_id = 1", "true"):
        parts = [runs.fold_events(events.where(split)), runs.fold_events(events.where(f"NOT ({split})"))]
        merged = runs.merge_folds(parts[1].union(parts[0]))
        assert rows(runs.run_states(merged)) == whole
        assert rows(runs.run_states(runs.merge_folds(merged))) == whole


def test_one_version_many_runs(spark, rows):
    events = spark.createDataFrame(
        [(i, i, "repeated", "v1", "START", DAY) for i in range(5)]
        + [(10 + i, 10 + i, "changing", f"v{i}", "START", DAY) for i in range(3)]
        + [(20, 20, "single", "v", "START", DAY)],
        facts.RUN_EVENTS,
    )
    assert rows(runs.versions_per_job(events)) == [
        ("changing", 3, 3, "many versions"),
        ("repeated", 1, 5, "one version, many runs"),
        ("single", 1, 1, "one version, one run"),
    ]
    assert rows(runs.runs_per_job(events)) == [("changing", 3), ("repeated", 5), ("single", 1)]


# Catalog and audits


def test_catalog(spark, rows):
    jobs = spark.createDataFrame(
        [("ns", "app.customer_summary", "a"), ("ns", "app.totals", "a"), ("ns", "app", "a"), ("other", "x.summary", None)],
        facts.JOBS,
    )
    io = spark.createDataFrame([("app.customer_summary", "1", "INPUT", "t")], facts.JOB_IO)
    events = _events(spark, [(1, "START", 0)]).withColumn("job", F.lit("app.totals"))
    assert rows(catalog.jobs_in(jobs, "ns", "summary")) == [("app.customer_summary",)]
    assert rows(catalog.jobs_in(jobs, "ns")) == [("app",), ("app.customer_summary",), ("app.totals",)]
    assert rows(catalog.placeholder_jobs(jobs, io, events)) == [("app",), ("x.summary",)]
    assert rows(catalog.jobs_per_application(jobs)) == [("a", 3)]


def test_freshness(spark, rows):
    expected = spark.createDataFrame([("n", "a"), ("n", "b"), ("n", "c"), ("n", "d")], "namespace STRING, name STRING")
    updates = spark.createDataFrame(
        [("n", "a", DAY), ("n", "b", DAY - timedelta(days=1)), ("n", "b", DAY + timedelta(days=1)),
         ("n", "c", DAY - timedelta(seconds=1)), ("m", "d", DAY)],
        facts.DATASETS,
    )
    found = audits.freshness(expected, updates, DAY).select("name", "state")
    assert rows(found) == [("a", "fresh"), ("b", "fresh"), ("c", "stale"), ("d", "missing")]


def test_events_are_dropped_whole(spark, rows):
    df = spark.createDataFrame(
        [(1, "ok://a"), (1, "ok://b"), (2, "ok://a"), (2, "bad,ns"), (3, None), (3, ""), (3, "also,bad"), (3, "and,bad")],
        "event_id INT, namespace STRING",
    )
    assert rows(audits.accepted_events(df)) == [(1, "ok://a"), (1, "ok://b")]
    assert rows(audits.rejections(df)) == [("empty", 1), ("illegal", 2), ("missing", 1)]


def test_collisions(spark, rows):
    names = ["k://b,a", "k://a,b", "k://a,b", "k://a+b", "x?", "x&", "alone"]
    df = spark.createDataFrame([(n,) for n in names], "namespace STRING")
    assert rows(audits.collisions(df)) == [("k://a+b", 3), ("x_", 2)]


def test_subtype_counts(declared_edges):
    found = {(r.job, r.subtype): r.edges for r in edges.subtype_counts(declared_edges).collect()}
    assert found["joins", "JOIN"] == 32
    assert Counter(job for job, _ in found)["expressions"] == 2
