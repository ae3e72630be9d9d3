from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import columns
from millrace.functions.jobs import job_part, known_job, query_version
from millrace.functions.namespaces import dataset_name, dataset_namespace, namespace_fault, normalise_namespace

LEGAL = re.compile(r"[a-zA-Z0-9_@+:;=/.-]{1,1024}\Z")

# Stored namespaces and what they become.
CASES = [
    ("postgres://pg1:5432,pg2:5432", "postgres://pg1:5432+pg2:5432"),
    ("postgres://pg2:5432,pg1:5432", "postgres://pg1:5432+pg2:5432"),
    ("k://, b ,,a,/p,q", "k://a+b/p_q"),
    ("x" * 2000, "x" * 1024),
    ("kafka://b2:9092,b1:9092,b3:9092", "kafka://b1:9092+b2:9092+b3:9092"),
    ("postgres://pg1:5432", "postgres://pg1:5432"),
    ("hdfs://namenode:9000/user/hive/warehouse", "hdfs://namenode:9000/user/hive/warehouse"),
    ("s3://my-bucket", "s3://my-bucket"),
    ("oracle://(DESCRIPTION=(HOST=h1))?x=1", "oracle://_DESCRIPTION=_HOST=h1___x=1"),
    ("jdbc:weird space&sym,bols?here", "jdbc:weird_space_sym_bols_here"),
    ("a://\th2\n,h1 ", "a://h1+h2"),
    ("a://only ", "a://only_"),
    ("", ""),
    (None, None),
]


def _apply(spark, values, *expressions):
    """The expressions of every value, in the order of the values."""
    numbered = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [tuple(row)[1:] for row in sorted(numbered.select("i", *[e(F.col("v")) for e in expressions]).collect())]


def test_namespace_cases(spark):
    assert _apply(spark, [raw for raw, _ in CASES], normalise_namespace) == [(wanted,) for _, wanted in CASES]


@pytest.mark.parametrize(
    ("separator", "wanted"), [("-", "k://a-b"), ("", "k://a+b"), (None, "k://a+b"), ("|", "k://a_b")]
)
def test_namespace_separator(spark, separator, wanted):
    assert _apply(spark, ["k://b,a"], lambda v: normalise_namespace(v, separator)) == [(wanted,)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.text(min_size=1, max_size=40),
            st.lists(st.text("ab1:. (", max_size=4), min_size=1, max_size=4).map(lambda hosts: "k://" + ",".join(hosts)),
        ),
        min_size=60,
        max_size=120,
    )
)
def test_namespace_properties(spark, raw):
    raw = [text.encode("utf-8", "ignore").decode() for text in raw]
    raw = [text for text in raw if text]
    once = [row[0] for row in _apply(spark, raw, normalise_namespace)]
    assert all(LEGAL.match(text) for text in once)
    assert [row[0] for row in _apply(spark, once, normalise_namespace)] == once


def test_host_order_does_not_matter(spark):
    hosts = ["h3:1", "h1:1", "h2:1"]
    turned = [",".join(hosts[i:] + hosts[:i]) for i in range(3)]
    assert len(set(_apply(spark, [f"k://{t}/db" for t in turned], normalise_namespace))) == 1


def test_namespace_fault(spark):
    values = ["s3://b", "a,b", "", None, "x" * 1024, "x" * 1025, "line\n"]
    wanted = [None, "illegal", "empty", "missing", None, "long", "illegal"]
    assert [row[0] for row in _apply(spark, values, namespace_fault)] == wanted


def test_dataset_identity(spark):
    found = _apply(
        spark,
        ["hdfs://namenode:9000/tmp/lineage/events_parquet", "default.raw_orders", None],
        lambda v: dataset_namespace(v, "jobs"),
        dataset_name,
    )
    assert found == [("hdfs://namenode:9000", "/tmp/lineage/events_parquet"), ("jobs", "default.raw_orders"), (None, None)]


def test_job_names(spark):
    found = _apply(
        spark,
        ["unknown.app.node.db.table", "app.node.out", "app", "unknown.unknown.n.o"],
        known_job,
        *[lambda v, part=part: job_part(v, part) for part in (1, 2, 3)],
    )
    assert found == [
        ("app.node.db.table", "app", "node", "db.table"),
        ("app.node.out", "app", "node", "out"),
        ("app", "", "", ""),
        ("unknown.n.o", "unknown", "n", "o"),
    ]


def test_query_version_ignores_spacing_but_not_literals(spark):
    texts = ["SELECT a\n  FROM t", " SELECT a FROM t ", "SELECT a FROM t WHERE c = 'x  y'", "SELECT a FROM t WHERE c = 'x y'"]
    one, two, wide, narrow = (row[0] for row in _apply(spark, texts, query_version))
    assert one == two
    assert len({one, wide, narrow}) == 3


def test_email_domain(spark):
    found = _apply(spark, ["a@b.c", "a@b@c", "none", "a@", None], columns.email_domain)
    assert [row[0] for row in found] == ["b.c", "b", None, "", None]


def test_pick_is_one_based(spark):
    found = spark.range(6).select(columns.pick(("a", "b", "c"), F.col("id") % 3 + 1)).collect()
    assert [row[0] for row in found] == list("abcabc")


def test_whole_quotient_is_exact(spark):
    big = 9_007_199_254_740_993
    assert spark.range(1).select(columns.whole_quotient(F.lit(big), 1)).first()[0] == big


def test_seconds_after_does_not_depend_on_the_zone(spark, conf):
    wanted = None
    for zone in ("UTC", "America/New_York"):
        conf(spark__sql__session__timeZone=zone)
        found = spark.range(1).select(columns.seconds_after("1970-01-01 00:00:00", F.lit(1_700_000_000))).first()[0]
        assert wanted in (None, found)
        wanted = found
    assert str(wanted) == "2023-11-14 22:13:20"


def test_mean_of_nothing_is_null(spark):
    empty = spark.createDataFrame([(1, None)], "k INT, amount DOUBLE")
    assert empty.groupBy("k").agg(columns.mean(F.col("amount"))).first()[1] is None
