"""The objects of the flows and the lineage facts, derived from the supplied parquet tables.

Every function takes the session and the directory of the tables and uses whole tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import label, money, pick, whole_quotient
from millrace.functions.jobs import query_version
from millrace.plans import staging
from millrace.sources.facts import DIRECT, DIRECT_SUBTYPES
from millrace.sources.tables import table

# Fields that a schema of the derived schema history can have.
SCHEMA_WIDTH = 200
RUN_START = datetime(1998, 1, 1)
JOB_NAMESPACE = "warehouse"


def customers(spark: SparkSession, directory: str) -> DataFrame:
    customer, nation = table(spark, directory, "customer"), table(spark, directory, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("country"),
    )


def orders(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("order_ts"),
    )


def exact_orders(spark: SparkSession, directory: str) -> DataFrame:
    """Orders with decimal amounts, for totals."""
    return orders(spark, directory).withColumn("amount", money(F.col("amount")))


def products(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def product_modulus(spark: SparkSession, directory: str) -> Column:
    """Six fifths of the number of products, so one order in six has none."""
    return products(spark, directory).agg(whole_quotient(F.count(F.lit(1)) * 6, 5)).scalar()


def batch_bounds(spark: SparkSession, directory: str) -> tuple[Column, Column]:
    """First order id of the second and of the third batch: two and four fifths of the highest id."""
    highest = F.max("order_id")
    ids = orders(spark, directory)
    return ids.agg(whole_quotient(highest * 2, 5)).scalar(), ids.agg(whole_quotient(highest * 4, 5)).scalar()


def drift_batches(spark: SparkSession, directory: str) -> list[DataFrame]:
    second, third = batch_bounds(spark, directory)
    return staging.drift_batches(orders(spark, directory), customers(spark, directory), second, third)


def run_events_of(events: DataFrame) -> DataFrame:
    """Four events make a run; signup starts it, purchase completes it, error fails it."""
    run = whole_quotient(F.col("event_id"), 4)
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "START")
        .when(kind == "purchase", "COMPLETE")
        .when(kind == "error", "FAIL")
        .otherwise("RUNNING")
    )
    query = F.concat(F.lit("SELECT *  FROM t\nWHERE k = "), F.get_json_object("props", "$.k"))
    return events.select(
        "event_id",
        run.alias("run_id"),
        label("job_", run % 20).alias("job"),
        query_version(query).alias("version"),
        state.alias("state"),
        "ts",
    )


def run_events(spark: SparkSession, directory: str) -> DataFrame:
    return run_events_of(table(spark, directory, "events"))


def job_versions(spark: SparkSession, directory: str) -> DataFrame:
    """Events as reported versions of their jobs; the same query is written with more or fewer blanks."""
    blanks = F.when(F.col("event_id") % 2 == 0, " ").otherwise("\n  ")
    return table(spark, directory, "events").select(
        label("job_", whole_quotient(F.col("event_id"), 4) % 20).alias("job"),
        label("v", F.col("event_id") % 97).alias("version"),
        F.concat(F.lit("SELECT * FROM t"), blanks, F.lit("WHERE k = "), F.get_json_object("props", "$.k")).alias("query_text"),
    )


def schema_fields(spark: SparkSession, directory: str) -> DataFrame:
    """One data set per supplier, one version per line number, a field per part bucket.

    The type of a field follows from its place and the version.
    """
    pos = F.col("l_partkey") % SCHEMA_WIDTH
    kind = F.when((pos + F.col("l_linenumber")) % 3 == 0, "bigint").otherwise("double")
    return table(spark, directory, "lineitem").select(
        F.lit(JOB_NAMESPACE).alias("namespace"),
        label("supplier_", F.col("l_suppkey")).alias("name"),
        F.col("l_linenumber").alias("version"),
        pos.cast("int").alias("pos"),
        label("c", pos).alias("field"),
        kind.alias("type"),
    )


def declared_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Upstream column of every field of the schema history: four neighbouring fields share one."""
    source = label("u", whole_quotient(F.col("pos"), 4)).alias("source")
    return schema_fields(spark, directory).select("namespace", "name", "field", source)


def datasets(spark: SparkSession, directory: str) -> DataFrame:
    """Customers as data sets; the namespace is the market segment."""
    return table(spark, directory, "customer").select(
        F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("name")
    )


def expected_datasets(spark: SparkSession, directory: str) -> DataFrame:
    return datasets(spark, directory)


def dataset_updates(spark: SparkSession, directory: str) -> DataFrame:
    """Urgent orders as updates of their customer; not every customer has one."""
    urgent = table(spark, directory, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    customer = table(spark, directory, "customer")
    return urgent.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("namespace"),
        F.col("c_name").alias("name"),
        F.col("o_orderdate").alias("updated_at"),
    )


def jobs(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as jobs of the application of their customer; the name ends in the priority."""
    order = F.col("o_orderkey").cast("string")
    return table(spark, directory, "orders").select(
        F.col("o_orderstatus").alias("namespace"),
        F.concat(F.lit("job_"), order, F.lit("."), F.lower("o_orderpriority")).alias("job"),
        label("app_", F.col("o_custkey")).alias("app_id"),
    )


def job_io(spark: SparkSession, directory: str) -> DataFrame:
    """Order lines as facts of job versions: the part is read, the supplier is written."""
    lines = table(spark, directory, "lineitem")
    key = [label("job_", F.col("l_orderkey")).alias("job"), F.col("l_linestatus").alias("version")]
    ends = F.array(
        F.struct(F.lit("INPUT").alias("role"), label("part_", F.col("l_partkey")).alias("dataset")),
        F.struct(F.lit("OUTPUT").alias("role"), label("supplier_", F.col("l_suppkey")).alias("dataset")),
    )
    return lines.select(*key, F.inline(ends))


def order_jobs(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "orders").select(label("job_", F.col("o_orderkey")).alias("job"))


def returned_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Returned order lines as run events of their job."""
    returned = table(spark, directory, "lineitem").where(F.col("l_returnflag") == "R")
    return returned.select(label("job_", F.col("l_orderkey")).alias("job"), F.col("l_shipdate").alias("ts"))


def job_outputs(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "lineitem").select(
        label("job_", F.col("l_orderkey")).alias("job"),
        F.lit("1").alias("version"),
        F.lit("mart").alias("out_dataset"),
        label("line_", F.col("l_linenumber")).alias("out_column"),
    )


def job_keys(spark: SparkSession, directory: str) -> DataFrame:
    subtype = F.when(F.col("l_linestatus") == "O", "JOIN").otherwise("GROUP_BY")
    return table(spark, directory, "lineitem").select(
        label("job_", F.col("l_orderkey")).alias("job"),
        F.lit("1").alias("version"),
        F.lit("suppliers").alias("in_dataset"),
        label("supplier_", F.col("l_suppkey")).alias("in_column"),
        subtype.alias("subtype"),
    )


def line_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Column edges from order lines: at most 7 output and 40 input columns per pair of data sets."""
    flag = F.col("l_returnflag")
    direct = F.col("l_linestatus") == "O"
    kind = F.col("l_partkey") % 3 + 1
    subtype = F.when(direct, pick(DIRECT_SUBTYPES, kind)).otherwise(pick(("JOIN", "GROUP_BY", "FILTER"), kind))
    return table(spark, directory, "lineitem").select(
        F.concat(F.lit("load_"), flag).alias("job"),
        F.lit("1").alias("version"),
        label("supplier_", F.col("l_suppkey")).alias("out_dataset"),
        label("line_", F.col("l_linenumber")).alias("out_column"),
        F.concat(F.lit("flag_"), flag).alias("in_dataset"),
        label("c", F.col("l_partkey") % 40).alias("in_column"),
        F.when(direct, DIRECT).otherwise("INDIRECT").alias("type"),
        subtype.alias("subtype"),
    )


def versioned_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Column edges from order lines whose load has a version for each line status."""
    flag = F.col("l_returnflag")
    return table(spark, directory, "lineitem").select(
        F.concat(F.lit("load_"), flag).alias("job"),
        F.col("l_linestatus").alias("version"),
        label("supplier_", F.col("l_suppkey")).alias("out_dataset"),
        label("line_", F.col("l_linenumber")).alias("out_column"),
        F.concat(F.lit("flag_"), flag).alias("in_dataset"),
        label("c", F.col("l_partkey") % 40).alias("in_column"),
        F.lit(DIRECT).alias("type"),
        F.lit(DIRECT_SUBTYPES[0]).alias("subtype"),
    )


def version_times(spark: SparkSession, directory: str) -> DataFrame:
    """When the versions of the loads ran: the ship dates of their lines."""
    return table(spark, directory, "lineitem").select(
        F.concat(F.lit("load_"), F.col("l_returnflag")).alias("job"),
        F.col("l_linestatus").alias("version"),
        F.col("l_shipdate").alias("ts"),
    )


def suppliers_in_debt(spark: SparkSession, directory: str) -> DataFrame:
    """Suppliers with a negative balance as nodes of the data set and job graph."""
    debt = table(spark, directory, "supplier").where(F.col("s_acctbal") < 0)
    return debt.select(label("supplier_", F.col("s_suppkey")).alias("id"), F.lit("DATASET").alias("type"))


def part_edges(spark: SparkSession, directory: str) -> DataFrame:
    """``out, in, subtype``: each part depends on the parts at a half and at a third of its key,
    except on itself."""
    key, size = F.col("p_partkey"), F.col("p_size")
    by_half = pick(DIRECT_SUBTYPES, whole_quotient(size, 3) % 3 + 1)
    by_third = pick(DIRECT_SUBTYPES, size % 3 + 1)
    ends = F.array(
        F.struct(whole_quotient(key, 2).alias("in"), by_half.alias("subtype")),
        F.struct(whole_quotient(key, 3).alias("in"), by_third.alias("subtype")),
    )
    links = table(spark, directory, "part").select(key.alias("out"), F.inline(ends))
    return links.where(F.col("out") != F.col("in"))


def dataset_edges(spark: SparkSession, directory: str) -> DataFrame:
    return part_edges(spark, directory).select(
        label("part_", F.col("out")).alias("out_dataset"), label("part_", F.col("in")).alias("in_dataset")
    )


def column_edges(spark: SparkSession, directory: str) -> DataFrame:
    """The part edges with ten columns to a data set."""

    def dataset(end: str) -> Column:
        return label("table_", whole_quotient(F.col(end), 10))

    def column(end: str) -> Column:
        return label("c", F.col(end) % 10)

    return part_edges(spark, directory).select(
        F.lit("parts").alias("job"),
        F.lit("1").alias("version"),
        dataset("out").alias("out_dataset"),
        column("out").alias("out_column"),
        dataset("in").alias("in_dataset"),
        column("in").alias("in_column"),
        F.lit(DIRECT).alias("type"),
        F.col("subtype"),
    )


def looped_dataset_edges(spark: SparkSession, directory: str) -> DataFrame:
    """The part edges, and back from the part at half the key to every part of size 10."""
    key = F.col("p_partkey")
    parts = table(spark, directory, "part").where((F.col("p_size") == 10) & (key > 1))
    back = parts.select(
        label("part_", whole_quotient(key, 2)).alias("out_dataset"), label("part_", key).alias("in_dataset")
    )
    return dataset_edges(spark, directory).unionByName(back)


def schema_changes_in_time(spark: SparkSession, directory: str) -> DataFrame:
    """When each schema version of a supplier's data set began: at its first returned line."""
    returned = table(spark, directory, "lineitem").where(F.col("l_returnflag") == "R")
    return returned.groupBy(
        F.lit(JOB_NAMESPACE).alias("namespace"), label("supplier_", F.col("l_suppkey")).alias("name"), F.col("l_linenumber").alias("version")
    ).agg(F.min("l_shipdate").alias("since"))


def supplier_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Every order line as a run that reads the data set of its supplier."""
    return table(spark, directory, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run_id"),
        F.lit(JOB_NAMESPACE).alias("namespace"),
        label("supplier_", F.col("l_suppkey")).alias("name"),
        F.col("l_shipdate").alias("started_at"),
    )


def retyped_batches(spark: SparkSession, directory: str) -> list[DataFrame]:
    """Four batches of orders whose columns change their types: whole numbers, wider ones, fractions, text."""
    order, share = F.col("order_id"), F.col("order_id") % 4
    whole = F.col("customer_id").cast("int")
    amounts = [F.floor("amount").cast("int"), F.floor("amount"), F.col("amount"), F.lit(0).cast("smallint")]
    codes = [whole, whole, F.col("customer_id"), F.concat(F.lit("c"), F.col("customer_id"))]
    return [
        orders(spark, directory).where(share == k).select(
            order.cast("int").alias("order_id") if k == 0 else order, amount.alias("amount"), code.alias("code")
        )
        for k, (amount, code) in enumerate(zip(amounts, codes, strict=True))
    ]


def hidden_datasets(spark: SparkSession, directory: str) -> DataFrame:
    """Parts of two types, taken as views that were never written."""
    views = table(spark, directory, "part").where(F.col("p_type").isin("ECONOMY", "PROMO"))
    return views.select(label("part_", F.col("p_partkey")).alias("dataset"))


def host_lists(spark: SparkSession, directory: str) -> DataFrame:
    """Each supplier and its successor as a two-host namespace, written in both orders."""
    key = F.col("s_suppkey")
    one, two = F.concat(F.lit("s"), key, F.lit(":9092")), F.concat(F.lit("s"), key + 1, F.lit(":9092"))
    both = F.array(
        F.concat(F.lit("kafka://"), one, F.lit(","), two),
        F.concat(F.lit("kafka://"), two, F.lit(", "), one, F.lit(",")),
    )
    return table(spark, directory, "supplier").select(F.explode(both).alias("namespace"))


def namespaces(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages").select(F.col("url").alias("namespace"))
    return pages.unionByName(host_lists(spark, directory))


def event_datasets(spark: SparkSession, directory: str) -> DataFrame:
    """Each page as an event that reads its whole address and writes to its host."""
    url = F.col("url")
    ends = F.array(
        F.struct(F.lit("INPUT").alias("role"), url.alias("namespace")),
        F.struct(F.lit("OUTPUT").alias("role"), F.regexp_extract(url, "^(.*?://[^/]*)", 1).alias("namespace")),
    )
    return table(spark, directory, "pages").select(F.col("page_id").alias("event_id"), F.inline(ends))


def locations(spark: SparkSession, directory: str) -> DataFrame:
    """Page addresses as paths, and customers as catalog tables."""
    paths = table(spark, directory, "pages").select(F.col("url").alias("location"))
    tables = table(spark, directory, "customer").select(F.concat(F.lit("default."), F.col("c_name")).alias("location"))
    return paths.unionByName(tables)


def job_names(spark: SparkSession, directory: str) -> DataFrame:
    """Events as job names ``app.node.output``; those of failed events miss the application name in time."""
    output = label(".default.out_", F.col("event_id"))
    name = F.concat(label("app_", F.col("user_id")), F.lit("."), F.col("event_type"), output)
    late = F.concat(F.lit("unknown."), name)
    job = F.when(F.col("event_type") == "error", late).otherwise(name)
    return table(spark, directory, "events").select(job.alias("job"))
