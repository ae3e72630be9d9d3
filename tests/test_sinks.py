from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from millrace import workspace
from millrace.sinks.writers import drop_tables, recreate_database, replace_table, write_files
from millrace.sources.tables import data_files, read_delimited, read_lines, read_merged, rows_per_file, table


def test_delimited_text(spark, folder, rows):
    spark.createDataFrame([("1,Test1",), ("2,Test2",), ("x,Test3",)], "value STRING").write.text(folder)
    found = read_delimited(spark, folder, "id INT, name STRING")
    assert rows(found) == [(1, "Test1"), (2, "Test2"), (None, "Test3")]


def test_lines(spark, folder, rows):
    spark.createDataFrame([("a b",), ("c",)], "value STRING").write.text(folder)
    assert rows(read_lines(spark, folder)) == [("a b",), ("c",)]


def test_fixed_number_of_files(spark, folder):
    for mode, files in (("overwrite", 8), ("append", 16), ("append", 24)):
        write_files(spark.range(1000).selectExpr("1 AS hot", "id"), folder, 8, mode)
        assert data_files(spark, folder).count() == files
    per_file = [row.row_count for row in rows_per_file(spark.read.parquet(folder)).collect()]
    assert len(per_file) == 24 and sum(per_file) == 3000
    assert max(per_file) - min(per_file) <= 8


def test_merged_read(spark, folder, rows):
    spark.sql("SELECT 1 AS a, 'x' AS b").write.parquet(folder)
    spark.sql("SELECT 2 AS a, 3.5D AS c").write.mode("append").parquet(folder)
    assert rows(read_merged(spark, folder, "a", "b", "c")) == [(1, "x", None), (2, None, 3.5)]


def test_merged_read_reports_two_types_of_one_column(spark, folder):
    spark.sql("SELECT 1 AS a").write.parquet(folder)
    spark.sql("SELECT 'x' AS a").write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="CANNOT_MERGE_SCHEMAS"):
        read_merged(spark, folder).collect()


def test_table_cannot_be_overwritten_from_itself_but_replaced(spark, database, rows):
    name = f"{database}.t"
    spark.sql("SELECT 1 AS id, 'n' AS name, 'e' AS email").write.saveAsTable(name)
    changed = spark.table(name).selectExpr("id", "name AS full_name")
    with pytest.raises(AnalysisException):
        changed.write.mode("overwrite").saveAsTable(name)
    for _ in range(2):
        replace_table(spark.table(name).selectExpr("id", f"{spark.table(name).columns[1]} AS full_name"), name)
    assert spark.table(name).columns == ["id", "full_name"]
    assert rows(spark.table(name)) == [(1, "n")]
    assert [t.name for t in spark.catalog.listTables(database)] == ["t"]


def test_ddl(spark, folder, rows):
    for _ in range(2):
        recreate_database(spark, "smoke_db", folder)
        spark.sql("CREATE TABLE IF NOT EXISTS smoke_db.t (id INT, name STRING) USING parquet")
        spark.sql("CREATE TABLE IF NOT EXISTS smoke_db.t (id INT, name STRING) USING parquet")
        spark.sql("INSERT INTO smoke_db.t VALUES (2, 'k2'), (1, 'k1')")
        assert spark.sql("SELECT count(*) AS cnt FROM smoke_db.t").first().cnt == 2
        assert [tuple(r) for r in spark.sql("SELECT * FROM smoke_db.t ORDER BY id").collect()] == [(1, "k1"), (2, "k2")]
    assert [row[0] for row in spark.sql("SHOW DATABASES LIKE 'smoke*'").collect()] == ["smoke_db"]
    drop_tables(spark, "smoke_db", "t", "absent")
    assert spark.catalog.listTables("smoke_db") == []
    spark.sql("DROP DATABASE smoke_db CASCADE")


class Session:
    """As much of a session as the choice of the shared folder needs."""

    def __init__(self, **settings):
        self.conf = {name.replace("__", "."): value for name, value in settings.items()}


def test_shared_root_comes_from_the_session():
    cluster = Session(spark__master="yarn", spark__checkpoint__dir="hdfs://nn/shared/")
    assert workspace.shared_root(cluster) == "hdfs://nn/shared"
    assert workspace.fresh_path(cluster, "x") != workspace.fresh_path(cluster, "x")


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_root(Session(spark__master="yarn"))


def test_local_master_has_a_folder_of_its_own():
    assert workspace.shared_root(Session(spark__master="local[2]")) == workspace.shared_root(Session(spark__master="local[2]"))


def test_materialise_counts_rows(spark):
    df, count = workspace.materialise(spark.range(10).where("id % 2 = 0"), "even")
    assert count == 5 and df.count() == 5
    df, count = workspace.materialise(spark.range(10).where("id < 0"), "none")
    assert count == 0 and df.columns == ["id"] and df.count() == 0


def test_an_overwritten_path_shows_its_new_columns(spark, folder):
    path = f"{folder}/t.parquet"
    spark.range(3).write.parquet(path)
    assert table(spark, folder, "t").columns == ["id"]
    spark.range(3).selectExpr("id", "id AS b").write.mode("overwrite").parquet(path)
    assert table(spark, folder, "t").columns == ["id", "b"]


def test_replacing_a_table_leaves_its_neighbours(spark, database, rows):
    spark.range(2).write.saveAsTable(f"{database}.m__next")
    for size in (3, 4):
        replace_table(spark.range(size), f"{database}.m")
    assert spark.table(f"{database}.m").count() == 4
    assert sorted(t.name for t in spark.catalog.listTables(database)) == ["m", "m__next"]


def test_a_failed_replacement_leaves_the_table(spark, database, rows):
    spark.range(2).write.saveAsTable(f"{database}.m")
    with pytest.raises(Exception, match="(?s)division|DIVIDE"):
        replace_table(spark.range(3).selectExpr("1 / (id - 2) AS x"), f"{database}.m")
    assert rows(spark.table(f"{database}.m")) == [(0,), (1,)]
    assert [t.name for t in spark.catalog.listTables(database)] == ["m"]


def test_a_given_schema_reads_merged_files(spark, folder, rows):
    spark.createDataFrame([(1,)], "a INT").write.parquet(folder)
    spark.createDataFrame([(2, "x")], "a INT, b STRING").write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], "a INT, b STRING").schema
    assert rows(read_merged(spark, folder, "b", "a", schema=schema)) == rows(read_merged(spark, folder, "b", "a"))
