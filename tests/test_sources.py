"""Sources: registered tables in queries, a database behind JDBC (an embedded one), stored results."""

import pytest
from pyspark.sql import functions as F

from evenkeel import DataQualityChecker, DataReference, SparkSource
from evenkeel.errors import QueryExecutionError
from evenkeel.models import ObjectType
from evenkeel.sources.jdbc import Database
from evenkeel.sources.results import SCHEMA

URL = "jdbc:derby:memory:checks;create=true"
OPTIONS = {"url": URL, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    db = Database(spark, OPTIONS, partitions=4)
    db.execute(
        "CREATE TABLE orders (id INT NOT NULL, line INT NOT NULL, name VARCHAR(40), price DECIMAL(12, 2), seen TIMESTAMP, d DATE, PRIMARY KEY (line, id))",
        "CREATE TABLE items (id INT NOT NULL PRIMARY KEY, name VARCHAR(40), d DATE)",
        "CREATE VIEW few_items AS SELECT * FROM items WHERE id < 3",
        *[f"INSERT INTO items VALUES ({i}, 'n{i}', DATE('2024-01-{i:02d}'))" for i in range(1, 21)],
        "INSERT INTO orders VALUES (1, 2, 'a', 1.50, TIMESTAMP('2024-01-01 10:00:00'), DATE('2024-01-01'))",
    )
    yield db
    db.execute("DROP VIEW few_items", "DROP TABLE items", "DROP TABLE orders")


def test_metadata_come_from_the_driver(database):
    assert database.primary_key(DataReference("Orders")) == ["line", "id"] and database.primary_key(DataReference("few_items")) == []
    kinds = [database.object_type(DataReference(n)) for n in ("items", "few_items", "none")]
    assert kinds == [ObjectType.TABLE, ObjectType.VIEW, ObjectType.UNKNOWN]


def test_tables_are_read_in_parts(spark, database):
    source = SparkSource(spark, "derby", jdbc=OPTIONS, partitions=4)
    by_key = source.table(DataReference("items"))
    assert by_key.rdd.getNumPartitions() == 4 and by_key.count() == 20 and by_key.columns == ["id", "name", "d"]
    by_day = source.table(DataReference("items"), "UTC", ("d", "2024-01-05", "2024-01-12"))
    assert by_day.rdd.getNumPartitions() == 4
    assert {r["id"] for r in by_day.collect()} == set(range(4, 14))  # a day more on both sides; the check cuts these off
    assert source.table(DataReference("orders")).rdd.getNumPartitions() == 1
    assert source.query("SELECT name FROM items WHERE id < :top;", {"top": 3}).count() == 2


def test_zone_statements(spark):
    of = lambda product: Database(spark, {"url": f"jdbc:{product}:x"}).read_options("Europe/Berlin").get("sessionInitStatement")
    assert of("postgresql") == "SET TIME ZONE 'Europe/Berlin'" and of("oracle") == "ALTER SESSION SET TIME_ZONE = 'Europe/Berlin'"
    assert of("clickhouse") == "SET session_timezone = 'Europe/Berlin'" and of("derby") is None
    with pytest.raises(ValueError, match="zone"):
        Database(spark, {"url": "jdbc:postgresql:x"}).read_options("x'; DROP TABLE t")


def test_ddl_by_product(spark):
    made = Database(spark, {"url": "jdbc:postgresql:x"}).create(DataReference("r", "s"), SCHEMA, "run_id")
    assert made.startswith("CREATE TABLE s.r (run_id VARCHAR(64) NOT NULL PRIMARY KEY, run_started_at TIMESTAMP")
    assert "report TEXT" in made and "stats_final_score FLOAT8" in made and made.count(",") == 45
    assert "report CLOB" in Database(spark, {"url": "jdbc:oracle:thin:x"}).create(DataReference("r"), SCHEMA, "run_id")
    house = Database(spark, {"url": "jdbc:clickhouse:x"}).create(DataReference("r"), SCHEMA, "run_id")
    assert house.startswith("CREATE TABLE IF NOT EXISTS r (run_id String,") and house.endswith("ENGINE = MergeTree ORDER BY run_id")


def test_checks_over_a_database(spark, database):
    changed = spark.createDataFrame([(i, "other" if i == 6 else f"n{i}", f"2024-01-{i:02d}") for i in range(1, 21)], "id int, name string, d string")
    target = SparkSource(spark, tables={"items": changed.withColumn("d", F.to_date("d"))})
    source = SparkSource(spark, "derby", jdbc=OPTIONS)
    ref = DataReference("items")
    checker = DataQualityChecker(source, target, results_engine=source)
    status, _, stats, details = checker.check_samples(ref, ref, date_column="d", date_range=("2024-01-03", "2024-01-12"), persist_result=DataReference("stored"))
    assert status == "failed" and (stats.comparable_rows, stats.passed_rows) == (10, 9)
    assert details.issue_examples.values.tolist() == [["6", "name", "n6", "other"]]
    assert checker.check_counts(ref, ref, date_column="d", persist_result=DataReference("stored"))[0] == "success"
    assert checker.check_sniff_query("SELECT id, CASE WHEN id = 4 THEN 'n' ELSE 'y' END AS xsniff_passed FROM items")[2].issue_rows_pct == 5.0
    assert database.primary_key(DataReference("stored")) == ["run_id"]
    rows = source.table(DataReference("stored")).collect()
    assert {r["check_type"]: (r["status"], r["stats_passed_rows"]) for r in rows} == {"samples": ("failed", 9), "counts": ("success", 20)}
    assert "SAMPLES CHECK REPORT" in next(r["report"] for r in rows if r["check_type"] == "samples")
    database.execute("DROP TABLE stored")


def test_errors_of_sources(spark, database):
    with pytest.raises(QueryExecutionError):
        SparkSource(spark).table(DataReference("no_such_table"))
    with pytest.raises(QueryExecutionError):
        SparkSource(spark).query("SELECT nothing FROM nowhere")
    with pytest.raises(QueryExecutionError):
        database.execute("CREATE NONSENSE")


def test_tables_of_equal_last_names_stay_apart(spark):
    spark.range(7).createOrReplaceTempView("t")
    one, two, three = (spark.createDataFrame([(v,)], "v int") for v in (1, 2, 3))
    source = SparkSource(spark, tables={"t": one, "x.t": two, "y.u": three})
    value = lambda sql: [tuple(r) for r in source.query(sql).collect()]
    assert value("SELECT v FROM t") == [(1,)] and value("SELECT x.t.v FROM x.t") == [(2,)]
    assert value("SELECT v FROM `t`") == [(1,)] and value("SELECT v FROM `x`.`t`") == [(2,)] and value("SELECT T.v FROM T") == [(1,)]
    assert value("SELECT u.v, 'x.t' FROM u JOIN y.u AS w USING (v)") == [(3, "x.t")]
    assert value("-- a comment\nWITH w AS (SELECT v + 1 AS v FROM t) SELECT v FROM w -- the end") == [(2,)]
    assert spark.table("t").count() == 7  # the caller's own view
    with pytest.raises(QueryExecutionError):
        SparkSource(spark, tables={"a.z": one, "b.z": two}).query("SELECT v FROM z")
    spark.catalog.dropTempView("t")


def test_json_columns_go_by_content(spark):
    s = spark.createDataFrame([(1, '{"a": 1, "b": {"x": 1, "y": [2, 3]}}'), (2, "not json"), (3, None)], "id int, j string")
    t = spark.createDataFrame([(1, '{"b": {"y": [2, 3], "x": 1},  "a": 1}'), (2, "not json"), (3, None)], "id int, j string")
    ref, by = DataReference("r"), {"r": ["J"]}
    checker = DataQualityChecker(*[SparkSource(spark, tables={"r": df}, primary_keys={"r": ["id"]}, json_columns=by) for df in (s, t)])
    assert checker.check_samples(ref, ref)[0] == "success"
