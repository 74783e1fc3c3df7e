"""Keyed diffs, counts, rules, chunks, reports and results on small inputs with known answers."""

import json
import subprocess
import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel import DataQualityChecker, DataReference, SparkSource
from evenkeel.functions.normalize import canonical
from evenkeel.functions.params import listing, literal, render
from evenkeel.models import CheckResult, CheckRunTimings, CheckStats
from evenkeel.operators import chunks, counts, diff, scan, sniff
from evenkeel.sources.results import SCHEMA, record


def stats_of(spark, schema, source, target, keys, flag=None):
    s, t = spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)
    values = [c for c in s.columns if c not in keys and c != flag]
    return diff.stats(diff.keyed_diff(s, t, keys, values, flag), values).first().asDict()


CASES = {
    "other keys": ("id int, value string", [(1, "A"), (2, "B"), (3, "C")], [(1, "A"), (2, "B"), (4, "X")], ["id"], {"final_diff_score": 15.0}),
    "other values": ("id int, name string, age int", [(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", 35)], [(1, "Alice", 25), (2, "Robert", 31), (3, "Charlie", 36)], ["id"], {"comparable_rows": 3, "final_diff_score": 100 / 3, "issues": [1, 2]}),
    "compound": ("id1 int, id2 string, value int", [(1, "a", 10), (1, "b", 20), (2, "a", 30)], [(1, "a", 10), (2, "a", 30), (2, "b", 40)], ["id1", "id2"], {"comparable_rows": 2, "only_source_rows": 1, "only_target_rows": 1, "final_diff_score": 15.0}),
    "double in source": ("pk int, value string", [(1, "A"), (1, "B"), (2, "C"), (3, "D")], [(1, "A"), (2, "C"), (3, "D"), (4, "E")], ["pk"], {"final_diff_score": 7.5}),
    "double in target": ("pk int, value string", [(1, "A"), (2, "C"), (3, "D"), (4, "E")], [(1, "A"), (1, "B"), (2, "C"), (3, "D")], ["pk"], {"dup_target_rows_pct": 25.0, "source_only_rows_pct": 100 / 3, "final_diff_score": 7.5}),
    "double and mismatch": ("id1 int, id2 string, value int", [(1, "a", 10), (1, "a", 15), (2, "a", 30), (3, "c", 40)], [(1, "a", 11), (2, "a", 30), (3, "c", 40)], ["id1", "id2"], {"final_diff_score": 19.1666666}),
    "no overlap": ("key1 int, key2 string, value int", [(1, "a", 1)], [(2, "b", 1)], ["key1", "key2"], {"comparable_rows": 0, "final_diff_score": 100.0, "final_score": 0.0, "dup_source_rows_pct": 100.0}),
    "null keys meet": ("id int, value string", [(None, None), (1, "x")], [(None, None), (1, None)], ["id"], {"comparable_rows": 2, "passed_rows": 1}),
    "keys only": ("id int", [(1,), (2,)], [(2,), (3,)], ["id"], {"comparable_rows": 1, "passed_rows": 1, "issues": []}),
}


@pytest.mark.parametrize("name", CASES)
def test_diff(spark, name):
    schema, source, target, keys, want = CASES[name]
    got = stats_of(spark, schema, source, target, keys)
    for k, v in want.items():
        assert got[k] == (pytest.approx(v, abs=1e-5) if isinstance(v, float) else v), k


def test_fresh_keys_go_on_both_sides(spark):
    schema = "id int, value string, xrecently_changed string"
    got = stats_of(spark, schema, [(1, "a", "y"), (2, "b", "n"), (3, "c", "y"), (4, "d", "n")], [(1, "a", "n"), (2, "b", "y"), (3, "c", "n"), (5, "e", "n")], ["id"], "xrecently_changed")
    assert (got["total_source_rows"], got["total_target_rows"], got["comparable_rows"]) == (1, 1, 0)


def text(spark, value, kind):
    return spark.createDataFrame([(value,)], T.StructType([T.StructField("x", kind)])).select(canonical(F.col("x"), kind)).first()[0]


def test_equal_values_of_other_types_are_equal_text(spark):
    assert {text(spark, 3, T.LongType()), text(spark, 3.0, T.DoubleType()), text(spark, Decimal("3.00"), T.DecimalType(10, 2)), text(spark, 3.0, T.FloatType())} == {"3"}
    assert text(spark, 1e-7, T.DoubleType()) == "0.0000001" and text(spark, 1e-20, T.DoubleType()) == "0.00000000000000000001"
    assert text(spark, 50000.01, T.DoubleType()) == "50000.01" and text(spark, -0.0, T.DoubleType()) == "0" and text(spark, 1e300, T.DoubleType()) == "1e300"
    assert text(spark, 0.1, T.FloatType()) == "0.1" and text(spark, 100.0, T.DoubleType()) == "100" and text(spark, Decimal("100.00"), T.DecimalType(10, 2)) == "100"
    assert {text(spark, v, T.StringType()) for v in (None, "", "  ", "None", "nan", "NaT", "N/A", " ")} == {"N/A"}
    assert text(spark, float("nan"), T.DoubleType()) == "N/A" and text(spark, "NaN ", T.StringType()) == "NaN "
    assert text(spark, True, T.BooleanType()) == "1" and text(spark, date(2024, 1, 1), T.DateType()) == "2024-01-01"
    assert text(spark, datetime(2024, 1, 1), T.TimestampNTZType()) == "2024-01-01" and text(spark, datetime(3023, 1, 1, 1, 2, 3, 9), T.TimestampNTZType()) == "3023-01-01 01:02:03"
    assert text(spark, bytearray(b"\x01\xff"), T.BinaryType()) == "01ff" and text(spark, [1, 2], T.ArrayType(T.IntegerType())) == "[1,2]"


def test_zones(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 20:00:00' AS x")
    assert df.select(canonical(F.col("x"), T.TimestampType(), "+05:00", "UTC")).first()[0] == "2024-01-02 01:00:00"
    inside = lambda day, zone: scan.in_days(df, "x", day, day, zone).count()
    assert inside("2024-01-01", "UTC") == 1 and inside("2024-01-02", "+05:00") == 1 and inside("2024-01-01", "+05:00") == 0


def test_chunks():
    got = chunks.date_chunks("2024-01-01", "2024-01-31", 10)
    assert len(got) == 4 and got[0] == ("2024-01-01", "2024-01-10") and got[-1] == ("2024-01-31", "2024-01-31")
    for bad in (("2024-01-01", "2024-01-31", 0), ("2024-02-01", "2024-01-01", 3)):
        with pytest.raises(ValueError):
            chunks.date_chunks(*bad)
    with pytest.raises(ValueError):
        chunks.paired_chunks({"start_date": "2024-01-01", "end_date": "2024-01-09"}, {"start_date": "2024-01-01", "end_date": "2024-01-02"}, 3)
    assert chunks.param_chunks({"a": 1}, 3) == [{"a": 1}]


def test_params():
    assert render("SELECT :a::int, ':a', x::date FROM t WHERE s = :ab", {"a": 1, "ab": "O'x"}) == "SELECT 1::int, ':a', x::date FROM t WHERE s = 'O''x'"
    assert [literal(v) for v in (None, True, 2.5, "q")] == ["NULL", "TRUE", "2.5", "'q'"]
    assert [literal(v) for v in (7, Decimal("1.50"), b"\x01\xff", date(2024, 1, 2))] == ["7", "1.50", "X'01ff'", "'2024-01-02'"]
    assert listing({"b", "a"}) == "a, b" and listing(("z", "y")) == "z, y" and listing(None) == "" and listing(()) == ""


def test_days_are_filled_and_null_days_left_out(spark):
    s = spark.createDataFrame([("2024-01-01", 10), ("2024-01-02", 20)], "dt string, cnt long")
    t = spark.createDataFrame([("2024-01-02", 15), ("2024-01-03", 25)], "dt string, cnt long")
    days = counts.aligned(s, t)
    assert days.count() == 3
    got = counts.totals(days).first()
    assert (got["source_total"], got["target_total"], got["diff_count"], got["equal_count"]) == (30, 40, 40, 15)
    raw = spark.sql("SELECT * FROM VALUES (DATE '2024-01-01'), (NULL), (DATE '2024-01-01') AS t(d)")
    assert [tuple(r) for r in counts.daily_counts(raw, "d").collect()] == [("2024-01-01", 2)]
    assert counts.totals(counts.aligned(s.limit(0), t.limit(0))).first()["counts_diff_pct"] is None


def test_sniff(spark):
    df = spark.createDataFrame([(1, "y"), (2, "y"), (3, "n"), (4, None), (5, "N")], "id int, XSNIFF_PASSED string")
    got = sniff.stats(df).first()
    assert (got["total_source_rows"], got["passed_rows"], got["issue_rows_pct"]) == (5, 4, 20.0)
    assert [tuple(r) for r in sniff.examples(df, 3).collect()] == [(3, "n")]
    assert sniff.stats(df.limit(0)).first()["final_score"] == 100.0
    with pytest.raises(ValueError, match="xsniff_passed"):
        sniff.stats(spark.range(1))


@pytest.fixture(scope="module")
def checker(spark):
    rows = [(i, f"n{i}", f"2024-01-{i:02d}") for i in range(1, 11)]
    s = spark.createDataFrame(rows, "id int, name string, d string").withColumn("d", F.to_date("d"))
    t = s.withColumn("name", F.when(F.col("id").isin(2, 4), "other").otherwise(F.col("name"))).withColumn("EXTRA", F.lit(1))
    return DataQualityChecker(SparkSource(spark, tables={"x.t": s, "t": s}, primary_keys={"t": ["ID"]}), SparkSource(spark, tables={"t": t, "none": t.limit(0)}), results_engine=spark)


REF = DataReference("t")


def test_samples(checker):
    status, report, stats, details = checker.check_samples(REF, REF, date_column="D", date_range=("2024-01-01", "2024-01-10"))
    assert status == "failed" and stats.final_diff_score == pytest.approx(10.0) and stats.max_issue_pct == pytest.approx(20.0)
    assert details.issue_breakdown.values.tolist() == [["name", 2]] and details.skipped_target_columns == ["extra"] and details.evaluated_columns == ["id", "name", "d"]
    assert details.issue_examples.values.tolist() == [["2", "name", "n2", "other"], ["4", "name", "n4", "other"]]
    assert "SAMPLES CHECK REPORT:\nt\nVS\nt\n" in report and "  Final discrepancies score: 10.00000" in report and report.endswith("=" * 80)
    chunked = checker.check_samples(REF, REF, date_column="d", date_range=("2024-01-01", "2024-01-10"), chunk_size_days=3)
    assert chunked[2] == stats and "chunks processed (4 intervals)" in chunked[1]
    assert checker.check_samples(REF, REF, tolerance_pct=10.0)[0] == "success"
    assert checker.check_samples(REF, REF, exclude_columns=["name", "id"])[2].final_score == 100.0
    assert checker.check_samples(REF, REF, include_columns=["d"])[3].evaluated_columns == ["id", "d"]
    assert checker.check_samples(REF, REF, date_column="d", date_range=("2030-01-01", "2030-01-02"))[:3] == ("skipped", None, None)
    assert checker.check_samples(REF, REF, update_column="d", exclude_recent_hours=9_000_000)[0] == "skipped"
    assert checker.check_samples(REF, DataReference("none"))[2].final_score == 0.0
    assert json.loads(checker.check_samples(REF, REF, report_output_format="JSON")[1])["stats"]["comparable_rows"] == 10


def test_errors(checker, spark):
    with pytest.raises(TypeError):
        checker.check_samples("t", REF)
    with pytest.raises(ValueError):
        checker.check_samples(REF, REF, report_output_format="xml")
    with pytest.raises(ValueError):
        DataQualityChecker(spark).check_counts(REF, REF)
    with pytest.raises(ValueError):
        checker.check_custom_queries("SELECT 1", {}, "SELECT 1", {}, [])
    with pytest.raises(ValueError):
        DataReference("a;b")
    assert checker.check_samples(REF, REF, custom_primary_key=["nope"]) == ("failed", None, None, None)
    assert checker.check_samples(DataReference("t", "x"), REF, chunk_size_days=0, custom_primary_key=["id"])[0] == "failed"
    assert checker.check_sniff_query("SELECT 1 AS x")[0] == "failed"
    assert checker.check_sniff_query("SELECT 1 AS x WHERE false")[2].final_score == 100.0


def test_counts_queries_and_results(checker, spark):
    status, report, stats, details = checker.check_counts(REF, REF, date_column="d")
    assert status == "success" and stats.passed_rows == 10 and "  Discrepancies %: 0.00000%" in report
    spark.sql("DROP TABLE IF EXISTS stored_checks")
    q = "SELECT ID, name, d FROM t WHERE d >= :start_date AND d <= :end_date AND id < :top"
    p = {"start_date": "2024-01-01", "end_date": "2024-01-10", "top": 8}
    status, report, stats, details = checker.check_custom_queries(q, p, q, p, ["Id"], check_name="c", chunk_size_days=5, persist_result=DataReference("stored_checks"), check_tags={"a": 1})
    assert status == "failed" and stats.comparable_rows == 7 and details.evaluated_columns == ["name", "d"]
    status, *_ = checker.check_sniff_query("SELECT id, IF(id = 3, 'n', 'y') AS xsniff_passed FROM t", tolerance_pct=50, persist_result=DataReference("stored_checks"))
    assert status == "success"
    rows = spark.table("stored_checks").orderBy("check_type").collect()
    assert [r["check_type"] for r in rows] == ["custom_queries", "sniff_query"] and len(rows[0]) == 46
    assert "id < 8" in rows[0]["source_query"] and rows[0]["check_tags_json"] == '{"a": 1}' and rows[1]["stats_issue_rows_pct"] == 10.0
    spark.sql("DROP TABLE stored_checks")
    checker.check_samples(REF, REF)
    checked = checker.check_stats
    assert checked["checked"] == sum(checked[k] for k in ("success", "failed", "skipped")) and "t" in checked["tables_failed"]


def test_results():
    r = CheckResult(timestamp="2024-01-01 00:00:00", run_id=" ab ", check_type="samples", status="success", stats=CheckStats(issue_rows_pct=100 / 6))
    assert r.run_id == "ab" and "run_id" not in r.to_dict() and len(record(r)) == len(SCHEMA.fields) == 46
    assert record(r)["stats_issue_rows_pct"] == 16.66667 and record(r)["details_issue_breakdown_json"] == "[]"
    with pytest.raises(ValueError):
        CheckResult(timestamp="", run_id=" ", check_type="", status="")
    t = CheckRunTimings()
    t.start("source_query")
    first = t.source_query_started_at
    t.start("source_query")
    assert t.source_query_started_at == first


def test_storage_failure_keeps_the_result(spark):
    class Broken:
        jdbc = None
        spark = None

    c = DataQualityChecker(spark)
    c.results.source = Broken()
    assert c.check_sniff_query("SELECT 'y' AS xsniff_passed", persist_result=True)[0] == "success"


def test_size_guard(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/a")
    with pytest.raises(ValueError, match="limit"):
        SparkSource(spark, tables={"a": f"{tmp_path}/a"}, max_bytes=10).table(DataReference("a"))


def test_stream(spark, tmp_path):
    from evenkeel.streaming.microbatch import sniff_stream

    spark.sql("SELECT id, IF(id % 4 = 0, 'n', 'y') AS xsniff_passed FROM range(100)").write.parquet(f"{tmp_path}/in")
    seen = {}
    q = sniff_stream(spark.readStream.schema("id long, xsniff_passed string").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", lambda n, s: seen.update({n: s}))
    q.processAllAvailable()
    q.stop()
    assert seen[0]["issue_rows_pct"] == 25.0


def test_one_exchange(spark):
    s = spark.range(1000).selectExpr("id", "id % 7 AS v")
    plan = diff.keyed_diff(s, s, ["id"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _condensed(monkeypatch) -> list:
    """The diffs that checks keep from now on."""
    kept, plain = [], diff.condensed
    monkeypatch.setattr(diff, "condensed", lambda d: kept.append(plain(d)) or kept[-1])
    return kept


def test_grouped_sides_are_not_dealt_again(spark, monkeypatch):
    """Queries that group by a whole-number key are compared where they are, in one pass: one exchange a side and no more."""
    kept = _condensed(monkeypatch)
    a = SparkSource(spark, tables={"a": spark.range(1000).selectExpr("id % 50 AS k", "id % 7 AS v")})
    sql = "SELECT k, count(*) AS n, sum({}) AS v FROM a GROUP BY k"
    stats = DataQualityChecker(a, a).check_custom_queries(sql.format("v"), {}, sql.format("v + IF(k = 4, 1, 0)"), {}, ["k"])[2]
    assert (stats.comparable_rows, stats.passed_rows, stats.total_source_rows) == (50, 49, 50)
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_whole_number_keys(spark, monkeypatch):
    """Results are those of the keys' texts; clean keys keep nothing but that they are there."""
    kept = _condensed(monkeypatch)
    s = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b"), (2, "a"), (10, "c"), (9, "x"), (7, "q")], "id int, v string")
    t = spark.createDataFrame([(None, "z"), (1, "a"), (2, "a"), (10, "d"), (-3, "x"), (9, None), (100, "q"), (100, "q")], "id int, v string")
    told = []
    for kinds in (("string", "string"), ("int", "int"), ("smallint", "bigint"), ("string", "bigint")):
        sides = [SparkSource(spark, tables={"t": df.withColumn("id", F.col("id").cast(kind))}) for df, kind in zip((s, t), kinds, strict=True)]
        _, _, stats, d = DataQualityChecker(*sides).check_samples(REF, REF, custom_primary_key=["id"])
        keys = (d.source_only_keys_examples, d.target_only_keys_examples, d.dup_source_keys_examples, d.dup_target_keys_examples)
        told.append((stats, keys, d.issue_examples.values.tolist(), d.issue_row_examples.values.tolist()))
        rows = kept[-1].where("__clean = 1").drop("__clean").collect()
        assert [[*r] for r in rows] == [[None, 0, 0, None, None]] and kept[-1].where("__clean = 0").count() == 7
    assert told[0][1] == (("7",), ("-3", "100"), ("2",), ("100",)) and told[0][2][0] == ["10", "v", "c", "d"]
    assert all(x == told[0] for x in told[1:])


@pytest.mark.parametrize("missing", ["tiktoken", "evenkeel.llm", "evenkeel.llm.queries", "corpus_pipeline"])
def test_entry_points_survive_a_missing_import(missing):
    """Only what needs the missing module goes; the queries of the engine stay."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    names, oracles = (line.split() for line in done.stdout.strip().split("\n")[-2:])
    assert "samples_stats_orders" in names and "samples_stats_orders" in oracles
    assert "pipeline" not in names and any(n.startswith("op1_") for n in names) == (missing == "corpus_pipeline" and _has_llm())


def _has_llm() -> bool:
    return (Path(__file__).resolve().parents[1] / "evenkeel" / "llm" / "queries.py").exists()
