"""Scores, alerts, reports and the run store on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablevitals.sources.reports import extract_report_rows
from tablevitals.operators import alerts, score
from tablevitals.plans import reports
from tablevitals.plans.store import RunStore, json_safe_record, runs_table
from tablevitals.streaming.folder import ingest_folder

RUN = "run_id string, timestamp timestamp, source_file string, dataset_name string, health_score int, rows_processed bigint, rows_flagged bigint"
ISSUE = "run_id string, row_reference string, column string, issue_type string, description string, severity string, row_index bigint, rule_ord int, column_ord int"


def run(run_id, day, dataset="d", points=90):
    return run_id, dt.datetime(2026, 1, day), f"{dataset}.csv", dataset, points, 10, 1


def issue(run_id, ref, kind="validity", severity="high", text="bad value"):
    return run_id, ref, "c", kind, text, severity, int(ref), 3, 0


@pytest.fixture(scope="module")
def tables(spark):
    runs = [run("a", 1), run("b", 2, points=40), run("c", 3, "e", 95), run("d", 4, "e", 95)]
    issues = [issue("a", "1", severity="low"), issue("d", "1"), issue("d", "1", "odd"), issue("d", "2")]
    issues += [issue("b", str(i), text=f"t{i:02}", severity="high") for i in range(12)]
    return spark.createDataFrame(runs, RUN), spark.createDataFrame(issues, ISSUE)


def test_scores(spark, tables):
    runs, issues = tables
    scores = {r["run_id"]: (r["score"], r["total_deducted"], r["total_issues"]) for r in score.health_score(runs, issues).collect()}
    assert scores == {"a": (90, 10, 1), "b": (0, 120, 12), "c": (100, 0, 0), "d": (75, 25, 3)}
    lost = score.deductions(issues).filter("run_id = 'd'").orderBy("place").collect()
    assert [(r["issue_type"], r["points_deducted"]) for r in lost] == [("validity", 20), ("odd", 5)]
    assert {r["run_id"]: r["rows_flagged"] for r in score.rows_flagged(issues).collect()} == {"a": 1, "b": 12, "d": 2}
    bands = runs.select(score.score_band(F.col("health_score"))).distinct().collect()
    assert {r[0] for r in bands} == {"green", "red"}


def test_alerts(spark, tables):
    runs, issues = tables
    flags = {r["run_id"]: r["alert"] for r in alerts.should_alert(runs, issues).collect()}
    assert flags == {"a": False, "b": True, "c": False, "d": True}  # low score; any high issue
    messages = {r["run_id"]: r["message"] for r in alerts.alert_message(runs, issues).collect()}
    assert set(messages) == {"b", "d"}
    lines = messages["b"].split("\n")
    assert "run `b`" in lines[0] and "40/100" in lines[2]
    assert [line for line in lines if "•" in line] == [f"  • [validity] t{i:02}" for i in range(10)]
    assert lines[-1] == "  … and 2 more"
    batch = {r["run_id"]: r["message"] for r in alerts.alert_batch(runs, issues, runs.filter("run_id = 'd'")).collect()}
    assert set(batch) == {"d"} and "*Source:* e\n" in batch["d"] and "*Rows flagged:* 3" in batch["d"]


def test_reports(spark, tables, tmp_path):
    runs, issues = tables
    summary = [(r["dataset_name"], r["latest_run_id"], r["run_count"], r["avg_health_score"]) for r in reports.dataset_summary(runs).collect()]
    assert summary == [("e", "d", 2, 95.0), ("d", "b", 2, 65.0)]
    scoped = reports.issue_breakdown(runs, issues, "e").collect()
    assert {(r["issue_type"], r["issue_count"], r["runs_affected"]) for r in scoped} == {("validity", 2, 1), ("odd", 1, 1)}
    pivot = {r["issue_type"]: (r["high"], r["medium"], r["low"]) for r in reports.breakdown_pivot(reports.issue_breakdown(runs, issues)).collect()}
    assert pivot == {"validity": (14, 0, 1), "odd": (1, 0, 0)}
    assert [r["run_id"] for r in reports.list_runs(runs, limit=2).collect()] == ["d", "c"]
    assert [r["run_id"] for r in reports.run_history(runs, "d").collect()] == ["a", "b"]
    assert reports.issue_history(runs, issues, "d").count() == 13
    report = reports.run_report(runs, issues)
    assert report.columns == reports.REPORT_COLUMNS
    clean = report.filter("run_id = 'c'").collect()
    assert [r["description"] for r in clean] == ["no issues flagged"] and clean[0]["severity"] == ""
    with pytest.raises(reports.UnknownRun):
        reports.run_issues(runs, issues, "nope")
    with pytest.raises(FileNotFoundError):
        reports.write_csv(reports.run_history(runs, "nope"), str(tmp_path / "x"))


def test_export_computes_its_report_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def counted(value):
        rows.add(1)
        return value

    report = spark.range(0, 100, 1, 4).select(F.udf(counted, "long")("id").alias("id"))
    reports.write_csv(report, str(tmp_path / "x"))
    assert rows.value == 100 and not report.storageLevel.useMemory
    assert [r["id"] for r in spark.read.option("header", True).schema("id long").csv(str(tmp_path / "x")).orderBy("id").collect()] == list(range(100))


def test_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.runs().count() == 0 and store.issues().count() == 0
    rows = spark.createDataFrame([(0, float("nan"), "x", None), (1, float("inf"), None, 2)], "_row_index bigint, v double, s string, n int")
    data = [r[0] for r in rows.select(json_safe_record(rows)).collect()]
    assert data == ['{"v":null,"s":"x","n":null}', '{"v":null,"s":null,"n":2}']
    store.store_rows(rows, "r1")
    assert store.rows().count() == 0  # no finished run yet
    finished = runs_table(spark, run_id="r1", dataset_name="d", source_file="f", health_score=1, rows_processed=2, rows_flagged=0, timestamp=dt.datetime(2026, 1, 1))
    store.store_run(finished)
    store.store_rows(rows, "r1")  # a repeated attempt replaces
    assert store.rows().count() == 2
    assert [r["row_index"] for r in reports.run_preview(store.runs(), store.rows(), "r1", 1).collect()] == [0]


def test_folder_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = RunStore(spark, str(tmp_path / "store"))
    start = lambda: ingest_folder(spark, str(folder), store, str(tmp_path / "stream")).awaitTermination()
    (folder / "sales.csv").write_text("store,amount\n" + "".join(f"s{i % 3},{i}\n" for i in range(20)) + "s1,-5\n")
    (folder / "notes.doc").write_text("nothing")
    (folder / "empty_2026-01.txt").write_text("nothing to extract")
    (folder / "power_2026-04.txt").write_text("Assam 1600 1580\nBihar 4300 4100\n")
    start()
    done = {r["dataset_name"]: r for r in store.runs().collect()}
    assert set(done) == {"sales", "power_2026-04"}
    assert done["sales"]["rows_processed"] == 21 and done["power_2026-04"]["rows_processed"] == 2
    assert {r["column"] for r in store.issues().filter("issue_type = 'validity'").collect()} == {"amount"}
    aside = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in spark.read.parquet(store.path("quarantine")).collect()}
    assert aside == {"notes.doc": "unsupported file type", "empty_2026-01.txt": "no rows"}
    assert store.rows().count() == 23
    (alert,) = store.alerts().collect()
    assert alert["run_id"] == done["sales"]["run_id"] and "*Source:* sales" in alert["message"]
    start()  # nothing new
    assert store.runs().count() == 2
    (folder / "0a1b2c3d_sales.csv").write_text("store,total\ns1,5\n")
    start()
    assert store.runs().filter("dataset_name = 'sales'").count() == 2
    drift = store.issues().filter("issue_type = 'schema_drift'").collect()
    assert {(r["column"], r["severity"]) for r in drift} == {("amount", "high"), ("total", "low")}
    messages = {r["run_id"]: r["message"] for r in store.alerts().collect()}
    assert set(messages) == {done["sales"]["run_id"], drift[0]["run_id"]}
    assert "Column 'amount' present in the previous run" in messages[drift[0]["run_id"]]


def test_report_lines_with_unicode_spaces(spark):
    df = spark.createDataFrame([("Odisha 4560 4490\nTamil Nadu 10 20",)], "text string")
    rows = extract_report_rows(df).collect()
    assert [(r["state_name"], r["energy_requirement_mu"]) for r in rows][0] == ("Odisha", 4560.0)
