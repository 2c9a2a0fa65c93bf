"""The sample batch with its four planted faults."""

from pyspark.sql import functions as F

from tablevitals.operators.score import deductions
from tablevitals.plans.pipeline import run_batch
from tablevitals.plans.reports import run_values
from tablevitals.plans.store import RunStore
from tablevitals.sources.csv import load_csv

STATES = [
    "Bihar", "Jharkhand", "Odisha", "Delhi", "Assam", "Kerala", "Punjab", "Haryana", "Gujarat", "Goa", "Sikkim",
    "Tripura", "Manipur", "Nagaland", "Mizoram", "Rajasthan", "Telangana", "Karnataka", "Uttarakhand", "Meghalaya",
    "Maharashtra",
]


def power_csv(path):
    """21 states in 3 months: one state absent once, one misspelled, a negative and a huge value."""
    lines = [" Month ,State Name,Energy Requirement (MU),Energy Availability (MU)"]
    for m, month in enumerate(["2026-01", "2026-02", "2026-03"]):
        for s, state in enumerate(STATES):
            if state == "Bihar" and m == 1:
                continue
            need = 1000 + 150 * s + 10 * m
            have = need - 30 - 5 * m
            if state == "Jharkhand" and m == 0:
                have = -120
            if state == "Delhi" and m == 2:
                need = 999999
            name = "Orissa" if state == "Odisha" and m == 2 else state
            lines.append(f"{month}, {name} ,{need},{have}")
    path.write_text("\n".join(lines) + "\n")


def test_planted_faults_and_store(spark, tmp_path):
    path = tmp_path / "power.csv"
    power_csv(path)
    df = load_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.drop("_row_index").schema] == ["string", "string", "double", "double"]
    assert df.count() == 62
    assert [r[0] for r in df.select("_row_index").orderBy("_row_index").collect()] == list(range(62))
    store = RunStore(spark, str(tmp_path / "store"))
    result = run_batch(spark, df, dataset_name="power", source_file=str(path), store=store, stage=True, keep_values=True)
    by_type = {r["issue_type"]: r["count"] for r in result.issues.groupBy("issue_type").count().collect()}
    assert by_type == {"completeness": 4, "validity": 1, "outlier": 2, "consistency": 1}
    assert result.summary["health_score"] == 57
    assert result.summary["rows_flagged"] == 6
    assert store.runs().count() == 1
    assert store.rows().count() == 62
    assert store.issues().count() == 8
    assert store.lineage().count() == 1
    assert store.profiles().count() == 4
    months = run_values(store.runs(), store.values(), result.run_id).filter("column = 'month'").collect()
    assert [r["value"] for r in months] == ["2026-01", "2026-02", "2026-03"]
    points = {r["issue_type"]: r["points_deducted"] for r in deductions(result.issues).collect()}
    assert points == {"completeness": 16, "outlier": 12, "validity": 10, "consistency": 5}
    texts = [r[0] for r in result.issues.select("description").collect()]
    assert any(t.startswith("Value -120.0 in 'energy_availability_mu' is negative, but 98% of") for t in texts)
    assert (
        "'Orissa' in column 'state_name' closely matches the far more common value 'Odisha' (67% similarity) — "
        "likely a naming inconsistency that will break joins/counts" in texts
    )
    assert "'Bihar' is missing from month=2026-02 despite reporting in other periods" in texts
    # The second run has a baseline and no drift; storing it again changes nothing.
    again = run_batch(spark, df, dataset_name="power", store=store, stage=True)
    assert again.issues.filter(F.col("issue_type") == "schema_drift").count() == 0
    run_batch(spark, df, dataset_name="power", store=store, run_id=again.run_id, stage=True)
    assert store.runs().count() == 2
    assert store.issues().count() == 16
    other = run_batch(spark, df.drop("month"), dataset_name="power", store=store, stage=True)
    drift = other.issues.filter(F.col("issue_type") == "schema_drift").collect()
    assert [(r["column"], r["severity"]) for r in drift] == [("month", "high")]


def test_run_written_again(spark, tmp_path):
    """The second attempt replaces the first, also where it finds nothing; keys may be texts."""
    store = RunStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(f"k{i}", "x", -5.0 if i == 3 else 10.0 + i) for i in range(20)] + [("k20", "x", 10.0)], "k string, s string, v double")
    first = run_batch(spark, df, dataset_name="d", store=store, row_key="k", run_id="r")
    assert first.summary["health_score"] < 100 and store.issues().count() == first.summary["total_issues"] > 0
    off = {rule: {"enabled": False} for rule in ("completeness", "duplicate", "validity", "outlier", "consistency", "schema_drift")}
    again = run_batch(spark, df, dataset_name="d", store=store, row_key="k", run_id="r", config=off)
    assert again.summary["health_score"] == 100 and again.summary["total_issues"] == 0
    assert store.issues().count() == 0 and store.runs().count() == 1
    assert {r["row_reference"] for r in store.rows().collect()} == {f"k{i}" for i in range(21)}
    assert store.values().filter("column = 'k'").count() == 21


def test_given_roles(spark):
    """Columns named as identifiers are not judged as measures."""
    df = spark.createDataFrame([(i, float(i) if i < 29 else 1e9, float(i)) for i in range(30)], "_row_index bigint, orderkey double, v double")
    assert run_batch(spark, df, dataset_name="d").issues.filter("issue_type = 'outlier'").count() == 1
    assert run_batch(spark, df, dataset_name="d", id_columns=["orderkey"]).issues.filter("issue_type = 'outlier'").count() == 0


def test_readers_while_a_run_is_written_again(spark, tmp_path, monkeypatch):
    """Until the mark is written readers see the old attempt, whole; what they began to read stays readable."""
    root = str(tmp_path / "store")
    store = RunStore(spark, root)
    df = spark.createDataFrame([(i, "x", -5.0 if i == 3 else 10.0 + i) for i in range(20)], "_row_index long, s string, v double")
    first = run_batch(spark, df, dataset_name="d", store=store, run_id="r")
    began, found = store.issues(), store.issues().count()
    assert found == first.summary["total_issues"] > 0
    seen = []
    plain = RunStore.store_run

    def look(self, run):
        other = RunStore(spark, root)
        seen.append((other.runs().first()["rows_processed"], other.rows().count(), other.issues().count(), began.count()))
        plain(self, run)

    monkeypatch.setattr(RunStore, "store_run", look)
    second = run_batch(spark, df.filter("v > 0").limit(10), dataset_name="d", store=RunStore(spark, root), run_id="r")
    assert seen == [(20, 20, found, found)] and began.count() == found
    assert store.runs().first()["rows_processed"] == store.rows().count() == 10
    assert store.issues().count() == second.summary["total_issues"] == 0
    # An attempt that fails before its mark changes nothing and is removed by the next.
    monkeypatch.setattr(RunStore, "store_run", lambda self, run: (_ for _ in ()).throw(OSError("lost")))
    try:
        run_batch(spark, df, dataset_name="d", store=RunStore(spark, root), run_id="r")
    except OSError:
        pass
    assert store.rows().count() == 10
    monkeypatch.setattr(RunStore, "store_run", plain)
    run_batch(spark, df, dataset_name="d", store=RunStore(spark, root), run_id="r")
    assert store.rows().count() == 20 and len(store._attempts_of("dataset_rows", "r")) == 2
