"""Files checked as one batch against the same files one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tablevitals.plans import grouped
from tablevitals.plans.store import RunStore
from tablevitals.sources.files import route_files
from tablevitals.streaming import folder as stream
from tests.test_end_to_end import power_csv


def write_files(folder):
    rng = random.Random(1)
    folder.mkdir()
    power_csv(folder / "power.csv")
    power_csv(folder / "11111111_power.csv")
    text = (folder / "power.csv").read_text().replace("Energy Availability (MU)", "Spare").replace(",999999,", ",99,")
    (folder / "99999999_power.csv").write_text(text)  # the same dataset with another column
    lines = ["Branch,Branch Type,Open,Price,Empty,Amount"]
    for i in range(120):
        lines.append(f"Filiale {i % 12} K\xf6ln,t{i % 3}, {'True' if i % 2 else 'false'} ,{'1e999' if i == 7 else rng.randrange(90)},NA,{i % 40 if i else -3}")
    lines += [lines[5], lines[6]]
    (folder / "branches.csv").write_bytes("\n".join(lines).encode("cp1252"))
    (folder / "notes of a shop.csv").write_text('name,"said, ""then""",n\n"a ""b""","two\nlines",1\nx,"c,d",2\nx,,x\n')
    (folder / "surplus.csv").write_text("a,b\n1,2\n3,4,5\n")
    (folder / "blank.csv").write_text("\n\n")
    (folder / "header.csv").write_text("a,b\n")
    (folder / "scan_2026-04.txt").write_text("Assam 1600 1580\nnothing\nBihar 4300 4100\nBihar 4300 4100\nGoa -5 12.50\n")
    (folder / "blank_2026-04.txt").write_text("nothing to extract")


def files_of(spark, folder):
    found = spark.read.format("binaryFile").load(str(folder)).select("path", "length", F.col("modificationTime").cast("string").alias("modified"))
    return route_files(found, report_text=True).orderBy("path").collect()


def contents(store, table, *leave_out):
    names = {r["run_id"]: (r["dataset_name"], r["source_file"].rsplit("/", 1)[-1]) for r in store.runs().collect()}
    df = table(store).drop(*leave_out)
    return sorted(str([names.get(r["run_id"]) if c == "run_id" else r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("grouped")
    write_files(root / "in")
    files = files_of(spark, root / "in")
    ids = [f"run{i}" for i in range(len(files))]
    together, alone = RunStore(spark, str(root / "together")), RunStore(spark, str(root / "alone"))
    aside = grouped.ingest_files(spark, together, files, ids)
    apart = stream.one_by_one(spark, alone, files, None, 3)
    return together, alone, aside, apart


def test_same_runs(stores):
    together, alone, aside, apart = stores
    assert contents(together, RunStore.runs, "timestamp") == contents(alone, RunStore.runs, "timestamp")
    assert together.runs().count() == 6
    name = lambda rows: sorted(path.rsplit("/", 1)[-1] for _, path, _ in rows)
    assert name(aside) == name(apart) == ["blank.csv", "blank_2026-04.txt", "header.csv", "surplus.csv"]
    reasons = {path.rsplit("/", 1)[-1]: reason for _, path, reason in aside}
    assert reasons["surplus.csv"] == "failed: more cells than columns" and reasons["header.csv"] == "no rows"


def test_same_issues(stores):
    together, alone, *_ = stores
    found = contents(together, RunStore.issues)
    assert found == contents(alone, RunStore.issues)
    kinds = {r["issue_type"] for r in together.issues().collect()}
    assert kinds == {"completeness", "duplicate", "validity", "outlier", "consistency", "schema_drift"}


def test_same_rows_profiles_values_and_alerts(stores):
    together, alone, *_ = stores
    for table, out in ((RunStore.rows, ()), (RunStore.profiles, ("created_at",)), (RunStore.values, ()), (RunStore.lineage, ("ingested_at",))):
        assert contents(together, table, *out) == contents(alone, table, *out), table.__name__
    assert contents(together, lambda s: s.alerts().select("run_id")) == contents(alone, lambda s: s.alerts().select("run_id"))


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    """Forty files make as many Spark jobs as four."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (4, 40):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        for i in range(n):
            (folder / f"shop{i}.csv").write_text("store,city,amount\n" + "".join(f"s{k % 11},c{k % 12},{k * (i + 1)}\n" for k in range(60)) + "s1,c9x,-5\n")
        files = files_of(spark, folder)
        store = RunStore(spark, str(tmp_path / f"store{n}"))
        spark.sparkContext.setJobGroup(f"files{n}", "counted")
        assert grouped.ingest_files(spark, store, files, [f"r{i}" for i in range(n)]) == []
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(tracker.getJobIdsForGroup(f"files{n}")))
        scores = {r["health_score"] for r in store.runs().collect()}
        assert store.runs().count() == n and len(scores) == 1
    assert 0 < jobs[1] <= jobs[0] + 5, jobs


def test_files_alone_where_the_batch_fails(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n3,4\n")
    store = RunStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(stream, "ingest_files", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    stream.ingest_folder(spark, str(folder), store, str(tmp_path / "stream")).awaitTermination()
    assert store.runs().count() == 1
