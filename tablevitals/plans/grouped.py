"""Many arriving files as one batch: every pass groups by run.

A file is a run. Rows of all files, whatever their columns, are one table of
``run_id, row, cells``, staged once. Each pass over it (figures of all columns,
counts of all values, every rule, the score, the store) is one grouped plan, so
the number of jobs doesn't grow with the number of files; files with the same
format and header are read by one scan. What reaches the driver is a row for
each file and column of the micro-batch.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tablevitals.config import BROADCAST_MAX_ROWS, ENTITY_MIN_DISTINCT, NUMERIC_COERCION_RATIO, PERIOD_MAX_DISTINCT, rule_config
from tablevitals.functions.columns import ROW_INDEX, col
from tablevitals.functions.pyformat import float_text, round_half_even
from tablevitals.operators.batch import candidate_note, period_note
from tablevitals.operators.completeness import absence_issues, missing_issues
from tablevitals.operators.consistency import best_matches, judged_by_ratio, most_frequent, naming_issues
from tablevitals.operators.drift import drift_issues
from tablevitals.operators.duplicates import duplicate_issues, duplicate_rows, repeated_hashes
from tablevitals.operators.outliers import far_issues, figures_by_group, judged_value
from tablevitals.operators.roles import ID_NAME, PERIOD_NAME
from tablevitals.operators.score import run_totals
from tablevitals.operators.validity import negative_issues, routinely_negative
from tablevitals.plans.pipeline import side_by_side
from tablevitals.plans.store import PROFILE_SCHEMA, RUN_SCHEMA, RunStore, lineage_table
from tablevitals.sources.csv import FileFormat, FileGroup, detect_formats, flagged_cells, header_names
from tablevitals.sources.reports import drop_confidence, extract_report_rows
from tablevitals.sources.row_index import with_file_row_index
from tablevitals.sources.tables import BOOLEANS, normalize_na_tokens, parse_number, strip

STATS_SCHEMA = (
    "run_id string, ord int, name string, dtype string, n bigint, missing bigint, "
    "min double, max double, mean double, std double, nonneg bigint"
)


@dataclass
class FileRun:
    """One file and what is known of its columns."""

    run_id: str
    path: str
    dataset_name: str
    names: list[str]
    rows: int = 0
    surplus: int = 0
    stats: list[dict] = field(default_factory=list)  # by column: STATS_SCHEMA, then distinct and rare
    entity: int | None = None
    period: int | None = None

    def columns(self, test: Callable[[dict], bool]) -> list[int]:
        return [s["ord"] for s in self.stats if test(s)]


def report_rows(spark: SparkSession, files: list) -> tuple[DataFrame, list[str], list[str]]:
    """Rows of report texts as cells, their names, and the files that have lines; positions follow the file."""
    place = F.col("_metadata.file_path")
    lines = spark.read.text([f["path"] for f in files]).select(
        "value", place.alias("_path"), F.col("_metadata.file_block_start").alias("_block")
    )
    month_of = {plain_path(f["path"]): f["month"] for f in files}
    paths = [r["_path"] for r in lines.select("_path").distinct().collect()]
    months = _by_path(spark, {p: month_of[plain_path(p)] for p in paths}, "month")
    numbered = with_file_row_index(lines, per_file=True).join(F.broadcast(months), "_path")
    rows = drop_confidence(extract_report_rows(numbered, "value", F.col("month"), keep=["_path", ROW_INDEX]))
    names = [c for c in rows.columns if c not in ("_path", ROW_INDEX, "line_no")]
    cells = F.array(*[float_text(col(c)) if t == "double" else col(c) for c, t in rows.select(*names).dtypes])
    order = F.row_number().over(Window.partitionBy("_path").orderBy(ROW_INDEX, "line_no"))
    rows = rows.select("_path", ROW_INDEX, "line_no", cells.alias("cells")).withColumn("row", (order - 1).cast("bigint"))
    return rows.select("_path", "row", F.lit(False).alias("surplus"), "cells"), names, paths


def plain_path(path: str) -> str:
    """A path without its scheme and URL encoding: listings and rows' metadata write them differently."""
    return unquote(path).split(":", 1)[-1].lstrip("/")


def small_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A table of a row for each file or column, made as a local relation: no job reads it."""
    schema = StructType.fromDDL(ddl)
    fields = to_arrow_schema(schema)
    columns = [pa.array(values, f.type) for values, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema)


def _by_path(spark: SparkSession, values: dict[str, str], name: str) -> DataFrame:
    return small_table(spark, list(values.items()), f"_path string, {name} string")


def file_rows(spark: SparkSession, files: list, run_ids: list[str]) -> tuple[DataFrame | None, dict[str, FileRun]]:
    """``run_id, row, surplus, cells`` of all files, missing cells null, and the runs of files that have a header."""
    known = {plain_path(f["path"]): (f, run) for f, run in zip(files, run_ids)}
    runs: dict[str, FileRun] = {}
    parts, run_of = [], {}

    def add(path: str, names: list[str]) -> None:
        file, run = known[plain_path(path)]
        runs[run] = FileRun(run, file["path"], file["dataset_name"], names)
        run_of[path] = run

    tables = [f["path"] for f in files if f["route"] == "structured"]
    by_form: dict[FileFormat, list[str]] = {}
    for path, form in sorted(detect_formats(spark, tables, encoded=True).items()) if tables else []:
        by_form.setdefault(form, []).append(path)
    for form, paths in by_form.items():
        files_read = [unquote(path) for path in paths]
        try:
            names = header_names(spark, files_read[0], form)
        except ValueError:
            continue  # blank files
        for path in paths:
            add(path, names)
        rows = normalize_na_tokens(flagged_cells(spark, FileGroup(files_read, form, names)), names)
        rows = with_file_row_index(rows, per_file=True)
        cells = F.array(*[strip(col(n)) for n in names])
        parts.append(rows.select("_path", F.col(ROW_INDEX).alias("row"), F.col("_surplus").alias("surplus"), cells.alias("cells")))
    texts = [f for f in files if f["route"] == "report_text"]
    if texts:
        rows, names, paths = report_rows(spark, texts)
        for path in paths:
            add(path, names)
        parts.append(rows)
    if not parts:
        return None, runs
    ids = _by_path(spark, run_of, "run_id")  # one row a file
    rows = reduce(DataFrame.unionByName, parts).join(F.broadcast(ids), "_path")
    return rows.select("run_id", F.col("row").cast("bigint").alias("row"), "surplus", "cells"), runs


def column_figures(rows: DataFrame) -> DataFrame:
    """One row for each run and column: what decides its type, and its figures as a number."""
    long = rows.select("run_id", "surplus", F.posexplode("cells").alias("ord", "text"))
    long = long.withColumn("number", parse_number(F.col("text")))
    truth, number = F.lower("text") == "true", F.col("number")
    return long.groupBy("run_id", "ord").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("surplus")).alias("surplus"),
        F.count("text").alias("present"),
        F.count(number).alias("numbers"),
        F.count_if(F.col("text").isin(list(BOOLEANS))).alias("booleans"),
        F.count_if(truth).alias("truths"),
        F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"),
        F.when(F.count(number) > 1, F.stddev_samp(number)).when(F.count(number) == 1, F.lit(0.0)).alias("std"),
        F.count_if(number >= 0).alias("nonneg"),
    )


def typed(figure, name: str) -> dict:
    """Type and figures of one column, as the ingest path for one file decides them."""
    n, present, numbers = figure["n"], figure["present"], figure["numbers"]
    keep = {"run_id": figure["run_id"], "ord": figure["ord"], "name": name, "n": n}
    none = dict.fromkeys(("min", "max", "mean", "std")) | {"nonneg": 0}
    if not present:
        return keep | {"dtype": "double", "missing": n} | none
    if numbers / present >= NUMERIC_COERCION_RATIO:
        return keep | {"dtype": "double", "missing": n - numbers} | {k: figure[k] for k in ("min", "max", "mean", "std", "nonneg")}
    if figure["booleans"] == n:
        share = figure["truths"] / n
        std = math.sqrt(share * (1 - share) * n / (n - 1)) if n > 1 else 0.0
        return keep | {"dtype": "boolean", "missing": 0, "min": float(share == 1), "max": float(share > 0), "mean": share, "std": std, "nonneg": n}
    return keep | {"dtype": "string", "missing": n - present} | none


class GroupedBatch:
    """The staged rows of all runs with the figures that their rules share."""

    def __init__(self, rows: DataFrame, runs: dict[str, FileRun], config: dict | None = None):
        self.spark, self.rows, self.runs = rows.sparkSession, rows, runs
        self.config = rule_config(config)
        self._persisted: list[DataFrame] = []
        for f in column_figures(rows).collect():
            run = self.runs[f["run_id"]]
            run.rows, run.surplus = f["n"], f["surplus"]
            run.stats.append(typed(f, run.names[f["ord"]]))
        for run in self.runs.values():
            run.stats.sort(key=lambda s: s["ord"])

    def kept(self, df: DataFrame) -> DataFrame:
        self._persisted.append(df.persist())
        return self._persisted[-1]

    def release(self) -> None:
        for df in self._persisted:
            df.unpersist()
        self._persisted.clear()

    def enabled(self, rule: str) -> bool:
        return self.config[rule].get("enabled", True)

    def select_runs(self, runs: dict[str, FileRun]) -> None:
        """Goes on with these runs only."""
        if len(runs) < len(self.runs):
            self.rows = self.rows.filter(F.col("run_id").isin(list(runs)))
        self.runs = runs

    def marked(self, table: dict[str, list]) -> DataFrame:
        """``run_id`` and one list for each run, as a table of a row for each file."""
        rows = [(run, marks) for run, marks in table.items()]
        return F.broadcast(small_table(self.spark, rows, "run_id string, marks array<string>"))

    def cells_of(self, test: Callable[[FileRun, dict], object]) -> DataFrame:
        """``run_id, row, ord, mark, text`` of the columns for which ``test`` gives a mark."""
        marks = {}
        for run in self.runs.values():
            given = {s["ord"]: test(run, s) for s in run.stats}
            if any(m is not None for m in given.values()):
                marks[run.run_id] = [None if given.get(i) is None else str(given[i]) for i in range(len(run.names))]
        if not marks:
            return small_table(self.spark, [], "run_id string, row bigint, ord int, mark string, text string")
        both = self.rows.join(self.marked(marks), "run_id")
        return both.select("run_id", "row", F.posexplode(F.arrays_zip("marks", "cells")).alias("ord", "cell")).select(
            "run_id", "row", "ord", F.col("cell.marks").alias("mark"), F.col("cell.cells").alias("text")
        ).filter("mark is not null")

    def stats_table(self) -> DataFrame:
        fields = [part.split()[0] for part in STATS_SCHEMA.split(", ")]
        return small_table(self.spark, [tuple(s[f] for f in fields) for run in self.runs.values() for s in run.stats], STATS_SCHEMA)

    def count_values(self) -> None:
        """Counts the values of all text and period columns; what decides roles and rules reaches the driver by column."""
        counted = self.cells_of(lambda _, s: s["dtype"] if s["dtype"] == "string" or PERIOD_NAME.search(s["name"]) else None)
        rare = self.config["consistency"].get("min_value_count", 2)
        value = cell_text(F.col("text"), F.col("mark"))
        counts = counted.select("run_id", "row", "ord", value.alias("value")).filter("value is not null")
        self.counts = self.kept(counts.groupBy("run_id", "ord", "value").agg(F.count("*").alias("value_count"), F.min("row").alias("first_row")))
        figures = self.counts.groupBy("run_id", "ord").agg(F.count("*").alias("distinct"), F.count_if(F.col("value_count") < rare).alias("rare"))
        found = {(r["run_id"], r["ord"]): r for r in figures.collect()}
        for run in self.runs.values():
            for s in run.stats:
                r = found.get((run.run_id, s["ord"]))
                s["distinct"], s["rare"] = (r["distinct"], r["rare"]) if r else (0, 0)
            self.guess_roles(run)

    def guess_roles(self, run: FileRun) -> None:
        most = self.config["completeness"].get("period_max_distinct", PERIOD_MAX_DISTINCT)
        periods = run.columns(lambda s: PERIOD_NAME.search(s["name"]) is not None)
        run.period = next((i for i in periods if run.stats[i]["distinct"] <= most), None)
        usable = run.columns(
            lambda s: s["dtype"] == "string" and s["ord"] not in periods and s["distinct"] >= ENTITY_MIN_DISTINCT and s["distinct"] != run.rows
        )
        run.entity = min(usable, key=lambda i: run.stats[i]["distinct"], default=None)


def cell_text(text: Column, dtype: Column) -> Column:
    """A cell as the profile lists it: numbers in their usual form."""
    number = parse_number(text)
    return F.when(dtype == "double", float_text(number)).when(dtype == "boolean", F.lower(text)).otherwise(text)


# Rules: issues with their run_id


def completeness(batch: GroupedBatch) -> DataFrame:
    stats = batch.stats_table().withColumn("pct", F.col("missing") / F.col("n") * 100)
    return missing_issues(stats, batch.config["completeness"].get("null_pct_threshold", 20.0), "run_id")


def group_completeness(batch: GroupedBatch) -> DataFrame:
    """Each run's periods are one list of at most ``period_max_distinct``; each entity's are taken from it."""
    both = {r.run_id: [r.names[r.entity], r.names[r.period], str(r.entity), str(r.period), r.stats[r.period]["dtype"]] for r in batch.runs.values() if r.entity is not None and r.period is not None}
    if not both:
        return absence_issues(small_table(batch.spark, [], "run_id string, entity string, period string"), F.lit(""), F.lit(""), "run_id")
    rows = batch.rows.join(batch.marked(both), "run_id")
    pick = lambda k: F.get("cells", F.get("marks", F.lit(k)).cast("int"))
    period = cell_text(pick(3), F.get("marks", F.lit(4)))
    pairs = batch.kept(rows.select("run_id", pick(2).alias("entity"), period.alias("period")).distinct())
    periods = pairs.filter("period is not null").groupBy("run_id").agg(F.collect_set("period").alias("expected"))
    seen = pairs.filter("entity is not null").groupBy("run_id", "entity").agg(F.collect_set("period").alias("seen"))
    many = seen.groupBy("run_id").agg(F.count("*").alias("entities")).filter("entities > 1").select("run_id")
    absent = seen.join(F.broadcast(periods.join(many, "run_id")), "run_id")  # one row a file
    absent = absent.select("run_id", "entity", F.explode(F.array_except("expected", "seen")).alias("period"))
    named = absent.join(batch.marked(both), "run_id")
    return absence_issues(named, F.get("marks", F.lit(0)), F.get("marks", F.lit(1)), "run_id")


def duplicate(batch: GroupedBatch) -> DataFrame:
    types = {r.run_id: [s["dtype"] for s in r.stats] for r in batch.runs.values()}
    rows = batch.rows.join(batch.marked(types), "run_id")
    value = F.transform("cells", lambda cell, i: cell_text(cell, F.get("marks", i)))
    rows = rows.select(F.struct("run_id", "row").alias("key"), "run_id", value.alias("v"))
    rows = rows.withColumn("hash", F.xxhash64("run_id", "v"))
    repeated = batch.kept(repeated_hashes(rows))
    found = duplicate_rows(rows, repeated, repeated.count() <= BROADCAST_MAX_ROWS)
    return duplicate_issues(found.select("key.run_id", F.col("key.row").alias("key")), "run_id")


def validity(batch: GroupedBatch) -> DataFrame:
    params = batch.config["validity"]

    def ratio(_, s: dict) -> float | None:
        present = s["n"] - s["missing"]
        judged = s["dtype"] == "double" and present and s["min"] < 0 and not routinely_negative(present, s["nonneg"], params)
        return s["nonneg"] / present if judged else None

    cells = batch.cells_of(ratio).withColumn("value", parse_number(F.col("text"))).filter("value < 0")
    flagged = _named(batch, cells).select("run_id", F.col("row").alias("key"), "name", "ord", "value", F.col("mark").cast("double").alias("ratio"))
    return negative_issues(flagged, "run_id")


def _named(batch: GroupedBatch, cells: DataFrame) -> DataFrame:
    names = small_table(batch.spark, [(r.run_id, r.names) for r in batch.runs.values()], "run_id string, names array<string>")
    return cells.join(F.broadcast(names), "run_id").withColumn("name", F.get("names", "ord")).drop("names")


def outlier(batch: GroupedBatch) -> DataFrame:
    params = batch.config["outlier"]
    group_by = params.get("group_by")

    def entity(run: FileRun) -> int | None:
        return run.entity if run.entity is not None else run.names.index(group_by) if group_by in run.names else None

    def numeric(s: dict) -> str | None:
        return "v" if s["dtype"] == "double" and not ID_NAME.search(s["name"]) else None

    roles = []
    for r in batch.runs.values():
        e = entity(r)
        roles.append((r.run_id, [numeric(s) for s in r.stats], e, None if e is None else r.stats[e]["dtype"]))
    table = small_table(batch.spark, roles, "run_id string, wanted array<string>, entity int, kind string")
    rows = batch.rows.join(F.broadcast(table), "run_id")  # one row a file
    group = cell_text(F.get("cells", "entity"), F.col("kind"))
    rows = rows.withColumn("g", F.when(F.col("entity").isNotNull(), group)).filter("entity is null or g is not null")
    cells = rows.select("run_id", "row", "g", F.posexplode(F.arrays_zip("wanted", "cells")).alias("ord", "cell")).filter("cell.wanted is not null")
    cells = cells.select("run_id", "row", "ord", "g", parse_number(F.col("cell.cells")).alias("value")).filter("value is not null")
    # One key for run and group: the length tells where the run's name ends.
    key = F.concat(F.length("run_id").cast("string"), F.lit(":"), "run_id", F.coalesce(F.concat(F.lit("="), "g"), F.lit("")))
    cells = cells.withColumn("k", key)
    counts = cells.groupBy(F.col("k").alias("g"), F.col("ord").alias("c"), F.col("value").alias("v")).agg(F.count("*").alias("n"))
    figures = batch.kept(figures_by_group(counts, params, batch.kept)).withColumnsRenamed({"g": "k", "c": "ord"})
    few = figures.count() <= BROADCAST_MAX_ROWS
    metric, far = judged_value(F.col("value"), F.col, params)
    flagged = cells.join(F.broadcast(figures) if few else figures, ["k", "ord"]).filter(far).withColumn("metric", metric)
    flagged = _named(batch, flagged.withColumn("key", F.col("row")))
    return far_issues(flagged, params.get("method", "zscore"), "run_id")


def consistency(batch: GroupedBatch) -> DataFrame:
    params = batch.config["consistency"]
    judged = {
        f"{r.run_id}/{s['ord']}": (s["distinct"] - s["rare"], s["rare"])
        for r in batch.runs.values() for s in r.stats
        if s["dtype"] == "string" and judged_by_ratio(r.rows, s["distinct"], s["rare"], params)
    }
    if not judged:
        return naming_issues(
            small_table(batch.spark, [], "run_id string, key bigint, column string, ord int, value string, match string, score double"), "run_id"
        )
    least, limit, threshold = params.get("min_value_count", 2), params.get("max_common_candidates"), params.get("fuzzy_match_threshold", 85)
    place = F.concat("run_id", F.lit("/"), "ord")
    counts = batch.counts.withColumn("column", place).filter(F.col("column").isin(list(judged)))
    frequent, rare = counts.filter(F.col("value_count") >= least), counts.filter(F.col("value_count") < least)
    if limit is not None:
        frequent = most_frequent(frequent, limit)
        judged = {k: (min(n, limit), m) for k, (n, m) in judged.items()}
    found = best_matches(rare.select("column", "value", "first_row"), frequent.select("column", "value", "value_count"), threshold, judged, batch.kept)
    found = found.withColumn("run_id", F.substring_index("column", "/", 1)).withColumn("ord", F.substring_index("column", "/", -1).cast("int"))
    if least > 2:
        cells = batch.cells_of(lambda r, s: f"{r.run_id}/{s['ord']}" in judged or None)
        found = found.drop("first_row").join(cells.select("run_id", "ord", F.col("text").alias("value"), F.col("row").alias("first_row")), ["run_id", "ord", "value"])
    rows = _named(batch, found.withColumn("key", F.col("first_row"))).withColumn("column", F.col("name"))
    return naming_issues(rows, "run_id")


def schema_drift(batch: GroupedBatch, before: dict[str, list[tuple[str, int, str]]]) -> DataFrame:
    """``before``: the baseline's (name, place, type) of each run that has one."""
    was = [(run, *c) for run, columns in before.items() for c in columns]
    now = [(run, s["name"], s["ord"], s["dtype"]) for run in before for s in batch.runs[run].stats]
    left = small_table(batch.spark, was, "run_id string, column string, was_ord int, was_dtype string")
    right = small_table(batch.spark, now, "run_id string, column string, now_ord int, now_dtype string")
    return drift_issues(left.join(right, ["run_id", "column"], "full_outer"), "run_id")


def all_issues(batch: GroupedBatch, before: dict) -> DataFrame:
    rules = []
    if batch.enabled("completeness"):
        rules += [completeness, group_completeness]
    rules += [f for name, f in (("duplicate", duplicate), ("validity", validity), ("outlier", outlier), ("consistency", consistency)) if batch.enabled(name)]
    if batch.enabled("schema_drift"):
        rules.append(lambda b: schema_drift(b, before))
    found = side_by_side(batch.spark, *[lambda rule=rule: rule(batch) for rule in rules]) if rules else []
    empty = completeness(batch).limit(0)
    return reduce(DataFrame.unionByName, found, empty)


# Store


def rows_as_json(batch: GroupedBatch) -> DataFrame:
    """The rows for the store: a JSON object each, numbers as numbers."""
    marks = {r.run_id: [f"{s['dtype'][0]}{json.dumps(s['name'], ensure_ascii=False)}:" for s in r.stats] for r in batch.runs.values()}
    rows = batch.rows.join(batch.marked(marks), "run_id")

    def member(cell: Column, i: Column) -> Column:
        mark = F.get("marks", i)
        kind, number = F.substring(mark, 1, 1), parse_number(cell)
        quoted = F.to_json(F.array(cell))
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        plain = F.when(F.abs(number) < float("inf"), number.cast("string"))
        value = F.when(kind == "d", plain).when(kind == "b", F.lower(cell)).when(cell.isNotNull(), text)
        return F.concat(F.substring(mark, F.lit(2), F.length(mark)), F.coalesce(value, F.lit("null")))

    data = F.concat(F.lit("{"), F.array_join(F.transform("cells", member), ","), F.lit("}"))
    return rows.select("run_id", F.col("row").alias("row_index"), F.col("row").cast("string").alias("row_reference"), data.alias("data"))


def profiles(batch: GroupedBatch, runs: DataFrame) -> DataFrame:
    unique = [(r.run_id, s["ord"], s["distinct"]) for r in batch.runs.values() for s in r.stats if s["dtype"] == "string"]
    unique = small_table(batch.spark, unique, "run_id string, ord int, unique_count bigint")
    stats = batch.stats_table().join(F.broadcast(unique), ["run_id", "ord"], "left").join(F.broadcast(runs), "run_id")
    rounded = {c: round_half_even(F.col(c), 2) for c in ("mean", "std")}
    pct = F.when(F.col("n") > 0, round_half_even(F.col("missing") / F.col("n") * 100, 2)).otherwise(0.0)
    named = stats.withColumns(rounded | {"null_pct": pct}).withColumnsRenamed({"n": "row_count", "name": "column", "ord": "ordinal", "missing": "null_count"})
    return named.withColumn("created_at", F.col("timestamp")).select(*[part.split()[0] for part in PROFILE_SCHEMA.split(", ")])


def notes_of(batch: GroupedBatch) -> list[tuple[str, str, str]]:
    """``(run_id, column, note)`` for what the rules left out."""
    most = batch.config["completeness"].get("period_max_distinct", PERIOD_MAX_DISTINCT)
    limit = batch.config["consistency"].get("max_common_candidates")
    notes = []
    for run in batch.runs.values():
        for s in run.stats:
            if batch.enabled("completeness") and PERIOD_NAME.search(s["name"]) and s["distinct"] > most:
                notes.append((run.run_id, s["name"], period_note(s["distinct"], most)))
            frequent = s["distinct"] - s["rare"]
            if batch.enabled("consistency") and limit is not None and s["dtype"] == "string" and frequent > limit:
                notes.append((run.run_id, s["name"], candidate_note(frequent, limit)))
    return notes


def baselines(batch: GroupedBatch, store: RunStore) -> dict[str, list[tuple[str, int, str]]]:
    """The columns each run is compared with: its dataset's run before it in this batch, else the newest stored one."""
    newest = store.latest_columns([r.dataset_name for r in batch.runs.values()])
    before: dict[str, list] = {}
    for run in sorted(batch.runs.values(), key=lambda r: r.path):
        if newest.get(run.dataset_name):
            before[run.run_id] = newest[run.dataset_name]
        newest[run.dataset_name] = [(s["name"], s["ord"], s["dtype"]) for s in run.stats]
    return before


def ingest_files(spark: SparkSession, store: RunStore, files: list, run_ids: list[str], config: dict | None = None) -> list[tuple]:
    """Checks and stores all files as one batch; returns the reasons ``(run_id, path, reason)`` of those set aside.

    Files of one dataset follow each other by name: each is the next one's
    baseline. A file without rows, or with a line of more cells than its header,
    is set aside; the others go on.
    """
    path_of = {run: f["path"] for f, run in zip(files, run_ids)}
    rows, runs = file_rows(spark, files, run_ids)
    if rows is None:
        return [(run, path, "no rows") for run, path in path_of.items()]
    staged = f"batch-{uuid.uuid4().hex}"
    batch = None
    try:
        batch = GroupedBatch(store.stage(rows, staged), runs, config)
        good = {k: r for k, r in runs.items() if r.rows and not r.surplus}
        aside = [
            (run, path, "failed: more cells than columns" if run in runs and runs[run].surplus else "no rows")
            for run, path in path_of.items() if run not in good
        ]
        if not good:
            return aside
        batch.select_runs(good)
        store.begin(list(good))
        batch.count_values()
        store.append("quality_issues", all_issues(batch, baselines(batch, store)))
        issues = store.issues_of(list(good))
        totals = {r["run_id"]: r for r in run_totals(issues, batch.config).collect()}
        start = datetime.now(timezone.utc)
        table = []
        for nth, run in enumerate(sorted(good.values(), key=lambda r: r.path)):
            t = totals.get(run.run_id)
            table.append((run.run_id, start + timedelta(microseconds=nth), run.path, run.dataset_name, t["health_score"] if t else 100, run.rows, t["rows_flagged"] if t else 0))
        done = spark.createDataFrame(table, RUN_SCHEMA)
        texts = {f"{r.run_id}/{s['ord']}" for r in good.values() for s in r.stats if s["dtype"] == "string"}
        listed = batch.counts.filter(F.concat("run_id", F.lit("/"), "ord").isin(list(texts)))
        side_by_side(
            spark,
            lambda: store.append("dataset_rows", rows_as_json(batch)),
            lambda: store.append("dataset_profiles", profiles(batch, done)),
            lambda: store.append("profile_values", _named(batch, listed).select("run_id", F.col("name").alias("column"), "value")),
            lambda: store.append("data_lineage", lineage_table(done)),
            lambda: store.store_notes(notes_of(batch)),
        )
        store.append("quality_runs", done)  # the commit mark
        store.store_alerts(list(good))
        return aside
    finally:
        if batch is not None:
            batch.release()
        store.drop_staged(staged)
