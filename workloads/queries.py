"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.functions import names
from tablevitals.functions.columns import ROW_INDEX
from tablevitals.functions.fuzzy import wratio_udf
from tablevitals.operators import alerts, roles, score
from tablevitals.operators.batch import Batch
from tablevitals.operators.completeness import completeness, group_completeness
from tablevitals.operators.consistency import consistency
from tablevitals.operators.drift import schema_drift
from tablevitals.operators.duplicates import duplicate
from tablevitals.operators.outliers import outlier
from tablevitals.operators.profile import (
    distinct_counts,
    null_badge,
    numeric_summary,
    profile_columns,
    text_summary,
    unique_values,
    value_counts,
)
from tablevitals.operators.validity import validity
from tablevitals.plans import reports, store
from tablevitals.plans.pipeline import run_all_rules, run_batch
from tablevitals.sources import tables
from tablevitals.sources.csv import load_csv, scan_csv
from tablevitals.sources.files import route_files
from tablevitals.sources.reports import drop_confidence, extract_report_rows
from tablevitals.sources.row_index import with_row_index
from tablevitals.streaming.folder import ingest_folder
from workloads import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATASET = "3-MEDIUM"  # the dataset whose history is reported
RUN = "7"  # the run whose issues and preview are reported


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def findings(issues: DataFrame) -> DataFrame:
    return issues.select("row_reference", "column", "issue_type", "description", "severity")


# Scans and ingest transforms


@query
def scan_csv_files(spark, sf_dir):
    """Orders written as CSV, then scanned back as text."""
    path = inputs.work_folder(spark)
    inputs.table(spark, sf_dir, "orders").drop("o_orderdate").write.option("header", True).csv(path)
    return scan_csv(spark, path)


@query
def load_csv_file(spark, sf_dir):
    """The same with typing, from Windows-1252 bytes."""
    path = inputs.work_folder(spark)
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Customer Key"),
        F.concat(F.lit(" "), "c_name", F.lit(" caf\xe9 ")).alias("Customer NAME"),
        F.col("c_acctbal").alias("Balance (USD)"),
    )
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return load_csv(spark, path).drop(ROW_INDEX)


@query
def normalize_na_tokens(spark, sf_dir):
    return tables.normalize_na_tokens(inputs.raw_orders(spark, sf_dir)).toDF("key", "price", "priority", "status")


@query
def standardize_columns(spark, sf_dir):
    return tables.standardize_columns(inputs.raw_orders(spark, sf_dir))


@query
def trim_strings(spark, sf_dir):
    return tables.trim_strings(inputs.raw_orders(spark, sf_dir)).toDF("key", "price", "priority", "status")


@query
def auto_coerce_numeric(spark, sf_dir):
    cells = tables.normalize_na_tokens(inputs.raw_orders(spark, sf_dir))
    return tables.auto_coerce_numeric(tables.trim_strings(cells)).toDF("key", "price", "priority", "status")


@query
def load_table(spark, sf_dir):
    return tables.load_table(inputs.raw_orders(spark, sf_dir), ["order_key"]).withColumnRenamed(ROW_INDEX, "row_index")


@query
def with_row_index_lines(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = inputs.table(spark, sf_dir, "lineitem").select(*order)
    return with_row_index(rows, order).withColumnRenamed(ROW_INDEX, "row_index")


@query
def extract_rows(spark, sf_dir):
    return extract_report_rows(inputs.report_texts(spark, sf_dir), keep=["report"])


@query
def drop_confidence_column(spark, sf_dir):
    rows = drop_confidence(extract_report_rows(inputs.report_texts(spark, sf_dir)))
    return rows.groupBy("month", "state_name").agg(
        F.count("*").alias("rows"), F.max("energy_requirement_mu").alias("most")
    )


@query
def infer_month(spark, sf_dir):
    files = inputs.dropped_files(spark, sf_dir)
    return files.select("page_id", names.infer_month(names.file_name(F.col("path"))).alias("month"))


@query
def dataset_name(spark, sf_dir):
    return inputs.dropped_files(spark, sf_dir).select("page_id", names.dataset_name(F.col("path")).alias("dataset_name"))


@query
def safe_dataset_key(spark, sf_dir):
    files = inputs.dropped_files(spark, sf_dir)
    return files.select("page_id", names.safe_dataset_key(names.dataset_name(F.col("path"))).alias("dataset_key"))


@query
def route_dropped_files(spark, sf_dir):
    return route_files(inputs.dropped_files(spark, sf_dir)).select("page_id", "route", "reason")


@query
def ingest_folder_stream(spark, sf_dir):
    """A feed as arriving CSV files through the stream into a run store: figures, issues by type and alert of every run."""
    root = inputs.work_folder(spark)
    inputs.write_feed_files(spark, sf_dir, f"{root}/in")
    run_store = store.RunStore(spark, f"{root}/store")
    ingest_folder(spark, f"{root}/in", run_store, f"{root}/stream").awaitTermination()
    number = lambda name: F.get_json_object("data", f"$.{name}").cast("double")
    stored = run_store.rows().groupBy("run_id").agg(
        F.max(number("shard")).cast("bigint").alias("shard"), F.count("*").alias("rows_stored"),
        F.max(number("n_chars")).alias("longest"), F.min(number("margin")).alias("least"),
    )
    kinds = ("completeness", "duplicate", "validity", "outlier", "consistency", "schema_drift")
    counts = run_store.issues().groupBy("run_id").agg(*[F.count_if(F.col("issue_type") == k).alias(k) for k in kinds])
    alerts_of = run_store.alerts().select("run_id", F.lit(True).alias("alerted"))
    runs = run_store.runs().join(stored, "run_id").join(counts, "run_id", "left").join(alerts_of, "run_id", "left")
    return runs.select(
        "shard", "rows_processed", "rows_stored", "longest", "least", "health_score", "rows_flagged",
        *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds], F.coalesce("alerted", F.lit(False)).alias("alerted"),
    )


@query
def unjudged_columns(spark, sf_dir):
    """What the rules leave out: a period column of many days, and frequent names beyond a limit."""
    limited = {"consistency": {"max_common_candidates": 20}}
    dated = Batch(inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    named = Batch(inputs.client_orders(spark, sf_dir), "o_orderkey", config=limited)
    notes = [("orders", *n) for n in dated.notes] + [("clients", *n) for n in named.notes]
    return spark.createDataFrame(notes, "source string, column string, note string")


# Roles and profile


def _name_and_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    return value_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct_values"))


@query
def period_like_columns(spark, sf_dir):
    df = inputs.shipments(spark, sf_dir)
    return _name_and_distinct(df, roles.period_like_columns(df))


@query
def guess_period_column(spark, sf_dir):
    df = inputs.shipments(spark, sf_dir)
    return _name_and_distinct(df, [roles.guess_period_column(df)])


@query
def id_like_numeric_columns(spark, sf_dir):
    df = inputs.shipments(spark, sf_dir)
    return _name_and_distinct(df, roles.id_like_numeric_columns(df))


@query
def outlier_columns(spark, sf_dir):
    df = inputs.shipments(spark, sf_dir)
    return _name_and_distinct(df, roles.outlier_columns(df))


@query
def guess_entity_column(spark, sf_dir):
    df = inputs.intake(spark, sf_dir)
    distinct = distinct_counts(value_counts(df, ["feed", "batch_week", "lang"]))
    exclude = roles.period_like_columns(df)
    return _name_and_distinct(df, [roles.guess_entity_column(df, exclude=exclude, distinct=distinct)])


@query
def profile(spark, sf_dir):
    return profile_columns(inputs.labeled_documents(spark, sf_dir))


@query
def numeric_summary_lines(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "lineitem")
    return numeric_summary(df, ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query
def text_summary_parts(spark, sf_dir):
    return text_summary(inputs.table(spark, sf_dir, "part"))


@query
def unique_values_parts(spark, sf_dir):
    return unique_values(inputs.table(spark, sf_dir, "part"))


@query
def value_counts_lines(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem")
    counts = value_counts(lines, ["l_returnflag", "l_linestatus", "l_shipdate"])
    return counts.select("column", "value", "value_count")


@query
def null_badges(spark, sf_dir):
    shares = null_badge(numeric_summary(inputs.labeled_documents(spark, sf_dir)))
    return shares.select("column", "null_pct", "badge")


# Rules


@query
def completeness_rule(spark, sf_dir):
    return findings(completeness(Batch(inputs.labeled_documents(spark, sf_dir), "doc_id")))


@query
def group_completeness_rule(spark, sf_dir):
    batch = Batch(inputs.dated_events(spark, sf_dir), "event_id")
    return findings(group_completeness(batch, "user_id", "event_date"))


@query
def duplicate_rule(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents")
    return findings(duplicate(Batch(documents, "doc_id", ["text"])))


@query
def duplicate_rule_orders(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    return findings(duplicate(Batch(orders, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])))


@query
def validity_rule(spark, sf_dir):
    return findings(validity(Batch(inputs.table(spark, sf_dir, "customer"), "c_custkey")))


@query
def validity_rule_strict(spark, sf_dir):
    """The same at a ratio of 0.92, which the customers' balances miss and the suppliers' reach."""
    strict = {"validity": {"nonnegative_ratio_threshold": 0.92}}
    customer = Batch(inputs.table(spark, sf_dir, "customer"), "c_custkey", config=strict)
    supplier = Batch(inputs.table(spark, sf_dir, "supplier"), "s_suppkey", config=strict)
    return findings(validity(customer).unionByName(validity(supplier)))


@query
def outlier_zscore(spark, sf_dir):
    return findings(outlier(Batch(inputs.table(spark, sf_dir, "events"), "event_id"), ["value"]))


@query
def outlier_grouped(spark, sf_dir):
    return findings(outlier(Batch(inputs.table(spark, sf_dir, "events"), "event_id"), ["value"], "event_type"))


@query
def outlier_iqr(spark, sf_dir):
    config = {"outlier": {"method": "iqr"}}
    return findings(outlier(Batch(inputs.table(spark, sf_dir, "events"), "event_id", config=config), ["value"]))


@query
def outlier_iqr_grouped(spark, sf_dir):
    config = {"outlier": {"method": "iqr"}}
    documents = Batch(inputs.table(spark, sf_dir, "documents"), "doc_id", config=config)
    return findings(outlier(documents, ["n_chars"], "source"))


@query
def outlier_hot_groups(spark, sf_dir):
    """A group with most of the rows, over several partitions of the counted values."""
    return findings(outlier(Batch(inputs.uneven_events(spark, sf_dir), "event_id"), ["value"], "kind"))


@query
def outlier_wide(spark, sf_dir):
    """Twenty columns at once."""
    return findings(outlier(Batch(inputs.wide_events(spark, sf_dir), "event_id"), [f"w{i}" for i in range(20)]))


@query
def consistency_rule(spark, sf_dir):
    return findings(consistency(Batch(inputs.maker_parts(spark, sf_dir), "p_partkey")))


@query
def consistency_many_candidates(spark, sf_dir):
    """Far more frequent values than one list of candidates holds."""
    return findings(consistency(Batch(inputs.client_orders(spark, sf_dir), "o_orderkey")))


@query
def fuzzy_wratio(spark, sf_dir):
    """Scores of one-word pairs, of similar and of different lengths."""
    part = inputs.table(spark, sf_dir, "part")
    pair = lambda name, a, b: F.struct(F.lit(name).alias("pair"), a.alias("a"), b.alias("b"))
    size_brand = F.concat(F.lit("Brand#"), F.col("p_size").cast("string"))
    name = F.regexp_replace("p_name", " ", "_")
    cells = [pair("brand", F.col("p_brand"), size_brand), pair("name", name, F.substr(name, F.lit(3), F.lit(3)))]
    pairs = part.select(F.inline(F.array(*cells)))
    distinct = pairs.groupBy("pair", "a", "b").agg(F.count("*").alias("parts"))
    return distinct.select("pair", "a", "b", "parts", F.round(wratio_udf("a", "b").cast("double"), 3).alias("score"))


def _earlier_profile(spark, sf_dir) -> DataFrame:
    """A profile of the intake as it might have been before."""
    before = inputs.intake(spark, sf_dir).select(
        "feed", F.col("lang").alias("language"), F.col("n_chars").cast("int").alias("n_chars"), "batch_week", "margin", "quality"
    )
    return profile_columns(before)


@query
def schema_drift_rule(spark, sf_dir):
    batch = Batch(inputs.intake(spark, sf_dir), "doc_id", inputs.INTAKE_COLUMNS)
    return findings(schema_drift(batch, _earlier_profile(spark, sf_dir)))


@query
def rule_toggle(spark, sf_dir):
    """All rules but the heavy ones switched off."""
    off = {r: {"enabled": False} for r in ("duplicate", "outlier", "consistency", "schema_drift", "completeness")}
    return findings(run_all_rules(Batch(inputs.intake(spark, sf_dir), "doc_id", inputs.INTAKE_COLUMNS, config=off)))


def _all_issues(spark, sf_dir) -> DataFrame:
    batch = Batch(inputs.intake(spark, sf_dir), "doc_id", inputs.INTAKE_COLUMNS)
    return run_all_rules(batch, _earlier_profile(spark, sf_dir))


@query
def all_rules(spark, sf_dir):
    return findings(_all_issues(spark, sf_dir))


@query
def batch_health(spark, sf_dir):
    """Deductions of one checked batch with its score; a clean batch has one row without an issue type and scores 100."""
    found = _all_issues(spark, sf_dir).withColumn("run_id", F.lit("intake"))
    lost = score.deductions(found)
    total = lost.agg(F.coalesce(F.sum("points_deducted"), F.lit(0)).alias("lost")).withColumn("run_id", F.lit("intake"))
    scored = total.select("run_id", F.greatest(F.lit(0).cast("bigint"), 100 - F.col("lost")).cast("int").alias("score"))
    health = scored.join(lost, "run_id", "left").fillna(0, ["issue_count", "penalty_weight", "points_deducted"])
    return health.select("issue_type", "issue_count", "penalty_weight", "points_deducted", "score")


# Scores and alerts


@query
def issue_counts(spark, sf_dir):
    return score.issue_counts(inputs.issues(spark, sf_dir)).drop("first_rule")


@query
def deductions(spark, sf_dir):
    return score.deductions(inputs.issues(spark, sf_dir))


@query
def health_score(spark, sf_dir):
    return score.health_score(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir))


@query
def rows_flagged(spark, sf_dir):
    return score.rows_flagged(inputs.issues(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir).select("run_id", "dataset_name", "source_file", "rows_processed")
    summary = runs.join(score.run_totals(inputs.issues(spark, sf_dir)), "run_id", "left")
    # A run without issues has lost nothing.
    counts = ["total_deducted", "total_issues", "high_issues", "rows_flagged"]
    return summary.fillna(0, counts).fillna(100, ["health_score"])


@query
def run_report(spark, sf_dir):
    found = inputs.issues(spark, sf_dir)
    return reports.printable_report(inputs.runs(spark, sf_dir), score.deductions(found), found)


@query
def score_band(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir)
    return runs.groupBy(score.score_band(F.col("health_score")).alias("band")).agg(F.count("*").alias("runs"))


@query
def should_alert(spark, sf_dir):
    flagged = alerts.should_alert(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir))
    return flagged.select("run_id", "high_issues", "alert")


@query
def alert_message(spark, sf_dir):
    return alerts.alert_message(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir), limit=2)


@query
def alert_batch(spark, sf_dir):
    return alerts.alert_batch(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir))


# Reports


@query
def dataset_summary(spark, sf_dir):
    return reports.dataset_summary(inputs.runs(spark, sf_dir))


@query
def issue_breakdown(spark, sf_dir):
    return reports.issue_breakdown(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir))


@query
def issue_breakdown_dataset(spark, sf_dir):
    return reports.issue_breakdown(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir), DATASET)


@query
def breakdown_pivot(spark, sf_dir):
    return reports.breakdown_pivot(reports.issue_breakdown(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir)))


@query
def run_history(spark, sf_dir):
    return reports.run_history(inputs.runs(spark, sf_dir), DATASET)


@query
def score_trend(spark, sf_dir):
    return reports.score_trend(inputs.runs(spark, sf_dir), DATASET)


@query
def issue_history(spark, sf_dir):
    return reports.issue_history(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir), DATASET)


@query
def list_runs(spark, sf_dir):
    return reports.list_runs(inputs.runs(spark, sf_dir))


@query
def latest_profile(spark, sf_dir):
    return reports.latest_profile(inputs.profiles(spark, sf_dir), DATASET)


@query
def run_profile(spark, sf_dir):
    stored = inputs.profiles(spark, sf_dir)
    return reports.run_profile(stored, stored, f"{DATASET}/1996")


@query
def run_issues(spark, sf_dir):
    return reports.run_issues(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir), RUN)


@query
def run_preview(spark, sf_dir):
    """First rows of a run whose rows are the customers."""
    rows = store.rows_table(inputs.table(spark, sf_dir, "customer"), RUN, "c_custkey")
    return reports.run_preview(inputs.runs(spark, sf_dir), rows, RUN)


@query
def export_run_report(spark, sf_dir):
    """Written as CSV and read back."""
    path = inputs.work_folder(spark)
    report = reports.run_report(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir))
    reports.write_csv(report.withColumn("run_timestamp", F.col("run_timestamp").cast("string")), path)
    schema = report.withColumn("run_timestamp", F.col("run_timestamp").cast("string")).schema
    read = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return read.na.fill("")


@query
def export_dataset_runs(spark, sf_dir):
    path = inputs.work_folder(spark)
    history = reports.run_history(inputs.runs(spark, sf_dir), DATASET)
    reports.write_csv(history, path)
    return spark.read.schema(history.schema).option("header", True).csv(path)


@query
def export_dataset_issues(spark, sf_dir):
    path = inputs.work_folder(spark)
    history = reports.issue_history(inputs.runs(spark, sf_dir), inputs.issues(spark, sf_dir), DATASET)
    reports.write_csv(history, path)
    return spark.read.schema(history.schema).option("header", True).option("escape", '"').csv(path)


# Run store


def _store(spark) -> store.RunStore:
    return store.RunStore(spark, inputs.work_folder(spark))


def _finished_run(spark, run_store: store.RunStore) -> DataFrame:
    run = store.runs_table(spark, run_id="r1", source_file="orders", dataset_name="orders", health_score=0)
    run = run.withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    run_store.store_run(run)
    return run


@query
def json_safe_record(spark, sf_dir):
    df = inputs.labeled_documents(spark, sf_dir).withColumn("share", F.expr("if(quality is null, double('NaN'), 0.5D)"))
    return df.select("doc_id", store.json_safe_record(df, ["source", "n_chars", "quality", "share"]).alias("data"))


@query
def store_rows(spark, sf_dir):
    run_store = _store(spark)
    run_store.store_rows(inputs.table(spark, sf_dir, "customer"), "r1", "c_custkey")
    _finished_run(spark, run_store)
    return run_store.rows()


@query
def store_issues(spark, sf_dir):
    run_store = _store(spark)
    run_store.store_issues(validity(Batch(inputs.table(spark, sf_dir, "customer"), "c_custkey")), "r1")
    _finished_run(spark, run_store)
    return findings(run_store.issues())


@query
def store_profile(spark, sf_dir):
    run_store = _store(spark)
    run = _finished_run(spark, run_store)
    run_store.store_profile(profile_columns(inputs.table(spark, sf_dir, "part")), run)
    return run_store.profiles().select("run_id", "dataset_name", "column", "dtype", "null_count", "min", "max", "unique_count")


@query
def store_runs_and_lineage(spark, sf_dir):
    """One run per dataset of the run table, with its lineage."""
    run_store = _store(spark)
    newest = reports.dataset_summary(inputs.runs(spark, sf_dir)).select(
        F.concat(F.lit("latest-"), "latest_run_id").alias("run_id"),
        F.col("latest_run_at").alias("timestamp"),
        F.col("dataset_name").alias("source_file"),
        "dataset_name",
        F.col("latest_health_score").alias("health_score"),
        "rows_processed",
        "rows_flagged",
    )
    run_store.store_lineage(newest)
    run_store.store_run(newest)
    steps = run_store.lineage().select("run_id", F.array_join("transformations_applied", ",").alias("steps"), "destination_table")
    return run_store.runs().join(steps, "run_id")


@query
def store_run_atomic(spark, sf_dir):
    """A whole batch into the store; rows of a run without its marker stay unseen."""
    run_store = _store(spark)
    customers = inputs.table(spark, sf_dir, "customer")
    run_store.store_rows(customers, "unfinished", "c_custkey")
    result = run_batch(spark, customers, dataset_name="customer", store=run_store, row_key="c_custkey", run_id="r1")
    rows = run_store.rows().groupBy("run_id").agg(F.count("*").alias("rows_stored"))
    return (
        run_store.runs()
        .join(rows, "run_id")
        .join(score.issue_counts(result.issues), "run_id")
        .select("run_id", "dataset_name", "health_score", "rows_processed", "rows_flagged", "rows_stored", "issue_type", "issue_count")
    )
