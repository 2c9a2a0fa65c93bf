"""Inputs that Spark derives from the given tables, over all of their rows.

The given tables hold no gaps, repeats or misspellings, so these views plant
some by the values that are there. ``workloads/oracle.py`` states the same
views in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.sources.row_index import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, for tables a query writes."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, which most of them lack."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left")


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with all kinds of faults; ``doc_id`` is its row key."""
    feed = F.concat(F.lit("crawl_feed_"), "source")
    return labeled_documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("n_chars") > 13900, F.concat(feed, F.lit("_"), F.col("doc_id").cast("string")))
        .otherwise(feed)
        .alias("feed"),
        F.concat(F.lit("W"), (F.col("n_chars") % 13).cast("string")).alias("batch_week"),
        "lang",
        "n_chars",
        (F.col("n_chars") - F.lit(300.0)).alias("margin"),
        "quality",
        "toxic",
    )


INTAKE_COLUMNS = ["feed", "batch_week", "lang", "n_chars", "margin", "quality", "toxic"]


FEED_FILES = 3


def write_feed_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The feed as CSV files, dealt by ``doc_id``, with five weeks; the column ``shard`` tells them apart."""
    shard = F.pmod(F.col("doc_id"), F.lit(FEED_FILES))
    week = F.concat(F.lit("W"), (F.col("n_chars") % 5).cast("string"))
    feed = intake(spark, sf_dir).withColumn("batch_week", week).select(*INTAKE_COLUMNS, shard.alias("shard"))
    for k in range(FEED_FILES):
        feed.filter(F.col("shard") == k).coalesce(1).write.mode("append").option("header", True).csv(folder)


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("event_date", F.col("ts").cast("date"))


def uneven_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two groups, one of which holds about four fifths of the rows."""
    kind = F.when(F.col("event_type") == "purchase", F.col("event_type")).otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", "value", kind.alias("kind"))


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with twenty measures, each the value times a factor that changes with the user."""
    measures = [(F.col("value") * (F.col("user_id") % (i + 2) + 1)).alias(f"w{i}") for i in range(20)]
    return table(spark, sf_dir, "events").select("event_id", *measures)


def maker_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a maker; every part of size 7 spells its maker in a way of its own."""
    part = table(spark, sf_dir, "part")
    own = F.concat(F.lit("Maker_"), F.col("p_partkey").cast("string"), F.lit("_"), "p_brand")
    usual = F.concat(F.lit("Maker_of_"), "p_brand")
    return part.select("p_partkey", "p_type", F.when(F.col("p_size") == 7, own).otherwise(usual).alias("maker"))


def client_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the name of their client, of whom there are many; the dearest orders spell it with a letter more."""
    client = F.concat(F.lit("Client_"), F.substring(F.md5(F.col("o_custkey").cast("string").cast("binary")), 1, 10))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 498000, F.concat(client, F.lit("x"))).otherwise(client).alias("client")
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("o_orderdate").alias("order_date"),
        F.year("o_orderdate").alias("order_year"),
        F.col("l_returnflag").alias("return_flag"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messy text cells under messy headings."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias(" Order Key "),
        F.when(F.col("o_totalprice") > 480000, F.lit("x"))
        .otherwise(F.concat(F.lit(" "), cents, F.lit("\t")))
        .alias("Total Price (Cents)"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("NA"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit(" "))
        .otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\t ")))
        .alias("Order--Priority"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1.5"))
        .when(F.col("o_orderstatus") == "O", F.lit("n/a"))
        .otherwise(F.lit("1d"))
        .alias("STATUS code"),
    )


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of reports: the documents, and one short report per customer."""
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("report"), "text")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string")
    lines = F.concat(
        F.lit("Segment   of "), "c_mktsegment", F.lit("  1,"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"),
        F.lit(", "), cents, F.lit("\nno figures here\r\n  "), "c_mktsegment", F.lit(". "),
        F.col("c_custkey").cast("string"), F.lit(" -"), F.col("c_nationkey").cast("string"), F.lit(".5"),
    )
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("report"), lines.alias("text"))
    return documents.unionByName(customers)


def dropped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file path per page, of various types, some with a month in the name."""
    kind = F.length("html") % 8
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".csv", ".XLSX", ".pdf", ".txt", ".PNG", "", ".CSV", ".tiff")]),
        (kind + 1).cast("int"),
    )
    month = F.when(
        F.length("url") % 3 > 0, F.concat(F.lit("_2024-0"), (F.length("html") % 9 + 1).cast("string"))
    ).otherwise(F.lit(""))
    prefix = F.when(F.length("url") % 2 == 0, F.concat(F.substr(F.md5("url"), F.lit(1), F.lit(8)), F.lit("_"))).otherwise(
        F.lit("")
    )
    name = F.concat(prefix, F.regexp_replace(F.regexp_extract("url", "//([^/]+)/", 1), "[.]", " "), month, suffix)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/drop/"), name).alias("path"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run table: every order is a run of the dataset named by its priority."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.concat(F.lit("orders/"), "o_orderpriority", F.lit(".csv")).alias("source_file"),
        F.col("o_orderpriority").alias("dataset_name"),
        F.greatest(F.lit(0), 100 - F.floor(price / 4000).cast("int")).cast("int").alias("health_score"),
        F.col("o_custkey").alias("rows_processed"),
        F.floor(price / 20000).cast("bigint").alias("rows_flagged"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue table: every line of an order is a finding of its run."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    issue_type = (
        F.when(flag == "A", "validity")
        .when(flag == "N", "outlier")
        .when(status == "O", "consistency")
        .otherwise("duplicate")
    )
    rule = F.when(flag == "A", 3).when(flag == "N", 4).when(status == "O", 5).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_partkey").cast("string").alias("row_reference"),
        F.when(status == "O", "l_quantity").otherwise("l_extendedprice").alias("column"),
        issue_type.alias("issue_type"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of supplier "), F.col("l_suppkey").cast("string")).alias(
            "description"
        ),
        F.when(F.col("l_tax") >= 0.06, "high").when(F.col("l_tax") >= 0.03, "medium").otherwise("low").alias("severity"),
        F.col("l_partkey").alias("row_index"),
        rule.alias("rule_ord"),
        F.col("l_linenumber").alias("column_ord"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles: per priority and year, figures of two order columns."""
    year = F.year("o_orderdate").cast("string")
    grouped = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", year.alias("year"))
        .agg(
            F.max("o_orderdate").alias("created_at"),
            F.count("*").alias("row_count"),
            *[f(c).alias(f"{n}_{c}") for c in ("o_custkey", "o_totalprice") for n, f in (("min", F.min), ("max", F.max))],
        )
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("ordinal"),
            F.col(f"min_{c}").cast("double").alias("min"),
            F.col(f"max_{c}").cast("double").alias("max"),
        )
        for i, c in enumerate(("o_custkey", "o_totalprice"))
    ]
    return grouped.select(
        F.concat("o_orderpriority", F.lit("/"), "year").alias("run_id"),
        F.col("o_orderpriority").alias("dataset_name"),
        "created_at",
        "row_count",
        F.inline(F.array(*cells)),
    )
