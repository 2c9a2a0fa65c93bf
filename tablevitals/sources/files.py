"""Which way a file goes, by its name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.names import dataset_name, file_name, file_suffix, infer_month

# File types by the way they are read.
TABLE_SUFFIXES = [".csv"]
WORKBOOK_SUFFIXES = [".xlsx", ".xls"]
SCAN_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".tiff"]
REPORT_TEXT_SUFFIXES = [".txt"]


def route_files(files: DataFrame, path: str = "path", report_text: bool = False) -> DataFrame:
    """Adds ``route`` (structured, report_text or quarantine), ``reason``, month and dataset.

    Scans and workbooks are quarantined: they need their text or CSV export.
    With ``report_text``, ``.txt`` files hold the text of a scan; like a scan
    they need a month in their name.
    """
    suffix, month = file_suffix(F.col(path)), infer_month(file_name(F.col(path)))
    texts = REPORT_TEXT_SUFFIXES if report_text else []
    routed = files.withColumns({"suffix": suffix, "month": month, "dataset_name": dataset_name(F.col(path))})
    is_scan, is_text = F.col("suffix").isin(SCAN_SUFFIXES), F.col("suffix").isin(texts) if texts else F.lit(False)
    return routed.withColumn(
        "route",
        F.when(F.col("suffix").isin(TABLE_SUFFIXES), "structured")
        .when(is_text & F.col("month").isNotNull(), "report_text")
        .otherwise("quarantine"),
    ).withColumn(
        "reason",
        F.when(F.col("route") != "quarantine", F.lit(None).cast("string"))
        .when((is_scan | is_text) & F.col("month").isNull(), "no month in the file name")
        .when(is_scan, "scanned file: provide its text")
        .when(F.col("suffix").isin(WORKBOOK_SUFFIXES), "workbook: export it to CSV")
        .otherwise("unsupported file type"),
    )
