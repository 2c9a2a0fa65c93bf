"""CSV files of any encoding and any columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import col
from tablevitals.functions.names import standardize_names
from tablevitals.sources.row_index import with_file_row_index
from tablevitals.sources.tables import auto_coerce_numeric, infer_types, normalize_na_tokens, trim_strings

# What the bytes 0x80 to 0x9F mean in Windows-1252, in byte order.
# Five of them (81 8D 8F 90 9D) mean nothing there.
WINDOWS_1252 = {
    byte: bytes([byte]).decode("cp1252") for byte in range(0x80, 0xA0) if byte not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}
UNDEFINED_1252 = "[\x81\x8d\x8f\x90\x9d]"
# A line that begins outside of quotes and ends inside: whole cells, then a quote at the start of a cell that nothing closes.
WHOLE_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+'
OPEN_AT_END = rf'\A(?:{WHOLE_CELL},)*+"[^"]*+(?:""[^"]*+)*+\z'


@dataclass(frozen=True)
class FileFormat:
    """How a file has to be read."""

    encoding: str  # utf-8, windows-1252 or latin-1
    multi_line: bool
    header: str | None = None  # the first line as it stands


def detect_formats(spark: SparkSession, paths: list[str], encoded: bool = False) -> dict[str, FileFormat]:
    """Encoding and quoting of each file from one scan of its lines.

    A file is UTF-8 only if every line is; else Windows-1252 unless a byte has
    no meaning there. While no line ends inside a quoted cell that it opens,
    every line begins outside of one, so that lines can be told apart wherever
    a file is split; quotes inside a cell, as in 5" pipe, don't matter. Only
    files with line breaks in quotes are read unsplit. The keys are paths as they are
    read, or with ``encoded`` as they stand, URL-encoded, in rows' metadata.
    """
    at_start = F.col("_metadata.file_block_start") == 0
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value", at_start.alias("at_start"))
    value = F.col("value")
    valid = F.is_valid_utf8(value)
    ascii_only = valid & (F.length(value) == F.octet_length(value))
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    found = (
        lines.groupBy("path")
        .agg(
            F.bool_and(valid).alias("utf8"),
            F.bool_or(F.when(ascii_only, False).otherwise(latin.rlike(UNDEFINED_1252))).alias("undefined"),
            F.bool_or(value.contains('"') & value.rlike(OPEN_AT_END)).alias("open_quote"),
            # One task reads a file's first block from front to back.
            F.first(F.when(F.col("at_start"), value), ignorenulls=True).alias("header"),
        )
        .collect()
    )
    formats = {}
    for r in found:
        encoding = "utf-8" if r["utf8"] else "latin-1" if r["undefined"] else "windows-1252"
        formats[r["path"] if encoded else unquote(r["path"])] = FileFormat(encoding, r["open_quote"], r["header"])
    return formats


def _from_1252(value: Column) -> Column:
    """Latin-1 text read again as Windows-1252."""
    return F.translate(value, "".join(map(chr, WINDOWS_1252)), "".join(WINDOWS_1252.values()))


QUOTING = {"quote": '"', "escape": '"'}


def _reader(spark: SparkSession, form: FileFormat):
    return (
        spark.read.option("encoding", "UTF-8" if form.encoding == "utf-8" else "ISO-8859-1")
        .options(**QUOTING)
        .option("multiLine", form.multi_line)
    )


def header_names(spark: SparkSession, path: str, form: FileFormat) -> list[str]:
    """Standardized names from the header line; a blank header is named by its position.

    The line is known already; only one with quotes or other bytes than UTF-8 is read from the file.
    """
    line = form.header or ""
    if line.strip() and '"' not in line and form.encoding == "utf-8":
        first = line.split(",")
    else:
        first = _reader(spark, form).option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"no columns in {path}")
    raw = [v if v and v.strip() else f"unnamed: {i}" for i, v in enumerate(first)]
    if form.encoding == "windows-1252":
        raw = [v.encode("latin-1").decode("cp1252") for v in raw]
    return standardize_names(raw)


@dataclass(frozen=True)
class FileGroup:
    """Files that are read together: one format, one header line."""

    paths: list[str]
    form: FileFormat
    names: list[str]


def file_groups(spark: SparkSession, paths: str | list[str]) -> list[FileGroup]:
    """The files of one table by encoding, quoting and header line.

    The order of columns may differ from file to file; the set may not.
    """
    by_form: dict[FileFormat, list[str]] = {}
    for path, form in sorted(detect_formats(spark, [paths] if isinstance(paths, str) else list(paths)).items()):
        by_form.setdefault(form, []).append(path)
    if not by_form:
        raise ValueError("no columns to read")
    groups = [FileGroup(files, form, header_names(spark, files[0], form)) for form, files in by_form.items()]
    groups.sort(key=lambda g: g.paths[0])
    for g in groups[1:]:
        if set(g.names) != set(groups[0].names):
            raise ValueError(f"{g.paths[0]} has other columns than {groups[0].paths[0]}")
    return groups


def _too_many(line: Column, schema: T.StructType) -> Column:
    """If a line that hasn't as many cells as the schema has more of them.

    Empty cells are null like absent ones, so a last cell is added: it shows up
    among the schema's cells only behind a line with fewer. It is made of the
    line's hash, which no cell of the line holds.
    """
    end = F.md5(line)
    ended = F.concat(F.regexp_replace(line, "[\\r\\n]+$", ""), F.lit(","), end)
    marked = F.from_csv(ended, ", ".join(f"{c} string" for c in schema.names), QUOTING)

    def shows(cells: Column) -> Column:
        return F.exists(F.array(*[cells[c] for c in schema.names]), lambda c: F.coalesce(F.endswith(c, end), F.lit(False)))

    return ~F.transform(F.array(marked), shows)[0]


def flagged_cells(spark: SparkSession, group: FileGroup) -> DataFrame:
    """All cells as text under their names, with file, block and ``_surplus``: whether the line has more cells than the header."""
    names, form = group.names, group.form
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    # The reader fills "line" where the number of cells is not the schema's; fewer are allowed.
    whole = T.StructType([*schema.fields, T.StructField("line", T.StringType())])
    reader = _reader(spark, form).schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line")
    reader = reader.option("columnPruning", False)  # cells are counted only where all are read
    raw = reader.option("header", True).option("enforceSchema", True).csv(group.paths)
    surplus = F.when(col("line").isNull(), False).otherwise(_too_many(col("line"), schema))
    cells = [col(f"c{i}") for i in range(len(names))]
    if form.encoding == "windows-1252":
        cells = [_from_1252(c) for c in cells]
    return raw.select(
        *[c.alias(n) for c, n in zip(cells, names)],
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        surplus.alias("_surplus"),
    )


def _cells(spark: SparkSession, group: FileGroup) -> DataFrame:
    """The same, where a line with more cells than the header is refused."""
    rows = flagged_cells(spark, group)
    first = F.coalesce(col(group.names[0]), F.lit(""))
    refused = F.raise_error(F.concat(F.lit("more cells than columns in "), F.col("_path"), F.lit(" after "), first))
    # A filter holds whatever columns are asked for.
    return rows.filter(F.when(F.col("_surplus"), refused.cast("boolean")).otherwise(True)).drop("_surplus")


def scan_csv(
    spark: SparkSession,
    paths: str | list[str],
    groups: list[FileGroup] | None = None,
    with_position: bool = False,
) -> DataFrame:
    """Rows of the CSV files of one table, all columns text, missing tokens null.

    Encoding, quoting and column order are those of each file; columns meet by
    name and stand as in the first file. ``groups`` are found out unless given;
    ``with_position`` adds each row's position, files in the order of their paths.
    """
    groups = groups or file_groups(spark, paths)
    names = groups[0].names
    rows = reduce(DataFrame.unionByName, [_cells(spark, g) for g in groups])
    clean = normalize_na_tokens(rows, names)
    return with_file_row_index(clean) if with_position else clean.select(*[col(n) for n in names])


def load_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The whole ingest path for one file, or files of one table: scan, missing
    tokens, names, trim, types, position."""
    groups = file_groups(spark, paths)
    # Types come from the cells alone, so that scan needs no positions.
    types = infer_types(trim_strings(scan_csv(spark, paths, groups)))
    rows = scan_csv(spark, paths, groups, with_position=True)
    return auto_coerce_numeric(trim_strings(rows, groups[0].names), types, from_file=True)
