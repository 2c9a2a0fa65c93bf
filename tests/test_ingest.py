"""Ingest transforms, CSV files, report texts and file routing."""

import math

import pytest
from pyspark.sql import functions as F

from tablevitals.functions import names
from tablevitals.functions.pyformat import fixed_text, float_text, round_half_even
from tablevitals.operators import roles
from tablevitals.operators.batch import Batch
from tablevitals.operators.consistency import consistency
from tablevitals.operators.validity import validity
from tablevitals.sources import tables
from tablevitals.sources.csv import OPEN_AT_END, detect_formats, load_csv, scan_csv
from tablevitals.sources.files import route_files
from tablevitals.sources.reports import REPORT_COLUMNS, drop_confidence, extract_report_rows
from tablevitals.sources.row_index import with_row_index


def test_names():
    assert names.standardize_names([" Energy Requirement (MU) ", "Store Name", "Units Sold"]) == [
        "energy_requirement_mu", "store_name", "units_sold",
    ]
    assert names.standardize_names(["A b", "a_b", "a-b", ""]) == ["a_b", "a_b_2", "a_b_3", ""]
    assert names.dataset_name_of("/x/0a1b2c3d_sales.csv") == "sales"
    assert names.dataset_name_of("/x/0a1b2c3d_.csv") == "0a1b2c3d_"
    assert names.dataset_name_of("sales.v2.csv") == "sales.v2"


def test_file_names(spark):
    paths = ["/in/power_report_2026-04.pdf", "/in/scan.png", "/in/0a1b2c3d_sales.csv", "/in/notes.txt", "/in/b.XLS", "/in/none"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = {r["path"]: r for r in route_files(files).collect()}
    assert rows[paths[0]]["month"] == "2026-04" and rows[paths[1]]["month"] is None
    assert [rows[p]["route"] for p in paths] == ["quarantine", "quarantine", "structured", "quarantine", "quarantine", "quarantine"]
    assert rows[paths[1]]["reason"] == "no month in the file name"
    assert rows[paths[3]]["reason"] == "unsupported file type"
    assert rows[paths[4]]["reason"].startswith("workbook")
    assert rows[paths[2]]["dataset_name"] == names.dataset_name_of(paths[2]) == "sales"
    key = files.select(names.safe_dataset_key(F.lit("a b/c.d-é_1"))).first()[0]
    assert key == "a_b_c_d-é_1"


def test_number_texts(spark):
    values = [0.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-4, 1.5e-5, -120.0, 0.0, -0.0, 1e22, 123456789012345680.0, 2.5e-10, -1e7]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", float_text(F.col("v")).alias("t"), fixed_text(F.col("v"), 1).alias("f"), round_half_even(F.col("v"), 2).alias("r")
    )
    for r in df.collect():
        assert r["t"] == repr(r["v"])
        assert r["r"] == round(r["v"], 2)
        if abs(r["v"]) < 1e15:
            assert float(r["f"]) == float(f"{r['v']:.1f}")
    half = spark.range(1).select(fixed_text(F.lit(12.25), 1), fixed_text(F.lit(66.5), 0), round_half_even(F.lit(2.675), 2)).first()
    assert tuple(half) == ("12.2", "66", 2.67)


def test_numbers_and_missing_tokens(spark):
    good = ["1", "-2.5", "+3", ".5", "4.", "1e5", "inf", " 7 ", "Infinity"]
    bad = ["1d", "1f", "0x10", "1,000", "12%", "$5", "nan", "1_000", "", "abc", "1e", "i"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    parsed = {r[0]: r[1] for r in df.select("t", tables.parse_number(F.col("t"))).collect()}
    assert all(parsed[t] == float(t) for t in good) and all(parsed[t] is None for t in bad)
    cells = spark.createDataFrame([("NA",), ("",), (" ",), ("null",), ("Na",)], "t string")
    clean = tables.trim_strings(tables.normalize_na_tokens(cells))
    assert [r[0] for r in clean.collect()] == [None, None, "", None, "Na"]
    wide = spark.createDataFrame([("　x\xa0\t",)], "t string")
    assert tables.trim_strings(wide).first()[0] == "x"


def test_coercion_ratio(spark):
    rows = [(str(i), "x" if i < 2 else str(i), f"n{i}", None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e int")
    typed = tables.auto_coerce_numeric(df)
    assert [f.dataType.simpleString() for f in typed.schema] == ["double", "double", "string", "string", "double"]
    assert typed.filter("b is null").count() == 2
    worse = spark.createDataFrame([("x",)] * 3 + [("1",)] * 20, "b string")
    assert tables.auto_coerce_numeric(worse).schema["b"].dataType.simpleString() == "string"


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_csv_files(spark, tmp_path):
    trademark = "™"
    cp1252 = write(tmp_path, "w.csv", f"product,price\nSuperWidget{trademark} “X”,19.99\n".encode("cp1252"))
    row = load_csv(spark, cp1252).first()
    assert row["product"] == f"SuperWidget{trademark} “X”" and row["price"] == 19.99
    latin = write(tmp_path, "l.csv", b"a,b\ncaf\xe9\x81,1\n")
    assert load_csv(spark, latin).first()["a"] == "caf\xe9\x81"
    bom = write(tmp_path, "u.csv", "﻿Store Name,Units Sold,Ok,Empty\nÉ,\"1\",TRUE,\n\"a\"\"b, c\",2,false,\n".encode())
    df = load_csv(spark, bom)
    assert df.columns[:4] == ["store_name", "units_sold", "ok", "empty"]
    assert [f.dataType.simpleString() for f in df.schema][:4] == ["string", "double", "boolean", "double"]
    assert [tuple(r)[:3] for r in df.orderBy("_row_index").collect()] == [("É", 1.0, True), ('a"b, c', 2.0, False)]
    quoted = write(tmp_path, "q.csv", b'a,b\n"line one\nline two",1\nx,2\n')
    assert [f.multi_line for f in detect_formats(spark, [quoted]).values()] == [True]
    assert [r["a"] for r in load_csv(spark, quoted).orderBy("_row_index").collect()] == ["line one\nline two", "x"]
    with pytest.raises(ValueError):
        load_csv(spark, write(tmp_path, "e.csv", b""))


def test_files_of_one_table(spark, tmp_path):
    """Columns meet by name, each file in its own encoding."""
    paths = [
        write(tmp_path, "a.csv", b"id,name,v\n1,x,10\n2,y\n"),
        write(tmp_path, "b.csv", b"v,id,name\n99,7,caf\xe9\n"),
        write(tmp_path, "c.csv", "id,name,v\n8,é,3\n".encode()),
    ]
    df = load_csv(spark, paths)
    rows = df.select("id", "name", "v").orderBy("_row_index").collect()
    assert [tuple(r) for r in rows] == [(1.0, "x", 10.0), (2.0, "y", None), (7.0, "café", 99.0), (8.0, "é", 3.0)]
    assert [r[0] for r in df.select("_row_index").orderBy("_row_index").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="other columns"):
        load_csv(spark, [paths[0], write(tmp_path, "d.csv", b"id,other,v\n1,x,10\n")])


def test_surplus_cells_are_refused(spark, tmp_path):
    path = write(tmp_path, "r.csv", b"id,name,v\n1,x,10\n2,y,20,EXTRA\n")
    with pytest.raises(Exception, match="more cells than columns in .*r.csv after 2"):
        load_csv(spark, path).collect()


@pytest.mark.parametrize(
    "line",
    [b"2,y,20,,EXTRA", b"2,y,20,", b"2,y,,", b'2,"y,z",20,,', b"2,,,,,,", b'2,"y\nz",20,,EXTRA', b'2,"y\nz",,', "2,é,20,,X".encode("latin-1")],
)
def test_empty_surplus_cells_are_refused(spark, tmp_path, line):
    path = write(tmp_path, "s.csv", b"id,name,v\n1,x,10\n" + line + b"\n3,z,30\n")
    with pytest.raises(Exception, match="more cells than columns in .*s.csv after 2"):
        load_csv(spark, path).collect()
    with pytest.raises(Exception, match="more cells than columns"):
        scan_csv(spark, path).select("v").collect()


def test_lines_with_fewer_cells_stay(spark, tmp_path):
    path = write(tmp_path, "f.csv", b'id,name,v\n1,x,\n2\n3,"y, z"\n4,,\n5,"a\n""b"""\n,,\n')
    rows = scan_csv(spark, path, with_position=True).orderBy("_row_index").collect()
    assert [tuple(r)[:3] for r in rows] == [
        ("1", "x", None), ("2", None, None), ("3", "y, z", None), ("4", None, None), ("5", 'a\n"b"', None), (None, None, None),
    ]


def test_positions_of_a_split_file(spark, tmp_path):
    """A file read in many blocks keeps its line order."""
    path = write(tmp_path, "big.csv", b"k\n" + b"".join(b"%d\n" % i for i in range(30000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = load_csv(spark, path)
        assert df.rdd.getNumPartitions() > 1
        assert df.filter(F.col("k") != F.col("_row_index")).count() == 0
        assert df.count() == 30000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_positions_across_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for n in range(3):
        write(tmp_path / "t", f"{n}.csv", b"k\n" + b"".join(b"%d\n" % (100 * n + i) for i in range(100)))
    df = load_csv(spark, str(tmp_path / "t"))
    assert [(r["k"], r["_row_index"]) for r in df.orderBy("_row_index").collect()] == [(float(i), i) for i in range(300)]


def test_with_row_index(spark):
    """Ties make up a third of the rows; every position is given once, in order."""
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11)).alias("k")).repartition(5)
    rows = with_row_index(df, ["k"], partitions=6).collect()
    assert sorted(r["_row_index"] for r in rows) == list(range(5000))
    keys = [r["k"] for r in sorted(rows, key=lambda r: r["_row_index"])]
    assert keys == sorted(keys)
    assert with_row_index(df.filter("k > 99"), ["k"]).count() == 0


def test_report_digits_of_other_scripts(spark):
    rows = report(spark, "Assam १,६००.५ -१५८०\nBihar ٤٣٠٠ 4100.٢٥\nGoa １２ \U0001d7d7\nKerala \U00011f51 2\nSikkim 3 x४").collect()
    assert [tuple(r)[1:4] for r in rows] == [
        ("Assam", 1600.5, -1580.0), ("Bihar", 4300.0, 4100.25), ("Goa", 12.0, 9.0), ("Kerala", 1.0, 2.0),
    ]


def test_roles(spark):
    modes, regions = ["air", "road", "sea"], ["n", "s", "e", "w"]
    rows = [(modes[i % 3], regions[i % 4], f"cat{i % 15}", f"2024-{i % 12 + 1:02}", f"d{i % 250}") for i in range(300)]
    df = spark.createDataFrame(rows, "ship_mode string, region string, product_sub_category string, month string, order_date string")
    assert roles.guess_entity_column(df, exclude=roles.period_like_columns(df)) == "product_sub_category"
    assert roles.guess_period_column(df) == "month"
    assert roles.guess_period_column(df.select("order_date")) is None
    ids = spark.createDataFrame([(1, 2, 3, 4.0, "x")], "row_id int, customer_id bigint, postal_code int, unit_price double, id string")
    assert roles.id_like_numeric_columns(ids) == ["row_id", "customer_id", "postal_code"]
    assert roles.outlier_columns(ids) == ["unit_price"]
    assert roles.period_like_columns(spark.createDataFrame([(1, 2, 3)], "order_date int, ship_date int, amount int")) == ["order_date", "ship_date"]


def report(spark, text):
    return extract_report_rows(spark.createDataFrame([(text,)], "text string"), month=F.lit("2026-04"))


def test_report_text(spark):
    rows = report(spark, "Assam 1600 1580\nBihar 4300 4100\n\nheading\n").collect()
    assert [tuple(r) for r in rows] == [
        ("2026-04", "Assam", 1600.0, 1580.0, "low"), ("2026-04", "Bihar", 4300.0, 4100.0, "low"),
    ]
    assert report(spark, "Uttar   Pradesh.  1,234.5, -50 7").first()[1:4] == ("Uttar Pradesh", 1234.5, -50.0)
    assert report(spark, "").columns == REPORT_COLUMNS and report(spark, "").count() == 0
    assert report(spark, "No digits here\n1 2 3\nA 1 2").count() == 0
    negative = with_row_index(drop_confidence(report(spark, "Jharkhand 2400 -50\nBihar 1 1")), ["state_name"])
    assert validity(Batch(negative)).count() == 1
    variant = with_row_index(drop_confidence(report(spark, "Odisha 4560 4490\nOdisha 4560 4490\nOrissa 4600 4550")), ["state_name"])
    assert consistency(Batch(variant)).count() == 1
    long_line = report(spark, "word " * 40000 + "Goa 5 6")
    assert long_line.first()["energy_availability_mu"] == 6.0
    assert not math.isnan(long_line.first()["energy_requirement_mu"])


def test_stray_quotes_leave_a_file_split(spark, tmp_path):
    """An inch mark inside a cell is no quoting: the file is read by many tasks, its rows in order."""
    path = tmp_path / "pipes.csv"
    lines = [f'{i},"a ""{i}""",{"5" + chr(34) + " pipe" if i % 1000 == 7 else "plain"},{i % 7}' for i in range(40_000)]
    path.write_text("n,name,kind,w\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        (form,) = detect_formats(spark, [str(path)]).values()
        assert not form.multi_line
        df = load_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 5
        rows = df.orderBy("_row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["_row_index"], r["n"]) for r in rows] == [(i, float(i)) for i in range(40_000)]
    assert rows[7]["kind"] == '5" pipe' and rows[8]["kind"] == "plain" and rows[8]["name"] == 'a "8"'


def test_lines_that_end_in_quotes(spark):
    lines = {
        'a,b': False, '"a",b': False, '"a': True, 'x,"a': True, 'x,"a"': False, 'x,"a""': True, 'x,"a"""': False, '': False, '"': True,
        '""': False, '5" x,"abc': True, '5" x,"abc"': False, 'x, "a': False, 'x,,"': True, '"a"b,"c': True, '"a,b",c"d': False, 'a""b"': False,
    }
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert {r["value"]: r["open"] for r in df.select("value", F.col("value").rlike(OPEN_AT_END).alias("open")).collect()} == lines


def test_file_names_with_spaces(spark, tmp_path):
    path = tmp_path / "two words 100%.csv"
    path.write_text('a,b\n1,"x\ny"\n')
    assert [r["b"] for r in load_csv(spark, str(path)).collect()] == ["x\ny"]
