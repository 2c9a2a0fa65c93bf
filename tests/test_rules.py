"""Each rule on small frames with known findings."""

import random
import time

import numpy as np

from tablevitals.operators.batch import Batch
from tablevitals.operators.completeness import completeness, group_completeness
from tablevitals.operators.consistency import best_matches, consistency
from tablevitals.operators.drift import schema_drift
from tablevitals.operators.duplicates import duplicate
from tablevitals.operators.outliers import outlier
from tablevitals.operators.profile import profile_columns
from tablevitals.operators.validity import validity
from tablevitals.plans.pipeline import run_all_rules


def batch(spark, columns, rows, **kwargs):
    """A batch of rows numbered from 0; ``columns`` is a DDL schema."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row_index bigint, " + columns).coalesce(2)
    return Batch(df, **kwargs)


def flagged(issues):
    return sorted(int(r["row_reference"]) for r in issues.collect())


def test_completeness(spark):
    hit = completeness(batch(spark, "a double, b double", [(1.0, 5.0)] + [(1.0, None)] * 4)).collect()
    assert [(r["column"], r["severity"], r["row_reference"]) for r in hit] == [("b", "high", "column")]
    assert hit[0]["description"] == "Column 'b' is 80.0% empty (4/5 rows) — above the 20.0% threshold"
    edge = batch(spark, "a double, b double", [(1.0, None)] + [(1.0, 2.0)] * 4)
    assert completeness(edge).count() == 0  # exactly 20 %
    off = batch(spark, "a double", [(None,)] * 3, config={"completeness": {"enabled": False}})
    assert completeness(off).count() == 0
    assert completeness(batch(spark, "a double", [])).count() == 0
    nan = batch(spark, "a double", [(float("nan"),), (1.0,)])
    assert completeness(nan).first()["severity"] == "medium"  # 50 % is not over 50


def test_group_completeness(spark):
    rows = [("a", "p1"), ("b", "p1"), ("a", "p2"), (None, "p3"), ("c", None)]
    found = group_completeness(batch(spark, "e string, p string", rows), "e", "p").collect()
    pairs = {(r["row_reference"], r["description"].split("'")[1]) for r in found}
    assert pairs == {("p=p1", "c"), ("p=p2", "b"), ("p=p2", "c"), ("p=p3", "a"), ("p=p3", "b"), ("p=p3", "c")}
    one = batch(spark, "e string, p string", [("a", "p1"), ("a", "p2")])
    assert group_completeness(one, "e", "p").count() == 0
    assert group_completeness(one, "e", "absent").count() == 0


def test_group_completeness_many_periods(spark):
    """More periods than one chunk holds, against brute force."""
    rng = random.Random(3)
    rows = [(f"e{rng.randrange(7)}", rng.randrange(1500)) for _ in range(4000)]
    found = group_completeness(batch(spark, "e string, p int", rows), "e", "p")
    got = {(r["row_reference"], r["description"].split("'")[1]) for r in found.collect()}
    seen, periods, entities = set(rows), {p for _, p in rows}, {e for e, _ in rows}
    assert len(periods) > 1024
    assert got == {(f"p={p}", e) for e in entities for p in periods if (e, p) not in seen}


def test_duplicate(spark):
    assert flagged(duplicate(batch(spark, "a double, b string", [(1.0, "x"), (2.0, "y"), (1.0, "x")]))) == [2]
    assert duplicate(batch(spark, "a double", [(1.0,), (2.0,), (3.0,)])).count() == 0
    gaps = [(None, "x"), (None, "x"), (float("nan"), "x"), (float("nan"), "x"), (0.0, None), (-0.0, None)]
    assert flagged(duplicate(batch(spark, "a double, b string", gaps))) == [1, 2, 3, 5]  # missing equals missing


def test_duplicate_hot_row(spark):
    """One row fills a third of the table."""
    rng = random.Random(1)
    rows = [(1, "same") if i % 3 == 0 else (rng.randrange(200), "other") for i in range(3000)]
    seen, expected = set(), []
    for i, row in enumerate(rows):
        if row in seen:
            expected.append(i)
        seen.add(row)
    assert flagged(duplicate(batch(spark, "a int, b string", rows))) == expected


def test_validity(spark):
    readings = [(100.0, 95.0), (150.0, -50.0)] + [(100.0 + i, 140.0 + i) for i in range(20)]
    found = validity(batch(spark, "need double, have double", readings)).collect()
    assert [(r["row_reference"], r["column"], r["severity"]) for r in found] == [("1", "have", "high")]
    assert found[0]["description"] == (
        "Value -50.0 in 'have' is negative, but 95% of this column's other values are non-negative — "
        "likely a data-entry or unit error"
    )
    assert validity(batch(spark, "a double", [(100.0,), (None,)])).count() == 0
    losses = batch(spark, "profit_loss double", [(v,) for v in (-10.0, -20.0, -5.0, 8.0, -12.0)])
    assert validity(losses).count() == 0
    few = batch(spark, "a double", [(-1.0,), (-2.0,)])
    assert validity(few).count() == 2  # too few values to call negatives routine


def test_outlier(spark):
    grouped = [("Bihar", 2980.0), ("Bihar", 3010.0), ("Bihar", 999999.0), (None, 5e9), ("Goa", 412.0), ("Goa", 999999.0)]
    found = outlier(batch(spark, "state string, v double", grouped), ["v"], "state").collect()
    assert [r["row_reference"] for r in found] == ["2"]
    assert found[0]["description"] == (
        "Value 999999.0 in v is a statistical outlier (zscore) relative to 'Bihar''s own history — "
        "possible decimal/unit error"
    )
    price = batch(spark, "price double", [(v,) for v in (10.0, 11.0, 9.0, 10.0, 12.0, 5000.0)])
    assert flagged(outlier(price)) == [5]
    assert flagged(outlier(price, None, "no_such_column")) == [5]
    sizes = [("big", 1e6), ("big", 1.01e6), ("big", 0.99e6), ("small", 10.0), ("small", 11.0), ("small", 9.0)]
    assert outlier(batch(spark, "e string, v double", sizes), ["v"], "e").count() == 0
    iqr = {"outlier": {"method": "iqr"}}
    assert flagged(outlier(batch(spark, "p double", [(float(v),) for v in (1, 2, 3, 4, 100)], config=iqr))) == [4]


def test_consistency(spark):
    hit = consistency(batch(spark, "state_name string", [("Odisha",)] * 4 + [("Orissa",)])).collect()
    assert [(r["row_reference"], r["severity"]) for r in hit] == [("4", "medium")]
    assert "closely matches the far more common value 'Odisha' (67% similarity)" in hit[0]["description"]
    assert consistency(batch(spark, "s string", [("Odisha",)] * 2 + [("Bihar",)] * 2)).count() == 0
    assert consistency(batch(spark, "notes string", [(f"note number {i}",) for i in range(20)])).count() == 0
    gap = batch(spark, "s string", [("Odisha",)] * 4 + [("Orissa",), (None,)])
    assert flagged(consistency(gap)) == [4]
    rare_twice = batch(spark, "s string", [("Odisha",)] * 4 + [("Orissa",)] * 2, config={"consistency": {"min_value_count": 3}})
    assert flagged(consistency(rare_twice)) == [4, 5]


def test_consistency_has_no_cap(spark):
    """The right spelling is found however many values are more frequent, unless the caller sets a limit."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(9))
    names = sorted({word("abcdefgh") for _ in range(1300)})
    rows = [(n,) for n in names for _ in range(3)] + [("zyxwvutsr",)] * 2 + [("zyxwvutsq",)]
    hit = consistency(batch(spark, "s string", rows)).collect()
    assert [(int(r["row_reference"]), "'zyxwvutsr' (89% similarity)" in r["description"]) for r in hit] == [(len(rows) - 1, True)]
    limited = batch(spark, "s string", rows, config={"consistency": {"max_common_candidates": 300}})
    assert consistency(limited).count() == 0


def test_consistency_scale(spark):
    rng = random.Random(7)
    names = [f"Customer {rng.choice('ABCDEFGH')}{rng.randrange(10**5)} {rng.choice(['Stores', 'Retail', 'Shop'])}" for _ in range(2000)]
    rows = [(float(i), rng.choice(names)) for i in range(5000)]
    table = batch(spark, "order_id double, customer string", rows)
    start = time.perf_counter()
    assert consistency(table).count() > 0
    assert time.perf_counter() - start < 30  # generous for a loaded test machine


def test_schema_drift(spark):
    before = batch(spark, "state_name string, extra_col string", [("a", "b")])
    now = batch(spark, "state_name string", [("a",)])
    baseline = profile_columns(before.df, before.columns)
    assert [(r["column"], r["severity"]) for r in schema_drift(now, baseline).collect()] == [("extra_col", "high")]
    back = schema_drift(before, profile_columns(now.df, now.columns)).collect()
    assert [(r["column"], r["severity"]) for r in back] == [("extra_col", "low")]
    retyped = batch(spark, "state_name double", [(1.0,)])
    assert schema_drift(retyped, profile_columns(now.df, now.columns)).first()["severity"] == "medium"
    assert schema_drift(now, None).count() == 0


def test_all_rules_order_and_toggle(spark):
    rows = [("W1", f"e{i % 12}", float(i % 7), None) for i in range(120)] + [("W1", "e1", 9e9, None)]
    table = batch(spark, "week string, e string, v double, gap double", rows)
    found = run_all_rules(table).orderBy("rule_ord").collect()
    assert found[0]["issue_type"] == "completeness" and found[0]["column"] == "gap"
    assert {r["issue_type"] for r in found} == {"completeness", "duplicate", "outlier"}
    off = batch(spark, "week string, e string, v double, gap double", rows, config={r: {"enabled": False} for r in ("completeness", "duplicate", "outlier")})
    assert run_all_rules(off).count() == 0
    table.release()


def test_no_rows(spark):
    assert run_all_rules(batch(spark, "a double, s string", [])).count() == 0


def test_plan_shapes(spark):
    """No cross join, no window without a partition, no per-column expansion of rows."""
    rows = [(f"e{i % 12}", f"2024-0{i % 5 + 1}", float(i)) for i in range(100)]
    table = batch(spark, "e string, month string, v double", rows)
    plan = run_all_rules(table)._jdf.queryExecution().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Expand "):
        assert unwanted not in plan
    table.release()


def test_consistency_one_letter_apart(spark):
    """Lengths on both sides of the limits, ties by score, count and value, against all pairs."""
    from tablevitals.functions.fuzzy import wratio

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n)).strip() or "a"
    frequent = {text(n): rng.randrange(2, 4) for n in [*range(1, 16), 30, 62, 63, 64, 65, 66, 80] for _ in range(3)}
    rare = {text(n) for n in (3, 11, 12, 40) for _ in range(4)}
    for value in list(frequent):
        at = rng.randrange(len(value) + 1)
        rare |= {value[:at] + "x" + value[at:], value[:at] + value[at + 1 :], value[:at] + "x" + value[at + 1 :]}
        frequent[value[:at] + "y" + value[at:]] = 3
    rare -= {v for v in rare if v in frequent or not v.strip()}
    rows = [(v,) for v, n in frequent.items() for _ in range(n)] + [(v,) for v in sorted(rare)]
    found = consistency(batch(spark, "s string", rows, config={"consistency": {"max_unique_ratio": 1.0}})).collect()
    got = {rows[int(r["row_reference"])][0]: (r["metric"], r["description"]) for r in found}
    for value in rare:
        score, _, match = min((-float(np.float32(wratio(value, f))), -n, f) for f, n in frequent.items())
        if -score < 60:
            assert value not in got
        else:
            assert got[value][0] == -score and f"value '{match}' (" in got[value][1], value
    assert len(got) > 100


def test_copied_lists_are_not_broadcast(spark):
    """The optimizer guesses the size of lists before they are copied for each block of the other side."""
    frequent = spark.createDataFrame([("s", f"name {i}", 2) for i in range(3)], "column string, value string, value_count bigint")
    rare = spark.createDataFrame([("s", "name x", 7)], "column string, value string, first_row bigint")
    found = best_matches(rare, frequent, 60, {"s": (3, 1)}, lambda df: df)
    assert [(r["value"], r["first_row"], r["match"]) for r in found.collect()] == [("name x", 7, "name 0")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [column" in plan and "ArrowEvalPython" in plan
    assert not any("Join [column" in line and "block" in line and "Broadcast" in line for line in plan.splitlines())
