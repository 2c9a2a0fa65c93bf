"""The registered queries as SQL over the same tables (DuckDB dialect).

The views restate ``workloads/inputs.py``; the rule builders restate each
rule's definition directly, without the Spark plan's shortcuts.
"""

from __future__ import annotations

from tablevitals.sources.reports import REPORT_LINE
from tablevitals.sources.tables import MISSING_TOKENS

DATASET = "3-MEDIUM"
RUN = "7"

VIEWS = {
    "labeled": "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "intake": """SELECT doc_id,
        CASE WHEN n_chars > 13900 THEN 'crawl_feed_' || source || '_' || doc_id::VARCHAR
             ELSE 'crawl_feed_' || source END AS feed,
        'W' || (n_chars % 13)::VARCHAR AS batch_week, lang, n_chars, n_chars - 300.0::DOUBLE AS margin, quality, toxic
        FROM labeled""",
    "dated_events": "SELECT *, ts::DATE AS event_date FROM events",
    "uneven_events": "SELECT event_id, value, CASE event_type WHEN 'purchase' THEN event_type ELSE 'other' END AS kind FROM events",
    "wide_events": "SELECT event_id, " + ", ".join(f"value * (user_id % {i + 2} + 1) AS w{i}" for i in range(20)) + " FROM events",
    "maker_parts": """SELECT p_partkey, p_type,
        CASE WHEN p_size = 7 THEN 'Maker_' || p_partkey::VARCHAR || '_' || p_brand
             ELSE 'Maker_of_' || p_brand END AS maker FROM part""",
    "client_orders": """SELECT o_orderkey, 'Client_' || substr(md5(o_custkey::VARCHAR), 1, 10)
        || CASE WHEN o_totalprice > 498000 THEN 'x' ELSE '' END AS client FROM orders""",
    "shipments": """SELECT o_custkey AS customer_id, l_partkey AS part_id, l_quantity AS quantity,
        l_shipdate AS ship_date, o_orderdate AS order_date, year(o_orderdate) AS order_year, l_returnflag AS return_flag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_orders": """SELECT '  ' || o_orderkey::VARCHAR || ' ' AS key,
        CASE WHEN o_totalprice > 480000 THEN 'x'
             ELSE ' ' || round(o_totalprice * 100)::BIGINT::VARCHAR || chr(9) END AS price,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'NA' WHEN o_orderpriority = '1-URGENT' THEN ' '
             ELSE ' ' || o_orderpriority || chr(9) || ' ' END AS priority,
        CASE o_orderstatus WHEN 'F' THEN '1.5' WHEN 'O' THEN 'n/a' ELSE '1d' END AS status FROM orders""",
    "report_texts": """SELECT 'd' || doc_id::VARCHAR AS report, text FROM documents UNION ALL
        SELECT 'c' || c_custkey::VARCHAR, 'Segment   of ' || c_mktsegment || '  1,' || lpad(c_nationkey::VARCHAR, 3, '0')
        || ', ' || round(c_acctbal * 100)::BIGINT::VARCHAR || chr(10) || 'no figures here' || chr(13) || chr(10) || '  '
        || c_mktsegment || '. ' || c_custkey::VARCHAR || ' -' || c_nationkey::VARCHAR || '.5' FROM customer""",
    "dropped": """SELECT page_id, '/drop/'
        || CASE WHEN length(url) % 2 = 0 THEN md5(url)[1:8] || '_' ELSE '' END
        || replace(regexp_extract(url, '//([^/]+)/', 1), '.', ' ')
        || CASE WHEN length(url) % 3 > 0 THEN '_2024-0' || (length(html) % 9 + 1)::VARCHAR ELSE '' END
        || ['.csv', '.XLSX', '.pdf', '.txt', '.PNG', '', '.CSV', '.tiff'][length(html) % 8 + 1] AS path FROM pages""",
    "names": """SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS name,
        regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\\.[^.]+$', '\\1') AS stem,
        lower(regexp_extract(path, '[^./]([.][^./]+)$', 1)) AS suffix FROM dropped""",
    "datasets": """SELECT page_id,
        CASE WHEN regexp_matches(stem, '^[0-9a-f]{8}_.') THEN stem[10:] WHEN stem = '' THEN 'default'
             ELSE stem END AS dataset_name FROM names""",
    "runs": """SELECT o_orderkey::VARCHAR AS run_id, o_orderdate AS "timestamp",
        'orders/' || o_orderpriority || '.csv' AS source_file, o_orderpriority AS dataset_name,
        greatest(0, 100 - floor(o_totalprice / 4000)::INT) AS health_score, o_custkey AS rows_processed,
        floor(o_totalprice / 20000)::BIGINT AS rows_flagged FROM orders""",
    "issues": """SELECT l_orderkey::VARCHAR AS run_id, l_partkey::VARCHAR AS row_reference,
        CASE WHEN l_linestatus = 'O' THEN 'l_quantity' ELSE 'l_extendedprice' END AS "column",
        CASE WHEN l_returnflag = 'A' THEN 'validity' WHEN l_returnflag = 'N' THEN 'outlier'
             WHEN l_linestatus = 'O' THEN 'consistency' ELSE 'duplicate' END AS issue_type,
        'line ' || l_linenumber::VARCHAR || ' of supplier ' || l_suppkey::VARCHAR AS description,
        CASE WHEN l_tax >= 0.06 THEN 'high' WHEN l_tax >= 0.03 THEN 'medium' ELSE 'low' END AS severity,
        l_partkey AS row_index,
        CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'N' THEN 4 WHEN l_linestatus = 'O' THEN 5 ELSE 2 END
            AS rule_ord, l_linenumber AS column_ord FROM lineitem""",
    "counts": """SELECT run_id, issue_type, count(*) AS issue_count, min(rule_ord) AS first_rule
        FROM issues GROUP BY ALL""",
    "weighted": """SELECT *, CASE issue_type WHEN 'completeness' THEN 4 WHEN 'duplicate' THEN 3 WHEN 'validity' THEN 10
        WHEN 'outlier' THEN 6 WHEN 'schema_drift' THEN 15 ELSE 5 END AS penalty_weight FROM counts""",
    "totals": """SELECT run_id, sum(penalty_weight * issue_count)::BIGINT AS lost, sum(issue_count)::BIGINT AS found
        FROM weighted GROUP BY run_id""",
    "high": "SELECT run_id, count(*) AS n FROM issues WHERE severity = 'high' GROUP BY run_id",
    "alerting": """SELECT r.*, coalesce(h.n, 0) AS high_issues, r.health_score < 70 OR coalesce(h.n, 0) > 0 AS alert
        FROM runs r LEFT JOIN high h USING (run_id)""",
    "profiles": """WITH g AS (SELECT o_orderpriority AS dataset_name, year(o_orderdate)::VARCHAR AS y,
            max(o_orderdate) AS created_at, count(*) AS row_count, min(o_custkey) AS a, max(o_custkey) AS b,
            min(o_totalprice) AS c, max(o_totalprice) AS d FROM orders GROUP BY ALL)
        SELECT dataset_name || '/' || y AS run_id, dataset_name, created_at, row_count, 'o_custkey' AS "column",
            0 AS ordinal, a::DOUBLE AS "min", b::DOUBLE AS "max" FROM g UNION ALL
        SELECT dataset_name || '/' || y, dataset_name, created_at, row_count, 'o_totalprice', 1, c, d FROM g""",
}
NEEDS = {
    "intake": ["labeled"],
    "names": ["dropped"],
    "datasets": ["dropped", "names"],
    "counts": ["issues"],
    "weighted": ["issues", "counts"],
    "totals": ["issues", "counts", "weighted"],
    "high": ["issues"],
    "alerting": ["runs", "issues", "high"],
}


def using(*views: str, select: str) -> str:
    """``select`` with the views it needs in front."""
    wanted: list[str] = []
    for view in views:
        wanted += [v for v in [*NEEDS.get(view, []), view] if v not in wanted]
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + " " + select


# Rules


def completeness(source: str, columns: list[str], threshold: float = 20.0) -> str:
    parts = [
        f"""SELECT '{c}' AS name, count(*) AS n, count(*) - count("{c}") AS missing,
        (count(*) - count("{c}")) / count(*) * 100 AS pct FROM {source}"""
        for c in columns
    ]
    return f"""SELECT 'column' AS row_reference, name AS "column", 'completeness' AS issue_type,
        'Column ''' || name || ''' is ' || format('{{:.1f}}', pct) || '% empty (' || missing || '/' || n
        || ' rows) — above the {threshold}% threshold' AS description,
        CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS severity
        FROM ({" UNION ALL ".join(parts)}) WHERE pct > {threshold}"""


def group_completeness(source: str, entity: str, period: str) -> str:
    return f"""SELECT '{period}=' || p AS row_reference, '{entity}' AS "column", 'completeness' AS issue_type,
        '''' || e || ''' is missing from {period}=' || p || ' despite reporting in other periods' AS description,
        'high' AS severity
        FROM (SELECT DISTINCT {entity}::VARCHAR AS e FROM {source} WHERE {entity} IS NOT NULL),
             (SELECT DISTINCT {period}::VARCHAR AS p FROM {source} WHERE {period} IS NOT NULL)
        WHERE NOT EXISTS (SELECT 1 FROM {source} o WHERE o.{entity}::VARCHAR = e AND o.{period}::VARCHAR = p)"""


def duplicate(source: str, key: str, columns: list[str]) -> str:
    return f"""SELECT k::VARCHAR AS row_reference, '*' AS "column", 'duplicate' AS issue_type,
        'Row ' || k || ' is an exact duplicate of an earlier row in this batch' AS description, 'medium' AS severity
        FROM (SELECT {key} AS k, row_number() OVER (PARTITION BY {", ".join(columns)} ORDER BY {key}) AS nth
              FROM {source}) WHERE nth > 1"""


def validity(source: str, key: str, columns: list[str], ratio: float = 0.90) -> str:
    parts = [
        f"""SELECT {key}::VARCHAR AS row_reference, '{c}' AS "column", 'validity' AS issue_type,
        'Value ' || v::VARCHAR || ' in ''{c}'' is negative, but ' || format('{{:.0f}}', r * 100)
        || '% of this column''s other values are non-negative — likely a data-entry or unit error' AS description,
        'high' AS severity
        FROM (SELECT {key}, {c}::DOUBLE AS v FROM {source} WHERE {c} < 0),
             (SELECT count(*) FILTER (WHERE {c} >= 0) / count({c}) AS r, count({c}) AS n FROM {source})
        WHERE NOT (n >= 5 AND r < {ratio})"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def outlier(source: str, key: str, columns: list[str], group: str | None = None, method: str = "zscore") -> str:
    parts = []
    g = f"{group}::VARCHAR" if group else "'x'"
    scope = "'''' || g || ''''" if group else "'the batch'"
    for c in columns:
        rows = f"SELECT {key} AS k, {g} AS g, {c}::DOUBLE AS v FROM {source} WHERE {c} IS NOT NULL"
        if group:
            rows += f" AND {group} IS NOT NULL"
        if method == "iqr":
            judged = f"""SELECT k, r.g, v, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM ({rows}) r
                JOIN (SELECT g, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
                      FROM ({rows}) GROUP BY g) s ON r.g = s.g WHERE n >= 3"""
            far = "v < low OR v > high"
        else:
            centred = f"""SELECT k, r.g, v, med FROM ({rows}) r
                JOIN (SELECT g, count(*) AS n, median(v) AS med FROM ({rows}) GROUP BY g) s ON r.g = s.g WHERE n >= 3"""
            judged = f"""SELECT k, r.g, v, med, mad FROM ({centred}) r
                JOIN (SELECT g, median(abs(v - med)) AS mad FROM ({centred}) GROUP BY g) s ON r.g = s.g"""
            far = "mad <> 0 AND abs(0.6745::DOUBLE * (v - med) / mad) > 3.5"
        parts.append(
            f"""SELECT k::VARCHAR AS row_reference, '{c}' AS "column", 'outlier' AS issue_type,
            'Value ' || v::VARCHAR || ' in {c} is a statistical outlier ({method}) relative to ' || {scope}
            || '''s own history — possible decimal/unit error' AS description, 'medium' AS severity
            FROM ({judged}) WHERE {far}"""
        )
    return " UNION ALL ".join(parts)


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of up to 60 characters."""
    full = f"((1::BIGINT << length({b})::INT) - 1)"
    masks = f"""list_transform(string_split({a}, ''), lambda ch: list_sum(list_transform(range(length({b})),
        lambda j: CASE WHEN substr({b}, (j + 1)::INT, 1) = ch THEN 1::BIGINT << j::INT ELSE 0::BIGINT END))::BIGINT)"""
    row = f"list_reduce([{full}] || {masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"(length({b}) - bit_count({row}))"


def ratio(a: str, b: str) -> str:
    return f"(200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})))"


def consistency(source: str, key: str, columns: list[str]) -> str:
    """For one-word values of similar lengths, where the fuzzy score is ``ratio``."""
    parts = []
    for c in columns:
        counts = f"SELECT {c} AS value, count(*) AS n, min({key}) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        parts.append(
            f"""SELECT k::VARCHAR AS row_reference, '{c}' AS "column", 'consistency' AS issue_type,
            '''' || rare || ''' in column ''{c}'' closely matches the far more common value ''' || common || ''' ('
            || format('{{:.0f}}', score) || '% similarity) — likely a naming inconsistency that will break joins/counts'
            AS description, 'medium' AS severity
            FROM (SELECT r.k, r.value AS rare, f.value AS common, f.n, {ratio("r.value", "f.value")}::FLOAT AS score,
                  row_number() OVER (PARTITION BY r.value ORDER BY {ratio("r.value", "f.value")}::FLOAT DESC, f.n DESC,
                                     f.value) AS place
                  FROM (SELECT * FROM ({counts}) WHERE n < 2) r,
                       (SELECT * FROM ({counts}) WHERE n >= 2) f
                  WHERE (SELECT count(DISTINCT {c}) / count(*) <= 0.5 OR count(*) < 10 FROM {source}))
            WHERE place = 1 AND score >= 60"""
        )
    return " UNION ALL ".join(parts)


DRIFT_ROWS = [
    ("language", "Column ''language'' present in the previous run is missing from this run", "high"),
    ("n_chars", "Column ''n_chars'' changed type from int to bigint", "medium"),
    ("lang", "New column ''lang'' not present in the previous run''s schema", "low"),
    ("toxic", "New column ''toxic'' not present in the previous run''s schema", "low"),
]
DRIFT = " UNION ALL ".join(
    f"""SELECT 'schema' AS row_reference, '{c}' AS "column", 'schema_drift' AS issue_type, '{d}' AS description,
    '{s}' AS severity"""
    for c, d, s in DRIFT_ROWS
)
INTAKE_COLUMNS = ["feed", "batch_week", "lang", "n_chars", "margin", "quality", "toxic"]
VALID_INTAKE = validity("intake", "doc_id", ["n_chars", "margin", "quality", "toxic"])
ALL_RULES = " UNION ALL ".join(
    [
        completeness("intake", INTAKE_COLUMNS),
        group_completeness("intake", "feed", "batch_week"),
        duplicate("intake", "doc_id", INTAKE_COLUMNS),
        VALID_INTAKE,
        outlier("intake", "doc_id", ["n_chars", "margin", "quality", "toxic"], "feed"),
        consistency("intake", "doc_id", ["feed", "batch_week", "lang"]),
        DRIFT,
    ]
)

FEED_COLUMNS = [*INTAKE_COLUMNS, "shard"]
FEED_NUMBERS = ["n_chars", "margin", "quality", "toxic", "shard"]


def feed_run(k: int) -> str:
    """Figures of the file with the rows of one shard."""
    source = f"feed_{k}"
    few = f"(SELECT count(DISTINCT feed) < 10 OR count(DISTINCT feed) = count(*) FROM {source})"
    by_entity = lambda found, otherwise: f"SELECT * FROM ({found}) WHERE NOT {few} UNION ALL SELECT * FROM ({otherwise}) WHERE {few}"
    absent, far = group_completeness(source, "feed", "batch_week"), outlier(source, "doc_id", FEED_NUMBERS, "feed")
    issues = " UNION ALL ".join(
        [
            completeness(source, FEED_COLUMNS),
            f"SELECT * FROM ({absent}) WHERE NOT {few}",
            duplicate(source, "doc_id", FEED_COLUMNS),
            validity(source, "doc_id", FEED_NUMBERS),
            by_entity(far, outlier(source, "doc_id", FEED_NUMBERS)),
            consistency(source, "doc_id", ["feed", "batch_week", "lang"]),
        ]
    )
    weights = {"completeness": 4, "duplicate": 3, "validity": 10, "outlier": 6, "consistency": 5, "schema_drift": 15}
    score = " - ".join(f"{w} * count_if(issue_type = '{t}')" for t, w in weights.items())
    return f"""SELECT {k}::BIGINT AS shard, n AS rows_processed, n AS rows_stored, longest, least,
        greatest(0, 100 - {score})::INTEGER AS health_score, count(DISTINCT row_reference) AS rows_flagged,
        {", ".join(f"count_if(issue_type = '{t}') AS {t}" for t in weights)},
        greatest(0, 100 - {score}) < 70 OR count_if(severity = 'high') > 0 AS alerted
        FROM (SELECT count(*) AS n, max(n_chars)::DOUBLE AS longest, min(margin) AS least FROM {source}) LEFT JOIN ({issues}) ON true
        GROUP BY ALL"""


FEED_RUNS = (
    f"WITH labeled AS ({VIEWS['labeled']}), intake AS ({VIEWS['intake']}), "
    + ", ".join(
        f"feed_{k} AS (SELECT * REPLACE ('W' || (n_chars % 5)::VARCHAR AS batch_week), {k} AS shard FROM intake WHERE doc_id % 3 = {k})"
        for k in range(3)
    )
    + " " + " UNION ALL ".join(feed_run(k) for k in range(3))
)


# Profile


def distinct_of(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM {source}" for c in columns
    )


def figures(source: str, columns: list[tuple[str, str]], extra: str = "") -> str:
    """Profile rows; ``columns`` are (name, Spark type), measured unless the type is text."""
    parts = []
    for i, (c, dtype) in enumerate(columns):
        texty = dtype in ("string", "timestamp", "date")
        nums = (
            "NULL::DOUBLE AS \"min\", NULL::DOUBLE AS \"max\", NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
            if texty
            else f"""min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max", round(avg({c}::DOUBLE), 2) AS mean,
            round(CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}::DOUBLE) END, 2) AS std"""
        )
        unique = f", {'count(DISTINCT ' + c + ')' if texty else 'NULL::BIGINT'} AS unique_count" if extra else ""
        parts.append(
            f"""SELECT count(*) AS row_count, '{c}' AS "column", {i} AS ordinal, '{dtype}' AS dtype,
            count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct,
            {nums}{unique} FROM {source}"""
        )
    return " UNION ALL ".join(parts)


LABELED = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ("quality", "int"), ("toxic", "int"),
]
PART = [
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
    ("p_retailprice", "double"),
]
LINES = [(c, t) for c, t in [("l_partkey", "bigint"), *[(f"l_{m}", "double") for m in ("quantity", "extendedprice", "discount", "tax")]]]

# Ingest

TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
NUMBER = r"^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"


def present(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({TOKENS}) THEN {c} END"


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches(lower({trimmed(c)}), '{NUMBER}') THEN try_cast({trimmed(c)} AS DOUBLE) END"


EXTRACTED = rf"""
    split AS (SELECT report, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts
              FROM report_texts),
    lines AS (SELECT report, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM split),
    matched AS (SELECT report, line_no, regexp_extract(line, '{REPORT_LINE}', 1) AS label,
                replace(regexp_extract(line, '{REPORT_LINE}', 2), ',', '') AS a,
                replace(regexp_extract(line, '{REPORT_LINE}', 3), ',', '') AS b
                FROM lines WHERE regexp_matches(line, '{REPORT_LINE}')),
    extracted AS (SELECT report, line_no::INT AS line_no, 'unknown' AS month,
                  regexp_replace(regexp_replace(label, '\s+', ' ', 'g'), '^[ .,-]+|[ .,-]+$', '', 'g') AS state_name,
                  try_cast(a AS DOUBLE) AS energy_requirement_mu, try_cast(b AS DOUBLE) AS energy_availability_mu,
                  'low' AS extraction_confidence FROM matched
                  WHERE try_cast(a AS DOUBLE) IS NOT NULL AND try_cast(b AS DOUBLE) IS NOT NULL)"""

# Alerts


def message(source: str, rows: str, flagged: str, limit: int) -> str:
    return f"""SELECT a.run_id, ':rotating_light: *Data Quality Alert* — run `' || a.run_id || '`' || chr(10)
        || '*Source:* ' || {source} || chr(10)
        || '*Health score:* ' || health_score || '/100 (alert threshold: 70)' || chr(10)
        || '*Rows processed:* ' || {rows} || ' · *Rows flagged:* ' || {flagged}
        || CASE WHEN high_issues > 0 THEN chr(10) || chr(10) || '*' || high_issues || ' high-severity issue(s):*'
           || chr(10) || lines ELSE '' END
        || CASE WHEN high_issues > {limit} THEN chr(10) || '  … and ' || (high_issues - {limit}) || ' more' ELSE '' END
        AS message
        FROM alerting a LEFT JOIN (
            SELECT run_id, string_agg('  • [' || issue_type || '] ' || description, chr(10) ORDER BY nth) AS lines
            FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rule_ord, column_ord, row_index,
                         row_reference, description) AS nth FROM issues WHERE severity = 'high')
            WHERE nth <= {limit} GROUP BY run_id) t ON a.run_id = t.run_id
        WHERE alert"""


SUMMARY = """SELECT dataset_name, latest.run_id AS latest_run_id, latest.t AS latest_run_at, latest.s AS latest_health_score,
    latest.p AS rows_processed, latest.f AS rows_flagged, run_count, avg_health_score, worst_health_score, best_health_score
    FROM (SELECT dataset_name, arg_max({'run_id': run_id, 't': "timestamp", 's': health_score, 'p': rows_processed,
                 'f': rows_flagged}, ("timestamp", run_id)) AS latest, count(*) AS run_count,
          ((20 * sum(health_score) + count(*)) // (2 * count(*)))::BIGINT / 10 AS avg_health_score,
          min(health_score) AS worst_health_score, max(health_score) AS best_health_score
          FROM runs GROUP BY dataset_name)"""
BREAKDOWN = """SELECT i.issue_type, i.severity, count(*) AS issue_count, count(DISTINCT i.run_id) AS runs_affected
    FROM issues i JOIN runs r ON r.run_id = i.run_id {where} GROUP BY ALL"""
HISTORY = f"""SELECT run_id, "timestamp", health_score, rows_processed, rows_flagged FROM runs
    WHERE dataset_name = '{DATASET}'"""
ISSUE_HISTORY = f"""SELECT r.run_id, r."timestamp" AS run_timestamp, r.health_score, i.severity, i.issue_type,
    i.row_reference, i."column", i.description FROM issues i JOIN runs r ON r.run_id = i.run_id
    WHERE r.dataset_name = '{DATASET}'"""
REPORT = """SELECT dataset_name, r.run_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS run_timestamp, health_score,
    rows_processed, rows_flagged, coalesce(severity, '') AS severity, coalesce(issue_type, '') AS issue_type,
    coalesce(row_reference, '') AS row_reference, coalesce("column", '') AS "column",
    coalesce(description, 'no issues flagged') AS description FROM runs r LEFT JOIN issues i ON r.run_id = i.run_id"""
SCORED = """SELECT r.run_id, greatest(0, 100 - coalesce(lost, 0))::INT AS score, 100 AS starting_score,
    coalesce(lost, 0) AS total_deducted, coalesce(found, 0) AS total_issues
    FROM runs r LEFT JOIN totals t USING (run_id)"""
PLACED = """SELECT run_id, issue_type, issue_count, penalty_weight, penalty_weight * issue_count AS points_deducted,
    (row_number() OVER (PARTITION BY run_id ORDER BY penalty_weight * issue_count DESC, first_rule, issue_type))::INT AS place
    FROM weighted"""
BAND = "CASE WHEN health_score >= 85 THEN 'green' WHEN health_score >= 60 THEN 'amber' ELSE 'red' END"
CUSTOMER_JSON = "to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment})::VARCHAR"
CUSTOMER_VALIDITY = validity("customer", "c_custkey", ["c_custkey", "c_nationkey", "c_acctbal"])
CUSTOMER_RULES = " UNION ALL ".join(
    [
        completeness("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
        CUSTOMER_VALIDITY,
        outlier("customer", "c_custkey", ["c_custkey", "c_nationkey", "c_acctbal"]),
        consistency("customer", "c_custkey", ["c_mktsegment"]),
    ]
)

ORACLE: dict[str, str] = {
    "scan_csv_files": """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
        o_totalprice::VARCHAR AS o_totalprice, o_orderpriority FROM orders""",
    "load_csv_file": """SELECT c_custkey::DOUBLE AS customer_key, c_name || ' café' AS customer_name,
        c_acctbal AS balance_usd FROM customer""",
    "normalize_na_tokens": using(
        "raw_orders", select=f"SELECT key, price, {present('priority')} AS priority, {present('status')} AS status FROM raw_orders"
    ),
    "standardize_columns": using(
        "raw_orders",
        select="SELECT key AS order_key, price AS total_price_cents, priority AS order_priority, status AS status_code FROM raw_orders",
    ),
    "trim_strings": using(
        "raw_orders", select="SELECT " + ", ".join(f"{trimmed(c)} AS {c}" for c in ("key", "price", "priority", "status")) + " FROM raw_orders"
    ),
    "auto_coerce_numeric": using(
        "raw_orders",
        select=f"""SELECT {number("key")} AS key, {number("price")} AS price, {trimmed(present("priority"))} AS priority,
        {present("status")} AS status FROM raw_orders""",
    ),
    "load_table": using(
        "raw_orders",
        select=f"""SELECT {number("key")} AS order_key, {number("price")} AS total_price_cents,
        {trimmed("priority")} AS order_priority, status AS status_code,
        row_number() OVER (ORDER BY {number("key")}) - 1 AS row_index FROM raw_orders""",
    ),
    "with_row_index_lines": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index FROM lineitem""",
    "extract_rows": using("report_texts", select="") .rstrip() + "," + EXTRACTED + " SELECT * FROM extracted",
    "drop_confidence_column": using("report_texts", select="").rstrip() + "," + EXTRACTED
    + " SELECT month, state_name, count(*) AS rows, max(energy_requirement_mu) AS most FROM extracted GROUP BY ALL",
    "infer_month": using("names", select="SELECT page_id, nullif(regexp_extract(name, '(\\d{4}-\\d{2})', 1), '') AS month FROM names"),
    "dataset_name": using("datasets", select="SELECT * FROM datasets"),
    "safe_dataset_key": using(
        "datasets", select="SELECT page_id, regexp_replace(dataset_name, '[^\\p{L}\\p{N}_-]', '_', 'g') AS dataset_key FROM datasets"
    ),
    "route_dropped_files": using(
        "names",
        select="""SELECT page_id, CASE WHEN suffix = '.csv' THEN 'structured' ELSE 'quarantine' END AS route,
        CASE WHEN suffix = '.csv' THEN NULL
             WHEN suffix IN ('.pdf', '.png', '.tiff') AND NOT regexp_matches(name, '\\d{4}-\\d{2}')
             THEN 'no month in the file name'
             WHEN suffix IN ('.pdf', '.png', '.tiff') THEN 'scanned file: provide its text'
             WHEN suffix = '.xlsx' THEN 'workbook: export it to CSV' ELSE 'unsupported file type' END AS reason
        FROM names""",
    ),
    "ingest_folder_stream": FEED_RUNS,
    "unjudged_columns": using(
        "client_orders",
        select="""SELECT 'orders' AS source, 'o_orderdate' AS "column",
        'not judged for absent entities: ' || count(DISTINCT o_orderdate) || ' periods, more than 60' AS note
        FROM orders HAVING count(DISTINCT o_orderdate) > 60
        UNION ALL SELECT 'clients', 'client', count(*) || ' frequent values, of which the 20 most frequent were candidates'
        FROM (SELECT client FROM client_orders GROUP BY client HAVING count(*) >= 2) HAVING count(*) > 20""",
    ),
    "period_like_columns": using("shipments", select=distinct_of("shipments", ["ship_date", "order_date", "order_year"])),
    "guess_period_column": using("shipments", select=distinct_of("shipments", ["order_year"])),
    "id_like_numeric_columns": using("shipments", select=distinct_of("shipments", ["customer_id", "part_id"])),
    "outlier_columns": using("shipments", select=distinct_of("shipments", ["quantity", "order_year"])),
    "guess_entity_column": using("intake", select=distinct_of("intake", ["feed"])),
    "profile": using("labeled", select=figures("labeled", LABELED, "unique")),
    "numeric_summary_lines": figures("lineitem", LINES),
    "text_summary_parts": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM part" for c in ("p_name", "p_brand", "p_type")
    ),
    "unique_values_parts": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM part" for c in ("p_name", "p_brand", "p_type")
    ),
    "value_counts_lines": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {v} AS value, count(*) AS value_count FROM lineitem GROUP BY ALL"
        for c, v in (
            ("l_returnflag", "l_returnflag"),
            ("l_linestatus", "l_linestatus"),
            ("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"),
        )
    ),
    "null_badges": using(
        "labeled",
        select=f"""SELECT "column", null_pct, CASE WHEN null_pct > 20 THEN 'red' WHEN null_pct > 0 THEN 'amber' END AS badge
        FROM ({figures("labeled", LABELED)})""",
    ),
    "completeness_rule": using("labeled", select=completeness("labeled", [c for c, _ in LABELED])),
    "group_completeness_rule": using("dated_events", select=group_completeness("dated_events", "user_id", "event_date")),
    "duplicate_rule": duplicate("documents", "doc_id", ["text"]),
    "duplicate_rule_orders": duplicate("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"]),
    "validity_rule": CUSTOMER_VALIDITY,
    "validity_rule_strict": validity("customer", "c_custkey", ["c_custkey", "c_nationkey", "c_acctbal"], 0.92)
    + " UNION ALL " + validity("supplier", "s_suppkey", ["s_suppkey", "s_nationkey", "s_acctbal"], 0.92),
    "outlier_zscore": outlier("events", "event_id", ["value"]),
    "outlier_grouped": outlier("events", "event_id", ["value"], "event_type"),
    "outlier_iqr": outlier("events", "event_id", ["value"], None, "iqr"),
    "outlier_iqr_grouped": outlier("documents", "doc_id", ["n_chars"], "source", "iqr"),
    "outlier_hot_groups": using("uneven_events", select=outlier("uneven_events", "event_id", ["value"], "kind")),
    "outlier_wide": using("wide_events", select=outlier("wide_events", "event_id", [f"w{i}" for i in range(20)])),
    "consistency_rule": using("maker_parts", select=consistency("maker_parts", "p_partkey", ["maker"])),
    "consistency_many_candidates": using("client_orders", select=consistency("client_orders", "o_orderkey", ["client"])),
    "fuzzy_wratio": f"""WITH pairs AS (SELECT 'brand' AS pair, p_brand AS a, 'Brand#' || p_size::VARCHAR AS b FROM part
            UNION ALL SELECT 'name', replace(p_name, ' ', '_'), substr(replace(p_name, ' ', '_'), 3, 3) FROM part),
        counted AS (SELECT pair, a, b, count(*) AS parts FROM pairs GROUP BY ALL),
        sized AS (SELECT *, greatest(length(a), length(b)) / least(length(a), length(b)) AS far,
                  {ratio("a", "b")} AS plain FROM counted),
        windows AS (SELECT pair, a, b, unnest(range(1 - length(b), length(a))) AS i FROM sized WHERE far >= 1.5),
        cut AS (SELECT pair, a, b, substr(a, (greatest(i, 0) + 1)::INT, (least(i + length(b), length(a)) - greatest(i, 0))::INT)
                AS w FROM windows),
        best AS (SELECT pair, a, b, max({ratio("w", "b")}) AS part FROM cut GROUP BY ALL)
        SELECT s.pair, s.a, s.b, parts, round(CASE WHEN far < 1.5 THEN plain WHEN far <= 8 THEN greatest(plain, 0.9 * part)
            ELSE greatest(plain, 0.6 * part) END::FLOAT::DOUBLE, 3) AS score
        FROM sized s LEFT JOIN best USING (pair, a, b)""",
    "schema_drift_rule": DRIFT,
    "rule_toggle": using("intake", select=VALID_INTAKE),
    "all_rules": using("intake", select=ALL_RULES),
    "batch_health": using(
        "intake",
        select=f"""SELECT * FROM (WITH lost AS (
        SELECT issue_type, count(*) AS issue_count,
        CASE issue_type WHEN 'completeness' THEN 4 WHEN 'duplicate' THEN 3 WHEN 'validity' THEN 10 WHEN 'outlier' THEN 6
             WHEN 'schema_drift' THEN 15 ELSE 5 END AS penalty_weight, penalty_weight * count(*) AS points_deducted
        FROM ({ALL_RULES}) GROUP BY issue_type)
        SELECT *, greatest(0, 100 - sum(points_deducted) OVER ())::INT AS score FROM lost
        UNION ALL SELECT NULL, 0, 0, 0, 100 WHERE NOT EXISTS (FROM lost))""",
    ),
    "issue_counts": using("counts", select="SELECT run_id, issue_type, issue_count FROM counts"),
    "deductions": using("weighted", select=PLACED),
    "health_score": using("runs", "totals", select=SCORED),
    "rows_flagged": using("issues", select="SELECT run_id, count(DISTINCT row_reference) AS rows_flagged FROM issues GROUP BY run_id"),
    "run_summary": using(
        "runs", "totals", "high",
        select="""SELECT r.run_id, dataset_name, source_file, rows_processed, coalesce(lost, 0) AS total_deducted,
        coalesce(found, 0) AS total_issues, coalesce(n, 0) AS high_issues, coalesce(f.rows_flagged, 0) AS rows_flagged,
        greatest(0, 100 - coalesce(lost, 0))::INT AS health_score
        FROM runs r LEFT JOIN totals t USING (run_id) LEFT JOIN high USING (run_id)
        LEFT JOIN (SELECT run_id, count(DISTINCT row_reference) AS rows_flagged FROM issues GROUP BY run_id) f USING (run_id)""",
    ),
    "run_report": using(
        "runs", "weighted",
        select=f"""SELECT run_id, 0 AS section, 0 AS place, printf('run %s (dataset: %s) source %s rows %d flagged %d score %d / 100',
            run_id, dataset_name, source_file, rows_processed, rows_flagged, health_score) AS line FROM runs UNION ALL
        SELECT run_id, 1, place, printf('- %-14s x%-3d @ -%d pts each = -%d pts', issue_type, issue_count, penalty_weight,
            points_deducted) FROM ({PLACED}) UNION ALL
        SELECT run_id, 2, row_index, printf('[%-6s] %-12s row=%s col=%s: %s', upper(severity), issue_type, row_reference,
            "column", description) FROM issues""",
    ),
    "score_band": using("runs", select=f"SELECT {BAND} AS band, count(*) AS runs FROM runs GROUP BY ALL"),
    "should_alert": using("alerting", select="SELECT run_id, high_issues, alert FROM alerting"),
    "alert_message": using("alerting", select=message("source_file", "rows_processed", "rows_flagged", 2)),
    "alert_batch": using("alerting", select=message("dataset_name", "0", "high_issues", 10)),
    "dataset_summary": using("runs", select=SUMMARY),
    "issue_breakdown": using("runs", "issues", select=BREAKDOWN.format(where="")),
    "issue_breakdown_dataset": using("runs", "issues", select=BREAKDOWN.format(where=f"WHERE r.dataset_name = '{DATASET}'")),
    "breakdown_pivot": using(
        "issues",
        select="""SELECT issue_type, count(*) FILTER (WHERE severity = 'high') AS high,
        count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low
        FROM issues GROUP BY issue_type""",
    ),
    "run_history": using("runs", select=HISTORY),
    "score_trend": using(
        "runs", select=f"SELECT run_id, \"timestamp\", health_score, {BAND} AS band FROM runs WHERE dataset_name = '{DATASET}'"
    ),
    "issue_history": using("runs", "issues", select=ISSUE_HISTORY),
    "list_runs": using("runs", select='SELECT * FROM runs ORDER BY "timestamp" DESC, run_id DESC LIMIT 200'),
    "latest_profile": using(
        "profiles",
        select=f"""SELECT * FROM profiles WHERE run_id = (SELECT arg_max(run_id, (created_at, run_id)) FROM profiles
        WHERE dataset_name = '{DATASET}')""",
    ),
    "run_profile": using("profiles", select=f"SELECT * FROM profiles WHERE run_id = '{DATASET}/1996'"),
    "run_issues": using(
        "issues",
        select=f"SELECT row_reference, \"column\", issue_type, description, severity FROM issues WHERE run_id = '{RUN}'",
    ),
    "run_preview": f"SELECT c_custkey AS row_index, {CUSTOMER_JSON} AS data FROM customer ORDER BY c_custkey LIMIT 50",
    "export_run_report": using("runs", "issues", select=REPORT),
    "export_dataset_runs": using("runs", select=HISTORY),
    "export_dataset_issues": using("runs", "issues", select=ISSUE_HISTORY),
    "json_safe_record": using(
        "labeled",
        select="""SELECT doc_id, to_json({'source': source, 'n_chars': n_chars, 'quality': quality,
        'share': CASE WHEN quality IS NOT NULL THEN 0.5::DOUBLE END})::VARCHAR AS data FROM labeled""",
    ),
    "store_rows": f"SELECT 'r1' AS run_id, c_custkey AS row_index, c_custkey::VARCHAR AS row_reference, {CUSTOMER_JSON} AS data FROM customer",
    "store_issues": CUSTOMER_VALIDITY,
    "store_profile": f"""SELECT 'r1' AS run_id, 'orders' AS dataset_name, "column", dtype, null_count, "min", "max", unique_count
        FROM ({figures("part", PART, "unique")})""",
    "store_runs_and_lineage": using(
        "runs",
        select=f"""SELECT 'latest-' || latest_run_id AS run_id, latest_run_at AS "timestamp", dataset_name AS source_file,
        dataset_name, latest_health_score AS health_score, rows_processed, rows_flagged,
        'load_structured,profile_dataframe,run_all_rules,compute_health_score' AS steps, 'dataset_rows' AS destination_table
        FROM ({SUMMARY})""",
    ),
    "store_run_atomic": f"""WITH found AS ({CUSTOMER_RULES})
        SELECT 'r1' AS run_id, 'customer' AS dataset_name, 0 AS health_score, (SELECT count(*) FROM customer) AS rows_processed,
        (SELECT count(DISTINCT row_reference) FROM found) AS rows_flagged, (SELECT count(*) FROM customer) AS rows_stored,
        issue_type, count(*) AS issue_count FROM found GROUP BY issue_type""",
}
