"""The same results in plain SQL, written from the definitions."""

from __future__ import annotations

from catalog.inputs import AS_OF, ORDER_SPLIT, SENTINEL, SPLIT, SQL

STAMP = "%Y-%m-%d %H:%M:%S.%f"


def _r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0e0"


def _rel(name: str) -> str:
    return f"({SQL[name]})" if name in SQL else name


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _common(column: str, c: str) -> str:
    return f"""'{column}' AS "column", count(*) AS total_count,
  count(*) - count({c}) AS missing_count,
  {_r(f"(count(*) - count({c})) * 100.0e0 / count(*)")} AS missing_percentage,
  count(DISTINCT {c}) AS unique_count"""


def _numeric(rel: str, column: str, boolean: bool = False) -> str:
    c = f"CAST({column} AS INTEGER)" if boolean else column
    d = f"CAST({c} AS DOUBLE)"
    quartile = {p: "CAST(NULL AS DOUBLE)" if boolean else _r(f"quantile_cont({d}, {p})") for p in (0.25, 0.75)}
    return f"""SELECT {_common(column, c)},
  {_r(f"avg({d})")} AS mean, {_r(f"stddev_samp({d})")} AS std, {_r(f"min({d})")} AS min,
  {_r(f"max({d})")} AS max, {_r(f"quantile_cont({d}, 0.5)")} AS median,
  {quartile[0.25]} AS q1, {quartile[0.75]} AS q3,
  {_r(f"skewness({d})")} AS skew, {_r(f"kurtosis({d})")} AS kurtosis,
  count(*) FILTER ({d} = 0) AS zero_count,
  {_r(f"count(*) FILTER ({d} = 0) * 100.0e0 / count({c})")} AS zero_percentage
FROM {_rel(rel)} t"""


def _text(rel: str, column: str) -> str:
    return f"""SELECT s.*, m.most_common, m.most_common_count,
  {_r("m.most_common_count * 100.0e0 / (s.total_count - s.missing_count)")} AS most_common_percentage,
  e.entropy
FROM (SELECT {_common(column, column)} FROM {_rel(rel)} t) s,
 (SELECT {column} AS most_common, count(*) AS most_common_count FROM {_rel(rel)} t
  WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) m,
 (SELECT {_r("-sum(p * log2(p))")} AS entropy FROM (
   SELECT count(*) * 1.0e0 / sum(count(*)) OVER () AS p FROM {_rel(rel)} t
   WHERE {column} IS NOT NULL GROUP BY {column})) e"""


def _date(rel: str, column: str) -> str:
    return f"""SELECT {_common(column, column)},
  strftime(min({column}), '{STAMP}') AS min_date, strftime(max({column}), '{STAMP}') AS max_date,
  date_sub('day', min({column}), max({column})) AS date_range_days,
  count(*) FILTER ({column} > TIMESTAMP '{AS_OF}') AS future_dates
FROM {_rel(rel)} t"""


def _families(rel: str, columns: list[str], kind) -> str:
    return _union([f"SELECT * FROM ({kind(rel, c)})" for c in columns])


_NULLS = {
    "number": ["mean", "std", "min", "max", "median", "q1", "q3", "skew", "kurtosis", "zero_percentage"],
    "text": ["most_common", "most_common_count", "most_common_percentage", "entropy"],
    "date": ["min_date", "max_date", "date_range_days", "future_dates"],
}
_ORDER = [
    "total_count", "missing_count", "missing_percentage", "unique_count", "mean", "std", "min",
    "max", "median", "q1", "q3", "skew", "kurtosis", "zero_count", "zero_percentage",
    "most_common", "most_common_count", "most_common_percentage", "entropy", "min_date",
    "max_date", "date_range_days", "future_dates",
]
_TYPES = {
    "zero_count": "BIGINT", "most_common": "VARCHAR", "most_common_count": "BIGINT",
    "min_date": "VARCHAR", "max_date": "VARCHAR", "date_range_days": "BIGINT",
    "future_dates": "BIGINT",
}


def _full(rel: str, columns: list[tuple[str, str, str]]) -> str:
    parts = []
    for i, (name, dtype, family) in enumerate(columns):
        kind = {
            "numeric": _numeric,
            "boolean": lambda r, c: _numeric(r, c, True),
            "text": _text,
            "datetime": _date,
        }[family]
        have = {"numeric": _ORDER[:15], "boolean": _ORDER[:15]}.get(
            family, _ORDER[:4] + _NULLS["text" if family == "text" else "date"]
        )
        cells = [
            n if n in have else f"CAST(NULL AS {_TYPES.get(n, 'DOUBLE')}) AS {n}" for n in _ORDER
        ]
        # The range of a bigint or decimal column in its own type.
        exact = f"(SELECT CAST({{}}({name}) AS VARCHAR) FROM {_rel(rel)} x)" if dtype == "bigint" else "CAST(NULL AS VARCHAR)"
        cells += [f"{exact.format('min')} AS min_exact", f"{exact.format('max')} AS max_exact"]
        parts.append(
            f"""SELECT "column", CAST({i} AS BIGINT) AS ordinal, '{dtype}' AS dtype,
  '{family}' AS family, {', '.join(cells)} FROM ({kind(rel, name)})"""
        )
    return _union(parts)


# Issues, as SELECTs of (column, issue_type, severity, message, affected_count, affected_percentage)


def _issue(column, kind, severity, message, count, percent, body) -> str:
    return f"""SELECT '{column}' AS "column", '{kind}' AS issue_type, {severity} AS severity,
  {message} AS message, CAST({count} AS BIGINT) AS affected_count,
  {_r(percent)} AS affected_percentage FROM {body}"""


def _missing_issue(rel: str, column: str, critical=0.3, warning=0.05) -> str:
    body = f"""(SELECT count(*) - count({column}) AS k,
  (count(*) - count({column})) * 100.0e0 / count(*) AS pct FROM {_rel(rel)} t)
  WHERE pct > {warning} * 100"""
    high = f"pct > {critical} * 100"
    return _issue(
        column, "missing_values", f"CASE WHEN {high} THEN 'critical' ELSE 'warning' END",
        f"printf(CASE WHEN {high} THEN 'High' ELSE 'Moderate' END || "
        "' percentage of missing values (%.1f%%)', pct)",
        "k", "pct", body,
    )


def _fences(rel: str, column: str, where: str = "true", k: float = 1.5) -> str:
    return f"""(SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi, n, mn, mx FROM (
  SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1,
   quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3, count({column}) AS n,
   CAST(min({column}) AS DOUBLE) AS mn, CAST(max({column}) AS DOUBLE) AS mx
  FROM {_rel(rel)} t WHERE {where}))"""


def _outlier_issue(rel: str, column: str, where: str = "true") -> str:
    body = f"""(SELECT any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n,
  count(*) FILTER ({column} < lo OR {column} > hi) AS k
  FROM {_rel(rel)} t, {_fences(rel, column, where)} f WHERE {where}) WHERE k > 0 AND n >= 10"""
    return _issue(
        column, "outliers", "CASE WHEN k * 100.0e0 / n < 10 THEN 'warning' ELSE 'critical' END",
        "printf('Found %d outliers outside range [%.2f, %.2f]', k, lo, hi)",
        "k", "k * 100.0e0 / n", body,
    )


def _skew_issue(rel: str, column: str, boolean: bool = False) -> str:
    d = f"CAST(CAST({column} AS INTEGER) AS DOUBLE)" if boolean else f"CAST({column} AS DOUBLE)"
    body = f"(SELECT skewness({d}) AS g FROM {_rel(rel)} t) WHERE abs(g) > 1"
    return _issue(
        column, "skewed_distribution", "'info'",
        "printf('Distribution is skewed (skewness = %.2f)', g)", "0", "0", body,
    )


def _cardinality_issue(rel: str, column: str) -> str:
    body = f"""(SELECT count(DISTINCT {column}) AS u, count(*) AS n FROM {_rel(rel)} t)
  WHERE u * 1.0e0 / n < 0.01"""
    return _issue(
        column, "low_cardinality", "'info'",
        "printf('Low cardinality: %d unique values for %d rows', u, n)",
        "u", "u * 100.0e0 / n", body,
    )


def _spelling(rel: str, column: str) -> str:
    return f"""(SELECT lower(trim({column}, ' ' || chr(9) || chr(10) || chr(13))) AS norm,
  count(DISTINCT {column}) AS spellings, count(*) AS k
  FROM {_rel(rel)} t WHERE {column} IS NOT NULL GROUP BY 1)"""


def _inconsistent_issue(rel: str, column: str) -> str:
    body = f"""(SELECT sum(k) AS k FROM {_spelling(rel, column)} WHERE spellings > 1),
  (SELECT count(*) AS n FROM {_rel(rel)} t) WHERE k > 0"""
    return _issue(
        column, "inconsistent_values", "'warning'",
        "'Potential inconsistent values (different casing/spacing)'", "k", "k * 100.0e0 / n", body,
    )


def _future_issue(rel: str, column: str) -> str:
    body = f"""(SELECT count(*) FILTER ({column} > TIMESTAMP '{AS_OF}') AS k, count(*) AS n
  FROM {_rel(rel)} t) WHERE k > 0"""
    return _issue(
        column, "future_dates", "'warning'", "printf('Found %d future dates', k)", "k",
        "k * 100.0e0 / n", body,
    )


def _all_issues(rel: str, numeric=(), boolean=(), text=(), dates=()) -> str:
    parts = []
    for c in numeric:
        parts += [_missing_issue(rel, c), _outlier_issue(rel, c), _skew_issue(rel, c)]
    for c in boolean:
        parts += [_missing_issue(rel, c), _skew_issue(rel, c, True)]
    for c in text:
        parts += [_missing_issue(rel, c), _cardinality_issue(rel, c), _inconsistent_issue(rel, c)]
    parts += [_future_issue(rel, c) for c in dates]
    return _union(parts)


EVENT_ISSUES = _all_issues(
    "dirty_events", ["event_id", "user_id", "value"], ["is_large"], ["event_type", "props"], ["ts"]
)
ORDER_ISSUES = _all_issues(
    "dirty_orders", ["o_orderkey", "o_custkey", "o_totalprice"], [],
    ["o_orderstatus", "o_orderpriority"], ["o_orderdate"],
)
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]

# Drift ------------------------------------------------------------------------

_REF, _CUR = "drift_ref", "drift_cur"
SQL[_REF] = f"SELECT * FROM ({SQL['drifted']}) WHERE ts < TIMESTAMP '{SPLIT}'"
SQL[_CUR] = f"SELECT * FROM ({SQL['drifted']}) WHERE ts >= TIMESTAMP '{SPLIT}'"
_OREF, _OCUR = "order_ref", "order_cur"
SQL[_OREF] = f"SELECT * FROM ({SQL['dirty_orders']}) WHERE o_orderdate < TIMESTAMP '{ORDER_SPLIT}'"
SQL[_OCUR] = f"SELECT * FROM ({SQL['dirty_orders']}) WHERE o_orderdate >= TIMESTAMP '{ORDER_SPLIT}'"

_TERM = """(CASE WHEN c = 0 THEN 1e-4 ELSE c * 1.0e0 / nc END - CASE WHEN r = 0 THEN 1e-4 ELSE r * 1.0e0 / nr END)
  * ln(CASE WHEN c = 0 THEN 1e-4 ELSE c * 1.0e0 / nc END / CASE WHEN r = 0 THEN 1e-4 ELSE r * 1.0e0 / nr END)"""


def _status(psi: str) -> str:
    return f"CASE WHEN {psi} >= 0.25 THEN 'significant' WHEN {psi} >= 0.1 THEN 'moderate' ELSE 'stable' END"


def _psi_category(ref: str, cur: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", sum({_TERM}) AS psi FROM (
  SELECT coalesce(a.k, 0) AS r, coalesce(b.k, 0) AS c FROM
   (SELECT {column} AS v, count(*) AS k FROM {_rel(ref)} t WHERE {column} IS NOT NULL GROUP BY 1) a
   FULL OUTER JOIN
   (SELECT {column} AS v, count(*) AS k FROM {_rel(cur)} t WHERE {column} IS NOT NULL GROUP BY 1) b
   ON a.v = b.v) x,
  (SELECT count({column}) AS nr FROM {_rel(ref)} t) y, (SELECT count({column}) AS nc FROM {_rel(cur)} t) z"""


def _psi_numeric(ref: str, cur: str, column: str) -> str:
    d = f"CAST({column} AS DOUBLE)"
    deciles = ", ".join(f"{i / 10}" for i in range(11))
    return f"""SELECT '{column}' AS "column", sum({_TERM}) AS psi FROM (
  SELECT b.lo, (SELECT count(*) FROM {_rel(ref)} t WHERE {d} >= b.lo AND ({d} < b.hi OR (b.is_last AND {d} = b.hi))) AS r,
   (SELECT count(*) FROM {_rel(cur)} t WHERE {d} >= b.lo AND ({d} < b.hi OR (b.is_last AND {d} = b.hi))) AS c
  FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi,
         lead(e, 2) OVER (ORDER BY e) IS NULL AS is_last FROM (
         SELECT DISTINCT unnest(quantile_cont({d}, [{deciles}])) AS e FROM {_rel(ref)} t)) b
  WHERE b.hi IS NOT NULL) x,
  (SELECT count({column}) AS nr FROM {_rel(ref)} t) y, (SELECT count({column}) AS nc FROM {_rel(cur)} t) z"""


def _ks(ref: str, cur: str, column: str, boolean: bool = False) -> str:
    d = f"CAST(CAST({column} AS INTEGER) AS DOUBLE)" if boolean else f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", d AS ks_statistic,
  least(1.0e0, 2 * exp(-2 * d * d * (nr * 1.0e0 * nc / (nr + nc)))) AS ks_p_value FROM (
  SELECT max(abs(cr * 1.0e0 / nr - cc * 1.0e0 / nc)) AS d, any_value(nr) AS nr, any_value(nc) AS nc FROM (
   SELECT sum(sum(r)) OVER (ORDER BY v) AS cr, sum(sum(c)) OVER (ORDER BY v) AS cc,
     sum(sum(r)) OVER () AS nr, sum(sum(c)) OVER () AS nc FROM (
    SELECT {d} AS v, 1 AS r, 0 AS c FROM {_rel(ref)} t WHERE {column} IS NOT NULL UNION ALL
    SELECT {d}, 0, 1 FROM {_rel(cur)} t WHERE {column} IS NOT NULL) GROUP BY v))"""


def _change(ref: str, cur: str, column: str, boolean: bool = False) -> str:
    d = f"CAST(CAST({column} AS INTEGER) AS DOUBLE)" if boolean else f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", rm AS ref_mean, cm AS curr_mean,
  CASE WHEN rm = 0 THEN 0 ELSE (cm - rm) / rm * 100 END AS pct_change FROM
  (SELECT avg({d}) AS rm FROM {_rel(ref)} t) a, (SELECT avg({d}) AS cm FROM {_rel(cur)} t) b"""


def _psi_table(parts: list[str]) -> str:
    return f"""SELECT "column", {_r("psi")} AS psi, {_status("psi")} AS drift_status FROM ({_union(parts)})"""


def _drift_table(ref: str, cur: str, columns: list[tuple[str, str, str]]) -> str:
    parts = []
    for name, dtype, family in columns:
        if family == "numeric":
            psi = _psi_numeric(ref, cur, name)
        else:
            psi = _psi_category(ref, cur, name)
        if family in ("numeric", "boolean"):
            flag = family == "boolean"
            rest = f"""{_r("m.pct_change")} AS pct_change, {_r("k.ks_statistic")} AS ks_statistic,
  {_r("k.ks_p_value")} AS ks_p_value FROM ({psi}) p, ({_change(ref, cur, name, flag)}) m, ({_ks(ref, cur, name, flag)}) k"""
        else:
            null = "CAST(NULL AS DOUBLE)"
            rest = f"{null} AS pct_change, {null} AS ks_statistic, {null} AS ks_p_value FROM ({psi}) p"
        parts.append(
            f"""SELECT p."column", '{dtype}' AS dtype, {_r("p.psi")} AS psi, {_status("p.psi")} AS drift_status, {rest}"""
        )
    return _union(parts)


# Small helpers for the rest -----------------------------------------------------


def _stamped(columns: list[str], stamps: list[str]) -> str:
    return ", ".join(
        f"strftime({c}, '{STAMP}') AS {c}" if c in stamps else c for c in columns
    )


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "is_large", "props"]
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _corr(rel: str, columns: list[str]) -> list[str]:
    return [
        f"""SELECT '{a}' AS col1, '{b}' AS col2, {_r(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")} AS r FROM {_rel(rel)} t"""
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]


def _missing_rows(rel: str, columns: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
  {_r(f"(count(*) - count({c})) * 100.0e0 / count(*)")} AS missing_percentage FROM {_rel(rel)} t"""
            for c in columns
        ]
    )


def _histogram(rel: str, column: str) -> str:
    d = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", CAST(i + 1 AS BIGINT) AS bin, {_r("lower")} AS lower, {_r("upper")} AS upper,
  (SELECT count(*) FROM {_rel(rel)} t WHERE {d} >= lower AND ({d} < upper OR (i = k - 1 AND {d} = upper))) AS cnt
FROM (SELECT i, k, lo + i * ((hi - lo) / k) AS lower,
   CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / k) END AS upper
  FROM (SELECT min({d}) AS lo, max({d}) AS hi, greatest(10, least(50, count({column}) // 10)) AS k FROM {_rel(rel)} t) s,
   generate_series(0, 49) g(i) WHERE i < k)"""


def _distribution(rel: str, column: str) -> str:
    d = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", count({column}) AS n, greatest(10, least(50, count({column}) // 10)) AS bins,
  {_r(f"min({d})")} AS min, {_r(f"max({d})")} AS max, {_r(f"avg({d})")} AS mean, {_r(f"median({d})")} AS median,
  {_r(f"skewness({d})")} AS skew, CASE WHEN abs(skewness({d})) > 1 THEN 'high'
   WHEN abs(skewness({d})) > 0.5 THEN 'moderate' ELSE 'low' END AS skew_class FROM {_rel(rel)} t"""


def _box(rel: str, column: str) -> str:
    d = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", {_r("any_value(q1)")} AS q1, {_r("any_value(q2)")} AS median,
  {_r("any_value(q3)")} AS q3, {_r("any_value(q3 - q1)")} AS iqr, {_r("any_value(q1 - 1.5 * (q3 - q1))")} AS lower_bound,
  {_r("any_value(q3 + 1.5 * (q3 - q1))")} AS upper_bound,
  count(*) FILTER ({d} < q1 - 1.5 * (q3 - q1) OR {d} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  {_r(f"count(*) FILTER ({d} < q1 - 1.5 * (q3 - q1) OR {d} > q3 + 1.5 * (q3 - q1)) * 100.0e0 / count({column})")} AS outlier_percentage
FROM {_rel(rel)} t, (SELECT quantile_cont({d}, 0.25) AS q1, quantile_cont({d}, 0.5) AS q2, quantile_cont({d}, 0.75) AS q3 FROM {_rel(rel)} t) q"""


def _categories(column: str) -> str:
    return f"""SELECT '{column}' AS "column", CASE WHEN grp > 14 AND vals > 15 THEN 'Other' ELSE v END AS category,
  CAST(sum(k) AS BIGINT) AS cnt, {_r("sum(k) * 100.0e0 / any_value(n)")} AS percentage, grp > 14 AND vals > 15 AS is_other
FROM (SELECT v, k, sum(k) OVER () AS n, count(*) OVER () AS vals,
   row_number() OVER (ORDER BY k DESC, v) AS grp
  FROM (SELECT {column} AS v, count(*) AS k FROM documents WHERE {column} IS NOT NULL GROUP BY 1))
GROUP BY 2, 5"""


def _size(rel: str, texts: list[str], fixed: dict[str, int]) -> str:
    parts = [f"coalesce(sum(strlen({c})), 0)" for c in texts]
    parts += [f"count({c}) * {w}" for c, w in fixed.items()]
    return f"CAST({' + '.join(parts)} AS BIGINT)"


_CUSTOMER_SIZE = _size(
    "customer", ["c_name", "c_mktsegment"], {"c_custkey": 8, "c_nationkey": 4, "c_acctbal": 8}
)
_SEVERITY = f"""SELECT count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info
FROM ({{}})"""
_RANGE = {"l_quantity": "l_quantity < 5 OR l_quantity > 45", "l_discount": "l_discount > 0.08"}
_ALLOWED = {"l_returnflag": "l_returnflag NOT IN ('A', 'N')"}
_CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, {} AS c_acctbal, c_mktsegment FROM customer"


def _constraint(column: str, kind: str, bad: str) -> str:
    return f"""SELECT '{column}' AS "column", '{kind}' AS "constraint", count({column}) AS checked_count,
  count(*) FILTER ({bad}) AS violations, {_r(f"count(*) FILTER ({bad}) * 100.0e0 / count({column})")} AS violation_percentage
FROM lineitem"""


def _date_check(column: str, parsed: str) -> str:
    seps = f"""array_to_string([s FOR s IN [CASE WHEN count(*) FILTER (contains({column}, '/')) > 0 THEN '/' END,
   CASE WHEN count(*) FILTER (contains({column}, '-') AND NOT contains({column}, '/')) > 0 THEN '-' END,
   CASE WHEN count(*) FILTER (contains({column}, '.') AND NOT contains({column}, '/') AND NOT contains({column}, '-')) > 0 THEN '.' END] IF s IS NOT NULL], '|')"""
    return f"""SELECT '{column}' AS "column", CASE WHEN count(d) > 0 THEN 'ok' ELSE 'no_valid_dates' END AS status,
  strftime(min(d), '{STAMP}') AS min_date, strftime(max(d), '{STAMP}') AS max_date,
  date_sub('day', min(d), max(d)) AS date_range_days, count(*) FILTER (d > TIMESTAMP '{AS_OF}') AS future_dates,
  count(*) FILTER (d < TIMESTAMP '1900-01-01') AS past_century_dates, count(d) AS valid_date_count,
  count(*) - count(d) AS invalid_date_count, {seps} AS separators, contains({seps}, '|') AS mixed_separators
FROM (SELECT {column}, {parsed} AS d FROM {_rel("order_dates")} t)"""


def _separator_rows(column: str) -> str:
    return f"""SELECT '{column}' AS "column", separator, count(*) AS "values" FROM (
  SELECT CASE WHEN contains({column}, '/') THEN '/' WHEN contains({column}, '-') THEN '-'
   WHEN contains({column}, '.') THEN '.' END AS separator FROM {_rel("order_dates")} t)
WHERE separator IS NOT NULL GROUP BY separator"""


_PARSED = "coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%Y/%m/%d'))"
_PATTERN = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _ORDER_COLUMNS)
_MISSING = _missing_rows("dirty_orders", _ORDER_COLUMNS)
_KEPT = f"value IS NOT NULL AND value <> {SENTINEL}"

ORACLES: dict[str, str] = {
    "profile_numeric": _families("lineitem", LINE_NUMBERS, _numeric),
    "profile_numeric_missing": _families("dirty_orders", ["o_orderkey", "o_custkey", "o_totalprice"], _numeric),
    "profile_boolean": _numeric("dirty_events", "is_large", True),
    "profile_categorical": _families("dirty_orders", ["o_orderstatus", "o_orderpriority"], _text),
    "profile_part_text": _families("part", ["p_name", "p_brand", "p_type"], _text),
    "profile_long_text": _families("documents", ["text", "lang", "source"], _text),
    "profile_pages": _families("pages", ["url", "html"], _text),
    "profile_conversations": _families("conversations", ["role", "text"], _text),
    "profile_datetime": _date("events", "ts"),
    "profile_nested": """SELECT 'vec_id' AS "column", 'numeric' AS family, count(*) AS total_count, count(*) - count(vec_id) AS missing_count, count(DISTINCT vec_id) AS unique_count FROM embeddings
UNION ALL SELECT 'embedding', 'other', count(*), count(*) - count(embedding), NULL FROM embeddings
UNION ALL SELECT 'label', 'numeric', count(*), count(*) - count(label), count(DISTINCT label) FROM embeddings""",
    "profile_full": _full(
        "dirty_events",
        [
            ("event_id", "bigint", "numeric"),
            ("ts", "timestamp_ntz", "datetime"),
            ("user_id", "bigint", "numeric"),
            ("event_type", "string", "text"),
            ("value", "double", "numeric"),
            ("is_large", "boolean", "boolean"),
            ("props", "string", "text"),
        ],
    ),
    "dataset_shape": f"""SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, count(*) * 5 AS total_cells,
  {_CUSTOMER_SIZE} AS size_bytes FROM customer""",
    "summary_statistics": f"""SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, count(*) * 5 AS total_cells,
  {_CUSTOMER_SIZE} AS size_bytes, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS column_names,
  '{{"bigint":1,"double":1,"int":1,"string":2}}' AS dtypes_count FROM customer""",
    "value_counts": """SELECT 'source' AS "column", source AS value, count(*) AS cnt FROM documents WHERE source IS NOT NULL GROUP BY 2""",
    "dataset_summary": f"""SELECT 'orders' AS dataset, t.rows, CAST(6 AS BIGINT) AS columns, t.rows * 6 AS total_cells, t.size_bytes,
  s.critical, s.warning, s.info,
  (SELECT '{{' || string_agg('"' || issue_type || '":' || n, ',' ORDER BY issue_type) || '}}' FROM (SELECT issue_type, count(*) AS n FROM ({ORDER_ISSUES}) GROUP BY 1)) AS issues_by_type,
  '{{"categorical":2,"datetime":1,"numeric":3}}' AS column_types,
  m.columns_with_missing, m.total_missing_cells, {_r("m.total_missing_cells * 100.0e0 / (t.rows * 6)")} AS total_missing_percentage, m.most_missing
FROM (SELECT count(*) AS rows, {_size("x", ["o_orderstatus", "o_orderpriority"], {"o_orderkey": 8, "o_custkey": 8, "o_orderdate": 8})}
   + 8 * (SELECT count(*) FROM orders WHERE NOT (o_orderkey % 14 = 0)) AS size_bytes FROM {_rel("dirty_orders")} x) t,
 ({_SEVERITY.format(ORDER_ISSUES)}) s,
 (SELECT count(*) FILTER (missing_count > 0) AS columns_with_missing, CAST(sum(missing_count) AS BIGINT) AS total_missing_cells,
   max_by("column", missing_percentage) AS most_missing FROM ({_MISSING})) m""",
    "quick_summary": f"""SELECT 'customer' AS dataset, (SELECT count(*) FROM customer) AS rows, CAST(5 AS BIGINT) AS columns, s.*, CAST(0 AS BIGINT) AS columns_with_missing
FROM ({_SEVERITY.format(_all_issues("customer", ["c_custkey", "c_nationkey", "c_acctbal"], [], ["c_name", "c_mktsegment"]))}) s""",
    "column_report": f"""SELECT 'value' AS "column", 'double' AS dtype, {_r("avg(value)")} AS mean, {_r("median(value)")} AS median,
  count(DISTINCT value) AS unique_count, (SELECT string_agg(issue_type, '|' ORDER BY issue_type) FROM ({_all_issues("events", ["value"])})) AS issue_types FROM events""",
    "missing_overview": f"""SELECT * FROM ({_MISSING}) WHERE missing_count > 0 ORDER BY missing_percentage DESC LIMIT 10""",
    "missing_totals": f"""SELECT count(*) FILTER (missing_count > 0) AS columns_with_missing, CAST(sum(missing_count) AS BIGINT) AS total_missing_cells,
  {_r("sum(missing_count) * 100.0e0 / (6 * (SELECT count(*) FROM orders))")} AS total_missing_percentage FROM ({_MISSING})""",
    "issues_missing": _union([_missing_issue("dirty_orders", c) for c in _ORDER_COLUMNS]),
    "issues_missing_thresholds": _union([_missing_issue("dirty_orders", c, 0.5) for c in _ORDER_COLUMNS]),
    "issues_outliers": _union([_outlier_issue("documents", c) for c in ("doc_id", "n_chars")]),
    "issues_outliers_critical": _union([_outlier_issue("labels", c) for c in ("doc_id", "quality", "toxic")]),
    "issues_outliers_excluding": _union(
        [_outlier_issue("dirty_events", "value", _KEPT)]
        + [_outlier_issue("dirty_events", c) for c in ("event_id", "user_id")]
    ),
    "outlier_examples": f"""SELECT 'value' AS "column", {_r("lo")} AS lower_bound, {_r("hi")} AS upper_bound, {_r("mn")} AS min_value, {_r("mx")} AS max_value,
  (SELECT string_agg(printf('%.2f', v), '|' ORDER BY far DESC, v) FROM (SELECT DISTINCT value AS v, greatest(f.lo - value, value - f.hi) AS far
    FROM events WHERE value < f.lo OR value > f.hi ORDER BY far DESC, v LIMIT 5)) AS examples FROM {_fences("events", "value")} f""",
    "issues_skew": _union([_skew_issue("events", c) for c in ("event_id", "user_id", "value")]),
    "issues_cardinality": _union([_cardinality_issue("lineitem", c) for c in ("l_returnflag", "l_linestatus")]),
    "issues_inconsistent": _union([_inconsistent_issue("dirty_events", c) for c in ("event_type", "props")]),
    "spelling_groups": f"""SELECT 'event_type' AS "column", (SELECT count(*) FROM {_spelling("dirty_events", "event_type")}) AS normalized_values,
  (SELECT string_agg(example, '|' ORDER BY k DESC, norm) FROM (
    SELECT norm, sum(k) AS k, string_agg(v, ' | ' ORDER BY k DESC, v) AS example FROM (
      SELECT event_type AS v, lower(trim(event_type)) AS norm, count(*) AS k FROM {_rel("dirty_events")} t GROUP BY 1, 2)
    GROUP BY norm HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS examples""",
    "issues_future": _future_issue("events", "ts"),
    "issues_all": EVENT_ISSUES,
    "issues_by_severity": f"""SELECT s.severity, count(i.severity) AS issues FROM (SELECT unnest(['critical', 'warning', 'info']) AS severity) s
LEFT JOIN ({EVENT_ISSUES}) i ON i.severity = s.severity GROUP BY 1""",
    "issues_by_type": f"SELECT issue_type, count(*) AS issues FROM ({EVENT_ISSUES}) GROUP BY 1",
    "issue_chart": f"""SELECT 'severity' AS chart, s.severity AS label, count(i.severity) AS issues FROM (SELECT unnest(['critical', 'warning', 'info']) AS severity) s
LEFT JOIN ({EVENT_ISSUES}) i ON i.severity = s.severity GROUP BY 2
UNION ALL SELECT 'type', issue_type, count(*) FROM ({EVENT_ISSUES}) GROUP BY 2""",
    "quality_grade": f"""SELECT *, CASE WHEN critical > 0 THEN 'POOR' WHEN warning > 0 THEN 'FAIR' ELSE 'GOOD' END AS grade FROM ({_SEVERITY.format(EVENT_ISSUES)})""",
    "health_score": f"""SELECT critical + warning + info AS total_issues, critical AS critical_issues,
  CAST(greatest(0, 100 - 10 * critical - 2 * (warning + info)) AS BIGINT) AS health_score,
  100 - 10 * critical - 2 * (warning + info) >= 80 AS approved FROM ({_SEVERITY.format(EVENT_ISSUES)})""",
    "recommendations": f"""SELECT rule, recommendation FROM (SELECT * FROM ({_SEVERITY.format(ORDER_ISSUES)}),
  (SELECT sum(missing_count) * 100.0e0 / (6 * (SELECT count(*) FROM orders)) AS pct FROM ({_MISSING}))) s,
 (VALUES ('critical', 'Address critical issues before proceeding with analysis.'),
  ('some_missing', 'Review missing data patterns and consider appropriate handling methods.'),
  ('much_missing', 'Consider data imputation or investigate sources of missing data.')) r(rule, recommendation)
WHERE (rule = 'critical' AND critical > 0) OR (rule = 'much_missing' AND pct > 20) OR (rule = 'some_missing' AND pct > 5 AND pct <= 20)""",
    "issue_context": f"""SELECT i."column", i.issue_type, i.severity, i.affected_count, i.affected_percentage,
  CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound, CAST(NULL AS VARCHAR) AS examples,
  CASE i."column" WHEN 'o_totalprice' THEN 'double' WHEN 'o_orderdate' THEN 'timestamp_ntz' ELSE 'string' END AS dtype,
  n.mean, n.median, n.min, n.max, coalesce(n.unique_count, x.unique_count, d.unique_count) AS unique_count, x.most_common
FROM ({ORDER_ISSUES}) i LEFT JOIN ({_numeric("dirty_orders", "o_totalprice")}) n ON n."column" = i."column"
LEFT JOIN ({_families("dirty_orders", ["o_orderstatus", "o_orderpriority"], _text)}) x ON x."column" = i."column"
LEFT JOIN ({_date("dirty_orders", "o_orderdate")}) d ON d."column" = i."column"
WHERE i.severity IN ('critical', 'warning')""",
    "rows_missing": f"SELECT {_stamped([c for c in _ORDER_COLUMNS if c != 'o_totalprice'], ['o_orderdate'])} FROM {_rel('dirty_orders')} t WHERE o_totalprice IS NULL",
    "rows_outliers": f"SELECT event_id, strftime(ts, '{STAMP}') AS ts, user_id, event_type, {_r('value')} AS value, props FROM events, {_fences('events', 'value')} f WHERE value < lo OR value > hi",
    "rows_all": f"SELECT event_id, strftime(ts, '{STAMP}') AS ts, user_id, event_type, {_r('value')} AS value, is_large, props FROM {_rel('dirty_events')} t, {_fences('dirty_events', 'value')} f WHERE value IS NULL OR value < lo OR value > hi",
    "rows_excluding_sentinels": f"SELECT event_id, strftime(ts, '{STAMP}') AS ts, user_id, event_type, {_r('value')} AS value, is_large, props FROM {_rel('dirty_events')} t, {_fences('dirty_events', 'value', _KEPT)} f WHERE {_KEPT} AND (value < lo OR value > hi)",
    "rows_any_issue": f"""SELECT o_orderkey, o_custkey, o_orderstatus, {_r('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '{STAMP}') AS o_orderdate, o_orderpriority
FROM {_rel('dirty_orders')} t, {_fences('dirty_orders', 'o_totalprice')} f, (SELECT DISTINCT true AS has FROM ({ORDER_ISSUES}) WHERE "column" = 'o_totalprice') h
WHERE o_totalprice IS NULL OR o_totalprice < lo OR o_totalprice > hi OR o_orderpriority IS NULL""",
    "rows_tagged": f"""SELECT doc_id, n_chars, 'n_chars' AS problems FROM documents, {_fences('documents', 'n_chars')} f WHERE n_chars < lo OR n_chars > hi""",
    "constraint_report": _union(
        [_constraint(c, "range", bad) for c, bad in _RANGE.items()]
        + [_constraint(c, "allowed", bad) for c, bad in _ALLOWED.items()]
    ),
    "constraint_rows": f"""SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_r('l_quantity')} AS l_quantity,
  {_r('l_extendedprice')} AS l_extendedprice, {_r('l_discount')} AS l_discount, {_r('l_tax')} AS l_tax, l_returnflag, l_linestatus,
  strftime(l_shipdate, '{STAMP}') AS l_shipdate, concat_ws('|', CASE WHEN {_RANGE['l_quantity']} THEN 'l_quantity' END,
   CASE WHEN {_RANGE['l_discount']} THEN 'l_discount' END, CASE WHEN {_ALLOWED['l_returnflag']} THEN 'l_returnflag' END) AS violated
FROM lineitem WHERE {_RANGE['l_quantity']} OR {_RANGE['l_discount']} OR {_ALLOWED['l_returnflag']}""",
    "constraint_lookup": f"""SELECT o_orderkey, o_custkey, o_orderstatus, {_r('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '{STAMP}') AS o_orderdate, o_orderpriority
FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
    "drift_mean": f"""SELECT "column", {_r("ref_mean")} AS ref_mean, {_r("curr_mean")} AS curr_mean, {_r("pct_change")} AS pct_change FROM ({_union([_change(_REF, _CUR, c, c == "is_large") for c in ("event_id", "user_id", "value", "is_large")])})""",
    "drift_profiles": f"""SELECT "column", {_r("ref_mean")} AS ref_mean, {_r("curr_mean")} AS curr_mean, {_r("pct_change")} AS pct_change FROM ({_union([_change(_OREF, _OCUR, c) for c in ("o_orderkey", "o_custkey", "o_totalprice")])})""",
    "drift_psi_numeric": _psi_table([_psi_numeric(_REF, _CUR, c) for c in ("event_id", "user_id", "value")]),
    "drift_psi_categorical": _psi_table([_psi_category(_OREF, _OCUR, c) for c in ("o_orderstatus", "o_orderpriority")]),
    "drift_psi_boolean": _psi_table([_psi_category(_REF, _CUR, "is_large")]),
    "drift_psi_datetime": _psi_table([_psi_category(_OREF, _OCUR, "o_orderdate")]),
    "drift_ks": f"""SELECT "column", {_r("ks_statistic")} AS ks_statistic, {_r("ks_p_value")} AS ks_p_value FROM ({_union([_ks(_REF, _CUR, c, c == "is_large") for c in ("event_id", "user_id", "value", "is_large")])})""",
    "drift_table": _drift_table(
        _REF,
        _CUR,
        [
            ("event_id", "bigint", "numeric"),
            ("ts", "timestamp_ntz", "datetime"),
            ("user_id", "bigint", "numeric"),
            ("event_type", "string", "text"),
            ("value", "double", "numeric"),
            ("is_large", "boolean", "boolean"),
        ],
    ),
    "drift_table_missing": _drift_table(
        _OREF,
        _OCUR,
        [
            ("o_orderkey", "bigint", "numeric"),
            ("o_custkey", "bigint", "numeric"),
            ("o_orderstatus", "string", "text"),
            ("o_totalprice", "double", "numeric"),
            ("o_orderdate", "timestamp_ntz", "datetime"),
            ("o_orderpriority", "string", "text"),
        ],
    ),
    "column_roles": _union(
        ["SELECT 'p_partkey' AS \"column\", 'numeric' AS role", "SELECT 'p_size', 'numeric'", "SELECT 'p_retailprice', 'numeric'"]
        + [
            f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) * 1.0e0 / count(*) < 0.1 THEN 'categorical' WHEN count(DISTINCT {c}) > 50 THEN 'text' ELSE 'categorical' END FROM part"
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
    "column_roles_events": _union(
        ["SELECT 'ts' AS \"column\", 'datetime' AS role"]
        + [f"SELECT '{c}', 'numeric'" for c in ("event_id", "user_id", "value", "is_large")]
        + [
            f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) * 1.0e0 / count(*) < 0.1 THEN 'categorical' WHEN count(DISTINCT {c}) > 50 THEN 'text' ELSE 'categorical' END FROM {_rel('dirty_events')} t"
            for c in ("event_type", "props")
        ]
    ),
    "potential_ids": f"""SELECT "column", {_r("ratio")} AS uniqueness_ratio, dtype FROM (
  SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) * 1.0e0 / count(*) AS ratio, 'bigint' AS dtype FROM customer
  UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) * 1.0e0 / count(*), 'int' FROM customer) WHERE ratio > 0.95""",
    "correlation_pairs": _union(_corr("lineitem", LINE_NUMBERS)),
    "correlation_missing": _union(_corr("dirty_events", ["event_id", "user_id", "value"])),
    "correlation_heatmap": f"""WITH pairs AS ({_union(_corr("part", ["p_partkey", "p_size", "p_retailprice"]))})
SELECT * FROM pairs UNION ALL SELECT col2, col1, r FROM pairs
UNION ALL SELECT c, c, 1.0e0 FROM (SELECT unnest(['p_partkey', 'p_size', 'p_retailprice']) AS c)""",
    "duplicate_columns": """SELECT CAST(0 AS BIGINT) AS group_id, c AS "column" FROM (SELECT unnest(['l_quantity', 'qty2']) AS c)
WHERE (SELECT corr(l_quantity, l_quantity * 2) FROM lineitem) > 0.95""",
    "date_consistency": _union([_date_check("order_date", _PARSED), _date_check("iso_date", "try_strptime(iso_date, '%Y-%m-%d')")]),
    "date_separators": _union([_separator_rows("order_date"), _separator_rows("iso_date")]),
    "missing_patterns": f"""SELECT pattern, concat_ws('|', CASE WHEN substr(pattern, 4, 1) = '1' THEN 'o_totalprice' END,
  CASE WHEN substr(pattern, 6, 1) = '1' THEN 'o_orderpriority' END) AS missing_columns, count(*) AS rows
FROM (SELECT {_PATTERN} AS pattern FROM {_rel("dirty_orders")} t) GROUP BY 1""",
    "missing_bars": f"""SELECT *, CASE WHEN missing_percentage > 30 THEN 'critical' WHEN missing_percentage > 5 THEN 'warning' ELSE 'info' END AS level
FROM ({_MISSING}) WHERE missing_count > 0""",
    "histogram": _union([_histogram("dirty_events", c) for c in ("event_id", "user_id", "value")]),
    "distribution_stats": _union([_distribution("dirty_events", c) for c in ("event_id", "user_id", "value")]),
    "box_stats": _union([_box("dirty_events", c) for c in ("event_id", "user_id", "value")]),
    "top_categories": _union([_categories("source"), _categories("lang")]),
    "sample_n": "SELECT least(1000, count(*)) AS sampled, least(1000, count(*)) AS distinct_ids FROM events",
    "sample_stratified": """SELECT event_type, CAST(CASE WHEN (SELECT count(*) FROM events) <= 1000 THEN count(*)
  ELSE round_even(count(*) * (1000.0e0 / (SELECT count(*) FROM events)), 0) END AS BIGINT) AS sampled FROM events GROUP BY 1""",
    "sample_large_csv": "SELECT least(500, count(*)) AS sampled, least(500, count(*)) AS distinct_ids FROM orders",
    "sample_chunk_stream": "SELECT least(300, count(*)) AS sampled, least(300, count(*)) AS distinct_ids FROM orders",
    "impute_median": f"SELECT event_id, {_r('coalesce(value, m)')} AS value FROM {_rel('dirty_events')} t, (SELECT median(value) AS m FROM {_rel('dirty_events')} t) s",
    "clip_fences": f"SELECT event_id, {_r('CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END')} AS value FROM {_rel('dirty_events')} t, {_fences(_REF, 'value')} f",
    "roundtrip_csv": _CUSTOMER.format(_r("c_acctbal")),
    "roundtrip_csv_inferred": f"""SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_r('l_quantity')} AS l_quantity,
  {_r('l_extendedprice')} AS l_extendedprice, {_r('l_discount')} AS l_discount, {_r('l_tax')} AS l_tax, l_returnflag, l_linestatus,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem""",
    "roundtrip_json": _CUSTOMER.format(_r("c_acctbal")),
    "roundtrip_json_array": _CUSTOMER.format(_r("c_acctbal")),
    "roundtrip_csv_text": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "profile_csv_markers": f"""SELECT "column", dtype, missing_count, unique_count, {_r('mean')} AS mean, {_r('median')} AS median FROM (
  SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(*) - count(o_orderkey) AS missing_count, count(DISTINCT o_orderkey) AS unique_count, avg(o_orderkey) AS mean, median(o_orderkey) AS median FROM orders
  UNION ALL SELECT 'o_custkey', 'bigint', count(*) - count(o_custkey), count(DISTINCT o_custkey), avg(o_custkey), median(o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'string', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL FROM orders
  UNION ALL SELECT 'o_totalprice', 'double', count(*) - count(x), count(DISTINCT x), avg(x), median(x) FROM (SELECT CASE WHEN o_orderkey % 7 NOT IN (0, 3) THEN o_totalprice END AS x FROM orders)
  UNION ALL SELECT 'o_orderdate', 'string', count(*) - count(o_orderdate), count(DISTINCT o_orderdate), NULL, NULL FROM orders
  UNION ALL SELECT 'o_orderpriority', 'string', count(*) - count(x), count(DISTINCT x), NULL, NULL FROM (SELECT CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority END AS x FROM orders))""",
    "view_by_name": """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS cnt FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2""",
    "issues_thresholds": _union([_missing_issue("dirty_orders", c, 0.3, 0.2) for c in _ORDER_COLUMNS]),
    "constraints_from_table": _union(
        [_constraint(c, "range", bad) for c, bad in _RANGE.items()]
        + [_constraint(c, "allowed", bad) for c, bad in _ALLOWED.items()]
    ),
    "roundtrip_jsonl": _CUSTOMER.format(_r("c_acctbal")),
    "roundtrip_parquet": _CUSTOMER.format(_r("c_acctbal")),
    "roundtrip_orc": _CUSTOMER.format(_r("c_acctbal")),
    "export_bad_rows": f"SELECT doc_id, text, lang, source, n_chars FROM documents, {_fences('documents', 'n_chars')} f WHERE n_chars < lo OR n_chars > hi",
    "export_results": EVENT_ISSUES,
}
