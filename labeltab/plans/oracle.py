"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Each text runs on the driver's pre-registered views (lineitem, orders, part, ...). Conventions:
counts are BIGINT, doubles are rounded to 6 decimals, ranks and codes are INTEGER, NaN is
mapped to NULL before any statistic (pandas semantics), and column names equal the Spark
side. Per-feature statements are generated from small templates to keep the text readable.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
D2_FEATURES = ["l_quantity", "l_discount", "l_tax"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# ---- derived fixtures (same definitions as labeltab.plans.fixtures) -------------------------

D1 = """d1 AS (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         WHEN o_orderkey % 89 = 0 THEN '  '
         WHEN o_orderkey % 83 = 0 THEN 'abc'
         WHEN o_orderkey % 79 = 0 THEN 'NaN'
         WHEN o_orderkey % 73 = 0 THEN 'inf'
         WHEN o_orderkey % 71 = 0 THEN '-5.0'
         WHEN o_orderkey % 67 = 0 THEN '999999'
         WHEN o_orderkey % 61 = 0 THEN '5d'
         WHEN o_orderkey % 59 = 0 THEN '3F'
         WHEN o_orderkey % 53 = 0 THEN '0x1p3'
         WHEN o_orderkey % 47 = 0 THEN '1_000'
         WHEN o_orderkey % 43 = 0 THEN '+5'
         ELSE CAST(round(o_totalprice) AS VARCHAR) END AS f1,
    CASE WHEN o_orderkey % 101 = 0 THEN ' '
         WHEN o_orderkey % 103 = 0 THEN ' ' || o_orderpriority
         WHEN o_orderkey % 7 = 0 AND o_orderpriority = '5-LOW' THEN '5-LWO'
         WHEN o_orderkey % 107 = 0 THEN lower(o_orderpriority)
         ELSE o_orderpriority END AS label
  FROM orders)"""

#: f1 as a number by the reference's reading: digits with an optional sign, point and exponent, or a
#: spelled infinity or NaN; anything else is no number
NUM_F1 = ("CASE WHEN regexp_full_match(trim(f1), '[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?') "
          "OR regexp_full_match(lower(trim(f1)), '[-+]?(inf|infinity|nan)') THEN TRY_CAST(ltrim(trim(f1), '+') AS DOUBLE) END")

LI_RID = """li_rid AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS rid, *
  FROM lineitem)"""

D2 = LI_RID + """,
d2 AS (
  SELECT rid, l_quantity, l_discount, l_tax,
    CAST(floor((CASE WHEN substr(md5(rid), 1, 1) = '0' THEN greatest(l_quantity - 1, 1.0)
                     ELSE l_quantity END - 1) / 10) AS INTEGER) AS cls
  FROM li_rid)"""

D3 = D2 + """,
d3 AS (
  SELECT 'm_exact' AS model, rid, cls AS label, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS prediction FROM d2
  UNION ALL SELECT 'm_shift', rid, cls, CAST(least(floor(l_quantity / 10), 4) AS INTEGER) FROM d2
  UNION ALL SELECT 'm_const', rid, cls, 0 FROM d2)"""


def nz(c: str) -> str:
    """NaN -> NULL, as a DOUBLE."""
    return f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"


def long_values(table: str, feats: list[str], label: str) -> str:
    """(label, feature, x) with present labels and values."""
    parts = [f"SELECT {label} AS label, '{f}' AS feature, {nz(f)} AS x FROM {table} WHERE {label} IS NOT NULL"
             for f in feats]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") u WHERE x IS NOT NULL"


def r(x: str) -> str:
    return f"round({x}, 6)"


# ---- A: profiling ------------------------------------------------------------------------

ORACLE["a01_class_counts"] = """
SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"""

ORACLE["a02_class_frequency"] = """
SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank,
       count(*) OVER () AS n_classes
FROM (SELECT o_orderpriority AS label, count(*) AS n FROM orders
      WHERE o_orderpriority IS NOT NULL GROUP BY 1) t"""

ORACLE["a03_class_balance"] = """
WITH c AS (SELECT event_type AS label, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1),
     b AS (SELECT label, n FROM c ORDER BY n DESC, label LIMIT 1),
     s AS (SELECT label, n FROM c ORDER BY n ASC, label LIMIT 1)
SELECT c.label, c.n, round(CAST(c.n AS DOUBLE) * 100 / (SELECT sum(n) FROM c), 6) AS percent,
       b.label AS largest_label, b.n AS largest_n, s.label AS smallest_label, s.n AS smallest_n,
       round(CAST(b.n AS DOUBLE) / s.n, 6) AS imbalance_ratio
FROM c, b, s"""


def _describe(table: str, feats: list[str]) -> str:
    parts = []
    for f in feats:
        parts.append(f"""SELECT '{f}' AS feature, count(x) AS n, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std,
  {r('min(x)')} AS min, {r('quantile_cont(x, 0.25)')} AS p25, {r('quantile_cont(x, 0.5)')} AS p50,
  {r('quantile_cont(x, 0.75)')} AS p75, {r('max(x)')} AS max,
  count(*) FILTER (WHERE raw IS NULL OR isnan(CAST(raw AS DOUBLE))) AS n_missing
FROM (SELECT {nz(f)} AS x, {f} AS raw FROM {table}) t""")
    return "\nUNION ALL\n".join(parts)


ORACLE["a04_describe"] = _describe("lineitem", LI_FEATURES)

ORACLE["a05_feature_summary"] = "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, {r('min(x)')} AS min, {r('max(x)')} AS max, {r('avg(x)')} AS mean,
  {r('quantile_cont(x, 0.5)')} AS median, {r('stddev_samp(x)')} AS std, count(DISTINCT x) AS n_unique
FROM (SELECT {nz(f)} AS x FROM part) t""" for f in ["p_size", "p_retailprice"])


def _class_stats(five: bool) -> str:
    parts = []
    for f in LI_FEATURES:
        if five:
            sel = f"""count(x) AS n, {r('avg(x)')} AS mean, {r('quantile_cont(x, 0.5)')} AS median,
  {r('stddev_samp(x)')} AS std, {r('min(x)')} AS min, {r('quantile_cont(x, 0.25)')} AS q1,
  {r('quantile_cont(x, 0.75)')} AS q3, {r('max(x)')} AS max,
  {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)')} AS iqr"""
        else:
            sel = f"""{r('avg(x)')} AS mean, {r('quantile_cont(x, 0.5)')} AS median, {r('stddev_samp(x)')} AS std,
  {r('min(x)')} AS min, {r('max(x)')} AS max"""
        parts.append(f"""SELECT label, '{f}' AS feature, {sel}
FROM (SELECT l_returnflag AS label, {nz(f)} AS x FROM lineitem WHERE l_returnflag IS NOT NULL) t GROUP BY label""")
    return "\nUNION ALL\n".join(parts)


ORACLE["a06_class_stats"] = _class_stats(False)
ORACLE["a07_class_summary"] = _class_stats(True)

ORACLE["a06_class_stats_wide"] = "SELECT l_returnflag AS label, " + ",\n  ".join(
    f"{r(f'avg({nz(f)})')} AS {f}_mean, {r(f'quantile_cont({nz(f)}, 0.5)')} AS {f}_median, "
    f"{r(f'stddev_samp({nz(f)})')} AS {f}_std, {r(f'min({nz(f)})')} AS {f}_min, {r(f'max({nz(f)})')} AS {f}_max"
    for f in LI_FEATURES) + "\nFROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"


def _outliers(table: str, feats: list[str]) -> str:
    parts = []
    for f in feats:
        lo, hi = "(q1 - 1.5 * (q3 - q1))", "(q3 + 1.5 * (q3 - q1))"
        parts.append(f"""SELECT '{f}' AS feature, {r('q1')} AS q1, {r('q3')} AS q3, {r(lo)} AS lower_fence, {r(hi)} AS upper_fence,
  count(*) FILTER (WHERE x < {lo} OR x > {hi}) AS outlier_count,
  round(CAST(count(*) FILTER (WHERE x < {lo} OR x > {hi}) AS DOUBLE) * 100 / count(*), 6) AS outlier_pct
FROM (SELECT {nz(f)} AS x FROM {table}) d,
     (SELECT quantile_cont({nz(f)}, 0.25) AS q1, quantile_cont({nz(f)}, 0.75) AS q3 FROM {table}) q
GROUP BY q1, q3""")
    return "\nUNION ALL\n".join(parts)


ORACLE["a08_iqr_outliers"] = _outliers("events", ["value"])
ORACLE["a08_iqr_outliers_lineitem"] = _outliers("lineitem", LI_FEATURES)

ORACLE["a09_correlation"] = "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({nz(a)}, {nz(b)})')} AS correlation FROM lineitem"
    for a in LI_FEATURES for b in LI_FEATURES) + ") t"

_PT_NUM = ["p_partkey", "p_size", "p_retailprice"]
ORACLE["a10_strong_pairs"] = "SELECT feature_a, feature_b, correlation FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({nz(a)}, {nz(b)})')} AS correlation FROM part"
    for i, a in enumerate(_PT_NUM) for j, b in enumerate(_PT_NUM) if i < j) + ") t WHERE abs(correlation) >= 0.3"

ORACLE["a11_histogram"] = f"""
WITH d AS (SELECT {nz('value')} AS x FROM events),
     mm AS (SELECT min(x) AS mn, max(x) AS mx FROM d),
     b AS (SELECT CAST(least(floor((x - mn) / (mx - mn) * 30), 29) AS INTEGER) AS bin, count(*) AS n
           FROM d, mm WHERE x IS NOT NULL GROUP BY 1),
     g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin, round(mn + g.bin * ((mx - mn) / 30), 6) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 30), 6) AS hi,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN b USING (bin), mm"""

ORACLE["a12_box_stats"] = f"""
WITH lng AS ({long_values('lineitem', LI_FEATURES, 'l_returnflag')}),
     al AS (SELECT label, feature, x FROM lng UNION ALL SELECT '*' AS label, feature, x FROM lng),
     q AS (SELECT label, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
                  quantile_cont(x, 0.75) AS q3 FROM al GROUP BY 1, 2)
SELECT q.label, q.feature, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
       round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
       count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM al JOIN q USING (label, feature)
GROUP BY q.label, q.feature, q1, med, q3"""


def _san(s: str) -> str:
    import re
    return re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower()


_IN_P = ", ".join(f"'{p}'" for p in PRIORITIES)
ORACLE["a13_crosstab"] = "SELECT o_orderstatus AS category,\n  " + ",\n  ".join(
    [f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS n_{_san(p)}" for p in PRIORITIES]
    + [f"round(CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS DOUBLE) / count(*), 6) AS share_{_san(p)}"
       for p in PRIORITIES]
    + [f"count(*) FILTER (WHERE o_orderpriority NOT IN ({_IN_P})) AS n_other",
       f"round(CAST(count(*) FILTER (WHERE o_orderpriority NOT IN ({_IN_P})) AS DOUBLE) / count(*), 6) AS share_other"]
) + "\nFROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL\nGROUP BY 1"

_TYPE_MAP = ("CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
             "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' "
             "ELSE lower(any_value(typeof({c}))) END")


def _inventory(table: str, cols: list[tuple[str, str]]) -> str:
    """cols: (name, kind) with kind in double|int|string|other."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        miss = f"({c} IS NULL OR isnan({c}))" if kind == "double" else f"({c} IS NULL)"
        ftype = {"double": "numeric", "int": "numeric", "string": "categorical"}.get(kind, "other")
        inf = f"count(*) FILTER (WHERE isinf({c}))" if kind == "double" else "CAST(0 AS BIGINT)"
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, {_TYPE_MAP.format(c=c)} AS data_type,
  '{ftype}' AS feature_type, count(*) FILTER (WHERE {miss}) AS missing_values,
  round(CAST(count(*) FILTER (WHERE {miss}) AS DOUBLE) * 100 / count(*), 6) AS missing_pct,
  count(DISTINCT CASE WHEN NOT {miss} THEN {c} END) AS unique_values, {inf} AS infinite_values,
  CAST(0 AS BIGINT) AS invalid_numeric_values,
  count(DISTINCT CASE WHEN NOT {miss} THEN {c} END) <= 1 AS constant_column
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


_PT_COLS = [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
            ("p_size", "int"), ("p_retailprice", "double")]
_LI_COLS = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "other")]
ORACLE["a14_column_inventory"] = _inventory("part", _PT_COLS)

ORACLE["a14_column_inventory_text"] = f"""
WITH {D1},
p AS (SELECT f1, {NUM_F1} AS v, f1 IS NULL OR regexp_matches(f1, '^\\s*$') AS gap FROM d1),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE gap OR isnan(v)) AS m, count(DISTINCT CASE WHEN NOT isnan(v) THEN v END) AS u,
             count(*) FILTER (WHERE isinf(v)) AS i, count(*) FILTER (WHERE NOT gap AND v IS NULL) AS x FROM p)
SELECT CAST(1 AS INTEGER) AS position, 'f1' AS column_name, 'string' AS data_type, 'numeric' AS feature_type, m AS missing_values,
       round(CAST(m AS DOUBLE) * 100 / n, 6) AS missing_pct, u AS unique_values, i AS infinite_values, x AS invalid_numeric_values,
       u <= 1 AS constant_column FROM c
UNION ALL SELECT * FROM ({_inventory('d1', [('row_id', 'int'), ('f1', 'string'), ('label', 'string')])}) t WHERE column_name <> 'f1'"""

ORACLE["a15_column_classification"] = f"""
WITH inv AS ({_inventory('lineitem', _LI_COLS)}),
rules(column_name, feature_group, leakage_classification, leakage_reason) AS (VALUES
  ('l_orderkey', 'Identifier', 'EXCLUDE_ID', 'Order identifier; carries no measurement.'),
  ('l_partkey', 'Identifier', 'EXCLUDE_ID', 'Part identifier; carries no measurement.'),
  ('l_suppkey', 'Identifier', 'EXCLUDE_ID', 'Supplier identifier; carries no measurement.'),
  ('l_linenumber', 'Identifier', 'EXCLUDE_ID', 'Line position inside an order.'),
  ('l_quantity', 'Line measures', 'SAFE_PRE_LABEL', 'Known when the line is entered.'),
  ('l_extendedprice', 'Line measures', 'SAFE_PRE_LABEL', 'Known when the line is entered.'),
  ('l_discount', 'Line measures', 'SAFE_PRE_LABEL', 'Known when the line is entered.'),
  ('l_tax', 'Line measures', 'SAFE_PRE_LABEL', 'Known when the line is entered.'),
  ('l_returnflag', 'Target', 'LEAKAGE', 'Target label column.'),
  ('l_linestatus', 'Status', 'LEAKAGE', 'Set after the outcome is known.'),
  ('l_shipdate', 'Dates', 'UNKNOWN', 'Date column; timing relative to the label is unknown.'))
SELECT inv.column_name, data_type, feature_type,
       coalesce(feature_group, 'Unclassified') AS feature_group,
       coalesce(leakage_classification, 'UNKNOWN') AS leakage_classification,
       coalesce(leakage_reason, 'No rule for this column.') AS leakage_reason,
       coalesce(starts_with(leakage_classification, 'SAFE'), false) AND feature_type = 'numeric'
         AND NOT constant_column AS usable
FROM inv LEFT JOIN rules USING (column_name)"""

ORACLE["a16_value_determinism"] = f"""
WITH {D2},
pv AS (SELECT l_quantity, count(DISTINCT cls) AS k FROM d2
       WHERE cls IS NOT NULL AND l_quantity IS NOT NULL AND NOT isnan(l_quantity) GROUP BY 1)
SELECT count(*) AS n_values, count(*) FILTER (WHERE k = 1) AS n_single_class,
       count(*) FILTER (WHERE k > 1) AS n_multi_class, CAST(max(k) AS BIGINT) AS max_classes FROM pv"""


def _profile_metrics(table: str, cols: list[tuple[str, str]], target: str, spec_cols: list[tuple[str, str]]) -> str:
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if k == 'double' else ''})"
                      for c, k in spec_cols)
    return f"""(SELECT count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns,
   count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}) x) AS n_duplicates,
   CAST({miss} AS BIGINT) AS n_missing, count(DISTINCT {target}) AS n_classes FROM {table})"""


ORACLE["a19_dataset_compare"] = f"""
WITH o AS {_profile_metrics('orders', [(c, '') for c in range(6)], 'o_orderpriority', [('o_totalprice', 'double'), ('o_orderpriority', 'string')])},
     p AS {_profile_metrics('part', _PT_COLS, 'p_brand', [('p_size', 'int'), ('p_retailprice', 'double'), ('p_brand', 'string')])}
SELECT 'n_rows' AS metric, o.n_rows AS orders, p.n_rows AS part FROM o, p
UNION ALL SELECT 'n_columns', o.n_columns, p.n_columns FROM o, p
UNION ALL SELECT 'n_duplicates', CAST(o.n_duplicates AS BIGINT), CAST(p.n_duplicates AS BIGINT) FROM o, p
UNION ALL SELECT 'n_missing', o.n_missing, p.n_missing FROM o, p
UNION ALL SELECT 'n_classes', o.n_classes, p.n_classes FROM o, p"""


# ---- R: relevance ------------------------------------------------------------------------

def _anova(src_cte: str, table: str, feats: list[str], label: str) -> str:
    moments = "\n  UNION ALL\n  ".join(
        f"SELECT '{f}' AS feature, label, count(x) AS n, avg(x) AS mean, var_samp(x) AS var "
        f"FROM (SELECT {label} AS label, {nz(f)} AS x FROM {table} WHERE {label} IS NOT NULL) t GROUP BY label"
        for f in feats)
    pre = f"{src_cte},\n" if src_cte else ""
    return f"""WITH {pre}m AS ({moments}),
g AS (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand
      FROM m WHERE n > 0),
a AS (SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n,
             sum(n * pow(mean - grand, 2)) AS ssb, sum(coalesce((n - 1) * var, 0)) AS ssw,
             max(mean) - min(mean) AS mean_range, avg(sqrt(var)) AS mean_std
      FROM g GROUP BY feature),
res AS (SELECT feature, k, n,
  CASE WHEN k > 1 AND n > k AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k)) END AS f_stat,
  CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) END AS eta_squared, mean_range,
  CASE WHEN mean_std > 0 THEN mean_range / mean_std END AS normalized_mean_range FROM a)"""


def _anova_select() -> str:
    return """SELECT feature, k, n, round(f_stat, 6) AS f_stat, round(eta_squared, 6) AS eta_squared,
  round(mean_range, 6) AS mean_range, round(normalized_mean_range, 6) AS normalized_mean_range FROM res"""


ORACLE["r01_anova"] = _anova("", "lineitem", LI_FEATURES, "l_returnflag") + "\n" + _anova_select()
#: with three classes (2 degrees of freedom) the survival function of F has a closed form
ORACLE["r02_anova_pvalue"] = _anova("", "lineitem", LI_FEATURES, "l_returnflag") + """
SELECT feature, round(f_stat, 6) AS f_stat, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within,
       round(pow(1 + 2 * f_stat / (n - k), -(n - k) / 2.0), 6) AS p_value FROM res"""
ORACLE["r01_anova_separable"] = _anova(D2, "d2", D2_FEATURES, "cls") + "\n" + _anova_select()
ORACLE["a20_feature_rank"] = _anova(D2, "d2", D2_FEATURES, "cls") + """
SELECT feature, round(f_stat, 6) AS f_stat,
       CAST(row_number() OVER (ORDER BY f_stat DESC NULLS LAST, feature) AS INTEGER) AS rank FROM res"""

ORACLE["r05_mutual_information"] = f"""
WITH {D2},
mm AS (SELECT {', '.join(f'min({nz(f)}) AS a_{f}, max({nz(f)}) AS b_{f}' for f in D2_FEATURES)} FROM d2),
lng AS ({' UNION ALL '.join(
    f"SELECT cls AS label, '{f}' AS feature, CASE WHEN {nz(f)} IS NULL THEN NULL "
    f"WHEN b_{f} > a_{f} THEN CAST(least(floor(({nz(f)} - a_{f}) / (b_{f} - a_{f}) * 20), 19) AS INTEGER) "
    f"ELSE 0 END AS bin FROM d2, mm WHERE cls IS NOT NULL" for f in D2_FEATURES)}),
c AS (SELECT feature, bin, label, count(*) AS nxy FROM lng WHERE bin IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
             sum(nxy) OVER (PARTITION BY feature, label) AS ny FROM c)
SELECT feature, round(sum(CAST(nxy AS DOUBLE) / n * ln(CAST(nxy AS DOUBLE) * n / (CAST(nx AS DOUBLE) * ny))), 6) AS mi
FROM t GROUP BY feature"""



def _neighbour(ctes: str, table: str, feats: list[str], label: str, k: int = 3) -> str:
    """Row-level nearest-neighbour estimate: the k-th of the 2k class neighbours in order, rows nearer than it by counts
    up to both ends, and psi of an integer as a harmonic number (its constant cancels)."""
    near = ", ".join([f"x - lag(x, {j}) OVER w" for j in range(1, k + 1)] + [f"lead(x, {j}) OVER w - x" for j in range(1, k + 1)])
    return f"""WITH {ctes}
lng0 AS ({long_values(table, feats, label)}),
lng AS (SELECT feature, label, x, count(*) OVER (PARTITION BY feature, label) AS nc FROM lng0 QUALIFY nc > 1),
nb AS (SELECT feature, label, x, nc, list_sort([{near}], 'ASC', 'NULLS LAST')[least({k}, nc - 1)] AS r
       FROM lng WINDOW w AS (PARTITION BY feature, label ORDER BY x)),
pts AS (SELECT feature, label, x, nc, r, count(*) AS c FROM nb GROUP BY ALL),
vals AS (SELECT feature, x, sum(count(*)) OVER (PARTITION BY feature ORDER BY x) AS upto, count(*) AS here FROM lng GROUP BY 1, 2),
hi AS (SELECT p.*, v.upto AS u FROM pts p ASOF JOIN vals v ON p.feature = v.feature AND p.x + CASE WHEN r > 0 THEN r * (1 - 1e-9) ELSE 0 END >= v.x),
lo AS (SELECT h.*, v.upto - v.here AS b FROM hi h ASOF JOIN vals v ON h.feature = v.feature AND h.x - CASE WHEN r > 0 THEN r * (1 - 1e-9) ELSE 0 END <= v.x),
harm AS (SELECT n, coalesce(sum(1.0 / (n - 1)) FILTER (WHERE n > 1) OVER (ORDER BY n), 0) AS h
         FROM range(1, (SELECT count(*) + 2 FROM lng0)) t(n)),
t AS (SELECT lo.feature, c, nc, u - b AS m FROM lo)
SELECT t.feature, CAST(sum(c) AS BIGINT) AS n,
       round(greatest(0.0, (SELECT h FROM harm WHERE n = CAST(sum(c) AS BIGINT))
                           + sum(c * (hk.h - hc.h - hm.h)) / sum(c)), 6) AS mi
FROM t JOIN harm hk ON hk.n = least({k}, nc - 1) JOIN harm hc ON hc.n = nc JOIN harm hm ON hm.n = m GROUP BY t.feature"""


ORACLE["r05_neighbour_information"] = _neighbour(
    "li_copy AS (SELECT *, l_quantity / 100 AS quantity_copy FROM lineitem),", "li_copy", [*LI_FEATURES, "quantity_copy"], "l_returnflag")
ORACLE["r05_neighbour_information_separable"] = _neighbour(D2 + ",", "d2", D2_FEATURES, "cls")

ORACLE["r06_categorical_relevance"] = """
WITH c AS (SELECT 'o_orderstatus' AS category_col, CAST(o_orderstatus AS VARCHAR) AS category,
                  o_orderpriority AS label, count(*) AS n
           FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY category_col) AS nn, sum(n) OVER (PARTITION BY category_col, category) AS ni,
             sum(n) OVER (PARTITION BY category_col, label) AS nj FROM c),
cells AS (SELECT category_col, any_value(nn) AS nn, count(DISTINCT category) AS r, count(DISTINCT label) AS k,
                 sum(CAST(n AS DOUBLE) * n * nn / (CAST(ni AS DOUBLE) * nj)) - any_value(nn) AS chi2,
                 sum(CAST(n AS DOUBLE) / nn * ln(CAST(n AS DOUBLE) * nn / (CAST(ni AS DOUBLE) * nj))) AS mi,
                 max(CAST(n AS DOUBLE) / ni) AS max_purity, CAST(max(ni) AS BIGINT) AS largest_category_n
          FROM t GROUP BY category_col),
ent AS (SELECT category_col, -sum(CAST(nj AS DOUBLE) / nn * ln(CAST(nj AS DOUBLE) / nn)) AS h
        FROM (SELECT category_col, label, sum(n) AS nj, sum(sum(n)) OVER (PARTITION BY category_col) AS nn
              FROM c GROUP BY 1, 2) e GROUP BY 1),
v AS (SELECT cells.*, h, greatest(0.0, chi2 / nn - (k - 1) * (r - 1) / (nn - 1)) AS phi2c,
             least(k - pow(k - 1, 2) / (nn - 1) - 1, r - pow(r - 1, 2) / (nn - 1) - 1) AS denom
      FROM cells JOIN ent USING (category_col))
SELECT category_col, round(chi2, 6) AS chi2, CAST((r - 1) * (k - 1) AS BIGINT) AS dof,
       round(CASE WHEN denom > 0 THEN sqrt(phi2c / denom) ELSE 0.0 END, 6) AS cramers_v,
       round(CASE WHEN h > 0 THEN mi / h ELSE 0.0 END, 6) AS nmi_target,
       round(max_purity, 6) AS max_purity, largest_category_n
FROM v"""

ORACLE["r10_class_ranges"] = f"""
WITH {D2},
lng AS ({long_values('d2', D2_FEATURES, 'cls')}),
b AS (SELECT feature, label, min(x) AS mn, max(x) AS mx, count(*) AS n FROM lng GROUP BY 1, 2),
ins AS (SELECT b.feature, b.label, count(l.x) AS inside FROM b LEFT JOIN lng l
        ON l.feature = b.feature AND l.label <> b.label AND l.x >= b.mn AND l.x <= b.mx GROUP BY 1, 2)
SELECT b.feature, b.label, round(mn, 6) AS min, round(mx, 6) AS max, n,
       CAST(inside AS BIGINT) AS n_other_inside, inside <= 0 AS exclusive
FROM b JOIN ins USING (feature, label)"""

ORACLE["r12_range_overlaps"] = f"""
WITH lng AS ({long_values('events', ['value'], 'event_type')}),
b AS (SELECT feature, label, min(x) AS mn, max(x) AS mx FROM lng GROUP BY 1, 2),
j AS (SELECT a.label AS class_a, c.label AS class_b, a.feature, a.mn AS a_min, a.mx AS a_max, c.mn AS b_min, c.mx AS b_max,
             a.mn <= c.mx AND c.mn <= a.mx AS overlap
      FROM b a JOIN b c ON a.feature = c.feature AND a.label < c.label)
SELECT class_a, class_b, feature, overlap,
       round(CASE WHEN overlap THEN greatest(a_min, b_min) END, 6) AS lo,
       round(CASE WHEN overlap THEN least(a_max, b_max) END, 6) AS hi,
       round(CASE WHEN overlap THEN least(a_max, b_max) - greatest(a_min, b_min) ELSE 0.0 END, 6) AS width,
       round(CASE WHEN least(a_max - a_min, b_max - b_min) > 0
                  THEN (CASE WHEN overlap THEN least(a_max, b_max) - greatest(a_min, b_min) ELSE 0.0 END)
                       / least(a_max - a_min, b_max - b_min) * 100.0 ELSE 0.0 END, 6) AS pct_of_smaller
FROM j"""

ORACLE["r13_granularity"] = f"""
WITH lng AS ({long_values('lineitem', LI_FEATURES, 'l_returnflag')}),
pv AS (SELECT feature, x, count(*) AS c FROM lng GROUP BY 1, 2),
a AS (SELECT feature, count(*) AS n_unique, CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (WHERE c > 1) AS n_repeated_values,
             min(x) AS mn, max(x) AS mx,
             CAST(max(greatest(0, length(regexp_extract(CAST(x AS VARCHAR), '\\.([0-9]*?)0*(e|$)', 1))
                          - coalesce(TRY_CAST(regexp_extract(CAST(x AS VARCHAR), 'e([-+]?[0-9]+)$', 1) AS INTEGER), 0))) AS INTEGER) AS max_decimals,
             bool_and(x = floor(x)) AS integer_like
      FROM pv GROUP BY 1),
pc AS (SELECT feature, label, count(DISTINCT x) AS d FROM lng GROUP BY 1, 2),
b AS (SELECT feature, min(d) AS min_distinct, max(d) AS max_distinct, avg(d) AS mean_distinct,
             '{{' || string_agg('"' || CAST(label AS VARCHAR) || '": ' || CAST(d AS VARCHAR), ', '
                               ORDER BY CAST(label AS VARCHAR)) || '}}' AS distinct_by_class
      FROM pc GROUP BY 1)
SELECT feature, n_unique, n - n_unique AS n_repeated_rows, n_repeated_values,
       round(CAST(n - n_unique AS DOUBLE) * 100 / n, 6) AS repeated_pct, round(mn, 6) AS min, round(mx, 6) AS max,
       min_distinct, max_distinct, round(mean_distinct, 6) AS mean_distinct, distinct_by_class, max_decimals, integer_like,
       CASE WHEN integer_like THEN 'discretized/integer-valued'
            WHEN n_unique < n * 0.05 THEN 'discretized (few distinct values)'
            WHEN max_decimals <= 2 THEN 'continuous-looking but rounded to <=2 decimals'
            ELSE 'continuous' END AS assessment
FROM a JOIN b USING (feature)"""

ORACLE["r14_scaled_copy"] = f"""
WITH {LI_RID},
d AS (SELECT l_quantity AS a, l_quantity * 100 + CASE WHEN substr(md5(rid), 1, 2) = '00' THEN 1.0 ELSE 0.0 END AS b FROM li_rid)
SELECT round(max(abs(a - b / 100.0)), 6) AS max_abs_diff, round(avg(abs(a - b / 100.0)), 6) AS mean_abs_diff,
       count(*) FILTER (WHERE abs(a - b / 100.0) > 1e-12) AS n_mismatch,
       coalesce(bool_and(abs(a - b / 100.0) <= 1e-12), true) AS all_match
FROM d"""

ORACLE["r15_label_quality"] = f"""
WITH {D1}
SELECT count(DISTINCT label) AS n_labels,
       count(*) FILTER (WHERE label <> trim(label) AND trim(label) <> '') AS n_outer_whitespace_rows,
       (SELECT count(*) FROM (SELECT lower(trim(label)) AS k FROM d1 WHERE label IS NOT NULL AND trim(label) <> ''
                              GROUP BY 1 HAVING count(DISTINCT label) > 1) v) AS n_case_variant_groups,
       count(*) FILTER (WHERE label IS NULL OR trim(label) = '') AS n_blank_labels,
       count(*) FILTER (WHERE label IN ('5-LWO')) AS n_misspelled_rows,
       count(*) FILTER (WHERE label IN ('5-LWO')) > 0 AS has_known_misspelling
FROM d1"""


# ---- Q: contract ---------------------------------------------------------------------------

_PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

ORACLE["q01_schema_contract"] = """
WITH actual AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS actual_column
                FROM (DESCRIBE SELECT * FROM part)),
expected(position, expected_column) AS (VALUES """ + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(_PART_COLUMNS)) + """)
SELECT CAST(coalesce(e.position, a.position) AS INTEGER) AS position, expected_column, actual_column,
       coalesce(expected_column = actual_column, false) AS matches
FROM expected e FULL OUTER JOIN actual a ON e.position = a.position"""

ORACLE["q02_required_columns"] = """
WITH req(column_name) AS (VALUES ('p_partkey'), ('p_size'), ('p_retailprice'), ('p_brand'), ('p_color'))
SELECT column_name, column_name IN (SELECT column_name FROM (DESCRIBE SELECT * FROM part)) AS present FROM req"""

ORACLE["q03_non_empty"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, NOT EXISTS (SELECT 1 FROM {t}) AS is_empty" for t in _TABLES)

ORACLE["q04_type_kinds"] = """
WITH want(column_name, expected_kind, pos) AS (VALUES ('p_size', 'numeric', 0), ('p_retailprice', 'numeric', 1), ('p_brand', 'string', 2)),
d AS (SELECT column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT')
                              OR column_type LIKE 'DECIMAL%' THEN 'numeric'
                              WHEN column_type = 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS kind
      FROM (DESCRIBE SELECT * FROM part))
SELECT w.column_name, kind, expected_kind, CASE WHEN kind = expected_kind THEN 'OK' ELSE 'INVALID' END AS status
FROM want w JOIN d USING (column_name)"""

ORACLE["q05_table_profile"] = """
SELECT 'lineitem' AS table_name, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem) x) AS n_duplicates,
       CAST(""" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))" for c in LI_FEATURES) + """
            + count(*) FILTER (WHERE l_returnflag IS NULL) AS BIGINT) AS n_missing,
       count(DISTINCT l_returnflag) AS n_classes
FROM lineitem"""

ORACLE["q06_missing_counts"] = f"""
WITH {D1},
c AS (SELECT count(*) FILTER (WHERE row_id IS NULL) AS n0, CAST(0 AS BIGINT) AS b0,
             count(*) FILTER (WHERE f1 IS NULL) AS n1, count(*) FILTER (WHERE regexp_matches(f1, '^\\s*$')) AS b1,
             count(*) FILTER (WHERE label IS NULL) AS n2, count(*) FILTER (WHERE regexp_matches(label, '^\\s*$')) AS b2
      FROM d1)
SELECT 'row_id' AS column_name, n0 AS n_null, b0 AS n_blank, n0 + b0 AS n_missing_like FROM c
UNION ALL SELECT 'f1', n1, b1, n1 + b1 FROM c
UNION ALL SELECT 'label', n2, b2, n2 + b2 FROM c
UNION ALL SELECT '_total', n0 + n1 + n2, b0 + b1 + b2, n0 + n1 + n2 + b0 + b1 + b2 FROM c"""

ORACLE["q09_numeric_validity"] = f"""
WITH {D1},
p AS (SELECT f1, {NUM_F1} AS v FROM d1),
bad AS (SELECT DISTINCT f1 FROM p WHERE f1 IS NOT NULL AND NOT regexp_matches(f1, '^\\s*$') AND v IS NULL),
ex AS (SELECT coalesce(string_agg(f1, ',' ORDER BY f1), '') AS examples FROM (SELECT f1 FROM bad ORDER BY f1 LIMIT 5) b)
SELECT 'f1' AS feature, count(*) FILTER (WHERE isnan(v)) AS n_nan, count(*) FILTER (WHERE isinf(v)) AS n_inf,
       count(*) FILTER (WHERE f1 IS NOT NULL AND NOT regexp_matches(f1, '^\\s*$') AND v IS NULL) AS n_invalid,
       any_value(examples) AS examples
FROM p, ex"""

ORACLE["q10_finite_gate"] = "WITH g AS (SELECT " + ", ".join(
    f"coalesce(bool_and({c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})), true) AS g_{c}" for c in LI_FEATURES
) + " FROM lineitem)\n" + "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS feature, g_{c} AS all_finite FROM g" for c in LI_FEATURES]
    + ["SELECT '*', " + " AND ".join(f"g_{c}" for c in LI_FEATURES) + " FROM g"])

_D1_NUM = f"""p AS (SELECT row_id, f1, label, {NUM_F1} AS v FROM d1),
m AS (SELECT *, f1 IS NOT NULL AND (v IS NULL OR isnan(v)) AS non_numeric,
             v IS NOT NULL AND NOT isnan(v) AND v < 0.0 AS below_min,
             v IS NOT NULL AND NOT isnan(v) AND v > 500000.0 AS above_max,
             v IS NOT NULL AND NOT isnan(v) AND isinf(v) AS infinite FROM p)"""

ORACLE["q11_bounds_rules"] = f"""
WITH {D1}, {_D1_NUM}
SELECT 'f1' AS feature, 'non_numeric' AS rule, count(*) FILTER (WHERE non_numeric) AS n FROM m
UNION ALL SELECT 'f1', 'below_min', count(*) FILTER (WHERE below_min) FROM m
UNION ALL SELECT 'f1', 'above_max', count(*) FILTER (WHERE above_max) FROM m
UNION ALL SELECT 'f1', 'infinite', count(*) FILTER (WHERE infinite) FROM m"""

ORACLE["q12_duplicate_count"] = """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM part GROUP BY p_size, p_type, p_brand) g"""

ORACLE["q13_duplicate_listing"] = """
SELECT p_partkey AS key, p_size, p_type, p_brand, group_size
FROM (SELECT p_partkey, p_size, p_type, p_brand,
             count(*) OVER (PARTITION BY p_size, p_type, p_brand) AS group_size FROM part) t
WHERE group_size > 1"""

ORACLE["q14_checklist"] = """
WITH a AS (SELECT count(*) AS n,
                  count(*) FILTER (WHERE """ + " OR ".join(f"{c} IS NULL OR isnan({c})" for c in LI_FEATURES) + """ OR l_returnflag IS NULL) AS miss,
                  coalesce(bool_and(""" + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in LI_FEATURES) + """), true) AS fin,
                  count(DISTINCT l_returnflag) AS k,
                  count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R') OR l_returnflag IS NULL) AS unexpected
           FROM lineitem),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem) x) AS dups FROM lineitem),
c AS (SELECT 'has_rows' AS check_name, n > 0 AS passed FROM a
      UNION ALL SELECT 'schema_matches', true FROM a
      UNION ALL SELECT 'no_missing_in_used_columns', miss = 0 FROM a
      UNION ALL SELECT 'features_finite', fin FROM a
      UNION ALL SELECT 'class_count_matches', k = 3 FROM a
      UNION ALL SELECT 'labels_in_domain', unexpected = 0 FROM a
      UNION ALL SELECT 'no_duplicate_rows', dups = 0 FROM d)
SELECT * FROM c UNION ALL SELECT 'status', bool_and(passed) FROM c"""


def split_cte(src: str, key: str, label: str, seed: str = "42", frac: float = 0.2) -> str:
    """Exact stratified split: largest-remainder quotas, then the lowest digests train."""
    return f"""sc AS (SELECT {label} AS label, count(*) AS n_c FROM {src} WHERE {label} IS NOT NULL GROUP BY 1),
sq1 AS (SELECT label, n_c, sum(n_c) OVER () AS n FROM sc),
sq2 AS (SELECT label, n_c, n, n - CAST(ceil(CAST({frac} AS DOUBLE) * n) AS BIGINT) AS n_train FROM sq1),
sq3 AS (SELECT label, (n_c * n_train) // n AS base, (n_c * n_train) % n AS rem, n_train FROM sq2),
sq4 AS (SELECT label, base, row_number() OVER (ORDER BY rem DESC, CAST(label AS VARCHAR)) AS rr,
               n_train - sum(base) OVER () AS lft FROM sq3),
quota AS (SELECT label, base + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS quota FROM sq4),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY {label}
                  ORDER BY md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR))), {key}) AS rk
           FROM {src} s WHERE {label} IS NOT NULL),
split AS (SELECT ranked.*, CASE WHEN rk <= quota THEN 'train' ELSE 'test' END AS split
          FROM ranked JOIN quota ON ranked.{label} = quota.label)"""


LI_SPLIT = LI_RID + ",\n" + split_cte("li_rid", "rid", "l_returnflag")

ORACLE["q15_split_shape"] = f"""
WITH {LI_SPLIT},
c AS (SELECT split, count(*) AS actual FROM split GROUP BY 1),
t AS (SELECT sum(actual) AS n FROM c)
SELECT split, CAST(CASE WHEN split = 'test' THEN ceil(CAST(0.2 AS DOUBLE) * n) ELSE n - ceil(CAST(0.2 AS DOUBLE) * n) END AS BIGINT) AS expected,
       actual, CASE WHEN split = 'test' THEN ceil(CAST(0.2 AS DOUBLE) * n) ELSE n - ceil(CAST(0.2 AS DOUBLE) * n) END = actual AS passed
FROM c, t"""

ORACLE["q16_class_domain"] = """
WITH seen AS (SELECT DISTINCT l_returnflag AS label FROM lineitem WHERE l_returnflag IS NOT NULL),
exp(label) AS (VALUES ('A'), ('N'), ('R'))
SELECT coalesce(s.label, e.label) AS label, s.label IS NOT NULL AS in_data, e.label IS NOT NULL AS in_expected,
       s.label IS NOT NULL AND e.label IS NOT NULL AS matches
FROM seen s FULL OUTER JOIN exp e ON s.label = e.label"""

ORACLE["q17_encoded_range"] = f"""
WITH {LI_SPLIT},
dim AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT l_returnflag AS label FROM split WHERE l_returnflag IS NOT NULL) d),
e AS (SELECT split, code FROM split JOIN dim ON split.l_returnflag = dim.label)
SELECT split, min(code) AS min_code, max(code) AS max_code, count(DISTINCT code) AS n_codes,
       min(code) = 0 AND max(code) = count(DISTINCT code) - 1 AS passed
FROM e GROUP BY split"""

ORACLE["q18_row_validation"] = f"""
WITH {D1},
p AS (SELECT row_id, {NUM_F1} AS v FROM d1),
m AS (SELECT row_id,
        CASE WHEN v IS NULL THEN 'f1 must be numeric.' WHEN isnan(v) THEN 'f1 cannot be NaN.'
             WHEN isinf(v) THEN 'f1 cannot be infinite.' END AS e1,
        CASE WHEN v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v < 0.0
             THEN 'f1 must be greater than or equal to 0.' END AS e2,
        CASE WHEN v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v > 500000.0
             THEN 'f1 must be less than or equal to 500000.' END AS e3
      FROM p)
SELECT row_id, e1 IS NULL AND e2 IS NULL AND e3 IS NULL AS is_valid,
       CAST((e1 IS NOT NULL)::INTEGER + (e2 IS NOT NULL)::INTEGER + (e3 IS NOT NULL)::INTEGER AS INTEGER) AS n_errors,
       concat_ws('; ', e1, e2, e3) AS errors FROM m"""


# ---- C: cleaning, encoding, split --------------------------------------------------------------

ORACLE["c01_projection"] = "SELECT " + ", ".join(LI_FEATURES) + ", l_returnflag FROM lineitem"

_D1_MISSING = "(f1 IS NULL OR regexp_matches(f1, '^\\s*$') OR label IS NULL OR regexp_matches(label, '^\\s*$'))"

ORACLE["c02_blank_drop"] = f"WITH {D1} SELECT row_id, f1, label FROM d1 WHERE NOT {_D1_MISSING}"

ORACLE["c03_drop_incomplete"] = f"""
WITH {D1}
SELECT count(*) AS n_before, count(*) FILTER (WHERE {_D1_MISSING}) AS n_missing_rows,
       count(*) - count(*) FILTER (WHERE {_D1_MISSING}) AS n_after,
       CASE WHEN count(*) FILTER (WHERE {_D1_MISSING}) > 0 THEN 'drop_rows_with_missing_values'
            ELSE 'no_missing_values_found' END AS method
FROM d1"""

ORACLE["c04_drop_duplicates"] = "SELECT DISTINCT p_size, p_type, p_brand FROM part"

ORACLE["c05_bounds_drop"] = f"""
WITH {D1}, {_D1_NUM}
SELECT row_id, f1, label FROM m WHERE NOT (non_numeric OR below_min OR above_max OR infinite)"""

ORACLE["c06_label_fix"] = f"""
WITH {D1},
f AS (SELECT label, CASE WHEN label = '5-LWO' THEN '5-LOW' ELSE label END AS fixed FROM d1),
b AS (SELECT label, count(*) AS n_before FROM f GROUP BY 1),
a AS (SELECT fixed AS label, count(*) AS n_after FROM f GROUP BY 1),
ch AS (SELECT label, count(*) AS n_changed FROM f WHERE label <> fixed GROUP BY 1)
SELECT label, CAST(coalesce(n_before, 0) AS BIGINT) AS n_before, CAST(coalesce(n_after, 0) AS BIGINT) AS n_after,
       CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed
FROM b FULL OUTER JOIN a USING (label) LEFT JOIN ch USING (label) WHERE label IS NOT NULL"""

ORACLE["c07_lineage"] = f"""
WITH {D1}, {_D1_NUM},
g AS (SELECT f1, label, any_value(non_numeric OR below_min OR above_max OR infinite) AS bad, count(*) AS c
      FROM m GROUP BY f1, label),
s AS (SELECT sum(c) AS n0, coalesce(sum(c) FILTER (WHERE {_D1_MISSING}), 0) AS r1,
             count(*) FILTER (WHERE NOT {_D1_MISSING}) AS g, count(*) FILTER (WHERE NOT {_D1_MISSING} AND bad) AS r3 FROM g)
SELECT 1 AS step, 'missing_values' AS stage, CAST(n0 AS BIGINT) AS n_before, CAST(r1 AS BIGINT) AS n_removed,
       CAST(n0 - r1 AS BIGINT) AS n_after FROM s
UNION ALL SELECT 2, 'duplicates', CAST(n0 - r1 AS BIGINT), CAST(n0 - r1 - g AS BIGINT), CAST(g AS BIGINT) FROM s
UNION ALL SELECT 3, 'bounds', CAST(g AS BIGINT), CAST(r3 AS BIGINT), CAST(g - r3 AS BIGINT) FROM s"""

ORACLE["c08_label_encode"] = """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT l_returnflag AS label FROM lineitem WHERE l_returnflag IS NOT NULL) d"""

ORACLE["c08_label_encode_integer"] = """
SELECT CAST(p_size AS VARCHAR) AS label, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL) d"""

ORACLE["c09_label_decode"] = """
WITH dim AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
             FROM (SELECT DISTINCT l_returnflag AS label FROM lineitem WHERE l_returnflag IS NOT NULL) d),
e AS (SELECT l_returnflag, code FROM lineitem LEFT JOIN dim ON l_returnflag = dim.label)
SELECT e.l_returnflag AS label, e.code, d2.label AS decoded, count(*) AS n
FROM e LEFT JOIN dim d2 ON e.code = d2.code GROUP BY 1, 2, 3"""

ORACLE["c10_split"] = f"WITH {LI_SPLIT} SELECT rid, l_returnflag AS label, split FROM split"

ORACLE["c11_split_report"] = f"WITH {LI_SPLIT} SELECT split, l_returnflag AS label, count(*) AS n FROM split GROUP BY 1, 2"

LI_FOLDS = LI_SPLIT + """,
folds AS (SELECT rid, l_returnflag, CAST((row_number() OVER (ORDER BY l_returnflag,
                 md5(concat_ws('|', '42|fold', CAST(rid AS VARCHAR))), rid) - 1) % 5 AS INTEGER) AS fold
          FROM split WHERE split = 'train')"""

ORACLE["c12_folds"] = f"WITH {LI_FOLDS} SELECT rid, l_returnflag AS label, fold FROM folds"

ORACLE["c13_fold_sizes"] = f"""
WITH {LI_FOLDS}, c AS (SELECT fold, count(*) AS n FROM folds GROUP BY 1)
SELECT CAST(fold + 1 AS INTEGER) AS fold, CAST(sum(n) OVER () - n AS BIGINT) AS n_train, n AS n_validation FROM c"""

ORACLE["c14_union"] = f"""
WITH {LI_SPLIT}
SELECT l_returnflag AS label, count(*) AS n FROM (SELECT * FROM split WHERE split = 'train'
                                                  UNION ALL SELECT * FROM split WHERE split = 'test') u GROUP BY 1"""

ORACLE["c15_ablation_sets"] = f"""
WITH {D2}
SELECT 'A_All_Features' AS config, 3 AS n_features, 'l_quantity,l_discount,l_tax' AS features,
       count(*) FILTER (WHERE {nz('l_quantity')} IS NOT NULL AND {nz('l_discount')} IS NOT NULL AND {nz('l_tax')} IS NOT NULL) AS n_complete_rows FROM d2
UNION ALL SELECT 'B_No_l_quantity', 2, 'l_discount,l_tax',
       count(*) FILTER (WHERE {nz('l_discount')} IS NOT NULL AND {nz('l_tax')} IS NOT NULL) FROM d2
UNION ALL SELECT 'C_No_l_discount', 2, 'l_quantity,l_tax',
       count(*) FILTER (WHERE {nz('l_quantity')} IS NOT NULL AND {nz('l_tax')} IS NOT NULL) FROM d2
UNION ALL SELECT 'D_No_l_tax', 2, 'l_quantity,l_discount',
       count(*) FILTER (WHERE {nz('l_quantity')} IS NOT NULL AND {nz('l_discount')} IS NOT NULL) FROM d2"""

ORACLE["c16_derived_columns"] = f"""
WITH {LI_RID}
SELECT rid, round(l_discount * 100.0, 6) AS discount_pct, l_returnflag = l_linestatus AS flag_equals_status,
       round(abs(l_extendedprice * (l_tax - l_discount)), 6) AS abs_net_change,
       round(CASE WHEN l_discount <> 1 THEN l_tax / (1 - l_discount) END, 6) AS tax_to_net_ratio
FROM li_rid"""

ORACLE["a17_leakage_overlap"] = f"""
WITH {LI_SPLIT},
tr AS (SELECT l_quantity, l_discount, l_returnflag FROM split WHERE split = 'train'),
te AS (SELECT l_quantity, l_discount, l_returnflag FROM split WHERE split = 'test')
SELECT (SELECT count(*) FROM te) AS n_test,
       (SELECT count(*) FROM te) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount FROM te) x) AS dup_test_features,
       (SELECT count(*) FROM te) - (SELECT count(*) FROM (SELECT DISTINCT * FROM te) x) AS dup_test_rows,
       (SELECT count(*) FROM (SELECT l_quantity, l_discount FROM tr INTERSECT SELECT l_quantity, l_discount FROM te) x) AS feature_overlap,
       (SELECT count(*) FROM (SELECT * FROM tr INTERSECT SELECT * FROM te) x) AS row_overlap"""

ORACLE["a18_union_duplicates"] = f"""
WITH {LI_SPLIT},
u AS (SELECT l_quantity, l_discount, l_returnflag FROM split WHERE split = 'train'
      UNION ALL SELECT l_quantity, l_discount, l_returnflag FROM split WHERE split = 'test')
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u) x) AS BIGINT) AS n_duplicates FROM u"""


# ---- M: evaluation ----------------------------------------------------------------------------

_CLS = "(VALUES (0), (1), (2), (3), (4))"


def metric_ctes(pred: str, g: str = "model", p: str = "") -> str:
    """confusion grid -> per-class -> summary, over the prediction relation ``pred``."""
    return f"""{p}counts AS (SELECT {g}, label, prediction, count(*) AS n FROM {pred} GROUP BY ALL),
{p}grid AS (SELECT gg.*, l.c AS label, q.c AS prediction FROM (SELECT DISTINCT {g} FROM {pred}) gg, {_CLS} l(c), {_CLS} q(c)),
{p}conf AS (SELECT {p}grid.*, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {p}grid LEFT JOIN {p}counts USING ({g}, label, prediction)),
{p}sup AS (SELECT {g}, label AS class, sum(n) AS support FROM {p}conf GROUP BY ALL),
{p}prd AS (SELECT {g}, prediction AS class, sum(n) AS predicted FROM {p}conf GROUP BY ALL),
{p}tp AS (SELECT {g}, label AS class, n AS tp FROM {p}conf WHERE label = prediction),
{p}pc1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS "precision",
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
           FROM {p}sup JOIN {p}prd USING ({g}, class) JOIN {p}tp USING ({g}, class)),
{p}pc AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1
          FROM {p}pc1),
{p}summ AS (SELECT {g}, sum(tp) / sum(support) AS accuracy,
       sum("precision" * support) / sum(support) AS weighted_precision,
       sum(recall * support) / sum(support) AS weighted_recall,
       sum(f1 * support) / sum(support) AS weighted_f1,
       avg("precision") FILTER (WHERE support > 0 OR predicted > 0) AS macro_precision,
       avg(recall) FILTER (WHERE support > 0 OR predicted > 0) AS macro_recall,
       avg(f1) FILTER (WHERE support > 0 OR predicted > 0) AS macro_f1
  FROM {p}pc GROUP BY ALL)"""


_M = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "macro_precision", "macro_recall", "macro_f1"]
_MR = ", ".join(f"round({m}, 6) AS {m}" for m in _M)
D3M = f"{D3},\n{metric_ctes('d3')}"

ORACLE["m06_confusion"] = f"WITH {D3M} SELECT model, label, prediction, n FROM conf"
ORACLE["m07_summary_metrics"] = f"WITH {D3M} SELECT model, {_MR} FROM summ"
# straight from the rows: no grid, all rows count, macro over the values that occur on either side
ORACLE["m07_summary_unknown_labels"] = f"""WITH {D3},
u AS (SELECT model, CASE WHEN substr(md5(rid), 1, 2) = '00' THEN 9 ELSE label END AS y,
             CASE WHEN substr(md5(rid), 1, 2) IN ('00', '01') THEN 7 ELSE prediction END AS z FROM d3),
v AS (SELECT DISTINCT model, y AS c FROM u UNION SELECT DISTINCT model, z FROM u),
k AS (SELECT v.model, c, count(*) FILTER (WHERE y = c) AS s, count(*) FILTER (WHERE z = c) AS p,
             count(*) FILTER (WHERE y = c AND z = c) AS t FROM v JOIN u ON u.model = v.model GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN p > 0 THEN t / p ELSE 0.0 END AS pr, CASE WHEN s > 0 THEN t / s ELSE 0.0 END AS re FROM k),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM q)
SELECT model, round(sum(t) / sum(s), 6) AS accuracy, round(sum(pr * s) / sum(s), 6) AS weighted_precision,
       round(sum(re * s) / sum(s), 6) AS weighted_recall, round(sum(f1 * s) / sum(s), 6) AS weighted_f1,
       round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       CAST(sum(s) FILTER (WHERE c > 4) AS BIGINT) AS n_unknown_labels, CAST(sum(p) FILTER (WHERE c > 4) AS BIGINT) AS n_unknown_predictions
FROM f GROUP BY model"""

ORACLE["m10_classification_report"] = f"""WITH {D3M}
SELECT model, CAST(class AS VARCHAR) AS class, round("precision", 6) AS "precision", round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT model, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model
UNION ALL SELECT model, 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc GROUP BY model"""
ORACLE["m11_per_class"] = f"""WITH {D3M}
SELECT model, class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pc"""
ORACLE["m12_largest_confusions"] = f"""WITH {D3M}
SELECT * FROM (SELECT model, label, prediction, n,
       CAST(row_number() OVER (PARTITION BY model ORDER BY n DESC, label, prediction) AS INTEGER) AS rank
       FROM conf WHERE label <> prediction AND n > 0) t WHERE rank <= 10"""
_RANK = "CAST(row_number() OVER (ORDER BY macro_f1 DESC, weighted_f1 DESC, accuracy DESC, model) AS INTEGER)"
ORACLE["m13_model_comparison"] = f"WITH {D3M} SELECT model, {_MR}, {_RANK} AS rank FROM summ"
ORACLE["m14_best_model"] = f"""WITH {D3M}
SELECT model, {_MR},
       printf('Selected %s using Macro F1 as the primary criterion (%.4f), then Weighted F1 (%.4f), then Accuracy (%.4f).',
              model, macro_f1, weighted_f1, accuracy) AS reason
FROM (SELECT *, {_RANK} AS rk FROM summ) t WHERE rk = 1"""
ORACLE["m15_best_model_v1"] = f"""WITH {D3M},
r AS (SELECT model, round_even(accuracy, 4) AS accuracy, round_even(weighted_f1, 4) AS weighted_f1 FROM summ),
t AS (SELECT *, row_number() OVER (ORDER BY weighted_f1 DESC, accuracy DESC, model) AS rk,
             count(*) OVER (PARTITION BY weighted_f1) AS n_tied FROM r)
SELECT model, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, CAST(n_tied AS BIGINT) AS n_tied,
       CASE WHEN n_tied > 1 THEN printf('Selected %s because it achieved the highest weighted F1-score (%.4f) among tied models, with accuracy %.4f and favorable simplicity/stability.', model, weighted_f1, accuracy)
                 || CASE WHEN model = 'Random Forest' THEN ' Random Forest was preferred as the simpler and more stable baseline.' ELSE '' END
            ELSE printf('Selected %s because it achieved the highest weighted F1-score (%.4f) on the held-out test set.', model, weighted_f1) END AS reason
FROM t WHERE rk = 1"""
ORACLE["m17_easiest_hardest"] = f"""WITH {D3M},
e AS (SELECT model, 'easiest' AS side, CAST(row_number() OVER (PARTITION BY model ORDER BY f1 DESC, recall DESC, "precision" DESC, class) AS INTEGER) AS rank,
             class, f1, recall, "precision" FROM pc),
h AS (SELECT model, 'hardest' AS side, CAST(row_number() OVER (PARTITION BY model ORDER BY f1, recall, "precision", class) AS INTEGER) AS rank,
             class, f1, recall, "precision" FROM pc)
SELECT model, side, rank, class, round(f1, 6) AS f1, round(recall, 6) AS recall, round("precision", 6) AS "precision"
FROM (SELECT * FROM e WHERE rank <= 3 UNION ALL SELECT * FROM h WHERE rank <= 3) u"""

D2_SPLIT = D2 + ",\n" + split_cte("d2", "rid", "cls")
_D3_OF = """SELECT '{m}' AS model, rid, cls AS label, {e} AS prediction FROM {src}"""


def _rules(src: str, extra: str = "") -> str:
    return " UNION ALL ".join([
        f"SELECT 'm_exact' AS model, rid, cls AS label, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS prediction{extra} FROM {src}",
        f"SELECT 'm_shift', rid, cls, CAST(least(floor(l_quantity / 10), 4) AS INTEGER){extra} FROM {src}",
        f"SELECT 'm_const', rid, cls, 0{extra} FROM {src}"])


ORACLE["m18_heldout_sample"] = f"""WITH {D2_SPLIT}
SELECT CAST(row_number() OVER (ORDER BY rid) AS INTEGER) AS row_number, rid, actual, predicted, actual = predicted AS correct
FROM (SELECT rid, cls AS actual, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS predicted FROM split
      WHERE split = 'test' ORDER BY rid LIMIT 5) t"""

D2_FOLDS = D2_SPLIT + """,
folds AS (SELECT *, CAST((row_number() OVER (ORDER BY cls, md5(concat_ws('|', '42|fold', CAST(rid AS VARCHAR))), rid) - 1) % 5 AS INTEGER) AS fold
          FROM split WHERE split = 'train'),
fpred AS (""" + _rules("folds", ", fold") + ")"

_CV = f"""{D2_FOLDS},
{metric_ctes('fpred', 'model, fold', 'f_')},
cvl AS (""" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM f_summ" for m in _M) + """),
cv AS (SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max
       FROM cvl GROUP BY model, metric)"""

ORACLE["m20_cv_summary"] = f"""WITH {_CV}
SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max FROM cv"""

ORACLE["m22_stability_verdict"] = f"""WITH {_CV},
tpred AS ({_rules("(SELECT * FROM split WHERE split = 'test')")}),
{metric_ctes('tpred', 'model', 't_')},
{_anova('', 'd2', D2_FEATURES, 'cls').removeprefix('WITH ')},
ev AS (SELECT (SELECT mean FROM cv WHERE model = 'm_exact' AND metric = 'macro_f1') AS cv_macro_f1_mean,
              (SELECT std FROM cv WHERE model = 'm_exact' AND metric = 'macro_f1') AS cv_macro_f1_std,
              (SELECT macro_f1 FROM t_summ WHERE model = 'm_exact') AS full_feature_macro_f1,
              (SELECT macro_f1 FROM t_summ WHERE model = 'm_const') AS no_key_feature_macro_f1,
              (SELECT sum(f_stat) FILTER (WHERE feature = 'l_quantity') / sum(f_stat) FROM res) AS key_feature_normalized_importance,
              (SELECT min(f1) FROM t_pc WHERE model = 'm_exact') AS minimum_class_f1)
SELECT CASE WHEN cv_macro_f1_mean >= 0.98 AND full_feature_macro_f1 - no_key_feature_macro_f1 >= 0.2
                 AND key_feature_normalized_importance >= 0.8 THEN 'B. Stable but heavily dependent on l_quantity'
            WHEN cv_macro_f1_std > 0.03 THEN 'C. Highly sensitive to the train/test split'
            WHEN cv_macro_f1_mean >= 0.99 AND minimum_class_f1 >= 0.95 THEN 'A. Stable and robust'
            ELSE 'E. Other' END AS category,
       round(cv_macro_f1_mean, 6) AS cv_macro_f1_mean, round(cv_macro_f1_std, 6) AS cv_macro_f1_std,
       round(full_feature_macro_f1, 6) AS full_feature_macro_f1, round(no_key_feature_macro_f1, 6) AS no_key_feature_macro_f1,
       round(full_feature_macro_f1 - no_key_feature_macro_f1, 6) AS macro_f1_drop_without_key_feature,
       round(key_feature_normalized_importance, 6) AS key_feature_normalized_importance,
       round(minimum_class_f1, 6) AS minimum_class_f1
FROM ev"""

_PROBS = f"""{D2},
raw AS (SELECT rid, c, exp(-pow((l_quantity - (10 * c + 5.5)) / 5.0, 2)) AS e FROM d2, {_CLS} k(c)),
pr AS (SELECT rid, c, e / sum(e) OVER (PARTITION BY rid) AS p FROM raw)"""

ORACLE["m23_confidence"] = f"""WITH {_PROBS}
SELECT rid AS row_id, CAST(arg_max(c, p) AS INTEGER) AS predicted, round(max(p), 6) AS confidence FROM pr GROUP BY rid"""

ORACLE["m24_probability_table"] = f"""WITH {_PROBS}
SELECT rid AS row_id, CAST(c AS VARCHAR) AS class, round(p, 6) AS probability, round(p * 100.0, 6) AS percent,
       CAST(row_number() OVER (PARTITION BY rid ORDER BY p DESC, CAST(c AS VARCHAR)) AS INTEGER) AS rank FROM pr"""

ORACLE["m28_contribution_ranking"] = f"""WITH {D2},
mu AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM d2),
c AS (SELECT rid, 'l_quantity' AS feature, 0.1 * (l_quantity - mq) AS v FROM d2, mu
      UNION ALL SELECT rid, 'l_discount', -20.0 * (l_discount - md) FROM d2, mu
      UNION ALL SELECT rid, 'l_tax', 25.0 * (l_tax - mt) FROM d2, mu),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(v) DESC, feature) AS rk,
             max(abs(v)) OVER (PARTITION BY rid) AS mx FROM c)
SELECT rid AS row_id, feature, round(v, 6) AS contribution, round(abs(v), 6) AS abs_contribution, CAST(rk AS INTEGER) AS rank,
       round(CASE WHEN mx > 0 THEN abs(v) / mx ELSE 0.0 END, 6) AS bar FROM r"""


# ---- S: sources and sinks ----------------------------------------------------------------------

ORACLE["s01_scan"] = "SELECT 'part' AS table_name, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM part"
ORACLE["s01_csv_scan"] = """SELECT count(*) AS n_rows, CAST(sum(p_size) AS BIGINT) AS sum_size,
       count(DISTINCT p_brand) AS n_brands, round(sum(p_retailprice), 6) AS sum_price FROM part"""
ORACLE["s02_dimension_scan"] = """SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""
ORACLE["s03_preview"] = """SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice
FROM part ORDER BY p_partkey LIMIT 5"""


def _canon(cols: list[tuple[str, str]]) -> str:
    texts = [f"CASE WHEN isnan({c}) THEN 'NaN' ELSE CAST(TRY_CAST({c} AS DECIMAL(38,9)) AS VARCHAR) END" if k == "double"
             else f"CAST({c} AS VARCHAR)" for c, k in cols]
    parts = [f"coalesce('v' || length({t}) || ':' || ({t}), 'n')" for t in texts]
    return "CAST('0x' || substr(md5(" + " || ".join(parts) + "), 1, 15) AS BIGINT)"


def _fp(name: str, rel: str, cols: list[tuple[str, str]]) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, sum(CAST({_canon(cols)} AS HUGEINT)) AS digest FROM {rel}"


_REG = [("r_regionkey", "int"), ("r_name", "string")]
_NAT = [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]
_SUP = [("s_suppkey", "int"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]
_CUS = [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
_PTC = [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
        ("p_retailprice", "double")]

ORACLE["s06_change_audit"] = f"""
WITH part2 AS (SELECT p_partkey, p_name, p_brand, p_type, p_size,
                      CASE WHEN p_partkey % 100 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part),
b AS ({_fp('region', 'region', _REG)} UNION ALL {_fp('nation', 'nation', _NAT)} UNION ALL {_fp('part', 'part', _PTC)}
      UNION ALL {_fp('supplier', 'supplier', _SUP)}),
a AS ({_fp('region', 'region', _REG)} UNION ALL {_fp('nation', 'nation', _NAT)} UNION ALL {_fp('part', 'part2', _PTC)}
      UNION ALL {_fp('customer', 'customer', _CUS)})
SELECT coalesce(b.table_name, a.table_name) AS table_name,
       CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'removed'
            WHEN b.digest = a.digest AND b.n_rows = a.n_rows THEN 'same' ELSE 'changed' END AS status,
       CAST(coalesce(b.n_rows, 0) AS BIGINT) AS n_rows_before, CAST(coalesce(a.n_rows, 0) AS BIGINT) AS n_rows_after
FROM b FULL OUTER JOIN a ON b.table_name = a.table_name"""

ORACLE["s07_split_sink"] = ORACLE["c08_label_encode"]
ORACLE["s08_split_reload"] = f"WITH {LI_SPLIT} SELECT l_returnflag AS label, count(*) AS n FROM split WHERE split = 'test' GROUP BY 1"
ORACLE["s09_report_sink"] = ORACLE["a05_feature_summary"]
ORACLE["s10_json_entries"] = """SELECT e.event_id, j.key AS entry, CAST(j.value AS BIGINT) AS value
FROM events e, json_each(e.props) j"""

ORACLE["a04_describe_distributed"] = ORACLE["a04_describe"]
ORACLE["a05_feature_summary_distributed"] = ORACLE["a05_feature_summary"]
ORACLE["a07_class_summary_distributed"] = ORACLE["a07_class_summary"]
ORACLE["a08_iqr_outliers_distributed"] = ORACLE["a08_iqr_outliers_lineitem"]
ORACLE["a12_box_stats_distributed"] = ORACLE["a12_box_stats"]

# ---- fitted operators: exact counts ---------------------------------------------------------
_MODELS = ["Random Forest", "LightGBM-like", "XGBoost-like", "CatBoost-like"]
_PER_MODEL = "(VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") m(model)"
_TEST = f"{D2_SPLIT},\nte AS (SELECT * FROM split WHERE split = 'test'),\nnt AS (SELECT count(*) AS n FROM te)"
ORACLE["m01_m02_scored_rows"] = f"""WITH {_TEST}
SELECT model, n AS n_rows, n AS n_ok, true AS loss_falls FROM {_PER_MODEL}, nt"""
ORACLE["m03_best_model_apart"] = f"WITH {_TEST} SELECT n AS n_rows, n AS n_same FROM nt"
ORACLE["m04_artifact_contract"] = f"""WITH {_TEST}
SELECT model, contract, contract = 'own' AS passed, CASE WHEN contract = 'own' THEN n ELSE 0 END AS n_scored
FROM {_PER_MODEL}, (VALUES ('own'), ('feature_order'), ('encoder'), ('kind')) c(contract), nt"""
ORACLE["m05_decoded_rows"] = f"WITH {_TEST} SELECT n AS n_rows, (SELECT count(DISTINCT rid) FROM te) AS n_ids, n AS n_decoded FROM nt"
ORACLE["m16_importance_check"] = f"""SELECT model, CAST(3 AS BIGINT) AS n_features, true AS sums_to_one, 'l_quantity' AS top_feature
FROM {_PER_MODEL}"""
ORACLE["m19_fold_rows"] = f"WITH {D2_FOLDS} SELECT fold, count(*) AS n_rows, true AS accurate FROM folds GROUP BY fold"
ORACLE["m21_ablation_rows"] = f"""WITH {_TEST}
SELECT config, n AS n_rows, config <> 'B_No_l_quantity' AS accurate
FROM (VALUES ('A_All_Features'), ('B_No_l_quantity'), ('C_No_l_discount'), ('D_No_l_tax')) c(config), nt"""
ORACLE["m25_ovr_check"] = f"WITH {_TEST} SELECT n AS n_rows, n AS n_sum_one, n AS n_argmax FROM nt"
_VALIDATED = f"""WITH {_TEST},
v AS (SELECT substr(md5(rid), 1, 2) NOT IN ('00', '01', '02', '03', '04') AND l_quantity BETWEEN 1 AND 50 AS is_valid FROM te)
SELECT is_valid, count(*) AS n_rows, count(*) FILTER (is_valid) AS n_scored, count(*) FILTER (NOT is_valid) AS n_messages
FROM v GROUP BY is_valid"""
ORACLE["m26_validated_counts"] = _VALIDATED
ORACLE["m30_streamed_counts"] = _VALIDATED
ORACLE["m27_attribution_check"] = f"""WITH {_TEST}
SELECT model, n AS n_rows, n AS n_finite, n AS n_additive FROM (VALUES ('CatBoost-like'), ('Spark forest')) m(model), nt"""
#: golden quantities and classes, as written down for the query
_GOLDEN = ", ".join(f"({q}, {c})" for c in range(5) for q in (10 * c + 3, 10 * c + 5, 10 * c + 7, 10 * c + 9))
ORACLE["m29_golden_cases"] = f"""WITH {_TEST},
cases AS (SELECT CAST(g.c AS VARCHAR) AS expected FROM te JOIN (VALUES {_GOLDEN}) g(q, c) ON te.l_quantity = g.q)
SELECT expected, count(*) AS n_cases, count(*) AS n_pass, CAST(1 AS DOUBLE) AS pass_rate FROM cases GROUP BY expected
UNION ALL SELECT '*', count(*), count(*), CAST(1 AS DOUBLE) FROM cases"""

# ---- further forms of earlier operators --------------------------------------------------------
ORACLE["a09_correlation_wide"] = ORACLE["a09_correlation"]
#: with an even number of degrees of freedom the tail is a finite sum
ORACLE["r06_chi2_pvalue"] = f"""WITH r AS ({ORACLE["r06_categorical_relevance"]}),
c AS (SELECT category_col, sum(CAST(n AS DOUBLE) * n * nn / (CAST(ni AS DOUBLE) * nj)) - any_value(nn) AS chi2 FROM (
  SELECT *, sum(n) OVER () AS nn, sum(n) OVER (PARTITION BY category) AS ni, sum(n) OVER (PARTITION BY label) AS nj FROM (
    SELECT 'o_orderstatus' AS category_col, o_orderstatus AS category, o_orderpriority AS label, count(*) AS n
    FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL) x) y GROUP BY 1)
SELECT category_col, round(c.chi2, 6) AS chi2, dof,
       round(exp(-c.chi2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: pow(c.chi2 / 2, i) / factorial(CAST(i AS INTEGER)))), 6) AS p_value
FROM r JOIN c USING (category_col)"""
_NUM_BAD = f"f1 IS NOT NULL AND ({NUM_F1} IS NULL OR isnan({NUM_F1}))"
ORACLE["q09_numeric_report"] = f"""WITH {D1},
e AS (SELECT coalesce(string_agg(f1, ',' ORDER BY f1), '') AS examples FROM (SELECT DISTINCT f1 FROM d1 WHERE {_NUM_BAD} ORDER BY f1 LIMIT 5) t),
n AS (SELECT {NUM_F1} AS f2 FROM d1)
SELECT 'f1' AS feature, 'string' AS dtype, false AS is_numeric, count(*) FILTER (WHERE f1 IS NULL) AS nan_count, CAST(0 AS BIGINT) AS infinite_count,
       count(*) FILTER (WHERE {_NUM_BAD}) AS invalid_string_count, any_value(examples) AS examples, false AS valid FROM d1, e
UNION ALL SELECT 'f2', 'double', true, count(*) FILTER (WHERE f2 IS NULL OR isnan(f2)), count(*) FILTER (WHERE isinf(f2)), 0, '',
       count(*) FILTER (WHERE f2 IS NULL OR isnan(f2) OR isinf(f2)) = 0 FROM n"""
ORACLE["q13_duplicate_positions"] = """WITH p AS (SELECT row_number() OVER () - 1 AS position, p_size, p_type, p_brand FROM part),
g AS (SELECT *, count(*) OVER (PARTITION BY p_size, p_type, p_brand) AS group_size FROM p)
SELECT CAST(position AS BIGINT) AS position, p_size, p_type, p_brand, group_size, CAST(position + 2 AS BIGINT) AS line_number FROM g WHERE group_size > 1"""
_D1_CELL = {c: f"({c} IS NULL OR regexp_matches({c}, '^\\s*$'))" for c in ("f1", "label")}
ORACLE["c07_lineage_labels"] = f"""WITH {D1},
g AS (SELECT f1, label, count(*) AS c FROM d1 GROUP BY f1, label),
s AS (SELECT CAST(sum(c) AS BIGINT) AS n0, CAST(coalesce(sum(c) FILTER (WHERE {_D1_CELL["f1"]} OR {_D1_CELL["label"]}), 0) AS BIGINT) AS r1,
             count(*) FILTER (WHERE NOT ({_D1_CELL["f1"]} OR {_D1_CELL["label"]})) AS g,
             CAST(coalesce(sum(c) FILTER (WHERE {_D1_CELL["f1"]}), 0) AS BIGINT) AS m0, CAST(coalesce(sum(c) FILTER (WHERE {_D1_CELL["label"]}), 0) AS BIGINT) AS m1,
             count(*) FILTER (WHERE NOT ({_D1_CELL["f1"]} OR {_D1_CELL["label"]}) AND label = '5-LWO') AS w FROM g)
SELECT 1 AS step, 'missing_values' AS stage, n0 AS n_before, r1 AS n_removed, n0 - r1 AS n_after, CAST(0 AS BIGINT) AS n_changed,
       CASE WHEN r1 > 0 THEN 'drop_rows_with_missing_values' ELSE 'no_missing_values_found' END AS method,
       '{{"f1": ' || m0 || ', "label": ' || m1 || '}}' AS details FROM s
UNION ALL SELECT 2, 'duplicates', n0 - r1, n0 - r1 - g, g, 0, 'keep_first_occurrence', '{{}}' FROM s
UNION ALL SELECT 3, 'label_standardization', g, 0, g, w, 'map_known_spellings', '{{"5-LWO": ' || w || '}}' FROM s"""
ORACLE["s07_split_rows"] = f"""WITH {LI_SPLIT},
dim AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_returnflag AS label FROM split) d)
SELECT split, dim.label, code, count(*) AS n, count(DISTINCT rid) AS n_ids, round(sum(l_quantity), 2) AS sum_quantity, round(sum(l_extendedprice), 2) AS sum_price
FROM split JOIN dim ON l_returnflag = dim.label GROUP BY ALL"""
ORACLE["s09_report_csv"] = ORACLE["a05_feature_summary"]
ORACLE["s10_json_leaves"] = """WITH d AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{broken' ELSE
  '{"props":' || props || ',"tags":["' || event_type || '",' || user_id || ',{"k":[' || event_id || ',true]}],"none":null,"empty":[],"void":{}}' END AS doc FROM events),
t AS (SELECT d.event_id, j.fullkey AS path, j.type, j.value, j.atom FROM (SELECT * FROM d WHERE json_valid(doc)) d, json_tree(d.doc) j)
SELECT event_id, path,
       CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
       CASE type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(value, '$') ELSE CAST(value AS VARCHAR) END AS value
FROM t WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('{}', '[]')
UNION ALL SELECT event_id, '$', 'malformed', doc FROM d WHERE NOT json_valid(doc)"""
