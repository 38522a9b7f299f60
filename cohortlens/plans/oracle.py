"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every statement starts from the driver's raw tables (views ``orders``,
``lineitem``, ``part``, ``supplier``, ``nation``, ``events``) and rebuilds
the fixture mapping in CTEs; it shares the names of columns, levels and
compared values with the Spark side, but no computation. Arithmetic is written in the same order as the Spark expressions and
doubles are rounded the same way (half-even on the scaled value), so values
hash equal.
"""

from __future__ import annotations

import numpy as np

from .queries import (
    COMPARE_GENRES,
    FREQUENT_COLUMNS,
    FREQUENT_SHARE,
    FREQUENT_VALUES,
    MIN_SEGMENT_USERS,
    PHIK_K1_BINS,
    PHIK_K1_COLUMNS,
    PHIK_K2_BINS,
    PHIK_K2_COLUMNS,
    SEGMENTS,
)


def D(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def rhe(expr: str, digits: int) -> str:
    """numpy-style rounding: round half even on the scaled double."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale})"


def ew_bin(x: str, lo: str, hi: str, n: int) -> str:
    """Same arithmetic as ``cohortlens.functions.add_equal_width_bin``."""
    x, lo, hi = D(x), D(lo), D(hi)
    step = f"(CASE WHEN {hi} > {lo} THEN ({hi} - {lo}) / CAST({n} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"
    raw = f"least(greatest(CAST(floor(({x} - {lo}) / {step}) AS BIGINT), 0), {n - 1})"
    edge = lambda i: f"({lo} + CAST({i} AS DOUBLE) * {step})"
    down = f"(CASE WHEN {raw} > 0 AND {x} < {edge(raw)} THEN {raw} - 1 ELSE {raw} END)"
    up = f"(CASE WHEN {down} < {n - 1} AND {x} >= {edge(f'({down} + 1)')} THEN {down} + 1 ELSE {down} END)"
    return f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE {up} END AS INTEGER)"


def bin_edge_sql(lo: str, hi: str, n: int, i: str) -> str:
    lo, hi = D(lo), D(hi)
    return f"({lo} + CAST({i} AS DOUBLE) * (({hi} - {lo}) / CAST({n} AS DOUBLE)))"


BASE = """
li AS (
  SELECT l_orderkey, count(*) AS n_lines, min(l_partkey) AS min_partkey, min(l_suppkey) AS min_suppkey
  FROM lineitem GROUP BY l_orderkey
),
purchases_c AS (
  SELECT o.o_custkey AS user_id,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'mobile'
         WHEN o.o_orderpriority = '2-HIGH' THEN 'desktop' ELSE 'other' END AS device_type_canonical,
    o.o_orderkey AS order_id,
    CAST(o.o_orderdate AS TIMESTAMP) AS created_dt_msk,
    CAST(o.o_orderdate AS TIMESTAMP) AS created_ts_msk,
    CASE WHEN o.o_orderstatus = 'P' THEN 'kzt' ELSE 'rub' END AS currency_code,
    CAST(o.o_totalprice AS DECIMAL(18,2)) AS revenue,
    CAST(li.n_lines AS INTEGER) AS tickets_count,
    'SVC_' || CAST(li.min_suppkey % 20 AS VARCHAR) AS service_name,
    li.min_partkey AS event_id
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey
),
event_dim AS (
  SELECT p_partkey AS event_id, p_name AS event_name_code, p_type AS event_type_main,
         CAST(p_size AS BIGINT) AS city_id FROM part
),
city_dim AS (
  SELECT s_suppkey AS city_id, s_name AS city_name, CAST(s_nationkey AS BIGINT) AS region_id FROM supplier
),
region_dim AS (SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS region_name FROM nation),
rates AS (
  SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS data, 100 AS nominal,
    CAST(15.0 + (dayofyear(o_orderdate) % 7) * 0.5 AS DECIMAL(18,6)) AS curs, 'kzt' AS cdx
  FROM orders WHERE dayofyear(o_orderdate) % 50 <> 0
),
ext_core AS (
  SELECT p.user_id, p.device_type_canonical, p.order_id, p.created_dt_msk AS order_dt,
    p.created_ts_msk AS order_ts, p.currency_code, p.revenue, p.tickets_count, p.event_id,
    e.event_name_code AS event_name, e.event_type_main, p.service_name, r.region_name, c.city_name
  FROM purchases_c p
  LEFT JOIN event_dim e ON p.event_id = e.event_id
  LEFT JOIN city_dim c ON e.city_id = c.city_id
  LEFT JOIN region_dim r ON c.region_id = r.region_id
  WHERE p.device_type_canonical IN ('mobile', 'desktop') AND e.event_type_main <> 'PROMO'
),
extract AS (
  SELECT user_id, device_type_canonical, order_id, order_dt, order_ts, currency_code, revenue,
    tickets_count,
    CAST(CASE WHEN user_id IS NOT NULL THEN datesub('day',
         lag(order_dt) OVER (PARTITION BY user_id ORDER BY order_dt, order_id), order_dt) END AS INTEGER)
      AS days_since_prev,
    event_id, event_name, event_type_main, service_name, region_name, city_name
  FROM ext_core
),
fx_core AS (
  SELECT CAST(x.user_id AS VARCHAR) AS user_id, x.device_type_canonical, x.order_id, x.order_dt,
    x.order_ts, x.currency_code, x.revenue, x.tickets_count, x.event_id, x.event_name,
    x.event_type_main, x.service_name, x.region_name, x.city_name,
    CASE WHEN x.currency_code IN ('kzt')
         THEN CAST(CAST(x.revenue * rt.curs AS DOUBLE) / rt.nominal AS DECIMAL(24,6))
         ELSE CAST(x.revenue AS DECIMAL(24,6)) END AS revenue_rub
  FROM ext_core x LEFT JOIN rates rt ON x.order_dt = rt.data AND x.currency_code = rt.cdx
),
purchases_rub AS (
  SELECT user_id, device_type_canonical, order_id, order_dt, order_ts, currency_code, revenue,
    tickets_count,
    CAST(CASE WHEN user_id IS NOT NULL THEN datesub('day',
         lag(order_dt) OVER (PARTITION BY user_id ORDER BY order_dt, order_id), order_dt) END AS INTEGER)
      AS days_since_prev,
    event_id, event_name, event_type_main, service_name, region_name, city_name, revenue_rub
  FROM fx_core
),
clean AS (
  SELECT * FROM fx_core
  WHERE CAST(revenue_rub AS DOUBLE) <= (SELECT quantile_cont(CAST(revenue_rub AS DOUBLE), 0.99) FROM fx_core)
),
clean_u AS (
  SELECT *, min(order_ts) OVER (PARTITION BY user_id) AS first_ts,
    datesub('day', order_ts, lead(order_ts) OVER (PARTITION BY user_id ORDER BY order_ts, order_id)) AS gap_d
  FROM clean WHERE user_id IS NOT NULL
),
profile AS (
  SELECT user_id, min(order_ts) AS min_order_ts, max(order_ts) AS max_order_ts,
    min(device_type_canonical) FILTER (WHERE order_ts = first_ts) AS first_order_device,
    min(region_name) FILTER (WHERE order_ts = first_ts) AS first_order_region,
    min(service_name) FILTER (WHERE order_ts = first_ts) AS first_service_name,
    min(event_type_main) FILTER (WHERE order_ts = first_ts) AS first_event_type,
    count(order_id) AS total_orders_cnt,
    CAST(sum(revenue_rub) AS DOUBLE) / count(order_id) AS avg_revenue_rub,
    CAST(sum(tickets_count) AS DOUBLE) / count(tickets_count) AS avg_cnt_per_order,
    CAST(sum(gap_d) AS DOUBLE) / nullif(count(gap_d), 0) AS date_difference_d,
    count(order_id) >= 2 AS is_two,
    count(order_id) >= 5 AS is_five
  FROM clean_u GROUP BY user_id
),
profile_f AS (
  SELECT * FROM profile
  WHERE CAST(total_orders_cnt AS DOUBLE)
        <= (SELECT quantile_cont(CAST(total_orders_cnt AS DOUBLE), 0.99) FROM profile)
),
profile_b AS (
  SELECT *,
    CASE WHEN avg_cnt_per_order >= 0 AND avg_cnt_per_order < 2 THEN '1-2'
         WHEN avg_cnt_per_order >= 2 AND avg_cnt_per_order < 3 THEN '2-3'
         WHEN avg_cnt_per_order >= 3 AND avg_cnt_per_order < 5 THEN '3-5'
         WHEN avg_cnt_per_order >= 5 AND avg_cnt_per_order < 12 THEN '5+' END AS cnt_tickets_cat,
    CASE WHEN total_orders_cnt >= 0 AND total_orders_cnt < 2 THEN '1'
         WHEN total_orders_cnt >= 2 AND total_orders_cnt < 5 THEN '2-4'
         WHEN total_orders_cnt >= 5 AND total_orders_cnt < 153 THEN '5+' END AS cnt_tickets_cat_v2,
    CAST(isodow(min_order_ts) - 1 AS INTEGER) AS day_of_week
  FROM profile_f
)
"""


def with_base(select: str) -> str:
    return "WITH " + BASE.strip() + "\n" + select.strip()


def with_base_ctes(extra_ctes: str, select: str) -> str:
    return "WITH " + BASE.strip() + ",\n" + extra_ctes.strip() + "\n" + select.strip()


# --- helpers for repeated shapes -------------------------------------------------------------

def share_sql(key: str) -> str:
    return with_base(f"""
SELECT {key}, CAST(count(user_id) AS BIGINT) AS users_cnt,
  {D('count(user_id)')} / (SELECT count(user_id) FROM profile_f) * CAST(100 AS DOUBLE) AS share
FROM profile_f WHERE {key} IS NOT NULL GROUP BY {key}
""")


def return_report(key: str, source: str = "profile_f") -> str:
    return f"""
rep AS (
  SELECT {key},
    CAST(sum(CASE WHEN is_two THEN 1 ELSE 0 END) AS BIGINT) AS returners_cnt,
    CAST(count(user_id) AS BIGINT) AS users_cnt
  FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}
),
rep2 AS (
  SELECT {key}, returners_cnt, users_cnt,
    {rhe(f"{D('returners_cnt')} / users_cnt * CAST(100 AS DOUBLE)", 2)} AS is_two_share
  FROM rep WHERE returners_cnt > 0
)"""


def return_sql(key: str) -> str:
    return with_base_ctes(return_report(key), "SELECT * FROM rep2")


def describe_sql(source: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = D(c)
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(count({x}) AS BIGINT) AS count,
  {rhe(f'avg({x})', 6)} AS mean, {rhe(f'stddev_samp({x})', 6)} AS std,
  {rhe(f'min({x})', 6)} AS min,
  {rhe(f'quantile_cont({x}, 0.25)', 6)} AS p25, {rhe(f'quantile_cont({x}, 0.5)', 6)} AS p50,
  {rhe(f'quantile_cont({x}, 0.75)', 6)} AS p75, {rhe(f'max({x})', 6)} AS max
FROM {source}""")
    return with_base("\nUNION ALL\n".join(parts))


def histogram_sql(data_cte: str, x: str, n: int, group: str | None = None,
                  shared: bool = False, density: bool = False) -> str:
    """``data_cte`` defines CTE ``hdata`` with column ``x`` (and ``grp``)."""
    keys = f"{group}, " if group else ""
    on = f"b.{group} = d.{group}" if group else "TRUE"
    if group and not shared:
        bounds = f"""
hb AS (SELECT {group}, min({D(x)}) AS lo, max({D(x)}) AS hi, count({D(x)}) AS n FROM hdata
       WHERE {x} IS NOT NULL GROUP BY {group})"""
    elif group:
        bounds = f"""
hall AS (SELECT min({D(x)}) AS lo, max({D(x)}) AS hi FROM hdata WHERE {x} IS NOT NULL),
hb AS (SELECT {group}, (SELECT lo FROM hall) AS lo, (SELECT hi FROM hall) AS hi, count({D(x)}) AS n
       FROM hdata WHERE {x} IS NOT NULL GROUP BY {group})"""
    else:
        bounds = f"""
hb AS (SELECT min({D(x)}) AS lo, max({D(x)}) AS hi, count({D(x)}) AS n FROM hdata WHERE {x} IS NOT NULL)"""
    counts = f"""
hc AS (
  SELECT {('d.' + group + ', ') if group else ''}{ew_bin('d.' + x, 'b.lo', 'b.hi', n)} AS bin, count(*) AS cnt
  FROM hdata d JOIN hb b ON {on}
  WHERE d.{x} IS NOT NULL
  GROUP BY ALL
),
hg AS (
  SELECT {keys}lo, hi, n, CAST(i AS INTEGER) AS bin,
    CASE WHEN hi = lo THEN 1 ELSE {n} END AS nbins
  FROM hb, LATERAL (SELECT unnest(range(0, CASE WHEN hb.hi = hb.lo THEN 1 ELSE {n} END)) AS i)
)"""
    lo_e = bin_edge_sql("g.lo", "g.hi", n, "g.bin")
    hi_e = f"(CASE WHEN g.bin = g.nbins - 1 THEN {D('g.hi')} ELSE {bin_edge_sql('g.lo', 'g.hi', n, 'g.bin + 1')} END)"
    cnt = "CAST(coalesce(c.cnt, 0) AS BIGINT)"
    cols = f"{('g.' + group + ', ') if group else ''}g.bin AS bin, {rhe(lo_e, 6)} AS bin_lo, {rhe(hi_e, 6)} AS bin_hi, {cnt} AS cnt"
    if density:
        width = f"(CASE WHEN {hi_e} > {lo_e} THEN {hi_e} - {lo_e} ELSE CAST(1 AS DOUBLE) END)"
        cols += f", {rhe(f'{D(cnt)} / (g.n * {width})', 12)} AS density"
    join_on = f"g.{group} = c.{group} AND g.bin = c.bin" if group else "g.bin = c.bin"
    return with_base_ctes(
        data_cte.strip() + "," + bounds + "," + counts,
        f"SELECT {cols} FROM hg g LEFT JOIN hc c ON {join_on}")


LOYALTY_SQL = """
hdata AS (
  SELECT user_id, avg_revenue_rub, g.grp FROM profile_f,
    LATERAL (SELECT unnest([
      CASE WHEN is_two THEN '2_plus' END,
      CASE WHEN NOT is_two THEN '1' END,
      CASE WHEN is_two AND NOT is_five THEN '2_4' END,
      CASE WHEN is_five THEN '5_plus' END]) AS grp) g
  WHERE g.grp IS NOT NULL
)"""


def phik_binned_sql(columns: list[str], bins: dict[str, int]) -> str:
    sel = []
    for c in columns:
        if c in bins:
            sel.append(f"CAST({ew_bin(c, f'(SELECT min({D(c)}) FROM profile_b)', f'(SELECT max({D(c)}) FROM profile_b)', bins[c])} AS VARCHAR) AS {c}")
        else:
            sel.append(f"CAST({c} AS VARCHAR) AS {c}")
    return "binned AS (SELECT " + ", ".join(sel) + " FROM profile_b)"


def contingency_cte(columns: list[str], bins: dict[str, int]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    union = "\n  UNION ALL\n".join(
        f"  SELECT '{a}' AS var_x, '{b}' AS var_y, {a} AS val_x, {b} AS val_y, CAST(count(*) AS BIGINT) AS n "
        f"FROM binned WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
        for a, b in pairs)
    return phik_binned_sql(columns, bins) + ",\ncells AS (\n" + union + "\n)"


CHI2_CTES = """
mx AS (SELECT var_x, var_y, val_x, sum(n) AS nx FROM cells GROUP BY ALL),
my AS (SELECT var_x, var_y, val_y, sum(n) AS ny FROM cells GROUP BY ALL),
mt AS (SELECT var_x, var_y, sum(n) AS "N" FROM cells GROUP BY ALL),
per AS (
  SELECT c.var_x, c.var_y, any_value(t."N") AS "N",
    sum(CAST(c.n AS DOUBLE) * c.n * t."N" / (CAST(x.nx AS DOUBLE) * y.ny)) AS s,
    count(DISTINCT c.val_x) AS r, count(DISTINCT c.val_y) AS k
  FROM cells c
  JOIN mx x ON c.var_x = x.var_x AND c.var_y = x.var_y AND c.val_x = x.val_x
  JOIN my y ON c.var_x = y.var_x AND c.var_y = y.var_y AND c.val_y = y.val_y
  JOIN mt t ON c.var_x = t.var_x AND c.var_y = t.var_y
  GROUP BY c.var_x, c.var_y
)"""

CHI2_SELECT = f"""
SELECT var_x, var_y, CAST("N" AS BIGINT) AS n, CAST(r AS BIGINT) AS r, CAST(k AS BIGINT) AS k,
  {rhe('s - "N"', 6)} AS chi2,
  CAST(greatest((r - 1) * (k - 1), 0) AS BIGINT) AS pedestal,
  CAST("N" * (least(r, k) - 1) AS BIGINT) AS chi2_max
FROM per"""


# phi_k: bisection for the correlation of a binned bivariate normal, all pairs at once.
# ``nodes`` are Gauss-Legendre nodes; ``above`` is what Phi2(h, k, rho) has over Phi(h)Phi(k).
_NODES = ", ".join(f"({float(x)!r}, {float(w)!r})" for x, w in zip(*np.polynomial.legendre.leggauss(64)))
_HALVINGS = 34  # until the bracket is narrower than 1e-10

PHIK_CTES = f"""
stats AS MATERIALIZED ({CHI2_SELECT}),
searched AS MATERIALIZED (
  SELECT var_x, var_y, r, k, {D('chi2 - pedestal')} / (chi2_max - pedestal) AS part
  FROM stats WHERE r >= 2 AND k >= 2 AND chi2 > pedestal AND chi2 < chi2_max
),
nodes(x, w) AS MATERIALIZED (SELECT CAST(col0 AS DOUBLE), CAST(col1 AS DOUBLE) FROM (VALUES {_NODES})),
sizes AS (SELECT r AS m FROM searched UNION SELECT k FROM searched),
cuts AS (SELECT m, unnest(range(0, m + 1)) AS i FROM sizes),
edges AS MATERIALIZED (
  SELECT m, i, z, 0.5 + z / 2 * sum(w * exp(-(z * (x + 1) / 2) * (z * (x + 1) / 2) / 2)) / sqrt(2 * pi()) AS phi
  FROM (SELECT m, i, CAST(-5 AS DOUBLE) + CAST(10 AS DOUBLE) * i / m AS z FROM cuts), nodes GROUP BY m, i, z
),
corners AS MATERIALIZED (
  SELECT s.var_x, s.var_y, a.i, b.i AS j, a.z AS h, b.z AS g, a.phi * b.phi AS both_, least(a.phi, b.phi) AS low
  FROM searched s JOIN edges a ON a.m = s.r JOIN edges b ON b.m = s.k
),
signs(di, dj, sgn) AS (VALUES (0, 0, 1), (1, 0, -1), (0, 1, -1), (1, 1, 1)),
box AS MATERIALIZED (
  SELECT c.var_x, c.var_y, c.i AS ci, c.j AS cj, c.i - di AS i, c.j - dj AS j, sgn
  FROM corners c, signs WHERE c.i > 0 AND c.j > 0
),
mass AS MATERIALIZED (
  SELECT b.var_x, b.var_y, ci, cj, sum(sgn * both_) AS p0, sum(sgn * (low - both_)) AS d1
  FROM box b JOIN corners c USING (var_x, var_y, i, j) GROUP BY b.var_x, b.var_y, ci, cj
),
goal AS MATERIALIZED (
  SELECT var_x, var_y, any_value(part) * sum(d1 * d1 / p0) AS goal
  FROM mass JOIN searched USING (var_x, var_y) GROUP BY var_x, var_y
),
search AS (
  SELECT var_x, var_y, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS step FROM searched
  UNION ALL
  SELECT var_x, var_y, CASE WHEN dist < goal THEN mid ELSE lo END, CASE WHEN dist < goal THEN hi ELSE mid END, step + 1
  FROM (
    SELECT var_x, var_y, lo, hi, mid, step, sum(d * d / p0) AS dist
    FROM (
      SELECT b.var_x, b.var_y, lo, hi, mid, step, ci, cj, sum(sgn * above) AS d
      FROM (
        SELECT var_x, var_y, i, j, lo, hi, mid, step,
          CASE WHEN mid <= 0.9 THEN area ELSE low - both_ - area END AS above
        FROM (
          SELECT var_x, var_y, i, j, lo, hi, mid, step, low, both_,
            sum((t1 - t0) / 2 * w * exp(-(h * h - 2 * h * g * sin(t) + g * g) / (2 * cos(t) * cos(t)))) / (2 * pi()) AS area
          FROM (
            SELECT c.*, lo, hi, mid, step, t0, t1, w, t0 + (t1 - t0) * (x + 1) / 2 AS t
            FROM (
              SELECT *, CASE WHEN mid <= 0.9 THEN 0 ELSE asin(mid) END AS t0,
                CASE WHEN mid <= 0.9 THEN asin(mid) ELSE pi() / 2 END AS t1
              FROM (SELECT *, (lo + hi) / 2 AS mid FROM search WHERE step < {_HALVINGS})
            ) q JOIN corners c USING (var_x, var_y), nodes
          ) GROUP BY ALL
        )
      ) a JOIN box b USING (var_x, var_y, i, j) GROUP BY ALL
    ) JOIN mass USING (var_x, var_y, ci, cj) GROUP BY ALL
  ) JOIN goal USING (var_x, var_y)
),
pair_phik AS (
  SELECT s.var_x, s.var_y,
    CASE WHEN s.r < 2 OR s.k < 2 THEN NULL WHEN s.chi2 >= s.chi2_max THEN 1 WHEN s.chi2 <= s.pedestal THEN 0
         ELSE {rhe('(f.lo + f.hi) / 2', 6)} END AS phik
  FROM stats s LEFT JOIN (SELECT * FROM search WHERE step = {_HALVINGS}) f USING (var_x, var_y)
)"""


def phik_sql(columns: list[str], bins: dict[str, int]) -> str:
    names = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    ctes = contingency_cte(columns, bins) + "," + CHI2_CTES + "," + PHIK_CTES + f""",
names(name, pos) AS (VALUES {names}),
upper_ AS (
  SELECT a.name AS var_x, b.name AS var_y, p.phik FROM names a JOIN names b ON a.pos < b.pos
  LEFT JOIN pair_phik p ON p.var_x = a.name AND p.var_y = b.name
),
matrix AS (
  SELECT var_x, var_y, CAST(phik AS DOUBLE) AS phik FROM upper_
  UNION ALL SELECT var_y, var_x, phik FROM upper_
  UNION ALL SELECT name, name, 1 FROM names
)"""
    return "WITH RECURSIVE" + with_base_ctes(ctes, "").removeprefix("WITH")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["extract_purchases"] = with_base("SELECT * FROM extract")
    overview_cols = ["user_id", "device_type_canonical", "order_id", "order_dt", "order_ts",
                     "currency_code", "revenue", "tickets_count", "days_since_prev", "event_id",
                     "event_name", "event_type_main", "service_name", "region_name", "city_name"]
    types = ["bigint", "string", "bigint", "timestamp_ntz", "timestamp_ntz", "string",
             "decimal(18,2)", "int", "int", "bigint", "string", "string", "string", "string", "string"]
    q["table_overview"] = with_base("\nUNION ALL\n".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS data_type, "
        f"CAST(count({c}) AS BIGINT) AS non_null_cnt, CAST(count(*) AS BIGINT) AS row_cnt FROM extract"
        for i, (c, t) in enumerate(zip(overview_cols, types))))
    q["typed_purchases"] = with_base("SELECT * FROM purchases_rub")
    q["fx_normalise"] = with_base("SELECT order_id, order_dt, currency_code, revenue, revenue_rub FROM fx_core")
    q["outlier_cut"] = with_base("SELECT * FROM clean")
    vol = lambda src, col, level=0.99: with_base(f"""
SELECT CAST(count(*) AS BIGINT) AS rows_before,
  CAST(sum(CASE WHEN {D(col)} <= (SELECT quantile_cont({D(col)}, {level}) FROM {src}) THEN 1 ELSE 0 END) AS BIGINT) AS rows_after,
  CAST(count(*) - sum(CASE WHEN {D(col)} <= (SELECT quantile_cont({D(col)}, {level}) FROM {src}) THEN 1 ELSE 0 END) AS BIGINT) AS rows_removed,
  {rhe(f"{D(f'count(*) - sum(CASE WHEN {D(col)} <= (SELECT quantile_cont({D(col)}, {level}) FROM {src}) THEN 1 ELSE 0 END)')} / count(*) * CAST(100 AS DOUBLE)", 2)} AS removed_pct
FROM {src}""")  # noqa: E731
    q["outlier_volume"] = vol("fx_core", "revenue_rub")
    q["outlier_volume_95"] = vol("fx_core", "revenue_rub", 0.95)
    q["fx_from_rates_csv"] = q["fx_normalise"]
    q["user_count"] = with_base("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users_cnt FROM clean")
    q["days_since_prev"] = with_base("SELECT user_id, order_id, order_dt, days_since_prev FROM extract")
    q["customer_profile"] = with_base("SELECT * FROM profile")
    q["first_order_attrs"] = with_base("""
SELECT user_id, min(order_ts) AS min_order_ts,
  min(device_type_canonical) FILTER (WHERE order_ts = first_ts) AS first_order_device,
  min(region_name) FILTER (WHERE order_ts = first_ts) AS first_order_region,
  min(service_name) FILTER (WHERE order_ts = first_ts) AS first_service_name,
  min(event_type_main) FILTER (WHERE order_ts = first_ts) AS first_event_type
FROM clean_u GROUP BY user_id""")
    q["order_gap_mean"] = with_base("""
SELECT user_id, CAST(sum(gap_d) AS DOUBLE) / count(gap_d) AS date_difference_d,
  CAST(count(gap_d) AS BIGINT) AS gaps_cnt
FROM clean_u WHERE gap_d IS NOT NULL GROUP BY user_id""")
    q["events_gap_stats"] = """
WITH g AS (
  SELECT user_id, datesub('day', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_d
  FROM events WHERE user_id IS NOT NULL
)
SELECT user_id, CAST(coalesce(sum(gap_d), 0) AS BIGINT) AS gap_sum, CAST(count(gap_d) AS BIGINT) AS gap_cnt
FROM g GROUP BY user_id"""
    q["profile_summary"] = with_base(f"""
SELECT CAST(count(user_id) AS BIGINT) AS total_users_cnt,
  {rhe('avg(avg_revenue_rub)', 1)} AS mean_user_avg_revenue,
  {rhe(f"{D('sum(CASE WHEN is_two THEN 1 ELSE 0 END)')} / count(user_id)", 1)} * CAST(100 AS DOUBLE) AS share_2_plus_orders,
  {rhe(f"{D('sum(CASE WHEN is_five THEN 1 ELSE 0 END)')} / count(user_id)", 1)} * CAST(100 AS DOUBLE) AS share_5_plus_orders
FROM profile""")
    q["describe_orders"] = describe_sql("purchases_rub", ["order_id", "revenue", "tickets_count",
                                                          "days_since_prev", "event_id", "revenue_rub"])
    q["describe_profile"] = describe_sql("profile", ["total_orders_cnt", "avg_cnt_per_order",
                                                     "date_difference_d"])
    q["profile_outlier_cut"] = with_base("SELECT * FROM profile_f")
    q["profile_outlier_volume"] = vol("profile", "total_orders_cnt")
    q["customer_lifetime"] = with_base("""
SELECT user_id, total_orders_cnt, CAST(datesub('day', min_order_ts, max_order_ts) AS INTEGER) AS lifetime_d
FROM profile""")

    for k, key in SEGMENTS.items():
        q[f"segment_share_{k}"] = share_sql(key)
        q[f"segment_return_{k}"] = return_sql(key)
        q[f"chart_return_{k}"] = with_base_ctes(return_report(key), f"SELECT {key}, is_two_share FROM rep2")
    region, service, event = SEGMENTS["region"], SEGMENTS["service"], SEGMENTS["event"]
    q["segment_share_region_top"] = with_base_ctes(
        f"""sh AS (SELECT {region}, CAST(count(user_id) AS BIGINT) AS users_cnt,
  {D('count(user_id)')} / (SELECT count(user_id) FROM profile_f) * CAST(100 AS DOUBLE) AS share
  FROM profile_f WHERE {region} IS NOT NULL GROUP BY {region})""",
        f"SELECT * FROM sh ORDER BY users_cnt DESC, {region} LIMIT 10")
    q["segment_share_service_top"] = with_base_ctes(
        f"""sh AS (SELECT {service}, CAST(count(user_id) AS BIGINT) AS users_cnt,
  {D('count(user_id)')} / (SELECT count(user_id) FROM profile_f) * CAST(100 AS DOUBLE) AS share
  FROM profile_f WHERE {service} IS NOT NULL GROUP BY {service})""",
        f"SELECT * FROM sh ORDER BY users_cnt DESC, {service} LIMIT 10")
    q["segment_return_region_min"] = with_base_ctes(
        return_report(region), f"SELECT * FROM rep2 WHERE users_cnt >= {MIN_SEGMENT_USERS}")
    q["segment_return_region_top"] = with_base_ctes(
        return_report(region), f"SELECT * FROM rep2 ORDER BY users_cnt DESC, {region} LIMIT 15")
    q["region_top10"] = with_base_ctes(
        return_report(region),
        f"SELECT {region}, is_two_share FROM rep2 ORDER BY users_cnt DESC, {region} LIMIT 10")
    q["region_tail_mean"] = with_base_ctes(
        return_report(region) + f""",
tail AS (SELECT * FROM rep2 ORDER BY users_cnt ASC, {region} DESC LIMIT 10)""",
        f"SELECT {rhe('avg(is_two_share)', 6)} AS mean_is_two_share FROM tail")
    q["service_top"] = with_base_ctes(
        return_report(service), f"SELECT * FROM rep2 ORDER BY is_two_share DESC, {service} LIMIT 10")
    q["service_top_mean"] = with_base_ctes(
        return_report(service) + f""",
top AS (SELECT * FROM rep2 ORDER BY is_two_share DESC, {service} LIMIT 10)""",
        f"SELECT {rhe('avg(is_two_share)', 6)} AS mean_is_two_share FROM top")
    q["service_top_by_users"] = with_base_ctes(
        return_report(service), f"SELECT * FROM rep2 ORDER BY users_cnt DESC, {service} LIMIT 10")
    rate = f"{D('r')} / n * CAST(100 AS DOUBLE)"
    q["segment_lift"] = with_base_ctes(f"""
ov AS (SELECT {D('sum(CASE WHEN is_two THEN 1 ELSE 0 END)')} / count(user_id) * CAST(100 AS DOUBLE) AS o FROM profile_f),
lr AS (SELECT {event}, CAST(sum(CASE WHEN is_two THEN 1 ELSE 0 END) AS BIGINT) AS r, CAST(count(user_id) AS BIGINT) AS n
       FROM profile_f WHERE {event} IS NOT NULL GROUP BY {event})""", f"""
SELECT {event}, r AS returners_cnt, n AS users_cnt, {rhe(rate, 6)} AS return_rate,
  {rhe('(SELECT o FROM ov)', 6)} AS overall_rate, {rhe(f'{rate} - (SELECT o FROM ov)', 6)} AS lift_pp
FROM lr""")
    a, b = COMPARE_GENRES
    ra = f"{D('max(CASE WHEN g = ' + repr(a) + ' THEN r END)')} / max(CASE WHEN g = '{a}' THEN n END) * CAST(100 AS DOUBLE)"
    rb = f"{D('max(CASE WHEN g = ' + repr(b) + ' THEN r END)')} / max(CASE WHEN g = '{b}' THEN n END) * CAST(100 AS DOUBLE)"
    q["segment_compare"] = with_base_ctes(f"""
cr AS (SELECT {event} AS g, sum(CASE WHEN is_two THEN 1 ELSE 0 END) AS r, count(user_id) AS n
       FROM profile_f WHERE {event} IN ('{a}', '{b}') GROUP BY {event})""", f"""
SELECT '{a}' AS segment_a, '{b}' AS segment_b,
  CAST(max(CASE WHEN g = '{a}' THEN n END) AS BIGINT) AS users_a,
  CAST(max(CASE WHEN g = '{b}' THEN n END) AS BIGINT) AS users_b,
  {rhe(ra, 6)} AS rate_a, {rhe(rb, 6)} AS rate_b, {rhe(f'({ra}) - ({rb})', 6)} AS diff_pp
FROM cr""")

    q["tickets_bucket"] = with_base("SELECT user_id, avg_cnt_per_order, cnt_tickets_cat FROM profile_b")
    q["tickets_bucket_stats"] = with_base_ctes("""
lab AS (SELECT * FROM (VALUES ('1-2'), ('2-3'), ('3-5'), ('5+')) t(cnt_tickets_cat)),
bc AS (SELECT cnt_tickets_cat, count(user_id) AS cnt FROM profile_b WHERE cnt_tickets_cat IS NOT NULL GROUP BY ALL)""", f"""
SELECT l.cnt_tickets_cat,
  {rhe(f"{D('coalesce(bc.cnt, 0)')} / (SELECT count(user_id) FROM profile_b)", 2)} * CAST(100 AS DOUBLE) AS share,
  CAST(coalesce(bc.cnt, 0) AS BIGINT) AS cnt
FROM lab l LEFT JOIN bc ON l.cnt_tickets_cat = bc.cnt_tickets_cat""")
    q["tickets_bucket_return"] = with_base_ctes("""
lab AS (SELECT * FROM (VALUES ('1-2'), ('2-3'), ('3-5'), ('5+')) t(cnt_tickets_cat)),
bc AS (SELECT cnt_tickets_cat, count(user_id) AS n, sum(CASE WHEN is_two THEN 1 ELSE 0 END) AS r
       FROM profile_b WHERE cnt_tickets_cat IS NOT NULL GROUP BY ALL)""", f"""
SELECT l.cnt_tickets_cat, CAST(coalesce(bc.n, 0) AS BIGINT) AS users_cnt,
  CAST(coalesce(bc.r, 0) AS BIGINT) AS returners_cnt,
  CASE WHEN coalesce(bc.n, 0) > 0 THEN {rhe(f"{D('coalesce(bc.r, 0)')} / coalesce(bc.n, 0) * CAST(100 AS DOUBLE)", 2)} END AS is_two_share
FROM lab l LEFT JOIN bc ON l.cnt_tickets_cat = bc.cnt_tickets_cat""")
    q["weekday_return"] = with_base(f"""
SELECT day_of_week, CAST(count(user_id) AS BIGINT) AS cnt,
  CASE WHEN sum(CASE WHEN is_two THEN 1 ELSE 0 END) > 0 THEN
    {rhe(f"{D('sum(CASE WHEN is_two THEN 1 ELSE 0 END)')} / count(user_id) * CAST(100 AS DOUBLE)", 2)} END AS share
FROM profile_b GROUP BY day_of_week""")
    q["gap_by_loyalty"] = with_base(f"""
SELECT is_five, {rhe('avg(date_difference_d)', 6)} AS mean_gap_d, CAST(count(user_id) AS BIGINT) AS users_cnt
FROM profile_f WHERE is_two GROUP BY is_five""")
    q["order_bucket_counts"] = with_base_ctes("""
lab AS (SELECT * FROM (VALUES ('1'), ('2-4'), ('5+')) t(cnt_tickets_cat_v2)),
bc AS (SELECT cnt_tickets_cat_v2, count(user_id) AS cnt FROM profile_b WHERE cnt_tickets_cat_v2 IS NOT NULL GROUP BY ALL)""", """
SELECT l.cnt_tickets_cat_v2, CAST(coalesce(bc.cnt, 0) AS BIGINT) AS cnt
FROM lab l LEFT JOIN bc ON l.cnt_tickets_cat_v2 = bc.cnt_tickets_cat_v2""")
    q["bucket_values"] = with_base(
        "SELECT DISTINCT total_orders_cnt FROM profile_b WHERE cnt_tickets_cat_v2 = '5+'")

    q["unbucketed_users"] = with_base("""
SELECT CAST(count(user_id) AS BIGINT) AS users_cnt,
  CAST(sum(CASE WHEN cnt_tickets_cat IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_ticket_bucket,
  CAST(sum(CASE WHEN cnt_tickets_cat_v2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_order_bucket
FROM profile_b""")
    cube_keys = {k: k for k in ("first_event_type", "first_order_device", "first_order_region", "first_service_name",
                                "day_of_week", "cnt_tickets_cat", "cnt_tickets_cat_v2", "total_orders_cnt")}
    cube_keys |= {"loyalty": "CASE WHEN is_two THEN is_five END", "all_users": "true"}
    q["segment_cube"] = with_base("\nUNION ALL\n".join(
        f"SELECT '{k}' AS segment, CAST({x} AS VARCHAR) AS value, CAST(count(user_id) AS BIGINT) AS users_cnt, "
        f"CAST(sum(CASE WHEN is_two THEN 1 ELSE 0 END) AS BIGINT) AS returners_cnt, "
        f"CAST(sum(CASE WHEN is_five THEN 1 ELSE 0 END) AS BIGINT) AS five_cnt, {rhe('avg(date_difference_d)', 6)} AS mean_gap_d "
        f"FROM profile_b GROUP BY {x}" for k, x in cube_keys.items()))

    q["tickets_histogram"] = histogram_sql("hdata AS (SELECT tickets_count FROM fx_core)", "tickets_count", 100)
    q["revenue_box"] = with_base_ctes(f"""
qs AS (SELECT quantile_cont({D('revenue_rub')}, 0.25) AS q1, quantile_cont({D('revenue_rub')}, 0.5) AS med,
              quantile_cont({D('revenue_rub')}, 0.75) AS q3 FROM fx_core WHERE revenue_rub IS NOT NULL),
fe AS (SELECT q1, med, q3, q3 - q1 AS iqr, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo_f,
              q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi_f FROM qs)""", f"""
SELECT CAST(count({D('revenue_rub')}) AS BIGINT) AS n,
  {rhe('any_value(fe.q1)', 6)} AS q1, {rhe('any_value(fe.med)', 6)} AS median,
  {rhe('any_value(fe.q3)', 6)} AS q3, {rhe('any_value(fe.iqr)', 6)} AS iqr,
  {rhe(f"min(CASE WHEN {D('revenue_rub')} >= fe.lo_f THEN {D('revenue_rub')} END)", 6)} AS whisker_lo,
  {rhe(f"max(CASE WHEN {D('revenue_rub')} <= fe.hi_f THEN {D('revenue_rub')} END)", 6)} AS whisker_hi,
  CAST(sum(CASE WHEN {D('revenue_rub')} < fe.lo_f THEN 1 ELSE 0 END) AS BIGINT) AS outliers_low,
  CAST(sum(CASE WHEN {D('revenue_rub')} > fe.hi_f THEN 1 ELSE 0 END) AS BIGINT) AS outliers_high,
  {rhe(f"min({D('revenue_rub')})", 6)} AS min, {rhe(f"max({D('revenue_rub')})", 6)} AS max
FROM fx_core, fe WHERE revenue_rub IS NOT NULL""")
    q["revenue_histogram"] = histogram_sql(LOYALTY_SQL, "avg_revenue_rub", 70, group="grp")
    q["revenue_histogram_shared"] = histogram_sql(LOYALTY_SQL, "avg_revenue_rub", 70, group="grp",
                                                  shared=True, density=True)

    q["phik_contingency"] = with_base_ctes(contingency_cte(PHIK_K1_COLUMNS, PHIK_K1_BINS),
                                           "SELECT * FROM cells")
    q["phik_chi2"] = with_base_ctes(contingency_cte(PHIK_K1_COLUMNS, PHIK_K1_BINS) + "," + CHI2_CTES,
                                    CHI2_SELECT)
    q["phik_chi2_default"] = with_base_ctes(contingency_cte(PHIK_K2_COLUMNS, PHIK_K2_BINS) + "," + CHI2_CTES,
                                            CHI2_SELECT)

    q["phik_matrix"] = phik_sql(PHIK_K1_COLUMNS, PHIK_K1_BINS) + "\nSELECT var_x, var_y, phik FROM matrix"
    q["phik_matrix_default"] = phik_sql(PHIK_K2_COLUMNS, PHIK_K2_BINS) + "\nSELECT var_x, var_y, phik FROM matrix"
    q["phik_target"] = (phik_sql(PHIK_K1_COLUMNS, PHIK_K1_BINS)
                        + "\nSELECT var_x AS variable, phik FROM matrix WHERE var_y = 'total_orders_cnt'")

    null_cols = ["user_id", "device_type_canonical", "order_id", "order_dt", "order_ts",
                 "currency_code", "revenue", "tickets_count", "days_since_prev", "event_id",
                 "event_name", "event_type_main", "service_name", "region_name", "city_name",
                 "revenue_rub"]
    q["null_profile"] = with_base("\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_cnt, "
        f"CAST(count(*) AS BIGINT) AS row_cnt, "
        f"{rhe(D('sum(CASE WHEN ' + c + ' IS NULL THEN 1 ELSE 0 END)') + ' / count(*) * CAST(100 AS DOUBLE)', 6)} AS null_pct "
        f"FROM purchases_rub" for c in null_cols))
    cat_cols = ["device_type_canonical", "currency_code", "event_type_main", "service_name", "region_name"]
    q["category_profile"] = with_base("\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {c} AS value, CAST(count(*) AS BIGINT) AS cnt, "
        f"({c} IS NULL OR lower(trim({c})) IN ('другое', 'нет данных', 'unknown', 'other')) AS is_sentinel "
        f"FROM fx_core GROUP BY {c}" for c in cat_cols))
    q["duplicate_orders"] = with_base(
        "SELECT order_id, CAST(count(*) AS BIGINT) AS n_rows FROM fx_core GROUP BY order_id HAVING count(*) > 1")
    q["duplicate_region_days"] = with_base("""
SELECT region_name, order_dt, CAST(count(*) AS BIGINT) AS n_rows
FROM fx_core GROUP BY region_name, order_dt HAVING count(*) > 1""")
    q["duplicate_purchases"] = with_base("""
SELECT *, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT * FROM fx_core UNION ALL SELECT * FROM fx_core WHERE order_id % 10 = 0) GROUP BY ALL HAVING count(*) > 1""")
    freq = "\n  UNION ALL\n".join(f"  SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM fx_core GROUP BY {c}"
                               for c in FREQUENT_COLUMNS)
    q["frequent_values"] = with_base_ctes(f"""
vals AS ({freq}),
marked AS (SELECT *, cnt > {D('sum(cnt) OVER (PARTITION BY column_name)')} * {D(FREQUENT_SHARE)} AS common FROM vals),
placed AS (SELECT *, row_number() OVER (PARTITION BY column_name, common
             ORDER BY cnt DESC, coalesce(value, ''), value NULLS FIRST) AS place FROM marked),
kept AS (SELECT *, common AND place <= {FREQUENT_VALUES} AS kept FROM placed)""", """
SELECT column_name, value, CAST(cnt AS BIGINT) AS cnt, CAST(place AS INTEGER) AS place, false AS is_rest,
  (value IS NULL OR lower(trim(value)) IN ('другое', 'нет данных', 'unknown', 'other')) AS is_sentinel
FROM kept WHERE kept
UNION ALL
SELECT column_name, NULL, CAST(sum(cnt) AS BIGINT), 0, true, false FROM kept WHERE NOT kept GROUP BY column_name""")
    q["monthly_users"] = with_base_ctes("""
um AS (SELECT DISTINCT user_id, strftime(order_ts, '%Y-%m') AS month FROM clean WHERE user_id IS NOT NULL AND order_ts IS NOT NULL),
uf AS (SELECT user_id, min(month) AS month FROM um GROUP BY user_id),
un AS (SELECT month, count(*) AS new_users FROM uf GROUP BY month),
uc AS (SELECT month, count(*) AS users FROM um GROUP BY month)""", """
SELECT month, CAST(users AS BIGINT) AS users_cnt, CAST(coalesce(new_users, 0) AS BIGINT) AS new_users_cnt,
  CAST(sum(coalesce(new_users, 0)) OVER (ORDER BY month) AS BIGINT) AS users_to_date
FROM uc LEFT JOIN un USING (month)""")
    q["profile_from_store"] = q["customer_profile"]
    return q


ORACLE_SQL = build()
