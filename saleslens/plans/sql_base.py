"""Common table expressions of the SQL twins: the panel and its dimensions."""

from __future__ import annotations

from .driver_panel import holiday_rows

_HOLIDAYS = ", ".join(f"({i}, DATE '{d}', '{k}', '{p}', '{t}', {str(m).lower()})" for i, d, k, p, t, m in holiday_rows())

_PARTS = {
    "fact": """SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS INT) AS store_nbr, p_type AS family, sum(l_quantity) AS sales,
      CAST(count(*) FILTER (l_discount >= 0.05) AS BIGINT) AS onpromotion
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "panel": """SELECT d.date, s.store_nbr, s.family, coalesce(f.sales, 0) AS sales, CAST(coalesce(f.onpromotion, 0) AS BIGINT) AS onpromotion
    FROM (SELECT DISTINCT date FROM fact) d CROSS JOIN (SELECT DISTINCT store_nbr, family FROM fact) s
    LEFT JOIN fact f ON f.date = d.date AND f.store_nbr = s.store_nbr AND f.family = s.family""",
    "stores": """SELECT CAST(n_nationkey AS INT) AS store_nbr, n_name AS city, r_name AS state, chr(CAST(65 + n_nationkey % 5 AS INT)) AS type, CAST(n_nationkey % 17 + 1 AS INT) AS cluster
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "oil": """SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS dcoilwtico FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1""",
    "filled": """SELECT date, coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(x IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dcoilwtico
    FROM (SELECT d.date, o.dcoilwtico AS x FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN oil o ON o.date = d.date)""",
    "events": f"""SELECT * FROM (VALUES {_HOLIDAYS}) AS v(ord, date, type, locale, description, transferred)""",
    "hol": """SELECT date, string_agg(type, ',' ORDER BY ord) AS holiday_type, bool_or(locale = 'National') AS is_national_holiday, bool_or(locale = 'Regional') AS is_regional_holiday,
      bool_or(locale = 'Local') AS is_local_holiday, bool_or(transferred) AS is_transferred, string_agg(description, ',' ORDER BY ord) AS holiday_description, true AS is_holiday FROM events GROUP BY date""",
    "master": """SELECT p.*, s.city, s.state, s.type, s.cluster, f.dcoilwtico, coalesce(h.holiday_type, 'None') AS holiday_type, coalesce(is_national_holiday, false) AS is_national_holiday,
      coalesce(is_regional_holiday, false) AS is_regional_holiday, coalesce(is_local_holiday, false) AS is_local_holiday, coalesce(is_transferred, false) AS is_transferred,
      coalesce(h.holiday_description, 'None') AS holiday_description, coalesce(is_holiday, false) AS is_holiday,
      CAST(year(p.date) AS INT) AS year, CAST(month(p.date) AS INT) AS month, CAST(day(p.date) AS INT) AS day, CAST(isodow(p.date) - 1 AS INT) AS dayofweek, CAST(dayofyear(p.date) AS INT) AS dayofyear,
      CAST(weekofyear(p.date) AS INT) AS weekofyear, isodow(p.date) >= 6 AS is_weekend, day(p.date) = 1 AS is_month_start, p.date = last_day(p.date) AS is_month_end
    FROM panel p LEFT JOIN stores s ON s.store_nbr = p.store_nbr LEFT JOIN filled f ON f.date = p.date LEFT JOIN hol h ON h.date = p.date""",
    "holdates": """SELECT date, bool_or(is_holiday) AS h FROM master GROUP BY date""",
    "distances": """SELECT date, h, min(CASE WHEN h THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - date AS to_raw,
      date - max(CASE WHEN h THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since_raw FROM holdates""",
    "recent": """SELECT * FROM panel WHERE date > (SELECT max(date) FROM panel) - INTERVAL 30 DAY""",
    "base": """SELECT date, store_nbr, family, sales, onpromotion, coalesce(lag(sales, 7) OVER w, 0.0) AS pred, coalesce(avg(sales) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 0.0) AS naive_roll_28,
      coalesce(avg(sales) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS naive_roll_7 FROM panel WINDOW w AS (PARTITION BY store_nbr, family ORDER BY date)""",
    "oof": """SELECT * FROM base WHERE date > (SELECT max(date) FROM panel) - INTERVAL 15 DAY""",
    "forecast": """SELECT *, greatest(pred * 0.5, 0.0) AS pred_q05, pred * 1.5 AS pred_q95 FROM oof""",
    "grid": """SELECT o.date, o.store_nbr, o.family, o.sales, o.pred AS base_bottom, 1.1 * sum(o.naive_roll_28) OVER (PARTITION BY date, store_nbr) AS base_store,
      0.9 * sum(o.naive_roll_28) OVER (PARTITION BY date, family) AS base_family, sum(o.naive_roll_7) OVER (PARTITION BY date) AS base_total FROM oof o""",
    "levels": """SELECT date, CASE 2 * grouping(store_nbr) + grouping(family) WHEN 3 THEN 'Total' WHEN 1 THEN 'Store' WHEN 2 THEN 'Family' ELSE 'Bottom' END AS level,
      CASE 2 * grouping(store_nbr) + grouping(family) WHEN 3 THEN 'Total' WHEN 1 THEN 'Store_' || store_nbr WHEN 2 THEN 'Family_' || family ELSE store_nbr || '_' || family END AS series_id,
      sum(sales) AS sales, sum(pred) AS pred FROM oof GROUP BY GROUPING SETS ((date), (date, store_nbr), (date, family), (date, store_nbr, family))""",
}
_NEEDS = {"panel": ["fact"], "filled": ["panel", "oil"], "hol": ["events"], "master": ["panel", "stores", "filled", "hol"], "holdates": ["master"], "distances": ["holdates"], "recent": ["panel"],
          "base": ["panel"], "oof": ["base"], "forecast": ["oof"], "grid": ["oof"], "levels": ["oof"]}


def with_base(select: str, *names: str) -> str:
    """``select`` after the named expressions and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in order) + "\n" + select
