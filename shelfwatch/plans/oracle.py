"""The same results as plain SQL over the same tables, written for a single-node SQL engine.

Written from the definitions, not from the Spark plans: spines are joins, post-promotion windows are
range joins, ranks are global ``row_number``. Agreement therefore checks the rewrites.
"""

from __future__ import annotations

import re

from shelfwatch.operators.runs import LOG_DECIMALS
from shelfwatch.plans.queries import (
    DECIMALS, DURABLE_DAYS, MISSING_ITEMS, MISSING_STORE, PARAMS, PERISHABLE_DAYS, SLICED, TIE_SHIFT,
)
from shelfwatch.params import Params


def _raw(store: str = "n_regionkey") -> dict[str, str]:
    """``store``: the column of supplier or nation that tells stores apart."""
    return {
        "lines": f"""
            SELECT l.*, CAST(l.l_shipdate AS DATE) AS date, {store} AS store_nbr
            FROM lineitem l, supplier s, nation n WHERE s.s_suppkey = l.l_suppkey AND n.n_nationkey = s.s_nationkey""",
        "types": """
            SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS position
            FROM (SELECT DISTINCT p_type FROM part)""",
        "products": """
            SELECT p_partkey, p_type, p_size > 25 AS large, 2 * position + CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS item_nbr
            FROM part NATURAL JOIN types""",
        "train": """
            SELECT date, store_nbr, item_nbr,
                   l_quantity * CASE WHEN l_returnflag || l_linestatus = 'RF' THEN -1 ELSE 1 END AS unit_sales,
                   CASE WHEN l_discount = 0 THEN NULL ELSE l_discount >= CAST(0.09 AS DOUBLE) END AS onpromotion
            FROM lines, products WHERE p_partkey = l_partkey""",
        "transactions": """
            SELECT date, store_nbr, count(DISTINCT l_orderkey) AS transactions FROM lines GROUP BY ALL""",
        "stores": f"""
            SELECT {store} AS store_nbr, min(r_name) AS city, min(n_name) AS state,
                   CASE WHEN min(r_regionkey) < 2 THEN 'A' ELSE 'B' END AS type, min(r_regionkey) AS cluster
            FROM region JOIN nation ON n_regionkey = r_regionkey
            {"JOIN supplier ON s_nationkey = n_nationkey" if store.startswith("s_") else ""} GROUP BY 1""",
        "items": """
            SELECT DISTINCT item_nbr, p_type AS family, CASE WHEN large THEN 1 ELSE 0 END AS class,
                   item_nbr % 3 = 0 AS perishable
            FROM products""",
        "holidays_events": """
            SELECT make_date(y, m, d) AS date, type, locale, transferred
            FROM (SELECT unnest(range(year(min(l_shipdate)), year(max(l_shipdate)) + 1)) AS y FROM lineitem),
                 (VALUES (1, 1, 'Holiday', 'National', false), (1, 12, 'Work Day', 'National', false),
                         (2, 8, 'Holiday', 'National', true), (2, 9, 'Transfer', 'National', false),
                         (3, 5, 'Holiday', 'Local', false), (5, 2, 'Bridge', 'National', false),
                         (7, 1, 'Event', 'National', false), (12, 24, 'Additional', 'National', false))
                 AS entries(m, d, type, locale, transferred)""",
    }


def _key(day: str) -> str:
    return f"CAST(strftime({day}, '%Y%m%d') AS BIGINT)"


def _tables(p: Params, x: str = "") -> dict[str, str]:
    """Definitions for one set of parameters; ``x`` is appended to every table name."""
    back, post = p.lookback_days, p.post_promo_days
    lookback = f"RANGE BETWEEN INTERVAL {back} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING"
    needed = p.min_expected_units * back
    return {
        f"sales{x}": f"""
            SELECT date, store_nbr, item_nbr,
                   sum(unit_sales) FILTER (WHERE unit_sales > 0) AS sold, -sum(unit_sales) FILTER (WHERE unit_sales < 0) AS back,
                   coalesce(sold, 0.0) AS units, coalesce(back, 0.0) AS return_units, bool_or(onpromotion) AS on_promo
            FROM train WHERE date >= DATE '{p.slice_start}' GROUP BY date, store_nbr, item_nbr""",
        f"store_day{x}": f"""
            SELECT date, store_nbr, transactions AS receipts FROM transactions WHERE date >= DATE '{p.slice_start}'""",
        f"trading{x}": f"""
            SELECT store_nbr, date, receipts,
                   receipts >= {p.min_receipts_share} * avg(receipts) OVER w AS full_day,
                   count(*) OVER w AS trading_days
            FROM store_day{x} WHERE receipts > 0
            WINDOW w AS (PARTITION BY store_nbr ORDER BY date {lookback})""",
        f"pairs{x}": f"""
            SELECT store_nbr, item_nbr, min(date) AS first_sale, max(date) AS last_sale
            FROM sales{x} WHERE date >= DATE '{p.window_start}' - {2 * back}
            GROUP BY store_nbr, item_nbr HAVING round(sum(units), 6) >= {needed}""",
        f"spine{x}": f"""
            SELECT p.store_nbr, p.item_nbr, t.date, t.full_day
            FROM pairs{x} p JOIN trading{x} t ON t.store_nbr = p.store_nbr AND t.date >= p.first_sale AND t.date <= p.last_sale""",
        f"filled{x}": f"""
            SELECT store_nbr, item_nbr, date, coalesce(s.units, 0.0) AS units, s.units IS NULL AS no_sale_row,
                   coalesce(full_day, false) AS full_day
            FROM spine{x} LEFT JOIN sales{x} s USING (store_nbr, item_nbr, date)""",
        f"series{x}": f"""
            SELECT *, avg(units) OVER w AS lambda_units, var_samp(units) OVER w AS var_units, count(*) OVER w AS history_days
            FROM filled{x}
            WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date ROWS BETWEEN {back} PRECEDING AND 1 PRECEDING)""",
        f"risk{x}": f"""
            SELECT {_key('date')} AS date_key, store_nbr AS store_key, item_nbr AS item_key, round(lambda_units, 2) AS expected_units
            FROM series{x} z
            WHERE date >= DATE '{p.window_start}' AND full_day AND no_sale_row AND history_days = {back}
              AND round(lambda_units, 9) >= {p.min_expected_units}
              AND EXISTS (FROM series{x} a WHERE a.store_nbr = z.store_nbr AND a.item_nbr = z.item_nbr
                          AND a.date > z.date AND a.date <= z.date + {back} AND a.units > 0)""",
        f"runs{x}": f"""
            SELECT store_nbr, item_nbr, min(date) AS start_date, max(date) AS end_date,
                   count(*) FILTER (WHERE full_day) AS run_days, count(*) AS spine_days,
                   arg_min_null(lambda_units, date) AS lambda_units, arg_min_null(var_units, date) AS var_units,
                   arg_min_null(history_days, date) AS history_days
            FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY date)
                          - row_number() OVER (PARTITION BY store_nbr, item_nbr, no_sale_row ORDER BY date) AS island
                  FROM series{x})
            WHERE no_sale_row GROUP BY store_nbr, item_nbr, island""",
        f"tested{x}": f"""
            SELECT store_nbr AS store_key, item_nbr AS item_key, {_key('start_date')} AS start_date_key,
                   {_key('end_date')} AS end_date_key, run_days, spine_days,
                   end_date - start_date + 1 AS calendar_days, lambda_units, coalesce(var_units, 0) / lambda_units AS dispersion,
                   round(-(lambda_units * run_days) * CASE WHEN dispersion > 1 THEN ln(dispersion) / (dispersion - 1) ELSE 1 END,
                         {LOG_DECIMALS}) AS ln_p_value,
                   round(-(lambda_units * run_days), {LOG_DECIMALS}) AS ln_p_poisson,
                   exp(ln_p_value) AS p_value, exp(ln_p_poisson) AS p_poisson, lambda_units * run_days AS expected_lost_units
            FROM runs{x}
            WHERE start_date BETWEEN DATE '{p.window_start}' AND DATE '{p.window_end}' AND history_days = {back}
              AND lambda_units > 0 AND run_days >= 1 AND spine_days <= {p.max_run_days}""",
        f"cutoff{x}": f"""
            SELECT max(ln_p_value) AS ln_cutoff
            FROM (SELECT ln_p_value, row_number() OVER (ORDER BY ln_p_value) AS i, count(*) OVER () AS m FROM tested{x})
            WHERE ln_p_value <= ln(i * CAST({p.fdr_q} AS DOUBLE) / m)""",
        f"poisson_cutoff{x}": f"""
            SELECT max(ln_p_poisson) AS cutoff
            FROM (SELECT ln_p_poisson, row_number() OVER (ORDER BY ln_p_poisson) AS i, count(*) OVER () AS m FROM tested{x})
            WHERE ln_p_poisson <= ln(i * CAST({p.fdr_q} AS DOUBLE) / m)""",
        f"flagged{x}": f"""
            SELECT t.*, coalesce(ln_p_value <= ln_cutoff, false) AS is_flagged FROM tested{x} t, cutoff{x}""",
        f"dispersion{x}": f"""
            SELECT store_nbr, item_nbr, avg(units) AS mean_units, var_samp(units) AS var_units,
                   var_samp(units) / avg(units) AS dispersion
            FROM series{x} WHERE date BETWEEN DATE '{p.window_start}' AND DATE '{p.window_end}'
            GROUP BY store_nbr, item_nbr HAVING avg(units) > 0""",
        f"holidays{x}": """
            SELECT DISTINCT date FROM holidays_events
            WHERE locale = 'National' AND NOT transferred AND type NOT IN ('Work Day', 'Event')""",
        f"dates{x}": f"""
            SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT least((SELECT min(date) FROM sales{x}), (SELECT min(date) FROM store_day{x})) AS lo,
                         greatest((SELECT max(date) FROM sales{x}), (SELECT max(date) FROM store_day{x})) AS hi)""",
        f"dim_store{x}": """
            SELECT store_nbr AS store_key, store_nbr, city, state, type AS store_type, cluster,
                   CASE WHEN o.day > (SELECT min(date) FROM transactions) + 7 THEN o.day END AS opening_date
            FROM stores JOIN (SELECT store_nbr, min(date) AS day FROM transactions GROUP BY 1) o USING (store_nbr)""",
        f"weekly{x}": f"""
            SELECT store_key, week_start, item_days, coalesce(flagged_days, 0) AS flagged_days, city,
                   coalesce(flagged_days, 0) / item_days AS rate, {_key('week_start')} AS week_start_key
            FROM (SELECT store_nbr AS store_key, CAST(date_trunc('week', date) AS DATE) AS week_start, count(*) AS item_days
                  FROM series{x} WHERE full_day AND date BETWEEN DATE '{p.window_start}' AND DATE '{p.window_end}'
                  GROUP BY 1, 2)
            LEFT JOIN (SELECT store_key, CAST(date_trunc('week', strptime(CAST(start_date_key AS VARCHAR), '%Y%m%d')) AS DATE)
                                AS week_start, CAST(sum(run_days) AS BIGINT) AS flagged_days
                       FROM flagged{x} WHERE is_flagged GROUP BY 1, 2) USING (store_key, week_start)
            LEFT JOIN (SELECT store_key, city FROM dim_store{x}) USING (store_key)""",
        f"weekly_exact{x}": f"""
            SELECT store_key, week_start, item_days, coalesce(own_days, 0) AS flagged_days, city,
                   coalesce(own_days, 0) / item_days AS rate, week_start_key
            FROM weekly{x}
            LEFT JOIN (SELECT r.store_key, CAST(date_trunc('week', s.date) AS DATE) AS week_start, count(*) AS own_days
                       FROM flagged{x} r JOIN series{x} s ON s.store_nbr = r.store_key AND s.item_nbr = r.item_key AND s.full_day
                         AND {_key('s.date')} BETWEEN start_date_key AND end_date_key
                       WHERE is_flagged GROUP BY 1, 2) USING (store_key, week_start)""",
        f"measured{x}": f"""
            SELECT s.*, coalesce(on_promo, false) AS promo,
                   date - min(date) OVER (PARTITION BY store_nbr, item_nbr) AS age,
                   coalesce(sum(units) FILTER (WHERE on_promo IS NOT TRUE) OVER w, 0) AS usual,
                   count(*) FILTER (WHERE on_promo) OVER w AS promo_days,
                   count(*) FILTER (WHERE on_promo) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date
                       RANGE BETWEEN INTERVAL {post} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS recent
            FROM sales{x} s
            WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date {lookback})""",
        f"fact{x}": f"""
            SELECT date, {_key('date')} AS date_key, store_nbr AS store_key, item_nbr AS item_key, units, return_units, on_promo,
                   NOT promo AND recent > 0 AS post_promo_window,
                   CASE WHEN (promo OR recent > 0) AND age >= {back} AND trading_days <> promo_days
                        THEN usual / (trading_days - promo_days) END AS baseline_units
            FROM measured{x} LEFT JOIN trading{x} USING (store_nbr, date)""",
        f"promo_days{x}": f"""
            SELECT f.*, h.date IS NOT NULL OR day(f.date) = 15 OR f.date = last_day(f.date) AS touching,
                   f.date - CAST(row_number() OVER (PARTITION BY store_key, item_key ORDER BY f.date) AS INTEGER) AS island
            FROM fact{x} f LEFT JOIN holidays{x} h ON h.date = f.date WHERE on_promo""",
        f"islands{x}": f"""
            SELECT store_key, item_key, min(date) AS start_date, max(date) AS end_date, count(*) AS promo_days,
                   sum(units) AS promo_units, arg_min_null(baseline_units, date) AS baseline_units,
                   bool_or(touching) AS touches_payday_or_holiday
            FROM promo_days{x} GROUP BY store_key, item_key, island""",
        f"events_raw{x}": f"""
            SELECT e.*, lead(start_date) OVER (PARTITION BY store_key, item_key ORDER BY start_date) AS next_start,
                   (SELECT sum(f.units) FROM fact{x} f WHERE f.store_key = e.store_key AND f.item_key = e.item_key
                      AND f.date > e.end_date AND f.date <= e.end_date + {post}) AS post_units_raw
            FROM islands{x} e""",
        f"events_post{x}": f"""
            SELECT *, end_date + {post} AS post_end,
                   (next_start IS NULL OR next_start > end_date + {post}) AND end_date + {post} <= DATE '{p.window_end}'
                     AND post_trading_days > 0 AS post_ok
            FROM (SELECT e.* REPLACE (coalesce(post_units_raw, 0) AS post_units_raw),
                         (SELECT nullif(count(*), 0) FROM trading{x} t WHERE t.store_nbr = e.store_key
                            AND t.date > e.end_date AND t.date <= e.end_date + {post}) AS post_trading_days
                  FROM events_raw{x} e
                  WHERE baseline_units > 0 AND start_date BETWEEN DATE '{p.window_start}' AND DATE '{p.window_end}')""",
        f"family_windows{x}": f"""
            SELECT family, CASE WHEN bool_or(perishable) THEN {PERISHABLE_DAYS} ELSE {DURABLE_DAYS} END AS post_days
            FROM items GROUP BY family""",
        f"events_by_family{x}": f"""
            SELECT *, end_date + post_days AS post_end,
                   (next_start IS NULL OR next_start > end_date + post_days) AND end_date + post_days <= DATE '{p.window_end}'
                     AND post_trading_days > 0 AS post_ok
            FROM (SELECT e.* REPLACE (coalesce((SELECT sum(f.units) FROM fact{x} f WHERE f.store_key = e.store_key
                                                  AND f.item_key = e.item_key AND f.date > e.end_date
                                                  AND f.date <= e.end_date + e.post_days), 0) AS post_units_raw),
                         (SELECT nullif(count(*), 0) FROM trading{x} t WHERE t.store_nbr = e.store_key
                            AND t.date > e.end_date AND t.date <= e.end_date + e.post_days) AS post_trading_days
                  FROM (SELECT r.*, family, CAST(post_days AS INTEGER) AS post_days
                        FROM events_raw{x} r JOIN items ON item_nbr = item_key JOIN family_windows{x} USING (family)) e
                  WHERE baseline_units > 0 AND start_date BETWEEN DATE '{p.window_start}' AND DATE '{p.window_end}')""",
        f"events{x}": f"""
            SELECT store_key, item_key, family, {_key('start_date')} AS start_date_key, {_key('end_date')} AS end_date_key,
                   promo_days, promo_units, baseline_units, promo_units / (baseline_units * promo_days) - 1 AS uplift,
                   CASE WHEN post_ok THEN post_units_raw END AS post_units,
                   CASE WHEN post_ok THEN baseline_units * post_trading_days END AS post_expected_units,
                   post_units / post_expected_units - 1 AS post_dip,
                   (promo_units + post_units) / (baseline_units * promo_days + post_expected_units) - 1 AS net_lift,
                   touches_payday_or_holiday
            FROM events_post{x} LEFT JOIN items ON item_nbr = item_key""",
    }


def _used(tables: dict[str, str], body: str) -> list[str]:
    """The definitions ``body`` needs, in definition order."""
    def mentioned(sql: str) -> set[str]:
        return set(re.findall(r"\w+", sql)) & tables.keys()

    open_names, needed = mentioned(body), set()
    while open_names:
        name = open_names.pop()
        needed.add(name)
        open_names |= mentioned(tables[name]) - needed
    return [name for name in tables if name in needed]


def _query(tables: dict[str, str], body: str) -> str:
    with_list = ",\n".join(f"{name} AS ({tables[name]})" for name in _used(tables, body))
    return f"WITH {with_list}\n{body}" if with_list else body


def _select(columns: str, source: str) -> str:
    """``columns``: space-separated names with a kind — i whole number, d double, t text or date, b boolean."""
    cast = {
        "i": 'CAST("{0}" AS BIGINT) AS "{0}"',
        "d": 'round(CAST("{0}" AS DOUBLE) + %r, %d) + 0.0 AS "{0}"' % (TIE_SHIFT, DECIMALS),
        "t": 'CAST("{0}" AS VARCHAR) AS "{0}"',
        "b": '"{0}"',
    }
    parts = [cast[c.split(":")[1]].format(c.split(":")[0]) for c in columns.split()]
    return f"SELECT {', '.join(parts)} FROM {source}"


_RUN = ("store_key:i item_key:i start_date_key:i end_date_key:i run_days:i spine_days:i calendar_days:i "
        "lambda_units:d dispersion:d p_value:d p_poisson:d expected_lost_units:d ln_p_value:d ln_p_poisson:d")
_RAW_EVENT = ("store_key:i item_key:i start_date:t end_date:t promo_days:i promo_units:d baseline_units:d "
              "touches_payday_or_holiday:b post_units_raw:d next_start:t")
_ISO_YEAR = "CAST(isoyear(date) AS BIGINT)"


def _bodies() -> dict[str, str]:
    p = PARAMS
    least = p.min_family_events
    week_grid = "(SELECT store_key, week_start, round(rate * 100, 4) AS rate_pct FROM weekly)"
    window = "date_key BETWEEN {} AND {}".format(*[f"{d:%Y%m%d}" for d in (p.window_start, p.window_end)])
    sides = f"(SELECT * FROM fact_new WHERE {window}) a JOIN (SELECT * FROM fact WHERE {window}) b USING (date_key, store_key, item_key)"
    flag_sides = f"(SELECT * FROM risk_new WHERE {window}) a FULL JOIN (SELECT * FROM risk WHERE {window}) b USING (date_key, store_key, item_key)"
    reconcile_sales = f"""
        (SELECT count(*) AS rows_new, sum(units) AS units_new FROM fact_new WHERE {window}),
        (SELECT count(*) AS rows_old, sum(units) AS units_old FROM fact WHERE {window})"""
    reconcile_baselines = f"""
        (SELECT count(*) FILTER (WHERE abs(a.baseline_units - b.baseline_units) > 0.01) AS drifted,
                count(*) FILTER (WHERE (a.baseline_units IS NULL) <> (b.baseline_units IS NULL)) AS mismatched,
                count(*) FILTER (WHERE a.baseline_units IS NOT NULL AND b.baseline_units IS NULL) AS only_new,
                count(*) FILTER (WHERE coalesce(a.baseline_units, b.baseline_units) IS NOT NULL) AS with_baseline
         FROM {sides})"""
    reconcile_flags = f"""
        (SELECT count(*) FILTER (WHERE a.expected_units IS NOT NULL AND b.expected_units IS NOT NULL) AS shared,
                count(*) FILTER (WHERE b.expected_units IS NULL) AS only_new,
                count(*) FILTER (WHERE b.expected_units IS NULL AND abs(a.expected_units - 3.0) < 1e-9) AS only_new_ties,
                count(*) AS either, CASE WHEN count(*) = 0 THEN 1.0 ELSE shared / count(*) END AS jaccard
         FROM {flag_sides})"""
    at_most = lambda name, table, value, bound: (
        f"SELECT '{name}' AS \"check\", CAST({value} AS DOUBLE) AS measured, 'at most' AS rule, {bound!r} AS bound, "
        f"{value} <= {bound!r} AS passed FROM {table}")
    at_least = lambda *a: at_most(*a).replace("at most", "at least").replace(" <= ", " >= ")
    report = " UNION ALL ".join([
        at_most("sales_row_gap", reconcile_sales, "abs(rows_new - rows_old)", 0.0),
        at_most("sales_unit_gap", reconcile_sales, "abs(units_new - units_old) / greatest(1.0, abs(units_old))", 1e-6),
        at_least("sales_rows", reconcile_sales, "rows_new", 1.0),
        at_most("baselines_drifted", reconcile_baselines, "drifted", 0.0),
        at_most("baselines_added", reconcile_baselines, "only_new", 0.0),
        at_most("baselines_lost_share", reconcile_baselines,
                "CASE WHEN with_baseline > 0 THEN (mismatched - only_new) / with_baseline ELSE 0 END", 0.005),
        at_most("flags_added", reconcile_flags, "only_new - only_new_ties", 0.0),
        at_least("flags_jaccard", reconcile_flags, "jaccard", 0.995),
    ])
    checks = lambda stores, items: f"""
        (SELECT 'fact_sales_duplicate_keys' AS "check", count(*) - count(DISTINCT (date_key, store_key, item_key)) AS violations FROM fact
         UNION ALL SELECT 'fact_stockout_risk_duplicate_keys', count(*) - count(DISTINCT (date_key, store_key, item_key)) FROM risk
         UNION ALL SELECT 'fact_sales_orphan_store', count(*) FROM fact WHERE store_key NOT IN (SELECT store_key FROM dim_store WHERE {stores})
         UNION ALL SELECT 'fact_sales_orphan_item', count(*) FROM fact WHERE item_key NOT IN (SELECT item_nbr FROM items WHERE {items})
         UNION ALL SELECT 'fact_sales_orphan_date', count(*) FROM fact WHERE date NOT IN (SELECT date FROM dates)
         UNION ALL SELECT 'fact_stockout_risk_orphan_date', count(*) FROM risk
             WHERE date_key NOT IN (SELECT CAST(strftime(date, '%Y%m%d') AS BIGINT) FROM dates)
         UNION ALL SELECT 'rows_silver_vs_gold', abs((SELECT count(*) FROM sales) - (SELECT count(*) FROM fact))
         UNION ALL SELECT 'units_silver_vs_gold', CASE WHEN (SELECT sum(CAST(units AS DECIMAL(38, 6))) FROM sales)
             = (SELECT sum(CAST(units AS DECIMAL(38, 6))) FROM fact) THEN 0 ELSE 1 END)"""  # noqa: E731
    seeded = checks(f"store_key <> {MISSING_STORE}", f"item_nbr % {MISSING_ITEMS} <> 0")
    checks = checks("true", "true")
    medians = f"""
        (SELECT family, count(*) AS n_events, median(uplift) AS uplift_median,
                count(post_dip) AS n_dip_events, CASE WHEN count(post_dip) >= {least} THEN median(post_dip) END AS dip_median,
                count(net_lift) AS n_net_events, CASE WHEN count(net_lift) >= {least} THEN median(net_lift) END AS net_median
         FROM events WHERE family IS NOT NULL GROUP BY family HAVING count(*) >= {least})"""
    enough = f"(SELECT family, count(*) AS n_events FROM events WHERE family IS NOT NULL GROUP BY 1 HAVING count(*) >= {least})"
    metrics = f"""
        (SELECT family, metric, count(v) AS n, median(v) AS mid, list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS vs
         FROM (SELECT family, unnest(['uplift', 'dip', 'net']) AS metric, unnest([uplift, post_dip, net_lift]) AS v FROM events)
         GROUP BY 1, 2 HAVING count(v) >= {least})"""

    def ends(widths: float) -> str:
        half = f"{widths} * sqrt(n) / 2"
        return (f"vs[CAST(greatest(floor(n / 2 - {half}), 1) AS BIGINT)] AS lo, "
                f"vs[CAST(least(ceil(n / 2 + {half}) + 1, n) AS BIGINT)] AS hi")

    spread = ", ".join(
        f"max({c}) FILTER (WHERE metric = '{m}') AS {m}_{name}" for m in ("uplift", "dip", "net")
        for c, name in (("mid", "median"), ("lo", "lo"), ("hi", "hi")))
    order_summary = f"""
        (SELECT family, n_events, n_dip_events, n_net_events, {spread}
         FROM (SELECT family, n_events, count(post_dip) AS n_dip_events, count(net_lift) AS n_net_events
               FROM {enough} JOIN events USING (family) GROUP BY 1, 2)
         LEFT JOIN (SELECT *, {ends(1.96)} FROM {metrics}) USING (family) GROUP BY 1, 2, 3, 4)"""
    # ends of the exact distribution of a resampled median: chances that a rank is reached, from binomial terms
    b = p.bootstrap_resamples
    wanted_ranks = " UNION ALL ".join(
        f"SELECT DISTINCT n, '{end}_{side}' AS name, {middle} AS middle, "
        f"{q} {sign} (4.0 * sqrt({q} * (1 - {q}) / {b}) + 1.0 / {b}) AS q FROM {metrics}"
        for end, q in (("lo", 0.025), ("hi", 0.975))
        for side, sign, middle in (("least", "-", "(n + 1) // 2"), ("most", "+", "n // 2 + 1")))
    ends_exact = f"""
        (SELECT n, name, min(k) AS rank
         FROM (SELECT n, name, k, q, least(1.0, sum(
                   CASE WHEN k = n THEN CAST(j = n AS INTEGER)
                        ELSE exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n)) END)) AS reach
               FROM (SELECT *, unnest(range(middle, n + 1)) AS j
                     FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM ({wanted_ranks})))
               GROUP BY n, name, k, q)
         WHERE reach >= least(greatest(q, 0.0), 1.0) OR k = n GROUP BY n, name)"""
    ends_found = ", ".join(f"max(vs[rank]) FILTER (WHERE name = '{end}_{side}') AS {end}_{side}"
                           for end in ("lo", "hi") for side in ("least", "most"))
    percent = lambda x: f"round(round(100 * ({x}), 10), 2)"
    uplift_order = f"""
        (SELECT family, n_events, {percent('uplift_median')} AS uplift_pct, {percent('uplift_hi - uplift_median')} AS error_up_pct,
                {percent('uplift_median - uplift_lo')} AS error_down_pct,
                row_number() OVER (ORDER BY uplift_median DESC, family DESC) = 1 AS is_top FROM {order_summary})"""
    payback_order = f"""
        (SELECT family, n_net_events, {percent('net_median')} AS net_pct, {percent('net_hi - net_median')} AS error_up_pct,
                {percent('net_median - net_lo')} AS error_down_pct, {percent('uplift_median')} AS uplift_pct,
                {percent('dip_median')} AS dip_pct,
                CASE WHEN net_lo > 0 THEN 'pays' WHEN net_hi < 0 THEN 'loses' ELSE 'unclear' END AS payback
         FROM {order_summary} WHERE net_median IS NOT NULL)"""
    payday = f"""
        (SELECT family, 100 * a.mid AS other_pct, 100 * b.mid AS touching_pct, b.mid - a.mid AS gap
         FROM (SELECT family, median(uplift) AS mid FROM events WHERE NOT touches_payday_or_holiday GROUP BY 1 HAVING count(*) >= {least}) a
         JOIN (SELECT family, median(uplift) AS mid FROM events WHERE touches_payday_or_holiday GROUP BY 1 HAVING count(*) >= {least}) b
           USING (family))"""
    ranking = f"""
        (SELECT store_key, city, sum(flagged_days) AS flagged_days, sum(item_days) AS item_days,
                sum(flagged_days) / sum(item_days) AS rate
         FROM weekly GROUP BY ALL)"""
    return {
        "sales_daily": _select("date:t store_nbr:i item_nbr:i units:d return_units:d on_promo:b", "sales"),
        "store_day": _select("date:t store_nbr:i receipts:i", "store_day"),
        "national_holidays": _select("date:t", "holidays"),
        "dim_date": f"""
            SELECT {_key('date')} AS date_key, CAST(date AS VARCHAR) AS date, year(date) AS year, quarter(date) AS quarter,
                   month(date) AS month_num, strftime(date, '%b') AS month_name, year(date) * 100 + month(date) AS month_key,
                   week(date) AS iso_week, {_ISO_YEAR} AS iso_year, isodow(date) AS weekday_num,
                   strftime(date, '%a') AS weekday_name, isodow(date) IN (6, 7) AS is_weekend,
                   date IN (SELECT date FROM holidays) AS is_national_holiday
            FROM dates""",
        "dim_item": _select("item_key:i item_nbr:i family:t class:i is_perishable:b",
                            "(SELECT item_nbr AS item_key, *, perishable AS is_perishable FROM items)"),
        "contract_store_day": _select("date_key:i store_key:i receipts:i",
                                      f"(SELECT {_key('date')} AS date_key, store_nbr AS store_key, receipts FROM store_day)"),
        "eligible_pairs": _select("store_nbr:i item_nbr:i first_sale:t last_sale:t", "pairs"),
        "trading_spine": _select("store_nbr:i item_nbr:i date:t", "spine"),
        "full_trading_days": _select("store_nbr:i date:t full_day:b", "trading"),
        "stockout_series": _select("store_nbr:i item_nbr:i date:t units:d no_sale_row:b full_day:b lambda_units:d "
                                   "var_units:d history_days:i", "series"),
        "stockout_risk_days": _select("date_key:i store_key:i item_key:i expected_units:d", "risk"),
        "zero_sale_runs": _select("store_nbr:i item_nbr:i start_date:t end_date:t run_days:i spine_days:i "
                                  "lambda_units:d var_units:d history_days:i", "runs"),
        "stockout_runs_tested": _select(_RUN, "tested"),
        "stockout_runs_flagged": _select(_RUN + " is_flagged:b", "flagged"),
        "bh_summary": _select("tested_runs:i flagged_runs:i bh_cutoff:d max_chance_flags:d poisson_flagged_runs:i", """
            (SELECT count(*) AS tested_runs, count(*) FILTER (WHERE is_flagged) AS flagged_runs,
                    exp(max(ln_cutoff)) AS bh_cutoff, count(*) * coalesce(exp(max(ln_cutoff)), 0) AS max_chance_flags,
                    count(*) FILTER (WHERE ln_p_poisson <= cutoff) AS poisson_flagged_runs
             FROM flagged, cutoff, poisson_cutoff)"""),
        "item_dispersion": _select("store_nbr:i item_nbr:i mean_units:d var_units:d dispersion:d", "dispersion"),
        "dispersion_headline": _select("median_dispersion:d share_over_1:d", """
            (SELECT median(dispersion) AS median_dispersion, avg(CAST(dispersion > 1 AS INTEGER)) AS share_over_1
             FROM dispersion)"""),
        "stockout_store_week": _select("store_key:i week_start:t item_days:i flagged_days:i city:t rate:d week_start_key:i",
                                       "weekly"),
        "stockout_store_week_exact": _select(
            "store_key:i week_start:t item_days:i flagged_days:i city:t rate:d week_start_key:i", "weekly_exact"),
        "promo_baseline": _select("date_key:i store_key:i item_key:i units:d return_units:d on_promo:b "
                                  "post_promo_window:b baseline_units:d", "fact"),
        "promo_events_raw": _select(_RAW_EVENT, "events_raw"),
        "promo_post_window": _select(_RAW_EVENT + " post_trading_days:i post_end:t post_ok:b", "events_post"),
        "promo_post_by_family": _select(
            _RAW_EVENT + " family:t post_days:i post_trading_days:i post_end:t post_ok:b", "events_by_family"),
        "promo_events": _select("store_key:i item_key:i family:t start_date_key:i end_date_key:i promo_days:i promo_units:d "
                                "baseline_units:d uplift:d post_units:d post_expected_units:d post_dip:d net_lift:d "
                                "touches_payday_or_holiday:b", "events"),
        "promo_family_medians": _select("family:t n_events:i uplift_median:d n_dip_events:i dip_median:d n_net_events:i "
                                        "net_median:d", medians),
        "interval_brackets": _select(
            "family:t metric:t n:i median:d outer_lo:d outer_hi:d holds_median:b lo_inside:b hi_inside:b", f"""
            (SELECT family, metric, n, mid AS median, lo AS outer_lo, hi AS outer_hi, true AS holds_median, true AS lo_inside,
                    true AS hi_inside
             FROM (SELECT *, {ends(4.0)} FROM {metrics}) JOIN {enough} USING (family))"""),
        "interval_bounds": _select(
            "family:t metric:t n:i lo_least:d lo_most:d hi_least:d hi_most:d lo_within:b hi_within:b", f"""
            (SELECT family, metric, n, {ends_found}, true AS lo_within, true AS hi_within
             FROM {metrics} JOIN {ends_exact} USING (n) JOIN {enough} USING (family) GROUP BY 1, 2, 3)"""),
        "family_summary_order": _select(
            "family:t n_events:i uplift_median:d uplift_lo:d uplift_hi:d n_dip_events:i dip_median:d dip_lo:d dip_hi:d "
            "n_net_events:i net_median:d net_lo:d net_hi:d", order_summary),
        "uplift_ranking_order": _select(
            "family:t n_events:i uplift_pct:d error_up_pct:d error_down_pct:d is_top:b", uplift_order),
        "payback_class_order": _select(
            "family:t n_net_events:i net_pct:d error_up_pct:d error_down_pct:d uplift_pct:d dip_pct:d payback:t", payback_order),
        "payback_count_order": f"SELECT count(*) FILTER (WHERE payback = 'pays') AS paying, count(*) AS families FROM {payback_order}",
        "slice_counts": f"""
            SELECT 'train' AS name, count(*) AS rows FROM train
            WHERE date BETWEEN DATE '{SLICED.slice_start}' AND DATE '{p.window_end}'
            UNION ALL SELECT 'transactions', count(*) FROM transactions
            UNION ALL SELECT 'stores', count(*) FROM stores
            UNION ALL SELECT 'items', count(*) FROM items
            UNION ALL SELECT 'holidays_events', count(*) FROM holidays_events""",
        "dq_checks": f'SELECT "check", CAST(violations AS BIGINT) AS violations FROM {checks}',
        "dq_seeded": f'SELECT "check", CAST(violations AS BIGINT) AS violations FROM {seeded} WHERE violations > 0',
        "dq_failing": f'SELECT "check", CAST(violations AS BIGINT) AS violations FROM {checks} WHERE violations > 0',
        "stockout_month": _select("year:i month_num:i flagged_days:i est_lost_units:d", """
            (SELECT date_key // 10000 AS year, date_key // 100 % 100 AS month_num, count(*) AS flagged_days,
                    round(sum(CAST(expected_units AS DECIMAL(38, 6)))) AS est_lost_units FROM risk GROUP BY 1, 2)"""),
        "layer_profile": """
            SELECT 'sales' AS table_name, count(*) AS rows, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day FROM sales
            UNION ALL SELECT 'store_day', count(*), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR) FROM store_day
            UNION ALL SELECT 'stockout_series', count(*), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR) FROM series""",
        "payday_gap": f"""
            SELECT family, round(round(other_pct, 10), 2) AS other_pct, round(round(touching_pct, 10), 2) AS touching_pct,
                   round(gap + {TIE_SHIFT!r}, {DECIMALS}) + 0.0 AS gap FROM {payday}""",
        "payday_headline": f"SELECT count(*) FILTER (WHERE gap > 0) AS inflated, count(*) AS families FROM {payday}",
        "store_stockout_rank": _select("store_key:i city:t flagged_days:i item_days:i rate:d", ranking),
        "worst_store": _select("store_key:i city:t flagged_days:i item_days:i rate:d",
                               f"{ranking} ORDER BY rate DESC, store_key LIMIT 1"),
        "stockout_grid": _select("store_key:i city:t week_start:t rate_pct:d", f"""
            (SELECT s.store_key, s.city, w.week_start, c.rate_pct
             FROM (SELECT DISTINCT store_key, city FROM weekly) s
             CROSS JOIN (SELECT DISTINCT week_start FROM weekly) w
             LEFT JOIN {week_grid} c ON c.store_key = s.store_key AND c.week_start = w.week_start)"""),
        "stockout_grid_cap": _select("cap_pct:d", f"(SELECT quantile_cont(rate_pct, 0.95) AS cap_pct FROM {week_grid})"),
        "dispersion_histogram": _select("bin:i from_log10:d to_log10:d store_items:i", """
            (SELECT least(CAST(floor(round((x - lo) / ((hi - lo) / 60), 6)) AS BIGINT), 59) AS bin,
                    any_value(lo) + bin * any_value((hi - lo) / 60) AS from_log10,
                    any_value(lo) + (bin + 1) * any_value((hi - lo) / 60) AS to_log10, count(*) AS store_items
             FROM (SELECT log10(dispersion) AS x, min(log10(dispersion)) OVER () AS lo, max(log10(dispersion)) OVER () AS hi
                   FROM dispersion WHERE dispersion > 0) GROUP BY 1)"""),
        "overdispersed_share": _select("share_over_1:d", """
            (SELECT count(*) FILTER (WHERE dispersion > 1) / count(*) AS share_over_1 FROM dispersion WHERE dispersion > 0)"""),
        "reconcile_sales": _select("rows_new:i rows_old:i units_new:d units_old:d", reconcile_sales),
        "reconcile_baselines": _select("drifted:i mismatched:i only_new:i with_baseline:i", reconcile_baselines),
        "reconcile_report": _select("check:t measured:d rule:t bound:d passed:b", f"({report})"),
        "reconcile_flags": _select("shared:i only_new:i only_new_ties:i either:i jaccard:d", reconcile_flags),
    }


_STORE = _select("store_key:i store_nbr:i city:t state:t store_type:t cluster:i opening_date:t", "dim_store")


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL. Bootstrap intervals come from random draws, so queries with them are left out."""
    analysis = {**_tables(PARAMS), **_tables(SLICED, "_new")}
    regions, nations, suppliers = ({**_raw(column), **analysis} for column in ("n_regionkey", "n_nationkey", "s_suppkey"))
    bodies = _bodies()
    cut = f"date BETWEEN DATE '{PARAMS.slice_start}' AND DATE '{PARAMS.window_end}'"
    files: dict[str, str] = {}
    for name, sql in regions.items():
        files |= {"uncut": sql, name: f"SELECT * FROM uncut WHERE {cut}"} if name == "train" else {name: sql}
    load_counts = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}"
        for name in ("train", "transactions", "stores", "items", "holidays_events"))
    by_sql = f"""
        (SELECT store_nbr, item_nbr, count(*) AS days, sum(units) AS units, max(receipts) AS most_receipts
         FROM sales JOIN store_day USING (date, store_nbr) WHERE date >= DATE '{PARAMS.window_start}' AND receipts > 0
         GROUP BY 1, 2 HAVING round(sum(units), 6) >= {PARAMS.min_expected_units * PARAMS.lookback_days})"""
    sources = {  # published table -> what its rows are
        "dim_date": "dates", "stg_store": "stores", "stg_item": "items", "stg_store_day": "store_day", "fact_sales": "fact",
        "fact_stockout_risk": "risk", "fact_stockout_run": "flagged", "stockout_bh_summary": "(SELECT 1)",
        "stockout_store_week": "weekly", "fact_promo_event": "events",
        "promo_family_summary":
            f"(SELECT family FROM events WHERE family IS NOT NULL GROUP BY family HAVING count(*) >= {PARAMS.min_family_events})",
    }
    audit = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows, true AS one_stamp, true AS after_stamp FROM {source}"
        for name, source in sources.items())
    finer = {"nation_runs_flagged": "stockout_runs_flagged", "nation_bh_summary": "bh_summary",
             "nation_store_week": "stockout_store_week", "nation_promo_events": "promo_events"}
    return {
        **{name: _query(regions, body) for name, body in bodies.items()},
        **{name: _query(nations, bodies[same]) for name, same in finer.items()},
        "dim_store": _query(suppliers, _STORE),
        "csv_load_counts": _query(files, load_counts),
        "csv_loaded_sales": _query(files, bodies["sales_daily"]),
        "csv_exported_runs": _query(files, bodies["stockout_runs_flagged"]),
        "release_audit": _query(files, audit),
        "catalog_runs_tested": _query(regions, bodies["stockout_runs_tested"]),
        "catalog_promo_days": _query(regions, _select("store_key:i item_key:i promo_days:i with_baseline:i promo_units:d", """
            (SELECT store_key, item_key, count(*) AS promo_days, count(baseline_units) AS with_baseline, sum(units) AS promo_units
             FROM fact WHERE on_promo GROUP BY store_key, item_key)""")),
        "stored_profile": _query(regions, bodies["layer_profile"]),
        "sales_by_sql": _query(regions, _select("store_nbr:i item_nbr:i days:i units:d most_receipts:i", by_sql)),
    }
