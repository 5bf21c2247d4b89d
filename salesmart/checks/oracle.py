"""SQL twins of the registered queries, for DuckDB over the same Parquet tables.

Written from the rules, not from the Spark code. ``FRAGMENTS`` are named subqueries;
``_sql`` prepends those a statement needs.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-11-04'"
PERIOD = "date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
REASONS = """CASE WHEN NOT coalesce(revenue > 0, false) THEN 'removed_negative_revenue'
    WHEN NOT coalesce(quantity > 0, false) THEN 'removed_zero_quantity'
    WHEN NOT coalesce(profit <= revenue, false) THEN 'removed_invalid_profit' END"""
AGE_GROUP = """CASE WHEN age IS NULL THEN NULL WHEN age <= 25 THEN '18-25' WHEN age <= 35 THEN '26-35'
    WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55' ELSE '56+' END"""
DAY = """coalesce(try_cast(sale_date AS DATE),
    CAST(try_strptime(sale_date, ['%m/%d/%Y', '%d.%m.%Y', '%Y%m%d']) AS DATE))"""
FIRST = """QUALIFY row_number() OVER (PARTITION BY sale_id ORDER BY product_id NULLS FIRST,
    store_id NULLS FIRST, sale_date NULLS FIRST, revenue NULLS FIRST) = 1"""
MONTHS_HE = (
    "['ינואר','פברואר','מרץ','אפריל','מאי','יוני','יולי','אוגוסט','ספטמבר','אוקטובר','נובמבר','דצמבר']"
)


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _likeliest(m: str) -> str:
    """Where the likelihood of a first-order autoregression is largest, by halving: its slope has one root in (-1, 1)."""
    middle = "((b[1] + b[2]) / 2)"
    slope = f"n * ({m}b - {m}c * {middle}) * (1 - {middle} * {middle}) - {middle} * ({m}a - 2 * {m}b * {middle} + {m}c * {middle} * {middle})"
    halves = f"CASE WHEN {slope} > 0 THEN [{middle}, b[2]] ELSE [b[1], {middle}] END"
    return f"list_reduce([[CAST(-1 AS DOUBLE), CAST(1 AS DOUBLE)]] || list_transform(range(80), lambda k: [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)]), lambda b, x: {halves})[1]"


FRAGMENTS = {
    "stores_raw": """
        SELECT s_suppkey AS store_id, s_name AS store_name, n_name AS city, r_name AS region,
            CASE s_suppkey % 3 WHEN 0 THEN 'branch' WHEN 1 THEN 'mall' ELSE 'online' END AS store_type,
            CAST(DATE '1990-01-01' + CAST(s_suppkey % 3650 AS INTEGER) AS DATE) AS opening_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "products_raw": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
            CAST(p_retailprice AS DECIMAL(12,2)) AS price,
            CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(40 + p_partkey % 31 AS DECIMAL(4,0))
                * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS cost
        FROM part""",
    "customers_raw": f"""
        SELECT customer_id, customer_name, gender, age, {AGE_GROUP} AS age_group, email, city FROM (
            SELECT c_custkey AS customer_id, c_name AS customer_name,
                CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
                CAST(18 + c_custkey % 58 AS INTEGER) AS age,
                'customer' || c_custkey || '@example.com' AS email, n_name AS city
            FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "sales_raw": """
        SELECT *, CAST(revenue - cost AS DECIMAL(12,2)) AS profit FROM (
            SELECT *, CAST(revenue * CAST(40 + product_id % 31 AS DECIMAL(4,0))
                * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS cost FROM (
                SELECT l_orderkey * 10 + l_linenumber AS sale_id, CAST(l_shipdate AS DATE) AS sale_date,
                    l_suppkey AS store_id, l_partkey AS product_id, o_custkey AS customer_id,
                    CAST(l_quantity AS INTEGER) AS quantity,
                    CAST(CAST(l_extendedprice AS DECIMAL(12,2))
                        * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS revenue
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "sales_first": f"SELECT * FROM sales_raw {FIRST}",
    "sales_clean": """
        SELECT * FROM sales_first
        WHERE sale_date IS NOT NULL AND revenue > 0 AND quantity > 0 AND profit <= revenue""",
    "dates": """
        SELECT CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS date_id, date,
            CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month,
            CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
            monthname(date) AS month_name, 'Q' || quarter(date) AS quarter_name,
            dayname(date) AS day_of_week, isodow(date) >= 6 AS is_weekend, false AS is_holiday
        FROM (SELECT DISTINCT sale_date AS date FROM sales_clean)""",
    "fact": """
        SELECT sale_id, date_id, store_id, product_id, customer_id, quantity, revenue, cost, profit,
            date, year, month, quarter, month_name, quarter_name
        FROM sales_clean JOIN dates ON sale_date = date
        WHERE store_id IN (SELECT store_id FROM stores_raw)
            AND product_id IN (SELECT product_id FROM products_raw)
            AND customer_id IN (SELECT customer_id FROM customers_raw)""",
    "facts": f"SELECT * FROM fact WHERE {PERIOD}",
    # the extract with faults
    "stores_dirty": """
        SELECT * FROM stores_raw UNION ALL
        SELECT store_id, store_name || ' copy', city, region, store_type, opening_date
        FROM stores_raw WHERE region = 'ASIA'""",
    "customers_dirty": """
        SELECT customer_id, customer_name, gender, age, age_group, email,
            CASE WHEN customer_id % 50 = 0 THEN NULL ELSE city END AS city FROM customers_raw""",
    "sales_dirty": """
        SELECT sale_id,
            CASE WHEN sale_id % 101 = 0 THEN NULL WHEN sale_id % 103 = 0 THEN 'no date'
                WHEN sale_id % 4 = 1 THEN strftime(sale_date, '%m/%d/%Y')
                WHEN sale_id % 4 = 2 THEN strftime(sale_date, '%d.%m.%Y')
                WHEN sale_id % 4 = 3 THEN strftime(sale_date, '%Y%m%d')
                ELSE CAST(sale_date AS VARCHAR) END AS sale_date,
            CASE WHEN sale_id % 131 = 0 THEN -1 ELSE store_id END AS store_id,
            CASE WHEN sale_id % 137 = 0 THEN NULL ELSE product_id END AS product_id,
            customer_id,
            CASE WHEN sale_id % 113 = 0 THEN 0 ELSE quantity END AS quantity,
            CASE WHEN sale_id % 107 = 0 THEN -revenue WHEN sale_id % 109 = 0 THEN NULL ELSE revenue END AS revenue,
            cost,
            CASE WHEN sale_id % 127 = 0 THEN revenue + 1 ELSE profit END AS profit
        FROM sales_raw""",
    "dirty_first": f"SELECT * FROM sales_dirty {FIRST}",
    "dirty_read": f"SELECT *, {DAY} AS day FROM dirty_first",
    "dirty_dated": "SELECT * REPLACE (day AS sale_date) FROM dirty_read WHERE day IS NOT NULL",
    "dirty_judged": f"SELECT *, {REASONS} AS reason FROM dirty_dated",
    "dirty_clean": """
        SELECT sale_id, CAST(sale_date AS DATE) AS sale_date, store_id, product_id, customer_id,
            quantity, revenue, cost, profit FROM dirty_judged WHERE reason IS NULL""",
    "dirty_dates": """
        SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS date_id
        FROM (SELECT DISTINCT sale_date AS date FROM dirty_clean)""",
    # inventory
    "levels": """
        SELECT store_id, product_id,
            CAST((7 * store_id + 13 * product_id) % 60 AS INTEGER) AS current_quantity,
            CAST(5 + product_id % 10 AS INTEGER) AS min_quantity,
            CAST(CASE WHEN product_id % 4 = 0 THEN 0 ELSE 60 + product_id % 90 END AS INTEGER) AS max_quantity,
            CAST(product_id % 40 AS INTEGER) AS reorder_point,
            CAST(max(date) AS TIMESTAMP) AS last_updated
        FROM fact GROUP BY store_id, product_id HAVING sum(quantity) >= 15""",
    "central": """
        SELECT product_id, CAST(17 * product_id % 500 AS INTEGER) AS current_stock
        FROM products_raw WHERE category <> 'PROMO'""",
    "sold": f"""
        SELECT f.store_id, store_name, f.product_id, product_name, p.cost AS unit_cost,
            CAST(sum(quantity) AS BIGINT) AS total_qty, count(DISTINCT date) AS sales_days
        FROM fact f JOIN stores_raw s ON f.store_id = s.store_id JOIN products_raw p ON f.product_id = p.product_id
        WHERE date >= {AS_OF} - INTERVAL 60 DAY
        GROUP BY f.store_id, store_name, f.product_id, product_name, p.cost""",
    "wanted": """
        SELECT sold.*, coalesce(current_quantity, 0) AS current_stock,
            coalesce(reorder_point, 0) AS stored_reorder, coalesce(max_quantity, 0) AS stored_max
        FROM sold LEFT JOIN levels USING (store_id, product_id)""",
    "sized": """
        SELECT *, daily AS d,
            CAST(trunc(greatest(1.0, sqrt(2 * (daily * 365) * 50 / greatest(hold, 1.0)))) AS INTEGER) AS eoq,
            CAST(trunc(daily * 7 * CAST(1.1 AS DOUBLE)) AS INTEGER) AS computed
        FROM (SELECT *, CAST(total_qty AS DOUBLE) / greatest(sales_days, 1) AS daily,
                greatest(CAST(unit_cost AS DOUBLE), 1.0) * CAST(0.2 AS DOUBLE) AS hold FROM wanted)""",
    "optimised": """
        SELECT store_id, store_name, product_id, product_name, current_stock,
            round_even(d, 2) AS daily_demand, eoq, computed AS reorder_point,
            greatest(1, CAST(trunc(computed * CAST(0.8 AS DOUBLE)) AS INTEGER)) AS min_level,
            computed + eoq AS max_level
        FROM sized""",
    "suggestions": """
        SELECT l.store_id, store_name, l.product_id, product_name, current_quantity AS current_stock,
            reorder_point, greatest(0, max_quantity - current_quantity) AS suggested_order_qty
        FROM levels l JOIN stores_raw s ON l.store_id = s.store_id
            JOIN products_raw p ON l.product_id = p.product_id
        WHERE current_quantity <= reorder_point""",
    "orders_due": """
        SELECT store_id, store_name, product_id, product_name, current_stock, rop AS reorder_point, eoq,
            greatest(eoq, CASE WHEN stored_max > 0 THEN stored_max ELSE rop + eoq END - current_stock)
                AS suggested_order_qty
        FROM (SELECT *, CASE WHEN stored_reorder > 0 THEN stored_reorder ELSE computed END AS rop FROM sized)
        WHERE current_stock <= rop""",
    "low_alerts": """
        SELECT CAST(NULL AS BIGINT) AS user_id, store_id, 'low_stock' AS type,
        'הזמנה אוטומטית - ' || product_name AS title,
        'נוצרה הצעת הזמנה אוטומטית של ' || suggested_order_qty || ' יחידות עבור ' || product_name || ' בסניף '
            || store_name || '.' AS message, 'warning' AS severity, false AS is_read FROM suggestions""",
    "order_alerts": """
        SELECT CAST(NULL AS BIGINT) AS user_id, store_id, 'auto_order' AS type,
        'הזמנה אוטומטית - ' || product_name AS title,
        'הומלצה הזמנה אוטומטית של ' || suggested_order_qty || ' יחידות עבור ' || product_name || ' בסניף '
            || store_name || '.' AS message, 'warning' AS severity, false AS is_read FROM orders_due""",
    # forecasts
    "monthly": """
        SELECT year, month, month_name, sum(revenue) AS revenue, sum(profit) AS profit
        FROM facts GROUP BY year, month, month_name""",
    "indexed": "SELECT *, row_number() OVER (ORDER BY year, month) - 1 AS period FROM monthly",
    "fit": """
        SELECT count(*) AS months,
            regr_slope(CAST(revenue AS DOUBLE), period) AS revenue_slope,
            regr_intercept(CAST(revenue AS DOUBLE), period) AS revenue_intercept,
            regr_r2(CAST(revenue AS DOUBLE), period) AS revenue_r2,
            regr_slope(CAST(profit AS DOUBLE), period) AS profit_slope,
            regr_intercept(CAST(profit AS DOUBLE), period) AS profit_intercept,
            regr_r2(CAST(profit AS DOUBLE), period) AS profit_r2,
            max(make_date(year, month, 1)) AS last_month
        FROM indexed""",
    "ahead": """
        SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
            revenue_intercept + revenue_slope * (months - 1 + step) AS revenue,
            profit_intercept + profit_slope * (months - 1 + step) AS profit,
            monthname(d) AS month_name, true AS is_forecast
        FROM (SELECT *, CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE) AS d
              FROM fit, generate_series(1, 6) AS g(step))""",
    "by_store": """
        SELECT store_id, year, month, sum(revenue) AS revenue, sum(profit) AS profit,
            CAST(row_number() OVER (PARTITION BY store_id ORDER BY year, month) - 1 AS INTEGER) AS period
        FROM facts GROUP BY store_id, year, month""",
    "store_fit": """
        SELECT store_id, count(*) AS months, max(make_date(year, month, 1)) AS last_month,
            regr_slope(CAST(revenue AS DOUBLE), period) AS rs, regr_intercept(CAST(revenue AS DOUBLE), period) AS ri,
            regr_slope(CAST(profit AS DOUBLE), period) AS ps, regr_intercept(CAST(profit AS DOUBLE), period) AS pi
        FROM by_store GROUP BY store_id HAVING count(*) >= 3""",
    "ar_steps": f"""
        SELECT store_id, period, {dbl("revenue")} AS r, {dbl("profit")} AS p, make_date(year, month, 1) AS month_start,
            {dbl("revenue")} - lag({dbl("revenue")}) OVER w AS dr, {dbl("profit")} - lag({dbl("profit")}) OVER w AS dp
        FROM by_store WINDOW w AS (PARTITION BY store_id ORDER BY period)""",
    "ar_pairs": """
        SELECT *, lag(dr) OVER w AS lr, lag(dp) OVER w AS lp
        FROM ar_steps WINDOW w AS (PARTITION BY store_id ORDER BY period)""",
    "ar_slopes": """
        SELECT store_id, greatest(-1, least(1, sum(dr * lr) / sum(lr * lr))) AS fr,
            greatest(-1, least(1, sum(dp * lp) / sum(lp * lp))) AS fp, max(period) AS period
        FROM ar_pairs GROUP BY store_id HAVING count(*) >= 4""",
    "ar_ahead": """
        SELECT store_id, CAST(month_start + to_months(CAST(step AS INTEGER)) AS DATE) AS d,
            r + dr * list_sum([fr ** k FOR k IN range(1, step + 1)]) AS r,
            p + dp * list_sum([fp ** k FOR k IN range(1, step + 1)]) AS p
        FROM ar_pairs JOIN ar_slopes USING (store_id, period), generate_series(1, 6) AS g(step)""",
    "ml_sums": """
        SELECT store_id, max(period) AS period, count(dr) AS n,
            sum(dr * dr) AS ra, sum(dr * lr) AS rb, sum(lr * lr) - arg_min(dr, period) ** 2 AS rc,
            sum(dp * dp) AS pa, sum(dp * lp) AS pb, sum(lp * lp) - arg_min(dp, period) ** 2 AS pc
        FROM ar_pairs GROUP BY store_id HAVING count(*) >= 4""",
    "ml_slopes": f"SELECT store_id, period, {_likeliest('r')} AS fr, {_likeliest('p')} AS fp FROM ml_sums",
    "ml_ahead": """
        SELECT store_id, CAST(month_start + to_months(CAST(step AS INTEGER)) AS DATE) AS d,
            r + dr * list_sum([fr ** k FOR k IN range(1, step + 1)]) AS r,
            p + dp * list_sum([fp ** k FOR k IN range(1, step + 1)]) AS p
        FROM ar_pairs JOIN ml_slopes USING (store_id, period), generate_series(1, 6) AS g(step)""",
    "calendar_lines": f"""
        SELECT store_id, regr_slope({dbl("revenue")}, m) AS rs, regr_intercept({dbl("revenue")}, m) AS ri,
            regr_slope({dbl("profit")}, m) AS ps, regr_intercept({dbl("profit")}, m) AS pi, max(m) AS m
        FROM (SELECT *, year * 12 + month - 1 AS m FROM by_store) GROUP BY store_id HAVING count(*) >= 3""",
    # customers
    "features": f"""
        SELECT customer_id, age_group, gender, count(DISTINCT sale_id) AS transactions,
            {dbl("sum(revenue)")} AS total_revenue, {ratio("sum(revenue)", "count(revenue)")} AS avg_order_value,
            {big("sum(quantity)")} AS total_quantity
        FROM facts JOIN customers_raw USING (customer_id) GROUP BY customer_id, age_group, gender""",
    "insights": f"""
        SELECT age_group, gender, count(DISTINCT customer_id) AS customer_count, sum(revenue) AS revenue,
            {ratio("sum(revenue)", "count(*)")} AS avg_revenue
        FROM facts JOIN customers_raw USING (customer_id) GROUP BY age_group, gender""",
    "daily": f"""
        SELECT date, {dbl("sum(revenue)")} AS daily_revenue, {big("sum(quantity)")} AS daily_quantity,
            count(DISTINCT sale_id) AS daily_transactions FROM facts GROUP BY date""",
    "pattern": f"""
        SELECT month, month_name, {ratio("sum(revenue)", "count(*)")} AS avg_revenue,
            {ratio("sum(profit)", "count(*)")} AS avg_profit, count(*) AS year_count
        FROM monthly GROUP BY month, month_name""",
    "by_category": f"""
        SELECT category, sum(revenue) AS revenue, sum(profit) AS profit, {big("sum(quantity)")} AS quantity
        FROM facts JOIN products_raw USING (product_id) GROUP BY category""",
    # feed
    "notes": """
        SELECT event_id AS notification_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
            CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 10 END AS store_id, event_type AS type,
            'Event ' || event_type AS title, props AS message,
            CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
            event_id % 2 = 0 AS is_read, ts AS created_at
        FROM events""",
    "accounts": """
        SELECT store_id + 1 AS user_id, 'store_' || store_id AS username, 'store_manager' AS role, store_id, region,
            CAST(DATE '2020-01-01' + CAST(store_id % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
            CASE WHEN store_id % 2 = 0 THEN CAST(DATE '2020-01-01' + CAST(store_id % 365 AS INTEGER) AS TIMESTAMP)
                + INTERVAL 90 MINUTE END AS last_login,
            store_id % 5 <> 0 AS is_active
        FROM stores_raw
        UNION ALL SELECT 0, 'admin', 'admin', NULL, NULL, TIMESTAMP '2019-12-31 08:00:00', NULL, true""",
}

# the same over all dates


# K-means as one statement: ten starts drawn by hashes, rounds by recursion until no customer moves.
_SCORED = ("transactions", "total_revenue", "avg_order_value", "total_quantity")


def _away(point: str, centre: str) -> str:
    return " + ".join(f"({point}[{i}] - {centre}[{i}]) * ({point}[{i}] - {centre}[{i}])" for i in range(1, 5))


def _distances(centres: str) -> str:
    return f"list_transform({centres}, lambda c: {_away('z', 'c')})"


def _nearest(centres: str) -> str:
    return f"list_position({_distances(centres)}, list_min({_distances(centres)}))"


def _wait(turn: int) -> str:
    return f"-ln((CAST('0x' || substr(md5('42:' || s || ':{turn}:' || customer_id), 1, 13) AS UBIGINT) + 1) / CAST(4503599627370496 AS DOUBLE))"


FRAGMENTS["scores"] = f"""
    SELECT *, [{", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)" for c in _SCORED)}] AS z FROM features"""
FRAGMENTS["seeds_0"] = f"SELECT s, [arg_min(z, {_wait(0)})] AS centres FROM scores, range(10) AS r(s) GROUP BY s"
for _turn in (1, 2, 3):
    FRAGMENTS[f"seeds_{_turn}"] = f"""
        SELECT s, list_append(centres, arg_min(z, {_wait(_turn)} / nullif(list_min({_distances("centres")}), 0))) AS centres
        FROM scores, seeds_{_turn - 1} GROUP BY s, centres"""
FRAGMENTS["lloyd"] = f"""
    SELECT 0 AS turn, s, CAST(NULL AS DOUBLE[][]) AS before, centres AS now, 1 AS moved FROM seeds_3
    UNION ALL
    SELECT turn + 1, s, now, list(centre ORDER BY place), CAST(sum(moved) AS INTEGER) FROM (
        SELECT turn, s, now, place, [{", ".join(f"avg(z[{i}])" for i in range(1, 5))}] AS centre, count(*) FILTER (WHERE gone) AS moved FROM (
            SELECT turn, s, now, z, {_nearest("now")} AS place, before IS NULL OR {_nearest("before")} <> {_nearest("now")} AS gone
            FROM lloyd, scores WHERE moved > 0 AND turn < 300)
        GROUP BY turn, s, now, place)
    GROUP BY turn, s, now"""
FRAGMENTS["best_centres"] = f"""
    SELECT arg_min(centres, cost) AS centres FROM (
        SELECT s, before AS centres, sum(list_min({_distances("before")})) AS cost FROM lloyd, scores WHERE moved = 0 GROUP BY s, before)"""
FRAGMENTS["placed"] = f"SELECT scores.*, {_nearest('centres')} AS place FROM scores, best_centres"
FRAGMENTS["segmented"] = """
    SELECT placed.*, CAST(segment AS INTEGER) AS segment
    FROM placed JOIN (SELECT place, row_number() OVER (ORDER BY avg(total_revenue)) - 1 AS segment FROM placed GROUP BY place) USING (place)"""
for _name in ("by_store", "store_fit", "features"):
    FRAGMENTS[f"{_name}_ever"] = re.sub(r"\b(facts|by_store)\b", lambda m: {"facts": "fact", "by_store": "by_store_ever"}[m[1]], FRAGMENTS[_name])


def _sql(statement: str) -> str:
    """Prepend the fragments that ``statement`` mentions, directly or not."""
    needed: set[str] = set()
    pending = [statement]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & FRAGMENTS.keys() - needed:
            needed.add(name)
            pending.append(FRAGMENTS[name])
    parts = [f"{name} AS ({FRAGMENTS[name]})" for name in FRAGMENTS if name in needed]
    recursive = "RECURSIVE " if "lloyd" in needed else ""
    return (f"WITH {recursive}{', '.join(parts)} " if parts else "") + statement


def _customers(rows: str, where: str = "true") -> str:
    return f"""SELECT age_group, gender, count(DISTINCT customer_id) AS customer_count, {dbl("sum(revenue)")} AS revenue,
        {ratio("sum(revenue)", "count(revenue)")} AS avg_revenue_per_customer
        FROM {rows} JOIN customers_raw USING (customer_id) WHERE {where} GROUP BY age_group, gender"""


def _kpis(source: str, where: str = "true") -> str:
    return f"""
        SELECT count(DISTINCT sale_id) AS total_transactions, {dbl("sum(revenue)")} AS total_revenue,
            {dbl("sum(profit)")} AS total_profit, {ratio("sum(profit)", "sum(revenue)")} * 100 AS profit_margin,
            {ratio("sum(revenue)", "count(revenue)")} AS avg_order_value,
            {big("sum(quantity)")} AS total_quantity
        FROM {source} WHERE {where} HAVING sum(revenue) IS NOT NULL"""


_MONEY = ", ".join(f"{dbl(c)} AS {c}" for c in ("revenue", "cost", "profit"))
_SALE = f"sale_id, sale_date, store_id, product_id, customer_id, quantity, {_MONEY}"
_MARGIN = f"{ratio('sum(profit)', 'sum(revenue)')} * 100"
_AVERAGE = ratio("sum(revenue)", "count(revenue)")
_EXPORT = """
    SELECT sale_id, date, store_name, s.city, region, product_name, category, customer_name, age_group,
        quantity, f.revenue, f.profit
    FROM facts f JOIN stores_raw s USING (store_id) JOIN products_raw USING (product_id)
        JOIN customers_raw USING (customer_id)
    """
_EXPORT_OUT = f"""SELECT sale_id, date, store_name, city, region, product_name, category, customer_name, age_group,
    quantity, {dbl('revenue')} AS revenue, {dbl('profit')} AS profit FROM ({_EXPORT})"""
_MONEY_TEXT = "regexp_replace(CAST(CAST({0} AS DECIMAL(12,2)) AS VARCHAR), '0$', '')"


def _iqr(source: str) -> str:
    return f"""
        SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
            outliers, round(100 * outliers / CAST(n AS DOUBLE), 6) AS outlier_pct
        FROM (SELECT q1, q3, lo, hi, count(*) AS n,
                count(*) FILTER (WHERE CAST(revenue AS DOUBLE) < lo OR CAST(revenue AS DOUBLE) > hi) AS outliers
            FROM {source}, (
                SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
                    SELECT quantile_cont(CAST(revenue AS DOUBLE), 0.25) AS q1,
                        quantile_cont(CAST(revenue AS DOUBLE), 0.75) AS q3 FROM {source}))
            GROUP BY q1, q3, lo, hi)"""


_COLUMNS = {
    "stores_dirty": ["store_id", "store_name", "city", "region", "store_type", "opening_date"],
    "products_raw": ["product_id", "product_name", "category", "brand", "price", "cost"],
    "customers_dirty": ["customer_id", "customer_name", "gender", "age", "age_group", "email", "city"],
    "sales_dirty": [
        "sale_id", "sale_date", "store_id", "product_id", "customer_id", "quantity", "revenue", "cost", "profit",
    ],
}
_NULLS = " UNION ALL ".join(
    f"""SELECT '{table.split("_")[0]}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls,
        count(*) AS n FROM {table}"""
    for table, names in _COLUMNS.items()
    for c in names
)


def _duplicates(dirty: bool) -> str:
    names = {
        "stores": "store_id", "products": "product_id", "customers": "customer_id", "sales": "sale_id",
    }
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{k}' AS key_column,
            {big(f"count(*) - count(DISTINCT coalesce({k}, -9))")} AS duplicates
            FROM {t + ("_dirty" if dirty and t != "products" else "_raw")}"""
        for t, k in names.items()
    )


_RULES = """SELECT count(*) FILTER (WHERE reason = 'removed_negative_revenue') AS removed_negative_revenue,
    count(*) FILTER (WHERE reason = 'removed_zero_quantity') AS removed_zero_quantity,
    count(*) FILTER (WHERE reason = 'removed_invalid_profit') AS removed_invalid_profit,
    count(reason) AS total_removed, count(*) - count(reason) AS rows_kept FROM dirty_judged"""
_REPORT = f"""
    SELECT 'missing_values' AS check_name, table_name, column_name AS item, CAST(nulls AS DOUBLE) AS value
        FROM ({_NULLS}) WHERE nulls > 0
    UNION ALL SELECT 'duplicates', table_name, key_column, CAST(duplicates AS DOUBLE) FROM ({_duplicates(True)})
    UNION ALL SELECT 'outliers', 'sales', 'outliers', CAST(outliers AS DOUBLE) FROM ({_iqr("dirty_first")})
    UNION ALL SELECT 'outliers', 'sales', 'outlier_pct', outlier_pct FROM ({_iqr("dirty_first")})
    UNION ALL SELECT 'data_types', 'sales', 'invalid_dates',
        CAST(count(*) - count(day) AS DOUBLE) FROM dirty_read
    UNION ALL SELECT 'business_rules', 'sales', item, CAST(value AS DOUBLE)
        FROM (UNPIVOT (SELECT * EXCLUDE (rows_kept) FROM ({_RULES})) ON COLUMNS(*) INTO NAME item VALUE value)"""

_UPDATED_LEVELS = f"""SELECT store_id, product_id, coalesce(l.current_quantity, o.current_stock) AS current_quantity,
    coalesce(o.min_level, l.min_quantity) AS min_quantity, coalesce(o.max_level, l.max_quantity) AS max_quantity,
    coalesce(o.reorder_point, l.reorder_point) AS reorder_point,
    CASE WHEN l.current_quantity IS NULL OR (o.eoq IS NOT NULL AND
        (o.min_level, o.max_level, o.reorder_point) IS DISTINCT FROM (l.min_quantity, l.max_quantity, l.reorder_point))
        THEN CAST({AS_OF} AS TIMESTAMP) ELSE l.last_updated END AS last_updated
    FROM levels l FULL JOIN optimised o USING (store_id, product_id)"""

ORACLE_BODIES = {
    "raw_sales_scan": f"SELECT {_SALE} FROM sales_raw",
    "warehouse_roundtrip": f"""SELECT sale_id, date_id, store_id, product_id, customer_id, quantity, {_MONEY},
        date, year, month FROM fact""",
    "export_sales": _EXPORT_OUT,
    "export_csv_roundtrip": _EXPORT_OUT,
    "export_workbook_roundtrip": _EXPORT_OUT,
    "workbook_customers": "SELECT * FROM customers_raw",
    "workbook_sales_scan": f"SELECT {_SALE} FROM sales_raw",
    "workbook_fact_sales": f"SELECT sale_id, date_id, store_id, product_id, customer_id, quantity, {_MONEY} FROM fact",
    "report_lines": f"""SELECT CAST(date AS VARCHAR) || ' | ' || store_name || ' | ' || product_name || ' | ' || quantity
        || ' | ₪' || {_MONEY_TEXT.format("revenue")} AS line
        FROM ({_EXPORT}) """,
    "dq_null_profile": f"""SELECT table_name, column_name, nulls,
        round(CAST(nulls AS DOUBLE) / n * 100, 6) AS null_pct FROM ({_NULLS})""",
    "dq_duplicate_keys": _duplicates(True),
    "dedupe_keep_first": f"SELECT {_SALE} FROM sales_first",
    "dq_iqr_outliers": _iqr("sales_first"),
    "dq_iqr_outliers_dirty": _iqr("dirty_first"),
    "dq_invalid_dates": """SELECT count(*) - count(day) AS invalid_dates, count(day) AS valid_dates FROM dirty_read""",
    "dq_missing_sale_ids": "SELECT count(*) FILTER (WHERE sale_id % 97 = 0) AS missing_ids, count(*) AS sales FROM sales_dirty",
    "dedupe_partial_order": f"""SELECT {_SALE} FROM sales_raw QUALIFY row_number() OVER (PARTITION BY sale_id
        ORDER BY store_id, sale_date, product_id, customer_id, quantity, revenue, cost, profit) = 1""",
    "dq_business_rules": _RULES,
    "dq_report": f"SELECT check_name, table_name, item, round(value, 6) AS value FROM ({_REPORT})",
    "dq_quality_score": f"""SELECT greatest(0.0, 100 - sum(least(15, 0.1 * duplicates))
        - (SELECT CASE WHEN outlier_pct > 5 THEN least(10, (outlier_pct - 5) * 0.5) ELSE 0 END
            FROM ({_iqr("sales_first")}))
        - (SELECT least(15, 0.01 * count(*) FILTER (WHERE {REASONS} IS NOT NULL)) FROM sales_first))::DOUBLE
        AS quality_score FROM ({_duplicates(False)})""",
    "dq_quality_score_dirty": f"""SELECT round(greatest(0, 100 - sum(penalty)), 6)::DOUBLE AS quality_score FROM (
        SELECT check_name, table_name, CASE check_name
            WHEN 'missing_values' THEN least(20, 0.1 * sum(value))
            WHEN 'duplicates' THEN least(15, 0.1 * sum(value))
            WHEN 'outliers' THEN greatest(0, least(10, 0.5 * (max(value) FILTER (WHERE item = 'outlier_pct') - 5)))
            WHEN 'business_rules' THEN least(15, 0.01 * max(value) FILTER (WHERE item = 'total_removed'))
            ELSE 0 END AS penalty
        FROM ({_REPORT}) GROUP BY check_name, table_name)""",
    "fk_semi_join": f"""SELECT sale_id, date_id, store_id, product_id, customer_id, quantity, {_MONEY}
        FROM dirty_clean JOIN dirty_dates ON sale_date = date
        WHERE store_id IN (SELECT store_id FROM stores_raw) AND product_id IN (SELECT product_id FROM products_raw)
            AND customer_id IN (SELECT customer_id FROM customers_raw)""",
    "fk_anti_rejects": """SELECT * FROM (SELECT sale_id, store_id, product_id,
            CASE WHEN NOT EXISTS (SELECT 1 FROM stores_raw s WHERE s.store_id = d.store_id) THEN 'store'
                WHEN NOT EXISTS (SELECT 1 FROM products_raw p WHERE p.product_id = d.product_id) THEN 'product'
                WHEN NOT EXISTS (SELECT 1 FROM customers_raw c WHERE c.customer_id = d.customer_id) THEN 'customer'
            END AS missing FROM dirty_clean d) WHERE missing IS NOT NULL""",
    "etl_clean_sales": f"SELECT {_SALE} FROM sales_clean",
    "etl_clean_sales_dirty": f"SELECT {_SALE} FROM dirty_clean",
    "dim_date": "SELECT * FROM dates",
    "date_surrogate_key": "SELECT sale_id, date_id, date FROM fact",
    "dim_store": "SELECT * FROM stores_raw",
    "dim_product": f"""SELECT product_id, product_name, category, brand, {dbl("price")} AS price, {dbl("cost")} AS cost
        FROM products_raw""",
    "dim_customer": "SELECT customer_id, customer_name, gender, age, age_group, city FROM customers_raw",
    "fact_sales": f"SELECT sale_id, date_id, store_id, product_id, customer_id, quantity, {_MONEY} FROM fact",
    "age_band": f"""SELECT customer_id, age, {AGE_GROUP} AS age_group
        FROM (SELECT c_custkey AS customer_id, CAST(c_custkey % 90 AS INTEGER) AS age FROM customer)""",
    "sale_measures": f"""SELECT l_orderkey, l_linenumber, product_id, quantity, {dbl("r")} AS revenue, {dbl("c")} AS cost,
        {dbl("r - c")} AS profit FROM (
        SELECT l_orderkey, l_linenumber, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
            CAST(price * CAST(l_quantity AS INTEGER) AS DECIMAL(12,2)) AS r,
            CAST(cost * CAST(l_quantity AS INTEGER) AS DECIMAL(12,2)) AS c
        FROM lineitem JOIN products_raw ON l_partkey = product_id)""",
    "kpis": _kpis("facts"),
    "filter_date_range": _kpis("fact", "date BETWEEN DATE '1997-03-05' AND DATE '1997-09-20'"),
    "filter_stores": _kpis("facts", "store_id IN (1, 3, 5)"),
    "filter_categories": _kpis("facts JOIN products_raw USING (product_id)", "category IN ('PROMO', 'ECONOMY')").replace(
        "sum(profit)", "sum(facts.profit)"
    ),
    "filter_regions": _kpis("facts JOIN stores_raw USING (store_id)", "region IN ('ASIA', 'EUROPE')"),
    "filter_combined": _kpis(
        "fact JOIN products_raw USING (product_id) JOIN stores_raw USING (store_id)",
        """date BETWEEN DATE '1996-06-01' AND DATE '1997-06-30' AND store_id IN (0,1,2,3,4,5,6,7)
        AND category IN ('PROMO', 'SMALL') AND region IN ('ASIA', 'AFRICA', 'AMERICA')""",
    ),
    "scope_store_manager": _kpis("facts", "store_id = 3"),
    "scope_without_store": _kpis("facts", "false"),
    "filter_last_year": _kpis("fact", f"date BETWEEN DATE '2000-11-04' AND {AS_OF}"),
    "filter_until_today": _kpis("fact", "date BETWEEN DATE '1997-01-01' AND current_date"),
    "filter_trailing_days": _kpis("fact", f"date >= {AS_OF} - INTERVAL 60 DAY"),
    "star_join_3dim": f"""SELECT sale_id, d.date, day_of_week, is_weekend, store_name, region, product_name, category,
        {dbl("revenue")} AS revenue FROM fact f JOIN dates d ON f.date_id = d.date_id
        JOIN stores_raw USING (store_id) JOIN products_raw USING (product_id)""",
    "star_join_4dim": f"""SELECT sale_id, date, store_name, s.city, category, customer_name, c.city AS customer_city,
        age_group, {dbl("revenue")} AS revenue FROM fact JOIN stores_raw s USING (store_id)
        JOIN products_raw USING (product_id) JOIN customers_raw c USING (customer_id)""",
    "sales_trend": f"""SELECT year, month, {dbl("sum(revenue)")} AS revenue, {dbl("sum(profit)")} AS profit,
        count(DISTINCT sale_id) AS transactions, month_name FROM facts GROUP BY year, month, month_name""",
    "store_performance": f"""SELECT store_id, store_name, city, region, {dbl("sum(revenue)")} AS revenue,
        {dbl("sum(profit)")} AS profit, {_MARGIN} AS profit_margin, count(DISTINCT sale_id) AS transactions
        FROM facts JOIN stores_raw USING (store_id) GROUP BY store_id, store_name, city, region
        ORDER BY sum(revenue) DESC, store_id LIMIT 15""",
    "product_performance": f"""SELECT category, brand, product_name, {big("sum(quantity)")} AS total_quantity,
        {dbl("sum(revenue)")} AS revenue, {dbl("sum(profit)")} AS profit, count(DISTINCT sale_id) AS sales_count
        FROM facts JOIN products_raw USING (product_id) GROUP BY category, brand, product_name, product_id
        ORDER BY sum(revenue) DESC, product_id LIMIT 20""",
    "top_products": f"""SELECT product_name, {dbl("sum(revenue)")} AS revenue
        FROM facts JOIN products_raw USING (product_id) GROUP BY product_name, product_id
        ORDER BY sum(revenue) DESC, product_id LIMIT 10""",
    "category_revenue": f"""SELECT category, {dbl("revenue")} AS revenue, {dbl("profit")} AS profit, quantity
        FROM by_category""",
    "customer_insights": f"""SELECT age_group, gender, customer_count, {dbl("revenue")} AS revenue,
        avg_revenue AS avg_revenue_per_customer FROM insights""",
    "customer_insights_ever": _customers("fact"),
    "customer_insights_filtered": _customers(
        "fact JOIN products_raw USING (product_id) JOIN stores_raw USING (store_id)",
        """date BETWEEN DATE '1996-01-17' AND DATE '1997-06-09' AND category IN ('PROMO', 'ECONOMY', 'STANDARD')
        AND region IN ('ASIA', 'EUROPE', 'AFRICA')""",
    ),
    "customer_insights_days": _customers("fact", "date BETWEEN DATE '1996-05-03' AND DATE '1996-05-30' AND store_id < 5"),
    "customer_insights_store": _customers("fact", "store_id = 3"),
    "insight_top_store": f"""SELECT store_name, {dbl("sum(revenue)")} AS revenue, {dbl("sum(profit)")} AS profit
        FROM facts JOIN stores_raw USING (store_id) GROUP BY store_id, store_name
        ORDER BY sum(revenue) DESC, store_id LIMIT 1""",
    "insight_top_category": f"""SELECT category, {dbl("revenue")} AS revenue FROM by_category
        ORDER BY by_category.revenue DESC, category LIMIT 1""",
    "seasonal_quarterly": f"""SELECT year, quarter, {dbl("sum(revenue)")} AS revenue, {dbl("sum(profit)")} AS profit,
        count(DISTINCT sale_id) AS transactions, {_AVERAGE} AS avg_revenue, quarter_name
        FROM facts GROUP BY year, quarter, quarter_name""",
    "seasonal_monthly": """SELECT month, avg_revenue, avg_profit,
        year_count, month_name FROM pattern""",
    "daily_sales": "SELECT * FROM daily",
    "customer_features": """SELECT customer_id, transactions, total_revenue, avg_order_value,
        total_quantity, age_group, gender FROM features""",
    "customer_features_scaled": "SELECT customer_id, "
    + ", ".join(
        f"coalesce(round(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 6), 0) AS {f}_z"
        for f in ("transactions", "total_revenue", "avg_order_value", "total_quantity")
    )
    + " FROM features_ever",
    "anomaly_daily": """SELECT strftime(date, '%Y-%m-%d') AS date, daily_revenue AS revenue, round(m, 4) AS expected_revenue,
        round((daily_revenue - m) / m * 100, 6) AS deviation,
        CASE WHEN daily_revenue > m THEN 'high' ELSE 'low' END AS type
        FROM (SELECT *, avg(daily_revenue) OVER () AS m, stddev_samp(daily_revenue) OVER () AS s,
            count(*) OVER () AS n FROM daily)
        WHERE n >= 7 AND abs(daily_revenue - m) > 2 * s""",
    "anomaly_stats": """SELECT round(avg(daily_revenue), 4) AS mean_revenue,
        round(stddev_samp(daily_revenue), 4) AS std_revenue, count(*) AS total_days FROM daily HAVING count(*) >= 7""",
    "seasonal_insights": """SELECT kind AS type, month_name AS month, avg_revenue AS revenue,
        round(CASE kind WHEN 'peak_month' THEN avg_revenue / m - 1 ELSE 1 - avg_revenue / m END * 100, 6) AS percentage
        FROM (
            (SELECT 'peak_month' AS kind, * FROM pattern ORDER BY avg_revenue DESC, month LIMIT 1)
            UNION ALL (SELECT 'low_month' AS kind, * FROM pattern ORDER BY avg_revenue, month LIMIT 1)),
            (SELECT avg(avg_revenue) AS m FROM pattern)""",
    "customer_grouping_sets": f"""SELECT age_group, gender, {dbl("sum(revenue)")} AS revenue FROM insights
        GROUP BY GROUPING SETS ((age_group), (gender))""",
    "category_share": f"""SELECT category, {dbl("revenue")} AS revenue,
        round({dbl("revenue")} / {dbl("sum(revenue) OVER ()")} * 100, 6) AS share_pct FROM by_category""",
    "gender_share": f"""SELECT gender, {dbl("sum(revenue)")} AS revenue,
        round({dbl("sum(revenue)")} / {dbl("sum(sum(revenue)) OVER ()")} * 100, 6) AS share_pct
        FROM insights GROUP BY gender""",
    "v_monthly_sales": f"""SELECT year, month, count(sale_id) AS total_transactions, {big("sum(quantity)")} AS total_quantity,
        {dbl("sum(revenue)")} AS total_revenue, {dbl("sum(cost)")} AS total_cost, {dbl("sum(profit)")} AS total_profit,
        {_AVERAGE} AS avg_revenue_per_transaction, {_MARGIN} AS profit_margin_pct, quarter, month_name
        FROM fact GROUP BY year, quarter, month, month_name""",
    "v_store_performance": f"""SELECT store_id, count(sale_id) AS total_transactions, {dbl("sum(revenue)")} AS total_revenue,
        {dbl("sum(profit)")} AS total_profit, {_MARGIN} AS profit_margin_pct, {_AVERAGE} AS avg_order_value,
        store_name, city, region, store_type FROM fact JOIN stores_raw USING (store_id)
        GROUP BY store_id, store_name, city, region, store_type""",
    "v_product_performance": f"""SELECT product_id, count(sale_id) AS total_sales, {big("sum(quantity)")} AS total_quantity_sold,
        {dbl("sum(revenue)")} AS total_revenue, {dbl("sum(profit)")} AS total_profit, {_AVERAGE} AS avg_revenue_per_sale,
        product_name, category, brand FROM fact JOIN products_raw USING (product_id)
        GROUP BY product_id, product_name, category, brand""",
    "filter_options_admin": """SELECT 'store' AS kind, store_id AS id, store_name AS label, city FROM stores_raw
        UNION ALL SELECT DISTINCT 'category', NULL, category, NULL FROM products_raw
        UNION ALL SELECT DISTINCT 'region', NULL, region, NULL FROM stores_raw""",
    "filter_options_store": """SELECT 'store' AS kind, store_id AS id, store_name AS label, city FROM stores_raw
            WHERE store_id = 3
        UNION ALL SELECT DISTINCT 'category', NULL, category, NULL FROM products_raw
            WHERE product_id IN (SELECT product_id FROM fact WHERE store_id = 3)
        UNION ALL SELECT DISTINCT 'region', NULL, region, NULL FROM stores_raw WHERE store_id = 3""",
    "demand_with_stock": f"""SELECT store_id, product_id, total_qty, sales_days, current_stock, stored_reorder, stored_max,
        store_name, product_name, {dbl("unit_cost")} AS unit_cost FROM wanted""",
    "demand_no_stock": f"""SELECT store_id, product_id, total_qty, sales_days, 0 AS current_stock, 0 AS stored_reorder,
        0 AS stored_max, store_name, product_name, {dbl("unit_cost")} AS unit_cost FROM sold""",
    "inventory_optimization": "SELECT * FROM optimised",
    "inventory_upsert": _UPDATED_LEVELS,
    "inventory_upsert_stored": _UPDATED_LEVELS,
    "reorder_suggestions": "SELECT * FROM suggestions",
    "inventory_scoped": "SELECT * FROM suggestions WHERE store_id = 3",
    "auto_orders": "SELECT * FROM orders_due",
    "auto_orders_scoped": "SELECT * FROM orders_due WHERE store_id = 3",
    "inventory_availability": """SELECT l.store_id, store_name, product_id, product_name, current_quantity AS store_stock,
        coalesce(current_stock, 0) AS central_stock FROM levels l JOIN stores_raw s ON l.store_id = s.store_id
        JOIN products_raw USING (product_id) LEFT JOIN central USING (product_id)""",
    "inventory_levels_listing": """SELECT l.store_id, store_name, product_id, product_name, current_quantity, min_quantity,
        max_quantity, reorder_point, last_updated FROM levels l JOIN stores_raw s ON l.store_id = s.store_id
        JOIN products_raw USING (product_id) """,
    "stock_probe": """SELECT probe, store_id, product_id, CASE probe WHEN 'stock_levels.current_quantity' THEN current_stock ELSE 0 END
            AS current_stock
        FROM wanted, (VALUES ('stock_levels.current_quantity'), ('stock_levels.no_such_column'),
            ('no_such_table.current_quantity')) v(probe)""",
    "alerts_appended": f"""SELECT store_id, type, title, message, severity, is_read, CAST({AS_OF} AS TIMESTAMP) AS created_at,
        count(*) AS ids, count(*) AS copies FROM (SELECT * FROM low_alerts UNION ALL SELECT * FROM order_alerts) GROUP BY ALL""",
    "stream_alerts": f"""SELECT store_id, type, title, message, severity, is_read, CAST({AS_OF} AS TIMESTAMP) AS created_at,
        count(*) AS ids, count(*) AS copies FROM (SELECT * FROM low_alerts UNION ALL SELECT * FROM order_alerts) GROUP BY ALL""",
    "stream_daily_sales": f"""SELECT date, {dbl("sum(revenue)")} AS daily_revenue, {big("sum(quantity)")} AS daily_quantity,
        count(DISTINCT sale_id) AS daily_transactions FROM fact GROUP BY date
        HAVING date + INTERVAL 3 DAY <= (SELECT max(date + to_seconds(sale_id % 86400)) FROM fact)""",
    "low_stock_alerts": "SELECT * FROM low_alerts",
    "auto_order_alerts": "SELECT * FROM order_alerts",
    "inventory_cards": """SELECT CAST(floor((SELECT avg(eoq) FROM optimised) + 0.5) AS BIGINT) AS avg_eoq,
        (SELECT count(*) FROM suggestions) AS low_stock_count,
        CAST((SELECT sum(suggested_order_qty) FROM orders_due) AS BIGINT) AS total_auto_order_qty""",
    "forecast_history": f"""SELECT year, month, {dbl("revenue")} AS revenue, {dbl("profit")} AS profit, month_name
        FROM monthly""",
    "forecast_fallback": f"""SELECT year, month, {dbl("sum(revenue)")} AS revenue, {dbl("sum(profit)")} AS profit, month_name
        FROM fact WHERE store_id = 3 GROUP BY year, month, month_name""",
    "period_index": "SELECT store_id, year, month, period FROM by_store_ever",
    "forecast_r2": "SELECT months, "
    + ", ".join(
        f"round({m}_{s}, {6 if s == 'r2' else 4}) AS {m}_{s}"
        for m in ("revenue", "profit")
        for s in ("slope", "intercept", "r2")
    )
    + " FROM fit",
    "forecast_linear": """SELECT year, month, round(revenue, 2) AS revenue, round(profit, 2) AS profit, month_name,
        is_forecast FROM ahead""",
    "forecast_calendar": """SELECT store_id, last_month, CAST(step AS INTEGER) AS step,
        CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE) AS date
        FROM store_fit_ever, generate_series(1, 12) AS g(step)""",
    "forecast_full": f"""SELECT year, month, round(revenue, 2) AS revenue, round(profit, 2) AS profit, month_name, is_forecast,
        year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS label FROM (
        SELECT year, month, {dbl("revenue")} AS revenue, {dbl("profit")} AS profit, month_name, false AS is_forecast
        FROM monthly UNION ALL BY NAME SELECT * FROM ahead)""",
    "forecast_linear_by_store": """SELECT store_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
        round(ri + rs * (months - 1 + step), 2) AS revenue, round(pi + ps * (months - 1 + step), 2) AS profit,
        monthname(d) AS month_name, true AS is_forecast
        FROM (SELECT *, CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE) AS d
            FROM store_fit, generate_series(1, 6) AS g(step))""",
    "forecast_last_value_by_store": f"""SELECT store_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
        round(revenue, 2) AS revenue, round(profit, 2) AS profit, monthname(d) AS month_name, true AS is_forecast,
        'arima(0,1,0)' AS fitted
        FROM (SELECT store_id, {dbl("revenue")} AS revenue, {dbl("profit")} AS profit, step,
                CAST(make_date(year, month, 1) + to_months(CAST(step AS INTEGER)) AS DATE) AS d
            FROM by_store, generate_series(1, 6) AS g(step)
            QUALIFY row_number() OVER (PARTITION BY store_id, step ORDER BY year DESC, month DESC) = 1)
        WHERE store_id IN (SELECT store_id FROM by_store GROUP BY store_id HAVING count(*) >= 3)""",
    "forecast_autoregressive_by_store": """SELECT store_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
        round(r, 2) AS revenue, round(p, 2) AS profit, monthname(d) AS month_name, true AS is_forecast, 'arima(1,1,0)' AS fitted
        FROM ar_ahead""",
    "forecast_likelihood_by_store": """SELECT store_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
        round(r, 1) AS revenue, round(p, 1) AS profit, monthname(d) AS month_name, true AS is_forecast, 'arima(1,1,0)' AS fitted
        FROM ml_ahead""",
    "forecast_calendar_trend_by_store": """SELECT store_id, CAST((m + step) // 12 AS INTEGER) AS year,
        CAST((m + step) % 12 + 1 AS INTEGER) AS month,
        round(ri + rs * (m + step), 2) AS revenue, round(pi + ps * (m + step), 2) AS profit,
        monthname(make_date(2000, CAST((m + step) % 12 + 1 AS INTEGER), 1)) AS month_name, true AS is_forecast,
        'trend, 0 waves' AS fitted FROM calendar_lines, generate_series(1, 6) AS g(step)""",
    "forecast_skipped_series": """SELECT customer_id, months,
            CASE WHEN months < 3 THEN 'fewer than 3 months' ELSE 'the order needs 8 months' END AS reason
        FROM (SELECT customer_id, count(DISTINCT year * 12 + month) AS months FROM facts GROUP BY customer_id) WHERE months < 8""",
    "segment_totals": """SELECT count(*) AS customers, round(CAST(sum(transactions) AS DOUBLE), 2) AS transactions,
        round(sum(total_revenue), 2) AS total_revenue, round(sum(avg_order_value), 2) AS avg_order_value,
        round(CAST(sum(total_quantity) AS DOUBLE), 2) AS total_quantity FROM features""",
    "customer_segments": "SELECT customer_id, age_group, gender, segment FROM segmented",
    "segment_summary": """SELECT segment, count(*) AS customers_count, round(avg(transactions), 4) AS avg_transactions,
        round(avg(total_revenue), 4) AS avg_revenue, round(avg(avg_order_value), 4) AS avg_order_value, round(avg(total_quantity), 4) AS avg_quantity
        FROM segmented GROUP BY segment""",
    "segment_nearest": f"""SELECT count(*) AS customers, count(*) FILTER (WHERE own > nearest + 1e-6) AS misplaced FROM (
            SELECT customer_id, min(away) FILTER (WHERE here) AS own, min(away) AS nearest FROM (
                SELECT customer_id, segment = other AS here, {_away("z", "centre")} AS away
                FROM segmented, (SELECT segment AS other, [{", ".join(f"avg(z[{i}])" for i in range(1, 5))}] AS centre FROM segmented GROUP BY segment))
            GROUP BY customer_id)""",
    "notification_feed_admin": """SELECT notification_id, type, title, message, severity, is_read,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, store_name
        FROM notes LEFT JOIN stores_raw USING (store_id) WHERE user_id IS NULL OR user_id = 8
        ORDER BY notes.created_at DESC, notification_id LIMIT 50""",
    "notification_feed_store": """SELECT notification_id, type, title, message, severity, is_read,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, store_name
        FROM notes n LEFT JOIN stores_raw s ON n.store_id = s.store_id
        WHERE (user_id IS NULL OR user_id = 8) AND (n.store_id IS NULL OR n.store_id = 3)
        ORDER BY n.created_at DESC, notification_id LIMIT 50""",
    "notification_unread": """SELECT count(*) AS unread_count FROM notes
        WHERE NOT is_read AND (user_id IS NULL OR user_id = 8) AND (store_id IS NULL OR store_id = 3)""",
    "notification_feed_receipts": """SELECT notification_id, type, title, message, is_read OR type = 'purchase' AS is_read, severity,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, store_name
        FROM notes n LEFT JOIN stores_raw s ON n.store_id = s.store_id
        WHERE (user_id IS NULL OR user_id = 8) AND (n.store_id IS NULL OR n.store_id = 3)
        ORDER BY n.created_at DESC, notification_id LIMIT 50""",
    "notification_mark_read": """SELECT notification_id, user_id, store_id, type, is_read OR type = 'purchase' AS is_read
        FROM notes""",
    "notification_mark_all": """SELECT notification_id, user_id, store_id, type,
        is_read OR user_id IS NULL OR user_id = 8 AS is_read FROM notes""",
    "user_directory": """SELECT user_id, username, role, a.store_id, store_name, city,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        strftime(last_login, '%Y-%m-%d %H:%M:%S') AS last_login, is_active
        FROM accounts a LEFT JOIN stores_raw s ON a.store_id = s.store_id""",
    "scope_rows": """SELECT 'store_' || store_id AS username, 'store_manager' AS role, store_id FROM stores_raw
        UNION ALL SELECT 'admin', 'admin', NULL""",
    "scope_upsert": f"""SELECT user_id, username, role, store_id,
        CASE WHEN region = 'ASIA' THEN strftime(CAST({AS_OF} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
            ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at,
        CASE WHEN region = 'ASIA' THEN NULL ELSE strftime(last_login, '%Y-%m-%d %H:%M:%S') END AS last_login,
        true AS is_active FROM accounts""",
    "scalar_date": f"""SELECT o_orderkey, CAST(day(d) AS INTEGER) AS day, CAST(month(d) AS INTEGER) AS month,
        CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year,
        CAST(isodow(d) - 1 AS INTEGER) AS weekday, monthname(d) AS month_name, dayname(d) AS day_of_week,
        {MONTHS_HE}[month(d)] AS month_name_he, 'Q' || quarter(d) AS quarter_name,
        strftime(d, '%Y-%m') AS label, CAST(d - INTERVAL 60 DAY AS DATE) AS back_60_days,
        make_date(year(d), month(d), 1) AS month_start,
        CAST(make_date(year(d), month(d), 1) + INTERVAL 1 MONTH AS DATE) AS next_month,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text
        FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "scalar_string": f"""SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug, p_name || ' | ' || p_brand AS joined,
        string_split(p_name, ' ')[1] AS first_word, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
        'store_' || p_partkey AS username, coalesce(nullif(p_type, 'PROMO'), 'none') AS defaulted,
        '₪' || format('{{:,.0f}}', p_retailprice) AS amount_text,
        {_MONEY_TEXT.format("p_retailprice")} AS money_text FROM part""",
    "scalar_math": """SELECT p_partkey, sqrt(p_retailprice) AS root, abs(p_size - 25) AS distance,
        greatest(p_size, 10) AS at_least_10, least(p_size, 40) AS at_most_40,
        CAST(trunc(p_retailprice * CAST(1.1 AS DOUBLE)) AS INTEGER) AS truncated,
        p_retailprice / nullif(CAST(p_size - 25 AS DOUBLE), 0) AS ratio,
        CAST(p_size AS DOUBLE) / nullif(p_retailprice, 0) * 100 AS percent,
        round(p_retailprice / 7, 4) AS rounded FROM part""",
}


def _cards(where: str) -> str:
    return f"""
        (SELECT '🏆 סניף מוביל' AS title, 'הסניף המוביל הוא ' || store_name || ' עם הכנסות של ₪'
            || format('{{:,.0f}}', {dbl("sum(revenue)")}) AS description,
            'רווח: ₪' || format('{{:,.0f}}', {dbl("sum(profit)")}) AS metric
            FROM facts JOIN stores_raw USING (store_id) WHERE {where} GROUP BY store_id, store_name
            ORDER BY sum(revenue) DESC, store_id LIMIT 1)
        UNION ALL
        (SELECT '📦 קטגוריה מובילה', 'הקטגוריה המובילה היא ' || category,
            'הכנסות: ₪' || format('{{:,.0f}}', {dbl("sum(revenue)")})
            FROM facts JOIN products_raw USING (product_id) WHERE {where} GROUP BY category
            ORDER BY sum(revenue) DESC, category LIMIT 1)"""


ORACLE_BODIES["insight_cards"] = _cards("true")
ORACLE_BODIES["insight_cards_store"] = _cards("store_id = 3")

ORACLE_BODIES["forecast_unbent_trend_by_store"] = ORACLE_BODIES["forecast_calendar_trend_by_store"]

ORACLE = {name: _sql(body) for name, body in ORACLE_BODIES.items()}
