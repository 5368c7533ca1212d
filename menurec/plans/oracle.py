"""Independent DuckDB SQL for every registered query.

The driver registers its parquet tables as views; each statement rebuilds the
fixture mapping (``menurec.sources.adapter``) as common table expressions and
then answers the query in plain SQL.  Outputs are cast to BIGINT, DOUBLE or
VARCHAR with the same column names as the Spark side.  Money stays exact:
averages are computed in integer units of 1/10000 and rounded half-up with
integer arithmetic.
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see menurec.sources.adapter and
# menurec.plans.queries).
EXCLUDED = "bolt"
AS_OF = "2001-08-01"

ADAPTER = """
menu AS (
    SELECT min(p_partkey) AS menu_item_id,
           p_name AS menu_item_name,
           arg_min(p_brand, p_partkey) AS truck_brand_name,
           arg_min(p_type, p_partkey) AS menu_type,
           CAST(arg_min(p_retailprice, p_partkey) AS DECIMAL(18,4)) AS sale_price_usd,
           split_part(p_name, ' ', 2) AS item_category,
           split_part(p_name, ' ', 1) AS item_subcategory
    FROM part GROUP BY p_name
),
part_item AS (
    SELECT p.p_partkey, m.menu_item_id
    FROM part p JOIN menu m ON p.p_name = m.menu_item_name
),
order_detail AS (
    SELECT l.l_orderkey * 1000 + l.l_linenumber AS order_detail_id,
           l.l_orderkey AS order_id, pi.menu_item_id,
           CAST(l.l_linenumber AS BIGINT) AS line_number,
           CAST(l.l_quantity AS INTEGER) AS quantity,
           CAST(NULL AS DECIMAL(18,4)) AS unit_price,
           CAST(l.l_extendedprice AS DECIMAL(18,4)) AS price
    FROM lineitem l JOIN part_item pi ON l.l_partkey = pi.p_partkey
),
order_header AS (
    SELECT o.o_orderkey AS order_id, s.truck_id,
           CAST(o.o_custkey % 25 AS DOUBLE) AS location_id,
           o.o_custkey AS customer_id,
           CAST(o.o_totalprice AS DECIMAL(18,4)) AS order_total,
           CAST(NULL AS DECIMAL(18,4)) AS order_amount,
           CAST(NULL AS VARCHAR) AS order_tax_amount,
           CAST(NULL AS VARCHAR) AS order_discount_amount,
           o.o_orderdate AS order_ts
    FROM orders o
    JOIN (SELECT l_orderkey, min(l_suppkey) AS truck_id FROM lineitem GROUP BY l_orderkey) s
      ON o.o_orderkey = s.l_orderkey
),
geo AS (
    SELECT n.n_nationkey, n.n_name, r.r_name
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
truck AS (
    SELECT s.s_suppkey AS truck_id, g.n_name AS primary_city, g.r_name AS region,
           g.r_name AS country, CAST(1 AS BIGINT) AS franchise_flag,
           CAST(s.s_nationkey AS BIGINT) AS franchise_id
    FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey
),
franchise AS (
    SELECT CAST(n_nationkey AS BIGINT) AS franchise_id, CAST(NULL AS VARCHAR) AS first_name,
           n_name AS last_name
    FROM geo WHERE n_nationkey < 24
),
location AS (
    SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS city, r_name AS country FROM geo
),
customer_loyalty AS (
    SELECT c.c_custkey AS customer_id, c.c_name AS first_name,
           CAST(NULL AS VARCHAR) AS last_name, CAST(NULL AS VARCHAR) AS e_mail,
           CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS children_count,
           g.n_name AS city, g.r_name AS country,
           CASE c.c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender,
           c.c_mktsegment AS marital_status,
           DATE '1950-01-01' + CAST((c.c_custkey * 37) % 18000 AS INTEGER) AS birthday_date
    FROM customer c JOIN geo g ON c.c_nationkey = g.n_nationkey
    WHERE c.c_custkey % 10 <> 9
),
franchised AS (
    -- orders whose truck belongs to a franchise and whose location is known
    SELECT h.*, v.primary_city, v.region, v.country, v.franchise_flag, v.franchise_id,
           w.first_name AS franchisee_first_name, w.last_name AS franchisee_last_name
    FROM order_header h, truck v, franchise w
    WHERE v.truck_id = h.truck_id AND w.franchise_id = v.franchise_id
      AND h.location_id IN (SELECT location_id FROM location)
),
orders_v AS (
    SELECT CAST(p.order_ts AS DATE) AS date,
           p.order_id, p.truck_id, p.order_ts, line.order_detail_id, line.line_number,
           item.truck_brand_name, item.menu_type, p.primary_city, p.region, p.country,
           p.franchise_flag, p.franchise_id,
           p.franchisee_first_name, p.franchisee_last_name,
           CAST(p.location_id AS BIGINT) AS location_id, buyer.customer_id, buyer.first_name, buyer.last_name,
           buyer.e_mail, buyer.phone_number, buyer.children_count, buyer.gender, buyer.marital_status,
           line.menu_item_id, item.menu_item_name, line.quantity, line.unit_price, line.price,
           p.order_amount, p.order_tax_amount, p.order_discount_amount, p.order_total
    FROM franchised p
    JOIN order_detail line ON line.order_id = p.order_id
    JOIN menu item ON item.menu_item_id = line.menu_item_id
    LEFT JOIN customer_loyalty buyer ON buyer.customer_id = p.customer_id
),
spans AS (
    SELECT customer_id,
           sum(order_total) AS total_spend,
           min(date) AS first_date, max(date) AS last_date,
           CAST((year(max(date)) * 12 + month(max(date)))
                - (year(min(date)) * 12 + month(min(date))) AS BIGINT) AS months,
           CAST(date_diff('day', date_trunc('week', min(date)), date_trunc('week', max(date))) // 7
                AS BIGINT) AS weeks,
           CAST(year(max(date)) - year(min(date)) AS BIGINT) AS years,
           CAST(sum(order_total) * 10000 AS HUGEINT) AS spend_units
    FROM orders_v WHERE customer_id IS NOT NULL GROUP BY customer_id
),
averages AS (
    SELECT customer_id,
           CAST((2 * spend_units + 100 * (months + 1)) // (200 * (months + 1)) AS DOUBLE) / 100.0
               AS avg_monthly_purchase_amount,
           CAST((2 * spend_units + 100 * (weeks + 1)) // (200 * (weeks + 1)) AS DOUBLE) / 100.0
               AS avg_weekly_purchase_amount,
           CAST((2 * spend_units + 100 * (years + 1)) // (200 * (years + 1)) AS DOUBLE) / 100.0
               AS avg_yearly_purchase_amount
    FROM spans
),
customer_features AS (
    SELECT customer_id, city, country, gender, marital_status, birthday_date,
           CAST(year(DATE '2001-08-01') - year(birthday_date) AS BIGINT) AS age
    FROM customer_loyalty
),
menu_features AS (
    SELECT menu_type, truck_brand_name, menu_item_name, item_category, item_subcategory,
           sale_price_usd
    FROM menu WHERE item_category != 'bolt'
),
items AS (SELECT menu_item_name FROM menu WHERE item_category != 'bolt'),
bought AS (SELECT DISTINCT customer_id, menu_item_name, truck_id FROM orders_v),
interactions AS (
    -- one row per truck that sold a customer a listed item ...
    SELECT cl.customer_id, it.menu_item_name, 1 AS purchased
    FROM customer_loyalty cl
    JOIN bought b ON b.customer_id = cl.customer_id
    JOIN items it ON it.menu_item_name = b.menu_item_name
    UNION ALL
    -- ... and one row for every (customer, listed item) never bought
    SELECT cl.customer_id, it.menu_item_name, 0 AS purchased
    FROM customer_loyalty cl, items it
    WHERE NOT EXISTS (SELECT 1 FROM bought b
                      WHERE b.customer_id = cl.customer_id
                        AND b.menu_item_name = it.menu_item_name)
),
nv_pairs AS (
    SELECT i.customer_id, m.truck_brand_name, i.purchased
    FROM interactions i JOIN menu_features m ON i.menu_item_name = m.menu_item_name
),
nv_all AS (SELECT DISTINCT customer_id, truck_brand_name, purchased FROM nv_pairs),
nv_visited AS (SELECT DISTINCT customer_id, truck_brand_name, purchased FROM nv_pairs
               WHERE purchased = 1),
nv AS (
    SELECT a.* FROM nv_all a
    WHERE NOT EXISTS (SELECT 1 FROM nv_visited v
                      WHERE v.customer_id = a.customer_id
                        AND v.truck_brand_name = a.truck_brand_name)
),
never_visited AS (
    SELECT nv.customer_id, nv.truck_brand_name, nv.purchased, m.menu_type,
           m.truck_brand_name AS item_truck_brand_name, m.menu_item_name, m.item_category,
           m.item_subcategory, m.sale_price_usd
    FROM nv JOIN menu_features m ON nv.truck_brand_name = m.truck_brand_name
),
audience AS (
    SELECT i.customer_id, i.menu_item_name, i.purchased, m.menu_type, m.truck_brand_name,
           m.item_category, m.item_subcategory, m.sale_price_usd,
           c.city, c.country, c.gender, c.marital_status, c.birthday_date, c.age,
           a.avg_monthly_purchase_amount, a.avg_weekly_purchase_amount,
           a.avg_yearly_purchase_amount
    FROM interactions i
    LEFT JOIN menu_features m ON i.menu_item_name = m.menu_item_name
    LEFT JOIN customer_features c ON i.customer_id = c.customer_id
    LEFT JOIN averages a ON i.customer_id = a.customer_id
),
audience_nv AS (
    SELECT n.*, c.city, c.country, c.gender, c.marital_status, c.birthday_date, c.age,
           a.avg_monthly_purchase_amount, a.avg_weekly_purchase_amount,
           a.avg_yearly_purchase_amount
    FROM never_visited n
    LEFT JOIN customer_features c ON n.customer_id = c.customer_id
    LEFT JOIN averages a ON n.customer_id = a.customer_id
),
hashed AS (
    SELECT i.*,
           ('0x' || substr(md5(CAST(i.customer_id AS VARCHAR) || '|' || i.menu_item_name),
                    1, 8))::BIGINT AS h
    FROM interactions i
),
scored AS (
    SELECT h.customer_id, c.city, h.menu_item_name, h.purchased,
           CAST(h.h % 1000 AS DOUBLE) / 1000.0 AS prediction
    FROM hashed h LEFT JOIN customer_features c ON h.customer_id = c.customer_id
),
top3 AS (
    SELECT * FROM (
        SELECT s.*, rank() OVER (PARTITION BY customer_id
                                 ORDER BY prediction DESC NULLS FIRST) AS rank
        FROM scored s) WHERE rank <= 3
),
history AS (
    SELECT customer_id, string_agg(menu_item_name, '|' ORDER BY menu_item_name)
               AS purchase_history
    FROM interactions
    WHERE purchased = 1 AND customer_id IN (SELECT customer_id FROM top3)
    GROUP BY customer_id
),
dataset AS (
    SELECT h.customer_id, h.menu_item_name, h.purchased, h.h,
           c.city, c.country, c.gender, c.marital_status, c.age,
           m.menu_type, m.truck_brand_name, m.item_category, m.item_subcategory,
           m.sale_price_usd,
           a.avg_monthly_purchase_amount, a.avg_weekly_purchase_amount,
           a.avg_yearly_purchase_amount
    FROM hashed h
    LEFT JOIN customer_features c ON h.customer_id = c.customer_id
    LEFT JOIN menu_features m ON h.menu_item_name = m.menu_item_name
    LEFT JOIN averages a ON h.customer_id = a.customer_id
),
train AS (SELECT * FROM dataset WHERE h % 10000 < 1000),
vocab AS (
    SELECT DISTINCT 'menu_item_name' AS feature, menu_item_name AS value FROM train
    UNION SELECT DISTINCT 'menu_type', menu_type FROM train
    UNION SELECT DISTINCT 'truck_brand_name', truck_brand_name FROM train
    UNION SELECT DISTINCT 'item_category', item_category FROM train
    UNION SELECT DISTINCT 'item_subcategory', item_subcategory FROM train
    UNION SELECT DISTINCT 'city', city FROM train
    UNION SELECT DISTINCT 'country', country FROM train
    UNION SELECT DISTINCT 'gender', gender FROM train
    UNION SELECT DISTINCT 'marital_status', marital_status FROM train
),
enc AS (
    SELECT feature, value,
           CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS BIGINT) AS code
    FROM vocab WHERE value IS NOT NULL
),
ranges AS (
    SELECT min(CAST(sale_price_usd AS DOUBLE)) AS lo_p, max(CAST(sale_price_usd AS DOUBLE)) AS hi_p,
           min(CAST(age AS DOUBLE)) AS lo_a, max(CAST(age AS DOUBLE)) AS hi_a,
           min(avg_monthly_purchase_amount) AS lo_m, max(avg_monthly_purchase_amount) AS hi_m,
           min(avg_weekly_purchase_amount) AS lo_w, max(avg_weekly_purchase_amount) AS hi_w,
           min(avg_yearly_purchase_amount) AS lo_y, max(avg_yearly_purchase_amount) AS hi_y
    FROM train
),
scales AS (
    SELECT *,
           1.0 / (CASE WHEN hi_p - lo_p = 0 THEN 1.0 ELSE hi_p - lo_p END) AS s_p,
           1.0 / (CASE WHEN hi_a - lo_a = 0 THEN 1.0 ELSE hi_a - lo_a END) AS s_a,
           1.0 / (CASE WHEN hi_m - lo_m = 0 THEN 1.0 ELSE hi_m - lo_m END) AS s_m,
           1.0 / (CASE WHEN hi_w - lo_w = 0 THEN 1.0 ELSE hi_w - lo_w END) AS s_w,
           1.0 / (CASE WHEN hi_y - lo_y = 0 THEN 1.0 ELSE hi_y - lo_y END) AS s_y
    FROM ranges
),
scaled AS (
    SELECT d.*,
           CAST(d.sale_price_usd AS DOUBLE) * s.s_p + (0.0 - s.lo_p * s.s_p) AS sale_price_usd_s,
           CAST(d.age AS DOUBLE) * s.s_a + (0.0 - s.lo_a * s.s_a) AS age_s,
           d.avg_monthly_purchase_amount * s.s_m + (0.0 - s.lo_m * s.s_m) AS avg_monthly_s,
           d.avg_weekly_purchase_amount * s.s_w + (0.0 - s.lo_w * s.s_w) AS avg_weekly_s,
           d.avg_yearly_purchase_amount * s.s_y + (0.0 - s.lo_y * s.s_y) AS avg_yearly_s
    FROM dataset d CROSS JOIN scales s
),
coded AS (
    SELECT d.*,
           e1.code AS menu_item_name_c, e2.code AS menu_type_c, e3.code AS truck_brand_name_c,
           e4.code AS item_category_c, e5.code AS item_subcategory_c, e6.code AS city_c,
           e7.code AS country_c, e8.code AS gender_c, e9.code AS marital_status_c
    FROM scaled d
    LEFT JOIN enc e1 ON e1.feature = 'menu_item_name' AND e1.value = d.menu_item_name
    LEFT JOIN enc e2 ON e2.feature = 'menu_type' AND e2.value = d.menu_type
    LEFT JOIN enc e3 ON e3.feature = 'truck_brand_name' AND e3.value = d.truck_brand_name
    LEFT JOIN enc e4 ON e4.feature = 'item_category' AND e4.value = d.item_category
    LEFT JOIN enc e5 ON e5.feature = 'item_subcategory' AND e5.value = d.item_subcategory
    LEFT JOIN enc e6 ON e6.feature = 'city' AND e6.value = d.city
    LEFT JOIN enc e7 ON e7.feature = 'country' AND e7.value = d.country
    LEFT JOIN enc e8 ON e8.feature = 'gender' AND e8.value = d.gender
    LEFT JOIN enc e9 ON e9.feature = 'marital_status' AND e9.value = d.marital_status
)"""

AUDIENCE_COLUMNS = """customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased,
       menu_type, truck_brand_name,
       item_category, item_subcategory, CAST(sale_price_usd AS DOUBLE) AS sale_price_usd,
       city, country, gender, marital_status, CAST(birthday_date AS VARCHAR) AS birthday_date,
       age, avg_monthly_purchase_amount, avg_weekly_purchase_amount, avg_yearly_purchase_amount"""

NV_COLUMNS = """customer_id, truck_brand_name, CAST(purchased AS BIGINT) AS purchased,
       menu_type, item_truck_brand_name, menu_item_name, item_category, item_subcategory,
       CAST(sale_price_usd AS DOUBLE) AS sale_price_usd"""


def _with(body: str, *extra_ctes: str) -> str:
    ctes = ADAPTER + "".join("," + c for c in extra_ctes)
    return "WITH " + ctes + "\n" + body


ORDERS_V = _with("""
SELECT CAST(date AS VARCHAR) AS date, order_id, truck_id, CAST(order_ts AS VARCHAR) AS order_ts,
       order_detail_id, line_number, truck_brand_name, menu_type, primary_city, region,
       country, franchise_flag, franchise_id, franchisee_first_name, franchisee_last_name,
       location_id, customer_id, first_name, last_name, e_mail, phone_number,
       children_count, gender, marital_status, menu_item_id, menu_item_name,
       CAST(quantity AS BIGINT) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(price AS DOUBLE) AS price, CAST(order_amount AS DOUBLE) AS order_amount,
       order_tax_amount, order_discount_amount, CAST(order_total AS DOUBLE) AS order_total
FROM orders_v""")

DATE_DIFFS = _with("""
SELECT customer_id, CAST(first_date AS VARCHAR) AS first_date,
       CAST(last_date AS VARCHAR) AS last_date, months, weeks, years
FROM spans""")

PURCHASE_AVERAGES = _with("""
SELECT customer_id, avg_monthly_purchase_amount, avg_weekly_purchase_amount,
       avg_yearly_purchase_amount
FROM averages""")


CUSTOMER_FEATURES = _with("""
SELECT customer_id, city, country, gender, marital_status,
       CAST(birthday_date AS VARCHAR) AS birthday_date, age
FROM customer_features""")

MENU_FEATURES = _with("""
SELECT menu_type, truck_brand_name, menu_item_name, item_category, item_subcategory,
       CAST(sale_price_usd AS DOUBLE) AS sale_price_usd
FROM menu_features""")

FILTER_OPTIONS = _with("""
SELECT kind, value,
       row_number() OVER (PARTITION BY kind ORDER BY value NULLS LAST) AS position
FROM (SELECT DISTINCT 'country' AS kind, country AS value FROM customer_features
      UNION ALL SELECT DISTINCT 'city', city FROM customer_features
      UNION ALL SELECT DISTINCT 'truck_brand_name', truck_brand_name FROM menu
      UNION ALL SELECT DISTINCT 'city_in_country', city FROM customer_features
                WHERE country IN ('AMERICA', 'EUROPE'))""")

INTERACTIONS = _with("""
SELECT customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased FROM interactions""")

INTERACTIONS_DEDUP = _with("""
SELECT DISTINCT customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased
FROM interactions""")

NEVER_VISITED = _with(f"""
SELECT {NV_COLUMNS} FROM never_visited""")

AUDIENCE = _with(f"""
SELECT {AUDIENCE_COLUMNS} FROM audience""")

AUDIENCE_FILTERED = _with(f"""
SELECT {AUDIENCE_COLUMNS} FROM audience
WHERE country IN ('AMERICA', 'EUROPE')
  AND city IN ('NATION_1', 'NATION_3', 'NATION_6', 'NATION_8', 'NATION_11')
  AND truck_brand_name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#12', 'Brand#14')
  AND purchased = 0""")

AUDIENCE_NEVER_VISITED = _with(f"""
SELECT {NV_COLUMNS}, city, country, gender, marital_status,
       CAST(birthday_date AS VARCHAR) AS birthday_date, age,
       avg_monthly_purchase_amount, avg_weekly_purchase_amount, avg_yearly_purchase_amount
FROM audience_nv
WHERE country IN ('AMERICA', 'EUROPE') AND purchased = 0""")

AUDIENCE_PAGE = _with(f"""
SELECT {AUDIENCE_COLUMNS} FROM audience
ORDER BY customer_id, menu_item_name LIMIT 10000""")

SPLIT_COUNTS = _with("""
SELECT CASE WHEN h % 10000 < 1000 THEN 'train'
            WHEN h % 10000 < 2000 THEN 'validation' ELSE 'test' END AS split,
       count(*) AS rows
FROM hashed GROUP BY 1""")

SAMPLE_N = _with("""
SELECT customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased
FROM hashed WHERE h % 10000 >= 2000
ORDER BY md5(CAST(customer_id AS VARCHAR) || '|' || menu_item_name), customer_id,
         menu_item_name
LIMIT 5000""")

TOP3_ITEMS = _with("""
SELECT customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased, prediction,
       CAST(rank AS BIGINT) AS rank
FROM top3""")

PURCHASE_HISTORY = _with("""
SELECT customer_id, purchase_history FROM history""")

RECOMMENDATIONS = _with("""
SELECT r.customer_id, r.city, coalesce(h.purchase_history, '') AS purchase_history,
       r.menu_item_name
FROM (SELECT customer_id, min(city) AS city,
             string_agg(menu_item_name, '|' ORDER BY rank, menu_item_name) AS menu_item_name
      FROM top3 GROUP BY customer_id) r
LEFT JOIN history h ON r.customer_id = h.customer_id""")

AUC = _with("""
SELECT CASE WHEN sum(pos) * sum(neg) > 0
            THEN CAST(sum(pos * (2 * neg_before + neg)) AS DOUBLE)
                 / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2.0)
       END AS auc
FROM (
    SELECT pos, neg,
           coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                     AND 1 PRECEDING), 0) AS neg_before
    FROM (SELECT prediction AS score,
                 sum(CASE WHEN purchased = 1 THEN 1 ELSE 0 END) AS pos,
                 sum(CASE WHEN purchased = 0 THEN 1 ELSE 0 END) AS neg
          FROM scored WHERE prediction IS NOT NULL GROUP BY prediction))""")

BINARY_METRICS = _with("""
SELECT tp, fp, fn, tn, precision, recall,
       CASE WHEN precision + recall > 0
            THEN precision * recall * 2.0 / (precision + recall) ELSE 0.0 END AS f1
FROM (
    SELECT tp, fp, fn, tn,
           CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)
                ELSE 0.0 END AS precision,
           CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE)
                ELSE 0.0 END AS recall
    FROM (SELECT CAST(count(*) FILTER (WHERE purchased = 1 AND prediction >= 0.5) AS BIGINT) AS tp,
                 CAST(count(*) FILTER (WHERE purchased = 0 AND prediction >= 0.5) AS BIGINT) AS fp,
                 CAST(count(*) FILTER (WHERE purchased = 1 AND prediction < 0.5) AS BIGINT) AS fn,
                 CAST(count(*) FILTER (WHERE purchased = 0 AND prediction < 0.5) AS BIGINT) AS tn
          FROM scored))""")

TRAINING_SET = _with("""
SELECT customer_id, menu_item_name_c AS menu_item_name, CAST(purchased AS BIGINT) AS purchased,
       city_c AS city, country_c AS country, gender_c AS gender,
       marital_status_c AS marital_status, age_s AS age, menu_type_c AS menu_type,
       truck_brand_name_c AS truck_brand_name, item_category_c AS item_category,
       item_subcategory_c AS item_subcategory, sale_price_usd_s AS sale_price_usd,
       avg_monthly_s AS avg_monthly_purchase_amount, avg_weekly_s AS avg_weekly_purchase_amount,
       avg_yearly_s AS avg_yearly_purchase_amount
FROM coded WHERE h % 10000 < 1000""")

SAVED_SETS = TRAINING_SET.replace("FROM coded WHERE h % 10000 < 1000", """,
       CASE WHEN h % 10000 < 1000 THEN 'train' ELSE 'validation' END AS split
FROM coded WHERE h % 10000 < 2000""")

SAVED_MENU_FEATURES = _with("""
SELECT menu_type, truck_brand_name, menu_item_name, item_category, item_subcategory,
       CAST(sale_price_usd AS DOUBLE) AS sale_price_usd
FROM menu""")

METRIC_LOG = f"""
SELECT 'run-1' AS run_id, 'menu_recommender' AS model_name, 'V1' AS version, metric, round(value, 4) AS value
FROM (SELECT 'AUC' AS metric, auc AS value FROM ({AUC})
      UNION ALL SELECT 'Precision', precision FROM ({BINARY_METRICS})
      UNION ALL SELECT 'Recall', recall FROM ({BINARY_METRICS})
      UNION ALL SELECT 'F1_Score', f1 FROM ({BINARY_METRICS}))"""

ENCODER_FILE = _with("SELECT feature, value, code FROM enc")

ENCODED = _with("""
SELECT customer_id, menu_item_name, city, truck_brand_name, CAST(purchased AS BIGINT) AS purchased,
       menu_item_name_c AS menu_item_name_encoded, menu_type_c AS menu_type_encoded,
       truck_brand_name_c AS truck_brand_name_encoded, item_category_c AS item_category_encoded,
       item_subcategory_c AS item_subcategory_encoded, city_c AS city_encoded,
       country_c AS country_encoded, gender_c AS gender_encoded,
       marital_status_c AS marital_status_encoded
FROM coded""")

SCALED = _with("""
SELECT customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased,
       sale_price_usd_s AS sale_price_usd, age_s AS age,
       avg_monthly_s AS avg_monthly_purchase_amount, avg_weekly_s AS avg_weekly_purchase_amount,
       avg_yearly_s AS avg_yearly_purchase_amount
FROM scaled""")


def _dense(layer: int, inputs: list[str], width: int, prefix: str, relu: bool = True) -> str:
    """Select list of one dense layer; its bias is the layer after it.  Weights
    follow the rule ((layer + 5 row + 3 column) mod 7 - 3) / 8."""
    out = []
    for j in range(width):
        terms = [f"{x} * ({((layer + 5 * i + 3 * j) % 7 - 3) / 8.0}::DOUBLE)"
                 for i, x in enumerate(inputs)]
        total = " + ".join(terms) + f" + ({((layer + 1 + 3 * j) % 7 - 3) / 8.0}::DOUBLE)"
        out.append(f"{f'greatest({total}, 0)' if relu else total} AS {prefix}{j}")
    return ", ".join(out)


def _fixed_model() -> list[str]:
    """Dense inputs -> 3 -> 2 (h); sum of the 2-wide embeddings (e); products of
    all pairs of (h, e), then h -> 3 -> 2 -> 1.  Layers are numbered in the order
    embedding, bottom weights and biases, top weights and biases."""
    codes = ["menu_item_name_c", "menu_type_c", "truck_brand_name_c", "item_category_c",
             "item_subcategory_c", "city_c", "country_c", "gender_c", "marital_status_c"]
    dense = ["sale_price_usd_s", "age_s", "avg_monthly_s", "avg_weekly_s", "avg_yearly_s"]
    embedded = [" + ".join(f"((5 * coalesce({c}, reserved) + {3 * d}) % 7 - 3) / 8.0::DOUBLE"
                           for c in codes) + f" AS e{d}" for d in range(2)]
    single = [f"CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE) AS x{i}"
              for i, c in enumerate(dense)]
    z = ["h0", "h1", "e0", "e1"]
    pairs = [f"({z[i]} * {z[j]})" for i in range(4) for j in range(i, 4)]
    return [
        "inputs AS (SELECT customer_id, menu_item_name, purchased, h, "
        f"{', '.join(embedded + single)}\n"
        "    FROM coded CROSS JOIN (SELECT max(code) + 1 AS reserved FROM enc))",
        f"layer1 AS (SELECT *, {_dense(1, [f'x{i}' for i in range(5)], 3, 'a')} FROM inputs)",
        f"layer2 AS (SELECT *, {_dense(3, ['a0', 'a1', 'a2'], 2, 'h')} FROM layer1)",
        f"layer3 AS (SELECT *, {_dense(5, [*pairs, 'h0', 'h1'], 3, 'b')} FROM layer2)",
        f"layer4 AS (SELECT *, {_dense(7, ['b0', 'b1', 'b2'], 2, 'c')} FROM layer3)",
        f"layer5 AS (SELECT *, {_dense(9, ['c0', 'c1'], 1, 'logit', relu=False)} FROM layer4)",
        # rows of a split in key order, in batches of 256 and shards of 2,048
        "placed AS (SELECT *, CASE WHEN h % 10000 < 1000 THEN 0 WHEN h % 10000 < 2000 THEN 1 ELSE 2 END AS part\n"
        "    FROM layer5)",
        "lossy AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY\n"
        "        md5(CAST(customer_id AS VARCHAR) || '|' || menu_item_name), customer_id, menu_item_name) - 1 AS BIGINT) AS pos,\n"
        "        greatest(logit0, 0) - logit0 * purchased + ln(1 + exp(-abs(logit0))) AS loss FROM placed)",
        "batched AS (SELECT part, pos // 2048 AS shard, pos // 256 AS batch, count(*) AS rows, avg(loss) AS loss\n"
        "    FROM lossy GROUP BY part, pos // 2048, pos // 256)"]


def _dlrm_forward() -> str:
    return _with(
        "SELECT customer_id, menu_item_name, CAST(purchased AS BIGINT) AS purchased,\n"
        "       floor(logit0 * 1000000 + 0.5) / 1000000 AS prediction FROM layer5", *_fixed_model()[:6])


def _dlrm_loss() -> str:
    return _with(
        "SELECT shard, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS batches,\n"
        "       floor(avg(loss) * 1000000 + 0.5) / 1000000 AS loss\n"
        "FROM batched WHERE part = 1 GROUP BY shard", *_fixed_model())


def _train_ledger() -> str:
    """Every shard starts from the step that the longest shard reached before."""
    return _with(
        "SELECT CAST(e.epoch AS BIGINT) AS epoch, s.shard, s.rows, s.batches,\n"
        "       s.batches + (e.epoch - 1) * (SELECT max(batches) FROM taken) AS steps,\n"
        "       CASE WHEN e.epoch = 1 THEN floor(s.first_loss * 1000000 + 0.5) / 1000000 END AS first_loss\n"
        "FROM taken s CROSS JOIN (SELECT unnest([1, 2]) AS epoch) e", *_fixed_model(),
        "taken AS (SELECT shard, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS batches, arg_min(loss, batch) AS first_loss\n"
        "    FROM batched WHERE part = 0 GROUP BY shard)")


# Per raw table: its number of columns and those that the fixture fills, by kind.
FILLED = {
    "country": (7, ["iso_country", "country", "city"], ["city_id"], []),
    "menu": (11, ["menu_type", "menu_item_name", "item_category", "item_subcategory", "truck_brand_name"],
             ["menu_item_id", "menu_item_id", "sale_price_usd"], []),
    "location": (7, ["city || '..' || country || '.'", "city", "country"], ["location_id"], []),
    "order_detail": (9, [], ["order_detail_id", "order_id", "menu_item_id", "line_number", "quantity", "price"], []),
    "order_header": (16, [], ["order_id", "truck_id", "location_id", "customer_id", "order_total"], ["order_ts"]),
    "truck": (14, ["primary_city", "region", "country"], ["truck_id", "franchise_flag", "franchise_id"], []),
    "franchise": (7, ["last_name"], ["franchise_id"], []),
    "customer_loyalty": (15, ["first_name", "city", "country", "gender", "marital_status"],
                         ["customer_id"], ["birthday_date"]),
}


def _bulk_load() -> str:
    def total(parts):
        return " + ".join(f"coalesce(sum({p}), 0)" for p in parts) or "0"

    def table(name):
        n, text, numbers, days = FILLED[name]
        filled = [*text, *numbers, *days]
        nulls = " + ".join([f"{n - len(filled)} * count(*)", *[f"(count(*) - count({c}))" for c in filled]])
        chars = total([f"length({c})" for c in text])
        sums = total([f"CAST({c} AS DECIMAL(28,4))" for c in numbers])
        since = total([f"date_diff('day', DATE '1970-01-01', CAST({c} AS DATE))" for c in days])
        return (f"SELECT '{name}' AS table_name, count(*) AS rows, count(*) AS manifest_rows,\n"
                f"       CAST({nulls} AS BIGINT) AS nulls, CAST({chars} AS BIGINT) AS chars,\n"
                f"       CAST({sums} AS DOUBLE) AS numbers, CAST({since} AS BIGINT) AS days\nFROM {name}")

    return _with("\nUNION ALL ".join(table(n) for n in FILLED),
                 "country AS (SELECT n_nationkey AS city_id, n_name AS city, r_name AS country,\n"
                 "    substr(r_name, 1, 2) AS iso_country FROM geo)")


INCREMENTAL_LOAD = _with("""
SELECT CAST(CASE WHEN order_id % 4 < 3 THEN 1 ELSE 2 END AS BIGINT) AS load_no,
       count(DISTINCT order_id % 4) AS files, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity
FROM order_detail GROUP BY 1""")


# Snapshots: state and view of the purchase view, before and after its refresh
# (4); each registration, refresh and dataset adds one; the first vacuum keeps
# state, two views and the dataset, the last keeps none.
FEATURE_STORE = _with("""
SELECT CAST(step AS BIGINT) AS step, name, CAST(rows AS BIGINT) AS rows, CAST(snapshots AS BIGINT) AS snapshots FROM (
    SELECT 1 AS step, 'register view' AS name, count(*) AS rows, 5 AS snapshots FROM customer_features WHERE country = 'ASIA'
    UNION ALL SELECT 2, 'refresh view', count(*), 6 FROM customer_features
    UNION ALL SELECT 3, 'get view', count(*), 6 FROM customer_features
    UNION ALL SELECT 4, 'list views', 2, 6
    UNION ALL SELECT 5, 'dataset', count(*), 7 FROM customer_features
    UNION ALL SELECT 6, 'part of the dataset', count(*), 7 FROM averages WHERE customer_id % 3 = 1
    UNION ALL SELECT 7, 'vacuum', 3, 4
    UNION ALL SELECT 8, 'list views after a delete', 1, 4
    UNION ALL SELECT 9, 'list entities after all deletes', 0, 4
    UNION ALL SELECT 10, 'last vacuum', 4, 0)""")


def oracle_sql() -> dict[str, str]:
    return {
        "dlrm_forward": _dlrm_forward(),
        "dlrm_loss": _dlrm_loss(),
        "train_ledger": _train_ledger(),
        "orders_v": ORDERS_V,
        "date_diffs": DATE_DIFFS,
        "purchase_averages": PURCHASE_AVERAGES,
        "customer_features": CUSTOMER_FEATURES,
        "menu_features": MENU_FEATURES,
        "filter_options": FILTER_OPTIONS,
        "filter_options_sql": FILTER_OPTIONS,
        "bulk_load": _bulk_load(),
        "refreshed_features": PURCHASE_AVERAGES,
        "feature_store": FEATURE_STORE,
        "incremental_load": INCREMENTAL_LOAD,
        "interactions": INTERACTIONS,
        "interactions_dedup": INTERACTIONS_DEDUP,
        "never_visited": NEVER_VISITED,
        "audience": AUDIENCE,
        "audience_filtered": AUDIENCE_FILTERED,
        "audience_never_visited": AUDIENCE_NEVER_VISITED,
        "audience_page": AUDIENCE_PAGE,
        "split_counts": SPLIT_COUNTS,
        "sample_n": SAMPLE_N,
        "top3_items": TOP3_ITEMS,
        "purchase_history": PURCHASE_HISTORY,
        "recommendations": RECOMMENDATIONS,
        "auc": AUC,
        "binary_metrics": BINARY_METRICS,
        "training_set": TRAINING_SET,
        "encoded": ENCODED,
        "saved_sets": SAVED_SETS,
        "saved_customer_features": CUSTOMER_FEATURES,
        "saved_menu_features": SAVED_MENU_FEATURES,
        "saved_recommendations": RECOMMENDATIONS,
        "metric_log": METRIC_LOG,
        "encoder_file": ENCODER_FILE,
        "scaled": SCALED,
    }
