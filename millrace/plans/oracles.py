"""The registered queries as SQL for another engine (DuckDB), over the same tables.

Amounts are summed as decimals and cast to double at the end, as the Spark jobs do. The
statements are written independently of the jobs: window functions, anti-joins and recursive
queries where the jobs use counts and rounds.
"""

from __future__ import annotations

CUSTOMERS = """raw_customers AS (
  SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '_')) || '@example.com' AS email, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ORDERS = """raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS order_ts FROM orders)"""
PRODUCTS = """raw_products AS (SELECT p_partkey AS product_id, p_type AS category, p_retailprice AS price FROM part)"""
RAW = f"WITH RECURSIVE {CUSTOMERS}, {ORDERS}, {PRODUCTS}"

MODULUS = "(SELECT count(*) * 6 // 5 FROM part)"
SECOND = "(SELECT max(o_orderkey) * 2 // 5 FROM orders)"
THIRD = "(SELECT max(o_orderkey) * 4 // 5 FROM orders)"

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
AMOUNT = MONEY.format("amount")

STATS = f"""stats AS (
  SELECT customer_id, count(*) AS orders_count, {AMOUNT} AS total_spent, {AMOUNT} / count(amount) AS avg_check,
         min(order_ts) AS first_order_ts, max(order_ts) AS last_order_ts
  FROM raw_orders GROUP BY customer_id)"""
JOINED = """joined AS (
  SELECT o.order_id, o.amount, o.order_ts, c.id AS customer_id, c.name AS customer_name, c.country
  FROM raw_orders o JOIN raw_customers c ON c.id = o.customer_id)"""
METRICS = f"""metrics AS (
  SELECT country, count(*) AS orders_count, count(DISTINCT customer_id) AS unique_customers,
         {AMOUNT} AS revenue, {AMOUNT} / count(amount) AS avg_check
  FROM joined GROUP BY country)"""
TOP = """SELECT country, orders_count, unique_customers, revenue, revenue / unique_customers AS revenue_per_customer
  FROM metrics ORDER BY revenue DESC NULLS LAST, country LIMIT 3"""
WIDE = f"""wide AS (
  SELECT o.order_id, c.id AS customer_id, c.name AS customer_name, c.country AS customer_country,
         o.amount AS order_amount, o.order_ts AS order_ts, p.category AS product_category, p.price AS product_price
  FROM raw_orders o JOIN raw_customers c ON c.id = o.customer_id
  LEFT JOIN raw_products p ON p.product_id = o.order_id % {MODULUS})"""
PRICED = f"""priced AS (
  SELECT o.order_id, o.customer_id, p.category AS product_category, p.price AS product_price
  FROM raw_orders o LEFT JOIN raw_products p ON p.product_id = o.order_id % {MODULUS})"""
DRIFT = f"""merged AS (
  SELECT order_id AS event_id, customer_id AS user_id, order_ts AS ts, NULL::VARCHAR AS country, NULL::VARCHAR AS device
  FROM raw_orders WHERE order_id < {SECOND}
  UNION ALL
  SELECT o.order_id, o.customer_id, o.order_ts, c.country, NULL
  FROM raw_orders o JOIN raw_customers c ON c.id = o.customer_id
  WHERE o.order_id BETWEEN {SECOND} AND {THIRD} - 1
  UNION ALL
  SELECT order_id, NULL, order_ts, NULL, list_extract(['ios', 'android', 'web'], CAST(order_id % 3 + 1 AS INT))
  FROM raw_orders WHERE order_id >= {THIRD})"""
PROFILE = """SELECT count(*) - count(event_id) AS event_id, count(*) - count(user_id) AS user_id, count(*) - count(ts) AS ts,
  count(*) - count(country) AS country, count(*) - count(device) AS device FROM merged"""
MERGED = "SELECT event_id, user_id, ts, country, device FROM merged"

SALES = """sales AS (
  SELECT i AS id, 'region_' || (i % 5) AS region, CAST(i * 7 % 100 AS DOUBLE) AS amount
  FROM (SELECT {} AS i FROM {}))"""
LINE_NUMBER = "l_orderkey * 8 + l_linenumber"

# Fixed values, as in the column expressions.
POINT_MODULUS = 1_000_000_007
POINT_X = 754_877_669
POINT_Y = 569_840_296
MIX_MODULUS = 2_147_483_647
MIX_FACTORS = (1_597_334_677, 747_796_405, 1_181_783_497)

ENRICHED = """SELECT id, name || ' <' || email || '>' AS contact, upper(name) AS name_upper,
  string_split(email, '@')[2] AS email_domain, lower(country) AS country_lower, CAST(id AS VARCHAR) AS id_str
  FROM raw_customers"""

COUNTRY_TOTALS = f"SELECT country, count(*) AS orders, {AMOUNT} AS revenue FROM joined GROUP BY country"

SUMMARY = """SELECT c.id, c.name, upper(c.country) AS country_code, coalesce(s.total_spent, 0.0::DOUBLE) AS total_spent
  FROM raw_customers c LEFT JOIN stats s ON s.customer_id = c.id"""

WAREHOUSE = {
    "src1_range": f"WITH {SALES.format('o_orderkey', 'orders')} SELECT id, region, amount FROM sales",
    "src2_parquet": "SELECT * FROM orders",
    "src3_merged": f"{RAW}, {DRIFT} {MERGED}",
    "src3_widened": """SELECT o_orderkey AS order_id,
          CASE o_orderkey % 4 WHEN 2 THEN o_totalprice WHEN 3 THEN 0 ELSE floor(o_totalprice) END AS amount,
          CASE o_orderkey % 4 WHEN 3 THEN 'c' ELSE '' END || o_custkey AS code
        FROM orders""",
    "src4_table": f"{RAW} SELECT id, name, email, country FROM raw_customers",
    "src5_csv": "SELECT CAST(c_custkey AS INT) AS id, c_name AS name FROM customer",
    "src5_external": "SELECT CAST(c_custkey AS INT) AS id, c_name AS name FROM customer",
    "src6_text": """SELECT value, count(*) AS n
        FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS value FROM documents) GROUP BY value""",
    "src7_slices": "SELECT count(DISTINCT o_orderkey) AS cnt, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders",
    "src8_values": """SELECT t.id, t.name, e.events
        FROM (VALUES ('signup', 1, 'Test1'), ('purchase', 2, 'Test2')) AS t(kind, id, name)
        JOIN (SELECT event_type, count(*) AS events FROM events GROUP BY event_type) e ON e.event_type = t.kind""",
    "src9_files": "SELECT true AS all_scanned, count(*) AS row_count FROM orders",
    "snk1_overwrite": f"{RAW}, {STATS} SELECT * FROM stats",
    "snk2_append": f"""{RAW} SELECT order_id, customer_id, amount, NULL::VARCHAR AS country FROM raw_orders
        UNION ALL SELECT NULL, id, NULL, country FROM raw_customers""",
    "snk3_ctas": f"{RAW}, {STATS} SELECT * FROM stats",
    "snk4_replace_schema": f"{RAW} SELECT id, name AS full_name, country FROM raw_customers",
    "snk4_replace_itself": f"{RAW} SELECT id, name AS full_name, country FROM raw_customers",
    "snk5_insert": """SELECT CAST(c_custkey AS INT) AS id, c_name AS name FROM customer
        UNION ALL SELECT * FROM (VALUES (-1, 'Test1'), (-2, 'Test2')) AS t(id, name)""",
    "snk6_ddl": "SELECT 'stage_one' AS table_name, count(*) AS cnt FROM customer",
    "snk7_filecount": "SELECT CAST(8 AS BIGINT) AS files, count(*) AS row_count FROM orders",
    "snk8_clean_rerun": f"{RAW}, {DRIFT} {MERGED}",
    "snk8_partition_rerun": """SELECT o_orderkey, o_totalprice + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS o_totalprice,
        o_orderstatus FROM orders""",
    "prj1_subset": f"{RAW} SELECT id, name, country FROM raw_customers",
    "prj2_rename": f"{RAW} SELECT id, name AS full_name, country FROM raw_customers",
    "prj3_concat": f"{RAW} SELECT id, name || ' <' || email || '>' AS contact FROM raw_customers",
    "prj4_functions": f"""{RAW} SELECT id, upper(name) AS name_upper, string_split(email, '@')[2] AS email_domain,
        lower(country) AS country_lower, CAST(id AS VARCHAR) AS id_str FROM raw_customers""",
    "prj5_ratio": f"{RAW}, {JOINED}, {METRICS} SELECT country, revenue / unique_customers AS revenue_per_customer FROM metrics",
    "prj6_default": f"""{RAW}, {PRICED} SELECT order_id, coalesce(product_category, 'none') AS category,
        coalesce(product_price, 0.0::DOUBLE) AS price FROM priced""",
    "prj7_computed": """SELECT o_orderkey AS order_id, 'user_' || (o_orderkey % 100) AS name,
        CAST(o_orderkey * 7 % 100 AS DOUBLE) AS amount, o_orderkey % 5 AS region_id,
        make_timestamp((1700000000 + o_orderkey * 60) * 1000000) AS order_ts FROM orders""",
    "prj8_position": """SELECT o_orderkey AS order_id,
        list_extract(['ios', 'android', 'web'], CAST(o_orderkey % 3 + 1 AS INT)) AS device,
        list_extract(['RU', 'US', 'DE', 'FR'], CAST(o_orderkey % 4 + 1 AS INT)) AS country FROM orders""",
    "flt1_lt": f"{RAW} SELECT * FROM raw_orders WHERE order_id < {SECOND}",
    "flt2_between": f"{RAW} SELECT * FROM raw_orders WHERE order_id BETWEEN {SECOND} AND {THIRD} - 1",
    "flt3_ge": f"{RAW} SELECT * FROM raw_orders WHERE order_id >= {THIRD}",
    "flt4_null": f"{RAW}, {PRICED} SELECT order_id, customer_id FROM priced WHERE product_category IS NULL",
    "flt5_contains": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget')",
    "flt6_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red %'",
    "flt7_since": f"{RAW} SELECT order_id, order_ts FROM raw_orders WHERE order_ts >= TIMESTAMP '1998-01-01'",
    "flt8_states": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "jn1_inner": f"{RAW}, {JOINED} SELECT * FROM joined",
    "jn2_modulo_left": f"{RAW}, {PRICED} SELECT order_id, product_category, product_price FROM priced",
    "jn3_three_way": f"{RAW}, {WIDE} SELECT * FROM wide",
    "jn4_left_agg": f"{RAW}, {STATS} {SUMMARY}",
    "jn5_join_group": f"{RAW}, {JOINED} {COUNTRY_TOTALS}",
    "agg1_sum_count": f"""SELECT l_returnflag, {MONEY.format('l_extendedprice')} AS total_amount, count(*) AS row_count
        FROM lineitem GROUP BY l_returnflag""",
    "agg2_metrics": f"{RAW}, {STATS} SELECT * FROM stats",
    "agg3_distinct": f"""SELECT o_orderpriority, count(*) AS orders_count, count(DISTINCT o_custkey) AS unique_customers,
        {MONEY.format('o_totalprice')} AS revenue, {MONEY.format('o_totalprice')} / count(o_totalprice) AS avg_check
        FROM orders GROUP BY o_orderpriority""",
    "agg3_by_batches": f"""{RAW}, {JOINED} SELECT country, count(*) AS orders_count, count(DISTINCT customer_id) AS unique_customers,
        {AMOUNT} AS revenue, {AMOUNT} / count(amount) AS avg_check, min(order_ts) AS first_order_ts, max(order_ts) AS last_order_ts
        FROM joined GROUP BY country""",
    "scl14_random": f"""WITH a AS (SELECT o_orderkey, (o_orderkey % {MIX_MODULUS} * {MIX_FACTORS[0]} % {MIX_MODULUS}
            + o_orderkey // {MIX_MODULUS} % {MIX_MODULUS} * {MIX_FACTORS[1]} % {MIX_MODULUS}
            + CAST(42 AS BIGINT) * {MIX_FACTORS[2]} % {MIX_MODULUS}) % {MIX_MODULUS} AS x FROM orders),
        b AS (SELECT o_orderkey, xor(x, x >> 15) * {MIX_FACTORS[0]} % {MIX_MODULUS} AS x FROM a),
        c AS (SELECT o_orderkey, xor(x, x >> 13) * {MIX_FACTORS[1]} % {MIX_MODULUS} AS x FROM b),
        d AS (SELECT o_orderkey, xor(x, x >> 16) * {MIX_FACTORS[2]} % {MIX_MODULUS} AS x FROM c)
        SELECT o_orderkey, CAST(x AS DOUBLE) / {MIX_MODULUS} AS drawn FROM d""",
    "agg4_null_share": f"""{RAW}, {WIDE} SELECT CAST(round(
        100.0 * sum(CASE WHEN product_category IS NULL THEN 1 ELSE 0 END) / count(*), 1) AS DOUBLE) AS null_pct FROM wide""",
    "agg5_null_profile": f"{RAW}, {DRIFT} {PROFILE}",
    "agg6_row_count": "SELECT count(*) AS cnt FROM lineitem",
    "agg7_reduce": f"""SELECT {MONEY.format('l_quantity')} AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers
        FROM lineitem""",
    "agg8_wordcount": """SELECT word, count(*) AS n
        FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents)
        WHERE word <> '' GROUP BY word""",
    "agg9_pi_lattice": f"""WITH points AS (
          SELECT i % {POINT_MODULUS} * {POINT_X} % {POINT_MODULUS} AS x, i % {POINT_MODULUS} * {POINT_Y} % {POINT_MODULUS} AS y
          FROM (SELECT {LINE_NUMBER} AS i FROM lineitem)),
        hits AS (SELECT count(*) FILTER (x * x + y * y <= {POINT_MODULUS}::BIGINT * {POINT_MODULUS}) AS inside, count(*) AS points
          FROM points)
        SELECT inside, points, CAST(4 * inside AS DOUBLE) / points AS pi FROM hits""",
    "top1_topk": f"{RAW}, {JOINED}, {METRICS} {TOP}",
    "top2_sorted": f"{RAW}, {STATS} SELECT customer_id, total_spent FROM stats ORDER BY total_spent DESC, customer_id",
    "set1_union_by_name": f"{RAW}, {DRIFT} {MERGED}",
    "pip1_generate_aggregate": f"""WITH {SALES.format(LINE_NUMBER, 'lineitem')}
        SELECT region, {AMOUNT} AS total_amount, count(*) AS row_count FROM sales GROUP BY region""",
    "pip2_chain": f"{RAW}, {JOINED}, {METRICS} {TOP}",
    "pip2_chain_views": f"{RAW}, {JOINED}, {METRICS} {TOP}",
    "pip3_rerun": f"{RAW}, {JOINED} {COUNTRY_TOTALS}",
    "pip4_versions": f"{RAW}, {STATS} {SUMMARY}",
    "pip5_drift": f"{RAW}, {DRIFT} {PROFILE}",
    "pip6_staging": f"{RAW} {ENRICHED}",
}

RUN_EVENTS = """WITH run_events AS (
  SELECT event_id, event_id // 4 AS run_id, 'job_' || (event_id // 4 % 20) AS job,
         sha256('SELECT * FROM t WHERE k = ' || json_extract_string(props, '$.k')) AS version,
         CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL'
           ELSE 'RUNNING' END AS state, ts
  FROM events)"""
RUN_STATES = """SELECT run_id, min(job) AS job, max_by(state, {'ts': ts, 'id': event_id}) AS state,
  coalesce(min(ts) FILTER (state = 'START'), min(ts)) AS started_at, max(ts) AS last_ts,
  date_diff('microsecond', coalesce(min(ts) FILTER (state = 'START'), min(ts)), max(ts)) AS duration_us, count(*) AS events
  FROM run_events GROUP BY run_id"""

FIELDS = """WITH fields AS (
  SELECT DISTINCT 'warehouse' AS namespace, 'supplier_' || l_suppkey AS name, l_linenumber AS version,
         l_partkey % 200 AS pos, 'c' || (l_partkey % 200) AS field,
         CASE WHEN (l_partkey % 200 + l_linenumber) % 3 = 0 THEN 'bigint' ELSE 'double' END AS type
  FROM lineitem)"""
CHANGES = f"""{FIELDS},
history AS (SELECT namespace, name, version, lag(version) OVER (PARTITION BY namespace, name ORDER BY version) AS previous
  FROM (SELECT DISTINCT namespace, name, version FROM fields)),
changes AS (
  SELECT f.namespace, f.name, f.version, f.field, 'added' AS change
  FROM fields f JOIN history h USING (namespace, name, version)
  WHERE h.previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields p
    WHERE p.namespace = f.namespace AND p.name = f.name AND p.version = h.previous AND p.field = f.field)
  UNION ALL
  SELECT p.namespace, p.name, h.version, p.field, 'dropped'
  FROM history h JOIN fields p ON p.namespace = h.namespace AND p.name = h.name AND p.version = h.previous
  WHERE NOT EXISTS (SELECT 1 FROM fields f
    WHERE f.namespace = p.namespace AND f.name = p.name AND f.version = h.version AND f.field = p.field)
  UNION ALL
  SELECT f.namespace, f.name, f.version, f.field, 'retyped'
  FROM fields f JOIN history h USING (namespace, name, version)
    JOIN fields p ON p.namespace = f.namespace AND p.name = f.name AND p.version = h.previous AND p.field = f.field
  WHERE p.type <> f.type)"""

LINE_EDGES = """WITH edges AS (
  SELECT DISTINCT 'load_' || l_returnflag AS job, 'supplier_' || l_suppkey AS out_dataset, 'line_' || l_linenumber AS out_column,
         'flag_' || l_returnflag AS in_dataset, 'c' || (l_partkey % 40) AS in_column,
         CASE l_linestatus WHEN 'O' THEN 'DIRECT' ELSE 'INDIRECT' END AS type,
         CASE l_linestatus WHEN 'O' THEN list_extract(['IDENTITY', 'TRANSFORMATION', 'AGGREGATION'], CAST(l_partkey % 3 + 1 AS INT))
           ELSE list_extract(['JOIN', 'GROUP_BY', 'FILTER'], CAST(l_partkey % 3 + 1 AS INT)) END AS subtype
  FROM lineitem)"""
EDGE = "out_dataset, out_column, in_dataset, in_column, type, subtype"

PART_EDGES = """WITH RECURSIVE links AS (
  SELECT p_partkey AS o, p_partkey // 2 AS i, p_size // 3 % 3 AS strength FROM part WHERE p_partkey <> p_partkey // 2
  UNION SELECT p_partkey, p_partkey // 3, p_size % 3 FROM part WHERE p_partkey <> p_partkey // 3)"""


LOOPED_EDGES = """WITH RECURSIVE links AS (
  SELECT p_partkey AS o, p_partkey // 2 AS i FROM part WHERE p_partkey <> p_partkey // 2
  UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey <> p_partkey // 3
  UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_size = 10 AND p_partkey > 1),
reach AS (SELECT o AS a, i AS b FROM links UNION SELECT r.a, l.i FROM reach r JOIN links l ON l.o = r.b),
cycles AS (
  SELECT x.a AS node, least('part_' || x.a, min('part_' || x.b)) AS cycle
  FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a)"""
#: Longest ways in a graph `steps` (o reads i).
LEVELS = """depths AS (
  SELECT i AS node, 0 AS level FROM steps WHERE i NOT IN (SELECT o FROM steps)
  UNION SELECT s.o, d.level + 1 FROM depths d JOIN steps s ON s.i = d.node),
levels AS (SELECT node, CAST(max(level) AS INT) AS level FROM depths GROUP BY node)"""


VIEWS = "{} IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))"


def _reached(first: str, from_end: str, to_end: str, depth: int | None = None) -> str:
    bound = "" if depth is None else f" WHERE w.hops < {depth}"
    return f"""walk AS (
      SELECT {from_end} AS a, {to_end} AS b, 1 AS hops FROM links WHERE {first}
      UNION
      SELECT w.a, l.{to_end}, w.hops + 1 FROM walk w JOIN links l ON l.{from_end} = w.b{bound}),
    reached AS (SELECT a, b, CAST(min(hops) AS INT) AS hops FROM walk WHERE a <> b GROUP BY a, b)"""


def _normalised(ns: str) -> str:
    uri = "'^(.*?://)([^/]*)(.*)$'"
    authority = f"regexp_extract({ns}, {uri}, 2, 's')"
    hosts = f"list_filter(list_transform(string_split({authority}, ','), lambda h: trim(h)), lambda h: h <> '')"
    collapsed = (
        f"CASE WHEN contains({authority}, ',') THEN regexp_extract({ns}, {uri}, 1, 's') || "
        f"array_to_string(list_sort({hosts}), '+') || regexp_extract({ns}, {uri}, 3, 's') ELSE {ns} END"
    )
    return f"substr(regexp_replace({collapsed}, '[^a-zA-Z0-9_@+:;=/.-]', '_', 'g'), 1, 1024)"


NAMESPACES = """WITH namespaces AS (
  SELECT url AS namespace FROM pages
  UNION ALL SELECT 'kafka://s' || s_suppkey || ':9092,s' || (s_suppkey + 1) || ':9092' FROM supplier
  UNION ALL SELECT 'kafka://s' || (s_suppkey + 1) || ':9092, s' || s_suppkey || ':9092,' FROM supplier)"""
EVENT_DATASETS = """WITH ends AS (
  SELECT page_id AS event_id, 'INPUT' AS role, url AS namespace FROM pages
  UNION ALL SELECT page_id, 'OUTPUT', regexp_extract(url, '^(.*?://[^/]*)', 1) FROM pages),
judged AS (SELECT *, CASE WHEN namespace IS NULL THEN 'missing' WHEN namespace = '' THEN 'empty'
    WHEN NOT regexp_full_match(namespace, '[a-zA-Z0-9_@+:;=/.-]+') THEN 'illegal'
    WHEN length(namespace) > 1024 THEN 'long' END AS reason FROM ends)"""

LINEAGE = {
    "lin1_datasets": """SELECT DISTINCT c_name AS name FROM customer
        WHERE c_mktsegment = 'BUILDING'""",
    "lin2_jobs": """SELECT DISTINCT 'job_' || o_orderkey || '.' || lower(o_orderpriority) AS job FROM orders
        WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%urgent%'""",
    "lin3_schema_history": f"""{FIELDS} SELECT namespace, name, version, pos // 10000 AS part,
        string_agg(field, ',' ORDER BY pos, field) AS fields FROM fields GROUP BY namespace, name, version, pos // 10000""",
    "lin4_schema_diff": f"{CHANGES} SELECT namespace, name, version, field, change FROM changes",
    "lin4_renames": f"""{CHANGES}, sourced AS (
          SELECT *, 'u' || (CAST(substr(field, 2) AS BIGINT) // 4) AS source FROM changes WHERE change <> 'retyped')
        SELECT namespace, name, version, source, min(field) FILTER (change = 'dropped') AS old_field,
               min(field) FILTER (change = 'added') AS new_field
        FROM sourced GROUP BY namespace, name, version, source
        HAVING count(*) FILTER (change = 'dropped') = 1 AND count(*) FILTER (change = 'added') = 1""",
    "lin4_renames_by_content": f"""{RAW}, overlap AS (
          SELECT field, count(DISTINCT value) FILTER (value IN (SELECT name FROM raw_customers)) AS shared,
            count(DISTINCT value) + (SELECT count(DISTINCT name) FROM raw_customers) AS summed
          FROM (SELECT 'name' AS field, name AS value FROM raw_customers
                UNION ALL SELECT 'email', email FROM raw_customers) GROUP BY field)
        SELECT CAST(3 AS INT) AS version, field AS old_field, 'full_name' AS new_field FROM overlap
        WHERE shared >= 0.5 * (summed - shared) AND shared > 0
        QUALIFY row_number() OVER (ORDER BY shared / (summed - shared) DESC, field) = 1""",
    "lin3_schema_of_run": """WITH changes AS (
          SELECT l_suppkey AS key, l_linenumber AS version, min(l_shipdate) AS since FROM lineitem
          WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_linenumber),
        last AS (SELECT key, since, max(version) AS version FROM changes GROUP BY key, since)
        SELECT l_orderkey * 8 + l_linenumber AS run_id, 'warehouse' AS namespace, 'supplier_' || l_suppkey AS name,
          l_shipdate AS started_at, version
        FROM lineitem ASOF LEFT JOIN last ON l_suppkey = key AND l_shipdate >= since""",
    "lin5_runs": f"{RUN_EVENTS} SELECT job, count(DISTINCT run_id) AS runs FROM run_events GROUP BY job",
    "lin6_versions": f"""{RUN_EVENTS}, counted AS (
          SELECT job, count(DISTINCT version) AS versions, count(DISTINCT run_id) AS runs FROM run_events GROUP BY job)
        SELECT *, CASE WHEN versions > 1 THEN 'many versions' WHEN runs > 1 THEN 'one version, many runs'
          ELSE 'one version, one run' END AS history FROM counted""",
    "lin6_version_runs": f"""{RUN_EVENTS} SELECT job, version, count(DISTINCT run_id) AS runs FROM run_events
        GROUP BY job, version""",
    "lin6_queries": """SELECT 'job_' || (event_id // 4 % 20) AS job, count(DISTINCT json_extract_string(props, '$.k')) AS queries,
          count(DISTINCT event_id % 97) AS versions FROM events GROUP BY event_id // 4 % 20""",
    "lin7_run_states": f"{RUN_EVENTS} {RUN_STATES}",
    "lin7_failed": f"{RUN_EVENTS} SELECT run_id, job FROM ({RUN_STATES}) WHERE state = 'FAIL'",
    "lin7_stream": f"{RUN_EVENTS} {RUN_STATES}",
    "lin8_direct_edges": f"{LINE_EDGES} SELECT DISTINCT {EDGE} FROM edges WHERE type = 'DIRECT'",
    "lin8_current_edges": """WITH last AS (SELECT l_returnflag AS flag, max({'ts': l_shipdate, 'version': l_linestatus}).version AS version
          FROM lineitem GROUP BY l_returnflag)
        SELECT DISTINCT 'load_' || l_returnflag AS job, l_linestatus AS version, 'supplier_' || l_suppkey AS out_dataset,
          'line_' || l_linenumber AS out_column, 'flag_' || l_returnflag AS in_dataset, 'c' || (l_partkey % 40) AS in_column,
          'DIRECT' AS type, 'IDENTITY' AS subtype
        FROM lineitem JOIN last ON l_returnflag = flag AND l_linestatus = version""",
    "lin11_node_graph": """WITH starts AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
        lines AS (SELECT * FROM lineitem JOIN starts ON l_suppkey = s_suppkey),
        jobs AS (SELECT DISTINCT s_suppkey, l_orderkey FROM lines)
        SELECT 'supplier_' || s_suppkey AS start, 'job_' || l_orderkey AS id, 'JOB' AS type, 'UPSTREAM' AS direction,
          CAST(1 AS INT) AS hops FROM jobs
        UNION ALL SELECT DISTINCT 'supplier_' || s_suppkey, 'part_' || l.l_partkey, 'DATASET', 'UPSTREAM', CAST(2 AS INT)
        FROM jobs JOIN lineitem l USING (l_orderkey)""",
    "lin8_subtypes": f"{LINE_EDGES} SELECT job, type, subtype, count(*) AS edges FROM edges GROUP BY job, type, subtype",
    "lin9_indirect_edges": """SELECT DISTINCT 'job_' || o.l_orderkey AS job, '1' AS version, 'mart' AS out_dataset,
          'line_' || o.l_linenumber AS out_column, 'suppliers' AS in_dataset, 'supplier_' || k.l_suppkey AS in_column,
          'INDIRECT' AS type, CASE k.l_linestatus WHEN 'O' THEN 'JOIN' ELSE 'GROUP_BY' END AS subtype
        FROM lineitem o JOIN lineitem k ON k.l_orderkey = o.l_orderkey""",
    "lin10_fan_in": f"""{LINE_EDGES} SELECT out_dataset, out_column, count(*) AS edges,
          count(*) FILTER (type = 'DIRECT') AS direct, count(*) FILTER (type = 'INDIRECT') AS indirect,
          count(*) FILTER (type = 'DIRECT' AND subtype = 'IDENTITY') AS identity,
          count(*) FILTER (type = 'DIRECT' AND subtype = 'TRANSFORMATION') AS transformation,
          count(*) FILTER (type = 'DIRECT' AND subtype = 'AGGREGATION') AS aggregation
        FROM (SELECT DISTINCT {EDGE} FROM edges) GROUP BY out_dataset, out_column""",
    "lin11_upstream": f"""{PART_EDGES}, {_reached(VIEWS.format('o'), 'o', 'i')}
        SELECT 'part_' || a AS dataset, 'part_' || b AS upstream, hops FROM reached""",
    "lin11_upstream_of_marts": f"""{PART_EDGES}, {_reached('o NOT IN (SELECT i FROM links)', 'o', 'i')}
        SELECT 'part_' || a AS dataset, 'part_' || b AS upstream, hops FROM reached""",
    "lin11_downstream": f"""{PART_EDGES}, {_reached(VIEWS.format('i'), 'i', 'o', 3)}
        SELECT 'part_' || a AS dataset, 'part_' || b AS downstream, hops FROM reached""",
    "lin11_downstream_to_the_end": f"""{PART_EDGES}, {_reached(VIEWS.format('i'), 'i', 'o')}
        SELECT 'part_' || a AS dataset, 'part_' || b AS downstream, hops FROM reached""",
    "lin11_cycles": f"{LOOPED_EDGES} SELECT 'part_' || node AS dataset, cycle FROM cycles",
    "lin11_levels": f"""{LOOPED_EDGES},
        nodes AS (SELECT o AS n FROM links UNION SELECT i FROM links),
        whole AS (SELECT n, coalesce(cycle, 'part_' || n) AS name FROM nodes LEFT JOIN cycles ON node = n),
        steps AS (
          SELECT DISTINCT x.name AS o, y.name AS i FROM links JOIN whole x ON x.n = o JOIN whole y ON y.n = i
          WHERE x.name <> y.name),
        {LEVELS}
        SELECT 'part_' || n AS dataset, level FROM whole JOIN levels ON node = name""",
    "lin11_rerun_order": f"""{PART_EDGES}, steps AS (SELECT DISTINCT o, i FROM links), {LEVELS},
        again AS (
          SELECT p_partkey AS n FROM part WHERE p_type IN ('ECONOMY', 'PROMO')
          UNION SELECT o FROM again JOIN steps ON i = n)
        SELECT 'part_' || n AS dataset, level FROM again JOIN levels ON node = n""",
    "lin12_column_sources": f"""{PART_EDGES}, walk AS (
          SELECT o AS a, i AS b, strength, 1 AS hops FROM links WHERE o NOT IN (SELECT i FROM links)
          UNION
          SELECT w.a, l.i, greatest(w.strength, l.strength), w.hops + 1 FROM walk w JOIN links l ON l.o = w.b)
        SELECT 'table_' || (a // 10) AS out_dataset, 'c' || (a % 10) AS out_column, 'table_' || (b // 10) AS in_dataset,
          'c' || (b % 10) AS in_column,
          list_extract(['IDENTITY', 'TRANSFORMATION', 'AGGREGATION'], CAST(strength + 1 AS INT)) AS subtype,
          CAST(min(hops) AS INT) AS hops
        FROM walk WHERE b NOT IN (SELECT o FROM links) GROUP BY a, b, strength""",
    "lin12_paths": f"""{PART_EDGES}, walk AS (
          SELECT o AS a, i AS b, strength AS s, 1 AS hops FROM links WHERE o NOT IN (SELECT i FROM links)
          UNION
          SELECT w.a, l.i, greatest(w.s, l.strength), w.hops + 1 FROM walk w JOIN links l ON l.o = w.b),
        states AS (SELECT a, b, s, min(hops) AS hops FROM walk GROUP BY a, b, s),
        before AS (
          SELECT x.a, x.b, x.s, p.b AS pb, p.s AS ps FROM states x
          JOIN states p ON p.a = x.a AND p.hops = x.hops - 1
          JOIN links l ON l.o = p.b AND l.i = x.b AND greatest(p.s, l.strength) = x.s
          QUALIFY row_number() OVER (
            PARTITION BY x.a, x.b, x.s ORDER BY 'table_' || (p.b // 10), 'c' || (p.b % 10), p.s) = 1),
        back AS (
          SELECT a, b AS raw, s AS kind, hops AS position, b AS at_b, s AS at_s FROM states WHERE b NOT IN (SELECT o FROM links)
          UNION ALL
          SELECT k.a, k.raw, k.kind, k.position - 1, pb, ps FROM back k
          JOIN before f ON f.a = k.a AND f.b = k.at_b AND f.s = k.at_s),
        places AS (SELECT a, raw, kind, position, at_b FROM back
          UNION ALL SELECT a, b, s, 0, a FROM states WHERE b NOT IN (SELECT o FROM links))
        SELECT 'table_' || (a // 10) AS out_dataset, 'c' || (a % 10) AS out_column, 'table_' || (raw // 10) AS in_dataset,
          'c' || (raw % 10) AS in_column,
          list_extract(['IDENTITY', 'TRANSFORMATION', 'AGGREGATION'], CAST(kind + 1 AS INT)) AS subtype,
          CAST(position AS INT) AS position, 'table_' || (at_b // 10) AS dataset, 'c' || (at_b % 10) AS "column"
        FROM places""",
    "lin13_dataset_form": f"""{LINE_EDGES} SELECT out_dataset, in_dataset, out_column, count(*) AS edges,
          string_agg(pair, ';' ORDER BY pair) AS pairs
        FROM (SELECT DISTINCT out_dataset, in_dataset, out_column, concat_ws('>', in_column, type, subtype) AS pair FROM edges)
        GROUP BY out_dataset, in_dataset, out_column""",
    "lin13_round_trip": f"{LINE_EDGES} SELECT DISTINCT {EDGE} FROM edges",
    "lin14_job_io": """SELECT 'job_' || l_orderkey AS job, l_linestatus AS version, count(DISTINCT l_partkey) AS inputs,
        count(DISTINCT l_suppkey) AS outputs FROM lineitem GROUP BY l_orderkey, l_linestatus""",
    "lin15_freshness": """SELECT c_mktsegment AS namespace, c_name AS name, u.updated_at,
          CASE WHEN u.updated_at IS NULL THEN 'missing' WHEN u.updated_at < TIMESTAMP '1998-01-01' THEN 'stale' ELSE 'fresh' END AS state
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS updated_at FROM orders
          WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) u ON u.o_custkey = c_custkey""",
    "lin16_normalise": f"{NAMESPACES} SELECT namespace, {_normalised('namespace')} AS normalised FROM namespaces",
    "lin17_accepted": f"""{EVENT_DATASETS} SELECT event_id, role, namespace FROM judged j
        WHERE NOT EXISTS (SELECT 1 FROM judged b WHERE b.event_id = j.event_id AND b.reason IS NOT NULL)""",
    "lin17_reasons": f"""{EVENT_DATASETS} SELECT reason, count(DISTINCT event_id) AS events FROM judged
        WHERE reason IS NOT NULL GROUP BY reason""",
    "lin18_collisions": f"""{NAMESPACES} SELECT normalised, count(DISTINCT namespace) AS raw_namespaces
        FROM (SELECT namespace, {_normalised('namespace')} AS normalised FROM namespaces)
        GROUP BY normalised HAVING count(DISTINCT namespace) > 1""",
    "lin19_job_parts": """WITH names AS (SELECT 'app_' || user_id || '.' || event_type || '.default.out_' || event_id AS job FROM events)
        SELECT job, split_part(job, '.', 1) AS app, split_part(job, '.', 2) AS node,
          split_part(job, '.', 3) || '.' || split_part(job, '.', 4) AS output FROM names""",
    "lin20_identity": """SELECT url AS location, regexp_extract(url, '^(.*?://[^/]*)', 1) AS namespace,
          regexp_extract(url, '^.*?://[^/]*(.*)$', 1) AS name FROM pages
        UNION ALL SELECT 'default.' || c_name, 'warehouse', 'default.' || c_name FROM customer""",
    "lin21_placeholders": """SELECT 'job_' || o_orderkey AS job FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "lin22_shared_application": """SELECT 'app_' || o_custkey AS app_id, count(DISTINCT o_orderkey) AS jobs
        FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 2""",
    "lin23_without_views": f"""{PART_EDGES}, hidden AS (SELECT p_partkey AS h FROM part WHERE p_type IN ('ECONOMY', 'PROMO')),
        walk AS (
          SELECT o AS a, i AS b FROM links WHERE o NOT IN (SELECT h FROM hidden)
          UNION
          SELECT w.a, l.i FROM walk w JOIN links l ON l.o = w.b WHERE w.b IN (SELECT h FROM hidden))
        SELECT 'part_' || a AS out_dataset, 'part_' || b AS in_dataset FROM walk WHERE b NOT IN (SELECT h FROM hidden)""",
}

SQL = {**WAREHOUSE, **LINEAGE}
