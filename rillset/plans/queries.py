"""The registered queries of the engine: each view is fed in steps, and its content at the end is the result.

Tables are split by a key: rows with key % 3 <> 0 come first, the others in a second step. Where a query retracts, a third
step takes back the rows of its retracted tables with key % 7 = 0, and the SQL it is held against reads the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillset.engine import Engine
from rillset.zset import WEIGHT, ZSet

KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "labels": "doc_id", "documents": "doc_id"}


@dataclass
class Spec:
    """{table} in the text stands for a table, so that the oracle can read what is left of it."""

    sql: str
    oracle: str | None = None
    retract: tuple[str, ...] = ()
    before: tuple[tuple[str, str], ...] = ()
    setup: Callable[[Engine], None] | None = None
    tables: tuple[str, ...] = field(default=())

    def text(self) -> str:
        return self.sql.format(**{t: t for t in KEYS})

    def oracle_text(self) -> str:
        left = {t: f"(SELECT * FROM {t} WHERE {KEYS[t]} % 7 <> 0)" if t in self.retract else t for t in KEYS}
        return (self.oracle or self.sql).format(**left)

    def used(self) -> list[str]:
        text = " ".join([self.sql, *(q for _, q in self.before)])
        return [t for t in KEYS if "{" + t + "}" in text or t in self.tables]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fed(spark: SparkSession, sf_dir: str, tables: list[str], views: Callable[[Engine], None], retract: tuple[str, ...] = (), mode: str = "incremental") -> Engine:
    """An engine whose tables took all their rows in two steps, and gave some back in a third."""
    engine = Engine(spark, mode=mode)
    frames = {t: table(spark, sf_dir, t) for t in tables}
    for t, df in frames.items():
        engine.create_table(t, df.schema)
    views(engine)
    for rest in (False, True):
        for t, df in frames.items():
            part = F.col(KEYS[t]) % 3
            engine.push(t, df.where(part == 0 if rest else part != 0))
        engine.step()
    if retract:
        for t in retract:
            engine.push(t, ZSet(frames[t].where(F.col(KEYS[t]) % 7 == 0)).negate())
        engine.step()
    return engine


def run(spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def views(engine: Engine) -> None:
            if spec.setup:
                spec.setup(engine)
            for name, text in spec.before:
                engine.sql(text.format(**{t: t for t in KEYS}), name)
            engine.sql(spec.text(), "result")

        return fed(spark, sf_dir, spec.used(), views, spec.retract).rows("result")

    return query


MONEY = "CAST(l_extendedprice AS DECIMAL(18,2))"
SECONDS = "CAST(date_diff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS BIGINT)"
DUCK_SECONDS = "CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS BIGINT)"

SPECS: dict[str, Spec] = {
    # scan, filter, project
    "scan_lineitem": Spec("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM {lineitem}"),
    "filter_amount": Spec("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 150000"),
    "filter_compound_null": Spec("SELECT event_id FROM {events} WHERE (value > 50 AND event_type <> 'error') OR NULLIF(event_type, 'click') IS NULL"),
    "project_arith": Spec("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS negated FROM {lineitem}"),
    "project_case": Spec("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM {orders}"),
    "filter_case_where": Spec("SELECT p_partkey FROM {part} WHERE CASE WHEN p_size > 25 THEN p_retailprice ELSE 0 END > 1000"),
    "in_list_between": Spec("SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20"),
    # aggregates
    "agg_sum_count": Spec(f"SELECT l_returnflag, CAST(SUM({MONEY}) AS DOUBLE) AS total, COUNT(*) AS n FROM {{lineitem}} GROUP BY l_returnflag"),
    "agg_avg_min_max": Spec("SELECT l_suppkey, ROUND(AVG(l_quantity), 6) AS a, MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi FROM {lineitem} GROUP BY l_suppkey"),
    "agg_count_col_nulls": Spec("SELECT user_id, COUNT(NULLIF(event_type, 'error')) AS some, COUNT(*) AS every_row FROM {events} GROUP BY user_id"),
    "agg_distinct_count": Spec("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag", retract=("lineitem",)),
    "agg_filter": Spec("SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS clicks FROM {events} GROUP BY user_id", retract=("events",)),
    "agg_global": Spec(f"SELECT COUNT(*) AS n, CAST(SUM({MONEY}) AS DOUBLE) AS total, MAX(l_quantity) AS top FROM {{lineitem}}", retract=("lineitem",)),
    "agg_having": Spec("SELECT l_suppkey, COUNT(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING COUNT(*) > 600", retract=("lineitem",)),
    "agg_groupby_expr": Spec("SELECT UPPER(o_orderpriority) AS p, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS big, COUNT(*) AS n FROM {orders} GROUP BY UPPER(o_orderpriority), CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END"),
    "agg_retract": Spec(f"SELECT l_returnflag, l_linestatus, CAST(SUM({MONEY}) AS DOUBLE) AS total, COUNT(*) AS n, MIN(l_shipdate) AS first_ship FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus", retract=("lineitem",)),
    "agg_group_disappears": Spec("SELECT o_orderkey % 7 AS k, COUNT(*) AS n FROM {orders} GROUP BY o_orderkey % 7", retract=("orders",)),
    "agg_rollup": Spec("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", retract=("lineitem",)),
    "agg_cube": Spec("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": Spec("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_stddev_collect": Spec("SELECT p_brand, ROUND(STDDEV_SAMP(p_size), 6) AS s, ROUND(VAR_POP(p_size), 6) AS v FROM {part} GROUP BY p_brand"),
    "agg_decimal_wide": Spec(
        "SELECT l_suppkey, CAST(SUM(CAST(CONCAT(CAST(l_orderkey AS STRING), '.0000000003') AS DECIMAL(28,10))) AS STRING) AS d, CAST(SUM(CAST(CONCAT(CAST(l_linenumber AS STRING), '.000000000000000007') AS DECIMAL(38,18))) AS STRING) AS w FROM {lineitem} GROUP BY l_suppkey",
        retract=("lineitem",),
    ),
    # what is taken back is huge, so that sums which only add and subtract would lose the rest
    "agg_float_retract": Spec("SELECT user_id % 20 AS k, SUM(CASE WHEN event_id % 7 = 0 THEN 1e20 ELSE CAST(event_id % 5 AS DOUBLE) END) AS s, AVG(CASE WHEN event_id % 7 = 0 THEN -1e300 ELSE CAST(event_id % 2 AS DOUBLE) END) AS a FROM {events} GROUP BY user_id % 20", retract=("events",)),
    "agg_avg_bigint_retract": Spec("SELECT user_id % 20 AS k, AVG(CASE WHEN event_id % 7 = 0 THEN 4611686018427387904 ELSE event_id END) AS a FROM {events} GROUP BY user_id % 20", retract=("events",)),
    "agg_min_max_retract": Spec("SELECT user_id, MIN(value) AS lo, MAX(value) AS hi, MAX(event_type) AS last_type FROM {events} GROUP BY user_id", retract=("events",)),
    "select_distinct": Spec("SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}", retract=("lineitem",)),
    # joins
    "join_inner": Spec("SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"),
    "join_inner_retract": Spec("SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey", retract=("orders", "customer")),
    "join_left": Spec("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey", retract=("lineitem",)),
    "join_right": Spec("SELECT l.doc_id AS labelled, d.doc_id, d.lang FROM {labels} l RIGHT JOIN {documents} d ON l.doc_id = d.doc_id", retract=("labels",)),
    "join_full": Spec("SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL JOIN {supplier} s ON c.c_custkey = s.s_suppkey * 20", retract=("customer",)),
    "join_cross": Spec("SELECT r_name, n_name FROM {region} CROSS JOIN {nation}"),
    "join_semi_in": Spec("SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')", retract=("customer",)),
    "join_semi_exists": Spec("SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)"),
    "join_anti_not_exists": Spec("SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)", retract=("labels",)),
    "join_anti_not_in": Spec("SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})", retract=("labels",)),
    "join_theta_range": Spec("SELECT s.s_suppkey, n.n_nationkey FROM {supplier} s JOIN {nation} n ON s.s_nationkey < n.n_nationkey AND n.n_nationkey <= s.s_nationkey + 3"),
    "join_multi_key": Spec("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 30", retract=("lineitem",)),
    "join_self": Spec("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_then_agg": Spec("SELECT n.n_name, COUNT(*) AS orders_n, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", retract=("orders",)),
    "join_update": Spec("SELECT c.c_mktsegment, COUNT(*) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", retract=("customer",)),
    "join_null_keys": Spec("SELECT e.event_id, g.n FROM {events} e JOIN (SELECT NULLIF(user_id % 50, 0) AS k, COUNT(*) AS n FROM {events} GROUP BY NULLIF(user_id % 50, 0)) g ON NULLIF(e.user_id % 50, 0) = g.k", retract=("events",)),
    "join_of_joins": Spec("SELECT l.l_orderkey, l.l_linenumber, c.c_name, n.n_name FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE l.l_quantity > 40", retract=("customer",)),
    # windows
    "win_row_number": Spec("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM {orders}", retract=("orders",)),
    "win_rank_dense": Spec("SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM {part}"),
    "win_sum_partition": Spec("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM {orders}", retract=("orders",)),
    "win_running_rows": Spec("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, MIN(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lo FROM {events}"),
    "win_rows_following": Spec("SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS hi FROM {events}"),
    "win_range_rolling": Spec(
        f"SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, {SECONDS} AS s FROM {{events}})",
        f"SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, {DUCK_SECONDS} AS s FROM {{events}})",
        retract=("events",),
    ),
    "win_range_minmax": Spec(
        f"SELECT event_id, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi FROM (SELECT event_id, user_id, value, {SECONDS} AS s FROM {{events}}) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING)",
        f"SELECT event_id, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi FROM (SELECT event_id, user_id, value, {DUCK_SECONDS} AS s FROM {{events}}) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING)",
    ),
    "win_named_multi": Spec("SELECT event_id, COUNT(*) OVER a AS n_user, COUNT(*) OVER b AS n_type FROM {events} WINDOW a AS (PARTITION BY user_id), b AS (PARTITION BY event_type)"),
    "win_avg_over": Spec("SELECT p_partkey, ROUND(AVG(p_size) OVER (PARTITION BY p_brand), 6) AS a FROM {part}", retract=("part",)),
    "win_lag_lead_first": Spec("SELECT event_id, LAG(value) OVER w AS before_v, LEAD(value) OVER w AS after_v, FIRST_VALUE(value) OVER w AS first_v FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "win_ntile_percent": Spec("SELECT p_partkey, CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS q, ROUND(PERCENT_RANK() OVER (PARTITION BY p_brand ORDER BY p_partkey), 9) AS pr FROM {part}"),
    "win_top1_filter": Spec("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r = 1", retract=("orders",)),
    "win_then_agg": Spec("SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) GROUP BY n"),
    "join_then_window": Spec("SELECT c.c_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY n.n_name ORDER BY c.c_acctbal DESC, c.c_custkey) AS BIGINT) AS r FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey", retract=("customer",)),
    "win_sum_over": Spec("SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS running, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total FROM {orders}", retract=("orders",)),
    "win_sum_rows": Spec("SELECT event_id, CAST(SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM {events}", retract=("events",)),
    "win_sum_rolling": Spec(
        f"SELECT event_id, CAST(SUM(event_id) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS t FROM (SELECT event_id, user_id, {SECONDS} AS s FROM {{events}})",
        f"SELECT event_id, CAST(SUM(event_id) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS t FROM (SELECT event_id, user_id, {DUCK_SECONDS} AS s FROM {{events}})",
        retract=("events",),
    ),
    "win_last_nth_cume": Spec("SELECT event_id, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v, NTH_VALUE(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_v, ROUND(CUME_DIST() OVER (PARTITION BY user_id ORDER BY event_type), 9) AS c FROM {events}", retract=("events",)),
    "win_nulls_order": Spec("SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'error') NULLS FIRST, event_id) AS BIGINT) AS f, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY NULLIF(event_type, 'click') DESC NULLS LAST, event_id) AS BIGINT) AS l FROM {events}", retract=("events",)),
    "win_null_partition": Spec("SELECT event_id, COUNT(*) OVER (PARTITION BY NULLIF(user_id % 9, 0)) AS n, MAX(event_id) OVER (PARTITION BY NULLIF(event_type, 'error')) AS top FROM {events}", retract=("events",)),
    "win_expression_keys": Spec("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey + 1, UPPER(o_orderstatus) ORDER BY -o_totalprice, o_orderkey * 2) AS BIGINT) AS r FROM {orders}", retract=("orders",)),
    # set operations
    "except_three": Spec("SELECT c_custkey AS k FROM {customer} EXCEPT SELECT s_suppkey FROM {supplier} EXCEPT SELECT p_partkey FROM {part}", retract=("supplier", "part")),
    "intersect_three": Spec("SELECT c_custkey AS k FROM {customer} INTERSECT SELECT p_partkey FROM {part} INTERSECT SELECT s_suppkey FROM {supplier}", retract=("part",)),
    "union_three": Spec("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_suppkey FROM {supplier} UNION SELECT n_regionkey FROM {nation}", retract=("customer", "supplier")),
    "union_all": Spec("SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", retract=("customer",)),
    "union_distinct": Spec("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_suppkey FROM {supplier}", retract=("supplier",)),
    "except_": Spec("SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}", retract=("labels",)),
    "except_all": Spec("SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}"),
    "intersect_": Spec("SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}", retract=("labels",)),
    "intersect_all": Spec("SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}", retract=("supplier",)),
    # sub-queries, CTEs, views
    "cte_basic": Spec("WITH big AS (SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey"),
    "cte_multi_join": Spec("WITH c AS (SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 0), n AS (SELECT n_nationkey, n_name FROM {nation}) SELECT n.n_name, COUNT(*) AS k FROM c JOIN n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"),
    "cte_reused": Spec("WITH t AS (SELECT n_nationkey, n_regionkey FROM {nation}) SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM t a JOIN t b ON a.n_regionkey = b.n_regionkey"),
    "cte_chained": Spec("WITH a AS (SELECT user_id, COUNT(*) AS n FROM {events} GROUP BY user_id), b AS (SELECT n, COUNT(*) AS users FROM a GROUP BY n) SELECT n, users FROM b WHERE users > 1"),
    "derived_table": Spec("SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM {customer} GROUP BY c_mktsegment) t WHERE n > 10"),
    "scalar_subquery": Spec("SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM {part})", retract=("part",)),
    "correlated_subquery": Spec("SELECT o_orderkey FROM {orders} o WHERE o_totalprice >= (SELECT MAX(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)"),
    "view_on_view": Spec("SELECT n_orders, COUNT(*) AS customers FROM per_customer GROUP BY n_orders", "SELECT n_orders, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n_orders FROM {orders} GROUP BY o_custkey) GROUP BY n_orders", ("orders",), (("per_customer", "SELECT o_custkey, COUNT(*) AS n_orders FROM {orders} GROUP BY o_custkey"),)),
    "view_diamond": Spec("SELECT a.user_id, a.n AS clicks, b.n AS errors FROM clicks a JOIN errors b ON a.user_id = b.user_id", "SELECT a.user_id, a.n AS clicks, b.n AS errors FROM (SELECT user_id, COUNT(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, COUNT(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY user_id) b ON a.user_id = b.user_id", ("events",), (("clicks", "SELECT user_id, COUNT(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY user_id"), ("errors", "SELECT user_id, COUNT(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY user_id"))),
    "view_three_layer": Spec("SELECT seg, MAX(n) AS top FROM by_customer GROUP BY seg", "SELECT seg, MAX(n) AS top FROM (SELECT c_mktsegment AS seg, c_custkey, COUNT(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 50000 GROUP BY c_mktsegment, c_custkey) GROUP BY seg", ("orders",), (("big_orders", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice > 50000"), ("by_customer", "SELECT c_mktsegment AS seg, c_custkey, COUNT(*) AS n FROM big_orders JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey"))),
    # scalar functions
    "str_case_len": Spec("SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, CAST(LENGTH(c_name) AS BIGINT) AS n FROM {customer}"),
    "str_substring": Spec("SELECT p_partkey, sub_text(p_name, 1, 5) AS head, sub_text(p_name, -3, 4) AS clamped, sub_text(p_name, 500, 5) AS past FROM {part}", "SELECT p_partkey, substring(p_name, 1, 5) AS head, substring(p_name, 1, 4) AS clamped, substring(p_name, 500, 5) AS past FROM {part}"),
    "str_trim": Spec("SELECT p_partkey, strip_text(concat('  ', p_name, chr(9))) AS b, lstrip_text(concat('  ', p_name)) AS l, rstrip_text(concat(p_name, '  ')) AS r FROM {part}", "SELECT p_partkey, p_name AS b, p_name AS l, p_name AS r FROM {part}"),
    "str_replace_concat": Spec("SELECT p_partkey, REPLACE(p_brand, '#', '-') AS brand, p_brand || '/' || p_type AS both_of FROM {part}"),
    "str_starts_with": Spec("SELECT p_partkey, starts_with(p_type, 'ST') AS s FROM {part}"),
    "dt_extract": Spec("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, day_of_week(CAST(o_orderdate AS DATE)) AS dow, day_of_year(CAST(o_orderdate AS DATE)) AS doy, CAST(EXTRACT(HOUR FROM o_orderdate) AS BIGINT) AS h FROM {orders}", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, isodow(o_orderdate)::BIGINT AS dow, dayofyear(o_orderdate)::BIGINT AS doy, hour(o_orderdate)::BIGINT AS h FROM {orders}"),
    "dt_trunc": Spec("SELECT event_id, trunc_date('MONTH', CAST(ts AS DATE)) AS m, trunc_date('DAY', CAST(ts AS DATE)) AS d, trunc_date('WEEK', CAST(ts AS DATE)) AS w, date_trunc('HOUR', ts) AS h FROM {events}", "SELECT event_id, date_trunc('month', ts)::DATE AS m, ts::DATE AS d, date_trunc('week', ts)::DATE AS w, date_trunc('hour', ts) AS h FROM {events}"),
    "dt_add_sub": Spec("SELECT o_orderkey, add_date_days(CAST(o_orderdate AS DATE), 10) AS later, subtract_date_days(CAST(o_orderdate AS DATE), 5) AS earlier FROM {orders}", "SELECT o_orderkey, (o_orderdate::DATE + 10)::DATE AS later, (o_orderdate::DATE - 5)::DATE AS earlier FROM {orders}"),
    "dt_diff": Spec("SELECT event_id, whole_days(TIMESTAMP_NTZ '2024-01-01 12:00:00', ts) AS d, whole_weeks(TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS w, whole_hours(ts, TIMESTAMP_NTZ '2024-01-15 00:00:00') AS h FROM {events}", "SELECT event_id, date_sub('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS d, date_sub('week', TIMESTAMP '2024-01-01 00:00:00', ts) AS w, date_sub('hour', ts, TIMESTAMP '2024-01-15 00:00:00') AS h FROM {events}"),
    "dt_diff_more": Spec(
        "SELECT event_id, whole_months(TIMESTAMP_NTZ '2023-01-10 12:00:00', ts) AS mo, whole_years(ts, TIMESTAMP_NTZ '2020-03-01 00:00:00') AS y, whole_minutes(TIMESTAMP_NTZ '2024-01-01 00:00:30', ts) AS mi, whole_seconds(ts, TIMESTAMP_NTZ '2024-01-02 00:00:00') AS s FROM {events}",
        "SELECT event_id, date_sub('month', TIMESTAMP '2023-01-10 12:00:00', ts) AS mo, date_sub('year', ts, TIMESTAMP '2020-03-01 00:00:00') AS y, date_sub('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS mi, date_sub('second', ts, TIMESTAMP '2024-01-02 00:00:00') AS s FROM {events}",
        retract=("events",),
    ),
    "null_coalesce_nullif": Spec("SELECT event_id, COALESCE(NULLIF(event_type, 'error'), 'none') AS t, NULLIF(user_id % 3, 0) AS u FROM {events}"),
    "null_safe_eq": Spec("SELECT event_id FROM {events} WHERE NULLIF(event_type, 'error') IS NOT DISTINCT FROM NULLIF(event_type, 'click')"),
    "cast_matrix": Spec("SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_orderkey AS DOUBLE) AS f, CAST(CAST(o_orderkey AS STRING) AS INT) AS i, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 2 AS BOOLEAN) AS b FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderkey AS INT) AS i, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 2 AS BOOLEAN) AS b FROM {orders}"),
    "math_div_mod": Spec("SELECT p_partkey, int_div(p_partkey, p_size % 4) AS q, safe_mod(p_partkey, p_size % 4) AS r, int_div(-7, 2) AS neg FROM {part}", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey // (p_size % 4) END AS q, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey % (p_size % 4) END AS r, CAST(-3 AS BIGINT) AS neg FROM {part}"),
    "order_limit_offset": Spec("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", retract=("orders",)),
    "order_nulls": Spec("SELECT event_id, NULLIF(event_type, 'error') AS t FROM {events} ORDER BY t NULLS LAST, event_id LIMIT 50", retract=("events",)),
    "dt_compare": Spec("SELECT o_orderkey FROM {orders} WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01' AND CAST(o_orderdate AS DATE) <> DATE '1996-02-29'", retract=("orders",)),
    "dt_current": Spec("SELECT n_nationkey FROM {nation} WHERE CURRENT_DATE >= DATE '2020-01-01' AND CURRENT_TIMESTAMP >= TIMESTAMP '2020-01-01 00:00:00'"),
    "order_limit_topk": Spec("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", retract=("orders",)),
    "late_out_of_order": Spec(
        f"SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM (SELECT event_id, user_id, {SECONDS} AS s FROM {{events}})",
        f"SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM (SELECT event_id, user_id, {DUCK_SECONDS} AS s FROM {{events}})",
    ),
}


# -- functions of users -------------------------------------------------------------------------------------------------
def _with_udf(engine: Engine) -> None:
    engine.register_udf("turned", lambda s: None if s is None else s[::-1], ["string"], "string")


SPECS["udf_scalar"] = Spec("SELECT c_custkey, turned(c_name) AS t FROM {customer}", "SELECT c_custkey, reverse(c_name) AS t FROM {customer}", setup=_with_udf)
SPECS["udf_filter"] = Spec("SELECT c_custkey FROM {customer} WHERE turned(c_mktsegment) LIKE 'G%'", "SELECT c_custkey FROM {customer} WHERE reverse(c_mktsegment) LIKE 'G%'", setup=_with_udf)


def _with_udafs(engine: Engine) -> None:
    from rillset.udf import AggregateUdf

    class WeightedSum(AggregateUdf):
        def initialize(self):
            return 0

        def accumulate(self, acc, value, weight):
            return acc if value is None else acc + int(value) * weight

        def finalize(self, acc):
            return acc

    class Product(WeightedSum):
        def initialize(self):
            return 1

        def accumulate(self, acc, value, weight):
            return acc if value is None else acc * int(value) ** weight % 1_000_003

    engine.register_udaf("weighted_sum", WeightedSum(), "i64", "i64")
    engine.register_udaf("product_mod", Product(), "i64", "i64")


SPECS["udaf_weighted_sum"] = Spec("SELECT p_brand, weighted_sum(CAST(p_size AS BIGINT)) AS s FROM {part} GROUP BY p_brand", "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS s FROM {part} GROUP BY p_brand", ("part",), setup=_with_udafs)
SPECS["udaf_product"] = Spec("SELECT n_regionkey, product_mod(CAST(n_nationkey % 3 + 1 AS BIGINT)) AS s FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, CAST(product(n_nationkey % 3 + 1) AS BIGINT) % 1000003 AS s FROM {nation} GROUP BY n_regionkey", ("nation",), setup=_with_udafs)


def _exploded(spark: SparkSession, sf_dir: str, after: str | None) -> Engine:
    def views(engine: Engine) -> None:
        engine.apply_table_udf("words", "part", [0, 3], lambda k, s: [(k, w, i) for i, w in enumerate((s or "").split(" "))], "p_partkey BIGINT, word STRING, place BIGINT")
        if after:
            engine.sql(after, "result")

    return fed(spark, sf_dir, ["part"], views, ("part",))


def udtf_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, None).rows("words")


def udtf_then_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, "SELECT word, COUNT(*) AS n FROM words GROUP BY word").rows("result")


_WORDS = "(SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, unnest(range(len(string_split(p_type, ' ')))) AS place FROM part WHERE p_partkey % 7 <> 0)"


# -- Z-sets -------------------------------------------------------------------------------------------------------------
def _pair(spark: SparkSession, sf_dir: str) -> tuple[ZSet, ZSet]:
    """Nations of customers and of suppliers, with repeats."""
    return ZSet(table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k")), ZSet(table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS k"))


def _weights(z: ZSet) -> DataFrame:
    return z.compact().df.withColumnRenamed(WEIGHT, "weight")


def _zset(f: Callable[[ZSet, ZSet], ZSet]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _weights(f(*_pair(spark, sf_dir)))


_A, _B = "(SELECT c_nationkey AS k FROM customer)", "(SELECT s_nationkey AS k FROM supplier)"
_SUM = f"SELECT k, CAST(SUM(w) AS BIGINT) AS weight FROM (SELECT k, 1 AS w FROM {_A} UNION ALL SELECT k, {{0}} FROM {_B}) GROUP BY k HAVING SUM(w) {{1}}"


def _states(spark: SparkSession, sf_dir: str) -> list[ZSet]:
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderkey AS o")
    return [ZSet(orders.where(F.col("o") % 3 == i).select("k")) for i in range(3)]


def integrate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.zset import integrate

    return _weights(integrate(_states(spark, sf_dir))[-1])


def differentiate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.zset import differentiate, integrate

    return _weights(differentiate(integrate(_states(spark, sf_dir)))[-1])


# -- steps, clocks, sinks, streams ----------------------------------------------------------------------------------------
def step_delta_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the retracting step changed in a grouped view."""
    engine = fed(spark, sf_dir, ["orders"], lambda e: e.sql("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey", "result") and None, ("orders",))
    return _weights(engine.output("result"))


_NOW = "(SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey)"
_THEN = "(SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)"


def _clocked(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    engine = Engine(spark)
    nation = table(spark, sf_dir, "nation")
    engine.create_table("nation", nation.schema)
    engine.sql(query, "result")
    engine.push("nation", nation.where("n_nationkey % 3 <> 0"), event_time=500).step()
    engine.push("nation", nation.where("n_nationkey % 3 = 0"), event_time=1500).step()
    return engine.rows("result")


def event_time_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocked(spark, sf_dir, "SELECT n_nationkey, event_time() AS seen_at FROM nation")


def event_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocked(spark, sf_dir, "SELECT n_nationkey FROM nation WHERE event_time() >= 1000")


def _bitemporal(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    engine = Engine(spark)
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus")
    engine.create_table("orders", orders.schema)
    engine.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "result")
    sink = engine.accumulate_view("result") if kind == "view" else engine.accumulate_table("orders")
    engine.push("orders", orders.where("o_orderkey % 3 <> 0"), 1000).step()
    engine.push("orders", orders.where("o_orderkey % 3 = 0"), 1001).step()
    engine.push("orders", ZSet(orders.where("o_orderkey % 7 = 0")).negate(), 1002).step()
    engine.set_event_time(1003)
    return sink.rows(engine.get_event_time())


def bitemporal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bitemporal(spark, sf_dir, "view")


def bitemporal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bitemporal(spark, sf_dir, "table")


_BITEMPORAL = "SELECT {0}, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 1000 ELSE 1001 END AS BIGINT) AS start_time, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1002 ELSE 1003 END AS BIGINT) AS end_time FROM orders {1}"


def stream_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of Parquet files feeds a table, one file a step."""
    from rillset.scratch import scratch_root
    from rillset.streaming.adapter import feed

    root, events = scratch_root(spark), table(spark, sf_dir, "events")
    events.repartition(2, "event_id").write.parquet(f"{root}/stream")
    engine = Engine(spark)
    engine.create_table("events", events.schema)
    engine.sql("SELECT event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY event_type", "result")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/stream")
    feed(engine, "events", stream, f"{root}/checkpoint").awaitTermination()
    return engine.rows("result")


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fed(spark, sf_dir, ["events"], lambda e: e.sql("SELECT CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) AS day, COUNT(*) AS n FROM events GROUP BY date_trunc('DAY', ts)", "result") and None)
    return engine.rows("result")


def _streamed(spark: SparkSession, sf_dir: str, windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Windows over a stream of the events' files, as they stand once all files have been read."""
    from rillset.scratch import scratch_root

    root, events = scratch_root(spark), table(spark, sf_dir, "events")
    events.repartition(3, "event_id").write.parquet(f"{root}/stream")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out-{number % 2}")
        last[0] = f"{root}/out-{number % 2}"

    last: list = [None]
    query = windows(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(last[0])


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.streaming.adapter import tumbling, wall

    windows = _streamed(spark, sf_dir, lambda e: tumbling(e, "ts", "1 day", "30 days", F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), keys=("event_type",)))
    return windows.select("event_type", wall(F.col("window.start")).alias("first"), "n", "top")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.streaming.adapter import sliding, wall

    windows = _streamed(spark, sf_dir, lambda e: sliding(e, "ts", "2 hours", "1 hour", "30 days", F.count(F.lit(1)).alias("n")))
    return windows.select(wall(F.col("window.start")).alias("first"), wall(F.col("window.end")).alias("last"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillset.streaming.adapter import sessions, wall

    windows = _streamed(spark, sf_dir, lambda e: sessions(e, "ts", "1 hour", "30 days", F.count(F.lit(1)).alias("n"), keys=("user_id",)))
    return windows.select("user_id", wall(F.col("session_window.start")).alias("first"), wall(F.col("session_window.end")).alias("last"), "n")


_HOURS = "SELECT h AS first, h + INTERVAL 2 HOUR AS last, COUNT(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h FROM events) GROUP BY h"
_GAPS = "SELECT user_id, MIN(ts) AS first, MAX(ts) + INTERVAL 1 HOUR AS last, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"


def _parquet_sink(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """What a sink wrote when the engine closed."""
    from rillset.scratch import scratch_root

    path = f"{scratch_root(spark)}/sink"
    engine = Engine(spark)
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus")
    engine.create_table("orders", orders.schema)
    engine.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", "result")
    (engine.write_view_to_parquet if kind == "view" else engine.write_table_to_parquet)("result" if kind == "view" else "orders", path)
    engine.push("orders", orders.where("o_orderkey % 3 <> 0"), 1000).step()
    engine.push("orders", orders.where("o_orderkey % 3 = 0"), 1001).step()
    engine.push("orders", ZSet(orders.where("o_orderkey % 7 = 0")).negate(), 1002).step()
    engine.set_event_time(1003)
    engine.drop()
    return spark.read.parquet(path)


def parquet_sink_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parquet_sink(spark, sf_dir, "view")


def parquet_sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parquet_sink(spark, sf_dir, "table")


def batch_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions by name over a batch: arithmetic, comparisons, logic, text."""
    from rillset.functions.vectorized import call, field, filter_batch, literal, project_batch

    part = table(spark, sf_dir, "part")
    some = filter_batch(part, call("or", call("gt", field("p_size"), literal(25)), call("not", call("equal", field("p_brand"), literal("Brand#11")))))
    return project_batch(
        some, "p_partkey", call("add", field("p_size"), literal(1)).alias("more"), call("multiply", field("p_size"), literal(2)).alias("twice"), call("negate", field("p_size")).alias("less"),
        call("divide", field("p_retailprice"), field("p_size") % 3).alias("share"), call("lte", field("p_size"), literal(10)).alias("small"), call("upper", field("p_name")).alias("loud"),
        call("char_length", field("p_type")).cast("bigint").alias("n"),
    )


def reset_and_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset forgets tables and views; what is pushed behind it counts alone."""
    engine = fed(spark, sf_dir, ["orders"], lambda e: e.sql("SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderkey) AS top FROM orders GROUP BY o_orderstatus", "result") and None)
    engine.reset()
    return engine.push("orders", table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")).step().rows("result")


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: a gap of an hour ends one."""
    gap = "CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END"
    text = f"SELECT user_id, CAST(SUM(fresh) AS BIGINT) AS sessions FROM (SELECT user_id, {gap} AS fresh FROM events) GROUP BY user_id"
    return fed(spark, sf_dir, ["events"], lambda e: e.sql(text, "result") and None).rows("result")


_SESSIONS = "SELECT user_id, CAST(SUM(fresh) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY user_id"


def recompute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped join without delta rules: the same content by recomputing."""
    text = "SELECT c.c_nationkey, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey"
    return fed(spark, sf_dir, ["orders", "customer"], lambda e: e.sql(text, "result") and None, ("orders",), mode="recompute").rows("result")


def dataframe_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view from a DataFrame plan instead of SQL text."""
    build = lambda t: t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return fed(spark, sf_dir, ["orders"], lambda e: e.dataframe_view(build, "result") and None, ("orders",)).rows("result")


PLAIN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "udtf_explode": (udtf_explode, f"SELECT p_partkey, word, place FROM {_WORDS}"),
    "udtf_then_sql": (udtf_then_sql, f"SELECT word, COUNT(*) AS n FROM {_WORDS} GROUP BY word"),
    "zset_add_compact": (_zset(lambda a, b: a.add(b)), _SUM.format("1", "<> 0")),
    "zset_negate_subtract": (_zset(lambda a, b: a.subtract(b)), _SUM.format("-1", "<> 0")),
    "zset_positive": (_zset(lambda a, b: a.subtract(b.scale(15)).positive()), _SUM.format("-15", "> 0")),
    "zset_distinct": (_zset(lambda a, b: a.add(b).distinct()), f"SELECT DISTINCT k, CAST(1 AS BIGINT) AS weight FROM (SELECT k FROM {_A} UNION ALL SELECT k FROM {_B})"),
    "zset_multiply": (lambda spark, d: _weights(_pair(spark, d)[0].map(F.col("k").alias("a")).compact().multiply(_pair(spark, d)[1].map(F.col("k").alias("b")).compact())), f"SELECT a.k AS a, b.k AS b, COUNT(*) AS weight FROM {_A} a CROSS JOIN {_B} b GROUP BY a.k, b.k"),
    "zset_except": (_zset(lambda a, b: a.except_(b)), f"SELECT k, CAST(1 AS BIGINT) AS weight FROM (SELECT k FROM {_A} EXCEPT SELECT k FROM {_B})"),
    "zset_intersect": (_zset(lambda a, b: a.intersect(b)), f"SELECT k, CAST(1 AS BIGINT) AS weight FROM (SELECT k FROM {_A} INTERSECT SELECT k FROM {_B})"),
    "integrate": (integrate_query, "SELECT o_custkey AS k, COUNT(*) AS weight FROM orders GROUP BY o_custkey"),
    "differentiate": (differentiate_query, "SELECT o_custkey AS k, COUNT(*) AS weight FROM orders WHERE o_orderkey % 3 = 2 GROUP BY o_custkey"),
    "step_delta_output": (step_delta_output, f"SELECT *, CAST(1 AS BIGINT) AS weight FROM (SELECT * FROM {_NOW} EXCEPT ALL SELECT * FROM {_THEN}) UNION ALL SELECT *, -1 FROM (SELECT * FROM {_THEN} EXCEPT ALL SELECT * FROM {_NOW})"),
    "event_time_stamp": (event_time_stamp, "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 3 <> 0 THEN 500 ELSE 1500 END AS BIGINT) AS seen_at FROM nation"),
    "event_time_filter": (event_time_filter, "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0"),
    "bitemporal_view": (bitemporal_view, _BITEMPORAL.format("o_orderkey", "WHERE o_orderstatus <> 'F'")),
    "bitemporal_table": (bitemporal_table, _BITEMPORAL.format("o_orderkey, o_orderstatus", "")),
    "stream_foreach_batch": (stream_foreach_batch, "SELECT event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY event_type"),
    "tumbling_window": (tumbling_window, "SELECT date_trunc('day', ts) AS day, COUNT(*) AS n FROM events GROUP BY date_trunc('day', ts)"),
    "session_window": (session_window, _SESSIONS),
    "stream_tumbling": (stream_tumbling, "SELECT event_type, date_trunc('day', ts) AS first, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY event_type, date_trunc('day', ts)"),
    "stream_sliding": (stream_sliding, _HOURS),
    "stream_sessions": (stream_sessions, _GAPS),
    "parquet_sink_view": (parquet_sink_view, _BITEMPORAL.format("o_orderkey", "WHERE o_orderstatus <> 'F'")),
    "parquet_sink_table": (parquet_sink_table, _BITEMPORAL.format("o_orderkey, o_orderstatus", "")),
    "batch_expressions": (batch_expressions, "SELECT p_partkey, p_size + 1 AS more, p_size * 2 AS twice, -p_size AS less, p_retailprice / NULLIF(p_size % 3, 0) AS share, p_size <= 10 AS small, upper(p_name) AS loud, length(p_type) AS n FROM part WHERE p_size > 25 OR NOT p_brand = 'Brand#11'"),
    "reset_and_again": (reset_and_again, "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderkey) AS top FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_orderstatus"),
    "recompute_mode": (recompute_mode, "SELECT c.c_nationkey, COUNT(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey"),
    "dataframe_view": (dataframe_view, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderstatus"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run(s) for k, s in SPECS.items()} | {k: f for k, (f, _) in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s.oracle_text() for k, s in SPECS.items()} | {k: q for k, (_, q) in PLAIN.items() if q}
