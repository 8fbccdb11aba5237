"""Relational queries, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import day_of_week, geometric_means, json_long, ntz_trunc, time_bucket, vowel_share, words
from tessera.functions import semistructured
from tessera.operators import asof_join, daily_sketches, exact_quantiles, inequality_join, interval_join, interval_totals, not_in, over_spans, reach, salted_join, sessions, top_k_per_group, whole_ranks
from tessera.operators.sketches import STANDARD_ERROR
from tessera.session import Scratch
from tessera.sources import TABLES, read_files, table, write_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its reference SQL if there is one."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


@query("""
SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        )
    )


def sql(name: str, text: str, reference: str | None = None) -> None:
    """Register a query that is SQL in both engines: tables stand in braces; ``reference`` where the texts differ."""
    used = [t for t in TABLES if "{" + t + "}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = (reference or text).replace("{", "").replace("}", "")


# Projections and filters
sql("filter_pushdown", "SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND l_discount < 0.02")
sql("case_and_like", """
SELECT p_brand, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n
FROM {part} WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'x%' GROUP BY 1, 2""")

# Joins
sql("join_left", "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
sql("join_full", """
SELECT coalesce(a.k, b.k) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_nationkey < 15 GROUP BY 1) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k""")
sql("join_semi", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
sql("join_anti", "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)")
sql("join_theta", "SELECT a.n_name AS one, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def join_lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls come last both ways, as in the SQL's engine; Spark's own ``ORDER BY`` has them first where it ascends."""
    orders = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL").select("o_custkey", "o_totalprice", "o_orderkey")
    best = top_k_per_group(orders, ["o_custkey"], [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")], 2)
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return not_in(table(spark, sf_dir, "customer"), "c_custkey", done, "o_custkey").select("c_custkey")


@query("""
SELECT e.event_id, e.user_id, p.amount AS last_amount FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS amount FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_amount"))
    return asof_join(clicks, bought.withColumnRenamed("ts", "bought_ts"), ["user_id"], "ts", "bought_ts", ["last_amount"]).select("event_id", "user_id", "last_amount")


@query("""
SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 25 AS hi FROM supplier) s ON p_retailprice >= lo AND p_retailprice < hi
""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 25).alias("hi"))
    return interval_join(table(spark, sf_dir, "part"), spans, "p_retailprice", "lo", "hi", 25.0).select("p_partkey", "s_suppkey")


#: Error events open a window of 1 to 1,024 minutes, by their id.
_OUTAGES = "SELECT event_id AS outage_id, ts AS opened, ts + INTERVAL '1 minute' * CAST(power(4, event_id % 6) AS INTEGER) AS closed FROM events WHERE event_type = 'error'"


@query(f"SELECT outage_id, count(*) AS clicks, max(event_id) AS last_id FROM ({_OUTAGES}) JOIN (SELECT event_id, ts FROM events WHERE event_type = 'click') c ON ts >= opened AND ts < closed GROUP BY outage_id")
def join_interval_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within windows whose lengths differ by a factor of a thousand; there are far more pairs of both than rows, so none are made."""
    events = table(spark, sf_dir, "events")
    minutes = F.make_dt_interval(mins=F.pow(F.lit(4), F.col("event_id") % 6).cast("int"))
    outages = events.where("event_type = 'error'").select(F.col("event_id").alias("outage_id"), F.col("ts").alias("opened"), (F.col("ts") + minutes).alias("closed"))
    clicks = events.where("event_type = 'click'").select("event_id", "ts")
    held = interval_totals(clicks, outages, "ts", "opened", "closed", "event_id", "clicks", "last_id")
    return held.groupBy("outage_id").agg(F.sum("clicks").alias("clicks"), F.max("last_id").alias("last_id"))


@query("""
SELECT a.event_id AS error_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.ts < b.ts + INTERVAL '1 minute' * (b.event_id % 20) AND a.ts + INTERVAL '1 minute' * (a.event_id % 20) > b.ts
WHERE a.event_type = 'error' AND b.event_type = 'purchase'
""")
def join_two_inequalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that overlap: two comparisons and no equality."""
    lasting = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 20).cast("int"))
    side = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_from"), lasting.alias(f"{name}_to"))
    errors, purchases = side("error", "error"), side("purchase", "purchase")
    return inequality_join(errors, purchases, ("error_from", "<", "purchase_to"), ("error_to", ">", "purchase_from")).select("error_id", "purchase_id")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return salted_join(lines, orders, "k", 4).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# Aggregations
sql("aggregate_basic", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS least, max(l_tax) AS most
FROM {lineitem} GROUP BY l_returnflag, l_linestatus""")
sql("aggregate_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS amounts FROM {events} GROUP BY event_type")
sql("aggregate_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("aggregate_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS whole, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("aggregate_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("aggregate_filter_having", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM {orders} GROUP BY o_custkey HAVING count(*) > 11")
# Of equal balances the SQL's engine, in one thread, names the first row and Spark's min_by the last one met: here the smallest key is named.
sql("aggregate_statistics", """
SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS spread, round(median(c_acctbal), 4) AS middle, round(corr(c_acctbal, c_custkey), 8) AS r,
  min_by(c_name, struct(c_acctbal, coalesce(c_custkey, 9223372036854775807), c_name)) FILTER (WHERE c_acctbal IS NOT NULL AND c_name IS NOT NULL) AS poorest, bool_and(c_acctbal > -1000) AS solvent
FROM {customer} GROUP BY c_mktsegment""", """
SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS spread, round(median(c_acctbal), 4) AS middle, round(corr(c_acctbal, c_custkey), 8) AS r, min_by(c_name, c_acctbal) AS poorest, bool_and(c_acctbal > -1000) AS solvent
FROM {customer} GROUP BY c_mktsegment""")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def aggregate_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.count("*").alias("turns"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY user_id
""")
def aggregate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


@query("SELECT s_suppkey, name, amount FROM (SELECT s_suppkey, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier) UNPIVOT (amount FOR name IN (balance, nation))")
def aggregate_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["balance", "nation"], "name", "amount")


@query("SELECT l_returnflag, unnest([0.0, 0.01, 0.5, 0.9, 0.999, 1.0]::DOUBLE[]) AS q, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.5, 0.9, 0.999, 1.0])), 6) AS value FROM lineitem GROUP BY l_returnflag")
def aggregate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of three large groups, a few bins at a time."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]).withColumn("value", F.round("value", 6))


@query("""
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS last_day FROM events)
SELECT last_day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS near FROM d JOIN events ON CAST(ts AS DATE) BETWEEN last_day - 6 AND last_day GROUP BY last_day, event_type
""")
def aggregate_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the seven days before each day, from kept daily sketches, and whether that is within four standard errors (or two users) of the exact number."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "user_id")
    kept = Scratch(spark, "sketches").table(daily_sketches(events, "ts", ["event_type"], {"about": F.col("user_id")}))
    days = F.to_date("ts").alias("last_day")
    spans = events.select(days).distinct().withColumn("first_day", F.date_sub("last_day", 6))
    estimates = over_spans(kept, spans, ["event_type"], ["about"]).select("last_day", "event_type", "n", "about")
    once = events.select(days, "event_type", "user_id").distinct()
    exact = once.withColumn("last_day", F.explode(F.sequence("last_day", F.date_add("last_day", 6)))).join(spans.select("last_day"), "last_day")
    exact = exact.groupBy("last_day", "event_type").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(2.0), 4 * STANDARD_ERROR * F.col("users"))
    return estimates.join(exact, ["last_day", "event_type"]).select("last_day", "event_type", "n", "users", near.alias("near"))


# Windows
sql("window_ranks", """
SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c
FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""")
sql("window_neighbours", """
SELECT event_id, lag(value) OVER w AS before, lead(event_type, 2) OVER w AS later, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
sql("window_frames", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM {orders}""")


@query("""
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3
""")
def window_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""
SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER w AS row_number, CAST(ntile(7) OVER w AS BIGINT) AS ntile, rank() OVER q AS rank, dense_rank() OVER q AS dense_rank, round(percent_rank() OVER q, 10) AS percent_rank, round(cume_dist() OVER q, 10) AS cume_dist
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_extendedprice, l_quantity FROM lineitem) WINDOW w AS (ORDER BY l_quantity, l_extendedprice DESC, l_orderkey, l_partkey), q AS (ORDER BY l_quantity)
""")
def window_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks without a partition: by a total order, and by fifty quantities with large groups of ties."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity").distinct()
    total = whole_ranks(lines, ["l_quantity", "l_extendedprice", "l_orderkey", "l_partkey"], [True, False, True, True], tiles=7).drop("rank", "dense_rank", "percent_rank", "cume_dist")
    ranked = whole_ranks(total.withColumnsRenamed({"row_number": "number", "ntile": "tile"}), ["l_quantity"])
    share = lambda c: F.round(c, 10).alias(c)
    return ranked.select("l_orderkey", "l_partkey", "l_extendedprice", F.col("number").alias("row_number"), F.col("tile").alias("ntile"), "rank", "dense_rank", share("percent_rank"), share("cume_dist"))


# Order, limits and sets
sql("order_top", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
sql("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("set_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
sql("set_intersect_all", "SELECT o_custkey AS k FROM {orders} INTERSECT ALL SELECT l_suppkey FROM {lineitem}")
sql("set_except", "SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}")
sql("set_except_all", "SELECT l_orderkey AS k FROM {lineitem} EXCEPT ALL SELECT o_orderkey FROM {orders}")

# Subqueries and common tables
sql("cte_above_average", """
WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey)
SELECT o_custkey, total FROM spent WHERE total > (SELECT avg(total) FROM spent)""")
sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
@query("""
WITH RECURSIVE r(part, steps) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT DISTINCT b.l_partkey, steps + 1 FROM r JOIN lineitem a ON a.l_partkey = part JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE steps < 6)
SELECT part, min(steps) AS steps FROM r GROUP BY part
""")
def cte_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the number of shared orders between them and part 1: a frontier that goes from parts to orders and back, in place of pairs of parts."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("part"), F.concat(F.lit("o"), "l_orderkey").alias("order"))
    links = lines.select(F.col("part").alias("source"), F.col("order").alias("target")).union(lines.select("order", "part"))
    found = reach(links, spark.createDataFrame([("p1",)], "node string"), most_steps=12).where("node like 'p%'")
    return found.select(F.expr("substring(node, 2)").cast("long").alias("part"), (F.col("steps") / 2).cast("long").alias("steps"))


sql("subquery_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")

# Scalar functions
sql("functions_string", """
SELECT p_partkey, substring(p_name, 2, 5) AS part, length(p_name) * CAST(1 AS BIGINT) AS size, lower(p_type) AS low, replace(p_brand, '#', '-') AS brand, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance, concat_ws('/', p_brand, p_type) AS joined, lpad(p_brand, 12, '.') AS padded
FROM {part}""")
_MATH = "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 8) AS lg, round(sqrt(l_quantity), 8) AS root, CAST(l_partkey % 7 AS BIGINT) AS m, abs(l_discount - l_tax) AS gap, CAST(floor(l_extendedprice / 100) AS BIGINT) AS hundreds, greatest(l_discount, l_tax) AS top FROM {lineitem}"
sql("functions_math", _MATH)
sql("functions_math_whole", _MATH)  # an earlier name of the same query


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(extract(dow FROM o_orderdate) AS BIGINT) AS dow, CAST(extract(year FROM o_orderdate) AS BIGINT) AS year, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS quarter, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def functions_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ntz_trunc("month", "o_orderdate").alias("month"), day_of_week("o_orderdate").alias("dow"), F.year(at).cast("long").alias("year"),
        F.quarter(at).cast("long").alias("quarter"), F.datediff(F.to_date(at), F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
    )


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def functions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(json_long("props", "k").alias("k")).agg(F.count("*").alias("n"))


@query("""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, list_max(embedding) AS top, embedding[1] AS head FROM embeddings
""")
def functions_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("dims"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.array_max(e).alias("top"), F.get(e, F.lit(0)).alias("head"),
    )


@query("SELECT label, i, count(*) AS n FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings) WHERE x > 0.3 GROUP BY ALL")
def functions_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return flat.where(F.col("x").cast("double") > 0.3).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, list_extract(l, i)::VARCHAR AS letter, CAST(i - 1 AS INTEGER) AS place
FROM (SELECT *, string_split(event_type, '') AS l FROM events), unnest(range(1, len(event_type) + 1)) AS u(i)
""")
def functions_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents made of the events: a path into an object within one, and the elements of an array."""
    letters = F.split("event_type", "")
    nested = F.concat(F.lit('{"event": {"kind": "'), "event_type", F.lit('", "props": '), "props", F.lit('}, "letters": '), F.to_json(letters), F.lit("}"))
    documents, _ = semistructured.parsed(table(spark, sf_dir, "events").select("event_id", nested.alias("text")), "text")
    of = semistructured.elements(documents, "document", "$.letters", "letter")
    return of.select("event_id", semistructured.at("document", "$.event.props.k", "long").alias("k"), semistructured.at("document", "$.event.kind", "string").alias("kind"), semistructured.at("letter", "$", "string").alias("letter"), "place")


# Event time
@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def time_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(time_bucket("ts", 3600).alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT start, count(*) AS n FROM (SELECT unnest([b, b - INTERVAL '30 minutes']) AS start FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b FROM events)) GROUP BY 1
""")
def time_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return seen.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM s GROUP BY user_id, session
""")
def time_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 7200)


# Formats: written to the shared folder and read back with a declared schema
def _there_and_back(fmt: str, partition_by: tuple[str, ...] = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = table(spark, sf_dir, "part")
        path = f"{Scratch(spark, fmt).root}/part"
        write_files(parts, path, fmt, partition_by)
        return read_files(spark, path, fmt, parts.schema).where("p_size > 10").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")

    run.__name__ = f"source_{fmt}"
    return query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_size > 10")(run)


_there_and_back("csv")
_there_and_back("json")
_there_and_back("orc")
_there_and_back("parquet", ("p_size",))


@query()
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: about a tenth of the rows, the same ones each time."""
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=7).select("l_orderkey", "l_linenumber")


#: Rows of one group of a grouped Python function, about.
GROUP_ROWS = 100_000


# Python functions over Arrow batches
@query("SELECT p_partkey, round(length(regexp_replace(p_name, '[^aeiouAEIOU]', '', 'g')) / length(p_name), 8) AS vowels FROM part")
def python_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(vowel_share("p_name"), 8).alias("vowels"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS typical FROM lineitem GROUP BY l_returnflag")
def python_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "typical").withColumn("typical", F.round("typical", 4))


@query("SELECT p_partkey, w AS word, CAST(i - 1 AS INTEGER) AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def python_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))).withColumnRenamed("id", "p_partkey")


@query("""
SELECT user_id, event_id, CAST(cents * count(*) OVER u - CAST(sum(cents) OVER u AS BIGINT) AS DOUBLE) / (100 * count(*) OVER u) AS off
FROM (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WINDOW u AS (PARTITION BY user_id)
""")
def python_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cents from the user's mean. Rows are dealt to groups of about ``GROUP_ROWS``, so a group holds many small users or a share of a large one; sums of all are known before."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    sums = events.groupBy(F.col("user_id").alias("_user")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    groups = max(1, -(-events.count() // GROUP_ROWS))
    dealt = events.join(sums, F.col("user_id").eqNullSafe(F.col("_user"))).withColumn("part", F.pmod(F.xxhash64("user_id", "event_id", "cents"), F.lit(groups)))

    def centred(t: pa.Table) -> pa.Table:
        # Whole cents add up exactly in any order; one division at the end.
        away = pc.subtract(pc.multiply(t["cents"], t["n"]), t["total"]).cast(pa.float64(), safe=False)
        return t.select(["user_id", "event_id"]).append_column("off", pc.divide(away, pc.multiply(t["n"], 100).cast(pa.float64(), safe=False)))

    return dealt.groupBy("part").applyInArrow(centred, "user_id long, event_id long, off double")


# Streams, run over all there is; windows that the last watermark (the newest time less an hour) has not passed stay open
@query("""
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY 1, 2
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streaming.event_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.run_available(spark, streaming.tumbling_counts(events, "1 day"), "tumbling").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL '2 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streaming.event_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.run_available(spark, streaming.session_counts(events, "2 hours"), "sessions").select("user_id", "n")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streaming.event_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.run_available(spark, streaming.distinct_events(events).select("event_id", "user_id", "event_type"), "distinct")


@query("""
SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '30 minutes'
WHERE a.event_type = 'view' AND b.event_type = 'purchase'
""")
def stream_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lambda kind: streaming.event_stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    return streaming.run_available(spark, streaming.follow_ups(seen("view"), seen("purchase"), "30 MINUTES"), "follow-ups")


@query("""
WITH mark AS (SELECT max(ts) - INTERVAL '2 days' AS passed FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20'),
counted AS (SELECT date_trunc('day', ts) AS start, event_type FROM events, mark
  WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20' OR date_trunc('day', ts) + INTERVAL '1 day' > passed)
SELECT start, event_type, count(*) AS n FROM counted WHERE start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '2 days' FROM events) GROUP BY 1, 2
""")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of two deliveries, the second with all errors: those of days that the watermark has passed by then are too late."""
    events = table(spark, sf_dir, "events")
    first = (F.col("event_type") != "error") & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    counted = streaming.run_deliveries(spark, [events.where(first), events.where(~first)], lambda e: streaming.tumbling_counts(e, "1 day"), "late", "2 days")
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
SELECT user_id, event_id FROM events v WHERE event_type = 'view' AND ts + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL '30 minutes')
""")
def stream_abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streaming.event_stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type").isin("view", "purchase"))
    return streaming.run_available(spark, streaming.abandoned(events, 30), "abandoned")


@query("""
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL '7 days' <= (SELECT max(ts) FROM events) GROUP BY 1, 2
""")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts from six deliveries of five days each, in three batches or more: a watermark as late as the files were measured to be (a delivery's
    files are read in any order), and state let go between batches. Days that end six days before the newest event are closed in any case."""
    scratch, events = Scratch(spark, "in-time"), table(spark, sf_dir, "events")
    streaming.deal_in_time(events, f"{scratch.root}/events", 6)
    files = spark.read.parquet(f"{scratch.root}/events").select("_metadata.file_path").distinct().count()
    counted = streaming.run_in_batches(spark, f"{scratch.root}/events", lambda e: streaming.tumbling_counts(e, "1 day"), "batches", max(1, files // 3))
    start = F.col("start").cast("timestamp_ntz")
    newest = events.agg(F.max("ts").alias("newest"))
    closed = counted.join(F.broadcast(newest), start + F.expr("INTERVAL '7' DAY") <= F.col("newest"))  # one row
    return closed.select(start.alias("start"), "event_type", "n")
