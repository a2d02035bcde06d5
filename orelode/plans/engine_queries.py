"""Relational, windowed, approximate and streaming queries over events and the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.sources.tables import table
from orelode.streaming import limits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def s215_hash_aggregate(spark, root):
    return t(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS orders, round(sum(l_extendedprice), 2) AS price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def s215_joins(spark, root):
    j = t(spark, root, "customer").join(t(spark, root, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, root, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def s215_semi_join(spark, root):
    o = t(spark, root, "orders").where("o_orderstatus = 'F'")
    return t(spark, root, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def s215_anti_join(spark, root):
    return t(spark, root, "customer").join(t(spark, root, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT n1.n_name AS nation, n2.n_name AS other FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
def s215_self_join(spark, root):
    n = t(spark, root, "nation")
    a, b = n.select(F.col("n_name").alias("nation"), F.col("n_nationkey").alias("k"), "n_regionkey"), n.select(F.col("n_name").alias("other"), F.col("n_nationkey").alias("l"), "n_regionkey")
    return a.join(b, "n_regionkey").where("k < l").select("nation", "other")


@query("SELECT user_id, count(*) AS pairs FROM (SELECT a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR) GROUP BY 1")
def s215_interval_join(spark, root):
    """Purchases within an hour after an error. Times fall into buckets of an hour, so that the join has an equal key beside the user."""
    e = t(spark, root, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    hour = 3_600_000_000
    a = e.where("event_type = 'error'").select("user_id", F.col("u").alias("at"), F.explode(F.array(F.floor(F.col("u") / hour), F.floor(F.col("u") / hour) + 1)).alias("b"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("u").alias("then"), F.floor(F.col("u") / hour).alias("b"))
    return a.join(b, ["user_id", "b"]).where(f"then > at and then <= at + {hour}").groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("SELECT p.event_id, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'error' GROUP BY user_id, ts) e ON p.user_id = e.user_id AND p.ts >= e.ts")
def s215_as_of_join(spark, root):
    """The last error at or before each purchase of the user: both kinds in one ordering, the last error carried on. No pairs arise."""
    e = t(spark, root, "events").where(F.col("event_type").isin("purchase", "error")).withColumn("late", (F.col("event_type") == "purchase").cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "late", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("late") == 0, F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("error_id", last).where("late = 1").select("event_id", "error_id")


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS types FROM part GROUP BY 1, 2")
def s215_distinct_aggregate(spark, root):
    return t(spark, root, "part").groupBy("p_brand", "p_size").agg(F.count_distinct("p_type").alias("types"))


@query("SELECT severity, category, count(*) AS n FROM issues GROUP BY CUBE (severity, category)")
def s215_cube(spark, root):
    return t(spark, root, "issues").cube("severity", "category").agg(F.count("*").alias("n"))


@query("SELECT project_id, severity, count(*) AS n FROM issues GROUP BY ROLLUP (project_id, severity)")
def s215_rollup(spark, root):
    return t(spark, root, "issues").rollup("project_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT category, source, count(*) AS n FROM issues GROUP BY GROUPING SETS ((category), (source), ())")
def s215_grouping_sets(spark, root):
    return t(spark, root, "issues").groupingSets([[F.col("category")], [F.col("source")], []], "category", "source").agg(F.count("*").alias("n"))


@query()
def s215_approximate(spark, root):
    return t(spark, root, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS by_price, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC) QUALIFY place <= 3")
def s215_window_ranking(spark, root):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    o = t(spark, root, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("by_price"), F.dense_rank().over(w).alias("dense"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))
    return o.where("place <= 3")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean_5 FROM events")
def s215_window_frames(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t(spark, root, "events").select("event_id", F.round(F.avg("value").over(w), 4).alias("mean_5"))


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, first_value(event_type) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def s215_lag_lead(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, root, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.first("event_type").over(w).alias("first"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def s215_top_k(spark, root):
    return t(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def s215_set_operations(spark, root):
    c, s, n = (t(spark, root, x).select(F.col(k).alias("k")) for x, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).union(n.subtract(s))


@query("SELECT p_partkey, upper(left(p_name, 3)) AS head, regexp_extract(p_brand, '[0-9]+')::INT AS brand_no, length(regexp_replace(p_type, '[AEIOU]', '', 'g')) AS consonants FROM part")
def s215_strings(spark, root):
    return t(spark, root, "part").select("p_partkey", F.upper(F.left("p_name", F.lit(3))).alias("head"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("brand_no"), F.length(F.regexp_replace("p_type", "[AEIOU]", "")).cast("bigint").alias("consonants"))


@query("SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n, count(*) FILTER (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) > 0) AS later FROM orders GROUP BY 1, 2")
def s215_dates(spark, root):
    return t(spark, root, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.date_diff("o_orderdate", F.lit("1995-01-01").cast("date")) > 0).alias("later"))


@query("SELECT l_orderkey, round(sqrt(sum(power(l_discount, 2))), 6) AS norm, max(abs(l_tax - l_discount)) AS gap, sum(l_quantity::BIGINT % 7)::BIGINT AS rest FROM lineitem GROUP BY 1")
def s215_math(spark, root):
    return t(spark, root, "lineitem").groupBy("l_orderkey").agg(F.round(F.sqrt(F.sum(F.pow("l_discount", 2))), 6).alias("norm"), F.max(F.abs(F.col("l_tax") - F.col("l_discount"))).alias("gap"), F.sum(F.col("l_quantity").cast("bigint") % 7).alias("rest"))


@query("SELECT event_type, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def s215_json(spark, root):
    return t(spark, root, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("k"), F.count("*").alias("n"))


@query("SELECT n_name, p.brand AS brand, count(*) AS n FROM nation, (SELECT DISTINCT p_brand AS brand FROM part) p WHERE length(n_name) > length(p.brand) GROUP BY 1, 2")
def s215_theta_join(spark, root):
    """Names longer than a brand: both sides fold to their lengths first, so the inequality is tested on few distinct numbers."""
    b = t(spark, root, "part").select(F.col("p_brand").alias("brand")).distinct()
    return t(spark, root, "nation").join(b, F.length("n_name") > F.length("brand")).groupBy("n_name", "brand").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE r AS (SELECT 0 AS k, 0 AS depth UNION ALL SELECT k * 2 + d, depth + 1 FROM r, (VALUES (1), (2)) v(d) WHERE depth < 3) SELECT k, min(depth)::INT AS depth FROM r GROUP BY 1")
def s215_recursive(spark, root):
    return spark.sql("WITH RECURSIVE r(k, depth) AS (SELECT 0, 0 UNION ALL SELECT k * 2 + d, depth + 1 FROM r, (VALUES (1), (2)) v(d) WHERE depth < 3) SELECT k, min(depth) AS depth FROM r GROUP BY k")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s215_tumbling_windows(spark, root):
    return limits.in_windows(t(spark, root, "events"), "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT w::TIMESTAMP AS window_start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def s215_sliding_windows(spark, root):
    return limits.in_windows(t(spark, root, "events"), "1 hour", "30 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query("WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM g GROUP BY user_id, s")
def s215_sessions(spark, root):
    return limits.sessions(t(spark, root, "events"), "6 hours").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


@query()
def s212_rate_limit(spark, root):
    return limits.allowed(t(spark, root, "events"), 3, 86_400)


def _streamed(spark: SparkSession, root: str, build, name: str, mode: str = "append") -> DataFrame:
    """The result of a stream over the events file, run to its end into a memory-free table in the checkpoint folder's place."""
    import uuid

    from orelode.session import shared_folder

    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # a stream reads folders: the table's own name below its root
    source = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    out = build(source.parquet(f"{root.rstrip('/')}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")))
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/rows").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


@query()
def s212_rate_limit_stream(spark, root):
    return _streamed(spark, root, lambda e: limits.allowed_stream(e.select("user_id", "event_id", "ts"), 3, 86_400), "limits")


@query()
def s215_stream_watermark(spark, root):
    """Windows that the watermark has closed when the stream ends."""
    return _streamed(spark, root, lambda e: limits.in_windows(e, "1 hour", late="10 minutes"), "windows")


@query("SELECT project_id, arg_max(analysis_status, (updated_at, list_position(['queued', 'running', 'completed', 'partial', 'failed'], analysis_status))) AS state FROM projects WHERE analysis_status IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1")
def s212_job_states(spark, root):
    return limits.latest_states(t(spark, root, "projects").where("analysis_status is not null and updated_at is not null"), ["project_id"], "analysis_status", "updated_at")


@query("SELECT owner_user_id, count(*) AS jobs, count(*) > 0 AS busy FROM (SELECT DISTINCT owner_user_id, project_id FROM projects WHERE analysis_status IN ('queued', 'running') AND owner_user_id IS NOT NULL) GROUP BY 1")
def s212_one_in_flight(spark, root):
    p = t(spark, root, "projects").where(F.col("analysis_status").isin("queued", "running") & F.col("owner_user_id").isNotNull()).dropDuplicates(["owner_user_id", "project_id"])
    return p.groupBy("owner_user_id").agg(F.count("*").alias("jobs")).withColumn("busy", F.col("jobs") > 0)


@query("SELECT project_id, source_revision = analysis_revision AS committed, CASE WHEN source_revision = analysis_revision THEN 'completed' ELSE 'stale' END AS state FROM projects")
def s212_optimistic_revision(spark, root):
    ok = F.col("source_revision") == F.col("analysis_revision")
    return t(spark, root, "projects").select("project_id", ok.alias("committed"), F.when(ok, "completed").otherwise("stale").alias("state"))
