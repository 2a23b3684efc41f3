"""Queries that write loads and read them back, that call functions from SQL, and headers of tables made from parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import sql
from docloom.operators import loads, repairs, sketches
from docloom.plans.registry import long, query
from docloom.streaming.counts import appended, shared_folder, windowed


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN l_quantity * 2 ELSE l_quantity END AS quantity,
       CASE WHEN o_orderpriority LIKE '%URGENT%' THEN o_orderpriority END AS note
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority NOT LIKE '%LOW%'""")
def written_loads(t):
    """All orders are loaded, then the urgent ones again with a column more, a load breaks before its commit, and low ones are taken away."""
    folder = f"{shared_folder(t.spark)}/loads-{uuid.uuid4().hex}"
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    lines = t("lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), F.col("l_quantity").alias("quantity"))
    urgent = orders.filter(F.col("o_orderpriority").contains("URGENT"))
    again = lines.join(urgent, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("quantity") * 2).alias("quantity"), F.col("o_orderpriority").alias("note"))
    key = "l_orderkey"
    loads.write({"lines": lines}, orders, folder, 0, key)
    loads.write({"lines": again}, urgent, folder, 1, key)
    loads.write({"lines": lines.limit(0)}, urgent, folder, 1, key)  # done before: nothing happens
    broken = lines.withColumn("load", F.lit(2).cast("long"))
    broken.write.mode("append").partitionBy("load").parquet(f"{folder}/lines")
    loads.write({"lines": lines.limit(0)}, orders.limit(0), folder, 3, key, gone=orders.filter(F.col("o_orderpriority").contains("LOW")))
    return loads.read(t.spark, folder, "lines", key)


@query("SELECT p_partkey, " + ", ".join(f"'{h}' AS h{i}" for i, h in enumerate(repairs.INVESTMENT_HEADERS)) + ", p_name AS v0, p_type AS v1, p_brand AS v2, CAST(p_size AS VARCHAR) AS v3, CAST(p_partkey AS VARCHAR) AS v4 FROM part")
def investment_headers(t):
    head = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("ชื่อบริษัท ประเภทธุรกิจ ธนาคารถือหุ้น"))).otherwise(F.array(*[F.lit(x) for x in ("ชื่อบริษัท ประเภทธุรกิจ ถือหุ้น", "column_2", "column_3", "column_4", "column_5")]))
    first = F.array(*[F.lit(x) for x in ("", "", "**ชนิดหุ้น**", "จำนวนหุ้น", "(%)")])
    own = F.array("p_name", "p_type", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    made = t("part").select("p_partkey", F.lit("t").alias("title"), head.alias("headers"), F.array(first, own).alias("rows"))
    out = repairs.investment_headers(made)
    return out.select("p_partkey", *[F.col("headers")[i].alias(f"h{i}") for i in range(5)], *[F.col("rows")[0][i].alias(f"v{i}") for i in range(5)])


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(0 AS BIGINT) AS table_no, CAST(1 AS BIGINT) AS row_no, c_name AS first_cell, 2 AS n_cells, CAST(c_custkey AS DOUBLE) AS shown FROM customer")
def sql_functions(t):
    sql.register(t.spark)
    made = F.concat(F.lit("<table><tr><th>name</th><th>n</th></tr><tr><td>"), "c_name", F.lit("</td><td>("), F.col("c_custkey").cast("string"), F.lit(",000)</td></tr></table>"))
    t("customer").select(long("c_custkey").alias("c_custkey"), made.alias("html")).createOrReplaceTempView("docloom_made_pages")
    return t.spark.sql("""
        SELECT c_custkey, x.table_no, x.row_no, x.cells[0] AS first_cell, size(x.cells) AS n_cells, parse_numeric(x.cells[1]) / -1000 AS shown
        FROM docloom_made_pages, LATERAL extract_tables(html) AS x WHERE x.row_no > 0""")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS same_as_whole, true AS median_near FROM events GROUP BY 1")
def sketched_days(t):
    """Sketches of each day and type are written, read again and merged by type; they are held against exact figures and against sketches of the whole."""
    events = t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    folder = f"{shared_folder(t.spark)}/sketches-{uuid.uuid4().hex}"
    of = ({"users_sketch": F.col("user_id")}, {"value_sketch": F.col("value")})
    sketches.sketched(events, ["day", "event_type"], *of).write.partitionBy("day").parquet(folder)
    merged = sketches.merged(t.spark.read.parquet(folder), ["event_type"], ["users_sketch"], ["value_sketch"])
    whole = sketches.sketched(events, ["event_type"], *of).select("event_type", sketches.distinct_count(F.col("users_sketch")).alias("whole"))
    known = merged.join(whole, "event_type").withColumn("median", sketches.quantile(F.col("value_sketch"), 0.5)).withColumn("estimate", sketches.distinct_count(F.col("users_sketch")))
    below = F.avg((F.col("value") <= F.col("median")).cast("int"))
    exact = events.join(known.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), below.alias("below"))
    own, estimate = known.drop("median").join(exact, "event_type"), F.col("estimate")
    near = F.abs(estimate - F.col("users")) <= F.greatest(F.lit(1.0), 0.05 * F.col("users"))
    middle = F.abs(F.col("below") - 0.5) <= F.greatest(F.lit(0.02), 1 / F.col("n"))
    return own.select("event_type", "n", "users", near.alias("users_near"), (estimate == F.col("whole")).alias("same_as_whole"), middle.alias("median_near"))


@query("""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, value FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM d
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""")
def stream_closed_days(t):
    """Days that are over by the watermark, each written once in append mode."""
    out = f"{shared_folder(t.spark)}/closed-{uuid.uuid4().hex}"
    appended(t.spark, t.path("events"), t("events").schema, lambda e: windowed(e, "1 day", "2 days"), out)
    rows = t.spark.read.parquet(f"{out}/rows")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
