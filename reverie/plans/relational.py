"""Plain relational queries over the sample tables, and storage round trips."""

from __future__ import annotations



from pyspark.sql import Window
from pyspark.sql import functions as F

from reverie.functions.scalars import glob_match
from reverie.operators.ledgers import summarize
from reverie.plans.stand_ins import MEMORY, memory
from reverie.sources import tables as t
from reverie.sources.scratch import folder as _scratch
from reverie.sources.tables import table


def pricing_summary(s, d):
    l = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")  # noqa: E741
    gross = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(gross), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def revenue_by_nation(s, d):
    joined = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def customers_without_urgent_orders(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderpriority like '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def top_orders_per_customer(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(s, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


def order_cube(s, d):
    return table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


def set_operations(s, d):
    a = table(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b).distinct(), "extra")).unionByName(tag(a.union(b).distinct(), "any"))


def as_of_join(s, d):
    """Each purchase with its user's last view at or before it: a union ordered by time, last view carried on."""
    e = table(s, d, "events").where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


def export_round_trip(s, d):
    """Rows, schema and content of the memory export after reading it back."""
    path = _scratch(s)
    t.export_memory(memory(s, d).withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0))), path)
    back = s.read.parquet(path)
    return back.select("id", "key", F.round(F.col("importance").cast("double"), 3).alias("importance"), (F.col("created_at_ns") / 1_000_000_000).cast("long").alias("created_at"), F.size("embedding").alias("dim"))


def snapshot_verify(s, d):
    """A copied folder against its manifest, after one file was added: the added one is named a problem."""
    source, target = _scratch(s), _scratch(s)
    memory(s, d).select("id", "key").repartition(2, "id").write.parquet(source)
    manifest = t.manifest(s, source).where("path like 'part%' or path like '_SUCCESS'")
    t.copy_folder(s, source, target)
    memory(s, d).select("id").limit(1).write.json(f"{target}/extra")
    found = t.verify_snapshot(s, target, manifest)
    return found.groupBy("problem").agg(F.min((F.col("path").startswith("extra/")).cast("int")).alias("extra"))


def glob_sources(s, d):
    return table(s, d, "documents").where(glob_match(F.concat_ws(".", F.lit("memory"), "source"), "memory.src?")).groupBy("source").agg(F.count("*").alias("n"))


def percentile_summary(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_totalprice").alias("score"))
    return summarize(rows, 100_000.0).select("run_id", "n", *(F.round(c, 2).alias(c) for c in ("p50", "p90", "p99", "lowest", "highest")))


QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation, customers_without_urgent_orders, top_orders_per_customer, order_cube, set_operations, as_of_join, export_round_trip, snapshot_verify, glob_sources, percentile_summary)}
_AT = lambda q: f"round(max(CASE WHEN r = floor((n - 1) * {q} + 0.5) + 1 THEN score END), 2)"
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "customers_without_urgent_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "top_orders_per_customer": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "set_operations": "SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'extra', k FROM (SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "as_of_join": "SELECT event_id, coalesce(view_id, -1) AS view_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS view_id FROM events WHERE event_type IN ('purchase', 'view')) WHERE event_type = 'purchase'",
    "export_round_trip": f"SELECT id, key, round(importance, 3)::DOUBLE AS importance, created_at, 2 AS dim FROM {MEMORY}",
    "snapshot_verify": "SELECT 'unexpected' AS problem, 1 AS extra",
    "glob_sources": "SELECT source, count(*) AS n FROM documents WHERE regexp_full_match('memory.' || source, 'memory\\.src.') GROUP BY source",
    "percentile_summary": f"SELECT run_id, n, {_AT('0.5')} AS p50, {_AT('0.9')} AS p90, {_AT('0.99')} AS p99, round(min(score), 2) AS lowest, round(max(score), 2) AS highest FROM (SELECT o_orderpriority AS run_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY run_id, n",
}
