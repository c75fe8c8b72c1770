"""Queries on the key-value log, audit, limits and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverie.functions.scalars import micros
from reverie.operators import services as v
from reverie.plans.stand_ins import BORN
from reverie.sources.tables import table


def _log(s, d):
    e = table(s, d, "events")
    return e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"), F.col("event_id").alias("seq"))


_LOG = "(SELECT 'user/' || user_id || '/' || event_type AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id AS seq FROM events)"
_NOW = f"(SELECT key, w.v AS value FROM (SELECT key, arg_max(struct_pack(v := value), seq) AS w FROM {_LOG} GROUP BY key) WHERE w.v IS NOT NULL)"


def _calls(s, d):
    e = table(s, d, "events")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("principal"), F.col("event_type").alias("tenant"), F.floor(micros(F.col("ts")) / 1_000_000 / 600).alias("at"), F.col("event_id").alias("seq"))


def dataset_rows(s, d):
    b = table(s, d, "benchmark")
    made = b.select("item_id", F.to_json(F.array(F.col("text"), F.to_json(F.struct(F.concat(F.lit("id"), F.col("item_id").cast("string")).alias("id"), F.col("text"), F.lit("train").alias("split"))))).alias("j"))
    return v.dataset_rows(made, "j").select("item_id", "place", "id", F.md5(F.col("text").cast("binary")).alias("digest"), "split")


QUERIES = {
    "kv_values": lambda s, d: v.current_values(_log(s, d)),
    "kv_scan_prefix": lambda s, d: v.scan_prefix(v.current_values(_log(s, d)), "user/1", 25).select("key", "value"),
    "kv_count": lambda s, d: v.current_values(_log(s, d)).agg(F.count("*").alias("n")),
    "session_purge": lambda s, d: v.expired_sessions(table(s, d, "events").select(F.col("user_id").alias("session_id"), F.floor(micros(F.col("ts")) / 1_000_000).alias("at"), (F.col("event_id") % 5 * 86_400).alias("ttl"), F.col("event_id").alias("seq")), BORN + 30 * 86_400),
    "audit_recent": lambda s, d: v.recent_audit(_calls(s, d), "purchase", 50).select("principal", "at", "seq"),
    "rate_limit": lambda s, d: v.rate_limited(_calls(s, d), 2).groupBy("principal", "allowed").agg(F.count("*").alias("n")),
    "dataset_rows_from_json": dataset_rows,
    "hit_lines": lambda s, d: table(s, d, "benchmark").select("item_id", v.hit_line(F.col("item_id"), F.col("item_id") / 7.0, F.col("text")).alias("line")),
    "latency_percentiles": lambda s, d: v.latency_percentiles(table(s, d, "events").select("event_type", "value"), "event_type").select("event_type", *(F.round(c, 4).alias(c) for c in ("p50", "p95", "p99"))),
    "store_info": lambda s, d: v.info({n: table(s, d, n) for n in ("documents", "events", "conversations", "labels")}),
    "clustered_vectors": lambda s, d: v.clustered_vectors(s, 2000, 16).select("id", "cluster", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x), 9).alias("squares")),
}
_AT = lambda p: f"round(max(CASE WHEN r = greatest(round_even(n * {p}, 0), 1) THEN value END), 4)"
SQL = {
    "kv_values": f"SELECT key, value FROM {_NOW}",
    "kv_scan_prefix": f"SELECT key, value FROM {_NOW} WHERE starts_with(key, 'user/1') ORDER BY key LIMIT 25",
    "kv_count": f"SELECT count(*) AS n FROM {_NOW}",
    "session_purge": f"SELECT user_id AS session_id FROM events GROUP BY user_id HAVING {BORN + 30 * 86_400} - max(epoch_us(ts) // 1000000) >= arg_max(event_id % 5 * 86400, event_id)",
    "audit_recent": "SELECT 'u' || (user_id % 3) AS principal, epoch_us(ts) // 600000000 AS \"at\", event_id AS seq FROM events WHERE event_type = 'purchase' ORDER BY epoch_us(ts) // 600000000 DESC, event_id DESC LIMIT 50",
    "rate_limit": "SELECT principal, allowed, count(*) AS n FROM (SELECT 'u' || (user_id % 3) AS principal, row_number() OVER (PARTITION BY user_id % 3, epoch_us(ts) // 600000000 ORDER BY event_id) <= 2 AS allowed FROM events) GROUP BY ALL",
    "dataset_rows_from_json": "SELECT item_id, 0 AS place, substr(md5('0/' || text), 1, 16) AS id, md5(text) AS digest, '' AS split FROM benchmark UNION ALL SELECT item_id, 1, 'id' || item_id, md5(text), 'train' FROM benchmark",
    "hit_lines": "SELECT item_id, printf('%d', item_id) || chr(9) || printf('%.6f', item_id / 7.0) || chr(9) || text AS line FROM benchmark",
    "latency_percentiles": f"SELECT event_type, {_AT('0.5')} AS p50, {_AT('0.95')} AS p95, {_AT('0.99')} AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type, n",
    "store_info": "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels",
    "clustered_vectors": "SELECT i AS id, i % 8 AS cluster, 16 AS dim, 1.0::DOUBLE AS squares FROM range(2000) t(i)",
}
