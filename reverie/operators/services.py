"""Key-value log, audit, limits, argument parsing and figures about a store."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("ok", "error", "open")


# --- key-value: key, value, seq; a null value deletes ---


def current_values(log: DataFrame) -> DataFrame:
    """``key, value`` after the last write of each key, without deleted ones."""
    return log.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("w")).select("key", "w.value").where("value is not null")


def scan_prefix(values: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Entries whose key begins with ``prefix``; with a limit, the first in the order of keys."""
    rows = values.where(F.col("key").startswith(prefix))
    return rows.orderBy("key").limit(limit) if limit is not None else rows


def expired_sessions(writes: DataFrame, now: float) -> DataFrame:
    """``session_id`` of the sessions (``session_id, at, ttl, seq``) whose last access is a ttl or more ago: what a purge removes."""
    last = writes.groupBy("session_id").agg(F.max("at").alias("at"), F.max_by("ttl", "seq").alias("ttl"))
    return last.where(F.lit(now) - F.col("at") >= F.col("ttl")).select("session_id")


# --- audit and limits ---


def recent_audit(audit: DataFrame, tenant: str | None, n: int = 1000) -> DataFrame:
    """The newest ``n`` records, of one tenant or of all."""
    rows = audit if tenant is None else audit.where(F.col("tenant") == tenant)
    return rows.orderBy(F.col("at").desc(), F.col("seq").desc()).limit(n)


def rate_limited(calls: DataFrame, per_second: int) -> DataFrame:
    """Calls with ``allowed``: the first ``per_second`` of a principal in each second."""
    w = Window.partitionBy("principal", F.floor("at")).orderBy("seq")
    return calls.withColumn("allowed", F.row_number().over(w) <= per_second)


# --- arguments ---


def filter_arguments(text: str | None) -> dict:
    """A filter's JSON as arguments of ``recall_filter`` or ``search_spans``; unknown members and states mean no filter."""
    try:
        given = json.loads(text or "{}")
    except json.JSONDecodeError as error:
        raise ValueError("a filter must be a JSON object") from error
    if not isinstance(given, dict):
        raise ValueError("a filter must be a JSON object")
    known = {k: given[k] for k in ("kind", "tags_any", "min_created", "max_created", "within_secs", "prefix", "since", "until", "status", "trace_id") if given.get(k) not in (None, "")}
    if known.get("status") not in (None, *STATUSES):
        del known["status"]
    return known


def within(arguments: dict, now: float) -> dict:
    """``within_secs`` as a lower bound of creation."""
    rest = {k: v for k, v in arguments.items() if k != "within_secs"}
    return rest | {"min_created": now - arguments["within_secs"]} if "within_secs" in arguments else rest


def dataset_rows(texts: DataFrame, json_col: str) -> DataFrame:
    """Rows of a dataset from a JSON array per input row: strings, or objects with id, text, data, split, annotations.

    A missing id becomes a digest of its place and text, so that a rerun gives the same ids.
    """
    items = F.from_json(F.col(json_col), "array<string>")
    rows = texts.select("*", F.posexplode(items).alias("place", "_item"))
    member = lambda name: F.get_json_object("_item", f"$.{name}")
    is_object = F.col("_item").startswith("{")
    text = F.when(is_object, member("text")).otherwise(F.col("_item"))
    made = F.substring(F.md5(F.concat_ws("/", F.col("place").cast("string"), F.coalesce(text, F.lit(""))).cast("binary")), 1, 16)
    return rows.select(*texts.columns, "place", F.coalesce(F.when(is_object, member("id")), made).alias("id"), text.alias("text"), F.when(is_object, member("data")).alias("data"), F.coalesce(F.when(is_object, member("split")), F.lit("")).alias("split"), F.when(is_object, member("annotations")).alias("annotations")).drop(json_col)


def hit_line(id_: Column, score: Column, text: Column) -> Column:
    """A hit as a line: id, score with six decimals, text."""
    return F.concat_ws("\t", id_.cast("string"), F.format_string("%.6f", score), text)


# --- figures ---


def latency_percentiles(samples: DataFrame, by: str) -> DataFrame:
    """p50, p95 and p99 by the benchmark's rank: round(p * n), at least the first. Values are counted before they are ranked."""
    counted = samples.groupBy(by, "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    ranked = counted.withColumn("_upto", F.sum("c").over(w.orderBy("value"))).withColumn("_n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.greatest(F.bround(F.col("_n") * F.lit(p)), F.lit(1.0)), F.col("value")))
    return ranked.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def info(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, rows`` of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clustered_vectors(spark: SparkSession, n: int, dim: int, *, deviation: float = 0.35, per_cluster: int = 500, seed: int = 42) -> DataFrame:
    """``id, cluster, embedding``: unit vectors about max(8, n / per_cluster) random centres, each row by its own seed."""
    import numpy as np
    import pandas as pd

    count = max(8, n // per_cluster)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = np.random.default_rng(seed).normal(size=(count, dim))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        for f in frames:
            which = [int(i) % count for i in f["id"]]
            v = np.stack([centres[c] + deviation * np.random.default_rng([seed, int(i)]).normal(size=dim) for i, c in zip(f["id"], which, strict=True)]) if len(f) else np.empty((0, dim))
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": f["id"], "cluster": which, "embedding": list(v)})

    return spark.range(n).mapInPandas(fill, "id long, cluster int, embedding array<double>")
