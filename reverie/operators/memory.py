"""Long-term memory as an append-only table with logs of recalls and removals.

Memory rows: ``id, key, text, importance, created_at (seconds), kind, tags``.
Current state is a function of the tables and of a time given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reverie.functions.scalars import effective_importance, utility
from reverie.operators.retrieval import hybrid, top
from reverie.sources.scratch import cut

#: Maintenance rewrites the table from this share of removed rows on, and from so many live ones (fixed values).
COMPACT_RATIO, COMPACT_ROWS = 0.20, 64
HALF_LIFE = 86_400.0
IDEMPOTENCY_SECONDS = 86_400


def remember(last_id: int, batch: DataFrame, order: Column, now: float) -> DataFrame:
    """``batch`` with ids after ``last_id`` in input order, defaults, and one time of creation.

    Ids are dealt range-wise: counts by range partition give the offsets, so that no
    single task numbers the whole batch. The dealt rows are written out before they are counted,
    so that a batch that comes out differently when it is computed again cannot give an id twice.
    """
    spark = batch.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(batch.withColumn("_o", order).repartitionByRange(parts, "_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = {r["_p"]: r["count"] for r in dealt.groupBy("_p").count().collect()}
    start, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(start)]
        start += counts[p]
    base = F.element_at(F.create_map(*offsets), F.col("_p")) if offsets else F.lit(0)
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    columns = set(batch.columns)
    default = lambda c, v: F.coalesce(F.col(c), v) if c in columns else v
    return dealt.select((F.lit(last_id + 1) + base + inside).cast("long").alias("id"), "key", "text", default("importance", F.lit(1.0)).alias("importance"), F.lit(float(now)).alias("created_at"), default("kind", F.lit(None).cast("string")).alias("kind"), default("tags", F.array().cast("array<string>")).alias("tags"))


def live(memory: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Rows without a tombstone (``forgotten``: id)."""
    return memory.join(forgotten.select("id").distinct(), "id", "left_anti")


def forget_key(memory: DataFrame, key: str) -> DataFrame:
    """Tombstones ``id, key`` for all rows of a key. The key is kept for subscribers."""
    return memory.where(F.col("key") == key).select("id", "key")


def forget_older(memory: DataFrame, now: float, seconds: float) -> DataFrame:
    """Tombstones for rows created strictly before ``now - seconds``."""
    return memory.where(F.col("created_at") < now - seconds).select("id", "key")


def scan(memory: DataFrame, after: int, limit: int = 10) -> DataFrame:
    """One page of ``id > after`` in the order of ids, with ``next_cursor``: the page's last id if more rows exist."""
    limit = max(1, limit)
    page = memory.where(F.col("id") > after).orderBy("id").limit(limit + 1)
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    page = page.withColumn("_n", F.row_number().over(Window.orderBy("id"))).withColumn("_all", F.count("*").over(w))
    last = F.max(F.when(F.col("_n") == limit, F.col("id"))).over(w)
    return page.withColumn("next_cursor", F.when(F.col("_all") > limit, last)).where(F.col("_n") <= limit).drop("_n", "_all")


def usage(recall_log: DataFrame) -> DataFrame:
    """``id, recalls, last_recall`` from a log of ``id, at``."""
    return recall_log.groupBy("id").agg(F.count("*").alias("recalls"), F.max("at").alias("last_recall"))


def with_utility(memory: DataFrame, recall_log: DataFrame, now: float, half_life: float = HALF_LIFE) -> DataFrame:
    """Rows with ``recalls, last_recall, utility``."""
    rows = memory.join(usage(recall_log), "id", "left")
    return rows.withColumn("utility", utility(F.col("importance"), F.col("created_at"), F.col("recalls"), F.col("last_recall"), now, half_life))


def evict(memory: DataFrame, recall_log: DataFrame, cap: int, now: float, half_life: float = HALF_LIFE) -> DataFrame:
    """The rows beyond ``cap`` with the least utility, ties by id: their tombstones ``id, utility``.

    Approximate quantiles bracket the utility of the last row to go. What lies below goes without being sorted;
    only the rows inside the bracket are ordered to find the exact cut.
    """
    rows = cut(with_utility(memory, recall_log, now, half_life).select("id", "utility"))
    n = rows.count()
    over = max(0, n - cap)
    if not 0 < over < n:
        return rows if over else rows.limit(0)
    low, high = (rows.select(F.percentile_approx("utility", [max(0.0, over / n - 0.005), min(1.0, over / n + 0.005)], 1000)).first()[0]) or (None, None)
    below, upto = rows.agg(F.count_if(F.col("utility") < low), F.count_if(F.col("utility") <= high)).first()
    if below > over:
        low, below = None, 0
    sure = rows.limit(0) if low is None else rows.where(F.col("utility") < low)
    inside = rows if low is None else rows.where(F.col("utility") >= low)
    inside = inside if upto < over else inside.where(F.col("utility") <= high)
    return sure.unionByName(inside.orderBy("utility", "id").limit(over - below))


def tombstone_ratio(memory: DataFrame, forgotten: DataFrame) -> DataFrame:
    """``indexed, live, ratio, compact``: removed over live rows (0 without live ones), and whether to rewrite."""
    marked = memory.select("id").join(forgotten.select("id").distinct().withColumn("_gone", F.lit(1)), "id", "left")
    out = marked.agg(F.count("*").alias("indexed"), F.count_if(F.col("_gone").isNull()).alias("live"))
    ratio = F.when(F.col("live") == 0, 0.0).otherwise((F.col("indexed") - F.col("live")) / F.col("live"))
    return out.withColumn("ratio", ratio).withColumn("compact", (F.col("ratio") >= COMPACT_RATIO) & (F.col("live") >= COMPACT_ROWS))


def recall(memory: DataFrame, query: str, *, k: int = 10, key: str | None = None, filtered: Column | None = None, spec: str = "hash:32", vec_col: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """``id, score`` and the memory's columns; removed rows must be left out before. ``key`` restricts to one owner.

    ``vec_col`` names stored vectors and ``index`` is a text index; without them both are computed from the texts.
    """
    if key is not None:
        filtered = (F.col("key") == key) if filtered is None else filtered & (F.col("key") == key)
    hits = hybrid(memory, query, k=k, filtered=filtered, spec=spec, vec_col=vec_col, index=index)
    return memory.join(F.broadcast(hits), "id")  # k rows


def recall_decayed(memory: DataFrame, query: str, now: float, half_life: float, *, k: int = 10, spec: str = "hash:32", vec_col: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """2k candidates, scores times effective importance, the best k."""
    hits = memory.join(F.broadcast(hybrid(memory, query, k=2 * k, spec=spec, vec_col=vec_col, index=index)), "id")
    score = F.col("score") * effective_importance(F.col("importance"), F.col("created_at"), now, half_life)
    return top(hits.withColumn("score", score), k)


def reinforcement(hits: DataFrame, now: float) -> DataFrame:
    """Rows for the recall log of the returned hits."""
    return hits.select("id", F.lit(float(now)).alias("at"))


def accept_once(writes: DataFrame, ttl: float = IDEMPOTENCY_SECONDS, *, key: str = "idem_key", at: str = "at", order: str = "seq") -> DataFrame:
    """``order`` column, ``accepted`` and ``original``: the write that a repeated key within ``ttl`` of the last accepted one stands for.

    The window starts at the last accepted write and doesn't slide, which is a fold over each key's writes.
    Each key is one group, so a group is as large as one client's retries.
    """
    import pandas as pd

    kind = dict(writes.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([at, order])
        accepted, original, start, first = [], [], None, None
        for t, s in zip(frame[at], frame[order], strict=True):
            fresh = start is None or t - start >= ttl
            if fresh:
                start, first = t, s
            accepted.append(fresh)
            original.append(first)
        return pd.DataFrame({key: frame[key], order: frame[order], "accepted": accepted, "original": original})

    return writes.select(key, at, order).groupBy(key).applyInPandas(fold, f"{key} {kind[key]}, {order} {kind[order]}, accepted boolean, original {kind[order]}")
