"""Spend ledgers with budgets, and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reverie.functions.scalars import nearest_rank, period_seconds, utc_day

#: Group keys of the spend roll-up.
GROUPS = ("tenant", "model", "prompt", "day", "none")
PASS_FROM = 0.5


# --- spend -------------------------------------------------------------------
# entries: tenant, model, prompt_name, tokens_in, tokens_out, cost_usd, recorded_at (seconds)


def valid_entries(entries: DataFrame) -> DataFrame:
    """Entries that may be recorded: no negative cost."""
    return entries.where(F.col("cost_usd") >= 0)


def spend_filter(*, tenant: str | None = None, model: str | None = None, prompt: str | None = None, since: float | None = None, until: float | None = None) -> Column:
    """Conjunction of the given conditions; ``since`` is inclusive, ``until`` exclusive."""
    out = F.lit(True)
    for name, value in (("tenant", tenant), ("model", model), ("prompt_name", prompt)):
        if value is not None:
            out = out & (F.col(name) == value)
    if since is not None:
        out = out & (F.col("recorded_at") >= since)
    if until is not None:
        out = out & (F.col("recorded_at") < until)
    return out


def query_spend(entries: DataFrame, condition: Column, limit: int = 0, tie: str = "id") -> DataFrame:
    """Matching entries, newest first; limit 0 means all."""
    rows = entries.where(condition).orderBy(F.col("recorded_at").desc(), tie)
    return rows.limit(limit) if limit else rows


def aggregate_spend(entries: DataFrame, by: str) -> DataFrame:
    """``bucket, entries, tokens_in, tokens_out, total_usd, mean_usd``; entries without a prompt are ``(none)``."""
    if by not in GROUPS:
        raise ValueError(f"group by one of {GROUPS}")
    bucket = {"tenant": F.col("tenant"), "model": F.col("model"), "prompt": F.coalesce("prompt_name", F.lit("(none)")), "day": utc_day(F.col("recorded_at")), "none": F.lit("(all)")}[by]
    return entries.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entries"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("total_usd"), F.avg("cost_usd").alias("mean_usd"))


def cube_spend(entries: DataFrame) -> DataFrame:
    """Totals over every combination of tenant and model."""
    return entries.cube("tenant", "model").agg(F.count("*").alias("entries"), F.sum("cost_usd").alias("total_usd"), F.grouping_id().alias("level"))


def total_spend(entries: DataFrame, condition: Column) -> DataFrame:
    return entries.where(condition).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_usd"))


def latest_budgets(events: DataFrame) -> DataFrame:
    """The last event of each tenant (by ``seq``) unless it deletes the budget; warn_pct is kept within 0 and 1."""
    last = events.groupBy("tenant").agg(F.max_by(F.struct("period", "amount", "warn_pct", "deleted"), "seq").alias("b"))
    return last.where("not b.deleted").select("tenant", "b.period", "b.amount", F.least(F.greatest("b.warn_pct", F.lit(0.0)), F.lit(1.0)).alias("warn_pct"))


def budget_status(entries: DataFrame, budgets: DataFrame, now: float) -> DataFrame:
    """``tenant, spent, amount, utilization, status`` of each tenant with entries or a budget: spend of [now - period, now)."""
    plan = budgets.withColumn("since", F.lit(now) - period_seconds(F.col("period")))
    tenants = entries.select("tenant").union(budgets.select("tenant")).distinct()
    spent = entries.join(F.broadcast(plan) if budgets.isLocal() else plan, "tenant").where((F.col("recorded_at") >= F.col("since")) & (F.col("recorded_at") < now)).groupBy("tenant").agg(F.sum("cost_usd").alias("spent"))
    rows = tenants.join(plan, "tenant", "left").join(spent, "tenant", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    status = (
        F.when(F.col("amount").isNull(), "nobudget")
        .when(F.col("spent") >= F.col("amount"), "exceeded")
        .when((F.col("warn_pct") > 0) & (F.col("spent") >= F.col("amount") * F.col("warn_pct")), "warning")
        .otherwise("ok")
    )
    return rows.select("tenant", "spent", "amount", F.when(F.col("amount") > 0, F.col("spent") / F.col("amount")).otherwise(0.0).alias("utilization"), status.alias("status"))


def alerts(status: DataFrame) -> DataFrame:
    """Tenants at warning or beyond."""
    return status.where(F.col("status").isin("warning", "exceeded"))


def rolling_spend(entries: DataFrame, seconds: int) -> DataFrame:
    """Each entry with its tenant's spend in the ``seconds`` up to and with it."""
    w = Window.partitionBy("tenant").orderBy("recorded_at").rangeBetween(-seconds, 0)
    return entries.withColumn("rolling_usd", F.sum("cost_usd").over(w))


# --- evaluation --------------------------------------------------------------
# scores: run_id, row_id, score, seq


def run_name(dataset: Column, prompt: Column, model: Column) -> Column:
    """``dataset:prompt-or-dash:model``."""
    return F.concat_ws(":", dataset, F.coalesce(prompt, F.lit("-")), model)


def current_scores(events: DataFrame) -> DataFrame:
    """Scores within 0 and 1, the last for each run and row."""
    return events.where("score between 0 and 1").groupBy("run_id", "row_id").agg(F.max_by("score", "seq").alias("score"))


def summarize(scores: DataFrame, pass_from: float = PASS_FROM) -> DataFrame:
    """``run_id, n, mean, p50, p90, p99, lowest, highest, pass_rate`` with nearest-rank percentiles.

    Scores are counted by value first, on the map side as well; ranks are found among a run's distinct values.
    """
    counted = scores.groupBy("run_id", "score").agg(F.count("*").alias("c"))
    run = Window.partitionBy("run_id")
    ranked = counted.withColumn("_upto", F.sum("c").over(run.orderBy("score"))).withColumn("_n", F.sum("c").over(run))
    at = lambda q: F.min(F.when(F.col("_upto") >= nearest_rank(q, F.col("_n")), F.col("score")))
    share = F.sum(F.when(F.col("score") >= pass_from, F.col("c")).otherwise(0)) / F.sum("c")
    return ranked.groupBy("run_id").agg(F.sum("c").alias("n"), (F.sum(F.col("score") * F.col("c")) / F.sum("c")).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.min("score").alias("lowest"), F.max("score").alias("highest"), share.alias("pass_rate"))


def compare_runs(scores: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """``row_id, score_a, score_b, delta, change`` with change one of regressed, improved, equal, new, dropped."""
    a = scores.where(F.col("run_id") == run_a).select("row_id", F.col("score").alias("score_a"))
    b = scores.where(F.col("run_id") == run_b).select("row_id", F.col("score").alias("score_b"))
    delta = F.col("score_b") - F.col("score_a")
    change = F.when(F.col("score_a").isNull(), "new").when(F.col("score_b").isNull(), "dropped").when(delta < 0, "regressed").when(delta > 0, "improved").otherwise("equal")
    return a.join(b, "row_id", "full").select("row_id", "score_a", "score_b", delta.alias("delta"), change.alias("change"))


def changed_rows(compared: DataFrame, change: str) -> DataFrame:
    """The regressed or improved rows of a comparison, the largest change first."""
    order = F.col("delta").asc() if change == "regressed" else F.col("delta").desc()
    return compared.where(F.col("change") == change).orderBy(order, "row_id")


def compare_summaries(summaries: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """``mean_delta, pass_delta`` from frozen summaries; 0 if either run has none."""
    value = lambda run, c: F.max(F.when(F.col("run_id") == run, F.col(c)))
    return summaries.agg(*(F.coalesce(value(run_b, c) - value(run_a, c), F.lit(0.0)).alias(name) for c, name in (("mean", "mean_delta"), ("pass_rate", "pass_delta"))))


def state_of_runs(events: DataFrame) -> DataFrame:
    """``run_id, status, reason`` after events ``run_id, kind (start, score, complete, fail), reason, seq``.

    The first score (or, of a replay, the first recorded output) makes a pending run a running one; after an end nothing counts.
    """
    end = F.min_by(F.struct("kind", "reason"), "seq")
    ended = events.where("kind in ('complete', 'fail')").groupBy("run_id").agg(end.alias("e"))
    seen = events.groupBy("run_id").agg(F.count_if(F.col("kind") == "score").alias("scores"))
    status = F.when(F.col("e.kind") == "complete", "completed").when(F.col("e.kind") == "fail", "failed").when(F.col("scores") > 0, "running").otherwise("pending")
    return seen.join(ended, "run_id", "left").select("run_id", status.alias("status"), F.when(F.col("e.kind") == "fail", F.col("e.reason")).alias("reason"))


def run_stats(states: DataFrame, scores: DataFrame) -> DataFrame:
    """``runs, scores, running, completed, failed``; pending runs count as running."""
    counts = states.agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin("pending", "running")).alias("running"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.join(scores.agg(F.count("*").alias("scores")))  # two single rows


def greedy_clusters(rows: DataFrame, *, group: str, id_col: str, order_col: str, vec_col: str, similarity: float, most: int, neighbours: int = 64) -> DataFrame:
    """``group, cluster, seed, id, size``: each row not yet taken seeds a cluster in the order of ``order_col`` and takes its nearest untaken rows.

    Membership depends on what came before, so a group is folded in one task. Callers
    bound groups first (failing rows of one run, the N dearest entries).
    """
    import numpy as np
    import pandas as pd

    kinds = dict(rows.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order_col, id_col], kind="stable").reset_index(drop=True)
        v = np.stack(frame[vec_col].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        taken, out = np.zeros(len(v), dtype=bool), []
        for seed in range(len(v)):
            if taken[seed]:
                continue
            near = np.round(np.clip(v @ v[seed], 0, 1), 9)
            order = np.lexsort((frame[id_col], -near))
            order = [i for i in order if i != seed][:neighbours]
            members = [seed, *(i for i in order if not taken[i] and near[i] >= similarity)]
            taken[members] = True
            out.append(members)
        out.sort(key=lambda m: -len(m))
        return pd.DataFrame([(frame[group][0], c, frame[id_col][m[0]], frame[id_col][i], len(m)) for c, m in enumerate(out[:most]) for i in m], columns=[group, "cluster", "seed", id_col, "size"])

    return rows.select(group, id_col, order_col, vec_col).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, cluster int, seed {kinds[id_col]}, {id_col} {kinds[id_col]}, size int")
