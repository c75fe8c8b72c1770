"""Queries on spend and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverie.functions.scalars import PERIODS
from reverie.operators import ledgers as o
from reverie.operators import retrieval as r
from reverie.plans.stand_ins import BORN, NOW, SCORES, SPEND, puts, scores, spend
from reverie.sources.tables import table

LATER = BORN + 20 * 86_400
_BUDGETS = [("t0", "weekly", 500.0, 0.8, False), ("t1", "monthly", 1500.0, 0.8, False), ("t2", "daily", 10.0, 0.9, False), ("t3", "monthly", 100000.0, 1.4, False), ("t4", "604800", 2000.0, 0.5, False), ("t5", "weekly", 0.0, 0.8, False), ("t6", "weekly", 5.0, 0.8, True)]


def budget_events(s, d):
    """Fixed budgets, the first of them set twice."""
    rows = [(i + 1, *b) for i, b in enumerate(_BUDGETS)] + [(0, "t0", "daily", 1.0, 0.1, False)]
    return s.createDataFrame(rows, "seq int, tenant string, period string, amount double, warn_pct double, deleted boolean")


def status(s, d):
    return o.budget_status(spend(s, d), o.latest_budgets(budget_events(s, d)), LATER)


def run_events(s, d):
    """Runs named by language: scored by source; ended by remainder."""
    docs = table(s, d, "documents")
    scored = docs.where("doc_id % 3 > 0").select(F.concat(F.lit("run"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("run_id"), F.lit("score").alias("kind"), F.lit(None).cast("string").alias("reason"), F.col("doc_id").alias("seq"))
    begun = docs.select(F.concat(F.lit("run"), F.pmod("doc_id", F.lit(45)).cast("string")).alias("run_id"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(-1).cast("long").alias("seq")).distinct()
    ended = docs.where("doc_id % 45 % 4 = 1").select(F.concat(F.lit("run"), F.pmod("doc_id", F.lit(45)).cast("string")).alias("run_id"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "complete").otherwise("fail").alias("kind"), F.concat(F.lit("at"), F.col("doc_id").cast("string")).alias("reason"), (F.col("doc_id") + 100000).alias("seq"))
    return scored.unionByName(begun).unionByName(ended)


_EVENTS = "(SELECT 'run' || (doc_id % 40) AS run_id, 'score' AS kind, NULL::VARCHAR AS reason, doc_id AS seq FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT DISTINCT 'run' || (doc_id % 45), 'start', NULL, -1 FROM documents UNION ALL SELECT 'run' || (doc_id % 45), CASE WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'fail' END, 'at' || doc_id, doc_id + 100000 FROM documents WHERE doc_id % 45 % 4 = 1)"
_STATES = f"(SELECT s.run_id, CASE WHEN e.kind = 'complete' THEN 'completed' WHEN e.kind = 'fail' THEN 'failed' WHEN s.scores > 0 THEN 'running' ELSE 'pending' END AS status, CASE WHEN e.kind = 'fail' THEN e.reason END AS reason, s.scores FROM (SELECT run_id, count(*) FILTER (kind = 'score') AS scores FROM {_EVENTS} GROUP BY run_id) s LEFT JOIN (SELECT run_id, arg_min(kind, seq) AS kind, arg_min(reason, seq) AS reason FROM {_EVENTS} WHERE kind IN ('complete', 'fail') GROUP BY run_id) e USING (run_id))"


def failure_clusters(s, d):
    """Failing rows of run a, clustered by their texts' hashed vectors."""
    failed = scores(s, d).where("run_id = 'a' and score < 0.2")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), r.hash_embedding(F.col("text"), 32).alias("vec"))
    return o.greedy_clusters(failed.join(docs, "row_id"), group="run_id", id_col="row_id", order_col="score", vec_col="vec", similarity=0.9, most=20)


def expensive_clusters(s, d):
    """The fifty dearest entries, clustered by the vectors of the documents that stand for their input."""
    dear = spend(s, d).orderBy(F.col("cost_usd").desc(), "id").limit(50).withColumn("all", F.lit("all")).withColumn("rank", -F.col("cost_usd"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), r.hash_embedding(F.col("text"), 32).alias("vec"))
    n = table(s, d, "documents").count()
    rows = dear.withColumn("doc", F.col("id") % n).join(docs.withColumnRenamed("id", "doc"), "doc")
    return o.greedy_clusters(rows.select("all", F.col("id"), "rank", "vec"), group="all", id_col="id", order_col="rank", vec_col="vec", similarity=0.7, most=10)


_money = lambda df, *keep: df.select(*keep, "entries", "tokens_in", "tokens_out", F.round("total_usd", 2).alias("total_usd"), F.round("mean_usd", 4).alias("mean_usd"))
_ROLL = "count(*) AS entries, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 2) AS total_usd, round(avg(cost_usd), 4) AS mean_usd"
_BUCKET = {"tenant": "tenant", "model": "model", "prompt": "coalesce(prompt_name, '(none)')", "day": "strftime(to_timestamp(recorded_at) AT TIME ZONE 'UTC', '%Y-%m-%d')", "none": "'(all)'"}
_PLAN = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}', {PERIODS.get(p) or int(p)}, {a}, {min(1.0, w)})" for t, p, a, w, gone in _BUDGETS if not gone) + ") v(tenant, secs, amount, warn))"
_STATUS = f"(SELECT t.tenant, coalesce(x.spent, 0) AS spent, p.amount, CASE WHEN p.amount > 0 THEN coalesce(x.spent, 0) / p.amount ELSE 0 END AS utilization, CASE WHEN p.amount IS NULL THEN 'nobudget' WHEN coalesce(x.spent, 0) >= p.amount THEN 'exceeded' WHEN p.warn > 0 AND coalesce(x.spent, 0) >= p.amount * p.warn THEN 'warning' ELSE 'ok' END AS status FROM (SELECT tenant FROM {SPEND} UNION SELECT tenant FROM {_PLAN}) t LEFT JOIN {_PLAN} p USING (tenant) LEFT JOIN (SELECT e.tenant, sum(cost_usd) AS spent FROM {SPEND} e JOIN {_PLAN} p USING (tenant) WHERE recorded_at >= {LATER} - p.secs AND recorded_at < {LATER} GROUP BY e.tenant) x USING (tenant))"
_AT = lambda q: f"max(CASE WHEN r = floor((n - 1) * {q} + 0.5) + 1 THEN score END)"
_SUMMARY = f"(SELECT run_id, count(*) AS n, avg(score) AS mean, {_AT('0.5')} AS p50, {_AT('0.9')} AS p90, {_AT('0.99')} AS p99, min(score) AS lowest, max(score) AS highest, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM {SCORES}) GROUP BY run_id)"

QUERIES = {f"cost_aggregate_{by}": (lambda s, d, by=by: _money(o.aggregate_spend(spend(s, d), by), "bucket")) for by in o.GROUPS}
SQL = {f"cost_aggregate_{by}": f"SELECT {_BUCKET[by]} AS bucket, {_ROLL} FROM {SPEND} GROUP BY 1" for by in o.GROUPS}
QUERIES |= {
    "cost_total": lambda s, d: o.total_spend(spend(s, d), o.spend_filter(tenant="t1", since=BORN + 86_400, until=LATER)).select(F.round("total_usd", 2).alias("total_usd")),
    "cost_query": lambda s, d: o.query_spend(spend(s, d), o.spend_filter(model="purchase", since=BORN), 20).select("id", "tenant", "recorded_at"),
    "cost_cube": lambda s, d: o.cube_spend(spend(s, d)).select("tenant", "model", "level", "entries", F.round("total_usd", 2).alias("total_usd")),
    "budget_status": lambda s, d: status(s, d).select("tenant", F.round("spent", 2).alias("spent"), "amount", F.round("utilization", 4).alias("utilization"), "status"),
    "budget_alerts": lambda s, d: o.alerts(status(s, d)).select("tenant", F.round("utilization", 4).alias("utilization"), "status"),
    "rolling_spend": lambda s, d: o.rolling_spend(spend(s, d), 7 * 86_400).select("id", F.round("rolling_usd", 2).alias("rolling_usd")),
    "ledger_stats": lambda s, d: spend(s, d).agg(F.count("*").alias("entries"), F.countDistinct("tenant").alias("tenants"), F.round(F.sum("cost_usd"), 2).alias("total_usd")),
    "eval_summary": lambda s, d: o.summarize(o.current_scores(scores(s, d))).select("run_id", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p99", "lowest", "highest", "pass_rate"))),
    "eval_compare": lambda s, d: o.compare_runs(scores(s, d), "a", "b").select("row_id", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"), F.round("delta", 6).alias("delta"), "change"),
    "eval_compare_summary": lambda s, d: o.compare_summaries(o.summarize(scores(s, d)), "a", "b").select(F.round("mean_delta", 6).alias("mean_delta"), F.round("pass_delta", 6).alias("pass_delta")),
    "eval_states": lambda s, d: o.state_of_runs(run_events(s, d)),
    "eval_stats": lambda s, d: o.run_stats(o.state_of_runs(run_events(s, d)), run_events(s, d).where("kind = 'score'")),
    "eval_run_names": lambda s, d: puts(s, d).select(o.run_name(F.col("name"), F.when(F.col("split") != "test", F.col("split")), F.lit("m1")).alias("run")).distinct(),
    "failure_clusters": failure_clusters,
    "expensive_clusters": expensive_clusters,
}
SQL |= {
    "cost_total": f"SELECT round(coalesce(sum(cost_usd), 0), 2) AS total_usd FROM {SPEND} WHERE tenant = 't1' AND recorded_at >= {BORN + 86_400} AND recorded_at < {LATER}",
    "cost_query": f"SELECT id, tenant, recorded_at FROM {SPEND} WHERE model = 'purchase' AND recorded_at >= {BORN} ORDER BY recorded_at DESC, id LIMIT 20",
    "cost_cube": f"SELECT tenant, model, grouping(tenant, model) AS level, count(*) AS entries, round(sum(cost_usd), 2) AS total_usd FROM {SPEND} GROUP BY CUBE (tenant, model)",
    "budget_status": f"SELECT tenant, round(spent, 2) AS spent, amount::DOUBLE AS amount, round(utilization, 4) AS utilization, status FROM {_STATUS}",
    "budget_alerts": f"SELECT tenant, round(utilization, 4) AS utilization, status FROM {_STATUS} WHERE status IN ('warning', 'exceeded')",
    "rolling_spend": f"SELECT id, round(sum(cost_usd) OVER (PARTITION BY tenant ORDER BY recorded_at RANGE BETWEEN {7 * 86_400} PRECEDING AND CURRENT ROW), 2) AS rolling_usd FROM {SPEND}",
    "ledger_stats": f"SELECT count(*) AS entries, count(DISTINCT tenant) AS tenants, round(sum(cost_usd), 2) AS total_usd FROM {SPEND}",
    "eval_summary": f"SELECT run_id, n, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(pass_rate, 6) AS pass_rate FROM {_SUMMARY}",
    "eval_compare": f"SELECT row_id, round(a.score, 6) AS score_a, round(b.score, 6) AS score_b, round(b.score - a.score, 6) AS delta, CASE WHEN a.score IS NULL THEN 'new' WHEN b.score IS NULL THEN 'dropped' WHEN b.score < a.score THEN 'regressed' WHEN b.score > a.score THEN 'improved' ELSE 'equal' END AS change FROM (SELECT * FROM {SCORES} WHERE run_id = 'a') a FULL JOIN (SELECT * FROM {SCORES} WHERE run_id = 'b') b USING (row_id)",
    "eval_compare_summary": f"SELECT round(b.mean - a.mean, 6) AS mean_delta, round(b.pass_rate - a.pass_rate, 6) AS pass_delta FROM {_SUMMARY} a, {_SUMMARY} b WHERE a.run_id = 'a' AND b.run_id = 'b'",
    "eval_states": f"SELECT run_id, status, reason FROM {_STATES}",
    "eval_stats": f"SELECT count(*) AS runs, sum(scores)::BIGINT AS scores, count(*) FILTER (status IN ('pending', 'running')) AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM {_STATES}",
    "eval_run_names": "SELECT DISTINCT source || ':' || CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'eval' ELSE '-' END || ':m1' AS run FROM documents",
}
