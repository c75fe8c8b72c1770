"""Queries on retrieval and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reverie.functions.scalars import micros
from reverie.operators import memory as m
from reverie.operators import retrieval as r
from reverie.plans.stand_ins import BORN, MEMORY, NOW, RECALLS, memory, recall_log
from reverie.sources.scratch import folder
from reverie.sources.tables import table

QUERY, DIM, HALF = "the of and with", 32, 7 * 86_400.0
_TERMS = r.query_terms(QUERY)
_rounded = lambda df, *keep: df.select(*keep, F.round("score", 6).alias("score"))

# --- SQL pieces ---
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def bm25_sql(rows: str) -> str:
    """Scores ``id, score`` of the query over a subquery with id and text."""
    counts = ", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS f{i}" for i, t in enumerate(_TERMS))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(_TERMS)))
    parts = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(_TERMS)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(_TERMS)))
    return f"(WITH w AS (SELECT id, {_WORDS} AS w FROM {rows}), c AS (SELECT id, len(w) AS len, {counts} FROM w), s AS (SELECT count(*) AS n, avg(len) AS mean, {stats} FROM c) SELECT id, {parts} AS score FROM c, s WHERE {some})"


_QUERY_VECTOR = "[" + ", ".join(map(repr, r.hash_query(QUERY, DIM))) + "]"


def embedded_sql(rows: str) -> str:
    """``id, v`` with hashed unit vectors."""
    place = f"('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM}"
    return f"(WITH p AS (SELECT id, list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''), lambda t: {place}) AS p FROM {rows}), c AS (SELECT id, list_transform(range({DIM}), lambda b: len(list_filter(p, lambda x: x = b))::DOUBLE) AS c FROM p) SELECT id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-6)) AS v FROM c)"


def near_sql(rows: str) -> str:
    q = _QUERY_VECTOR
    return f"(SELECT id, list_dot_product(v, {q}) / greatest(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({q}, {q})), 1.1920929e-07) AS score FROM {embedded_sql(rows)})"


def top_sql(scored: str, k: int) -> str:
    return f"(SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {scored} ORDER BY score DESC, id LIMIT {k})"


def hybrid_sql(rows: str, k: int, per: int) -> str:
    return f"(SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT id, r FROM {top_sql(near_sql(rows), per)} UNION ALL SELECT id, r FROM {top_sql(bm25_sql(rows), per)}) GROUP BY id ORDER BY score DESC, id LIMIT {k})"


_USED = f"(SELECT m.*, u.recalls, u.last_recall, importance * pow(2, -greatest({NOW} - created_at, 0) / {HALF}) * CASE WHEN u.last_recall IS NULL THEN 1 ELSE 1 + u.recalls * pow(2, -greatest({NOW} - u.last_recall, 0) / {HALF}) END AS utility FROM {MEMORY} m LEFT JOIN (SELECT id, count(*) AS recalls, max(\"at\") AS last_recall FROM {RECALLS} GROUP BY id) u USING (id))"
_FILTER = {"kind": "en", "tags_any": ["m1", "src3"], "min_created": BORN + 600, "max_created": BORN + 30_000}
_FILTERED = f"(SELECT * FROM {MEMORY} WHERE kind = 'en' AND list_has_any(tags, ['m1', 'src3']) AND created_at >= {BORN + 600} AND created_at <= {BORN + 30_000})"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _first(s, d):
    return _vectors(s, d).where("id = 0").first()[1]


def _forgotten(s, d):
    rows = memory(s, d)
    return m.forget_key(rows, "src3").unionByName(m.forget_older(rows, BORN + 7200, 3600))


_GONE = f"(SELECT id FROM {MEMORY} WHERE key = 'src3' OR created_at < {BORN + 3600})"


def semantic_neighbours(s, d):
    """For every vector, the three most cosine-similar others with its label."""
    rows = table(s, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "embedding")
    pairs = r.best_matches(rows.withColumnRenamed("id", "q"), rows, 3, 6, others=True).select("q", "id", "score")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where("rank <= 3")


def recall_quality(s, d):
    """recall@10 and nDCG@10 of a coarse ranking (the first 32 components) against the exact one, for query vector 0."""
    rows, q = _vectors(s, d), _first(s, d)
    coarse = r.top(r.vector_scores(rows.select("id", F.slice("embedding", 1, 32).alias("embedding")), q[:32]).withColumn("score", F.round("score", 9)), 10)
    found = coarse.select(F.lit(0).alias("query_id"), "id", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"))
    truth = r.top(r.vector_scores(rows, q).withColumn("score", F.round("score", 9)), 10).select(F.lit(0).alias("query_id"), "id")
    return r.recall_at_k(found, truth, 10).select("query_id", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1.1920929e-07)"


_V = "(SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
_SCORED = f"SELECT v.id, round({_cos('v.e', 'q.e')}, 9) AS score FROM {_V} v, (SELECT e FROM {_V} WHERE id = 0) q"

def vector_topk_ann(s, d):
    """The ten nearest of vector 0 by hashed signs: exact scores of the rows in its buckets."""
    planes = r.hyperplanes(64)
    rows = _vectors(s, d).withColumn("buckets", r.sign_buckets(F.col("embedding"), planes))
    return _rounded(r.approximate_top(rows, [float(x) for x in _first(s, d)], planes, 10), "id")


def bm25_indexed(s, d):
    """The text index of the memories, written in folders by bucket, and a query on it."""
    rows, path = memory(s, d), folder(s)
    r.text_index(rows).write.partitionBy("bucket").parquet(path)
    return _rounded(r.top(r.bm25_indexed(s.read.parquet(path), rows.select("id", r.term_total(F.col("text")).alias("n_terms")), QUERY), 32), "id")


QUERIES = {
    "bm25_indexed": bm25_indexed,
    "vector_topk_ann": vector_topk_ann,
    "bm25_topk": lambda s, d: _rounded(r.top(r.bm25(memory(s, d), QUERY), 32), "id"),
    "vector_topk": lambda s, d: _rounded(r.top(r.vector_scores(_vectors(s, d), _first(s, d)), 10), "id"),
    "semantic_neighbours": semantic_neighbours,
    "hash_embedding": lambda s, d: memory(s, d).select("id", F.transform(r.hash_embedding(F.col("text"), DIM), lambda x: F.round(x, 6)).alias("v")).select("id", *(F.element_at("v", i + 1).alias(f"v{i}") for i in range(DIM))),
    "rrf_fuse": lambda s, d: _rounded(r.rrf([r.top(r.vector_scores(memory(s, d).select("id", r.hash_embedding(F.col("text"), DIM).alias("embedding")), r.hash_query(QUERY, DIM)), 32), r.top(r.bm25(memory(s, d), QUERY), 32)], n=20), "id"),
    "hybrid_recall": lambda s, d: _rounded(m.recall(memory(s, d), QUERY), "id", "key", "kind"),
    "hybrid_recall_filtered": lambda s, d: _rounded(m.recall(memory(s, d), QUERY, k=5, filtered=r.recall_filter(**_FILTER)), "id", "key", "kind"),
    "recall_by_key": lambda s, d: _rounded(m.recall(memory(s, d), QUERY, k=5, key="src4"), "id", "key"),
    "recall_live_only": lambda s, d: _rounded(m.recall(m.live(memory(s, d), _forgotten(s, d)), QUERY, k=10), "id", "key"),
    "recall_decayed": lambda s, d: m.recall_decayed(memory(s, d), QUERY, NOW, HALF, k=5).select("id", F.round("score", 8).alias("score")),
    "reinforcement": lambda s, d: m.reinforcement(m.recall(memory(s, d), QUERY), NOW),
    "recall_quality": recall_quality,
    "memory_filter": lambda s, d: memory(s, d).where(r.recall_filter(**_FILTER)).select("id", "kind", "created_at"),
    "memory_scan": lambda s, d: m.scan(memory(s, d), 17, 25).select("id", "key", "next_cursor"),
    "remember_batch": lambda s, d: m.remember(1000, table(s, d, "benchmark").select(F.col("text").alias("key"), "text", "item_id"), F.col("item_id"), NOW).select("id", F.md5(F.col("text").cast("binary")).alias("digest"), "importance", "created_at"),
    "forget_by_key": lambda s, d: m.forget_key(memory(s, d), "src3"),
    "forget_older": lambda s, d: m.forget_older(memory(s, d), BORN + 7200, 3600),
    "memory_live": lambda s, d: m.live(memory(s, d), _forgotten(s, d)).select("id", "key"),
    "tombstone_ratio": lambda s, d: m.tombstone_ratio(memory(s, d), _forgotten(s, d)).select("indexed", "live", F.round("ratio", 6).alias("ratio"), "compact"),
    "utility_score": lambda s, d: m.with_utility(memory(s, d), recall_log(s, d), NOW, HALF).select("id", F.coalesce("recalls", F.lit(0)).alias("recalls"), F.coalesce("last_recall", F.lit(-1)).alias("last_recall"), F.round("utility", 6).alias("utility")),
    "cap_eviction": lambda s, d: m.evict(memory(s, d), recall_log(s, d), 150, NOW, HALF).select("id"),
    "idempotent_ingest": lambda s, d: m.accept_once(table(s, d, "events").select(F.col("user_id").alias("idem_key"), F.floor(micros(F.col("ts")) / 1_000_000).alias("at"), F.col("event_id").alias("seq")), ttl=5 * 86_400),
}

SQL = {
    "bm25_indexed": f"SELECT id, round(score, 6) AS score FROM {top_sql(bm25_sql(MEMORY), 32)}",
    "bm25_topk": f"SELECT id, round(score, 6) AS score FROM {top_sql(bm25_sql(MEMORY), 32)}",
    "vector_topk": f"SELECT v.id, round({_cos('v.e', 'q.e')}, 6) AS score FROM {_V} v, (SELECT e FROM {_V} WHERE id = 0) q ORDER BY {_cos('v.e', 'q.e')} DESC, v.id LIMIT 10",
    "semantic_neighbours": f"SELECT q, id, score, rank FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS q, v.vec_id AS id, round({_cos('v.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 6) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label AND v.vec_id <> q.vec_id)) WHERE rank <= 3",
    "hash_embedding": "SELECT id, " + ", ".join(f"round(v[{i + 1}], 6) AS v{i}" for i in range(DIM)) + f" FROM {embedded_sql(MEMORY)}",
    "rrf_fuse": f"SELECT id, round(score, 6) AS score FROM {hybrid_sql(MEMORY, 20, 32)}",
    "hybrid_recall": f"SELECT h.id, m.key, m.kind, round(score, 6) AS score FROM {hybrid_sql(MEMORY, 10, 32)} h JOIN {MEMORY} m USING (id)",
    "hybrid_recall_filtered": f"SELECT h.id, m.key, m.kind, round(score, 6) AS score FROM {hybrid_sql(_FILTERED, 5, 128)} h JOIN {MEMORY} m USING (id)",
    "recall_by_key": f"SELECT h.id, m.key, round(score, 6) AS score FROM {hybrid_sql(f'(SELECT * FROM {MEMORY} WHERE key = {chr(39)}src4{chr(39)})', 5, 128)} h JOIN {MEMORY} m USING (id)",
    "recall_live_only": f"SELECT h.id, m.key, round(score, 6) AS score FROM {hybrid_sql(f'(SELECT * FROM {MEMORY} WHERE id NOT IN {_GONE})', 10, 32)} h JOIN {MEMORY} m USING (id)",
    "recall_decayed": f"SELECT id, round(score, 8) AS score FROM (SELECT h.id, h.score * m.importance * pow(2, -greatest({NOW} - m.created_at, 0) / {HALF}) AS score FROM {hybrid_sql(MEMORY, 10, 32)} h JOIN {MEMORY} m USING (id)) ORDER BY score DESC, id LIMIT 5",
    "reinforcement": f"SELECT id, {float(NOW)}::DOUBLE AS \"at\" FROM {hybrid_sql(MEMORY, 10, 32)}",
    "recall_quality": f"WITH t AS (SELECT id FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 10), c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT v.id, round({_cos('v.e[1:32]', 'q.e[1:32]')}, 9) AS score FROM {_V} v, (SELECT e FROM {_V} WHERE id = 0) q) ORDER BY score DESC, id LIMIT 10) SELECT 0 AS query_id, round(count(t.id) / 10.0, 6) AS recall, round(sum(CASE WHEN t.id IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) x(i)), 6) AS ndcg FROM c LEFT JOIN t USING (id)",
    "memory_filter": f"SELECT id, kind, created_at FROM {_FILTERED}",
    "memory_scan": f"WITH p AS (SELECT id, key, row_number() OVER (ORDER BY id) AS n FROM {MEMORY} WHERE id > 17 ORDER BY id LIMIT 26) SELECT id, key, CASE WHEN (SELECT count(*) FROM p) > 25 THEN (SELECT id FROM p WHERE n = 25) END AS next_cursor FROM p WHERE n <= 25",
    "remember_batch": f"SELECT 1000 + row_number() OVER (ORDER BY item_id) AS id, md5(text) AS digest, 1.0::DOUBLE AS importance, {float(NOW)}::DOUBLE AS created_at FROM benchmark",
    "forget_by_key": f"SELECT id, key FROM {MEMORY} WHERE key = 'src3'",
    "forget_older": f"SELECT id, key FROM {MEMORY} WHERE created_at < {BORN + 3600}",
    "memory_live": f"SELECT id, key FROM {MEMORY} WHERE id NOT IN {_GONE}",
    "tombstone_ratio": f"SELECT indexed, live, round((indexed - live) / live, 6) AS ratio, (indexed - live) / live >= 0.2 AND live >= 64 AS compact FROM (SELECT count(*) AS indexed, count(*) FILTER (id NOT IN {_GONE}) AS live FROM {MEMORY})",
    "utility_score": f"SELECT id, coalesce(recalls, 0) AS recalls, coalesce(last_recall, -1) AS last_recall, round(utility, 6) AS utility FROM {_USED}",
    "cap_eviction": f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY utility, id) AS r, count(*) OVER () AS n FROM {_USED}) WHERE r <= n - 150",
    "idempotent_ingest": f"WITH RECURSIVE e AS (SELECT user_id AS idem_key, epoch_us(ts) // 1000000 AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events), f AS (SELECT idem_key , t, seq, n, TRUE AS accepted, seq AS original, t AS since FROM e WHERE n = 1 UNION ALL SELECT e.idem_key, e.t, e.seq, e.n, e.t - f.since >= {5 * 86400}, CASE WHEN e.t - f.since >= {5 * 86400} THEN e.seq ELSE f.original END, CASE WHEN e.t - f.since >= {5 * 86400} THEN e.t ELSE f.since END FROM f JOIN e ON e.idem_key = f.idem_key AND e.n = f.n + 1) SELECT idem_key, seq, accepted, original FROM f",
}
