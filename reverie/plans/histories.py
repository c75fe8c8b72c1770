"""Queries on traces, registries, replays, documents, caches, sessions and the change feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reverie.functions.scalars import micros
from reverie.operators import histories as h
from reverie.operators import retrieval as r
from reverie.plans.recall import bm25_sql, near_sql, top_sql
from reverie.plans.stand_ins import BORN, INVOCATIONS, NOW, PUTS, SPANS, invocations, puts, spans
from reverie.sources.scratch import folder as _scratch
from reverie.sources.tables import table
from reverie.streaming import changes as c


def _spans(s, d):
    return h.current_spans(spans(s, d)).where("span_id is not null")


def _closed(s, d):
    closings = table(s, d, "conversations").where("turn % 5 = 4").select((F.col("conv_id") * 1000 + F.col("turn")).alias("span_id"), (F.lit(BORN) + F.col("conv_id") * 100 + F.col("turn") + 9).alias("end"), F.lit("closed").alias("status"), F.col("turn").alias("seq"))
    return h.close_spans(_spans(s, d), closings)


def _numbered(s, d):
    return h.versions(puts(s, d))


def _deleted(s, d):
    return _numbered(s, d).where("version % 4 = 0 or name = 'src2'").select("name", "version")


def _live(s, d):
    return h.live_versions(_numbered(s, d), _deleted(s, d))


def _tag_events(s, d):
    n = _numbered(s, d)
    put = n.where("version % 7 = 1").select("name", F.lit("prod").alias("tag"), F.col("version"), F.col("seq"))
    gone = n.where("version = 7 and name < 'src15'").select("name", F.lit("prod").alias("tag"), F.lit(None).cast("int").alias("version"), (F.col("seq") + 10_000_000).alias("seq"))
    beta = n.where("version % 5 = 1").select("name", F.lit("beta").alias("tag"), "version", "seq")
    return put.unionByName(gone).unionByName(beta)


_LIVE = f"(SELECT * FROM {PUTS} WHERE NOT (version % 4 = 0 OR name = 'src2'))"
_TAGS = f"(SELECT name, tag, version FROM (SELECT name, tag, arg_max(struct_pack(v := version), seq).v AS version FROM (SELECT name, 'prod' AS tag, version, seq FROM {PUTS} WHERE version % 7 = 1 UNION ALL SELECT name, 'prod', NULL, seq + 10000000 FROM {PUTS} WHERE version = 7 AND name < 'src15' UNION ALL SELECT name, 'beta', version, seq FROM {PUTS} WHERE version % 5 = 1) GROUP BY name, tag) WHERE version IS NOT NULL AND (name, version) IN (SELECT (name, version) FROM {_LIVE}))"


def _overrides(s, d):
    i = h.captured(invocations(s, d))
    act = F.element_at(F.array(*map(F.lit, ("model", "prompt", "output", "skip"))), (F.pmod("trace_id", F.lit(4)) + 1).cast("int"))
    one = i.where("idx = trace_id % 3").select(F.concat(F.lit("run"), F.col("trace_id").cast("string")).alias("run_id"), "trace_id", F.col("idx").alias("at_idx"), act.alias("action"), F.concat(F.lit("new"), F.col("idx").cast("string")).alias("value"), F.lit(1).alias("seq"))
    return one.unionByName(one.withColumn("action", F.lit("skip")).withColumn("seq", F.lit(2)))


_OVERRIDES = f"(SELECT 'run' || trace_id AS run_id, trace_id, idx, ['model', 'prompt', 'output', 'skip'][trace_id % 4 + 1] AS action, 'new' || idx AS value FROM {INVOCATIONS} WHERE idx = trace_id % 3)"


def _outputs(s, d):
    return h.captured(invocations(s, d)).where("idx % 3 <> 2").select(F.concat(F.lit("run"), F.col("trace_id").cast("string")).alias("run_id"), "trace_id", "idx", F.when(F.col("idx") % 3 == 1, F.concat(F.lit("x"), F.col("output"))).otherwise(F.col("output")).alias("output"))


def _documents(s, d):
    """Pages and documents as ingested files; every third document comes twice."""
    docs = table(s, d, "documents").select(F.concat(F.lit("file:///"), F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string")).alias("uri"), F.lit("text/plain").alias("content_type"), "text", F.col("doc_id").alias("seq"))
    pages = table(s, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("uri"), F.lit("text/html").alias("content_type"), F.col("html").alias("text"), F.col("page_id").alias("seq"))
    return docs.unionByName(pages)


_DOCS = "(SELECT uri, md5(uri) AS doc_id, count(*) AS version, arg_max(text, seq) AS text FROM (SELECT 'file:///' || source || '/' || (doc_id // 3) AS uri, text, doc_id AS seq FROM documents UNION ALL SELECT 'page:' || page_id, html, page_id FROM pages) GROUP BY uri)"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CHUNKS = f"(SELECT doc_id, uri, version, i AS chunk_index, trim(substr(t, i * 700 + 1, 800), {_WS}) AS text FROM (SELECT doc_id, uri, version, t, unnest(range(CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 800 THEN 1 ELSE ceil((length(t) - 800) / 700.0)::BIGINT + 1 END)) AS i FROM (SELECT *, trim(text, {_WS}) AS t FROM {_DOCS})))"


def doc_search(s, d):
    """The five best chunks for a query, with their citation."""
    rows = h.chunks(h.current_documents(_documents(s, d))).withColumn("id", F.concat_ws("#", "doc_id", F.lpad(F.col("chunk_index").cast("string"), 6, "0")))
    hits = r.top(r.bm25(rows, "the of and with"), 5)
    return rows.join(F.broadcast(hits), "id").select("uri", "version", "chunk_index", F.round("score", 6).alias("score"))


def _cache(s, d):
    e = table(s, d, "embeddings")
    return h.cached(e.select(F.concat(F.lit("tool"), (F.col("vec_id") % 7).cast("string")).alias("tool"), F.col("vec_id").alias("args_hash"), "embedding", F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("result"), (F.lit(NOW) - F.col("vec_id") % 500 * 10).alias("stored_at"), F.lit(3000).alias("ttl"), F.col("vec_id").alias("seq")))


def _lookups(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("lookup_id"), F.concat(F.lit("tool"), (F.col("label") % 7).cast("string")).alias("tool"), (F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 0).otherwise(1_000_000_000)).alias("args_hash"), "embedding")


_COS = "list_dot_product(l.embedding::DOUBLE[], c.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(l.embedding::DOUBLE[], l.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 1.1920929e-07)"
_LOOK = f"(SELECT l.vec_id AS lookup_id, (l.vec_id % 2 = 0 AND l.vec_id = c.vec_id) AS exact, CASE WHEN l.vec_id % 2 = 0 AND l.vec_id = c.vec_id THEN 1.0 ELSE round({_COS}, 9) END AS similarity, 'r' || c.vec_id AS result, c.vec_id AS hash FROM embeddings l LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 500 * 10 < 3000) c ON l.label % 7 = c.vec_id % 7)"


def _session_events(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("session_id"), F.floor(micros(F.col("ts")) / 1_000_000).alias("at"), F.col("props").alias("data"), F.col("event_id").alias("seq"))


def _changes(s, d):
    return c.event_stream(s, f"{d}/events.parquet")


def windowed_events(s, d):
    out = c.run_to_end(c.windowed(_changes(s, d), "1 day"), _scratch(s), _scratch(s))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "table", "n", F.round("total", 2).alias("total"))


def calls(s, d):
    rows = table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("principal"), "event_type", "event_id")
    required = s.createDataFrame([("click", "read"), ("view", "read"), ("signup", "write"), ("purchase", "admin")], "command string, needs string")
    grants = s.createDataFrame([("u0", "admin"), ("u1", "write"), ("u2", "read"), ("u3", "write")], "principal string, role string")
    return h.authorised(rows.withColumnRenamed("event_type", "command"), grants, required).groupBy("principal", "command", "allowed").agg(F.count("*").alias("n"))


def permissions(s, d):
    """What each role may do, over the commands that event types stand for."""
    commands = F.element_at(F.array(*map(F.lit, ("REMEMBER", "RECALL", "EVAL.SCORE", "PROMPT.DELETE", "INFO"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 6).cast("string")).alias("principal"), commands.alias("command"))
    grants = s.createDataFrame([("u0", "Owner"), ("u1", "service"), ("u2", "evaluator"), ("u3", "viewer"), ("u4", "strange")], "principal string, role string")
    return h.permitted(rows, grants, ("RECALL",)).groupBy("principal", "command", "allowed").agg(F.count("*").alias("n"))


_SPAN_COLUMNS = ["span_id", "trace_id", "parent_id", "name", "status"]
_no_null = lambda df, *cols: df.select(*[F.coalesce(x, F.lit(-1)).alias(x) if x in ("parent_id", "end", "duration") else F.col(x) for x in cols])

QUERIES = {
    "trace_spans": lambda s, d: _no_null(_spans(s, d), *_SPAN_COLUMNS),
    "trace_close": lambda s, d: _no_null(_closed(s, d).withColumn("duration", h.duration(F.col("start"), F.col("end"))), "span_id", "status", "duration"),
    "trace_get": lambda s, d: _spans(s, d).where("trace_id = 3").select("span_id", "name", F.row_number().over(Window.partitionBy("trace_id").orderBy("first_seq")).alias("place")),
    "trace_subtree": lambda s, d: h.subtrees(_spans(s, d), _spans(s, d).where("span_id % 1000 in (0, 1)")),
    "trace_thread": lambda s, d: h.thread_of(_spans(s, d), 4).select("trace_id", "span_id", "place"),
    "trace_search": lambda s, d: h.search_spans(_spans(s, d), prefix="user.", since=BORN + 100, until=BORN + 5000, status="ok", kind="user").select("span_id", "name", "start"),
    "trace_counts": lambda s, d: h.trace_counts(_spans(s, d)),
    "prompt_versions": lambda s, d: _live(s, d).select("name", "version", F.md5(F.col("content").cast("binary")).alias("digest")),
    "prompt_latest": lambda s, d: h.latest(_live(s, d)).select("name", "version", F.md5(F.col("content").cast("binary")).alias("digest")),
    "prompt_tags": lambda s, d: h.current_tags(_tag_events(s, d), _live(s, d)).select("name", "tag", "version"),
    "prompt_by_tag": lambda s, d: h.by_tag(_live(s, d), h.current_tags(_tag_events(s, d), _live(s, d)), "prod").select("name", "version", "split"),
    "prompt_names": lambda s, d: h.names(_numbered(s, d), s.createDataFrame([("draft",), ("src1",)], "name string")),
    "prompt_stats": lambda s, d: _live(s, d).agg(F.countDistinct("name").alias("names"), F.count("*").alias("versions")),
    "prompt_search": lambda s, d: r.top(_live(s, d).select(F.concat_ws("@", "name", F.lpad(F.col("version").cast("string"), 6, "0")).alias("id"), F.least(F.greatest(F.round(r.cosine(r.hash_embedding(F.col("content"), 32), F.array(*map(F.lit, r.hash_query("the of and with", 32)))), 6), F.lit(0.0)), F.lit(1.0)).alias("score")), 10),
    "prompt_diff_lines": lambda s, d: (lambda v: v.alias("a").join(v.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.version") + 1 == F.col("b.version"))).select(F.col("a.name").alias("name"), F.col("a.version").alias("version"), F.size(h.line_changes(F.col("a.content"), F.col("b.content"))[0]).alias("removed"), F.size(h.line_changes(F.col("a.content"), F.col("b.content"))[1]).alias("added")))(_numbered(s, d)),
    "prompt_diff": lambda s, d: (lambda v: v.alias("a").join(v.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.version") + 1 == F.col("b.version"))).select(F.col("a.name").alias("name"), F.col("a.version").alias("version"), h.diff_column(F.col("a.content"), F.col("b.content")).alias("diff")))(_numbered(s, d)),
    "dataset_sizes": lambda s, d: h.split_sizes(puts(s, d)),
    "dataset_splits": lambda s, d: puts(s, d).select("name", "split").distinct(),
    "dataset_sample": lambda s, d: h.sample_rows(puts(s, d).where("name = 'src5'"), 5, "seq", "eval").select("name", "seq", "split"),
    "dataset_from_recall": lambda s, d: (lambda docs: docs.join(F.broadcast(r.top(r.bm25(docs.withColumnRenamed("doc_id", "id"), "the of and with"), 20)), F.col("doc_id") == F.col("id")).select(F.col("doc_id").alias("memory_id"), F.lit("recalled").alias("name"), F.lit(1).alias("version"), F.to_json(F.struct(F.lit("recall").alias("source"), F.col("doc_id").alias("memory_id"), F.col("source").alias("key"))).alias("annotations")))(table(s, d, "documents")),
    "replay_capture": lambda s, d: h.captured(invocations(s, d)).select("trace_id", "seq", "idx", "model"),
    "replay_fingerprint": lambda s, d: h.fingerprints(h.captured(invocations(s, d))),
    "replay_plan": lambda s, d: h.replay_plan(h.captured(invocations(s, d)), _overrides(s, d)).select("run_id", "trace_id", "idx", "model", "input", F.coalesce("recorded", F.lit("-")).alias("recorded"), "executes"),
    "replay_diff": lambda s, d: h.replay_diff(h.captured(invocations(s, d)), _outputs(s, d)).select("trace_id", "idx", "differs"),
    "replay_stats": lambda s, d: h.captured(invocations(s, d)).agg(F.countDistinct("trace_id").alias("sessions"), F.count("*").alias("invocations")),
    "doc_versions": lambda s, d: h.current_documents(_documents(s, d)).select("uri", "doc_id", "version", F.md5(F.col("text").cast("binary")).alias("digest")),
    "doc_chunks": lambda s, d: h.chunks(h.current_documents(_documents(s, d))).select("doc_id", "version", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest")),
    "doc_search_cite": doc_search,
    "tool_cache_live": lambda s, d: _cache(s, d).withColumn("fresh", h.fresh(NOW)).groupBy("tool", "fresh").agg(F.count("*").alias("n")),
    "tool_cache_lookup": lambda s, d: h.cache_lookup(_cache(s, d), _lookups(s, d), NOW).select("lookup_id", "outcome", F.coalesce(F.round("similarity", 6), F.lit(-1.0)).alias("similarity"), F.coalesce("result", F.lit("-")).alias("result")),
    "sliding_ttl_sessions": lambda s, d: h.sessions(_session_events(s, d), 12 * 3600),
    "session_state": lambda s, d: h.session_state(_session_events(s, d), BORN + 25 * 86_400, 86_400),
    "chat_history": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select("conv_id", F.size("m").alias("n"), F.md5(F.concat_ws("|", F.transform("m", lambda x: F.concat_ws(":", x["role"], x["text"]))).cast("binary")).alias("digest")),
    "changes_by_channel": lambda s, d: c.run_to_files(c.subscribed(_changes(s, d), pattern="p*.u1?"), _scratch(s), _scratch(s)).select("row_id", "table", "key", "kind"),
    "changes_by_table": lambda s, d: c.run_to_files(c.subscribed(_changes(s, d), exact="signup"), _scratch(s), _scratch(s)).select("row_id", "kind"),
    "changes_once": lambda s, d: c.run_to_files(c.once(_changes(s, d), "60 days", "key", "table"), _scratch(s), _scratch(s)).select("key", "table"),
    "windowed_events": windowed_events,
    "session_windows": lambda s, d: c.run_to_end(c.session_windows(_changes(s, d), "12 hours"), _scratch(s), _scratch(s)).select("key", F.unix_micros("opened").alias("opened"), "n"),
    "alert_transitions": lambda s, d: c.run_to_files(c.alert_transitions(_changes(s, d), 1000.0, 0.8), _scratch(s), _scratch(s)).select("key", "status"),
    "authorised_calls": calls,
    "permitted_commands": permissions,
    "tool_cache_purge": lambda s, d: h.expired_entries(_cache(s, d), NOW),
}

_PAIRS = f"{PUTS} a JOIN {PUTS} b ON a.name = b.name AND a.version + 1 = b.version"
SQL = {
    "tool_cache_purge": "SELECT 'tool' || (vec_id % 7) AS tool, vec_id AS args_hash FROM embeddings WHERE vec_id % 500 * 10 >= 3000",
    "permitted_commands": "SELECT principal, command, command = 'INFO' OR p = 0 OR (p = 1 AND command <> 'PROMPT.DELETE') OR (p = 2 AND command IN ('RECALL', 'EVAL.SCORE')) OR (p IN (3, 4) AND command = 'RECALL') AS allowed, count(*) AS n FROM (SELECT user_id % 6 AS p, 'u' || (user_id % 6) AS principal, ['REMEMBER', 'RECALL', 'EVAL.SCORE', 'PROMPT.DELETE', 'INFO'][event_id % 5 + 1] AS command FROM events) GROUP BY ALL",
    "trace_spans": f"SELECT span_id, trace_id, coalesce(parent_id, -1) AS parent_id, name, status FROM {SPANS}",
    "trace_close": f"SELECT span_id, CASE WHEN \"end\" IS NULL THEN 'closed' ELSE status END AS status, greatest(coalesce(\"end\", start + 9) - start, 0) AS duration FROM {SPANS}",
    "trace_get": f"SELECT span_id, name, row_number() OVER (ORDER BY seq) AS place FROM {SPANS} WHERE trace_id = 3",
    "trace_subtree": f"WITH RECURSIVE s AS (SELECT * FROM {SPANS}), t AS (SELECT span_id AS root, span_id, trace_id, 0 AS depth, [seq] AS path FROM s WHERE span_id % 1000 IN (0, 1) UNION ALL SELECT t.root, s.span_id, s.trace_id, t.depth + 1, list_append(t.path, s.seq) FROM t JOIN s ON s.parent_id = t.span_id AND s.trace_id = t.trace_id) SELECT root, span_id, depth, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM t",
    "trace_thread": f"SELECT trace_id, span_id, row_number() OVER (ORDER BY first, seq) AS place FROM (SELECT *, min(seq) OVER (PARTITION BY trace_id) AS first FROM {SPANS} WHERE thread_id = 4)",
    "prompt_search": f"SELECT id, score FROM (SELECT id, least(greatest(round(score, 6), 0), 1) AS score FROM {near_sql(f"(SELECT name || '@' || lpad(version::VARCHAR, 6, '0') AS id, content AS text FROM {_LIVE})")}) ORDER BY score DESC, id LIMIT 10",
    "dataset_from_recall": f"SELECT doc_id AS memory_id, 'recalled' AS name, 1 AS version, '{{\"source\":\"recall\",\"memory_id\":' || doc_id || ',\"key\":\"' || source || '\"}}' AS annotations FROM documents JOIN {top_sql(bm25_sql('(SELECT doc_id AS id, text FROM documents)'), 20)} h ON h.id = doc_id",
    "doc_search_cite": f"SELECT c.uri, c.version, c.chunk_index, round(h.score, 6) AS score FROM {top_sql(bm25_sql(f"(SELECT doc_id || '#' || lpad(chunk_index::VARCHAR, 6, '0') AS id, text FROM {_CHUNKS})"), 5)} h JOIN {_CHUNKS} c ON h.id = c.doc_id || '#' || lpad(c.chunk_index::VARCHAR, 6, '0')",
    "trace_search": f"SELECT span_id, name, start FROM {SPANS} WHERE name LIKE 'user.%' AND start >= {BORN + 100} AND start < {BORN + 5000} AND status = 'ok' AND kind = 'user'",
    "trace_counts": f"SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT thread_id) AS threads FROM {SPANS}",
    "prompt_versions": f"SELECT name, version, md5(content) AS digest FROM {_LIVE}",
    "prompt_latest": f"SELECT name, max(version) AS version, md5(arg_max(content, version)) AS digest FROM {_LIVE} GROUP BY name",
    "prompt_tags": f"SELECT name, tag, version FROM {_TAGS}",
    "prompt_by_tag": f"SELECT l.name, l.version, l.split FROM {_LIVE} l JOIN {_TAGS} t ON l.name = t.name AND l.version = t.version WHERE t.tag = 'prod'",
    "prompt_names": f"SELECT name FROM {PUTS} UNION SELECT 'draft' UNION SELECT 'src1'",
    "prompt_stats": f"SELECT count(DISTINCT name) AS names, count(*) AS versions FROM {_LIVE}",
    "prompt_diff_lines": f"SELECT a.name, a.version, len(list_distinct(list_filter(string_split(a.content, chr(10)), lambda x: NOT list_contains(string_split(b.content, chr(10)), x)))) AS removed, len(list_distinct(list_filter(string_split(b.content, chr(10)), lambda x: NOT list_contains(string_split(a.content, chr(10)), x)))) AS added FROM {_PAIRS}",
    "dataset_sizes": f"SELECT split, count(*) AS n FROM {PUTS} GROUP BY split",
    "dataset_splits": f"SELECT DISTINCT name, split FROM {PUTS}",
    "dataset_sample": f"SELECT name, seq, split FROM {PUTS} WHERE name = 'src5' AND split = 'eval' ORDER BY seq LIMIT 5",
    "replay_capture": f"SELECT trace_id, seq, idx, model FROM {INVOCATIONS}",
    "replay_fingerprint": f"SELECT trace_id, n, lower(printf('%08x', (h // 4294967296)::BIGINT) || printf('%08x', (h % 4294967296)::BIGINT)) AS fingerprint FROM (SELECT trace_id, n, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(x) + 1), lambda i: ('0x' || substr(hex(x), 2 * i - 1, 2))::HUGEINT)), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616) AS h FROM (SELECT trace_id, count(*) AS n, encode(string_agg(coalesce(input, '') || kind || coalesce(model, ''), '' ORDER BY idx)) AS x FROM {INVOCATIONS} GROUP BY trace_id))",
    "replay_plan": f"SELECT r.run_id, i.trace_id, i.idx, CASE WHEN o.action = 'model' THEN o.value ELSE i.model END AS model, CASE WHEN o.action = 'prompt' THEN o.value ELSE i.input END AS input, CASE WHEN o.action = 'output' THEN o.value WHEN o.action = 'skip' THEN 'null' ELSE '-' END AS recorded, coalesce(o.action NOT IN ('output', 'skip'), TRUE) AS executes FROM (SELECT DISTINCT run_id, trace_id FROM {_OVERRIDES}) r JOIN {INVOCATIONS} i USING (trace_id) LEFT JOIN {_OVERRIDES} o ON o.trace_id = i.trace_id AND o.idx = i.idx",
    "replay_diff": f"SELECT trace_id, idx, CASE WHEN idx % 3 = 2 THEN output IS NOT NULL WHEN idx % 3 = 1 THEN output IS NOT NULL ELSE FALSE END AS differs FROM {INVOCATIONS}",
    "replay_stats": f"SELECT count(DISTINCT trace_id) AS sessions, count(*) AS invocations FROM {INVOCATIONS}",
    "doc_versions": f"SELECT uri, doc_id, version, md5(text) AS digest FROM {_DOCS}",
    "doc_chunks": f"SELECT doc_id, version, chunk_index, md5(text) AS digest FROM {_CHUNKS}",
    "tool_cache_live": f"SELECT 'tool' || (vec_id % 7) AS tool, vec_id % 500 * 10 < 3000 AS fresh, count(*) AS n FROM embeddings GROUP BY 1, 2",
    "tool_cache_lookup": f"SELECT lookup_id, CASE WHEN exact THEN 'exact' WHEN similarity >= 0.95 THEN 'near' ELSE 'miss' END AS outcome, CASE WHEN exact OR similarity >= 0.95 THEN round(similarity, 6) ELSE -1.0 END AS similarity, CASE WHEN exact OR similarity >= 0.95 THEN result ELSE '-' END AS result FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY exact DESC, similarity DESC, hash) AS n FROM {_LOOK}) WHERE n = 1",
    "sliding_ttl_sessions": "SELECT session_id, session, min(t) AS opened, max(t) AS last_access, count(*) AS accesses FROM (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT session_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t) < 43200 THEN 0 ELSE 1 END AS opens FROM (SELECT user_id AS session_id, epoch_us(ts) // 1000000 AS t FROM events))) GROUP BY 1, 2",
    "session_state": f"SELECT session_id, max(t) AS last_access, arg_max(data, struct_pack(a := t, b := seq)) AS data, {BORN + 25 * 86_400} - max(t) >= 86400 AS expired FROM (SELECT user_id AS session_id, epoch_us(ts) // 1000000 AS t, props AS data, event_id AS seq FROM events) GROUP BY session_id",
    "chat_history": "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "changes_by_channel": "SELECT event_id AS row_id, event_type AS \"table\", 'u' || user_id AS key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'update' ELSE 'insert' END AS kind FROM events WHERE regexp_full_match(event_type || '.u' || user_id, 'p.*\\.u1.')",
    "changes_by_table": "SELECT event_id AS row_id, 'insert' AS kind FROM events WHERE event_type = 'signup'",
    "changes_once": "SELECT DISTINCT 'u' || user_id AS key, event_type AS \"table\" FROM events",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS \"table\", count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "session_windows": "SELECT 'u' || user_id AS key, min(t) AS opened, count(*) AS n FROM (SELECT user_id, t, sum(o) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, g",
    "alert_transitions": "SELECT key, status FROM (SELECT *, lag(status, 1, 'ok') OVER (PARTITION BY key ORDER BY ts, event_id) AS prev FROM (SELECT 'u' || user_id AS key, ts, event_id, CASE WHEN s >= 1000 THEN 'exceeded' WHEN s >= 800 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events))) WHERE status <> prev",
    "authorised_calls": "SELECT principal, command, level >= needs AS allowed, count(*) AS n FROM (SELECT 'u' || (user_id % 5) AS principal, event_type AS command, [3, 2, 1, 2, 0][user_id % 5 + 1] AS level, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 3 END AS needs FROM events) GROUP BY ALL",
}
