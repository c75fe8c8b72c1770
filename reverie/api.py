"""A store of agent state on Parquet folders: one method per command, each a few operators.

Every write appends rows with a sequence number to a table below ``root``;
reads fold the tables. Methods return DataFrames, except where a command's answer is one value.
One writer at a time is assumed; readers need no lock.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.operators import histories as h
from reverie.operators import ledgers as o
from reverie.operators import memory as m
from reverie.operators import retrieval as r
from reverie.operators import services as v
from reverie.sources import tables as t

SCHEMAS = {
    "memory": "id long, key string, text string, importance double, created_at double, kind string, tags array<string>, embedding array<double>, n_terms long",
    "postings": "bucket int, term string, id long, f long",
    "forgotten": "id long, key string",
    "id_marks": "id long",
    "recalls": "id long, at double",
    "idempotency": "idem_key string, id long, at double",
    "sessions": "session_id string, at double, ttl double, data string, seq long",
    "tool_cache": "tool string, args_hash long, embedding array<double>, result string, stored_at double, ttl double, seq long",
    "spans": "trace_id string, span_id string, parent_id string, thread_id string, name string, kind string, start double, end double, status string, attributes string, seq long",
    "closings": "span_id string, end double, status string, seq long",
    "prompts": "name string, content string, metadata string, seq long",
    "datasets": "name string, content string, metadata string, seq long",
    "dataset_rows": "name string, put_seq long, place int, id string, text string, data string, split string, annotations string",
    "dataset_schemas": "name string, schema string, seq long",
    "deletions": "registry string, name string, version int",
    "tags": "registry string, name string, tag string, version int, seq long",
    "runs": "run_id string, name string, dataset string, model string, scorer string, metadata string, seq long",
    "run_events": "run_id string, kind string, reason string, seq long",
    "scores": "run_id string, row_id string, score double, output string, notes string, seq long",
    "invocations": "trace_id string, kind string, model string, input string, output string, seq long",
    "replays": "run_id string, trace_id string, mode string, metadata string, seq long",
    "replay_overrides": "run_id string, trace_id string, at_idx int, action string, value string, seq long",
    "replay_outputs": "run_id string, trace_id string, idx int, output string, seq long",
    "replay_events": "run_id string, kind string, reason string, seq long",
    "replay_traces": "run_id string, replay_trace_id string, seq long",
    "summaries": "run_id string, n long, mean double, p50 double, p90 double, p99 double, lowest double, highest double, pass_rate double",
    "kv": "key string, value string, seq long",
    "spend": "id string, tenant string, model string, prompt_name string, tokens_in long, tokens_out long, cost_usd double, input_text string, metadata string, recorded_at double, seq long",
    "budgets": "tenant string, period string, amount double, warn_pct double, deleted boolean, seq long",
    "documents": "uri string, content_type string, text string, seq long",
    "removed_documents": "uri string, seq long",
    "changes": "table string, key string, row_id string, kind string, at double",
    "audit": "principal string, tenant string, command string, outcome string, at double, seq long",
}


#: Tables that are rewritten together, by the name of their generation.
GENERATIONS = {"memory": ("memory", "postings", "forgotten"), "sessions": ("sessions",), "tool_cache": ("tool_cache",), "idempotency": ("idempotency",)}
_GROUP = {table: group for group, tables in GENERATIONS.items() for table in tables}


class Store:
    """``retention`` (seconds) and ``cap`` (rows) are kept to after each write; ``auto_compact`` rewrites the memory when enough of it is removed."""

    def __init__(self, spark: SparkSession, root: str, *, embedder: str = "hash:32", clock: Callable[[], float] = time.time, retention: float | None = None, cap: int | None = None, half_life: float = m.HALF_LIFE, auto_compact: bool = True) -> None:
        self.spark, self.root, self.spec, self.clock = spark, root.rstrip("/"), embedder, clock
        self.retention, self.cap, self.half_life, self.auto_compact = retention, cap, half_life, auto_compact
        r.embedder(embedder)
        self.dim = int(embedder.partition(":")[2])
        self._last = 0

    # --- tables ---

    def _generation(self, group: str) -> int:
        """How often a group of tables was rewritten: the last of its marks, which are empty files."""
        where, fs = t._files(self.spark, f"{self.root}/generations")
        if not fs.exists(where):
            return 0
        names = [str(x.getPath().getName()) for x in fs.listStatus(where)]
        return max((int(n.rpartition(".")[2]) for n in names if n.startswith(group + ".")), default=0)

    def _folder(self, name: str, generation: int | None = None) -> str:
        if name not in _GROUP:
            return f"{self.root}/{name}"
        generation = self._generation(_GROUP[name]) if generation is None else generation
        return f"{self.root}/{name}-{generation}" if generation else f"{self.root}/{name}"

    def _rewrite(self, group: str, fresh: Mapping[str, DataFrame]) -> None:
        """Puts new contents in the place of a group's tables; those that are not given become empty.

        They are written to new folders first. One new file is the switch, so that a crash
        leaves either the old tables or the new ones; what is left over is removed by the next rewrite.
        """
        before = self._generation(group)
        for name in GENERATIONS[group]:
            where, fs = t._files(self.spark, self._folder(name, before + 1))
            fs.delete(where, True)
        for name, rows in fresh.items():
            self._save(name, rows, self._folder(name, before + 1))
        where, fs = t._files(self.spark, f"{self.root}/generations/{group}.{before + 1:09d}")
        fs.mkdirs(where.getParent())
        fs.createNewFile(where)
        for name in GENERATIONS[group]:
            fs.delete(t._files(self.spark, self._folder(name, before))[0], True)

    def read(self, name: str) -> DataFrame:
        where, fs = t._files(self.spark, self._folder(name))
        return self.spark.read.schema(SCHEMAS[name]).parquet(str(where)) if fs.exists(where) else self.spark.createDataFrame([], SCHEMAS[name])

    def _save(self, name: str, df: DataFrame, path: str) -> None:
        t.append(df, path, ["bucket"] if name == "postings" else None)

    def _write(self, name: str, rows: Iterable[tuple] | DataFrame) -> None:
        self._save(name, rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), SCHEMAS[name]), self._folder(name))

    def _seq(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _changed(self, table: str, key: str | None, row_id, kind: str) -> None:
        self._write("changes", [(table, key, str(row_id), kind, self.clock())])

    def changes(self, channel: str | None = None, pattern: str | None = None) -> DataFrame:
        """SUBSCRIBE and PSUBSCRIBE as a stream over the change table."""
        return h.subscribed(self.spark.readStream.schema(SCHEMAS["changes"]).parquet(f"{self.root}/changes"), exact=channel, pattern=pattern)

    def info(self) -> DataFrame:
        return v.info({name: self.read(name) for name in SCHEMAS})

    # --- memory ---

    def memory(self) -> DataFrame:
        return m.live(self.read("memory"), self.read("forgotten"))

    def _last_id(self) -> int:
        """The largest id ever given; compaction leaves a mark of it."""
        return self.read("memory").select("id").union(self.read("id_marks")).agg(F.max("id")).first()[0] or 0

    def remember(self, key: str, text: str, *, importance: float = 1.0, kind: str | None = None, tags: Iterable[str] = (), embedding: list[float] | None = None) -> int:
        return self.remember_batch([(key, text)], importance=importance, kind=kind, tags=tags, embeddings=None if embedding is None else [embedding])[0]

    def remember_batch(self, items: Iterable[tuple[str, str]], *, importance: float = 1.0, kind: str | None = None, tags: Iterable[str] = (), embeddings: list[list[float]] | None = None) -> list[int]:
        """The ids given. Vectors are the embedder's unless they are given, with its dimension."""
        items, tags, now = list(items), list(tags), self.clock()
        vectors = [self._vector(x) for _, x in items] if embeddings is None else [list(map(float, v)) for v in embeddings]
        if len(vectors) != len(items) or any(len(v) != self.dim for v in vectors):
            raise ValueError(f"each item needs a vector of {self.dim} components")
        if not items:
            return []
        last = self._last_id()
        ids = list(range(last + 1, last + 1 + len(items)))
        rows = self.spark.createDataFrame([(i, k, x, float(importance), float(now), kind, tags, v) for i, (k, x), v in zip(ids, items, vectors, strict=True)], SCHEMAS["memory"].rpartition(",")[0])
        self._remember(rows)
        self._write("changes", [("memory", k, str(i), "insert", now) for i, (k, _) in zip(ids, items, strict=True)])
        self._maintain()
        return ids

    def remember_frame(self, batch: DataFrame, order: str) -> None:
        """A bulk write of ``key, text`` (and importance, kind, tags) with ids in the order of a column."""
        rows = m.remember(self._last_id(), batch, F.col(order), self.clock())
        self._remember(rows.withColumn("embedding", r.embedder(self.spec)[0](F.col("text"))))
        self._maintain()

    def _remember(self, rows: DataFrame) -> None:
        """Terms first: postings without a row are never seen, a row without postings would not be found."""
        rows = rows.withColumn("n_terms", r.term_total(F.col("text")))
        self._write("postings", r.text_index(rows))
        self._write("memory", rows)

    def _maintain(self) -> None:
        """What a write is followed by: retention, then the cap, then compaction if enough is removed."""
        if self.retention is not None:
            self.forget_older(self.retention)
        if self.cap is not None and self.memory().count() > self.cap:
            self.evict(self.cap, self.half_life)
        if self.auto_compact and not self.read("forgotten").isEmpty() and self.tombstones().first()["compact"]:
            self.compact()

    def remember_idempotent(self, idem_key: str, key: str, text: str, ttl: float = m.IDEMPOTENCY_SECONDS) -> int:
        now = self.clock()
        known = self.read("idempotency").where((F.col("idem_key") == idem_key) & (F.lit(now) - F.col("at") < ttl)).orderBy(F.col("at").desc()).first()
        if known:
            return known["id"]
        i = self.remember(key, text)
        self._write("idempotency", [(idem_key, i, now)])
        return i

    def recall(self, query: str, *, k: int = 10, key: str | None = None, filter_json: str | None = None, reinforce: bool = True) -> DataFrame:
        given = v.within(v.filter_arguments(filter_json), self.clock()) if filter_json else {}
        given = {name: given[name] for name in given if name in ("kind", "tags_any", "min_created", "max_created")}
        condition = r.recall_filter(**given) if given else None
        hits = self.spark.createDataFrame(m.recall(self.memory(), query, k=k, key=key, filtered=condition, spec=self.spec, vec_col="embedding", index=self.read("postings")).collect(), f"{SCHEMAS['memory']}, score double")
        if reinforce:
            self._write("recalls", m.reinforcement(hits, self.clock()))
        return r.top(hits, k)

    def recall_decayed(self, query: str, half_life: float, k: int = 10) -> DataFrame:
        return m.recall_decayed(self.memory(), query, self.clock(), half_life, k=k, spec=self.spec, vec_col="embedding", index=self.read("postings"))

    def scan(self, after: int = 0, count: int = 10) -> DataFrame:
        return m.scan(self.memory(), after, count)

    def _forget(self, gone: DataFrame) -> int:
        rows = gone.select("id", "key").collect()
        if rows:
            self._write("forgotten", [tuple(x) for x in rows])
            self._write("changes", [("memory", x["key"], str(x["id"]), "delete", self.clock()) for x in rows])
        return len(rows)

    def forget(self, id_: int) -> int:
        return self._forget(self.memory().where(F.col("id") == id_))

    def forget_key(self, key: str) -> int:
        return self._forget(m.forget_key(self.memory(), key))

    def forget_older(self, seconds: float) -> int:
        return self._forget(m.forget_older(self.memory(), self.clock(), seconds))

    def evict(self, cap: int, half_life: float = m.HALF_LIFE) -> int:
        rows = self.memory()
        return self._forget(rows.join(F.broadcast(m.evict(rows, self.read("recalls"), cap, self.clock(), half_life)), "id", "left_semi"))

    def tombstones(self) -> DataFrame:
        return m.tombstone_ratio(self.read("memory"), self.read("forgotten"))

    def compact(self) -> int:
        """Rewrites the memory and its text index without removed rows; returns how many were reclaimed."""
        state = self.tombstones().first()
        if state["indexed"] == state["live"]:
            return 0
        self._write("id_marks", [(self._last_id(),)])
        rows = self.memory()
        self._rewrite("memory", {"memory": rows, "postings": self.read("postings").join(rows.select("id"), "id", "left_semi").select("bucket", "term", "id", "f")})
        return state["indexed"] - state["live"]

    def purge_idempotency(self, ttl: float = m.IDEMPOTENCY_SECONDS) -> int:
        """Forgets keys whose time is over; returns how many rows went."""
        return self._purge("idempotency", F.lit(self.clock()) - F.col("at") >= ttl)

    def _purge(self, name: str, gone) -> int:
        rows = self.read(name)
        n = rows.where(gone).count()
        if n:
            self._rewrite(name, {name: rows.where(~gone)})
        return n

    # --- key-value ---

    def kv_put(self, key: str, value: str) -> None:
        self._write("kv", [(key, value, self._seq())])

    def kv_batch(self, changes: Mapping[str, str | None]) -> None:
        """Puts and, for null values, deletions in one commit."""
        self._write("kv", [(k, x, self._seq()) for k, x in changes.items()])

    def kv_get(self, key: str) -> str | None:
        row = v.current_values(self.read("kv").where(F.col("key") == key)).first()
        return row and row["value"]

    def kv_delete(self, key: str) -> None:
        self._write("kv", [(key, None, self._seq())])

    def kv_scan(self, prefix: str = "", limit: int | None = None) -> DataFrame:
        return v.scan_prefix(v.current_values(self.read("kv")), prefix, limit)

    def kv_count(self) -> int:
        return v.current_values(self.read("kv")).count()

    # --- sessions and tool cache ---

    def session_set(self, session_id: str, data: str | None, ttl: float = 3600) -> None:
        self._write("sessions", [(session_id, float(self.clock()), float(ttl), data, self._seq())])

    def session_get(self, session_id: str) -> str | None:
        """The payload, with its time to live begun anew; None once expired or deleted."""
        last = self.read("sessions").where(F.col("session_id") == session_id).orderBy(F.col("seq").desc()).first()
        if last is None or last["data"] is None or self.clock() - last["at"] >= last["ttl"]:
            return None
        self.session_set(session_id, last["data"], last["ttl"])
        return last["data"]

    def session_delete(self, session_id: str) -> None:
        self.session_set(session_id, None)

    def session_purge(self) -> int:
        """Removes sessions whose time is over and deleted ones; returns how many."""
        last = self.read("sessions").groupBy("session_id").agg(F.max_by(F.struct("at", "ttl", "data"), "seq").alias("s"))
        live = last.where(F.col("s.data").isNotNull() & (F.lit(self.clock()) - F.col("s.at") < F.col("s.ttl"))).select("session_id")
        gone = last.count() - live.count()
        if gone:
            self._rewrite("sessions", {"sessions": self.read("sessions").join(live, "session_id", "left_semi").select(*self.read("sessions").columns)})
        return gone

    def tool_cache_purge(self) -> int:
        """Removes entries whose time is over; returns how many."""
        entries = h.cached(self.read("tool_cache"))
        gone = h.expired_entries(entries, self.clock())
        n = gone.count()
        if n:
            rows = self.read("tool_cache")
            self._rewrite("tool_cache", {"tool_cache": rows.join(gone, ["tool", "args_hash"], "left_anti").select(*rows.columns)})
        return n

    def tool_cache_put(self, tool: str, args: str, result: str, ttl: float = 3600) -> None:
        self._write("tool_cache", [(tool, self._hash(args), self._vector(args), result, float(self.clock()), float(ttl), self._seq())])

    def tool_cache_get(self, tool: str, args: str) -> dict | None:
        ask = self.spark.createDataFrame([(1, tool, self._hash(args), self._vector(args))], "lookup_id int, tool string, args_hash long, embedding array<double>")
        hit = h.cache_lookup(h.cached(self.read("tool_cache")), ask, self.clock()).first()
        return None if hit["outcome"] == "miss" else hit.asDict()

    def _hash(self, text: str) -> int:
        import hashlib

        return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")

    def _vector(self, text: str) -> list[float]:
        return r.embedder(self.spec)[1](text)

    # --- traces ---

    def record_span(self, trace_id: str, span_id: str, name: str, *, parent_id: str | None = None, thread_id: str | None = None, kind: str = "internal", start: float | None = None, end: float | None = None, status: str = "open", attributes: Mapping | None = None) -> None:
        self._write("spans", [(trace_id, span_id, parent_id, thread_id, name, kind, float(self.clock() if start is None else start), end, status, json.dumps(attributes or {}, sort_keys=True), self._seq())])

    def close_span(self, span_id: str, end: float, status: str = "ok") -> None:
        if self.read("spans").where(F.col("span_id") == span_id).isEmpty():
            raise KeyError(span_id)
        self._write("closings", [(span_id, float(end), status, self._seq())])

    def spans(self) -> DataFrame:
        return h.close_spans(h.current_spans(self.read("spans")), self.read("closings"))

    def trace(self, trace_id: str) -> DataFrame:
        return self.spans().where(F.col("trace_id") == trace_id).orderBy("first_seq")

    def subtree(self, span_id: str) -> DataFrame:
        spans = self.spans()
        return h.subtrees(spans, spans.where(F.col("span_id") == span_id))

    def thread(self, thread_id: str) -> DataFrame:
        return h.thread_of(self.spans(), thread_id)

    def search_spans(self, filter_json: str = "{}", limit: int = 100) -> DataFrame:
        given = v.filter_arguments(filter_json)
        return h.search_spans(self.spans(), **{k: given[k] for k in given if k in ("prefix", "since", "until", "status", "trace_id", "kind")}).orderBy("first_seq").limit(limit)

    # --- registries: "prompts" and "datasets" ---

    def put(self, registry: str, name: str, content: str, metadata: Mapping | None = None) -> int:
        self._write(registry, [(name, content, json.dumps(metadata or {}, sort_keys=True), self._seq())])
        return self._versions(registry).where(F.col("name") == name).agg(F.max("version")).first()[0]

    def _versions(self, registry: str) -> DataFrame:
        return h.versions(self.read(registry))

    def versions(self, registry: str, name: str | None = None) -> DataFrame:
        live = h.live_versions(self._versions(registry), self.read("deletions").where(F.col("registry") == registry))
        return live if name is None else live.where(F.col("name") == name).orderBy("version")

    def tags(self, registry: str) -> DataFrame:
        return h.current_tags(self.read("tags").where(F.col("registry") == registry), self.versions(registry))

    def get(self, registry: str, name: str, which: int | str | None = None) -> DataFrame:
        """A version by number, by tag, or the latest."""
        live = self.versions(registry).where(F.col("name") == name)
        if which is None:
            return h.latest(live)
        return live.where(F.col("version") == which) if isinstance(which, int) else h.by_tag(live, self.tags(registry), which)

    def names(self, registry: str) -> DataFrame:
        return h.names(self.read(registry), self.read("dataset_schemas") if registry == "datasets" else None).orderBy("name")

    def tag(self, registry: str, name: str, version: int, tag: str) -> None:
        if self.get(registry, name, version).isEmpty():
            raise KeyError(f"{name} version {version}")
        self._write("tags", [(registry, name, tag, version, self._seq())])

    def untag(self, registry: str, name: str, tag: str) -> None:
        self._write("tags", [(registry, name, tag, None, self._seq())])

    def delete_version(self, registry: str, name: str, version: int) -> None:
        self._write("deletions", [(registry, name, version)])

    def search(self, registry: str, query: str, k: int = 10, name: str | None = None) -> DataFrame:
        rows = self.versions(registry, name).withColumn("id", F.concat_ws("@", "name", F.lpad(F.col("version").cast("string"), 9, "0")))
        scores = r.vector_scores(rows.select("id", r.embedder(self.spec)[0](F.col("content")).alias("embedding")), self._vector(query))
        return rows.join(F.broadcast(r.top(scores.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))), k)), "id")

    def diff(self, name: str, a: int, b: int) -> str:
        old, new = (self.get("prompts", name, x).first() for x in (a, b))
        if old is None or new is None:
            raise KeyError(f"{name} version {a if old is None else b}")
        return h.line_diff(old["content"], new["content"])

    def dataset_create(self, name: str, schema: Mapping | None = None) -> None:
        self._write("dataset_schemas", [(name, json.dumps(schema or {}, sort_keys=True), self._seq())])

    def dataset_add(self, name: str, rows_json: str, metadata: Mapping | None = None) -> int:
        version = self.put("datasets", name, rows_json, metadata)
        seq = self._versions("datasets").where((F.col("name") == name) & (F.col("version") == version)).first()["seq"]
        rows = v.dataset_rows(self.spark.createDataFrame([(name, seq, rows_json)], "name string, put_seq long, j string"), "j")
        self._write("dataset_rows", rows)
        return version

    def dataset_rows(self, name: str, which: int | str | None = None) -> DataFrame:
        return self.read("dataset_rows").join(self.get("datasets", name, which).select("name", F.col("seq").alias("put_seq")), ["name", "put_seq"], "left_semi")

    def dataset_sample(self, name: str, which: int | str | None, n: int, split: str | None = None) -> DataFrame:
        return h.sample_rows(self.dataset_rows(name, which), n, "place", split)

    def dataset_splits(self, name: str, which: int | str | None = None) -> DataFrame:
        return h.split_sizes(self.dataset_rows(name, which))

    def dataset_from_recall(self, query: str, k: int, name: str, split: str = "") -> int:
        hits = self.recall(query, k=k, reinforce=False).collect()
        rows = [{"id": str(x["id"]), "text": x["text"], "split": split, "annotations": {"source": "recall", "memory_id": x["id"], "key": x["key"], "score": round(x["score"], 6)}} for x in hits]
        return self.dataset_add(name, json.dumps(rows))

    # --- evaluation ---

    def eval_start(self, dataset: str, model: str, scorer: str, *, prompt: str | None = None, metadata: Mapping | None = None) -> str:
        run = uuid.uuid4().hex
        self._write("runs", [(run, f"{dataset}:{prompt or '-'}:{model}", dataset, model, scorer, json.dumps(metadata or {}, sort_keys=True), self._seq())])
        self._write("run_events", [(run, "start", None, self._seq())])
        return run

    def _open(self, states: DataFrame, run: str) -> None:
        state = states.where(F.col("run_id") == run).first()
        if state is None or state["status"] in ("completed", "failed"):
            raise ValueError(f"run {run} is {'unknown' if state is None else state['status']}")

    def eval_states(self) -> DataFrame:
        return o.state_of_runs(self.read("run_events"))

    def eval_score(self, run: str, row_id: str, score: float, output: str | None = None, notes: str | None = None) -> None:
        if not 0 <= score <= 1:
            raise ValueError("a score must lie within 0 and 1")
        self._open(self.eval_states(), run)
        self._write("scores", [(run, row_id, float(score), output, notes, self._seq())])
        self._write("run_events", [(run, "score", None, self._seq())])

    def eval_end(self, run: str, reason: str | None = None) -> None:
        """Completes a run or, with a reason, fails it."""
        self._open(self.eval_states(), run)
        # what was scored until now is the run's summary from here on
        frozen = o.summarize(self.eval_scores().where(F.col("run_id") == run))
        self._write("summaries", self.spark.createDataFrame(frozen.collect(), SCHEMAS["summaries"]))
        self._write("run_events", [(run, "fail" if reason else "complete", reason, self._seq())])
        self._changed("eval", run, 0, "update")

    def eval_scores(self) -> DataFrame:
        return o.current_scores(self.read("scores"))

    def eval_summary(self) -> DataFrame:
        return o.summarize(self.eval_scores())

    def eval_runs(self, dataset: str | None = None) -> DataFrame:
        runs = self.read("runs").join(self.eval_states(), "run_id")
        return (runs if dataset is None else runs.where(F.col("dataset") == dataset)).orderBy(F.col("seq").desc())

    def eval_compare(self, a: str, b: str) -> DataFrame:
        return o.compare_runs(self.eval_scores(), a, b)

    def eval_compare_summaries(self, a: str, b: str) -> DataFrame:
        """Differences of the summaries that the runs ended with."""
        return o.compare_summaries(self.read("summaries"), a, b)

    def eval_changes(self, a: str, b: str, change: str) -> DataFrame:
        """The ``regressed`` or ``improved`` rows, the largest change first."""
        return o.changed_rows(self.eval_compare(a, b), change)

    def eval_failures(self, run: str, below: float = 0.5, similarity: float = 0.8, most: int = 10) -> DataFrame:
        last = self.read("scores").where(F.col("run_id") == run).groupBy("run_id", "row_id").agg(F.max_by(F.struct("score", "output"), "seq").alias("s"))
        failed = last.where((F.col("s.score") < below) & F.col("s.output").isNotNull()).select("run_id", "row_id", F.col("s.score").alias("score"), r.embedder(self.spec)[0](F.col("s.output")).alias("vec"))
        return o.greedy_clusters(failed, group="run_id", id_col="row_id", order_col="score", vec_col="vec", similarity=similarity, most=most)

    # --- replay ---

    def replay_capture(self, trace_id: str, kind: str, input_: str, output: str, model: str | None = None) -> None:
        self._write("invocations", [(trace_id, kind, model, input_, output, self._seq())])

    def replay_sessions(self) -> DataFrame:
        return h.fingerprints(h.captured(self.read("invocations")))

    def replay_start(self, trace_id: str, mode: str = "live", overrides: Iterable[tuple[int, str, str | None]] = (), metadata: Mapping | None = None) -> str:
        source = h.captured(self.read("invocations")).where(F.col("trace_id") == trace_id)
        if source.isEmpty():
            raise KeyError(trace_id)
        run = uuid.uuid4().hex
        self._write("replays", [(run, trace_id, mode, json.dumps(metadata or {}, sort_keys=True), self._seq())])
        self._write("replay_events", [(run, "start", None, self._seq())])
        rows = [(run, trace_id, i, action, value, self._seq()) for i, action, value in overrides]
        self._write("replay_overrides", rows or [(run, trace_id, -1, "none", None, self._seq())])
        if mode == "cached":
            self._write("replay_outputs", source.select(F.lit(run).alias("run_id"), "trace_id", F.col("idx").cast("int").alias("idx"), "output", F.lit(self._seq()).alias("seq")))
        return run

    def replay_plan(self, run: str) -> DataFrame:
        return h.replay_plan(h.captured(self.read("invocations")), self.read("replay_overrides").where(F.col("run_id") == run)).orderBy("idx")

    def replay_states(self) -> DataFrame:
        return o.state_of_runs(self.read("replay_events"))

    def replay_runs(self, trace_id: str | None = None) -> DataFrame:
        """Runs with their state and the trace they produced, the newest first; of one source trace, if it is named."""
        runs = self.read("replays")
        traces = self.read("replay_traces").groupBy("run_id").agg(F.max_by("replay_trace_id", "seq").alias("replay_trace_id"))
        runs = runs if trace_id is None else runs.where(F.col("trace_id") == trace_id)
        return runs.join(self.replay_states(), "run_id").join(traces, "run_id", "left").orderBy(F.col("seq").desc())

    def replay_stats(self) -> DataFrame:
        """``sessions, invocations, runs, running, completed, failed``."""
        calls = self.read("invocations").agg(F.countDistinct("trace_id").alias("sessions"), F.count("*").alias("invocations"))
        return calls.join(o.run_stats(self.replay_states(), self.read("replay_outputs")).drop("scores"))  # two single rows

    def replay_end(self, run: str, reason: str | None = None) -> None:
        """Completes a run or, with a reason, fails it."""
        self._open(self.replay_states(), run)
        self._write("replay_events", [(run, "fail" if reason else "complete", reason, self._seq())])
        self._changed("replay", run, 0, "update")

    def replay_set_trace(self, run: str, replay_trace_id: str) -> None:
        if self.read("replays").where(F.col("run_id") == run).isEmpty():
            raise KeyError(run)
        self._write("replay_traces", [(run, replay_trace_id, self._seq())])

    def replay_record(self, run: str, idx: int, output: str) -> None:
        self._open(self.replay_states(), run)
        step = self.replay_plan(run).where(F.col("idx") == idx).first()
        if step is None:
            raise IndexError(idx)
        self._write("replay_outputs", [(run, step["trace_id"], idx, output, self._seq())])
        self._write("replay_events", [(run, "score", None, self._seq())])
        self._changed("replay", run, idx, "update")

    def replay_diff(self, run: str) -> DataFrame:
        plan = self.replay_plan(run)
        own = self.read("replay_outputs").where(F.col("run_id") == run).groupBy("run_id", "trace_id", "idx").agg(F.max_by("output", "seq").alias("output"))
        fixed = plan.where("recorded is not null").select("run_id", "trace_id", "idx", F.col("recorded").alias("output"))
        outputs = own.join(fixed, ["run_id", "trace_id", "idx"], "left_anti").unionByName(fixed)
        source = h.captured(self.read("invocations")).join(plan.select("trace_id").distinct(), "trace_id", "left_semi")
        return h.replay_diff(source, outputs).orderBy("idx")

    # --- spend ---

    def cost_record(self, tenant: str, model: str, tokens_in: int, tokens_out: int, cost_usd: float, *, prompt: str | None = None, input_text: str | None = None, metadata: Mapping | None = None) -> None:
        if cost_usd < 0:
            raise ValueError("a cost cannot be negative")
        before = self._status(tenant)
        self._write("spend", [(uuid.uuid4().hex, tenant, model, prompt, tokens_in, tokens_out, float(cost_usd), input_text, json.dumps(metadata or {}, sort_keys=True), self.clock(), self._seq())])
        # the entry counts from the next moment on: budgets look at what is before the time of asking
        after = self._status(tenant, self.clock() + 1e-6)
        if after != before and after in ("warning", "exceeded"):
            self._changed("budget", tenant, after, "update")

    def _status(self, tenant: str, now: float | None = None) -> str | None:
        """A tenant's budget status; None without a budget."""
        budget = self.budgets().where(F.col("tenant") == tenant)
        if budget.isEmpty():
            return None
        return o.budget_status(self.read("spend").where(F.col("tenant") == tenant), budget, self.clock() if now is None else now).first()["status"]

    def cost_query(self, limit: int = 0, **conditions) -> DataFrame:
        return o.query_spend(self.read("spend"), o.spend_filter(**conditions), limit)

    def cost_aggregate(self, by: str, **conditions) -> DataFrame:
        return o.aggregate_spend(self.read("spend").where(o.spend_filter(**conditions)), by).orderBy(F.col("total_usd").desc(), "bucket")

    def cost_total(self, **conditions) -> float:
        return o.total_spend(self.read("spend"), o.spend_filter(**conditions)).first()[0]

    def set_budget(self, tenant: str, period: str, amount: float, warn_pct: float = 0.8) -> None:
        self._write("budgets", [(tenant, period, float(amount), float(warn_pct), False, self._seq())])

    def delete_budget(self, tenant: str) -> None:
        self._write("budgets", [(tenant, "daily", 0.0, 0.0, True, self._seq())])

    def budgets(self) -> DataFrame:
        return o.latest_budgets(self.read("budgets"))

    def budget_status(self, tenant: str | None = None) -> DataFrame:
        rows = o.budget_status(self.read("spend"), self.budgets(), self.clock())
        return rows if tenant is None else rows.where(F.col("tenant") == tenant)

    def budget_alerts(self) -> DataFrame:
        return o.alerts(self.budget_status()).orderBy(F.col("utilization").desc(), "tenant")

    def expensive_clusters(self, similarity: float = 0.7, most: int = 10, top: int = 50) -> DataFrame:
        dear = self.read("spend").where("coalesce(input_text, '') <> ''").orderBy(F.col("cost_usd").desc(), "id").limit(top)
        rows = dear.select(F.lit("all").alias("all"), "id", (-F.col("cost_usd")).alias("rank"), r.embedder(self.spec)[0](F.col("input_text")).alias("vec"))
        return o.greedy_clusters(rows, group="all", id_col="id", order_col="rank", vec_col="vec", similarity=similarity, most=most)

    # --- documents ---

    def doc_ingest(self, uri: str, text: str, content_type: str = "text/plain") -> None:
        self._write("documents", [(uri, content_type, text, self._seq())])

    def documents(self) -> DataFrame:
        removed = self.read("removed_documents").groupBy("uri").agg(F.max("seq").alias("gone"))
        all_ = h.current_documents(self.read("documents"))
        last = self.read("documents").groupBy("uri").agg(F.max("seq").alias("last"))
        return all_.join(last, "uri").join(removed, "uri", "left").where("gone is null or gone < last").drop("gone", "last")

    def doc_list(self) -> DataFrame:
        return self.documents().orderBy("uri")

    def doc_source(self, uri: str) -> bytes:
        """The object that a document's uri names."""
        return t.get_object(self.spark, uri)

    def doc_delete(self, uri: str) -> None:
        self._write("removed_documents", [(uri, self._seq())])

    def doc_search(self, query: str, k: int = 10) -> DataFrame:
        """Hybrid search over chunks, with citations."""
        rows = h.chunks(self.documents()).withColumn("id", F.concat_ws("#", "doc_id", F.lpad(F.col("chunk_index").cast("string"), 9, "0")))
        return rows.join(F.broadcast(r.hybrid(rows, query, k=k, spec=self.spec)), "id").orderBy(F.col("score").desc(), "id")

    # --- audit, export and snapshots ---

    def audit(self, principal: str, command: str, outcome: str, tenant: str | None = None) -> None:
        self._write("audit", [(principal, tenant, command, outcome, self.clock(), self._seq())])

    def audit_recent(self, tenant: str | None = None, n: int = 1000) -> DataFrame:
        return v.recent_audit(self.read("audit"), tenant, n)

    def export(self, path: str) -> int:
        return t.export_memory(self.memory(), path)

    def snapshot(self, target: str) -> DataFrame:
        """Copies the store and returns the manifest of what was copied."""
        t.copy_folder(self.spark, self.root, target)
        return t.manifest(self.spark, target)

    def restore(self, source: str, *, force: bool = False) -> str | None:
        return t.copy_folder(self.spark, source, self.root, force=force)
