"""Traces, versioned registries, replays, documents, caches, sessions and change feeds.

Mutations are events with a sequence number; a current state is a fold over them.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reverie.functions.scalars import glob_match, json_equal, set_json_field
from reverie.operators.retrieval import best_matches
from reverie.sources.scratch import cut

# --- traces: trace_id, span_id, parent_id, thread_id, name, kind, start, end, status, attributes, seq ---


def current_spans(events: DataFrame) -> DataFrame:
    """The last record of each span, with the place of its first (``first_seq``)."""
    keep = [c for c in events.columns if c not in ("span_id", "seq")]
    return events.groupBy("span_id").agg(F.max_by(F.struct(*keep), "seq").alias("s"), F.min("seq").alias("first_seq")).select("span_id", "s.*", "first_seq")


def close_spans(spans: DataFrame, closings: DataFrame) -> DataFrame:
    """Spans with the end and status of their last closing (``span_id, end, status, seq``)."""
    last = closings.groupBy("span_id").agg(F.max_by(F.struct("end", "status"), "seq").alias("c"))
    return spans.join(last, "span_id", "left").withColumn("end", F.coalesce("c.end", "end")).withColumn("status", F.coalesce("c.status", "status")).drop("c")


def duration(start: Column, end: Column) -> Column:
    """End minus start, never below 0; null while open."""
    return F.greatest(end - start, F.lit(0))


def search_spans(spans: DataFrame, *, prefix: str | None = None, since: float | None = None, until: float | None = None, status: str | None = None, trace_id=None, kind: str | None = None) -> DataFrame:
    """Spans that meet all given conditions; ``since`` is inclusive, ``until`` exclusive."""
    rows = spans
    if prefix:
        rows = rows.where(F.col("name").startswith(prefix))
    if since is not None:
        rows = rows.where(F.col("start") >= since)
    if until is not None:
        rows = rows.where(F.col("start") < until)
    for name, value in (("status", status), ("trace_id", trace_id), ("kind", kind)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def ancestries(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, path`` (structs span_id, seq; from the topmost ancestor to the span itself), of any depth.

    Each round joins a span's path to that of its topmost ancestor so far, which doubles
    what it reaches: the rounds are as the logarithm of the depth. A parent in another trace or one
    that is not there ends a path, and so does an ancestor that comes a second time (a cycle).
    """
    itself = F.array(F.struct("span_id", F.col("first_seq").alias("seq")))
    state = cut(spans.select("trace_id", "span_id", F.col("parent_id").alias("above"), itself.alias("path")))
    names, kind = ["trace_id", "span_id", "above", "path"], state.schema["path"].dataType
    while not (left := state.where("above is not null")).isEmpty():
        other = state.select("trace_id", F.col("span_id").alias("above"), F.col("above").alias("_next"), F.col("path").alias("_rest"))
        joined = left.join(other, ["trace_id", "above"], "left").withColumn("_rest", F.coalesce("_rest", F.array().cast(kind)))
        # the last ancestor of the rest that the path has already: what is above it would come again
        again = F.expr("coalesce(array_max(transform(array_intersect(_rest.span_id, path.span_id), x -> array_position(_rest.span_id, x))), 0L)").cast("int")
        longer = F.concat(F.slice("_rest", again + 1, F.size("_rest") - again), F.col("path"))
        joined = joined.select("trace_id", "span_id", F.when(again == 0, F.col("_next")).alias("above"), longer.alias("path"))
        state = cut(state.where("above is null").select(*names).unionByName(joined))
    return state.select("trace_id", "span_id", "path")


def subtrees(spans: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, span_id, depth, place`` of the spans below each root (``span_id``), the root first, in pre-order, however deep.

    Only traces with a root are followed; a span is below each root among its ancestors.
    """
    rows = spans.select("trace_id", "span_id", "parent_id", "first_seq")
    wanted = roots.select("span_id").distinct()
    rows = rows.join(rows.join(wanted, "span_id", "left_semi").select("trace_id").distinct(), "trace_id", "left_semi")
    placed = ancestries(rows).select("span_id", "path", F.posexplode("path").alias("at", "_a")).withColumn("root", F.col("_a.span_id"))
    below = placed.join(wanted.withColumnRenamed("span_id", "root"), "root", "left_semi")
    below = below.select("root", "span_id", (F.size("path") - 1 - F.col("at")).alias("depth"), F.expr("transform(slice(path, at + 1, size(path) - at), x -> x.seq)").alias("order"))
    return below.select("root", "span_id", "depth", F.row_number().over(Window.partitionBy("root").orderBy("order")).alias("place"))


def trace_counts(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces"), F.countDistinct("thread_id").alias("threads"))


def thread_of(spans: DataFrame, thread_id) -> DataFrame:
    """A thread's spans with ``trace_place``: traces in the order of their first span, spans in the order of theirs."""
    mine = spans.where(F.col("thread_id") == thread_id)
    first = mine.groupBy("trace_id").agg(F.min("first_seq").alias("trace_first"))
    return mine.join(first, "trace_id").withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("trace_first", "first_seq")))


# --- registries: puts (name, seq, ...), deletions (name, version), tag events (name, tag, version, seq) ---


def versions(puts: DataFrame) -> DataFrame:
    """Puts with their version, counted from 1 for each name and never used again."""
    return puts.withColumn("version", F.row_number().over(Window.partitionBy("name").orderBy("seq")))


def live_versions(numbered: DataFrame, deletions: DataFrame) -> DataFrame:
    return numbered.join(deletions.select("name", "version").distinct(), ["name", "version"], "left_anti")


def latest(live: DataFrame) -> DataFrame:
    """The highest live version of each name."""
    keep = [c for c in live.columns if c != "name"]
    return live.groupBy("name").agg(F.max_by(F.struct(*keep), "version").alias("v")).select("name", "v.*")


def current_tags(events: DataFrame, live: DataFrame) -> DataFrame:
    """``name, tag, version``: where each tag points; a null version removes a tag, deleted versions lose theirs."""
    last = events.groupBy("name", "tag").agg(F.max_by(F.struct("version"), "seq").alias("t")).select("name", "tag", "t.version").where("version is not null")
    return last.join(live.select("name", "version"), ["name", "version"], "left_semi")


def by_tag(live: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return live.join(tags.where(F.col("tag") == tag).select("name", "version"), ["name", "version"])


def names(numbered: DataFrame, schema_only: DataFrame | None = None) -> DataFrame:
    """All names ever put, deleted ones too, and those that have a schema alone."""
    out = numbered.select("name")
    return (out if schema_only is None else out.union(schema_only.select("name"))).distinct()


def sample_rows(rows: DataFrame, n: int, order: str, split: str | None = None) -> DataFrame:
    """The first ``n`` rows of a dataset version in the order they came, of a split if one is named (not - or empty)."""
    chosen = rows if split in (None, "-", "") else rows.where(F.col("split") == split)
    return chosen.orderBy(order).limit(n)


def split_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def line_changes(a: Column, b: Column) -> tuple[Column, Column]:
    """Lines only in ``a`` and lines only in ``b``: the changes without their places."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    return F.array_except(x, y), F.array_except(y, x)


def _lines(text: str | None) -> list[str]:
    out = (text or "").split("\n")
    return [x.removesuffix("\r") for x in (out[:-1] if out[-1] == "" else out)]


def line_diff(a: str | None, b: str | None) -> str:
    """A line diff: shared lines after a space, removed ones after -, added ones after +.

    Where the current lines differ, each is looked for further on in the other text, and the nearer
    one is gone on to (the new text's at a tie); if neither is there, both lines are a change.
    """
    old, new = _lines(a), _lines(b)
    in_old: dict[str, list[int]] = {}
    in_new: dict[str, list[int]] = {}
    for lines, places in ((old, in_old), (new, in_new)):
        for i, line in enumerate(lines):
            places.setdefault(line, []).append(i)

    def ahead(places: list[int] | None, start: int) -> int | None:
        """How far on from ``start`` the next of ``places`` is."""
        k = bisect_left(places or [], start)
        return places[k] - start if places and k < len(places) else None

    out, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            out.append(" " + old[i])
            i, j = i + 1, j + 1
            continue
        add, drop = ahead(in_new.get(old[i]), j), ahead(in_old.get(new[j]), i)
        if add is None and drop is None:
            add = drop = 1
        elif add is not None and drop is not None:
            add, drop = (0, drop) if drop < add else (add, 0)
        out += ["-" + x for x in old[i : i + (drop or 0)]] + ["+" + x for x in new[j : j + (add or 0)]]
        i, j = i + (drop or 0), j + (add or 0)
    return "\n".join(out + ["-" + x for x in old[i:]] + ["+" + x for x in new[j:]])


def diff_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([line_diff(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


# --- replays: invocations (trace_id, seq, kind, model, input, output), overrides (run_id, at_idx, action, value, seq) ---


def captured(invocations: DataFrame) -> DataFrame:
    """Invocations with their index from 0 in each trace."""
    return invocations.withColumn("idx", F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")) - 1)


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's bytes in UTF-8, as 16 hexadecimal digits (fixed constants)."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            h = 0xCBF29CE484222325
            for byte in (value or "").encode():
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            out.append(f"{h:016x}")
        return pd.Series(out)

    return run(text)


def fingerprints(invocations: DataFrame) -> DataFrame:
    """``trace_id, n, fingerprint``: one hash over each step's input (its JSON text), kind and model, in order."""
    step = F.struct("idx", F.concat_ws("", "input", "kind", "model").alias("x"))
    steps = invocations.groupBy("trace_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(step)).alias("s"))
    return steps.select("trace_id", "n", fnv1a(F.concat_ws("", F.col("s.x"))).alias("fingerprint"))


def replay_plan(invocations: DataFrame, overrides: DataFrame) -> DataFrame:
    """The whole effective run: each step with the first override at its index applied.

    Actions: model, prompt, temperature (sets a member of a JSON input), output (recorded as it is),
    skip (recorded as JSON null, not executed).
    """
    first = overrides.groupBy("run_id", "trace_id", "at_idx").agg(F.min_by(F.struct("action", "value"), "seq").alias("o"))
    runs = overrides.select("run_id", "trace_id").distinct()
    steps = runs.join(invocations, "trace_id").join(first.withColumnRenamed("at_idx", "idx"), ["run_id", "trace_id", "idx"], "left")
    act, value = F.col("o.action"), F.col("o.value")
    return steps.select(
        "run_id", "trace_id", "idx", "kind",
        F.when(act == "model", value).otherwise(F.col("model")).alias("model"),
        F.when(act == "prompt", value).when(act == "temperature", set_json_field(F.col("input"), "temperature", value)).otherwise(F.col("input")).alias("input"),
        F.when(act == "output", value).when(act == "skip", "null").alias("recorded"),
        F.coalesce(~act.isin("output", "skip"), F.lit(True)).alias("executes"),
    )


def replay_diff(invocations: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per step of each run: whether its output differs in value from the original, or one is missing."""
    return invocations.join(outputs.select("run_id", "trace_id", "idx", F.col("output").alias("replayed")), ["trace_id", "idx"], "left").select("run_id", "trace_id", "idx", "output", "replayed", (~json_equal(F.col("output"), F.col("replayed"))).alias("differs"))


# --- documents: uri, content_type, text, seq ---


def chunk(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Trimmed windows of ``size`` characters, ``overlap`` shared with the next; a text that fits is one chunk, an empty one none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    plain, step = F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), size - overlap
    n = F.char_length(plain)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")), lambda i: i * step))
    windows = F.transform(starts, lambda s: F.btrim(F.substring(plain, s + 1, F.lit(size)), F.lit(" \t\n\x0b\x0c\r")))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(windows)


def current_documents(events: DataFrame) -> DataFrame:
    """``uri, doc_id, version`` and the last text of each uri; the id is a hash of the uri."""
    return events.groupBy("uri").agg(F.max_by(F.struct("content_type", "text"), "seq").alias("d"), F.count("*").alias("version")).select("uri", F.md5(F.col("uri").cast("binary")).alias("doc_id"), "version", "d.*")


def chunks(documents: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """``doc_id, uri, version, chunk_index, text``: what a citation needs."""
    return documents.select("doc_id", "uri", "version", F.posexplode(chunk(F.col("text"), size, overlap)).alias("chunk_index", "text"))


# --- tool cache: tool, args_hash, embedding, result, stored_at, ttl, seq ---


def cached(puts: DataFrame) -> DataFrame:
    """The last entry of each tool and arguments."""
    keep = ["embedding", "result", "stored_at", "ttl"]
    return puts.groupBy("tool", "args_hash").agg(F.max_by(F.struct(*keep), "seq").alias("e")).select("tool", "args_hash", "e.*")


def fresh(now: float) -> Column:
    return (F.lit(now) - F.col("stored_at")) < F.col("ttl")


def expired_entries(cache: DataFrame, now: float) -> DataFrame:
    """``tool, args_hash`` of the entries that a purge removes."""
    return cache.where(~fresh(now)).select("tool", "args_hash")


def cache_lookup(cache: DataFrame, lookups: DataFrame, now: float, least: float = 0.95) -> DataFrame:
    """``lookup_id, outcome (exact, near, miss), similarity, result`` among fresh entries of the same tool.

    ``lookups`` has ``lookup_id, tool, args_hash, embedding``. An entry with the same arguments is found by
    an equi-join; only lookups without one are compared with their tool's vectors, and only
    what is similar enough is kept. The most similar entry wins, ties by arguments.
    """
    usable = cache.where(fresh(now))
    same = lookups.join(usable.select("tool", "args_hash", F.struct("result").alias("hit")), ["tool", "args_hash"], "left")
    exact = same.where("hit is not null").select("lookup_id", F.lit("exact").alias("outcome"), F.lit(1.0).alias("similarity"), "hit.result")
    rest = same.where("hit is null").select("lookup_id", "tool", "embedding")
    entries = usable.select(F.col("tool").alias("group"), F.col("args_hash").alias("id"), "embedding")
    found = best_matches(rest.select(F.col("tool").alias("group"), F.col("lookup_id").alias("q"), "embedding"), entries, 1, 9, least=least)
    results = usable.select("tool", F.col("args_hash").alias("hash"), "result")
    scored = found.join(results, (F.col("group") == F.col("tool")) & F.col("id").eqNullSafe(F.col("hash"))).select(F.col("q").alias("lookup_id"), F.col("score").alias("similarity"), "hash", "result")
    best = scored.groupBy("lookup_id").agg(F.max_by(F.struct("similarity", "result"), F.struct("similarity", -F.col("hash"))).alias("b"))
    near = rest.select("lookup_id").join(best, "lookup_id", "left")
    return exact.unionByName(near.select("lookup_id", F.when(F.col("b").isNull(), "miss").otherwise("near").alias("outcome"), "b.similarity", "b.result"))


# --- sessions: session_id, at, data, seq ---


def sessions(events: DataFrame, ttl: int, key: str = "session_id", at: str = "at") -> DataFrame:
    """``key, session, opened, last_access, accesses``: an access ``ttl`` or more after the one before finds nothing and opens anew."""
    w = Window.partitionBy(key).orderBy(at)
    opens = F.when(F.col(at) - F.lag(at).over(w) < ttl, 0).otherwise(1)
    numbered = events.withColumn("_new", opens).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("opened"), F.max(at).alias("last_access"), F.count("*").alias("accesses"))


def session_state(events: DataFrame, now: float, ttl: int, key: str = "session_id", at: str = "at") -> DataFrame:
    """Each key's last access, payload and whether it has expired."""
    return events.groupBy(key).agg(F.max(at).alias("last_access"), F.max_by("data", F.struct(at, "seq")).alias("data")).withColumn("expired", F.lit(now) - F.col("last_access") >= ttl)


# --- change feed: table, key, row_id, kind ---


def channel(table: Column, key: Column) -> Column:
    """``table.key``, or the table alone."""
    return F.when(key.isNull(), table).otherwise(F.concat_ws(".", table, key))


def subscribed(changes: DataFrame, *, exact: str | None = None, pattern: str | None = None) -> DataFrame:
    """Changes on a channel (or on all of a table's), or on those that match a glob; both empty: all. Works on streams."""
    where = channel(F.col("table"), F.col("key"))
    if exact:
        return changes.where((where == exact) | (F.col("table") == exact))
    return changes.where(glob_match(where, pattern)) if pattern else changes


# --- permissions: principal roles and capabilities ---

#: What a principal may do; the sets of the roles and the commands of each capability (fixed values).
CAPABILITIES = ("read", "write_memory", "delete_memory", "write_session", "write_prompt", "write_dataset", "run_eval", "write_trace", "write_replay", "write_cost", "admin")
ROLES = {
    "all": ("admin", "root", "owner"),
    "data": ("write", "readwrite", "read-write", "rw", "developer", "dev", "service", "service-account"),
    "evaluation": ("evaluator",),
}
ALWAYS = ("PING", "HELLO", "AUTH", "COMMAND", "INFO", "QUIT", "SUBSCRIBE", "UNSUBSCRIBE", "PSUBSCRIBE", "PUNSUBSCRIBE")
COMMANDS = {
    "write_session": ("SET",),
    "write_memory": ("REMEMBER", "REMEMBER.IDEM", "REMEMBER.BATCH", "REMEMBER.META"),
    "delete_memory": ("DEL", "COMPACT", "FORGET", "FORGET.KEY", "FORGET.OLDER"),
    "write_prompt": ("PROMPT.PUT", "PROMPT.TAG", "PROMPT.UNTAG"),
    "write_dataset": ("DATASET.CREATE", "DATASET.ADD", "DATASET.TAG", "DATASET.UNTAG", "DATASET.FROM_RECALL", "DOC.INGEST", "DOC.DELETE"),
    "run_eval": ("EVAL.START", "EVAL.SCORE", "EVAL.COMPLETE", "EVAL.FAIL"),
    "write_trace": ("TRACE.RECORD", "TRACE.CLOSE"),
    "write_replay": ("REPLAY.CAPTURE", "REPLAY.START", "REPLAY.STEP", "REPLAY.RECORD", "REPLAY.COMPLETE", "REPLAY.FAIL", "REPLAY.SET_TRACE"),
    "write_cost": ("COST.RECORD", "COST.SET_BUDGET", "COST.DELETE_BUDGET"),
}


def capabilities(role: Column) -> Column:
    """The capabilities of a role's name, as an array; unknown names may read."""
    name = F.lower(F.trim(role))
    listed = lambda xs: F.array(*map(F.lit, xs))
    return (
        F.when(name.isin(*ROLES["all"]), listed(CAPABILITIES))
        .when(name.isin(*ROLES["data"]), listed(CAPABILITIES[:-1]))
        .when(name.isin(*ROLES["evaluation"]), listed(("read", "run_eval", "write_dataset")))
        .otherwise(listed(("read",)))
    )


def permitted(calls: DataFrame, grants: DataFrame, reads: tuple[str, ...]) -> DataFrame:
    """Calls (``principal, command``) with ``allowed``: the principal's role has the capability that the command needs.

    ``reads`` names the commands that only read; what belongs to no family needs admin. Principals without a role may do nothing but meta commands.
    """
    needs = F.lit("admin")
    for flag, commands in (*COMMANDS.items(), ("read", reads)):
        needs = F.when(F.col("command").isin(*commands), flag).otherwise(needs)
    rows = calls.join(grants.select("principal", capabilities(F.col("role")).alias("_has")), "principal", "left")
    has = F.coalesce(F.array_contains("_has", needs) | F.array_contains("_has", "admin"), F.lit(False))
    return rows.withColumn("allowed", F.col("command").isin(*ALWAYS) | has).drop("_has")


def authorised(calls: DataFrame, grants: DataFrame, required: DataFrame) -> DataFrame:
    """Calls with ``allowed``: the principal has the role that the command needs; unknown commands need admin."""
    rank = lambda c: F.when(c == "admin", 3).when(c == "write", 2).when(c == "read", 1).otherwise(0)
    rows = calls.join(required, "command", "left").join(grants, "principal", "left")
    return rows.withColumn("allowed", rank(F.coalesce("role", F.lit("none"))) >= rank(F.coalesce("needs", F.lit("admin"))))
