"""Small fixtures whose results follow from the definitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reverie.functions import scalars as x
from reverie.operators import histories as h
from reverie.operators import ledgers as o
from reverie.operators import memory as m
from reverie.operators import retrieval as r
from reverie.sources import tables as t
from reverie.streaming import changes as c
from tests.conftest import SF


def values(df, *names):
    return sorted(tuple(row) for row in df.select(*names).collect())


def test_fusion_prefers_what_both_rank_high(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.3)], "id int, score double")
    b = spark.createDataFrame([(3, 1.0), (1, 0.8), (4, 0.2)], "id int, score double")
    found = r.rrf([a, b]).collect()
    assert [row.id for row in found] == [1, 3, 2, 4]
    assert found[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_bm25_ranks_repetition_first_and_empty_queries_find_nothing(spark):
    docs = spark.createDataFrame([(1, "refund refund refund my order"), (2, "refund please"), (3, "weather forecast"), (4, None)], "id int, text string")
    assert [row.id for row in r.top(r.bm25(docs, "refund"), 5).collect()] == [1, 2]
    assert r.bm25(docs, " .,").count() == 0
    assert r.bm25(docs.limit(0), "refund").count() == 0


def test_hybrid_finds_the_pair_that_agrees(spark):
    docs = spark.createDataFrame([(1, "refund request"), (2, "weather forecast")], "id int, text string")
    assert r.hybrid(docs, "refund request").first().id == 1


def test_hash_embedding_is_unit_or_zero(spark):
    rows = spark.createDataFrame([("Hello hello WORLD",), ("",), (None,)], "text string").select(r.hash_embedding(F.col("text"), 16).alias("v")).collect()
    assert sum(v * v for v in rows[0].v) == pytest.approx(1)
    assert rows[0].v == pytest.approx(r.hash_query("hello HELLO world", 16))
    assert not any(rows[1].v) and not any(rows[2].v)


def test_hashed_signs_find_clustered_neighbours(spark):
    from reverie.operators import services as v

    rows = v.clustered_vectors(spark, 1500, 16, deviation=0.15).cache()
    planes = r.hyperplanes(16)
    indexed = rows.withColumn("buckets", r.sign_buckets(F.col("embedding"), planes)).cache()
    hits = 0
    for q in (0, 3, 5):
        query = rows.where(F.col("id") == q).first().embedding
        exact = {row.id for row in r.top(r.vector_scores(rows, query), 10).collect()}
        hits += len(exact & {row.id for row in r.approximate_top(indexed, query, planes, 10).collect()})
    assert hits >= 27


def test_hashed_signs_find_neighbours_in_the_sample_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    planes = r.hyperplanes(64)
    indexed = rows.withColumn("buckets", r.sign_buckets(F.col("embedding"), planes)).cache()
    hits = 0
    for q in range(0, 500, 50):
        query = [float(x) for x in rows.where(F.col("id") == q).first().embedding]
        exact = {row.id for row in r.top(r.vector_scores(rows, query), 10).collect()}
        hits += len(exact & {row.id for row in r.approximate_top(indexed, query, planes, 10).collect()})
    assert hits >= 90


def test_unknown_embedders_are_refused():
    for spec in ("hash:2", "hash:x", "other:8"):
        with pytest.raises(ValueError):
            r.embedder(spec)


def test_filter_bounds_are_inclusive_and_null_kinds_never_match(spark):
    rows = spark.createDataFrame([(1, "a", ["x"], 10), (2, None, ["x", "y"], 20), (3, "a", [], 30)], "id int, kind string, tags array<string>, created_at int")
    ids = lambda **k: [row.id for row in rows.where(r.recall_filter(**k)).orderBy("id").collect()]
    assert ids(kind="a") == [1, 3]
    assert ids(tags_any=["y", "x"]) == [1, 2]
    assert ids(min_created=20, max_created=30) == [2, 3]
    assert ids() == [1, 2, 3]


def test_recalled_memory_outlives_an_important_one(spark):
    memory = spark.createDataFrame([(1, "k", 1.0, 1000), (2, "k", 5.0, 1000)], "id int, key string, importance double, created_at long")
    log = spark.createDataFrame([(1, 1000)] * 10, "id int, at long")
    assert [row.id for row in m.evict(memory, log, 1, 1000).collect()] == [2]
    assert m.evict(memory, log, 2, 1000).count() == 0


def test_remember_numbers_in_order(spark):
    batch = spark.createDataFrame([(f"k{i}", f"t{i}", 99 - i) for i in range(50)], "key string, text string, n int")
    found = m.remember(7, batch, F.col("n"), 5.0).orderBy("id").collect()
    assert [row.id for row in found] == list(range(8, 58))
    assert found[0].key == "k49" and found[0].importance == 1.0 and found[0].tags == []


def test_scan_pages_do_not_overlap(spark):
    memory = spark.range(1, 8)
    page = m.scan(memory, 0, 3).collect()
    assert [row.id for row in page] == [1, 2, 3] and page[0].next_cursor == 3
    last = m.scan(memory, 4, 3).collect()
    assert [row.id for row in last] == [5, 6, 7] and last[0].next_cursor is None


def test_repeated_keys_count_from_the_last_accepted_write(spark):
    writes = spark.createDataFrame([("a", 0, 1), ("a", 6, 2), ("a", 10, 3), ("a", 15, 4), ("b", 1, 5)], "idem_key string, at long, seq long")
    assert values(m.accept_once(writes, 10), "seq", "accepted", "original") == [(1, True, 1), (2, False, 1), (3, True, 3), (4, False, 3), (5, True, 5)]


def test_decay_floors():
    assert x.PERIODS["monthly"] == 30 * 86_400
    assert x.glob_regex("a.*?\\*") == "^(?s)a\\..*.\\*$"


def test_percentiles_are_nearest_ranks(spark):
    scores = spark.createDataFrame([("r", v) for v in (0.1, 0.4, 0.5, 0.7, 0.9)], "run_id string, score double")
    row = o.summarize(scores).first()
    assert (row.n, row.p50, row.lowest, row.highest) == (5, 0.5, 0.1, 0.9)
    assert row.mean == pytest.approx(0.52) and row.pass_rate == pytest.approx(0.6)


def test_budget_goes_from_ok_to_exceeded(spark):
    budgets = spark.createDataFrame([(1, "acme", "daily", 10.0, 0.8, False)], "seq int, tenant string, period string, amount double, warn_pct double, deleted boolean")
    plan = o.latest_budgets(budgets)
    for spent, status in ((7.0, "ok"), (9.0, "warning"), (11.0, "exceeded")):
        entries = spark.createDataFrame([("acme", spent, 100), ("other", 1.0, 100)], "tenant string, cost_usd double, recorded_at long")
        assert values(o.budget_status(entries, plan, 200), "tenant", "status") == [("acme", status), ("other", "nobudget")]


def test_subtree_is_in_pre_order_and_cycles_end(spark):
    events = spark.createDataFrame([("t", "s1", None, 1), ("t", "s2", "s1", 2), ("t", "s3", "s1", 3), ("t", "s4", "s2", 4), ("u", "c1", "c2", 5), ("u", "c2", "c1", 6)], "trace_id string, span_id string, parent_id string, seq int")
    spans = h.current_spans(events)
    tree = h.subtrees(spans, spans.where("span_id in ('s1', 's2', 'c1')"))
    order = lambda root: [row.span_id for row in tree.where(F.col("root") == root).orderBy("place").collect()]
    assert order("s1") == ["s1", "s2", "s4", "s3"]
    assert order("s2") == ["s2", "s4"]
    assert order("c1") == ["c1", "c2"]


def test_deep_and_wide_trees_are_followed_to_the_end(spark):
    chain = [("t", f"d{i}", f"d{i - 1}" if i else None, i) for i in range(200)]
    wide = [("w", "top", None, 1000)] + [("w", f"x{i}", "top", 1001 + i) for i in range(500)]
    orphan = [("o", "lost", "nowhere", 2000), ("o", "own", "own", 2001), ("o", "across", "d5", 2002)]
    spans = h.current_spans(spark.createDataFrame(chain + wide + orphan, "trace_id string, span_id string, parent_id string, seq int"))
    tree = {(r.root, r.span_id): (r.depth, r.place) for r in h.subtrees(spans, spans.where("span_id in ('d0', 'd150', 'top', 'lost', 'own', 'across')")).collect()}
    assert [tree["d0", f"d{i}"] for i in range(200)] == [(i, i + 1) for i in range(200)]
    assert tree["d150", "d199"] == (49, 50) and ("d0", "across") not in tree and tree["across", "across"] == (0, 1)
    assert all(tree["top", f"x{i}"] == (1, i + 2) for i in range(500))
    assert tree["lost", "lost"] == tree["own", "own"] == (0, 1)


def test_versions_are_never_used_again(spark):
    puts = h.versions(spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "name string, seq int"))
    live = h.live_versions(puts, puts.where("version = 3"))
    assert h.latest(live).first().version == 2
    assert values(h.names(puts, spark.createDataFrame([("q",)], "name string")), "name") == [("p",), ("q",)]


def test_tags_follow_the_last_event(spark):
    live = spark.createDataFrame([("p", 1), ("p", 2)], "name string, version int")
    tags = spark.createDataFrame([("p", "prod", 1, 1), ("p", "prod", 2, 2), ("p", "old", 1, 3), ("p", "old", None, 4), ("p", "lost", 9, 5)], "name string, tag string, version int, seq int")
    assert values(h.current_tags(tags, live), "tag", "version") == [("prod", 2)]


def brute_diff(a, b):
    """The rule by looking ahead line by line."""
    old, new, out = a.split("\n"), b.split("\n"), []
    while old and new:
        if old[0] == new[0]:
            out.append(" " + old[0])
            old, new = old[1:], new[1:]
        elif old[0] not in new and new[0] not in old:
            out += ["-" + old[0], "+" + new[0]]
            old, new = old[1:], new[1:]
        elif new[0] in old and (old[0] not in new or old.index(new[0]) < new.index(old[0])):
            out.append("-" + old[0])
            # go on until the line that was found
            stop = old.index(new[0])
            out += ["-" + x for x in old[1:stop]]
            old = old[stop:]
        else:
            stop = new.index(old[0])
            out += ["+" + x for x in new[:stop]]
            new = new[stop:]
    return "\n".join(out + ["-" + x for x in old] + ["+" + x for x in new])


def test_line_diff():
    import random

    assert h.line_diff("line a\nshared\nline c", "line a\nshared\nNEW line").split("\n") == [" line a", " shared", "-line c", "+NEW line"]
    assert h.line_diff("", "") == "" and h.line_diff(None, "x") == "+x" and h.line_diff("a\r\nb\n", "a\nb") == " a\n b"
    assert h.line_diff("a\nb\nc", "b\nc").split("\n") == ["-a", " b", " c"]
    r = random.Random(1)
    for _ in range(500):
        a, b = ("\n".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(2))
        assert h.line_diff(a, b) == brute_diff(a, b)


def test_fingerprints_are_fnv1a(spark):
    calls = h.captured(spark.createDataFrame([("t", 1, "llm_call", "m", "a"), ("u", 1, "", None, "")], "trace_id string, seq int, kind string, model string, input string"))
    found = {r.trace_id: r.fingerprint for r in h.fingerprints(calls).collect()}
    assert found["u"] == "cbf29ce484222325"
    value = 0xCBF29CE484222325
    for byte in b"allm_callm":
        value = (value ^ byte) * 0x100000001B3 % 2**64
    assert found["t"] == f"{value:016x}"


def test_eviction_cuts_exactly_among_ties(spark):
    memory = spark.createDataFrame([(i, "k", float(i % 5 + 1), 1000) for i in range(400)], "id int, key string, importance double, created_at long")
    log = spark.createDataFrame([], "id int, at long")
    order = sorted(range(400), key=lambda i: (i % 5, i))
    for cap in (0, 1, 37, 200, 399, 400):
        assert sorted(row.id for row in m.evict(memory, log, cap, 1000).collect()) == sorted(order[: 400 - cap])


def test_set_members_keep_their_types(spark):
    rows = spark.createDataFrame([('{"n": 1, "o": {"x": [true, null]}, "s": "1", "temperature": 9}', "0.5"), ("[1]", "2")], "doc string, value string")
    import json

    found = [r[0] for r in rows.select(x.set_json_field(F.col("doc"), "temperature", F.col("value"))).collect()]
    assert json.loads(found[0]) == {"n": 1, "o": {"x": [True, None]}, "s": "1", "temperature": 0.5} and found[1] == "[1]"


def test_replay_overrides(spark):
    calls = h.captured(spark.createDataFrame([("t", i, "llm_call", "m", '{"prompt": "p"}', f"o{i}") for i in range(5)], "trace_id string, seq int, kind string, model string, input string, output string"))
    overrides = spark.createDataFrame([("r", "t", 0, "model", "big", 1), ("r", "t", 1, "temperature", "0.5", 1), ("r", "t", 2, "output", "fixed", 1), ("r", "t", 3, "skip", None, 1), ("r", "t", 0, "skip", None, 2)], "run_id string, trace_id string, at_idx int, action string, value string, seq int")
    plan = {row.idx: row for row in h.replay_plan(calls, overrides).collect()}
    assert plan[0].model == "big" and plan[0].executes
    assert '"temperature":0.5' in plan[1].input
    assert plan[2].recorded == "fixed" and not plan[2].executes
    assert plan[3].recorded == "null" and not plan[3].executes
    assert plan[4].recorded is None and plan[4].executes


def test_replay_diff_compares_values(spark):
    calls = spark.createDataFrame([("t", 0, '{"a": 1, "b": 2}'), ("t", 1, "1"), ("t", 2, None), ("t", 3, "null")], "trace_id string, idx int, output string")
    outputs = spark.createDataFrame([("r", "t", 0, '{"b":2,"a":1}'), ("r", "t", 1, "2"), ("r", "t", 3, "null")], "run_id string, trace_id string, idx int, output string")
    assert values(h.replay_diff(calls, outputs), "idx", "differs") == [(0, False), (1, True), (2, False), (3, False)]


def test_chunks(spark):
    texts = spark.createDataFrame([("a" * 500,), ("  short ",), ("",), (None,)], "t string").select(h.chunk(F.col("t"), 100, 20).alias("c")).collect()
    assert [len(x) for x in texts[0].c] == [100] * 6 and texts[1].c == ["short"] and texts[2].c == [] and texts[3].c == []
    with pytest.raises(ValueError):
        h.chunk(F.lit("x"), 10, 10)


def test_cache_outcomes(spark):
    cache = h.cached(spark.createDataFrame([("web", 42, [1.0, 0.0], "r", 0, 60, 1), ("web", 7, [0.9, 0.1], "old", 0, 5, 2)], "tool string, args_hash long, embedding array<double>, result string, stored_at long, ttl long, seq int"))
    ask = spark.createDataFrame([(1, "web", 42, [0.0, 1.0]), (2, "web", 1, [1.0, 0.01]), (3, "web", 1, [0.0, 1.0]), (4, "no", 42, [1.0, 0.0])], "lookup_id int, tool string, args_hash long, embedding array<double>")
    assert values(h.cache_lookup(cache, ask, 30), "lookup_id", "outcome") == [(1, "exact"), (2, "near"), (3, "miss"), (4, "miss")]
    assert values(h.cache_lookup(cache, ask, 60), "lookup_id", "outcome") == [(i, "miss") for i in (1, 2, 3, 4)]


def test_session_gap_of_the_ttl_opens_anew(spark):
    events = spark.createDataFrame([("s", 0), ("s", 9), ("s", 19)], "session_id string, at long")
    assert values(h.sessions(events, 10), "session", "accesses") == [(1, 2), (2, 1)]


def test_clusters_take_the_nearest(spark):
    rows = spark.createDataFrame([("r", 1, 0.1, [1.0, 0.0]), ("r", 2, 0.2, [1.0, 0.1]), ("r", 3, 0.3, [0.0, 1.0])], "run string, id int, score double, vec array<double>")
    found = o.greedy_clusters(rows, group="run", id_col="id", order_col="score", vec_col="vec", similarity=0.8, most=5)
    assert values(found, "cluster", "id") == [(0, 1), (0, 2), (1, 3)]


def test_export_of_an_empty_store_has_a_schema(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, key string, text string, embedding array<float>, importance double, created_at long")
    assert t.export_memory(rows, f"file://{tmp_path}/e") == 0
    assert spark.read.parquet(f"file://{tmp_path}/e").columns == list(t.EXPORT_COLUMNS)


def test_snapshot_names_changed_and_missing_files(spark, tmp_path):
    source, target = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.range(10).repartition(2).write.csv(f"file://{source}")
    listed = t.manifest(spark, f"file://{source}").cache()
    assert listed.count() >= 2
    t.copy_folder(spark, f"file://{source}", f"file://{target}")
    assert t.verify_snapshot(spark, f"file://{target}", listed.where("path like 'part%'")).where("problem <> 'unexpected'").count() == 0
    with pytest.raises(FileExistsError):
        t.copy_folder(spark, f"file://{source}", f"file://{target}")
    assert t.copy_folder(spark, f"file://{source}", f"file://{target}", force=True).endswith(".backup")


def test_stream_windows_and_alerts(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "click", 50.0, "{}"), (2, "2024-01-01 01:00:00", 1, "click", 40.0, "{}"), (3, "2024-01-01 02:00:00", 1, "view", 20.0, "{}"), (4, "2024-01-02 00:00:00", 2, "error", 5.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"file://{tmp_path}/events")
    stream = lambda: c.event_stream(spark, f"file://{tmp_path}/events")
    assert values(c.run_to_end(c.windowed(stream(), "1 day"), f"file://{tmp_path}/o1", f"file://{tmp_path}/c1"), "table", "n") == [("click", 2), ("error", 1), ("view", 1)]
    assert values(c.run_to_files(c.alert_transitions(stream(), 100.0, 0.8), f"file://{tmp_path}/o2", f"file://{tmp_path}/c2"), "key", "status") == [("u1", "exceeded"), ("u1", "warning")]
    assert values(c.run_to_files(c.subscribed(stream(), exact="click.u1"), f"file://{tmp_path}/o", f"file://{tmp_path}/c3"), "row_id") == [(1,), (2,)]


def test_permissions(spark):
    calls = spark.createDataFrame([("a", "get"), ("b", "set"), ("b", "drop"), ("x", "get")], "principal string, command string")
    grants = spark.createDataFrame([("a", "read"), ("b", "write")], "principal string, role string")
    needs = spark.createDataFrame([("get", "read"), ("set", "write")], "command string, needs string")
    assert values(h.authorised(calls, grants, needs), "principal", "command", "allowed") == [("a", "get", True), ("b", "drop", False), ("b", "set", True), ("x", "get", False)]


def test_files_become_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes("# ñ".encode())
    (tmp_path / "in" / "b.txt").write_bytes(b"plain \xff")
    found = {row.uri.rsplit("/", 1)[1]: row for row in t.documents_from_files(spark, f"file://{tmp_path}/in").collect()}
    assert found["a.md"].content_type == "text/markdown" and found["a.md"].text == "# ñ"
    assert found["b.txt"].text.startswith("plain ") and len(found["b.txt"].text) == 7


def test_arguments_of_filters():
    from reverie.operators import services as v

    assert v.filter_arguments('{"kind": "a", "tags_any": [], "status": "strange", "other": 1}') == {"kind": "a", "tags_any": []}
    assert v.within({"within_secs": 10, "kind": "a"}, 100.0) == {"kind": "a", "min_created": 90.0}
    for text in ("[1]", "{"):
        with pytest.raises(ValueError):
            v.filter_arguments(text)


def test_generated_vectors_are_unit_and_repeatable(spark):
    from reverie.operators import services as v

    a, b = ([tuple(row) for row in v.clustered_vectors(spark, 40, 8).orderBy("id").collect()] for _ in range(2))
    assert a == b and all(abs(sum(x * x for x in row[2]) - 1) < 1e-9 for row in a)
