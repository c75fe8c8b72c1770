"""The store end to end, a command at a time."""

from __future__ import annotations

import pytest

from reverie.api import Store


@pytest.fixture
def store(spark, tmp_path):
    now = [1000.0]
    s = Store(spark, f"file://{tmp_path}/store", clock=lambda: now[0])
    s.now = now
    return s


def test_memory(store):
    assert store.recall("anything").count() == 0
    assert store.remember_batch([("alice", "refund request"), ("bob", "weather forecast")], kind="note", tags=["x"]) == [1, 2]
    assert store.remember_idempotent("once", "alice", "refund please") == 3 == store.remember_idempotent("once", "alice", "refund please")
    assert store.recall("refund request", k=1).first()["id"] == 1
    assert {x["id"] for x in store.recall("refund", filter_json='{"kind": "note", "tags_any": ["x"]}').collect()} <= {1, 2}
    assert store.read("recalls").count() >= 2
    assert store.forget(1) == 1 and store.forget(1) == 0
    assert store.recall("refund request").where("id = 1").count() == 0
    store.now[0] += 100
    assert store.forget_older(50) == 2 and store.compact() == 3 and store.memory().count() == 0
    assert store.remember("c", "new") == 4


def test_bulk_writes(store, spark):
    store.remember("k", "first")
    store.remember_frame(spark.createDataFrame([("a", "refund of an order", 2), ("b", "weather", 1)], "key string, text string, n int"), "n")
    assert [(x["id"], x["key"]) for x in store.memory().orderBy("id").collect()] == [(1, "k"), (2, "b"), (3, "a")]
    assert store.recall("refund of an order", k=1).first()["id"] == 3
    assert store.recall_decayed("refund of an order", 60.0, k=1).first()["id"] == 3


def test_sessions_and_cache(store):
    store.session_set("s", "data", ttl=10)
    store.now[0] += 9
    assert store.session_get("s") == "data"
    store.now[0] += 9
    assert store.session_get("s") == "data"
    store.now[0] += 10
    assert store.session_get("s") is None
    store.tool_cache_put("web", "what is spark", "answer", ttl=60)
    assert store.tool_cache_get("web", "what is spark")["outcome"] == "exact"
    assert store.tool_cache_get("web", "spark is what")["outcome"] == "near"
    assert store.tool_cache_get("web", "something else entirely") is None


def test_traces(store):
    store.record_span("t", "a", "root")
    store.record_span("t", "b", "child", parent_id="a")
    store.close_span("a", 2000.0)
    assert [(x["span_id"], x["status"]) for x in store.trace("t").collect()] == [("a", "ok"), ("b", "open")]
    assert store.subtree("a").count() == 2
    with pytest.raises(KeyError):
        store.close_span("zzz", 1.0)


def test_registries(store):
    assert [store.put("prompts", "p", x) for x in ("a\nb", "a\nc")] == [1, 2]
    store.tag("prompts", "p", 1, "prod")
    assert store.get("prompts", "p", "prod").first()["content"] == "a\nb"
    assert store.diff("p", 1, 2).split("\n") == [" a", "-b", "+c"]
    store.delete_version("prompts", "p", 2)
    assert store.get("prompts", "p").first()["version"] == 1 and store.put("prompts", "p", "d") == 3
    assert store.search("prompts", "a b", k=1).first()["version"] == 1
    with pytest.raises(KeyError):
        store.tag("prompts", "p", 2, "gone")
    assert store.dataset_add("d", '["one", {"id": "k", "text": "two", "split": "train"}]') == 1
    assert [x["text"] for x in store.dataset_sample("d", None, 5).collect()] == ["one", "two"]
    assert store.dataset_sample("d", 1, 5, "train").count() == 1
    store.dataset_create("only-schema")
    assert [x["name"] for x in store.names("datasets").collect()] == ["d", "only-schema"]


def test_evaluation_and_replay(store):
    run = store.eval_start("d", "m", "judge")
    store.eval_score(run, "r1", 0.2, "bad output")
    store.eval_score(run, "r1", 0.3, "bad output")
    store.eval_score(run, "r2", 0.9)
    with pytest.raises(ValueError):
        store.eval_score(run, "r3", 1.5)
    assert store.eval_failures(run).count() == 1
    store.eval_end(run)
    with pytest.raises(ValueError):
        store.eval_score(run, "r3", 0.5)
    assert store.eval_summary().first()["n"] == 2 and store.eval_runs("d").first()["status"] == "completed"
    for i in range(3):
        store.replay_capture("t", "llm_call", f'{{"q": {i}}}', f'"o{i}"')
    replay = store.replay_start("t", "cached", [(1, "skip", None)])
    store.replay_record(replay, 2, '"changed"')
    assert [x["differs"] for x in store.replay_diff(replay).collect()] == [False, True, True]
    with pytest.raises(IndexError):
        store.replay_record(replay, 9, "x")


def test_spend_documents_and_snapshots(store, tmp_path):
    store.cost_record("acme", "m", 1, 2, 9.0, input_text="long question")
    store.set_budget("acme", "daily", 10.0)
    store.now[0] += 1
    assert store.budget_alerts().first()["status"] == "warning" and store.cost_total(tenant="acme") == 9.0
    assert store.cost_aggregate("prompt").first()["bucket"] == "(none)" and store.expensive_clusters().count() == 1
    store.delete_budget("acme")
    assert store.budget_status("acme").first()["status"] == "nobudget"
    store.doc_ingest("file:///a", "alpha beta " * 200)
    store.doc_ingest("file:///a", "gamma delta")
    hit = store.doc_search("gamma", 3).first()
    assert (hit["uri"], hit["version"], hit["chunk_index"]) == ("file:///a", 2, 0)
    store.doc_delete("file:///a")
    assert store.documents().count() == 0
    store.remember("k", "text")
    assert store.export(f"file://{tmp_path}/export") == 1
    assert store.snapshot(f"file://{tmp_path}/copy").count() > 0
    with pytest.raises(FileExistsError):
        store.restore(f"file://{tmp_path}/copy")
    store.restore(f"file://{tmp_path}/copy", force=True)
    assert store.memory().count() == 1
    store.audit("root", "COMPACT", "ok", "acme")
    assert store.audit_recent("acme").count() == 1 and store.info().count() > 20


def test_filters_of_other_commands_do_not_reach_recall(store):
    store.remember("a", "refund request", kind="note")
    assert store.recall("refund", filter_json='{"status": "ok", "prefix": "x", "since": 5, "until": 9, "trace_id": "t", "kind": "note"}').count() == 1


def test_writes_are_followed_by_retention_cap_and_compaction(spark, tmp_path):
    now = [1000.0]
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: now[0], retention=500.0, cap=70)
    s.remember_batch([("k", f"text {i}") for i in range(70)])
    now[0] += 100
    assert s.remember_batch([("k", f"later {i}") for i in range(14)]) == list(range(71, 85))
    # 14 rows beyond the cap are a fifth of the live ones: the memory was rewritten
    assert s.memory().count() == 70 and s.read("memory").count() == 70 and s.read("forgotten").count() == 0
    assert s.read("postings").select("id").distinct().count() == 70 and s._generation("memory") == 1
    assert s.recall("later", k=3).where("text like 'later%'").count() == 3
    now[0] += 450
    assert s.remember("k", "new") == 85
    assert s.memory().where("created_at < 1050").count() == 0
    with pytest.raises(ValueError):
        s.remember("k", "x", embedding=[1.0, 2.0])


def test_a_crash_before_the_switch_leaves_the_old_memory(store, monkeypatch):
    store.remember_batch([("a", "one"), ("b", "two")])
    store.forget(1)
    from reverie.sources import tables

    real = store._save
    monkeypatch.setattr(store, "_save", lambda name, df, path: (_ for _ in ()).throw(OSError("lost")) if name == "postings" and "-1" in path else real(name, df, path))
    with pytest.raises(OSError):
        store.compact()
    assert [x["id"] for x in store.memory().collect()] == [2] and store.read("forgotten").count() == 1
    monkeypatch.undo()
    assert store.compact() == 1 and [x["id"] for x in store.memory().collect()] == [2] and store.read("memory").count() == 1
    assert tables.get_object and store.remember("c", "three") == 3


def test_purges(store):
    store.session_set("short", "x", ttl=5)
    store.session_set("long", "y", ttl=500)
    store.tool_cache_put("web", "a", "r", ttl=5)
    store.tool_cache_put("web", "b", "r", ttl=500)
    store.remember_idempotent("once", "k", "text", ttl=5)
    store.now[0] += 10
    assert (store.session_purge(), store.tool_cache_purge(), store.purge_idempotency(5)) == (1, 1, 1)
    assert (store.session_purge(), store.tool_cache_purge(), store.purge_idempotency(5)) == (0, 0, 0)
    assert store.session_get("long") == "y" and store.tool_cache_get("web", "b")["outcome"] == "exact" and store.read("tool_cache").count() == 1


def test_key_values(store):
    store.kv_put("a/1", "x")
    store.kv_batch({"a/2": "y", "b/1": "z"})
    store.kv_delete("a/1")
    assert store.kv_get("a/1") is None and store.kv_get("a/2") == "y" and store.kv_count() == 2
    assert [x["key"] for x in store.kv_scan("a/").collect()] == ["a/2"]


def test_ended_runs_and_alerts(store):
    for i in range(2):
        store.replay_capture("t", "llm_call", f'{{"q": {i}}}', f'"o{i}"')
    one, two = store.replay_start("t"), store.replay_start("t")
    store.replay_record(one, 0, '"x"')
    assert {x["run_id"]: x["status"] for x in store.replay_states().collect()} == {one: "running", two: "pending"}
    store.replay_end(one)
    store.replay_end(two, "broke")
    store.replay_set_trace(one, "t2")
    for run in (one, two):
        with pytest.raises(ValueError):
            store.replay_record(run, 1, '"y"')
    runs = {x["run_id"]: x for x in store.replay_runs("t").collect()}
    assert runs[one]["replay_trace_id"] == "t2" and runs[two]["status"] == "failed" and runs[two]["reason"] == "broke"
    stats = store.replay_stats().first()
    assert (stats["sessions"], stats["invocations"], stats["runs"], stats["running"], stats["completed"], stats["failed"]) == (1, 2, 2, 0, 1, 1)
    a, b = store.eval_start("d", "m", "judge"), store.eval_start("d", "m", "judge")
    for run, scores in ((a, (0.2, 0.9, 0.5)), (b, (0.8, 0.1, 0.5))):
        for i, score in enumerate(scores):
            store.eval_score(run, f"r{i}", score)
        store.eval_end(run)
    assert store.eval_compare_summaries(a, b).first()["mean_delta"] == pytest.approx(-0.2 / 3)
    assert [x["row_id"] for x in store.eval_changes(a, b, "regressed").collect()] == ["r1"]
    store.set_budget("acme", "daily", 10.0)
    for cost in (7.0, 2.0, 0.5, 2.0):
        store.cost_record("acme", "m", 1, 1, cost)
        store.now[0] += 1
    assert [(x["row_id"]) for x in store.read("changes").where("table = 'budget'").orderBy("at").collect()] == ["warning", "exceeded"]


def test_objects(spark, tmp_path, store):
    from reverie.sources import tables

    path = f"file://{tmp_path}/objects/a.bin"
    tables.put_object(spark, path, b"\x00\xffabc")
    assert tables.get_object(spark, path) == b"\x00\xffabc" == store.doc_source(path)
    assert tables.delete_object(spark, path) and not tables.delete_object(spark, path)
