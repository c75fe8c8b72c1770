"""The best pairs of a group, against all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from reverie.functions.scalars import cosine
from reverie.operators import histories as h
from reverie.operators.retrieval import best_matches


def test_best_matches_of_odd_vectors_and_many_blocks(spark):
    r = np.random.default_rng(8)
    vectors = [[float(x) for x in v] for v in np.round(r.normal(size=(90, 3)), 1)] + [[1.0, 2.0, 3.0]] * 40 + [[1.0, 2.0, 3.0000001]] * 5
    vectors += [None, None, [0.0] * 3, [0.0] * 3, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("nan"), 1.0, 1.0], [2.0, 4.0], [1e-9, 0.0, 0.0], [1e160, 1.0, 0.0], []]
    rows = spark.createDataFrame([(None if i % 31 == 7 else "ab"[i % 5 == 0], i // 2 if i < 6 else i, v) for i, v in enumerate(vectors)], "group string, id long, embedding array<double>").cache()
    a, b = rows.select("group", F.col("id").alias("q"), F.col("embedding").alias("e")), rows
    plain = a.join(b, "group").select("group", "q", "id", cosine(F.col("embedding"), F.col("e")).alias("score"))
    best = lambda df, k: sorted(((x.q, x["rank"], x.id, repr(x.score + 0.0) if x.score is not None else None) for x in df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where(f"rank <= {k}").collect()))
    for k, digits, least, others in ((3, 6, None, True), (1, 9, 0.95, False), (2, 1, None, True)):
        expected = plain.withColumn("score", F.round("score", digits)).where("q <> id" if others else "true").where("true" if least is None else F.col("score") >= least)
        for block in (7, 4096):
            assert best(best_matches(a.withColumnRenamed("e", "embedding"), b, k, digits, least=least, others=others, block_rows=block), k) == best(expected, k)
    assert best_matches(a.withColumnRenamed("e", "embedding").limit(0), b, 3, 6).count() == 0


def test_pairs_of_a_group_do_not_leave_their_block(spark):
    x = np.random.default_rng(9).normal(size=(3000, 8))
    x[::3] = x[0]
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "group string, id long, embedding array<double>")
    found = best_matches(rows.withColumnRenamed("id", "q"), rows, 3, 6, others=True, block_rows=1000)
    assert found.count() <= 3000 * 3 * 5  # 9 million pairs
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 1, 3, 2999):
        s = np.round(unit @ unit[q], 6)
        s[q] = -2
        assert [v.id for v in found.where(f"q = {q}").orderBy(F.col("score").desc(), "id").limit(3).collect()] == np.lexsort((np.arange(3000), -s))[:3].tolist()


def test_cache_lookup_of_many_entries_and_copies(spark):
    x = np.round(np.random.default_rng(10).normal(size=(400, 3)), 1)
    entries = [("web", i, [float(c) for c in v], f"r{i}", 0, 60) for i, v in enumerate([*x, *x])] + [("web", 900, None, "r900", 0, 60), ("other", 901, [1.0, 0.0, 0.0], "r901", 0, 60)]
    cache = spark.createDataFrame(entries, "tool string, args_hash long, embedding array<double>, result string, stored_at long, ttl long")
    asked = [(i, "web", 700 + i if i < 9 else 5000 + i, [float(c) for c in v]) for i, v in enumerate(x)] + [(998, "web", 5000, None), (999, "none", 1, [1.0, 0.0, 0.0])]
    ask = spark.createDataFrame(asked, "lookup_id int, tool string, args_hash long, embedding array<double>")
    found = h.cache_lookup(cache, ask, 30)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {row.lookup_id: (row.outcome, row.result) for row in found.collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-12)
    for i in range(400):
        s = np.round(unit @ unit[i], 9)
        expected = ("exact", f"r{700 + i}") if i < 9 else ("near", f"r{int(np.argmax(s))}") if s.max() >= 0.95 else ("miss", None)
        assert got[i] == expected
    assert got[998] == got[999] == ("miss", None)
