"""The pipeline's stages against brute force over what their predecessors kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as p
from reverie.llm import bpe, quality
from tests.conftest import SF
from tests.llm.test_operators import ODD, brute_components, brute_mix, brute_strip, frame, sets_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, results = docs, {}
    for name, stage in p.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(results)}"
        stage(spark, before, SF).write.parquet(path)
        results[name] = before = spark.read.parquet(path)
    names = [n for n, _ in p.STAGES]
    assert all(results[n].columns == docs.columns for n in names[:-1])
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in (docs, *(results[n] for n in names[:-1]))]
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {k for k, _ in rows[1]} == {r.doc_id for r in docs.collect() if model.score(r.text, r.lang, r.source, r.n_chars)[0] >= 0.3}
    assert {k for k, _ in rows[2]} == {k for k, c in brute_components(sets_of(rows[1])).items() if c == k}
    cut = brute_strip(rows[2], 50)
    assert dict(rows[3]) == {k: (cut[k][2] if cut[k][1] else t) for k, t in rows[2] if not cut[k][1] or cut[k][2]}
    assert {k for k, _ in rows[4]} == {k for k, _ in brute_mix(results[names[2]], 0.9, 1, 11)}
    expected = Counter(map(tuple, bpe.digests(results[names[3]], bpe.default_vocabulary()).collect()))
    assert Counter(map(tuple, results[names[4]].collect())) == expected == Counter(map(tuple, p.run(spark, SF).collect()))


def test_odd_and_empty_tables(spark):
    for rows in ([*ODD, ODD[4]], []):
        docs = frame(spark, rows)
        for i, (_, stage) in enumerate(p.STAGES):
            docs = stage(spark, docs, SF)
            assert i == len(p.STAGES) - 1 or docs.columns == p.COLUMNS
        assert docs.count() <= len(rows)


def test_rows_that_share_an_id_are_neither_multiplied_nor_mixed(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "first " + passage, "en", "a", 0), (2, "second " + passage + " end", "en", "a", 0), (2, "another text of that id", "en", "a", 0), (2, "another text of that id", "en", "a", 0)]
    docs = frame(spark, rows)
    found = sorted((r.doc_id, r.text) for r in p.cut_repeats(spark, docs, SF).collect())
    assert found == [(1, "first " + passage), (2, "another text of that id"), (2, "another text of that id"), (2, "second end")]
    # the near copy under id 1 takes all rows of id 2 with it
    assert [r.doc_id for r in p.keep_one_of_each(spark, docs, SF).collect()] == [1]
    apart = docs.where("text not like 'second%'")
    assert p.keep_one_of_each(spark, apart, SF).count() == p.encode(spark, apart, SF).count() == 3
    assert p.mix_sources(spark, apart, SF).count() <= 3
