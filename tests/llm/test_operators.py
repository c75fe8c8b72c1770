"""The corpus operators against brute force, and on tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverie.llm import bpe, components, hilbert, jaccard, langid, mixing, quality, registry, substrings, syncmers, toxicity, wordpiece
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words int, rep string, h string"
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t ", "en", None, 6), (3, "word", None, "a", 4), (4, "one two three four", "en", "a", 18),
    (5, "ñandú 中文 🎉 <|endoftext|> don't", "es", "b", 30), (6, "x" * 30_000, "en", "b", 30_000), (7, "ab " * 3000, "en", "b", 9000), (8, "ab " * 3000, "en", "b", 9000), (None, "no id at all", "en", "b", 12),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, "r", "h") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with a repeated one and columns whose names clash with the operators' own."""
    return frame(spark, [*ODD, ODD[4]]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def invented(seed, n=220):
    """Texts with near copies, shared passages, exact copies and short ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.2:
            words = r.choice(out)[1].split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        elif kind < 0.35:
            at = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
            text = " ".join(at + passage[r.randint(0, 10) : r.randint(50, 70)] + at[: r.randint(0, 5)])
        elif kind < 0.45:
            text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9)))
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.randint(10, 250)))
        out.append((i, text))
    return out


# --- 1 ---


def test_language_identification_on_held_out_rows(spark):
    rows = registry.queries()["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    long = [r for r in rows if r.held_out and len(r.text) > 60]
    assert sum(r.lang_pred == r.lang for r in long) >= 0.95 * len(long)


def test_language_of_odd_texts(spark, odd, empty):
    model = langid.fit_language_model(odd)
    found = {r.doc_id: r for r in langid.identify_language(odd, model).collect()}
    assert all(found[k].language == "und" and found[k].score == 0 for k in (0, 1, 2))
    assert found[6].language in ("en", "es")
    numerals = spark.createDataFrame([(1, "½ ² Ⅷ 12"), (2, "½ a")], "doc_id long, text string")
    assert [r.language == "und" for r in langid.identify_language(numerals, model).orderBy("doc_id").collect()] == [True, False]
    assert langid.fit_language_model(empty) is None
    assert langid.identify_language(empty, model).count() == 0
    assert {r.language for r in langid.identify_language(odd, None).collect()} == {"und"}


def test_buckets_are_counts_of_grams_and_prediction_follows_from_them():
    def brute(text, buckets):
        letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        points = [ord(c) for c in f" {letters} "]
        m, out = 2**32, Counter()
        for n in range(1, 5):
            for i in range(len(points) - n + 1):
                h = (points[i] * 0x9E3779B1 + 1) % m
                for c in points[i + 1 : i + n]:
                    h = ((h ^ (h >> 15)) * 0x85EBCA6B + c * 0xC2B2AE35) % m
                out[(h * 0x27D4EB2F % m) >> (32 - (buckets.bit_length() - 1))] += 1
        return out

    for text in ("Hello, wörld 12 again", "a", "中文 ok"):
        counts = langid.bucket_counts(text, 1 << 10)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == brute(text, 1 << 10)
    model = langid.train(["aaa bbb", "bbb aaa", "xxx yyy", "yyy xxx"] * 10, ["p", "p", "q", "q"] * 10, buckets=1 << 8, dim=4)
    counts = brute("aaa bbb", 1 << 8)
    hidden = sum(n * model.embedding[b].astype(float) for b, n in counts.items()) / sum(counts.values())
    z = (hidden @ model.weights + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert langid.predict(model, "aaa bbb")[0] == "p" == model.languages[int(p.argmax())]
    assert langid.predict(model, "aaa bbb")[1] == pytest.approx(float(p.max()), abs=1e-6)


def test_samples_are_bounded_whatever_repeats(spark):
    from reverie.llm.common import bounded_rows

    rows = [(None, f"t{i}", "a") for i in range(500)] + [(7, "same", "a")] * 500 + [(i, "x", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = bounded_rows(df, ["doc_id", "text"], F.col("lang"), 50).collect()
    assert 10 <= sum(r.lang == "a" for r in found) <= 100 and sum(r.lang == "b" for r in found) == 40
    assert len({(r.doc_id, r.text) for r in found}) == len(found)
    assert len(bounded_rows(df, ["doc_id", "text"], F.col("lang"), 50, most_rows=20).collect()) <= 40


# --- 2 ---


def test_bpe_matches_the_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for rows, source in ((docs, spark.createDataFrame(docs, "doc_id long, text string")), ([(r[0], r[1]) for r in [*ODD, ODD[4]]], odd)):
        expected = Counter()
        for k, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            expected[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.digests(source, bpe.default_vocabulary()).collect())) == expected
    back = bpe.decode(bpe.encode(odd, bpe.default_vocabulary()), bpe.default_vocabulary())
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in [*ODD, ODD[4]])
    assert bpe.digests(empty, bpe.default_vocabulary()).count() == 0


def test_bpe_with_a_small_cache(docs):
    whole, small = bpe.PairIndexBPE(bpe.default_vocabulary()), bpe.PairIndexBPE(bpe.default_vocabulary(), most_cached=50)
    texts = [t for _, t in docs[:40]]
    assert list(whole.encode_batch(texts)) == [ids for t in texts for ids in small.encode_batch([t])]


# --- 3 ---


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 2.0}, {"kill": 2.0})
    f = lambda t: dict(zip(toxicity.FEATURES, g.features(t), strict=True))
    assert f("you idiot")["targeted"] > 0 and f("an idiot")["direct"] > 0
    assert f("not an idiot")["negated"] < f("an idiot")["direct"] and f("not an idiot")["direct"] == 0
    assert f('she said idiot')["reported"] > 0 and f("I will kill")["threat"] > 0
    assert f("idiot. no. idiot")["clauses"] == pytest.approx(math.log(3))
    assert not any(g.features(None)) and not any(g.features("fine words"))
    assert g.score("you idiot") > g.score("not an idiot") > g.score("")


def brute_clause(words, insults, threats):
    """Kind, weight and tags of each hit, by looking at each word's neighbourhood."""
    kinds = []
    for w in words:
        if w in toxicity.NEGATIONS:
            kinds.append("negation")
        elif w in toxicity.TARGETS:
            kinds.append("target")
        elif w in toxicity.REPORTS:
            kinds.append("report")
        elif w == '"':
            kinds.append("quote")
        else:
            kinds.append("insult" if any(w.startswith(s) for s in insults) else "threat" if any(w.startswith(s) for s in threats) else "other")
    out, quoted, reported = [], False, False
    for i, k in enumerate(kinds):
        if k == "quote":
            # a report's effect ends with the quotation that follows it
            quoted, reported = not quoted, False
        elif k == "report" and not quoted:
            reported = True
        if k in ("insult", "threat"):
            hit = [2.0, set()]
            if "negation" in kinds[max(0, i - 3) : i]:
                hit = [hit[0] * 0.25, hit[1] | {"negated"}]
            if quoted or reported:
                hit = [hit[0] * 0.4, hit[1] | {"reported"}]
            near = any(j == "target" for j in kinds[i + 1 : i + 4]) or "target" in kinds[max(0, i - 6) : i] or any(kinds[j] in ("insult", "threat") and "target" in kinds[j + 1 : j + 4] for j in range(max(0, i - 5), i))
            if near:
                hit = [hit[0] * 1.5, hit[1] | {"targeted"}]
            out.append((k == "threat", hit[0], hit[1]))
    return out


def test_composed_machines_agree_with_brute_force():
    r = random.Random(12)
    g = toxicity.Grammar({"idiot": 2.0, "mor": 2.0}, {"kill": 2.0})
    words = ["idiot", "idiots", "moron", "killer", "you", "not", "said", '"', "the", "a", "fine", "idio", "them", "never"]
    for _ in range(3000):
        clause = [r.choice(words) for _ in range(r.randint(1, 14))]
        found = [(k in (toxicity.THREAT, toxicity.AIMED_THREAT), w, set(t)) for k, w, t in g.clause(" ".join(clause))]
        expected = brute_clause(clause, ("idiot", "mor"), ("kill",))
        assert [(a, c) for a, _, c in found] == [(a, c) for a, _, c in expected]
        assert [b for _, b, _ in found] == pytest.approx([b for _, b, _ in expected])
    assert len(g.forward.arcs) > len(toxicity.negation().arcs) * len(toxicity.target().arcs)


def test_long_texts_take_time_in_proportion():
    import time

    g = toxicity.Grammar({"idiot": 2.0}, {})
    seconds = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        assert math.expm1(g.features("idiot ok, " * n + "! x")[-1]) == pytest.approx(1)
        g.features("idiot ok! " * n)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * max(seconds[0], 0.02)


def test_toxicity_on_held_out_rows(spark, odd, empty):
    d = SF.replace("0.001", "0.1")
    rows = registry.queries()["op3_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.85 * sum(r.toxic for r in held) and hits >= 0.85 * sum(r.predicted for r in held)
    labels = spark.createDataFrame([(4, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    grammar = toxicity.fit_toxicity(odd, labels)
    assert grammar.layer is None and toxicity.score_toxicity(odd, grammar).count() == len(ODD) + 1
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


# --- 4 ---


def sets_of(rows):
    low = {i: i + 32 for i in range(65, 91)}
    out = {}
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


@pytest.mark.parametrize(("seed", "dear"), [(1, 32), (2, 2), (3, 1), (4, 3)])
def test_similarity_components_are_exact(spark, seed, dear):
    rows = invented(seed)
    sets = sets_of(rows)
    found = {r.doc_id: r for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), dear_from=dear).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in found.items()} == {k: (len(sets[k]), c) for k, c in brute_components(sets).items()}


def test_short_sets_find_each_other_through_one_deletion_neighbourhoods(spark):
    """Every linked pair of sets with dear segments meets in a group, though no dear segment is a group."""
    r = np.random.default_rng(14)
    fresh = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    sets = []
    for _ in range(12):
        base = fresh(int(r.integers(30, 60)))
        for _ in range(5):
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) > 0.06], fresh(int(r.integers(0, 4)))])))
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j])}
    entries, spare = [], jaccard.bands()[2]
    counts, reached, unaided = np.zeros((2, jaccard.SKETCH), dtype=np.int64), set(), set()
    where: dict[int, dict[str, set]] = defaultdict(lambda: defaultdict(set))
    shares = 0
    for i, s in enumerate(sets):
        for up in (0, 1):
            key, owner, empty, band, use, at, without = jaccard.segments_of([s], up, deletions=True)
            if not use[0]:
                continue
            # a third of all segments are dear, by their keys
            dear = key[key % np.uint64(3) == 0]
            chosen = jaccard.raised(key, owner, empty, at, without, int(spare[band[0]]), dear, counts)
            assert chosen is None or not set(key[chosen].tolist()) & set(dear.tolist())
            shares += chosen is not None and len(chosen) > 0
            for k in key.tolist():
                where[k]["whole"].add(i)
            for k in without.tolist():
                where[k]["without"].add(i)
            given = np.ones(len(key), dtype=int)
            given[empty | np.isin(key, dear)] = 0
            if chosen is None:
                continue
            given[chosen] = 2
            assert given.sum() >= len(key) - spare[band[0]]
            entries.append((i, key, given, at, without))
    for i, key, given, at, without in entries:
        for j in np.flatnonzero(given):
            unaided |= {(min(i, o), max(i, o)) for o in where[int(key[j])]["whole"]}
        for j in np.flatnonzero(given == 2):
            seen = set(where[int(key[j])]["without"])
            for k in without[at == j].tolist():
                seen |= set(where[k]["whole"])
            reached |= {(min(i, o), max(i, o)) for o in seen}
    assert shares > 20 and len(links) > 40 and links <= reached | unaided
    assert reached - unaided


def test_neighbour_groups_join_seekers_and_holders(spark):
    key = np.array([5, 5, 5, 9, 9, 7], dtype=np.uint64) << np.uint64(40)
    value = np.array([4 | jaccard.WHOLE, 8 | jaccard.SEEKS_WHOLE, 12 | jaccard.WITHOUT, 4 | jaccard.WITHOUT, 8 | jaccard.WHOLE, 4 | jaccard.SEEKS_WHOLE], dtype=np.int64)
    rows = [(r["p"].as_py(), bytearray(r["entries"].as_py())) for b in jaccard.dealt(key, value, 4) for r in ({"p": b.column(0)[i], "entries": b.column(1)[i]} for i in range(b.num_rows))]
    df = spark.createDataFrame(rows, "p int, entries binary")
    assert sorted(x.h4 for x in jaccard.neighbour_groups(df).collect()) == [4, 8]


def test_entries_are_what_was_dealt():
    r = np.random.default_rng(3)
    key = np.concatenate([r.integers(0, 2**64, 3000, dtype=np.uint64), np.array([0, 0, 2**64 - 1, 2**64 - 1], dtype=np.uint64)])
    value = r.integers(-(2**63), 2**63, len(key))
    found = jaccard.gathered(jaccard.dealt(key, value, 7))
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(zip(key.tolist(), value.tolist(), strict=True))
    assert not list(jaccard.dealt(key[:0], value[:0], 7)) and not len(jaccard.gathered(iter([]))[0])


def test_groups_are_unpacked_once(spark):
    """A group that several tasks report with the same members is one."""
    who = np.array([3, -4, 5], dtype=np.int64)
    rows = [(7, bytearray(who.tobytes()))] * 3 + [(9, bytearray(who[:2].tobytes()))]
    found = jaccard.members_once(spark.createDataFrame(rows, "gid long, who binary").repartition(3)).collect()
    assert sorted(map(tuple, found)) == [(7, -4), (7, 3), (7, 5), (9, -4), (9, 3)]
    assert jaccard.members_once(spark.createDataFrame([], "gid long, who binary")).count() == 0


def test_similarity_of_odd_rows(spark, odd, empty):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(odd).collect()]
    assert Counter(found) == Counter([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5), (6, 1, 6), (7, 1, 7), (8, 1, 7)])
    assert jaccard.similarity_components(empty).count() == 0


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.12], r.integers(0, 2**63, int(r.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
        if jaccard.linked(x, y):
            assert jaccard.may_link(len(x), len(y), jaccard.bitmap(x), jaccard.bitmap(y))


def test_open_pairs_of_a_large_group(spark):
    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[:40], r.integers(0, 2**63, 20, dtype=np.uint64)])) if i % 3 else np.sort(np.concatenate([base[:57], r.integers(0, 2**63, 3, dtype=np.uint64)])) for i in range(60)]
    info = spark.createDataFrame([(i, len(s), bytearray(jaccard.bitmap(s))) for i, s in enumerate(sets)], "doc_id long, n long, bits binary")
    members = spark.createDataFrame([(9, i, i) for i in range(60)], "gid long, doc_id long, component long")
    whole, cut = ({tuple(x) for x in jaccard.open_pairs(members, info, chunk=n).collect()} for n in (100, 7))
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if jaccard.linked(sets[i], sets[j])}
    assert whole == cut and links <= whole


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: find(k) for k in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5 ---


def test_fingerprints_and_edits(spark, docs):
    rows = {r.doc_id: r for r in registry.queries()["op5_fingerprints"](spark, SF).collect()}
    order = sorted(docs, reverse=True)
    marks = {}
    for i, (k, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint
    long = [r for r in rows.values() if r.n_chars > 1000]
    assert sum(r.near_edited > 0.15 for r in long) > 0.9 * len(long) and sum(r.near_next < 0.1 for r in long) > 0.9 * len(long)


def test_syncmers_do_not_depend_on_context(spark):
    r = random.Random(2)
    words = [[f"v{r.randrange(10_000)}" for _ in range(n)] for n in (80, 60, 60)]
    texts = [(" ".join(words[0]),), (" ".join(words[1] + words[0] + words[2]),)]
    a, b = (set(x.a) for x in spark.createDataFrame(texts, "t string").select(syncmers.anchors(F.col("t")).alias("a")).collect())
    assert a <= b and len(a) > 15


def test_likeness_does_not_jump_with_the_number_of_words(spark):
    words = [f"word{i * i}" for i in range(40)]
    pairs = [(" ".join(words[:n]), " ".join(words[: n + 1])) for n in (14, 15, 16, 30, 31, 32)]
    pairs += [(" ".join(words[:15]), " ".join(words[:33])), ("".join(words) * 4, "".join(words) * 4 + " " + " ".join(words))]
    near = syncmers.likeness(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("b")))
    found = [r.near for r in spark.createDataFrame(pairs, "a string, b string").select(near.alias("near")).collect()]
    assert min(found[:6]) > 0.7 and found[6] > 0.2 and found[7] > 0.5


def test_neighbour_by_key_over_many_ranges(spark):
    rows = [(i * 3 % 1000 - 200, f"t{i}") for i in range(300)] + [(None, "last"), (-200, "t0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, r.text, r.next.text) for r in syncmers.with_next(df, "doc_id", F.xxhash64("text"), ["text"], slices=16).collect())
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, tie[x[1]]), reverse=True)
    assert got == Counter((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))


@pytest.mark.parametrize("slices", [1, 2, 4000])
def test_neighbour_by_key_with_any_number_of_ranges(spark, slices):
    df = spark.range(0, 3000).select((F.col("id") * 7 - 5000).alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(5)
    got = {int(r.text): int(r.next.text) for r in syncmers.with_next(df, "doc_id", F.xxhash64("text"), ["text"], slices=slices).collect()}
    assert got == {i: (i - 1) % 3000 for i in range(3000)}


def test_anchors_and_likeness_by_brute_force(spark):
    r = random.Random(13)
    words = [r.choice("abcdefghij") + r.choice("xyz") for _ in range(60)]
    h = lambda *x: F.xxhash64(*x)
    units = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", "w", h(F.col("w")).alias("h")).collect()
    hashes = [u.h for u in sorted(units)]
    inner = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(hashes, hashes[1:], strict=False))], "i int, a long, b long").select("i", h("a", "b").alias("m")).collect()
    m = [x.m for x in sorted(inner)]
    runs = spark.createDataFrame([(i, m[i], m[i + 3], hashes[i + 2]) for i in range(len(m) - 3)], "i int, a long, b long, c long").select("i", h(h("a", "b"), F.col("c")).alias("k")).collect()
    kmers = [x.k for x in sorted(runs)]
    expected = list(dict.fromkeys(k for i, k in enumerate(kmers) if min(m[i : i + 4]) in (m[i], m[i + 3])))
    assert spark.createDataFrame([(" ".join(words),)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).first().a == expected

    def brute_likeness(x, y):
        p, q = [v for v in x if v in y], [v for v in y if v in x]
        steps = lambda a: set(zip(["-", *a], a, strict=False))
        return len(steps(p) & steps(q)) / len({*x, *y})

    lists = [[f"{r.randrange(30):012x}" for _ in range(20)] for _ in range(30)]
    lists = [list(dict.fromkeys(a)) for a in lists]
    pairs = [(lists[i], lists[j]) for i in range(30) for j in range(i, 30)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(syncmers.likeness(F.col("a"), F.col("b")).alias("l"), "a", "b").collect()
    assert all(x.l == pytest.approx(brute_likeness(x.a, x.b)) for x in got)


def test_a_moved_block_costs_its_edges(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[20:] + words[:20]))], "a string, b string")
    assert df.select(syncmers.likeness(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("b"))).alias("l")).first().l > 0.8


def test_fingerprint_query_on_odd_tables(spark, tmp_path, empty):
    for name, rows in (("odd", [*ODD, ODD[4]]), ("one", ODD[4:5]), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        found = syncmers.op5_fingerprints(spark, folder).collect()
        assert len(found) == len(rows) and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in found)
        if name == "one":
            assert found[0].near_next == 1


def test_fingerprints_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.fingerprint) for r in syncmers.fingerprint(odd).collect()]
    by = dict(rows)
    assert len(rows) == len(ODD) + 1 and by[0] == by[1] and by[7] == by[8] and by[3] != by[1] and by[6]
    assert syncmers.fingerprint(empty).count() == 0


# --- 6 ---


def test_quality_separates_junk(spark, odd, empty):
    d = SF.replace("0.001", "0.1")
    rows = registry.queries()["op6_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.accepted for r in good) > 0.97 * len(good) and sum(not r.accepted for r in bad) > 0.85 * len(bad)
    part = spark.read.parquet(f"{d}/labels.parquet").where("crc32(cast(doc_id as string)) % 4 <> 2")
    model = quality.fit_quality(spark.read.parquet(f"{d}/documents.parquet"), part)
    scored = quality.classify_quality(spark.read.parquet(f"{d}/documents.parquet"), model).join(spark.read.parquet(f"{d}/labels.parquet").where("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id").collect()
    good, bad = [r for r in scored if r.quality], [r for r in scored if not r.quality]
    assert sum(r.accepted for r in good) > 0.97 * len(good) and sum(not r.accepted for r in bad) > 0.9 * len(bad)
    labels = spark.createDataFrame([(4, 1), (7, 1), (None, 0)], "doc_id long, quality int")
    assert quality.fit_quality(odd, labels) is None
    assert all(r.accepted and r.score == 1 for r in quality.classify_quality(odd, None).collect())
    both = quality.fit_quality(odd, spark.createDataFrame([(4, 1), (7, 0), (3, 1), (6, 0)], "doc_id long, quality int"))
    found = quality.classify_quality(odd, both, keep=("doc_id", "text", "n_chars")).collect()
    assert len(found) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in found)
    assert quality.classify_quality(empty, both).count() == 0 and quality.fit_quality(empty, labels) is None


def test_quality_views_see_different_things():
    assert (quality.metadata_view("en", "a", 100) == quality.metadata_view("en", "a", 127)).all()
    assert (quality.metadata_view("en", "a", 100) != quality.metadata_view("en", "b", 100)).any()
    assert quality.metadata_view(None, None, None).sum() == 3
    c = quality.content_view("aab")
    assert (c[: quality.BUCKETS] ** 2).sum() == pytest.approx(1, abs=1e-5) and sorted(np.round(c[: quality.BUCKETS][c[: quality.BUCKETS] > 0] ** 2 * 6)) == [1, 1, 1, 1, 2]
    assert list(c[quality.BUCKETS :]) == pytest.approx(quality.layout("aab"))


def test_each_view_learns_from_what_the_other_is_sure_of(spark):
    r = random.Random(6)
    # the text tells labelled rows apart; the source does so in the unlabelled ones only
    rows = [(i, ("good words here " if i % 2 else "$$$ %%% ### ") * r.randint(3, 9), "en", "mixed", 50) for i in range(80)]
    rows += [(1000 + i, ("good words here " if i % 2 else "$$$ %%% ### ") * r.randint(3, 9), "en", "clean" if i % 2 else "junk", 50) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    before, after = (quality.fit_quality(docs, labels, rounds=n) for n in (0, 2))
    gap = lambda m: float(m.metadata.margin(quality.metadata_view("en", "clean", 50)) - m.metadata.margin(quality.metadata_view("en", "junk", 50)))
    assert abs(gap(before)) < 1e-6 and gap(after) > 0.3


# --- 7 ---


def brute_strip(rows, size):
    seen, out = {}, {}
    for k, text in sorted(rows):
        w = (text or "").encode().split()
        gone, mine = [False] * len(w), []
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if seen.get(x, k) < k:
                gone[i : i + size] = [True] * size
            mine.append(x)
        for x in mine:
            seen.setdefault(x, k)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), kept.decode())
    return out


@pytest.mark.parametrize(("seed", "size"), [(5, 50), (6, 7), (7, 2)])
def test_repeated_passages_are_cut_exactly(spark, seed, size):
    rows = [*invented(seed), (900, "a b " * 200), (901, "b a " * 150), (902, "a b " * 30)]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=size).collect()}
    assert found == brute_strip(rows, size)


def test_shards_of_a_frequent_anchor(spark):
    r = random.Random(8)
    words = [r.getrandbits(64) for _ in range(30)]
    passages = [(1, p, p, [r.getrandbits(64) for _ in range(r.randint(0, 9))] + words[r.randint(0, 9) : r.randint(15, 30)]) for p in range(40)]
    df = spark.createDataFrame([(a, p, d, d % 2 == 0, bytearray(np.array(w, dtype=np.uint64).tobytes())) for a, p, d, w in passages], "anchor long, passage long, doc_id long, copies boolean, words binary")
    found = lambda most: {(x.passage, x.shift + i, x.least) for x in substrings.matched_windows(df, 5, most=most).collect() for i in range(x["count"])}
    windows = {(p, i): any(d2 < d and w[i : i + 5] in [v[j : j + 5] for j in range(len(v) - 4)] for _, _, d2, v in passages) for _, p, d, w in passages for i in range(len(w) - 4)}
    expected = {(p, i, None) for (p, i), known in windows.items() if known} | {(p, i, p) for (p, i), known in windows.items() if not known and p % 2 == 0}
    assert found(1000) == found(6) == expected
    # an anchor's windows meet in shards by their words: none is sent to more than one
    assert substrings.shards(df, 5, 6).count() == len(windows)


def test_rows_that_share_an_id_are_cut_each_for_itself(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, "x " + passage), (2, passage + " tail"), (2, "other " * 3), (2, "y z " + passage), (2, passage + " tail"), (3, None)]
    found = sorted((r.doc_id, r.n_removed, r.kept, r.mark) for r in substrings.strip_repeats(spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, mark int"), size=7, keep=("mark",)).collect())
    assert found == [(1, 0, "x " + passage, 5), (2, 0, "other other other", 5), (2, 12, "tail", 5), (2, 12, "tail", 5), (2, 12, "y z", 5), (3, 0, "", 5)]


def test_anchors_of_a_text_too_long_for_packed_places():
    words = np.random.default_rng(9).integers(0, 2**63, 5000, dtype=np.uint64)
    words[1000:1400] = words[1000]
    whole = substrings.anchored(np.resize(words, (1 << 24) + 100), 50)
    part = substrings.anchored(words, 50)
    n = len(part[0]) - 1  # the last run goes on in the longer text
    assert all((a[:n] == b[:n]).all() for a, b in zip(whole, part, strict=True))
    assert whole[1].sum() == (1 << 24) + 51 and set(part[2]) <= set(whole[2])


def test_automaton_statistics():
    r = random.Random(9)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randint(1, 25))] for _ in range(4)]
        a = substrings.SuffixAutomaton()
        for t in texts[:-1]:
            a.add(t)
        known = {tuple(t[i:j]) for t in texts[:-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        last = texts[-1]
        assert a.statistics(last) == [max((n for n in range(1, i + 2) if tuple(last[i + 1 - n : i + 1]) in known), default=0) for i in range(len(last))]


def test_strip_of_odd_rows(odd, empty):
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.strip_repeats(odd).collect())
    assert found == Counter([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 4, 0), (4, 4, 0), (5, 5, 0), (6, 1, 0), (7, 3000, 0), (8, 3000, 3000)])
    assert substrings.strip_repeats(empty).count() == 0


# --- 8 ---


def greedy(symbols, pieces, longest):
    i = n = 0
    while i < len(symbols):
        j = next((j for j in range(min(len(symbols), i + longest), i, -1) if tuple(symbols[i:j]) in pieces), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_piece_counts_are_greedy(spark, docs, odd, empty):
    r = random.Random(3)
    for _ in range(400):
        vocabulary = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) + r.choice(["", "", "</w>"]) for _ in range(r.randint(1, 14))} | ({"</w>"} if r.random() < 0.5 else set()))
        a, pieces = wordpiece.LongestMatch(vocabulary), {tuple(wordpiece.LongestMatch.symbols(v)) for v in vocabulary}
        for _ in range(8):
            word = [*(r.choice("abc") for _ in range(r.randint(1, 8))), wordpiece.END]
            assert a.count(word) == greedy(word, pieces, 6)
    import json

    path = wordpiece.default_vocabulary()
    with open(path, encoding="utf-8") as f:
        pieces = {tuple(wordpiece.LongestMatch.symbols(v)) for v in json.load(f)["model"]["vocab"]}
    longest, counter = max(map(len, pieces)), wordpiece.PieceCounter(path)
    few = spark.createDataFrame(docs[:25], "doc_id long, text string")
    found = {x.doc_id: x.n_pieces for x in wordpiece.count_pieces(few, path).collect()}
    assert found == {k: sum(greedy([*(counter.of_byte[b] for b in w.encode()), wordpiece.END], pieces, longest) for w in counter.words(t.lower())) for k, t in docs[:25]}
    odd_found = {x.doc_id: x.n_pieces for x in wordpiece.count_pieces(odd, path).collect()}
    assert odd_found[0] == odd_found[1] == odd_found[2] == 0 and odd_found[7] == odd_found[8] and odd_found[6] > 0
    assert wordpiece.count_pieces(empty, path).count() == 0


# --- 9 ---


def brute_nearest(vectors, queries, k):
    fine = [(i, np.array(v, dtype=float)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fine:
        if q in queries:
            scored = sorted((-float((x * v).sum()), i) for i, x in fine if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_of_ties_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 120)]
    vectors += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (220, [])]
    df = spark.createDataFrame([(*v, "x", 1.0) for v in vectors], "vec_id long, embedding array<double>, rank string, score double")
    queries = {i for i, _ in vectors if i % 20 == 0}
    found = defaultdict(list)
    for row in hilbert.nearest(df, df.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row.vec_id, row.score))
        assert row["rank"] == len(found[row.query_id])
    expected = brute_nearest(vectors, queries, 7)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in found for a, b in zip(found[q], expected[q], strict=True))
    assert hilbert.nearest(df.limit(0), df.limit(0)).count() == 0
    three = df.where("vec_id < 3")
    assert hilbert.nearest(three, three, k=7).count() == 6


def recall_of(spark, vectors, every, k, **options):
    """Recall@k against brute force, and the mean share of the table that a query's blocks hold."""
    x = np.array(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = defaultdict(set)
    for row in hilbert.nearest(df, df.where(f"vec_id % {every} = 0"), k=k, **options).collect():
        found[row.query_id].add(row.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:k].tolist()))
    return hits / (k * len(range(0, len(x), every)))


def test_recall_with_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 24))
    chosen = []
    cheapest = hilbert.cheapest
    monkeypatch.setattr(hilbert, "cheapest", lambda *a, **k: chosen.append(cheapest(*a, **k)) or chosen[-1])
    assert recall_of(spark, [centres[i % 30] + 0.25 * r.normal(size=24) for i in range(3000)], 100, 10, least_rows=50) >= 0.9
    # windows of some hundredths of the order are enough where there are clusters
    assert chosen[0][1] < 0.15


@pytest.mark.parametrize("least_rows", [200, 512])
def test_recall_on_uniform_vectors_of_many_blocks(spark, least_rows):
    x = np.random.default_rng(5).normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert recall_of(spark, x, 100, 20, least_rows=least_rows) >= 0.9


def test_blocks_of_a_stretch_are_merged_in_their_task(spark, monkeypatch):
    made, map_arrow = [], hilbert.map_arrow
    monkeypatch.setattr(hilbert, "map_arrow", lambda *a: made.append(map_arrow(*a)) or made[-1])
    x = np.random.default_rng(7).normal(size=(6000, 24))
    assert recall_of(spark, x, 60, 10, least_rows=100, curves=(8,)) >= 0.9
    assert made[-1].count() <= 100 * 8 * 2 * 11  # k + 1 for each stretch that a window touches
    # a bounded number is held; nothing that was found is lost by it
    whole = made[-1].count()
    monkeypatch.setattr(hilbert, "REDUCE_ROWS", 500)
    monkeypatch.setattr(hilbert, "HELD_ROWS", 1000)
    assert recall_of(spark, x, 60, 10, least_rows=100, curves=(8,)) >= 0.9
    assert made[-1].count() >= whole


def test_best_of_keeps_the_best_of_an_id():
    parts = [tuple(map(np.array, p)) for p in (([1, 1, 1, 2], [5, 6, 7, 5], [0.5, 0.9, 0.5, 0.1]), ([1, 1, 2], [5, 8, 5], [0.7, 0.5, 0.2]))]
    assert [x.tolist() for x in hilbert.best_of(parts, 3)] == [[1, 1, 1, 2], [6, 5, 7, 5], [0.9, 0.7, 0.5, 0.2]]


def test_recall_in_one_crowded_cell(spark):
    r = np.random.default_rng(6)
    x = np.ones(16) + 1e-3 * r.normal(size=(4000, 16))
    x[::100] = r.normal(size=(40, 16))
    assert recall_of(spark, x, 50, 10, least_rows=100, most_rows=200) >= 0.9


def test_windows_grow_with_what_is_missed():
    apart = np.array([[0.01] * 90 + [0.3] * 10, [0.3] * 90 + [0.02] * 10])
    assert hilbert.cheapest(apart, (1, 2), 10**6, 10**5, 0.9) == (2, 0.02)
    assert hilbert.cheapest(apart, (1,), 10**6, 10**5, 0.8) == (1, 0.01)
    assert hilbert.cheapest(apart, (1,), 10**6, 10**5, 0.95) == (1, 0.3)
    # with few queries, dealing the vectors to another curve costs more than it saves
    assert hilbert.cheapest(apart, (1, 2), 10**6, 10, 0.95)[0] == 1


def test_hilbert_order_steps_by_one_cell():
    cells = np.array([[i, j] for i in range(16) for j in range(16)])
    walk = cells[np.argsort(hilbert.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# --- 10 ---


def test_shortages_go_to_siblings_first():
    tokens = {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "z"): 100, ("b", "en", "w"): 1000}
    even = lambda path, n: 1.0
    assert mixing.leaf_budgets(tokens, 200, 1, even) == {("a", "en", "x"): 10, ("a", "en", "y"): 40, ("a", "de", "z"): 50, ("b", "en", "w"): 100}
    assert mixing.leaf_budgets(tokens, 1000, 1, even) == {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "z"): 100, ("b", "en", "w"): 790}
    assert sum(mixing.leaf_budgets(tokens, 10**9, 2, even).values()) == 2 * 1210
    assert mixing.leaf_budgets({}, 5, 1, even) == {}


def brute_mix(df, share, epochs, seed):
    """(doc_id, epoch) of what mixing takes: each leaf's whole epochs and the prefix of one more."""
    rows = df.select("doc_id", "text", "lang", "source", *(F.xxhash64(F.lit(seed), F.lit(e).cast("long"), "doc_id").alias(f"e{e}") for e in range(epochs + 1))).collect()
    leaves, domain = defaultdict(list), lambda s: "other" if s is None else f"domain{int(re.search('[0-9]+$', s)[0]) % 4}"
    for x in rows:
        leaves[domain(x.source), x.lang, x.source].append((x, len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))))
    tokens = {leaf: sum(n for _, n in x) for leaf, x in leaves.items()}
    budgets = mixing.leaf_budgets(tokens, int(share * sum(tokens.values())), epochs, mixing.root_weight)
    expected = Counter()
    for leaf, members in leaves.items():
        whole, rest = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        expected.update((x.doc_id, e) for x, _ in members for e in range(whole))
        run = 0
        for x, n in sorted(members, key=lambda m: m[0][f"e{whole}"] % 2**64):
            run += n
            if run > rest or not rest:
                break
            expected[x.doc_id, whole] += 1
    return expected


@pytest.mark.parametrize(("share", "epochs", "slice_rows"), [(0.6, 2, 7), (0.3, 1, 1000), (1.7, 3, 3)])
def test_selection_is_the_prefix_of_seeded_epochs(spark, share, epochs, slice_rows):
    r = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["s0", "s1", "s1", "s1", "s2", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    found = Counter((x.doc_id, x.epoch) for x in mixing.mix(df, domain=mixing.numbered_domain(F.col("source")), share=share, max_epochs=epochs, slice_rows=slice_rows, seed=5).collect())
    assert found == brute_mix(df, share, epochs, 5)


def test_mixing_of_odd_rows(odd, empty):
    domain = mixing.numbered_domain(F.col("source"))
    found = mixing.mix(odd, domain=domain, share=5.0, max_epochs=1).collect()
    assert {r.doc_id for r in found} == {r[0] for r in ODD if r[0] is not None} - {0, 2} | {r.doc_id for r in found if r.n_tokens == 0}
    assert mixing.mix(empty, domain=domain).count() == 0
