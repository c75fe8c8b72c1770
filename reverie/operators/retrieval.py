"""Text and vector retrieval and their fusion.

A ranking is a frame of ``id, score``; ties go to the smaller id everywhere.
Queries are scored in one pass over the rows: only the query's terms are counted and
only top-k rows leave a partition.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reverie.functions.scalars import EPSILON, cosine, dot, tokens
from reverie.sources.scratch import cut

#: Okapi parameters.
K1, B = 1.2, 0.75
#: Rank constant of the fusion (fixed value).
RRF_K = 60
#: White space between the words of an embedded text.
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.orderBy(F.col("score").desc(), "id").limit(k)


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def term_counts(rows: DataFrame, terms: list[str], text: Column, *others: Column) -> DataFrame:
    """``others``, ``_len`` and one count ``_f<i>`` for each term."""
    split = rows.select(*others, tokens(F.coalesce(text, F.lit(""))).alias("_t"))
    names = [c for c in split.columns if c != "_t"]
    return split.select(*names, F.size("_t").alias("_len"), *(occurrences(F.col("_t"), t).alias(f"_f{i}") for i, t in enumerate(terms)))


def okapi(counted: DataFrame, terms: int) -> DataFrame:
    """Rows of ``term_counts`` with a term, with their score; the corpus figures are one aggregate."""
    figures = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(terms))).first()
    score: Column = F.lit(0.0)
    for i in range(terms):
        df, f = figures[f"d{i}"], F.col(f"_f{i}").cast("double")
        idf = F.log(F.lit(1 + (figures["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.lit(float(figures["mean"] or 1.0))))
    return counted.where(" or ".join(f"_f{i} > 0" for i in range(terms))).withColumn("score", score)


def bm25(docs: DataFrame, query: str, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, score`` of the rows with a term of the query; an empty query finds nothing.

    Texts are read once: each row's counts of the query's terms are written out, and the corpus
    figures (rows, mean length, document frequencies) and the scores follow from those few numbers.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    return okapi(cut(term_counts(docs, terms, F.col(text_col), F.col(id_col).alias("id"))), len(terms)).select("id", "score")


#: Buckets of the terms in a text index.
TERM_BUCKETS = 64


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def text_index(rows: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``bucket, term, id, f``: how often each row has each of its terms. Written in folders by bucket, a query reads its terms' buckets alone."""
    words = rows.select(F.col(id_col).alias("id"), F.explode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("f")).select(term_bucket(F.col("term")).alias("bucket"), "term", "id", "f")


def term_total(text: Column) -> Column:
    """The length of a text in terms, which is kept beside its row."""
    return F.size(tokens(F.coalesce(text, F.lit("")))).cast("long")


def bm25_indexed(index: DataFrame, rows: DataFrame, query: str) -> DataFrame:
    """As ``bm25`` over ``rows`` (``id, n_terms``) from a text index; entries of other rows are left out. No text is read."""
    terms = query_terms(query)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    of_spark = rows.sparkSession
    buckets = [r[0] for r in of_spark.createDataFrame([(t,) for t in terms], "term string").select(term_bucket(F.col("term"))).collect()]
    found = cut(index.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)).join(rows, "id").select("id", "term", "f", "n_terms"))
    n, mean = rows.agg(F.count("*"), F.avg("n_terms")).first()
    frequency = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    weight = F.lit(0.0)
    for t, df in frequency.items():
        weight = F.when(F.col("term") == t, math.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(weight)
    f = F.col("f").cast("double")
    part = weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_terms") / F.lit(float(mean or 1.0))))
    return found.groupBy("id").agg(F.sum(part).alias("score"))


def vector_scores(rows: DataFrame, query: list[float], *, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Cosine similarity of every row to the query."""
    return rows.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), F.array(*map(F.lit, map(float, query)))).alias("score"))


def hyperplanes(dim: int, bits: int = 8, tables: int = 6, seed: int = 7) -> list[list[list[float]]]:
    """Random directions: ``bits`` for each of ``tables`` hash tables."""
    import random

    rng = random.Random(seed)
    return [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]


def sign_buckets(vec: Column, planes: list[list[list[float]]]) -> Column:
    """A vector's bucket in each table, as an array: the signs of its products with the table's directions."""
    out = []
    for t, table in enumerate(planes):
        place: Column = F.lit(t << len(table))
        for i, plane in enumerate(table):
            place = place + F.when(dot(vec, F.array(*map(F.lit, plane))) > 0, 1 << i).otherwise(0)
        out.append(place)
    return F.array(*out)


def approximate_top(indexed: DataFrame, query: list[float], planes: list[list[list[float]]], k: int, *, vec_col: str = "embedding", bucket_col: str = "buckets", probes: int = 48) -> DataFrame:
    """Top k by cosine among the rows that share one of the query's ``probes`` likeliest buckets in a table.

    A bucket is likelier the less the query must move to reach it: the sum of its squared
    products with the directions whose signs differ. Measured recall is in the README.
    ``indexed`` holds ``sign_buckets`` of its vectors, computed once when rows are written.
    """
    near_buckets = []
    for t, table in enumerate(planes):
        products = [sum(a * b for a, b in zip(query, plane, strict=False)) for plane in table]
        own = sum((x > 0) << i for i, x in enumerate(products))
        moved = lambda flips, products=products: sum(x * x for i, x in enumerate(products) if flips >> i & 1)
        near_buckets += [(t << len(table)) + (own ^ flips) for flips in sorted(range(1 << len(table)), key=moved)[:probes]]
    near = indexed.where(F.arrays_overlap(F.col(bucket_col), F.array(*map(F.lit, near_buckets))))
    return top(vector_scores(near, query, vec_col=vec_col), k)


#: Rows on either side of a block of ``best_matches``.
BLOCK_ROWS = 4096


def _filled(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, shorter ones filled up with zeros, and which are null or hold a null."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    values, gaps = flat.cast(pa.float64()).fill_null(0.0).to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)
    out, blank = np.zeros((len(lengths), dim)), vectors.is_null().to_numpy(zero_copy_only=False).copy()
    owner, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[owner, place] = values
    blank[owner[gaps]] = True
    out[blank] = 0.0
    return out, blank


def _alike(x: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Numbers of classes of equal vectors."""
    rows = np.ascontiguousarray(np.hstack([x, blank[:, None]]))
    return np.unique(rows.view([("", f"V{rows.shape[1] * 8}")]).ravel(), return_inverse=True)[1].reshape(-1)


def _nth(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` (as for ``lexsort``), and each one's place, from 0, among those equal in all keys but the first."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys[1:]:
        new[1:] |= key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    return order, np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))


def _block_matches(asked: pa.Table, held: pa.Table, k: int, digits: int, least: float | None, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``asked`` and ``held`` (id, vector) and scores of the pairs that can be among a query's ``k`` best.

    All products come from one matrix product, which sums in an order of its own: it only rules out.
    What is near the k-th best is scored again from the first component on. Equal vectors are looked at
    once; of equal scores only the smallest ids are kept, by rounded score where the rounding is certain.
    """
    asked_v, held_v = (t.column(1).combine_chunks() for t in (asked, held))
    dim = max([1, *(x for v in (asked_v, held_v) for x in v.value_lengths().drop_null().to_pylist())])
    (q, q_blank), (x, x_blank) = _filled(asked_v, dim), _filled(held_v, dim)
    ids = np.unique(held.column(0).to_numpy(), return_inverse=True)[1].reshape(-1)
    keep = k + (int(np.bincount(ids).max()) if others else 0)  # a query's own rows may be among them
    order, nth = _nth(ids, _alike(x, x_blank))
    of_held = order[nth < keep]
    x, x_blank, ids = x[of_held], x_blank[of_held], ids[of_held]
    _, of_class, class_of = np.unique(_alike(q, q_blank), return_index=True, return_inverse=True)
    q, q_blank = q[of_class], q_blank[of_class]
    norm = lambda v: np.sqrt(np.cumsum(v * v, axis=1)[:, -1])
    q_norm, x_norm = norm(q), norm(x)
    slack = 1.01 * 10.0**-digits + 1e-9
    found_q, found_x, found_s = [], [], []
    step, n = max(1, (1 << 20) // len(x)), min(keep, len(x))
    for start in range(0, len(q), step):
        part = slice(start, start + step)
        rough = (q[part] @ x.T) / np.maximum(np.outer(q_norm[part], x_norm), EPSILON)
        rough[q_blank[part]] = -3.0
        rough[:, x_blank] = -3.0
        own = np.arange(len(rough))
        if least is not None:
            own = np.flatnonzero(~(rough.max(axis=1) < least - slack))
            rough = rough[own]
        cutoff = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n, None]
        near = np.where(np.isnan(cutoff), np.isnan(rough), ~(rough < cutoff - slack))
        if least is not None:
            near &= ~(rough < least - slack)
        i, j = np.nonzero(near)
        i = own[i] + start
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            score = np.cumsum(x[b] * q[a], axis=1)[:, -1] / np.maximum(x_norm[b] * q_norm[a], EPSILON)
            blank = q_blank[a] | x_blank[b]
            scaled = score * 10.0**digits + 0.5
            key = np.where(np.abs(scaled - np.round(scaled)) < 1e-4, scaled - 0.25, np.floor(scaled))
            key = np.where(blank, -np.inf, np.where(np.isnan(score), np.inf, key))
            picked, nth = _nth(ids[b], key, a)
            picked = picked[nth < keep]
            found_q.append(a[picked])
            found_x.append(b[picked])
            found_s.append(np.where(blank, -np.inf, score)[picked])
    i, j, score = (np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in ((found_q, np.int64), (found_x, np.int64), (found_s, np.float64)))
    first, last = np.searchsorted(i, class_of, "left"), np.searchsorted(i, class_of, "right")
    who = np.repeat(np.arange(len(class_of)), last - first)
    at = np.arange(len(who)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
    return who, of_held[j[at]], score[at]


def best_matches(queries: DataFrame, rows: DataFrame, k: int, digits: int, *, least: float | None = None, others: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``group, q, id, score``: pairs of one group with their cosine, among them each query's ``k`` best by score rounded to ``digits``, ties to the smaller id.

    ``queries`` has ``group, q, embedding`` and ``rows`` ``group, id, embedding``; ``others`` leaves out
    pairs with one id, ``least`` those of a smaller rounded score. Every pair is looked at: both sides are dealt to blocks of about
    ``block_rows``, each pair of blocks is one matrix product, and a few pairs a query leave it.
    A score is null where a vector is null or holds a null.
    """
    queries, rows = (df.where(F.col("group").isNotNull()) for df in (queries, rows))
    if others:
        queries, rows = queries.where("q is not null"), rows.where("id is not null")
    blocks = lambda df, name: df.groupBy("group").agg(F.ceil(F.count("*") / block_rows).alias(name))
    counts = blocks(queries, "_nq").join(blocks(rows, "_nr"), "group")
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).alias("i" if n == "_nq" else "j")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("i" if n == "_nq" else "j")
    asked = queries.join(counts, "group").select(F.col("group").alias("g"), place("q", "_nq"), every("_nr"), "q", F.col("embedding").alias("e"))
    held = rows.join(counts, "group").select("group", every("_nq"), place("id", "_nr"), "id", "embedding")
    schema = "group {}, q {}, id {}, score double".format(*(df.schema[c].dataType.simpleString() for df, c in ((queries, "group"), (queries, "q"), (rows, "id"))))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.select(["q", "e"]), right.select(["id", "embedding"])
        empty = not left.num_rows or not right.num_rows
        with np.errstate(all="ignore"):  # components may be NaN or as large as can be
            who, at, score = (np.empty(0, dtype=np.int64),) * 3 if empty else _block_matches(left, right, k, digits, least, others)
        q, ids, group = left.column("q").take(pa.array(who)), right.column("id").take(pa.array(at)), pa.array([key[0].as_py()] * len(who), key[0].type)
        return pa.table({"group": group, "q": q, "id": ids, "score": pa.array(score.astype(np.float64), mask=np.isneginf(score.astype(np.float64)))})

    found = asked.groupBy("g", "i", "j").cogroup(held.groupBy("group", "i", "j")).applyInArrow(run, schema).withColumn("score", F.round("score", digits))
    if others:
        found = found.where("q <> id")
    return found if least is None else found.where(F.col("score") >= least)


def hash_embedding(text: Column, dim: int) -> Column:
    """Counts of hashed lower-case words, scaled to unit length; an empty text is the zero vector.

    One histogram for each text, in Arrow batches; a worker remembers the places of words.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                v = [0.0] * dim
                for word, n in Counter(_SPACE.split(t)).items():
                    if word:
                        if (at := places.get(word)) is None:
                            if len(places) > 500_000:
                                places.clear()
                            at = places[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim
                        v[at] += n
                norm = max(math.sqrt(sum(x * x for x in v)), 1e-6)
                out.append([x / norm for x in v])
            yield pd.Series(out)

    return run(F.lower(F.coalesce(text, F.lit(""))))


def hash_query(text: str, dim: int) -> list[float]:
    """As ``hash_embedding``, for a query text on the driver."""
    v = [0.0] * dim
    for word in text.lower().split():
        v[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = max(sum(x * x for x in v) ** 0.5, 1e-6)
    return [x / norm for x in v]


def embedder(spec: str):
    """``hash:<dim>`` as a pair of functions: column embedding and query embedding. Providers with a network are not offered."""
    kind, _, arg = spec.partition(":")
    if kind != "hash" or not arg.isdigit() or not 4 <= int(arg) <= 1024:
        raise ValueError(f"unknown embedder {spec!r}; use hash:<4..1024>")
    return (lambda text: hash_embedding(text, int(arg))), (lambda text: hash_query(text, int(arg)))


def rrf(rankings: list[DataFrame], *, k: int = RRF_K, n: int = 10) -> DataFrame:
    """Reciprocal-rank fusion: ``id, score`` with the sum of 1 / (k + rank) over the rankings.

    Each ranking is a short list (a top-k), so ranking it in one window moves few rows.
    """
    ranked = None
    for r in rankings:
        part = r.select("id", (1.0 / (k + F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))).alias("part"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return top(ranked.groupBy("id").agg(F.sum("part").alias("score")), n)


def hybrid(docs: DataFrame, query: str, *, spec: str = "hash:32", k: int = 10, filtered: Column | None = None, id_col: str = "id", text_col: str = "text", vec_col: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Lexical and vector candidates fused; a predicate is applied before the candidates are chosen.

    Candidates per ranking: max(3k, 32), with a predicate max(8k, 128). With a text ``index`` (and ``n_terms`` and
    vectors kept in ``docs``) no text is read. Otherwise texts are read
    once: counts of the query's terms and the vector score, a few numbers a row, are
    written out, and the two candidate lists are taken from them.
    """
    spark = docs.sparkSession
    column, of_query = embedder(spec)
    per = max(3 * k, 32) if filtered is None else max(8 * k, 128)
    rows = docs if filtered is None else docs.where(filtered)
    near = lambda v: cosine(v, F.array(*map(F.lit, of_query(query))))
    terms = query_terms(query)
    if index is not None and vec_col is not None:
        lists = [top(rows.select(F.col(id_col).alias("id"), near(F.col(vec_col)).alias("score")), per).collect()]
        if terms and lists[0]:
            lists.append(top(bm25_indexed(index, rows.select(F.col(id_col).alias("id"), "n_terms"), query), per).collect())
    else:
        vec = F.col(vec_col) if vec_col else column(F.col(text_col))
        rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), vec.alias("_vec"))
        counted = term_counts(rows, terms, F.col("text"), F.col("id"), F.col("_vec"))
        held = cut(counted.select("id", near(F.col("_vec")).alias("near"), *(c for c in counted.columns if c not in ("id", "_vec"))))
        lists = [top(held.select("id", F.col("near").alias("score")), per).collect()]
        if terms and lists[0]:
            lists.append(top(okapi(held, len(terms)).select("id", "score"), per).collect())
    kind = docs.schema[id_col].dataType.simpleString()
    return rrf([spark.createDataFrame([tuple(x) for x in found], f"id {kind}, score double") for found in lists], n=k)


def recall_filter(*, kind: str | None = None, tags_any: list[str] | None = None, min_created: float | None = None, max_created: float | None = None) -> Column:
    """Conjunction of the given conditions; a null kind never matches, time bounds are inclusive."""
    out = F.lit(True)
    if kind is not None:
        out = out & F.coalesce(F.col("kind") == kind, F.lit(False))
    if tags_any:
        out = out & F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags_any))), F.lit(False))
    if min_created is not None:
        out = out & (F.col("created_at") >= min_created)
    if max_created is not None:
        out = out & (F.col("created_at") <= max_created)
    return out


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, ndcg`` of rankings (query_id, rank, id) against true neighbours (query_id, id), binary relevance."""
    hits = found.where(F.col("rank") <= k).join(truth.select("query_id", "id").withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    gain = F.coalesce(F.col("_hit"), F.lit(0)) / F.log2(F.col("rank") + 1.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    sums = hits.groupBy("query_id").agg(F.count("_hit").alias("hits"), F.sum(gain).alias("gain"))
    return sizes.join(sums, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.least("n", F.lit(k))).alias("recall"), (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"))


__all__ = ["EPSILON", "approximate_top", "best_matches", "bm25", "bm25_indexed", "embedder", "hash_embedding", "hash_query", "hybrid", "hyperplanes", "query_terms", "recall_at_k", "recall_filter", "rrf", "sign_buckets", "term_total", "text_index", "top", "vector_scores"]
