"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected to a few dimensions and ordered along several Hilbert
curves, each with a projection and a shift of its own. Each curve's order is
cut into blocks at quantiles; a query looks at
its own block and ``reach`` neighbours on either side, and the blocks' best
candidates are merged over all curves and ranked by the exact inner product.
A task walks along a stretch of a curve and merges there what its blocks find, so that
a query has k + 1 rows for each stretch that its window touches, however many blocks that are.

How many curves there are and how wide the windows are follows from a measurement, at every size: the true
neighbours of ``check_queries`` queries (a bounded sample by hash) are found by one pass over the table,
and their places along ``curves[-1]`` curves show which share of the order a window must
cover so that ``target`` of them are seen. Of the numbers in ``curves``, the one with the least
work (vectors dealt and pairs scored) is taken. The windows alone give the result.

The largest inner product becomes a nearest direction by one more coordinate:
a vector x is placed as (x, sqrt(M**2 - |x|**2)) / M with M the largest norm, a
query as (q, 0) / |q|.

Of equal vectors, only the k + 1 with the smallest ids can be among a query's k best, and
equal queries have equal answers (but for themselves), so that both are reduced
to those first: a vector that a third of the rows share costs no more than others. Different
vectors of one cell are spread along the curve by a hash of their id, so that a cell that many
share is cut into blocks like any other stretch.

``fit_rows`` vectors (a bounded sample by hash of the id) fix the block bounds
and scales; every vector is indexed. Measured recall is in the README.

Defined results: vectors that are null, zero, empty, or hold null or non-finite
components take no part; a shorter vector counts as filled up with zeros; of
rows with one id and different vectors each is a candidate and the best counts; rows
with a null id take no part. An empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reverie.llm.common import cut, map_arrow, mix64, table

#: Bits of a place that tell the vectors of one cell apart.
SPREAD_BITS = 15
#: Rows of a stretch of a curve, unless one window has more; found rows that are held before they are reduced, and at most.
STRETCH_ROWS, REDUCE_ROWS, HELD_ROWS = 1 << 18, 1 << 18, 1 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with ``bits``-bit coordinates (rows): Skilling's transform."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.view(np.int64)


class Curves:
    """Projections, shifts and scales of the curves."""

    def __init__(self, dim: int, largest: float, count: int, axes: int, bits: int, seed: int) -> None:
        if axes * bits + SPREAD_BITS > 63:
            raise ValueError("a place must fit into 63 bits")
        rng = np.random.default_rng(seed)
        self.largest, self.bits, self.dim = largest, bits, dim
        self.axes = [np.linalg.qr(rng.normal(size=(dim + 1, min(axes, dim + 1))))[0] for _ in range(count)]
        self.shifts = [rng.uniform(0, 0.5, a.shape[1]) for a in self.axes]
        self.low = self.width = None

    def place(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1)
        if query:
            return np.hstack([vectors / norms[:, None], np.zeros((len(vectors), 1))])
        rest = np.sqrt(np.maximum(0, self.largest**2 - norms**2))
        return np.hstack([vectors, rest[:, None]]) / self.largest

    def scale(self, vectors: np.ndarray) -> None:
        """Coordinates' ranges from a sample."""
        spread = [self.place(vectors, False) @ a for a in self.axes]
        self.low = [np.quantile(s, 0.005, axis=0) for s in spread]
        self.width = [np.maximum(1e-9, np.quantile(s, 0.995, axis=0) - low) for s, low in zip(spread, self.low, strict=True)]

    def first(self, count: int) -> Curves:
        """The first ``count`` curves alone."""
        self.axes, self.shifts, self.low, self.width = (x[:count] for x in (self.axes, self.shifts, self.low, self.width))
        return self

    def places(self, ids: np.ndarray, vectors: np.ndarray, query: bool) -> list[np.ndarray]:
        """Places along each curve, ascending with the curve and within a cell by a hash of the id."""
        placed, top = self.place(vectors, query), 1 << self.bits
        spread = (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - SPREAD_BITS)).view(np.int64)
        out = []
        for a, shift, low, width in zip(self.axes, self.shifts, self.low, self.width, strict=True):
            unit = ((placed @ a - low) / width + shift) / 1.5
            cells = np.clip((unit * top).astype(np.int64), 0, top - 1)
            out.append((hilbert_keys(cells, self.bits) << SPREAD_BITS) | spread)
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part; components as double, or as float where they are given so."""
    v = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled up with zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def true_neighbours(rows: DataFrame, who: np.ndarray, q: np.ndarray, dim: int, k: int) -> list[tuple[int, int]]:
    """(place in ``who``, vec_id) of each query's ``k`` best: one pass by brute force; a partition gives k + 1 a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = np.empty((len(q), 0)), np.empty((len(q), 0), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x_ids = batch.column(0).to_numpy()
            more = np.where(who[:, None] == x_ids, -np.inf, q @ matrix(batch.column(1), dim).T)
            scores, ids = np.hstack([scores, more]), np.hstack([ids, np.broadcast_to(x_ids, more.shape)])
            best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            scores, ids = np.take_along_axis(scores, best, axis=1), np.take_along_axis(ids, best, axis=1)
        i, j = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[i, j]), pa.array(scores[i, j])], names=["q", "vec_id", "score"])

    found = map_arrow(rows, run, "q long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return [(r[0], r[1]) for r in found.withColumn("_n", place).where(F.col("_n") <= k).select("q", "vec_id").collect()]


def best_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best rows (query, id, score) of each query, the best of those with one id; ties to smaller ids."""
    who, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-scores, ids, who))
    who, ids, scores = who[order], ids[order], scores[order]
    new = np.r_[True, (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])]
    who, ids, scores = who[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    nth = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
    return who[nth < keep], ids[nth < keep], scores[nth < keep]


def cheapest(apart: np.ndarray, counts: tuple[int, ...], rows: int, queries: int, target: float, *, deal: float = 100.0) -> tuple[int, float]:
    """Number of curves and half a window's share of the order: the least work by which ``target`` of the neighbours are seen.

    ``apart[c, i]`` is the share of curve c between a query and its neighbour i. Dealing a vector to a
    curve costs as much as scoring it ``deal`` times.
    """
    best = None
    for count in counts:
        need = np.sort(apart[:count].min(axis=0)) if apart.shape[1] else np.zeros(1)
        half = float(need[min(len(need) - 1, int(np.ceil(target * len(need))))])
        work = count * rows * (deal + queries * min(1.0, 2.5 * half))
        if best is None or work < best[0]:
            best = (work, count, half)
    return best[1], best[2]


def nearest(base: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", curves: tuple[int, ...] = (4, 8, 16), axes: int = 12, bits: int = 4, least_rows: int = 512, most_rows: int = 16_384, reach: int = 2, fit_rows: int = 20_000, target: float = 0.95, check_queries: int = 256, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates found for each query.

    A window is made of ``reach`` blocks on either side and the query's own; a block has ``least_rows``
    at least (a smaller table is one block) and ``most_rows`` at most, where the reach grows instead.
    """
    spark = base.sparkSession
    name = [F.xxhash64("v"), F.hash("v")]
    rows = usable(base, id_col, vec_col)
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    rows = cut(rows.select("vec_id", "v", name[0].alias("h1"), name[1].alias("h2")).withColumn("_n", rank).where(F.col("_n") <= k + 1).drop("_n"))
    asked = usable(queries, id_col, vec_col).select(F.col("vec_id").alias("query_id"), "v", name[0].alias("h1"), name[1].alias("h2"))
    total, longest, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    n_asked, longest_asked = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total or not n_asked:
        return spark.createDataFrame([], schema)
    dim = max(longest, longest_asked)

    def drawn(frame: DataFrame, key: str, count: int, of: int) -> DataFrame:
        share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, count / of))
        return frame.where(share).select(key, "v").limit(2 * count)

    def fetched(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = frame.collect()
        return np.array([r[0] for r in found], dtype=np.int64), matrix(pa.array([r[1] for r in found], pa.list_(pa.float64())), dim) if found else np.empty((0, dim))

    model = Curves(dim, float(np.sqrt(largest)), max(curves), axes, bits, seed)
    s_ids, s = fetched(drawn(rows, "vec_id", fit_rows, total))
    if not len(s):
        s_ids, s = fetched(rows.select("vec_id", "v").limit(100))
    model.scale(s)
    orders = [np.sort(x) for x in model.places(s_ids, s, False)]
    count, half = 1, 0.0
    if total > least_rows:
        who, q = fetched(drawn(asked, "query_id", check_queries, n_asked))
        if not len(who):
            who, q = fetched(asked.select("query_id", "v").limit(check_queries))
        pairs = true_neighbours(rows.select("vec_id", "v"), who, q, dim, k)
        wanted = spark.createDataFrame([(i,) for i in sorted({v for _, v in pairs})], "vec_id long")
        n_ids, n = fetched(rows.select("vec_id", "v").join(F.broadcast(wanted), "vec_id"))  # k rows a sampled query
        row_of = {int(i): j for j, i in enumerate(n_ids)}
        share = lambda ids, x, query: np.array([np.searchsorted(o, p) / len(o) for o, p in zip(orders, model.places(ids, x, query), strict=True)])
        left, right = share(who, q, True), share(n_ids, n, False)
        a, b = np.array([i for i, _ in pairs], dtype=np.int64), np.array([row_of[v] for _, v in pairs], dtype=np.int64)
        count, half = cheapest(np.abs(left[:, a] - right[:, b]), curves, total, n_asked, target)
    model.first(count)
    of_block = min(max(half / reach, least_rows / total), max(least_rows, most_rows) / total, 1.0)
    blocks = max(1, round(1 / of_block))
    reach = int(np.ceil(half * blocks)) if blocks > 1 else 0
    bounds = [o[np.minimum(len(o) - 1, (np.arange(1, blocks) * len(o)) // blocks)] for o in orders[:count]]
    packing = np.float32 if dict(rows.dtypes)["v"] == "array<float>" and dict(asked.dtypes)["v"] == "array<float>" else np.float64

    def deal(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = matrix(batch.column(1), dim)
                packed = pa.array([v.tobytes() for v in vectors.astype(packing)], pa.binary())
                for c, places in enumerate(model.places(batch.column(0).to_numpy(), vectors, query)):
                    own = np.searchsorted(bounds[c], places, side="right")
                    for off in range(-reach, reach + 1) if query else (0,):
                        at = np.flatnonzero((own + off >= 0) & (own + off < blocks))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), c * blocks) + own[at] + off), pa.array(np.full(len(at), query)), batch.column(0).take(pa.array(at)), packed.take(pa.array(at))],
                            names=["block", "query", "id", "vector"],
                        )

        return run

    kind = "block long, query boolean, id long, vector binary"
    # one query for each distinct vector, named by its smallest id
    classes = asked.groupBy("h1", "h2").agg(F.min("query_id").alias("class"))
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("query_id"))
    ask = asked.withColumn("_n", first).where("_n = 1").select("query_id", "v")
    dealt = map_arrow(rows.select("vec_id", "v"), deal(False), kind).unionByName(map_arrow(ask, deal(True), kind))
    window = 2 * reach + 1
    stretch = max(window, min(4 * window, STRETCH_ROWS * blocks // total))
    along = F.pmod("block", F.lit(blocks))
    dealt = dealt.withColumn("stretch", F.floor((F.col("block") - along) / blocks) * (blocks // stretch + 1) + F.floor(along / stretch))
    dealt = dealt.repartition("stretch").sortWithinPartitions("stretch", "block", "query")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, base_rows = None, [], [], None
        at_stretch, parts = None, []

        def search(q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            out_q, out_v, out_s = [], [], []
            x_ids, x = base_rows
            keep, step = min(k + 1, len(x)), max(1, (1 << 21) // len(x))
            for i in range(0, len(q), step):
                scores = q[i : i + step] @ x.T
                cutoff = np.partition(scores, len(x) - keep, axis=1)[:, len(x) - keep]
                slack = 1e-9 * (np.abs(cutoff) + np.linalg.norm(q[i : i + step], axis=1) * model.largest)
                for row, least, who, vec in zip(scores, cutoff - slack, q_ids[i : i + step], q[i : i + step], strict=True):
                    at = np.flatnonzero(row >= least)
                    exact = np.cumsum(x[at] * vec, axis=1)[:, -1]  # summed from the first component on
                    order = np.lexsort((x_ids[at], -exact))[:keep]
                    out_q.append(np.full(len(order), who))
                    out_v.append(x_ids[at[order]])
                    out_s.append(exact[order])
            return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

        def given(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        for batch in batches:
            of, is_query, who, stretches = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (is_query[1:] != is_query[:-1])]) if len(of) else []
            for i, j in zip(edges, np.r_[edges[1:], len(of)], strict=True):
                if of[i] != block:
                    block, ids, held, base_rows = of[i], [], [], None
                if stretches[i] != at_stretch:
                    if parts:
                        yield given(best_of(parts, k + 1))
                    at_stretch, parts = stretches[i], []
                vectors = np.frombuffer(b"".join(batch.column(3).slice(i, j - i).to_pylist()), dtype=packing).reshape(-1, dim).astype(np.float64)
                if not is_query[i]:
                    ids.append(who[i:j])
                    held.append(vectors)
                elif held:
                    base_rows = base_rows or (np.concatenate(ids), np.concatenate(held))
                    parts.append(search(who[i:j], vectors))
                    if sum(len(x[0]) for x in parts[1:]) > max(REDUCE_ROWS, len(parts[0][0])):
                        parts = [best_of(parts, k + 1)]
                        if len(parts[0][0]) > HELD_ROWS:
                            yield given(parts.pop())
        if parts:
            yield given(best_of(parts, k + 1))

    found = map_arrow(dealt, best, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumnRenamed("query_id", "class")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.col("score").desc(), "vec_id"))
    found = found.withColumn("_n", place).where(F.col("_n") <= k + 1).drop("_n")
    each = asked.join(classes, ["h1", "h2"]).select("query_id", "class").distinct().join(found, "class").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
