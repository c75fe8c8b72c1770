"""Exact similarity join of word-shingle sets by universe partition and pigeonhole.

Sets are put into bands by size, each band's upper end 1.25 times its lower one
(the inverse of the similarity), so that similar sets are in one band or in
neighbouring ones. For a band, sets that reach the similarity differ in at most
H elements. The universe is hashed into H + 1 + g segments. A set's entries in the index are the hashes of its
segments, for its own band and for the next.

Allocation by cost. A set gives each segment 0 (left out), 1 (found if the other set's segment is equal) or 2
(found if it differs by one element at most), H + 1 in all: then some segment of a linked pair differs
by less than it was given. An entry is dear if many sets share it, as those of frequent passages; segments without
elements are dear as well. A set starts with 1 for each segment that is not dear. At most g dear ones
leave it with H + 1. With more, it is short, and raises as many of its segments to 2 as it lacks: those
whose one-deletion neighbourhoods (the segment without one of its elements, or one element more on the other side) promise the
fewest sets, as counted in sketches of fixed size. A linked pair of which one set is not short is found by an equal segment of that
one; so only short sets have their neighbourhoods indexed. A set that cannot make up H + 1 this way
keeps its dear entries.

Each entry's group of sets is compared with its smallest member first, with
exact intersections. What is linked to it needs no further comparison; the other
pairs of a group are compared where the members are not connected yet. Before an
exact comparison, a parity bitmap of a few bits an element rules pairs out:
the number of its differing bits never exceeds the number of differing elements.

Equal sets are one class throughout, named by a hash of the set until pairs are compared, so that copies count
once; shingles are compared by 64-bit hashes.

Defined results: a null, empty or wordless text has an empty set and links with
nothing, its component is its own doc_id. Rows with a null doc_id are left out.
Repeated rows get equal rows; different texts under one doc_id are one node, with
the links of either. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import WordHasher, cut, drop_table, map_arrow, mix64, only_slots, slot_of, slots_used, table, window_hashes
from reverie.llm.components import components

SIZE = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUMER, DENOM = 80, 100
#: Keys of entries have 56 bits: a chance collision adds candidates, which are compared exactly.
_KEY = np.uint64(0xFFFFFFFFFFFFFF00)


def shingles(hasher: WordHasher, text: str | None) -> np.ndarray:
    """The set of a text as sorted hashes: runs of five words, or the whole of a shorter text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = hasher.words(text, lower=True)
    if not len(words):
        return words
    found = np.sort(window_hashes(words, min(SIZE, len(words))))
    return found[np.r_[True, found[1:] != found[:-1]]]


@lru_cache(maxsize=1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each band: smallest size, number of segments, and g."""
    lows, segments, spare = [], [], []
    low = 1
    while low < 1 << 40:
        high = low * DENOM // NUMER
        # |x ^ y| <= (|x| + |y|) (1 - t) / (1 + t)
        most = 2 * high * (DENOM - NUMER) // (DENOM + NUMER)
        g = 2 + -(-15 * most // 100)
        lows.append(low)
        segments.append(most + 1 + g)
        spare.append(g)
        low = high + 1
    return np.array(lows), np.array(segments), np.array(spare)


def segments_of(sets: list[np.ndarray], up: int, keys: bool = True, deletions: bool = False) -> tuple[np.ndarray, ...]:
    """For the own band (up 0) or the next (1): key (if asked for), owner and emptiness of each segment, the sets' bands and whether they use it.

    With ``deletions``, these follow: of each element, its segment's place and the key of that segment without it.
    """
    lows, segments, _ = bands()
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    band = np.searchsorted(lows, sizes, side="right") - 1 + up
    # a set goes into the next band only if it can reach that band's sizes
    use = (sizes > 0) & ((up == 0) | (sizes * DENOM >= lows[band] * NUMER))
    flat = np.concatenate([s for s, u in zip(sets, use, strict=True) if u] or [np.empty(0, dtype=np.uint64)])
    m = np.where(use, segments[band], 0)
    starts = np.concatenate([[0], np.cumsum(m)])
    of = np.repeat(np.arange(len(sets)), np.where(use, sizes, 0))
    with np.errstate(over="ignore"):
        spread = mix64(flat ^ (np.uint64(0xA5A5) + band[of].astype(np.uint64) * np.uint64(0x1000193)))
        at = starts[of] + (((spread >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        empty = np.ones(starts[-1], dtype=bool)
        empty[at] = False
        owner = np.repeat(np.arange(len(sets)), m)
        if not keys:
            return None, owner, empty, band, use
        total = np.zeros(starts[-1], dtype=np.uint64)
        np.add.at(total, at, mix64(spread))
        segment = (np.arange(starts[-1]) - starts[owner]).astype(np.uint64)
        salt = segment * np.uint64(0x9E3779B97F4A7C15) + band[owner].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        key = mix64(total + salt) & _KEY
        if deletions:
            return key, owner, empty, band, use, at, mix64(total[at] - mix64(spread) + salt[at]) & _KEY
    return key, owner, empty, band, use


def allocate(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners of the entries: all segments with elements, the empty ones of sets with too many of them."""
    found = []
    for up in (0, 1):
        key, owner, empty, band, _ = segments_of(sets, up)
        without = np.bincount(owner[empty], minlength=len(sets))
        keep = ~empty | (without > bands()[2][band])[owner]
        found.append((key[keep], owner[keep]))
    return np.concatenate([k for k, _ in found]), np.concatenate([o for _, o in found])


def slack_of(sets: list[np.ndarray]) -> np.ndarray:
    """How many more entries each set can leave out, in the band where it is fewest."""
    spare, slack = bands()[2], np.full(len(sets), np.iinfo(np.int32).max, dtype=np.int64)
    for up in (0, 1):
        _, owner, empty, band, use = segments_of(sets, up, keys=False)
        without = np.bincount(owner[empty], minlength=len(sets))
        slack = np.where(use, np.minimum(slack, np.where(without <= spare[band], spare[band] - without, 0)), slack)
    return slack


def set_name(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        return int((mix64(s + np.uint64(1)).sum(dtype=np.uint64) ^ mix64(np.array([len(s)], dtype=np.uint64))[0]).view(np.int64))


def bitmap(elements: np.ndarray) -> bytes:
    """Parities of the elements by the low bits of their hashes: a power of two of bits, two to four an element."""
    bits = max(64, 2 << max(0, int(len(elements) - 1).bit_length()))
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(maps: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of fewer bits, ``to`` bytes: halves are joined by exclusive or."""
    while maps.shape[-1] > to:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def may_link(n: int, m: int, a: bytes, b: bytes) -> bool:
    """False only if sets of n and m elements with these bitmaps cannot be similar enough."""
    if min(n, m) * DENOM < max(n, m) * NUMER:
        return False
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) * (DENOM + NUMER) <= (n + m) * (DENOM - NUMER)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if not len(x) or not len(y):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DENOM * common >= NUMER * (len(x) + len(y) - common)


def chunks(ids: list, texts: list, most_chars: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Cuts a batch so that a worker's memory is bounded; a text is never cut."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t or "") > most_chars:
            yield start, i
            start, total = i, 0
        total += len(t or "")
    if start < len(ids):
        yield start, len(ids)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n, h, slack, bits`` of every row: set size, hash of the set, spare entries, parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(ids, texts):
                sets = [shingles(hasher, t) for t in texts[a:b]]
                slack = slack_of(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.int64()), pa.array(slack), pa.array([bitmap(s) for s in sets], pa.binary())],
                    names=["doc_id", "n", "h", "slack", "bits"],
                )

    return map_arrow(docs, run, "doc_id long, n long, h long, slack long, bits binary")


def planes(key: np.ndarray) -> bytes:
    """Keys in ascending order as their differences, byte by byte: the bytes that are mostly 0 stand together and compress."""
    return np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    """The inverse of ``planes``."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def dealt(key: np.ndarray, value: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """``p, entries``: packed (key, value) in the order of keys, one row for each bucket of keys."""
    if not len(key):
        return
    order = np.argsort(key)
    key, value = key[order], value[order]
    p = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    ends = np.r_[cuts[1:], len(p)]
    packed = [planes(key[i:j]) + value[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)]
    for i in range(0, len(cuts), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(p[cuts[i : i + 2000]].astype(np.int32)), pa.array(packed[i : i + 2000], pa.binary())], names=["p", "entries"])


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a task's packed entries, in the order of keys."""
    keys, values = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for batch in batches:
        for packed in batch.column(1).to_pylist():
            half = len(packed) // 2
            keys.append(from_planes(packed[:half]))
            values.append(np.frombuffer(packed, dtype=np.int64, offset=half))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    return key[order], value[order]


def index(docs: DataFrame, buckets: int) -> DataFrame:
    """``p, entries``: packed (key, name of the set) of all sets, dealt to ``buckets`` by key. Equal sets of a chunk count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(ids, texts):
                found = {set_name(s): s for s in (shingles(hasher, t) for t in texts[a:b]) if len(s)}
                if found:
                    key, owner = allocate(list(found.values()))
                    yield from dealt(key, np.array(list(found), dtype=np.int64)[owner], buckets)

    return map_arrow(docs, run, "p int, entries binary")


def listed(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """``gid, h`` of groups (name, members)."""
    sizes = [len(who) for _, who in rows]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([g for g, _ in rows], dtype=np.uint64), sizes).view(np.int64)), pa.array(np.concatenate([who for _, who in rows]))], names=["gid", "h"])


def name_of(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(members.view(np.uint64) * np.uint64(2 * len(members) + 1)).sum(dtype=np.uint64))


def groups(entries: DataFrame, dear_from: int) -> DataFrame:
    """``gid, h, who``: members of every entry that at least two sets have.

    Cheap entries with the same members are one group, a row with its members packed in ``who``. An entry that more
    than ``dear_from`` sets have is dear: its gid is its key, and each member is a row with its name in ``h``.
    """

    def packed(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        gid = np.array([g for g, _ in rows], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(gid), pa.nulls(len(rows), pa.int64()), pa.array([who.tobytes() for _, who in rows], pa.binary())], names=["gid", "h", "who"])

    def single(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        rows = listed(rows)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary())], names=["gid", "h", "who"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name = gathered(batches)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        size = np.diff(np.r_[start, len(key)])
        known: set[int] = set()
        out, dear, members = [], [], 0
        for i, n in zip(start[size > 1], size[size > 1], strict=True):
            who = np.unique(name[i : i + n])
            if len(who) < 2:
                continue
            if len(who) > dear_from:
                dear.append((int(key[i]), who))
                members += len(who)
            elif (gid := name_of(who)) not in known:
                known.add(gid)
                out.append((gid, who))
            if len(out) >= 5000:
                yield packed(out)
                out = []
            if members >= 20_000:
                yield single(dear)
                dear, members = [], 0
        if out:
            yield packed(out)
        if dear:
            yield single(dear)

    return map_arrow(entries, run, "gid long, h long, who binary")


def members_once(packed: DataFrame) -> DataFrame:
    """``gid, h``: the members of packed groups (gid, who); a gid that several tasks report has equal members and counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column(0).to_numpy()
            first = np.r_[last is None or gid[0] != last, gid[1:] != gid[:-1]]
            last = gid[-1]
            who = batch.column(1).filter(pa.array(first)).to_pylist()
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gid[first], [len(w) // 8 for w in who])), pa.array(np.frombuffer(b"".join(who), dtype=np.int64))], names=["gid", "h"])

    return map_arrow(packed.repartition("gid").sortWithinPartitions("gid"), run, "gid long, h long")


# --- one-deletion neighbourhoods of the short sets ---

#: An entry's value is the name of its set without its lowest two bits, and what it is there for.
WHOLE, WITHOUT, SEEKS_WHOLE, SEEKS_WITHOUT = range(4)
SKETCH = 1 << 17


def sketch_slot(key: np.ndarray) -> np.ndarray:
    return (mix64(key ^ np.uint64(0x51ED270B)) >> np.uint64(64 - 17)).astype(np.int64)


def sketch_counts(short: DataFrame) -> np.ndarray:
    """How many whole segments (first row) and segments without an element (second) of the short sets fall into each slot of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(), np.zeros(2 * SKETCH, dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(ids, texts, 600_000):
                sets = [shingles(hasher, t) for t in texts[a:b]]
                for up in (0, 1):
                    key, _, _, _, _, _, without = segments_of(sets, up, deletions=True)
                    counts += np.bincount(sketch_slot(key), minlength=2 * SKETCH)
                    counts += np.bincount(SKETCH + sketch_slot(without), minlength=2 * SKETCH)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    out = np.zeros(2 * SKETCH, dtype=np.int64)
    # at most 2 * SKETCH rows, whatever the number of sets
    for r in map_arrow(short.select("doc_id", "text"), run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(2, SKETCH)


def raised(key, owner, empty, at, without, spare: int, dear: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """Places of the segments of one set that get 2; None if that cannot make up for its dear ones."""
    out = empty | np.isin(key, dear)
    lacking = int(out.sum()) - spare
    if lacking <= 0:
        return np.empty(0, dtype=np.int64)
    open_ = np.flatnonzero(~out)
    if lacking > len(open_):
        return None
    cost = counts[1][sketch_slot(key)] + np.bincount(at, weights=counts[0][sketch_slot(without)], minlength=len(key))
    return open_[np.argsort(cost[open_], kind="stable")[:lacking]]


def neighbourhoods(short: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Index and probes of the short sets (doc_id, text, h, dear: their dear keys, packed): packed (key, value) as in ``index``.

    A set that cannot make up H + 1 has no probes and gets a row with p -1: its packed name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts, names, dear = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in chunks(names, texts, 600_000):
                keys, values, hopeless = [], [], set()

                def put(key: np.ndarray, name: int, what: int, keys=keys, values=values) -> None:
                    keys.append(key)
                    values.append(np.full(len(key), (name & ~3) | what, dtype=np.int64))

                for text, name, costly in zip(texts[a:b], names[a:b], dear[a:b], strict=True):
                    s = [shingles(hasher, text)]
                    if set_name(s[0]) != name:
                        continue  # another text of that doc_id
                    costly = np.frombuffer(costly, dtype=np.uint64)
                    for up in (0, 1):
                        key, owner, empty, band, use, at, without = segments_of(s, up, deletions=True)
                        if not use[0]:
                            continue
                        put(key, name, WHOLE)
                        put(without, name, WITHOUT)
                        chosen = raised(key, owner, empty, at, without, int(bands()[2][band[0]]), costly, counts)
                        if chosen is None:
                            hopeless.add(name)
                            continue
                        put(key[chosen], name, SEEKS_WITHOUT)
                        put(without[np.isin(at, chosen)], name, SEEKS_WHOLE)
                if hopeless:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hopeless), -1, dtype=np.int32)), pa.array([np.int64(x).tobytes() for x in sorted(hopeless)], pa.binary())], names=["p", "entries"])
                if keys:
                    yield from dealt(np.concatenate(keys), np.concatenate(values), buckets)

    return map_arrow(short.select("doc_id", "text", "h", "dear"), run, "p int, entries binary")


def packed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``doc_id, h, gid`` in the order of sets: one row for each with all its gids packed."""

    def listing(names: list[tuple[int, int]], parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in names], pa.int64()), pa.array([h for _, h in names], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "h", "dear"])

    last, held = None, []
    for batch in batches:
        doc, h, gid = (c.to_numpy() for c in batch.columns)
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.empty(0, dtype=np.int64)
        names, parts = [], []
        for i, j in zip(starts, np.r_[starts[1:], len(doc)], strict=True):
            name = (int(doc[i]), int(h[i]))
            if last is not None and name != last:
                names.append(last)
                parts.append(np.concatenate(held))
                held = []
            last = name
            held.append(gid[i:j])
        if names:
            yield listing(names, parts)
    if last is not None:
        yield listing([last], [np.concatenate(held)])


def unpacked_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64))], names=["h"])


def neighbour_groups(entries: DataFrame) -> DataFrame:
    """``gid, h4``: of each key, the sets that seek it and those that have it, where there are such; h4 is h without its lowest two bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = gathered(batches)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        size = np.diff(np.r_[start, len(key)])
        known: set[int] = set()
        out = []
        for i, n in zip(start[size > 1], size[size > 1], strict=True):
            what, name = value[i : i + n] & 3, value[i : i + n] & ~np.int64(3)
            for has, seeks in ((WHOLE, SEEKS_WHOLE), (WITHOUT, SEEKS_WITHOUT)):
                if not (what == seeks).any() or not (what == has).any():
                    continue
                who = np.unique(name[(what == seeks) | (what == has)])
                if len(who) > 1 and (gid := name_of(who)) not in known:
                    known.add(gid)
                    out.append((gid, who))
            if len(out) >= 5000:
                yield listed(out)
                out = []
        if out:
            yield listed(out)

    return map_arrow(entries, run, "gid long, h long").withColumnRenamed("h", "h4")


def sets_of(docs: DataFrame, wanted: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """``doc_id, elements`` (packed hashes) of the rows of ``docs`` whose doc_id is in ``wanted`` (column doc_id).

    A bitset of ``slots`` bits, whatever the number of wanted ids, spares most
    other rows the hashing; those that it lets through do no harm.
    """
    bits = slots_used(wanted, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, use = WordHasher(), np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)
        for batch in batches:
            at = np.flatnonzero(use[batch.column(2).to_numpy()])
            for part in np.array_split(at, max(1, len(at) // 200)):
                if len(part):
                    rows = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([shingles(hasher, t).tobytes() for t in rows.column(1).to_pylist()], pa.binary())], names=["doc_id", "elements"])

    return map_arrow(docs.select("doc_id", "text", slot_of(slots).alias("slot")), run, "doc_id long, elements binary")


def ruled_in(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and bitmaps allow to be linked."""
    one = info.select(F.col("doc_id").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x"))
    two = info.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            yield batch.select([0, 1]).filter(pa.array([may_link(*r) for r in zip(n, m, x, y, strict=True)], pa.bool_()))

    sized = pairs.join(one, "a").join(two, "b").where(F.least("n", "m") * DENOM >= F.greatest("n", "m") * NUMER)
    return map_arrow(sized.select("a", "b", "n", "m", "x", "y"), run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a table of a, b on shared storage) whose whole sets are similar enough."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yes = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    sets = cut(sets)
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a")
    found = cut(map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long"))
    drop_table(sets)
    return found


def open_pairs(members: DataFrame, info: DataFrame, chunk: int = 2048) -> DataFrame:
    """Pairs (a, b) of members of one group in different components that sizes and bitmaps allow.

    A large group is cut into chunks, each pair of which is one block, so that no
    task holds more than two chunks at once.
    """
    cuts = members.groupBy("gid").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cuts"))
    rows = members.join(cuts, "gid").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select(F.xxhash64("gid", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "doc_id", "component", "own", (F.col("own") == F.col("other")).alias("alone"))
    rows = rows.join(info.select("doc_id", "n", "bits"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried: set[tuple[int, int]] = set()  # the same pair stands in many groups

        def small_block(rows: list[tuple]) -> list[tuple[int, int]]:
            rows = sorted(rows, key=lambda r: r[5])
            maps = [(8 * len(r[6]), int.from_bytes(r[6], "little")) for r in rows]
            found = []
            for i, (_, a, comp, own, alone, n, _) in enumerate(rows):
                for j in range(i + 1, len(rows)):
                    _, b, other, there, _, m, _ = rows[j]
                    if n * DENOM < m * NUMER:
                        break
                    if comp == other or (own == there and not alone):
                        continue
                    pair = (a, b) if a < b else (b, a)
                    if pair in tried:
                        continue
                    if len(tried) < 200_000:
                        tried.add(pair)
                    (w, x), (wide, y) = maps[i], maps[j]
                    while wide > w:
                        wide //= 2
                        y = (y >> wide) ^ (y & ((1 << wide) - 1))
                    if (x ^ y).bit_count() * (DENOM + NUMER) <= (n + m) * (DENOM - NUMER):
                        found.append(pair)
            return found

        def large_block(rows: list[tuple]) -> list[tuple[int, int]]:
            doc, comp, own, alone, n = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4, 5))
            found = []
            order = np.argsort(n, kind="stable")
            doc, comp, own, alone, n = doc[order], comp[order], own[order], alone[order], n[order]
            maps = [np.frombuffer(rows[i][6], dtype=np.uint8) for i in order]
            widths = np.array([len(x) for x in maps])
            stacked = {w: np.stack([fold(maps[i], w) for i in range(len(maps)) if widths[i] >= w]) for w in np.unique(widths)}
            offset = {w: np.flatnonzero(widths >= w) for w in stacked}
            for i in range(len(doc) - 1):
                # n ascends, so widths do: partners j > i have at least the width of i
                j = np.arange(i + 1, np.searchsorted(n, n[i] * DENOM // NUMER, side="right"))
                j = j[(comp[j] != comp[i]) & ((own[j] != own[i]) | alone[i])]
                if not len(j):
                    continue
                w = widths[i]
                place = np.searchsorted(offset[w], j)
                apart = np.bitwise_count(stacked[w][place] ^ maps[i]).sum(axis=1, dtype=np.int64)
                found += [(min(doc[i], d), max(doc[i], d)) for d in doc[j[apart * (DENOM + NUMER) <= (n[i] + n[j]) * (DENOM - NUMER)]]]
            return found

        def block(rows: list[tuple]) -> pa.RecordBatch:
            new = small_block(rows) if len(rows) <= 32 else large_block(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.int64())], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    dealt = rows.select("block", "doc_id", "component", "own", "alone", "n", "bits").repartition("block").sortWithinPartitions("block")
    return map_arrow(dealt, run, "a long, b long").distinct()


def similar_classes(docs: DataFrame, *, dear_from: int = 32) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and links between them.

    ``docs`` has doc_id (long, not null) and text. Returns the table
    ``doc_id, n, rep`` (rep: least doc_id with an equal set) and ``a, b``: links
    between rep ids, enough of them that their components are those of all links.
    """
    spark = docs.sparkSession
    info = cut(describe(docs))
    least = info.where("n > 0").groupBy("h", "n").agg(F.min("doc_id").alias("rep"))
    classes = cut(info.join(least, ["h", "n"], "left").select("doc_id", "n", "h", F.coalesce("rep", "doc_id").alias("rep"), "slack"))
    reps = classes.where("n > 0 and doc_id = rep").groupBy("h").agg(F.min("rep").alias("rep"), F.min("slack").alias("slack"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = index(docs, 4 * partitions).repartition(partitions, "p")
    found = cut(groups(entries, dear_from))
    cheap = members_once(found.where("who is not null").select("gid", "who")).join(reps, "h").select("gid", F.col("rep").alias("doc_id"))
    # sets with more dear entries than they can spare
    dear = found.where("who is null").select("gid", "h")
    short = cut(dear.groupBy("h").count().join(reps, "h").where("count > slack").select(F.col("rep").alias("doc_id"), "h"))
    keys = dear.join(short, "h").select("doc_id", "h", "gid")
    lists = map_arrow(keys.repartition("doc_id").sortWithinPartitions("doc_id", "h"), packed_lists, "doc_id long, h long, dear binary")
    texts = cut(only_slots(docs, slots_used(short, 1 << 20), 1 << 20, True).join(lists, "doc_id").select("doc_id", "text", "h", "dear"))
    near = cut(neighbourhoods(texts, sketch_counts(texts), 4 * partitions))
    drop_table(texts)
    by_h4 = short.select(F.col("h").bitwiseAND(F.lit(~3)).alias("h4"), "doc_id")
    widened = neighbour_groups(near.where("p >= 0").repartition(partitions, "p")).join(by_h4, "h4").select("gid", "doc_id")
    # those that neighbourhoods cannot serve keep their dear entries
    hopeless = keys.join(map_arrow(near.where("p < 0"), unpacked_names, "h long").distinct(), "h", "left_semi").select("doc_id", "gid")
    members = cut(cheap.unionByName(widened.unionByName(hopeless).distinct()))
    for done in (found, short, near):
        drop_table(done)
    heads = members.groupBy("gid").agg(F.min("doc_id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = cut(members.join(heads, "gid").select("gid", "doc_id", "head"))
    star = cut(ruled_in(members.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), info))
    links = verify(star, docs)
    named = components(links)
    labelled = members.join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("gid", "doc_id", F.coalesce("component", "doc_id").alias("component"), "head")
    mixed = labelled.groupBy("gid").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u <> v").select("gid")
    rest = cut(open_pairs(labelled.join(mixed, "gid", "left_semi"), info).join(star, ["a", "b"], "left_anti"))
    more = verify(rest, docs)
    for done in (info, members, star, rest):
        drop_table(done)
    return classes.select("doc_id", "n", "rep"), links.unionByName(more)


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id and text, without rows whose id is null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")


def similarity_components(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_class`` for every row of ``docs``.

    ``n_class`` counts the documents whose set equals this one.
    """
    classes, links = similar_classes(nodes_of(docs), **options)
    named = components(links).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    sizes = classes.groupBy("rep").agg(F.count("*").alias("n_class"))
    by_class = sizes.join(named, "rep", "left").select("rep", "n_class", F.coalesce("component_id", "rep").alias("component_id"))
    out = classes.join(by_class, "rep").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_class")
    return out


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
