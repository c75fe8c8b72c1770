"""Removal of repeated word sequences by suffix automata of reference shards.

A window is a run of ``size`` words of one document. It is repeated if its words
also stand in a document with a smaller doc_id; every word that a repeated window
covers is removed. Windows are judged on the texts as they came in.

Where to look. Of the 25-word runs in a window, the one with the least hash is the
window's anchor; equal windows have equal anchors. Anchors are indexed with their
documents, and only those that two documents have are followed up. The
windows of one anchor occurrence are neighbours; their words are its passage (75 words at most),
and documents with one and the same passage share what is found for it.

Which windows are repeated. The distinct passages of an anchor are the reference of its shard. One
suffix automaton per shard takes them in by the smallest document that has them; each passage, before it
goes in, is streamed through for its matching statistics. A window that ends
where the longest match has ``size`` words or more stands in a smaller document than any that has this passage; the
passage's other windows are repeated in all its documents but the smallest. An anchor with
more than ``most`` passages has several shards: its passages are cut into windows, dealt to the shards by a
hash of their words, so that the work stays in proportion to the windows.

A shard is not broadcast past all documents, which would make the work grow with the square of the corpus:
it goes where its anchor's passages are.

Words are compared by 64-bit hashes. Defined results: a null text has no words; rows with a
null doc_id are left out; equal doc_ids do not repeat each other, whatever their texts; repeated rows
get equal rows; a document with fewer words than a window keeps them all; an empty table gives no
rows; other columns are not read unless they are to be kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import WordHasher, cut, map_arrow, mix64, only_slots, rolling_hashes, slots_used, table
from reverie.llm.jaccard import chunks

_PLACE = 24  # bits for a word's place in the packed minimum; longer texts hold hash and place apart


def anchored(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows with one anchor."""
    short = (size + 1) // 2
    if len(words) < size:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0, dtype=np.uint64)
    h = rolling_hashes(words, short)
    if len(words) >= 1 << _PLACE:
        return runs_of(first_least(h, size - short + 1), h)
    least = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    reach, span = size - short + 1, 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return runs_of((least & np.uint64((1 << _PLACE) - 1)).astype(np.int64), h)


def first_least(h: np.ndarray, reach: int) -> np.ndarray:
    """For each ``reach`` consecutive hashes, the first place of the least, compared as in the packed minimum."""
    value, place, span = h >> np.uint64(_PLACE), np.arange(len(h)), 1
    while span < reach:
        step = min(span, reach - span)
        place = np.where(value[:-step] <= value[step:], place[:-step], place[step:])
        value = np.minimum(value[:-step], value[step:])
        span += step
    return place


def runs_of(place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows with one anchor place."""
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, len(place)]), h[place[first]]


class SuffixAutomaton:
    """Of the word sequences taken in so far."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, step: dict[int, int], length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's longest string followed by c, apart from q's longer ones."""
        clone = self._state(dict(self.step[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        """Takes in one more sequence."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in words:
            if (q := step[last].get(c)) is not None:  # known from an earlier sequence
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state({}, length[last] + 1, 0), last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def statistics(self, words: list[int]) -> list[int]:
        """Length of the longest suffix of each beginning of ``words`` that is known."""
        step, link, length = self.step, self.link, self.length
        state = matched = 0
        out = []
        for c in words:
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if (t := step[state].get(c)) is not None:
                state, matched = t, matched + 1
            else:
                matched = 0
            out.append(matched)
        return out


def index_anchors(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """``p, entries``: packed (anchor, doc_id), each pair once, dealt to ``buckets`` by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(ids, texts, 8_000_000):
                found = [(k, np.unique(anchored(hasher.words(t or "", lower=False), size)[2])) for k, t in zip(ids[a:b], texts[a:b], strict=True)]
                key = np.concatenate([x for _, x in found])
                doc = np.repeat(np.array([k for k, _ in found], dtype=np.int64), [len(x) for _, x in found])
                if not len(key):
                    continue
                p = ((mix64(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(p, kind="stable")
                key, doc, p = key[order], doc[order], p[order]
                start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                packed = [key[i:j].tobytes() + doc[i:j].tobytes() for i, j in zip(start, np.r_[start[1:], len(p)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p[start]), pa.array(packed, pa.binary())], names=["p", "entries"])

    return map_arrow(docs, run, "p int, entries binary")


def shared_anchors(entries: DataFrame) -> DataFrame:
    """``doc_id, anchor`` of the anchors that at least two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs = [], []
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                half = len(packed) // 2
                keys.append(np.frombuffer(packed, dtype=np.uint64, count=half // 8))
                docs.append(np.frombuffer(packed, dtype=np.int64, offset=half))
        if not keys:
            return
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        key, doc = key[once], doc[once]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        many = np.repeat(count > 1, count)
        key, doc = key[many].view(np.int64), doc[many]
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 100_000]), pa.array(key[i : i + 100_000])], names=["doc_id", "anchor"])

    return map_arrow(entries, run, "doc_id long, anchor long")


def passages(docs: DataFrame, size: int) -> DataFrame:
    """From doc_id, tid (the text's hash), text and the anchors to follow up: a row for each passage, and rows with the words.

    Passage rows: ``doc_id, tid, firsts, windows, anchor, passage`` (hash of its words), one for each
    passage of a document, with all its places. Word rows: ``doc_id, tid, firsts, words`` (packed
    hashes of the words from the one place on), anchor null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        names = ["doc_id", "tid", "firsts", "windows", "anchor", "passage", "words"]
        for batch in batches:
            for k, tid, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hasher.words(text or "", lower=False)
                first, windows, anchor = anchored(words, size)
                use = np.isin(anchor.view(np.int64), np.array(wanted, dtype=np.int64))
                first, windows, anchor = first[use], windows[use], anchor[use].view(np.int64)
                if not len(first):
                    continue
                end = first + windows + size - 1
                with np.errstate(over="ignore"):
                    # hash of words[first:end] from prefix sums over odd powers
                    base = np.uint64(0xD6E8FEB86659FD93)
                    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), base, dtype=np.uint64))])
                    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), pow(int(base), -1, 2**64), dtype=np.uint64))])
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1], dtype=np.uint64)])
                    name = mix64((sums[end] - sums[first]) * inverse[first] + windows.astype(np.uint64)).view(np.int64)
                n = len(first)
                order = np.lexsort((first, name, anchor))
                heads = np.flatnonzero(np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (name[order][1:] != name[order][:-1])])
                places = pa.ListArray.from_arrays(pa.array(np.r_[heads, n].astype(np.int32)), pa.array(first[order]))
                at = order[heads]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(np.full(len(at), tid)), places, pa.array(windows[at]), pa.array(anchor[at]), pa.array(name[at]), pa.nulls(len(at), pa.binary())], names=names)
                # the covered stretches of words
                opens = np.flatnonzero(np.r_[True, first[1:] > np.maximum.accumulate(end)[:-1]])
                closes = np.r_[opens[1:], n] - 1
                starts, stops = first[opens], np.maximum.accumulate(end)[closes]
                m = len(opens)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k)), pa.array(np.full(m, tid)), pa.array([[i] for i in starts.tolist()], pa.list_(pa.int64())), none, none, none, pa.array([words[i:j].tobytes() for i, j in zip(starts, stops, strict=True)], pa.binary())], names=names)

    return map_arrow(docs.select("doc_id", "tid", "text", "wanted"), run, "doc_id long, tid long, firsts array<long>, windows long, anchor long, passage long, words binary")


def shards(references: DataFrame, size: int, most: int) -> DataFrame:
    """``shard, anchor, passage, shift, doc_id, copies, words``: passages or, of anchors with more than ``most``, their windows."""
    parts = references.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    rows = references.join(parts, "anchor", "left")
    few = rows.where("parts is null").select(F.xxhash64("anchor").alias("shard"), "anchor", "passage", F.lit(0).cast("long").alias("shift"), "doc_id", "copies", "words")
    windows = (F.length("words") / 8).cast("long") - size
    many = rows.where("parts is not null").withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), windows)))
    many = many.withColumn("words", F.substring("words", (F.col("shift") * 8 + 1).cast("int"), F.lit(8 * size)))
    many = many.select(F.xxhash64("anchor", F.pmod(F.xxhash64("words"), F.col("parts"))).alias("shard"), "anchor", "passage", "shift", "doc_id", "copies", "words")
    return few.unionByName(many)


def matched_windows(references: DataFrame, size: int, most: int = 4096) -> DataFrame:
    """``anchor, passage, shift, count, least``: runs of windows; with a ``least``, they are repeated in documents beyond it only, else in all.

    ``references`` has ``anchor, passage, doc_id`` (the smallest that has it), ``copies`` (whether others have it) and ``words``.
    """
    dealt = shards(references, size, most).repartition("shard").sortWithinPartitions("shard", "anchor", "doc_id")

    def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(at):
            opens = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            yield from ((int(at[i]), int(at[j - 1] - at[i] + 1)) for i, j in zip(opens, np.r_[opens[1:], len(at)], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        automaton, waiting = SuffixAutomaton(), []
        for batch in batches:
            out: list[tuple[int, int, int, int, int | None]] = []
            for name, anchor, passage, shift, doc, copies, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != (name, anchor):
                    shard, automaton, waiting = (name, anchor), SuffixAutomaton(), []
                words = np.frombuffer(packed, dtype=np.uint64).tolist()
                if waiting and waiting[0][0] < doc:
                    for _, before in waiting:
                        automaton.add(before)
                    waiting = []
                longest = np.array(automaton.statistics(words))
                known = longest[size - 1 :] >= size
                out += [(anchor, passage, shift + i, n, None) for i, n in runs(np.flatnonzero(known))]
                if copies:
                    out += [(anchor, passage, shift + i, n, doc) for i, n in runs(np.flatnonzero(~known))]
                if longest[-1] < len(words):
                    waiting.append((doc, words))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["anchor", "passage", "shift", "count", "least"])

    return map_arrow(dealt, run, "anchor long, passage long, shift long, count long, least long")


def repeated_spans(docs: DataFrame, size: int, slots: int = 1 << 20) -> DataFrame:
    """``doc_id, tid, spans`` of each text (doc_id, tid, text) with repeated words: ``length`` words from each of ``firsts``, ``shift`` words on."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    follow = cut(shared_anchors(index_anchors(docs.select("doc_id", "text"), size, 4 * partitions).repartition(partitions, "p")))
    bits = slots_used(follow, slots)
    wanted = follow.groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted"))
    found = cut(passages(only_slots(docs.select("doc_id", "tid", "text"), bits, slots, True).join(wanted, "doc_id"), size))
    occurs = found.where("anchor is not null").select("doc_id", "tid", "firsts", "windows", "anchor", "passage").distinct()
    least = F.min(F.struct("doc_id", "tid", F.element_at("firsts", 1).alias("first"))).alias("at")
    kinds = occurs.groupBy("anchor", "passage").agg(least, F.max("windows").alias("windows"), (F.min("doc_id") < F.max("doc_id")).alias("copies"))
    kinds = kinds.select("anchor", "passage", "at.doc_id", "at.tid", "at.first", "windows", "copies")
    texts = found.where("anchor is null").select("doc_id", "tid", F.element_at("firsts", 1).alias("from"), "words").distinct()
    placed = kinds.join(texts, ["doc_id", "tid"]).where("first >= `from` and first < `from` + length(words) / 8")
    references = placed.select("anchor", "passage", "doc_id", "copies", F.substring(F.col("words"), ((F.col("first") - F.col("from")) * 8 + 1).cast("int"), ((F.col("windows") + size - 1) * 8).cast("int")).alias("words"))
    matched = matched_windows(references, size)
    spans = occurs.select("doc_id", "tid", "firsts", "anchor", "passage").join(matched, ["anchor", "passage"]).where("least is null or doc_id > least")
    spans = spans.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("firsts", "shift", (F.col("count") + size - 1).alias("length"))).alias("spans"))
    return spans


def cut_words(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that are left, and how many were there."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not spans:
        return words, len(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        starts = np.array(s["firsts"]) + s["shift"]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + s["length"], -1)
    gone = np.cumsum(change)[:-1] > 0
    return [words[i] for i in np.flatnonzero(~gone)], len(words)


def strip_repeats(docs: DataFrame, *, size: int = 50, slots: int = 1 << 20, digest: bool = False, untouched: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed`` and ``kept`` (the words left, joined by one space) or its ``kept_sha256``, a row for each row.

    With ``untouched``, a text without repeats is kept as it is. Columns of ``docs`` named in ``keep`` follow under their own names.
    """
    clash = {"doc_id", "n_words", "n_removed", "kept", "kept_sha256"} & set(keep)
    if clash:
        raise ValueError(f"cannot keep columns named {sorted(clash)}")
    extra = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).where("doc_id is not null").withColumn("tid", F.xxhash64("text"))
    spans = cut(repeated_spans(docs, size, slots))
    bits = slots_used(spans, slots)
    last = "kept_sha256" if digest else "kept"
    carried = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            cuts = batch.column(2 + len(keep)).to_pylist() if batch.num_columns > 2 + len(keep) else [None] * len(texts)
            n, removed, kept = [], [], []
            for text, at in zip(texts, cuts, strict=True):
                left, count = cut_words(text, at)
                n.append(count)
                removed.append(count - len(left))
                if untouched and count == len(left) and not digest:
                    kept.append(text)
                    continue
                joined = b" ".join(left)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(batch.column(2 + i) for i in range(len(keep)))], names=["doc_id", "n_words", "n_removed", last, *carried])

    kind = ", ".join([f"doc_id long, n_words long, n_removed long, {last} string", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)])
    whole = map_arrow(only_slots(docs, bits, slots, False).select("doc_id", "text", *carried), run, kind)
    some = map_arrow(only_slots(docs, bits, slots, True).join(spans, ["doc_id", "tid"], "left").select("doc_id", "text", *carried, "spans"), run, kind)
    return whole.unionByName(some).withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"), digest=True)
