"""Byte-level BPE by a pair occurrence index.

The distinct pieces of a group of texts are laid out in one symbol array. An
index maps the rank of each mergeable pair to all positions where it occurs; the active
ranks are taken in ascending order, every occurrence is merged from left to
right, and the lists of the neighbouring pairs are updated. A pair that a merge
creates always has a higher rank than the merge, so one ascending sweep gives
each piece the same result as merging it alone.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows get equal rows. Texts are never shortened.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reverie.llm.common import map_arrow, table

#: Splits text into the pieces within which merges happen (fixed value of the vocabulary's format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairIndexBPE:
    """Encoder and decoder over a ``tokenizers`` JSON file."""

    def __init__(self, path: str, most_cached: int = 250_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = [vocab[a + b] for a, b in merges]
        self.first = [vocab[a] for a, _ in merges]
        self.second = [vocab[b] for _, b in merges]
        #: of each symbol: what may follow it, and what may precede it, with the pair's rank
        self.follows: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.precedes: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(zip(self.first, self.second, strict=True)):
            self.follows[a][b] = rank
            self.precedes[b][a] = rank
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        self.byte_ids = np.array(self.byte_id, dtype=np.int64)
        #: rank of each pair of bytes, or -1
        self.byte_pairs = np.array([[self.follows[a].get(b, -1) for b in self.byte_id] for a in self.byte_id], dtype=np.int32)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(back[c] for c in text)
        for text, i in special.items():
            self.token[i] = text.encode()
        self.digits = [str(i) for i in range(size)]
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.pieces = regex.compile(PIECES).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.most_cached = most_cached

    def merge(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece: one ascending sweep over the ranks that occur in any of them."""
        if not pieces:
            return []
        encoded = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        ends = np.cumsum([len(e) + 1 for e in encoded])
        data = np.frombuffer(b"\0" + b"\0".join(encoded) + b"\0", dtype=np.uint8)
        symbols = self.byte_ids[data]
        symbols[0] = -1
        symbols[ends] = -1  # no pair crosses the end of a piece
        # the index: positions of each rank's pair
        at: list[list[int] | None] = [None] * len(self.made)
        ranks = np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), self.byte_pairs[data[:-1], data[1:]], -1)
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        starts = np.flatnonzero(np.r_[True, np.diff(ranks[places]) > 0]) if len(places) else places
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(places)], strict=False):
            at[ranks[places[i]]] = places[i:j].tolist()
        sym: list[int] = symbols.tolist()
        ends = (ends + 1).tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        follows, precedes = self.follows, self.precedes
        for rank in range(len(at)):
            places = at[rank]
            if places is None:
                continue
            at[rank] = None
            a, b, c = self.first[rank], self.second[rank], self.made[rank]
            if a == b:
                places.sort()  # only then can two places overlap
            left, right = precedes[c].get, follows[c].get
            for p in places:
                if sym[p] != a or sym[q := after[p]] != b:
                    continue  # a neighbour's merge has used one of the two
                sym[p], sym[q] = c, -2
                after[p] = t = after[q]
                before[t] = p
                s = before[p]
                if (r := left(sym[s])) is not None:
                    if (more := at[r]) is None:
                        at[r] = [s]
                    else:
                        more.append(s)
                if (r := right(sym[t])) is not None:
                    if (more := at[r]) is None:
                        at[r] = [p]
                    else:
                        more.append(p)
        out, start = [], 1
        for end in ends:
            out.append(tuple(x for x in sym[start : end - 1] if x >= 0))
            start = end
        return out

    def parts(self, text: str) -> list[str]:
        """Pieces and, in their places, special tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        return list(chain.from_iterable([x] if x in self.special else self.pieces(x) for x in self.split_special(text) if x))

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text. Pieces seen before are looked up; all new ones are merged together."""
        known = self.known
        if len(known) > self.most_cached:
            known.clear()
        split = [self.parts(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(known))
        for piece in [x for x in new if x in self.special]:
            known[piece] = (self.special[piece],)
        new = [x for x in new if x not in self.special]
        known.update(zip(new, self.merge(new), strict=True))
        for pieces in split:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBPE] = {}


def encoder(path: str) -> PairIndexBPE:
    """One encoder per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def groups(texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Cuts a batch where its texts exceed ``most_chars``, to bound a worker's memory; texts stay whole."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t or "") > most_chars:
            yield start, i
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(bpe.encode_batch(texts[a:b])), pa.list_(pa.int32()))], names=[id_col, "ids"])
        bpe.known.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` from arrays of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(id_col, ids_col), run, f"{id_col} {kind}, text string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass, for round-trip audits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                n, of_ids, of_text = [], [], []
                for ids in bpe.encode_batch(texts[a:b]):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.known.clear()  # the worker may go on to something else

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())
