"""Greedy word-piece lengths by a linear longest-match automaton.

A trie over the vocabulary has, at each node, a failure link and the number of
pieces popped when it is followed. Reading a word, a character without an edge
pops pieces through the links until one fits; the counts add up to the number
of pieces that greedy longest-match-first would give, and no piece is built.

The vocabulary is a ``tokenizers`` JSON file whose word-final pieces end in
``</w>``; the end of a word is one more symbol of the automaton. A word that
greedy matching cannot split counts as one unknown piece.

Defined results: a null text, an empty one or one of white space has 0 pieces;
repeated rows get equal rows; texts are never shortened.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reverie.llm.bpe import byte_symbols
from reverie.llm.common import map_arrow, table

#: The words of the vocabulary's format (fixed value): contractions, runs of letters, single digits, runs of others.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END = "</w>"


class LongestMatch:
    def __init__(self, pieces: list[str]) -> None:
        """Builds the trie and, breadth first, the links and popped counts."""
        self.edges: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in self.symbols(piece):
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = self.edges[node][c]
            final[node] = node > 0
        #: link -1: the word cannot be split; popped[v]: pieces given out on the way along v's link.
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                queue.append(v)
                if final[v]:
                    self.link[v], self.popped[v] = 0, 1
                    continue
                z, count = self.link[u], self.popped[u]
                while z >= 0 and c not in self.edges[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0 and u != 0:
                    self.link[v], self.popped[v] = self.edges[z][c], count

    @staticmethod
    def symbols(piece: str) -> list[str]:
        return [*piece[: -len(END)], END] if piece.endswith(END) else list(piece)

    def count(self, symbols: list[str]) -> int:
        node = total = 0
        edges, link, popped = self.edges, self.link, self.popped
        for c in symbols:
            while (step := edges[node].get(c)) is None:
                total += popped[node]
                node = link[node]
                if node < 0 or (node == 0 and c not in edges[0]):
                    return 1
            node = step
        while node > 0:
            total += popped[node]
            node = link[node]
        return 1 if node < 0 else total


class PieceCounter:
    def __init__(self, path: str, most_cached: int = 250_000) -> None:
        with open(path, encoding="utf-8") as f:
            self.automaton = LongestMatch(list(json.load(f)["model"]["vocab"]))
        self.of_byte = byte_symbols()
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, int] = {}
        self.most_cached = most_cached

    def word(self, word: str) -> int:
        return self.automaton.count([*(self.of_byte[b] for b in word.encode("utf-8", "surrogatepass")), END])

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words, known = self.words(text.lower()), self.known
        if len(known) > self.most_cached:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return sum(map(known.__getitem__, words))


_loaded: dict[str, PieceCounter] = {}


def count_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_pieces`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = PieceCounter(path)
        counter = _loaded[path]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.text(t) for t in batch.column(1).to_pylist()], pa.int64())], names=[id_col, "n_pieces"])
        counter.known.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_pieces bigint")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), default_vocabulary())
