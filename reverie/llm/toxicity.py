"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexical machine is the union of five tries that read the letters of a word: insults
and threats (beginnings of words, with weights), targets, negations and reports (whole
words). It maps each word of a clause to a symbol. Three transducers over symbols are
composed into one: negation weakens what follows within a few words; reported speech weakens what a
report or a quotation introduces; the target strengthens insults and threats near a
person addressed. A target may also follow: a transducer that reads the clause
backwards marks such insults and threats first. A clause's score is the
weight of its path; a document's features are sums over its matched clauses, which a
logistic layer turns into a probability.

The insult lexicon has a small public core and stems induced from labelled
documents (``per_class`` of each label at most, a bounded sample): the longest
word beginnings that toxic documents have and others don't.

Defined results: a null or empty text scores like a text without a match;
without labelled rows of both classes the core lexicon and fixed weights are
used. Of a document with labels that contradict each other, the higher one counts;
labels that are null or neither 0 nor 1 and labels with a null id teach nothing. Repeated rows get
equal rows; an empty table gives no rows; other columns are not read, whatever their names; texts
are scored whole, in time that grows with their length; those above ``longest_fit`` characters are
not learnt from.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import bounded_rows, crc_mod, map_arrow, table

#: The public core of the lexicon: beginnings of words.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "dumbass", "arschloch", "dummkopf", "trottel", "connard", "crétin", "imbécil", "estúpid", "gilipollas")
THREATS = ("kill", "murder", "strangle", "umbringen", "töten", "abstechen", "tuerai", "tuerons", "mataré", "mataremos")
TARGETS = frozenset("you your yours yourself u he him she her they them thou du dich dir dein deine euch ihr tu toi te ton vous votre vos él ella ellos vosotros usted ustedes".split())
NEGATIONS = frozenset("not no never neither nor none cannot isn't aren't don't doesn't didn't wasn't nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls quoted quotes wrote writes reported reports alleged allegedly claimed sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split())

#: AIMED symbols are insults and threats that a target follows closely.
INSULT, THREAT, AIMED_INSULT, AIMED_THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = SYMBOLS = range(9)
HITS = (INSULT, THREAT, AIMED_INSULT, AIMED_THREAT)
AIMED = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}
FEATURES = ("direct", "targeted", "negated", "reported", "threat", "strongest", "clauses")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_QUOTES = frozenset("\"“”«»„")
_END = "\0"  # after the last letter of a word


class Lexicon:
    """A deterministic machine over the letters of a word and its end; an accepting state has a symbol and a weight."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, float] | None] = [None]

    @classmethod
    def trie(cls, symbol: int, weights: dict[str, float], whole: bool) -> Lexicon:
        """Accepts each key as a whole word, or as a word's beginning."""
        out = cls()
        for word, weight in weights.items():
            state = 0
            for c in word + _END if whole else word:
                if c not in out.arcs[state]:
                    out.arcs[state][c] = len(out.arcs)
                    out.arcs.append({})
                    out.accepts.append(None)
                state = out.arcs[state][c]
            out.accepts[state] = (symbol, weight)
        return out

    def __or__(self, other: Lexicon) -> Lexicon:
        """The union, by the product of both machines (a state of -1 is a machine that has stopped); this one's symbols come first."""
        out, names, queue = Lexicon(), {(0, 0): 0}, [(0, 0)]
        for a, b in queue:  # grows while states are found
            here = names[a, b]
            out.accepts[here] = (self.accepts[a] if a >= 0 else None) or (other.accepts[b] if b >= 0 else None)
            left, right = self.arcs[a] if a >= 0 else {}, other.arcs[b] if b >= 0 else {}
            for c in sorted({*left, *right}):
                to = (left.get(c, -1), right.get(c, -1))
                if to not in names:
                    names[to] = len(names)
                    out.arcs.append({})
                    out.accepts.append(None)
                    queue.append(to)
                out.arcs[here][c] = names[to]
        return out

    def read(self, word: str) -> tuple[int, float]:
        """Symbol and weight of the longest accepted beginning, a whole word before all."""
        state, found, arcs = 0, None, self.arcs
        for c in word + _END:
            if (state := arcs[state].get(c, -1)) < 0:
                break
            found = self.accepts[state] or found
        return found or (OTHER, 0.0)


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol]`` is (next state, symbol written, factor on the weight, tags), for every state and symbol."""

    arcs: tuple[tuple[tuple[int, int, float, frozenset[str]], ...], ...]

    @classmethod
    def of(cls, states: int, arc) -> Transducer:
        """From ``arc(state, symbol)``: next state and, where they are not as usual, symbol, factor and tag."""

        def whole(state: int, symbol: int, to: int, written: int | None = None, factor: float = 1.0, tag: str = ""):
            return to, symbol if written is None else written, factor, frozenset([tag] if tag else [])

        return cls(tuple(tuple(whole(s, x, *arc(s, x)) for x in SYMBOLS) for s in range(states)))

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""
        names, queue, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            row = []
            for symbol in SYMBOLS:
                to, written, factor, tags = self.arcs[a][symbol]
                to2, last, factor2, tags2 = other.arcs[b][written]
                if (to, to2) not in names:
                    names[to, to2] = len(names)
                    queue.append((to, to2))
                row.append((names[to, to2], last, factor * factor2, tags | tags2))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs))

    def run(self, tape: Iterable[tuple[int, float]]) -> list[tuple[int, float, frozenset[str]]]:
        state, out = 0, []
        for symbol, weight in tape:
            state, written, factor, tags = self.arcs[state][symbol]
            out.append((written, weight * factor, tags))
        return out


def negation(reach: int = 3, factor: float = 0.25) -> Transducer:
    """States count down the words that a negation still reaches."""

    def arc(state: int, symbol: int):
        if symbol == NEGATION:
            return (reach,)
        if symbol in HITS and state:
            return state - 1, symbol, factor, "negated"
        return (max(0, state - 1),)

    return Transducer.of(reach + 1, arc)


def reported_speech(factor: float = 0.4) -> Transducer:
    """State 1: after a verb of report, to the clause's end; state 2: within quotation marks."""

    def arc(state: int, symbol: int):
        if symbol == QUOTE:
            return (0 if state == 2 else 2,)
        if symbol == REPORT:
            return (max(1, state),)
        return (state, symbol, factor, "reported") if symbol in HITS and state else (state,)

    return Transducer.of(3, arc)


def target(reach: int = 6, factor: float = 1.5) -> Transducer:
    """States count down the words in which an insult or threat still falls on the person addressed."""

    def arc(state: int, symbol: int):
        if symbol == TARGET:
            return (reach,)
        if symbol in (AIMED_INSULT, AIMED_THREAT):
            return reach - 1, symbol, factor, "targeted"
        if symbol in HITS and state:
            return state - 1, symbol, factor, "targeted"
        return (max(0, state - 1),)

    return Transducer.of(reach + 1, arc)


def target_behind(reach: int = 3) -> Transducer:
    """Reads backwards: insults and threats with a target among the next words become aimed ones."""

    def arc(state: int, symbol: int):
        if symbol == TARGET:
            return (reach,)
        return (max(0, state - 1), AIMED[symbol]) if state and symbol in AIMED else (max(0, state - 1),)

    return Transducer.of(reach + 1, arc)


class Grammar:
    """The composed machines with their lexicon (beginning of a word -> weight) and a logistic layer."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float], layer: np.ndarray | None = None) -> None:
        self.insults, self.threats, self.layer = insults, threats, layer
        self._build()

    def _build(self) -> None:
        whole = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (QUOTE, _QUOTES))
        parts = [Lexicon.trie(INSULT, self.insults, False), Lexicon.trie(THREAT, self.threats, False), *(Lexicon.trie(k, dict.fromkeys(sorted(w), 0.0), True) for k, w in whole)]
        self.lexicon = reduce(Lexicon.__or__, parts)
        self.behind = target_behind()
        self.forward = reduce(Transducer.then, (negation(), reported_speech(), target()))
        stems = sorted({*self.insults, *self.threats}, key=len, reverse=True)
        self.find = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, stems)) + ")").finditer if stems else lambda _: iter(())

    def __getstate__(self):
        return self.insults, self.threats, self.layer

    def __setstate__(self, state):
        self.insults, self.threats, self.layer = state
        self._build()

    def clause(self, text: str) -> list[tuple[int, float, frozenset[str]]]:
        """The matched symbols of one clause with their weights along the composed path."""
        tape = [self.lexicon.read(w) for w in _WORD.findall(text)]
        aimed = [x[0] for x in reversed(self.behind.run(reversed(tape)))]
        return [x for x in self.forward.run(zip(aimed, (w for _, w in tape), strict=True)) if x[0] in HITS]

    def features(self, text: str | None) -> np.ndarray:
        """Sums over the clauses in which the lexicon has a match; other clauses score nothing. One pass over the text."""
        sums = dict.fromkeys(FEATURES, 0.0)
        if text:
            low, done, ends = text.lower(), 0, None
            for hit in self.find(low):
                if hit.start() < done:
                    continue
                if ends is None:
                    ends = [-1, *(m.start() for m in _CLAUSE_END.finditer(low)), len(low)]
                i = bisect_left(ends, hit.start())
                done = ends[i]
                path = self.clause(low[ends[i - 1] + 1 : done])
                for kind, weight, tags in path:
                    name = "threat" if kind in (THREAT, AIMED_THREAT) else next((t for t in ("negated", "reported", "targeted") if t in tags), "direct")
                    sums[name] += weight
                if path:
                    sums["strongest"] = max(sums["strongest"], sum(w for _, w, _ in path))
                    sums["clauses"] += 1
        return np.array([math.log1p(sums[k]) for k in FEATURES])

    def score(self, text: str | None) -> float:
        return self.probability(self.features(text))

    def probability(self, x: np.ndarray) -> float:
        z = float(x @ self.layer[:-1] + self.layer[-1]) if self.layer is not None else float(x[:6].sum() - 2.5)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def induce_stems(toxic: list[str], other: list[str], *, shortest: int = 3, longest: int = 10, least: int = 3, odds: float = 25.0, surprise: float = 12.0) -> dict[str, float]:
    """Beginnings of words that many toxic documents have and others hardly: stem -> log odds.

    Evidence is counted in occurrences between different neighbours, as the words of a passage
    that was copied into several toxic documents always have the same ones. A stem is
    taken if at least ``least`` toxic documents have it and chance would put its
    occurrences on the toxic side with a log probability below ``-surprise``.
    """
    split = [[re.findall(r"[^\W\d_]+", t.lower()) for t in texts] for texts in (toxic, other)]

    def spread(texts: list[list[str]]) -> tuple[Counter, Counter]:
        """Documents that have a stem at all, and that have it twice."""
        once: Counter = Counter()
        twice: Counter = Counter()
        for words in texts:
            seen = Counter(w[:longest] for w in words)
            stems: Counter = Counter()
            for w, n in seen.items():
                for k in range(shortest, len(w) + 1):
                    stems[w[:k]] += n
            once.update(stems.keys())
            twice.update(k for k, n in stems.items() if n > 1)
        return once, twice

    (a, a2), (b, b2) = map(spread, split)
    odds_of = lambda x, y: ((x + 0.5) / (len(toxic) + 1)) / ((y + 0.5) / (len(other) + 1))
    rate = lambda s: odds_of(a[s], b[s])
    # words that others have by chance, but hardly twice, count as well: with the lower weight of one occurrence
    likely = {s for s, n in a.items() if n >= least and (rate(s) >= odds or (a2[s] >= least and rate(s) >= 3 and odds_of(a2[s], b2[s]) >= odds))}
    near: tuple[dict[str, set], dict[str, set]] = ({s: set() for s in likely}, {s: set() for s in likely})
    for side in (0, 1):
        for words in split[side]:
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                for n in range(shortest, min(longest, len(word)) + 1):
                    if (stem := word[:n]) in likely:
                        near[side][stem].add((before, after))
    share = sum(map(len, split[0])) / max(1, sum(map(len, split[0])) + sum(map(len, split[1])))

    def evidence(stem: str) -> float:
        """n * KL(observed toxic share, toxic share of all words): the negative log of a bound on the probability."""
        x, y = len(near[0][stem]), len(near[1][stem])
        p = x / (x + y)
        return 0.0 if p <= share else x * math.log(p / share) + (y * math.log((1 - p) / (1 - share)) if y else 0.0)

    chosen: dict[str, float] = {}
    for stem in sorted((s for s in likely if len(near[0][s]) >= 0.6 * a[s] and evidence(s) >= (1 if rate(s) >= odds else 2) * surprise), key=lambda s: (len(s), s)):
        parent = next((stem[:n] for n in range(len(stem) - 1, shortest - 1, -1) if stem[:n] in chosen), None)
        if parent is not None:
            if a[stem] < 0.9 * a[parent]:
                continue
            del chosen[parent]  # the longer one covers as much
        chosen[stem] = min(8.0, math.log(rate(stem)))
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 0.02, steps: int = 30) -> np.ndarray:
    """Weights and, last, the intercept: Newton steps on the ridge-penalised loss."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge * len(x) / 100 + 1e-6)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (p - y) + penalty * w
        curve = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_grammar(texts: list[str], labels: list[int]) -> Grammar:
    core = dict.fromkeys(INSULTS, 2.0)
    threats = dict.fromkeys(THREATS, 2.0)
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    other = [t for t, y in zip(texts, labels, strict=True) if not y]
    if not toxic or not other:
        return Grammar(core, threats)
    # stems come from one half of the sample, the layer from the other, so that its weights are honest
    stems = induce_stems(toxic[::2], other[::2])
    trial = Grammar(core | stems, threats)
    rest_x = [*toxic[1::2], *other[1::2]] or texts
    rest_y = [1] * len(toxic[1::2]) + [0] * len(other[1::2]) or labels
    layer = fit_logistic(np.array([trial.features(t) for t in rest_x]), np.array(rest_y, dtype=float))
    return Grammar(core | induce_stems(toxic, other), threats, layer)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, columns: list[str], label_col: str, per_class: int, longest: int) -> DataFrame:
    """About ``per_class`` rows of ``columns`` for each label 0 and 1, one row for each id, and ``_y``; bounded before anything is collected."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    chosen = bounded_rows(marked, [id_col], F.col("_y"), per_class)
    found = docs.select(id_col, *columns).join(F.broadcast(chosen), id_col).where(F.char_length(columns[0]) <= longest)
    # of rows with one id, the least stands for all
    return found.groupBy(id_col, "_y").agg(F.min(F.struct(*columns)).alias("s")).select(id_col, "s.*", "_y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1000, longest_fit: int = 100_000) -> Grammar:
    """Fit on about ``per_class`` labelled rows of each class with up to ``longest_fit`` characters; only those texts reach the driver."""
    rows = sorted(labelled_texts(docs, labels, id_col, [text_col], label_col, per_class, longest_fit).collect(), key=lambda r: (r[0], r[1]))
    return fit_grammar([r[1] for r in rows], [int(r[2]) for r in rows])


def score_toxicity(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, n_clauses`` for every row; n_clauses counts the matched clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([grammar.probability(x) for x in found], pa.float64()), pa.array([round(math.expm1(x[-1])) for x in found], pa.int64())],
                names=[id_col, "score", "n_clauses"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, score double, n_clauses bigint")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    grammar = fit_toxicity(docs, labels.where(~held))
    scored = score_toxicity(docs, grammar)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_clauses")
