"""Mixing of sources to target weights by hierarchical budgeting.

The documents' tokens hang from a tree of domains, languages and sources. A
budget of tokens goes down the tree by the nodes' weights. What a node cannot
take (all its documents, ``max_epochs`` times) goes to its siblings by their
weights; only what no sibling can take goes up and to the ancestor's siblings.

A leaf with a budget takes whole epochs of its documents, then the prefix of
one more epoch, in an order seeded for that epoch, whose tokens fit. The
prefix is found without sorting a leaf in one task: the order is cut into
slices of about ``slice_rows`` documents, the slices' sums give the one where
the budget ends, and only that slice is sorted.

Defined results: a null text has no tokens and is in the first epoch that is
taken whole, or in the prefix; null languages and sources are nodes of their own; rows with a null
doc_id are left out; repeated rows count each; without tokens or budget nothing is selected.

The tree's nodes (not the documents) are collected on the driver: at most
``most_leaves`` leaves, beyond which an error asks for coarser sources.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reverie.llm.common import cut, table

Path = tuple[str | None, ...]


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def share_out(budget: int, weights: list[float], most: list[int]) -> list[int]:
    """Whole parts of ``budget`` by weight, none above its ``most``; what one can't take goes to the others."""
    given = [0] * len(weights)
    budget = min(budget, sum(most))
    open_ = [i for i, m in enumerate(most) if m > 0]
    while budget > 0 and open_:
        total = sum(weights[i] for i in open_)
        part = {i: (budget * weights[i] / total if total > 0 else budget / len(open_)) for i in open_}
        full = [i for i in open_ if given[i] + part[i] >= most[i]]
        if full:
            for i in full:
                budget -= most[i] - given[i]
                given[i] = most[i]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        whole = {i: math.floor(part[i]) for i in open_}
        rest = budget - sum(whole.values())
        for i in sorted(open_, key=lambda i: (whole[i] - part[i], i))[:rest]:
            whole[i] += 1
        for i in open_:
            given[i] += whole[i]
        break
    return given


def leaf_budgets(tokens: Mapping[Path, int], budget: int, max_epochs: int, weight: Callable[[Path, int], float]) -> dict[Path, int]:
    """Budget of each leaf. ``weight(path, tokens)`` of a node is relative to its siblings."""
    below: dict[Path, set[Path]] = defaultdict(set)
    total: dict[Path, int] = defaultdict(int)
    for leaf, n in tokens.items():
        for depth in range(len(leaf) + 1):
            total[leaf[:depth]] += n
            if depth:
                below[leaf[: depth - 1]].add(leaf[:depth])
    out = {}

    def down(node: Path, given: int) -> None:
        if node in tokens:
            out[node] = given
            return
        children = sorted(below[node], key=lambda c: tuple((x is None, x or "") for x in c))
        parts = share_out(given, [weight(c, total[c]) for c in children], [max_epochs * total[c] for c in children])
        for child, part in zip(children, parts, strict=True):
            down(child, part)

    if tokens:
        down((), budget)
    return out


def root_weight(path: Path, tokens: int) -> float:
    """The default: nodes weigh as the square root of their tokens, so that large ones don't crowd out small ones."""
    return math.sqrt(tokens)


def mix(docs: DataFrame, *, domain: Column, share: float = 0.7, max_epochs: int = 2, weight: Callable[[Path, int], float] = root_weight, seed: int = 11, slice_rows: int = 1000, most_leaves: int = 100_000, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch``: a row for each time that a document is taken.

    The budget is ``share`` of all tokens there are.
    """
    rows = docs.select("doc_id", domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n_tokens")).where("doc_id is not null")
    rows = cut(rows)
    spark, names = rows.sparkSession, ["domain", "lang", "source"]
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(most_leaves + 1).collect()
    if len(leaves) > most_leaves:
        raise ValueError(f"more than {most_leaves} leaves: use coarser sources")
    tokens = {(r["domain"], r["lang"], r["source"]): r["tokens"] for r in leaves}
    budgets = leaf_budgets(tokens, int(share * sum(tokens.values())), max_epochs, weight)
    plan = []
    for r in leaves:
        have, given = r["tokens"], budgets[r["domain"], r["lang"], r["source"]]
        epochs = given // have if have else 0
        plan.append((r["domain"], r["lang"], r["source"], epochs, given - epochs * have, max(1, -(-r["n"] // slice_rows))))
    listed = spark.createDataFrame(plan, "p_domain string, p_lang string, p_source string, epochs long, rest long, slices long")
    same = rows["domain"].eqNullSafe(listed["p_domain"]) & rows["lang"].eqNullSafe(listed["p_lang"]) & rows["source"].eqNullSafe(listed["p_source"])
    rows = rows.join(F.broadcast(listed), same).withColumn("leaf", F.xxhash64(*(F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in names)))
    whole = rows.where("epochs > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - 1)")))
    turn = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    last = rows.where("rest > 0").withColumn("turn", turn)
    last = last.withColumn("slice", F.least(F.floor((F.shiftrightunsigned("turn", 11) / F.lit(float(1 << 53))) * F.col("slices")), F.col("slices") - 1).cast("long"))
    last = last.withColumn("turn", F.shiftrightunsigned("turn", 1))
    # sums of slices: rows by the thousand of documents
    sums = last.groupBy("leaf", "slice").agg(F.sum("n_tokens").alias("inside"))
    sums = sums.withColumn("upto", F.sum("inside").over(Window.partitionBy("leaf").orderBy("slice"))).select("leaf", "slice", "upto", (F.col("upto") - F.col("inside")).alias("before"))
    placed = last.join(sums, ["leaf", "slice"]).where("before < rest")
    inside = placed.where("upto <= rest")
    edge = placed.where("upto > rest").withColumn("run", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("leaf").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).where("run <= rest")
    out = ["doc_id", *names, "n_tokens"]
    return whole.select(*out, "epoch").unionByName(inside.select(*out, F.col("epochs").alias("epoch"))).unionByName(edge.select(*out, F.col("epochs").alias("epoch")))


def numbered_domain(source: Column, domains: int = 4) -> Column:
    """For sources that end in a number, a domain by its remainder; others are a domain of their own."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(domains)).cast("string"))).otherwise(F.lit("other"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain=numbered_domain(F.col("source")))
