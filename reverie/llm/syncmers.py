"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of units: words, and the characters of very long words. A text
of few units has anchors over its characters as well; two texts are compared by
anchors of the same kind. A run of ``k`` units is a closed syncmer when its smallest inner run of ``s``
units stands first or last in it. That depends on the run alone, so an anchor
chosen in one text is chosen in every text that has it, whatever surrounds it.
The fingerprint lists the ``size`` anchors with the smallest hashes, in the
order of the text.

Two fingerprints are compared by position: the anchors that both have are
written down in either order, and an anchor matches where it follows the same one (or is the
first) in both, so that a moved block costs only its edges. The
likeness is matches over the size of the union, where only hashes up to the smaller of the two
largest listed ones count if a list is full; equal texts have likeness 1.

Defined results: a null text counts as empty; a text too short for an anchor is
its own anchor, so that two empty texts have likeness 1. Among rows with one doc_id
the order is by a hash of the text; repeated rows follow each other; rows with a null doc_id come
last; the only row of a table follows itself. An empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reverie.llm.common import table

HEX = 12


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(a: Column, n: int) -> Column:
    """``a`` without its first ``n`` entries."""
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _pairwise(a: Column, n: int, f) -> Column:
    """f(a[i], a[i + n]) for all i for which both exist."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0))), _tail(a, n), f)


def units(text: Column, longest: int = 40) -> Column:
    """Words; a word of more than ``longest`` characters counts as its characters."""
    words = F.split(text, "[\\x20\\x09-\\x0D]+")
    apart = lambda w: F.when(F.length(w) > longest, F.split(w, "")).otherwise(F.array(w))
    return F.when(text.rlike("[^\\x20\\x09-\\x0D]{%d}" % (longest + 1)), F.flatten(F.transform(words, apart))).otherwise(words)


def anchors(text: Column, k: int = 5, s: int = 2, of: Column | None = None) -> Column:
    """Hashes of the closed syncmers of ``text`` (of its units, or the array ``of``) in their order, each once."""
    if k - s != 3:
        raise ValueError("the window minimum is built for k - s = 3")

    def chosen(h: Column) -> Column:
        inner = _pairwise(h, 1, lambda a, b: F.xxhash64(a, b))
        return _let(inner, lambda m: _syncmers(h, m))

    def _syncmers(h: Column, m: Column) -> Column:
        # least of four neighbouring inner runs, by doubling
        both = lambda a, b: F.least(a, b)
        least = _pairwise(_pairwise(m, 1, both), 2, both)
        edge = _pairwise(m, 3, both)
        kmer = F.zip_with(_pairwise(m, 3, lambda a, b: F.xxhash64(a, b)), F.slice(_tail(h, 2), 1, F.greatest(F.size(m) - 3, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        found = F.zip_with(F.zip_with(least, edge, lambda a, b: a == b), kmer, lambda yes, x: F.when(yes, x))
        return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))

    return _let(F.transform(units(text) if of is None else of, lambda u: F.xxhash64(u)), lambda h: _let(chosen(h), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.xxhash64(text)))))


def sketch(text: Column, size: int = 64, few_words: int = 32) -> Column:
    """The ``size`` smallest anchors, in the order of the text, as hexadecimal strings.

    With fewer than ``few_words`` units, the anchors over characters follow. The first
    digit tells them apart: below 8 for units, 8 and more for characters.
    """

    def smallest(found: Column) -> Column:
        least = F.element_at(F.slice(F.array_sort(found), size, 1), 1)
        return F.when(F.size(found) <= size, found).otherwise(_let(least, lambda top: F.filter(found, lambda x: x <= top)))

    # negative for units; shifted so that the order of numbers is the order of their hexadecimal strings
    kind = lambda found, chars: F.array_distinct(F.transform(found, lambda x: x.bitwiseAND(F.lit(2**63 - 1)) if chars else x.bitwiseOR(F.lit(-(2**63)))))
    number = lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(2**63))), 64 - 4 * HEX))), HEX, "0")

    def both(parts: Column) -> Column:
        whole = _let(kind(anchors(text, of=parts), False), smallest)
        single = _let(kind(anchors(text, of=F.split(text, "")), True), smallest)
        return F.transform(F.when(F.size(parts) < few_words, F.concat(whole, single)).otherwise(whole), number)

    return _let(units(text), both)


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Share of the union of two fingerprints (arrays) that is matched by position, 0 to 1.

    Where both have anchors over characters, these are compared, else those over units.
    """

    def below(x: Column, top: Column) -> Column:
        return F.filter(x, lambda v: v <= top)

    def matched(x: Column, y: Column) -> Column:
        steps = lambda a: F.zip_with(F.slice(F.concat(F.array(F.lit("-")), a), 1, F.size(a)), a, lambda u, v: F.concat(u, v))
        return _let(
            F.struct(F.array_intersect(x, y).alias("p"), F.array_intersect(y, x).alias("q"), F.size(x).alias("n"), F.size(y).alias("m")),
            lambda c: F.size(F.array_intersect(steps(c["p"]), steps(c["q"]))) / (c["n"] + c["m"] - F.size(c["p"])),
        )

    # a full list says nothing of anchors beyond its largest hash
    last = lambda x: F.when(F.size(x) >= size, F.array_max(x)).otherwise(F.lit("g"))

    def compared(x: Column, y: Column) -> Column:
        return _let(F.least(last(x), last(y)), lambda top: _let(F.struct(below(x, top).alias("x"), below(y, top).alias("y")), lambda c: matched(c["x"], c["y"])))

    chars = lambda x: F.filter(x, lambda v: v >= "8")
    other = lambda x: F.filter(x, lambda v: v < "8")
    kinds = F.struct(chars(a).alias("a"), chars(b).alias("b"))
    alike = lambda c: (F.size(c["a"]) > 0) & (F.size(c["b"]) > 0)
    pair = lambda c: F.when(alike(c), F.struct(c["a"].alias("x"), c["b"].alias("y"))).otherwise(F.struct(other(a).alias("x"), other(b).alias("y")))
    return _let(_let(kinds, pair), lambda c: compared(c["x"], c["y"])).cast("double")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 64) -> DataFrame:
    """``id_col, fingerprint`` (the anchors' strings, joined) for every row."""
    return docs.select(id_col, F.concat_ws("", sketch(F.coalesce(F.col(text_col), F.lit("")), size)).alias("fingerprint"))


def range_of(key: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are not above ``key``: a binary search in a constant array, one step for each doubling of them."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    # at: cuts known to be not above the key; a step is taken where the cut at its end exists and is not above either
    step = lambda at, width: F.when(F.coalesce(F.try_element_at(listed, at + width) <= key, F.lit(False)), at + width).otherwise(at)
    return F.aggregate(F.array(*(F.lit(1 << i) for i in range(steps - 1, -1, -1))), F.lit(0), step)


def with_next(rows: DataFrame, key: str, tie: Column, fields: list[str], *, slices: int | None = None, slice_rows: int = 20_000, most_slices: int = 16_384) -> DataFrame:
    """Adds struct ``next``: ``fields`` of the row with the next smaller ``key`` (a whole number; after the last: the largest).

    The keys are cut into ranges of about ``slice_rows`` rows at approximate quantiles; each range is
    sorted apart, and the largest row of a range is also sent to the range above,
    where it follows the smallest. Null keys come last. Without ``slices``, there are
    64 ranges at least and twice the session's shuffle partitions, but no more than ``most_slices``, as
    their bounds are on the driver; beyond that, ranges grow and are sorted with spilling.
    """
    spark = rows.sparkSession
    if slices is None:
        wanted = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.select(key).count() // slice_rows))
        slices = min(wanted, most_slices)
    shares = F.expr("array(" + ",".join(f"{i / slices!r}D" for i in range(1, slices)) + ")") if slices > 1 else F.array(F.lit(0.5))
    cuts = sorted({x for x in rows.select(F.percentile_approx(key, shares, 10 * slices)).first()[0] or []}) if slices > 1 else []
    rows = rows.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(range_of(F.col(key), cuts)))
    # of each range, the row that comes first: at most slices + 1 rows of key and tie reach the driver
    order = [F.col(key).desc_nulls_last(), F.col("_tie").desc()]
    heads = rows.groupBy("_range").agg(F.max(F.struct(F.col(key), tie.alias("_tie"))).alias("h")).collect()
    heads = sorted(heads, key=lambda r: -r["_range"])
    above = [{"_r": h["_range"], "_k": h["h"][key], "_t": h["h"]["_tie"], "_to": heads[i - 1]["_range"]} for i, h in enumerate(heads)]
    if not above:
        return rows.select("*", F.struct(*fields).alias("next")).drop("_range")
    extra = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(above)), "array<struct<_r:int,_k:bigint,_t:bigint,_to:int>>"))))
    rows = rows.withColumn("_tie", tie)
    sent = rows.join(extra, (rows["_range"] == extra["_r"]) & rows[key].eqNullSafe(extra["_k"]) & (rows["_tie"] == extra["_t"]), "left")
    sent = sent.withColumn("_copy", F.explode(F.when(F.col("_to").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    sent = sent.withColumn("_range", F.when(F.col("_copy"), F.col("_to")).otherwise(F.col("_range")))
    w = Window.partitionBy("_range").orderBy(F.col("_copy").asc(), *order)
    out = sent.withColumn("next", F.lead(F.struct(*fields)).over(w))
    return out.where(~F.col("_copy")).drop("_range", "_tie", "_r", "_k", "_t", "_to", "_copy")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("own", sketch(F.col("text")))
    pairs = with_next(docs, "doc_id", F.xxhash64("text"), ["text", "own"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = pairs.select("doc_id", "n_chars", "own", F.col("next.own").alias("follows"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "own", "follows", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("changed"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat_ws("", "own").alias("fingerprint"), F.concat_ws("", "changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("follows")).alias("near_next"),
    )
