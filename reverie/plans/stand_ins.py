"""The sample tables seen as agent state, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.functions.scalars import micros
from reverie.sources.tables import table

#: The time of all queries: 2024-02-01 00:00 UTC.
NOW = 1_706_745_600
#: Memories are a minute apart from 2024-01-01 on.
BORN = 1_704_067_200


def memory(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("key"), "text", (F.lit(0.5) + F.pmod("doc_id", F.lit(10)) / 10.0).alias("importance"),
        (F.lit(BORN) + F.col("doc_id") * 60).alias("created_at"), F.col("lang").alias("kind"), F.array("source", F.concat(F.lit("m"), F.pmod("doc_id", F.lit(3)).cast("string"))).alias("tags"),
    )


MEMORY = f"(SELECT doc_id AS id, source AS key, text, 0.5 + (doc_id % 10) / 10.0 AS importance, {BORN} + doc_id * 60 AS created_at, lang AS kind, [source, 'm' || (doc_id % 3)::VARCHAR] AS tags FROM documents)"


def recall_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") % table(spark, d, "documents").count()).alias("id"), F.floor(micros(F.col("ts")) / 1_000_000).alias("at"))


RECALLS = '(SELECT event_id % (SELECT count(*) FROM documents) AS id, epoch_us(ts) // 1000000 AS "at" FROM events)'


def spend(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant"), F.col("event_type").alias("model"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).alias("prompt_name"), k.alias("tokens_in"), (k * 2 + 1).alias("tokens_out"), F.col("value").alias("cost_usd"), F.floor(micros(F.col("ts")) / 1_000_000).alias("recorded_at"))


SPEND = "(SELECT event_id AS id, 't' || user_id AS tenant, event_type AS model, CASE WHEN event_id % 4 > 0 THEN 'p' || (event_id % 4) END AS prompt_name, json_extract_string(props, '$.k')::BIGINT AS tokens_in, json_extract_string(props, '$.k')::BIGINT * 2 + 1 AS tokens_out, value AS cost_usd, epoch_us(ts) // 1000000 AS recorded_at FROM events)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a trace and its turns are spans: turn t hangs below turn (t - 1) div 2."""
    c = table(spark, d, "conversations")
    t = F.col("turn")
    return c.select(
        F.col("conv_id").alias("trace_id"), (F.col("conv_id") * 1000 + t).alias("span_id"), F.when(t > 0, F.col("conv_id") * 1000 + F.floor((t - 1) / 2)).alias("parent_id"), (F.col("conv_id") % 10).alias("thread_id"),
        F.concat_ws(".", "role", F.concat(F.lit("step"), t.cast("string"))).alias("name"), F.col("role").alias("kind"), (F.lit(BORN) + F.col("conv_id") * 100 + t).alias("start"), F.when(t % 5 != 4, F.lit(BORN) + F.col("conv_id") * 100 + t + F.length("text") % 7 - 1).alias("end"),
        F.when(t % 3 == 2, "error").otherwise("ok").alias("status"), (F.col("conv_id") * 1000 + t).alias("seq"),
    ).dropDuplicates(["span_id"])


SPANS = f"(SELECT DISTINCT ON (conv_id * 1000 + turn) conv_id AS trace_id, conv_id * 1000 + turn AS span_id, CASE WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2 END AS parent_id, conv_id % 10 AS thread_id, role || '.step' || turn AS name, role AS kind, {BORN} + conv_id * 100 + turn AS start, CASE WHEN turn % 5 <> 4 THEN {BORN} + conv_id * 100 + turn + length(text) % 7 - 1 END AS \"end\", CASE WHEN turn % 3 = 2 THEN 'error' ELSE 'ok' END AS status, conv_id * 1000 + turn AS seq FROM conversations)"


def puts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source are the versions of one prompt."""
    return table(spark, d, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "eval").otherwise("test").alias("split"))


PUTS = "(SELECT source AS name, doc_id AS seq, text AS content, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'eval' ELSE 'test' END AS split, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version FROM documents)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over labelled documents: a scores even and b odd thirds apart, with overlaps."""
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    a = rows.where("doc_id % 5 <> 0").select(F.lit("a").alias("run_id"), F.col("doc_id").alias("row_id"), (F.pmod(F.col("doc_id") * 7, F.lit(11)) / 10.0 * F.col("quality")).alias("score"), F.col("doc_id").alias("seq"))
    b = rows.where("doc_id % 7 <> 0").select(F.lit("b").alias("run_id"), F.col("doc_id").alias("row_id"), (F.pmod(F.col("doc_id") * 3, F.lit(11)) / 10.0 * (1 - F.col("toxic"))).alias("score"), F.col("doc_id").alias("seq"))
    return a.unionByName(b)


SCORES = "(SELECT 'a' AS run_id, doc_id AS row_id, (doc_id * 7 % 11) / 10.0 * quality AS score FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT 'b', doc_id, (doc_id * 3 % 11) / 10.0 * (1 - toxic) FROM labels WHERE doc_id % 7 <> 0)"


def invocations(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn is an input, what follows it the output."""
    c = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    nxt = c.select(F.col("conv_id").alias("nc"), (F.col("turn") - 1).alias("nt"), F.col("text").alias("reply"))
    rows = c.where("role = 'user'").join(nxt, (F.col("conv_id") == F.col("nc")) & (F.col("turn") == F.col("nt")), "left")
    return rows.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.lit("llm_call").alias("kind"), F.when(F.col("turn") % 2 == 0, "small").otherwise("large").alias("model"), F.md5(F.col("text").cast("binary")).alias("input"), F.md5(F.col("reply").cast("binary")).alias("output"))


INVOCATIONS = "(SELECT c.conv_id AS trace_id, c.turn AS seq, 'llm_call' AS kind, CASE WHEN c.turn % 2 = 0 THEN 'small' ELSE 'large' END AS model, md5(c.text) AS input, md5(n.text) AS output, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS idx FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) c LEFT JOIN (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.role = 'user')"
