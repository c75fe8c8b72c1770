"""Reading and writing tables, exports and snapshots on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the memory export, in order (fixed values); none is null.
EXPORT_COLUMNS = ("id", "key", "text", "embedding", "importance", "created_at_ns")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One atomic commit of files; readers see all of it or nothing."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def compact(memory: DataFrame, forgotten: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrites the table without removed rows."""
    memory.join(forgotten.select("id").distinct(), "id", "left_anti").write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


def export_memory(memory: DataFrame, path: str) -> int:
    """Writes the export's columns with snappy and returns the number of rows; an empty store still writes its schema."""
    rows = memory.select(
        "id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("embedding").cast("array<float>"), F.array().cast("array<float>")).alias("embedding"),
        F.coalesce(F.col("importance").cast("float"), F.lit(1.0).cast("float")).alias("importance"), (F.coalesce(F.col("created_at"), F.lit(0)) * 1_000_000_000).cast("long").alias("created_at_ns"),
    )
    rows.write.option("compression", "snappy").mode("errorifexists").parquet(path)
    return memory.sparkSession.read.parquet(path).count()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://")[-1].split(":")[-1]
    return files.select(F.regexp_replace("path", f"^.*{root}/", "").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_snapshot(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``path, problem`` (missing, changed, unexpected) of files that differ from a manifest; none if it is sound."""
    now = manifest(spark, path).select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    both = expected.join(now, "path", "full")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def copy_folder(spark: SparkSession, source: str, target: str, *, force: bool = False) -> str | None:
    """Copies a folder. A target with files is refused or, by ``force``, moved aside; returns where to."""
    there, fs = _files(spark, target)
    backup = None
    if fs.exists(there) and len(fs.listStatus(there)):
        if not force:
            raise FileExistsError(target)
        backup = target.rstrip("/") + ".backup"
        fs.rename(there, _files(spark, backup)[0])
    here, source_fs = _files(spark, source)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, here, fs, there, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    return backup


def put_object(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one object on any file system that Spark reaches, in place of one that is there."""
    where, fs = _files(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def get_object(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0][0])


def delete_object(spark: SparkSession, path: str) -> bool:
    where, fs = _files(spark, path)
    return fs.delete(where, False)


def documents_from_files(spark: SparkSession, path: str) -> DataFrame:
    """``uri, content_type, text`` of the files below a folder; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.col("path").endswith(".html"), "text/html").when(F.col("path").endswith(".md"), "text/markdown").otherwise("text/plain")
    return files.select(F.col("path").alias("uri"), kind.alias("content_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
