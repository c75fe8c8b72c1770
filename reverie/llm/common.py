"""Helpers shared by the corpus operators: table access, shared storage, bounded samples.

Every operator reads its inputs through Spark and keeps intermediate tables in
the folder that the cluster names in ``spark.checkpoint.dir``, so that a lost
executor costs a recomputation and never a result.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, for the byte-wise tokeniser.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="reverie-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the JVM ends.

    Only a local master (tests on one machine) may do without the setting: a temporary
    folder takes its place. On a cluster each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a frame made by ``cut`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns freed memory of this process to the system, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def map_arrow(df: DataFrame, run, schema: str, rows: int = 1000) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``rows`` rows, for texts of any length: it bounds a worker's memory.

    The limit is the session's; it is lowered here and stays lowered. After a partition, a
    worker gives back what it no longer uses, as it lives on for other stages.
    """

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, rows)
    return df.mapInArrow(bounded, schema)


def slot_of(slots: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")


def slots_used(ids: DataFrame, slots: int) -> bytes:
    """A bitset over hashes of ``ids`` (column doc_id): ``slots`` bits, however many ids there are."""
    bits = np.zeros(slots, dtype=bool)
    bits[[r[0] for r in ids.select(slot_of(slots)).distinct().collect()]] = True
    return np.packbits(bits).tobytes()


def only_slots(docs: DataFrame, bits: bytes, slots: int, inside: bool) -> DataFrame:
    """The rows whose doc_id's slot is used, or not used."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)
        for batch in batches:
            yield batch.select(list(range(len(columns)))).filter(pa.array(use[batch.column(len(columns)).to_numpy()] == inside))

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_arrow(docs.select(*columns, slot_of(slots).alias("_slot")), run, kinds)


def crc_mod(key: Column, divisor: int) -> Column:
    """crc32 of the decimal text of ``key`` modulo ``divisor`` (null keys: null)."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def bounded_rows(df: DataFrame, keys: list[str], stratum: Column, most: int, *, most_rows: int | None = None, only: Column | None = None, seed: int = 17) -> DataFrame:
    """About ``most`` distinct rows of each stratum (fewer with many: ``most_rows`` in all), chosen by a seeded hash of ``keys``.

    One counting pass gives each stratum's share; the choice itself is a filter
    inside the scan, so that only chosen rows are moved. ``only`` is a further condition on those.
    Strata are classes of a label: their number must be small. Many rows with one hash (repeated
    ids, nulls) cannot exceed the bound: what is left is cut at twice ``most`` for each stratum.
    """
    counted = df.groupBy(stratum.alias("s")).count().where("s is not null").collect()
    if not counted:
        return df.limit(0)
    if most_rows is not None:
        most = max(1, min(most, most_rows // len(counted)))
    drawn = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000))
    keep = F.lit(False)
    for row in counted:
        keep = keep | ((stratum == F.lit(row["s"])) & (drawn < int(1_000_000 * min(1.0, most / row["count"]))))
    return df.where(keep if only is None else keep & only).distinct().limit(2 * most * len(counted))


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, without building words.

    The hash of bytes b[i:j] is a polynomial over the odd base modulo 2**64;
    prefix sums and the powers of the inverse give all words at once.
    """

    def __init__(self) -> None:
        self._grow(1 << 16)
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold
        space = np.zeros(256, dtype=bool)
        space[list(SPACE_BYTES)] = True
        self.space = space

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))])

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (byte offsets) of the words."""
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~self.space[data]
        edges = np.flatnonzero(np.diff(inside))
        return edges[::2], edges[1::2]

    def words(self, text: str, lower: bool) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts, ends = self.spans(data)
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        if lower:
            data = self.fold[data]
        n = len(data)
        if n >= len(self.power):
            self._grow(2 * n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[data] * self.power[:n], out=sums[1:])
            return mix64((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            out *= np.uint64(_BASE)
            out += words[j : j + n]
        return mix64(out)


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As ``window_hashes`` in time that does not depend on ``size``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), _BASE, dtype=np.uint64))])
        inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), _INVERSE, dtype=np.uint64))])
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * power[: len(words)], out=sums[1:])
        return mix64((sums[size:] - sums[:-size]) * inverse[:n])
