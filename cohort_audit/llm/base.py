"""Helpers that the training-data operators share: shared tables, Arrow text buffers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that the numpy kernels take at a time; a longer document is taken alone.
CHUNK_BYTES = 1 << 19
#: Rows of text that Spark hands to a Python worker at a time: texts are long, and a worker holds a batch whole.
BATCH_ROWS = 1000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs in one local process (tests) a
    temporary folder is made once for the session; on a cluster that is an error, as executors do not share such a folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cohort_audit.sharedDir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("cohort_audit.sharedDir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    swept(spark)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so after garbage collections of the driver, which are rare where the heap has room; until then the files of every plan
    add up on the disk, with many partitions mostly as small files.
    """
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of the shared folder that are deleted together, once what was made of them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        swept(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


#: Rows of one key that make it heavy; buckets of keys of which those with a heavy one are told to all tasks; tasks that share a
#: heavy bucket's keys.
HEAVY, BUCKETS, SALTS = 1000, 1 << 14, 16


def split_join(many: DataFrame, few: DataFrame, on: list[str], heavy: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, where the rows of ``many`` of a heavy key (a row of ``heavy``) go to several tasks.

    Only the numbers of the buckets of keys that hold a heavy one are broadcast, at most ``BUCKETS`` whatever the input. Rows
    of ``many`` in such buckets go to ``SALTS`` tasks a key, by a hash of ``spread``; those of ``few`` are repeated.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    hot = heavy.select(bucket.alias("__bucket")).distinct().withColumn("__hot", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", bucket).join(F.broadcast(hot), "__bucket", "left").drop("__bucket")

    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    left = marked(many).withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = marked(few).withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def whole_row(df: DataFrame) -> Column:
    """A row as one struct, whatever its columns are called."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker else keeps the peak of its last task beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives back its memory, and the powers that :class:`Rolling` keeps, once a task's batches are done."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            Rolling._powers.clear()
            give_back()

    return whole


def batched(df: DataFrame) -> DataFrame:
    """``df``; Python workers get at most ``BATCH_ROWS`` rows at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that further columns of any name do no harm; batches of at most ``BATCH_ROWS`` rows."""
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_share(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from the hash of an id: rows below a share are a sample that depends on ids alone."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 31)) / F.lit(float(1 << 31))


def bounded_sample(df: DataFrame, n: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, those of the smallest id hashes (null ids left out).

    The hash first thins the table to about 2 n rows wherever they lie, so that tasks have little to sort and to send.
    """
    rows = df.where(F.col(doc_id).isNotNull())
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(id_share(doc_id) < 2 * n / total)
    return rows.orderBy(id_share(doc_id), doc_id).limit(n)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def byte_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a batch's UTF-8 texts, at most ``most`` bytes unless one row has more."""
    col = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def row_chunks(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, unless one row has more."""
    for lo, hi, _, _ in byte_chunks(batch, column, most):
        yield batch.slice(lo, hi - lo)


def kept_rows(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], most: int = 1 << 20) -> DataFrame:
    """``docs`` with the rows whose flag is true; ``keep`` sees batches of ``text`` alone. No row is matched by its id."""
    batched(docs)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # any column name passes through
    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, docs.schema, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(names.index("text")).cast(pa.string())], ["text"])
            for lo, hi, _, _ in byte_chunks(texts, "text", most):
                yield batch.slice(lo, hi - lo).filter(pa.array(keep(texts.slice(lo, hi - lo))))

    return docs.toDF(*plain).mapInArrow(frugal(run), schema).toDF(*names)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any range of a buffer (bytes, or 64-bit hashes of words) in constant time, by prefix sums of a polynomial modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = int(mix(np.array([seed], np.uint64), 77)[0]) | 1
        value = mix(np.arange(256, dtype=np.uint64), seed + 100)[data] if data.dtype == np.uint8 else data
        self.inverse, power = self._of(base, len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(value * power[: len(data)], out=self.sums[1:])

    @classmethod
    def _of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        kept = cls._powers.get(base)
        if kept is None or len(kept[0]) < n:
            size = max(n, CHUNK_BYTES + 1)

            def powers(b: int) -> np.ndarray:
                x = np.full(size, b, np.uint64)
                x[0] = 1
                with np.errstate(over="ignore"):
                    return np.multiply.accumulate(x)

            kept = powers(pow(base, -1, 2**64)), powers(base)
            if size <= 4 * CHUNK_BYTES:
                cls._powers[base] = kept
        return kept

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Unfinished hashes of [start, end); equal bytes give equal hashes wherever they lie."""
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * (self.inverse[start] if not isinstance(start, slice) else self.inverse[: len(self.sums)][start])


#: Word characters for shingles: ASCII letters (folded to lower case) and digits, and every byte of a non-ASCII character.
FOLD = np.zeros(256, np.uint8)
FOLD[48:58], FOLD[97:123], FOLD[65:91], FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes; a run ends where its row ends."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def to_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
