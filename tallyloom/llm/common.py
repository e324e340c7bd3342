"""Shared parts of the text operators: table access, work folders and Arrow row mapping."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "__text"
#: Bytes of text that one call of a mapping function gets, unless a single text is longer.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor reaches.

    Where that is unset, a local session (as in tests) gets a folder of its own; a cluster is refused, as its executors share none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tallyloom-"))
        top = _own[0]
    return f"{top.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a written table: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, id_col: str = "id", path: str | None = None) -> DataFrame:
    """df as a written table with a number from 1 on for each row: its place in its file, after the rows of the files before.

    What goes to the driver and back is a row for each written file."""
    spark, path = df.sparkSession, path or work_dir(df.sparkSession)
    written(df, path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before, offsets = 1, []
    for r in rows.groupBy("__file").count().orderBy("__file").collect():
        offsets.append((r["__file"], before))
        before += r["count"]
    firsts = spark.createDataFrame(offsets, "__file string, __first long")
    return rows.join(F.broadcast(firsts), "__file").withColumn(id_col, F.col("__first") + F.col("__row")).drop("__file", "__row", "__first")


def remove(spark: SparkSession, top: str, *tables: str) -> None:
    """Deletes work tables that nothing reads any more, through the file system that Spark uses for them."""
    for t in tables:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{t}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Lets Spark put a Bloom filter of the smaller side's keys, of its usual bounded size, on the larger side's scan at any size.
_RUNTIME_FILTER = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1B"}


@contextlib.contextmanager
def runtime_filters(spark: SparkSession):
    """While it is open, queries that run join a few keys with long rows without shuffling the rows that surely do not match."""
    before = {k: spark.conf.get(k, None) for k in _RUNTIME_FILTER}
    for k, v in _RUNTIME_FILTER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slices(lengths: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to at most `most`, or that hold one row."""
    lo = size = 0
    for i, n in enumerate(lengths):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)


def map_texts(df: DataFrame, text_col: str, keep: list[str], out: T.StructType, make: Callable[[], Callable[[list[bytes]], dict]], most: int = SLICE_BYTES) -> DataFrame:
    """Keeps the columns `keep` and appends those of `out`, which make()(texts) returns as arrays by name.

    Texts come as UTF-8 bytes, null as b"". Kept columns with the name of a column of `out` go, as do all columns not in `keep`.
    """
    names = [f.name for f in out]
    kept = [c for c in keep if c not in names]
    src = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)], col(text_col).cast("string").alias(TEXT))
    schema = T.StructType([T.StructField(f"k{i}", src.schema[i].dataType) for i in range(len(kept))] + list(out))
    types = None

    def run(batches):
        nonlocal types
        from pyspark.sql.pandas.types import to_arrow_type

        types = types or {f.name: to_arrow_type(f.dataType) for f in out}
        fn = make()
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in slices(sizes, most):
                part = [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
                got = fn(part)
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                cols += [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], types[n]) for n in names]
                yield pa.RecordBatch.from_arrays(cols, [*(f"k{i}" for i in range(len(kept))), *names])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    mapped = src.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(n) for n in names])


def others(df: DataFrame, text_col: str) -> list[str]:
    return [c for c in df.columns if c != text_col]


#: Maps UTF-8 bytes to the words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with A-Z lower-cased: all else becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lower-cases A-Z only.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


# ---- words as numbers ----

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, the first n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial of the first i bytes: span_hashes gives any run's hash from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end): equal for equal bytes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_428_361_577
_prime_powers: list[np.ndarray] = []


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        x = (x & _PRIME) + (x >> np.uint64(31))
    return x


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime 2 ** 31 - 1, the first n of each."""
    if not _prime_powers or len(_prime_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME))):
            out, done = np.ones(size, np.uint64), 1
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = out[:more] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
                done += more
            tables.append(out)
        _prime_powers[:] = tables
    return _prime_powers[0][:n], _prime_powers[1][:n]


def token_hashes(texts: list[bytes], table: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs that `table` does not map to spaces), and the number of words of each text.

    Polynomials modulo 2 ** 64 alone are equal for known pairs of long words whatever their base, so one modulo a prime is mixed in."""
    data = np.frombuffer(b" ".join(texts).translate(table) + b" ", np.uint8)
    prefix = prefix_hashes(data)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], data != 32, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    first = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    up, down = prime_powers(len(data))
    np.cumsum(_folded((data.astype(np.uint64) + np.uint64(1)) * up, 1), out=prefix[1:])
    second = _folded(_folded(prefix[ends] - prefix[starts], 2) * down[starts], 3)
    second[second >= _PRIME] -= _PRIME
    return mixed(first + second * np.uint64(0xD1342543DE82EF95)), counts
