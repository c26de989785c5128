"""NumPy kernels over Arrow text buffers, and the small pieces of plan that several operators share.

A text column arrives in a worker as one UTF-8 buffer with offsets. The kernels hash words and byte
windows of that buffer with a polynomial prefix hash modulo 2**64, so no Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that one NumPy pass takes; a longer document is a pass of its own.
PASS_BYTES = 1 << 19


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set a folder is chosen on one machine, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def few_files(df: DataFrame, rows: int, per_file: int = 500_000) -> DataFrame:
    """df in as many partitions as its rows need, or as there are cores, where a shuffle has four times as many or more; else
    uniting some of them would only make tasks uneven."""
    need = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_file))
    return df.coalesce(need) if shuffle_partitions(df.sparkSession) >= 4 * need else df


def cut(df: DataFrame, rows: int | None = None, per_file: int = 500_000) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation.
    Where the number of rows is known, in few files."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else few_files(df, rows, per_file)).checkpoint()


class Tables:
    """Intermediate tables in a folder of their own in the shared one, until ``drop``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.n = spark, 0
        self.folder = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def over_text(docs: DataFrame, make, added: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default), then those of the schema text ``added``, which ``make()`` gives a function for: text array -> arrays.

    The texts travel to the worker once; where ``keep`` has no text they do not travel back."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at, schema = rows.columns.index("text"), StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(added).fields])

    def kernel(batches):
        work = make()
        for batch in batches:
            columns = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*columns, *work(batch.column(at))], schema.names)

    return rows.mapInArrow(kernel, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id's decimal text, reduced: the contract's fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and n+1 offsets into them; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES):
    """Ranges of rows with about ``limit`` bytes each, a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64 = BASE) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = 1 << max(12, (n - 1).bit_length())
        inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", self.base), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: polynomial hashes have weak low bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class PrefixHash:
    """Hash of any byte range of one pass in O(1)."""

    def __init__(self, raw: np.ndarray, powers: Powers) -> None:
        powers.to(len(raw) + 1)
        self.powers = powers
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.powers.down[starts] + (ends - starts).astype(np.uint64))


#: Bytes that make up words where punctuation is not wanted: letters, digits and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of one pass, and for each row the index of its first word (n+1 values).

    ``offsets`` are relative to ``raw``. A word never crosses two rows."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = word_bytes[raw]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    if len(cuts):  # words that touch across a row's end
        both = cuts[inside[cuts] & inside[cuts + 1]]
        if len(both):
            starts = np.sort(np.concatenate([starts, both]))
            ends = np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item from n+1 first-item indexes."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
