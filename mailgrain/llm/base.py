"""What the operators of this subpackage share: shared tables, code shipping and vectorised text arrays.

Texts are handled as UTF-8 bytes.  A chunk is a run of documents of at most ``CHUNK_BYTES`` bytes (or one longer
document); word bounds and hashes of a whole chunk are found with numpy, so no Python loop runs over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 18

# ---------------------------------------------------------------- session

_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 8 << 20


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and bound the bytes of Arrow batches if nobody has."""
    context = spark.sparkContext
    # texts may be long: bound Arrow batches by bytes, not only by rows
    if spark.conf.get(_BATCH_BYTES, None) in (None, str((1 << 63) - 1), f"{(1 << 63) - 1}b", "-1"):
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="mailgrain-llm-code-")) / "mailgrain_llm.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="mailgrain-llm-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """:func:`store` in buckets of ``column``, as many as shuffles have parts: a join or grouping on it leaves the rows where
    they are.  The files lie in the shared folder; the session's catalog only knows that they are bucketed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(parts, column).write.format("parquet").bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(label)
    return spark.table(label)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a stored table that no result reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    root = shared_root(spark).split("://")[-1].removeprefix("file:")
    for folder in folders:
        if "/llm-" in folder and root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it keeps until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- arrow batches


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of ``column`` (a longer row stands alone)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + limit, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offsets of each; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, raw_offsets, raw = wide.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[wide.offset: wide.offset + len(wide) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def schema_of(df: DataFrame, keep: list[str], more: str) -> StructType:
    """Schema of the columns ``keep`` of ``df`` followed by those of the DDL string ``more``."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(more).fields)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


# ---------------------------------------------------------------- memory of reused workers

_held: dict[str, object] = {}


def held(name: str, build: Callable[[], object]):
    """A large table that a Python worker keeps from task to task; only one is kept."""
    if name not in _held:
        let_go()
        _held[name] = build()
    return _held[name]


def let_go() -> None:
    """Give back what a worker holds for another operator, to the system too."""
    if _held:
        _held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- words

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: words are runs of anything but the six ASCII white-space characters
NOT_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: words are runs of digits, lower-case letters and non-ASCII characters
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, mod 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any stretch of a symbol sequence (64-bit codes) in constant time each."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * _GOLD)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each position that has as many after it."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


class Words:
    """Words of a chunk: byte bounds, hashes and the first word of each document."""

    def __init__(self, column: pa.Array, lower: bool, alphabet: np.ndarray):
        let_go()
        data, offsets = byte_arrays(column)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = alphabet[self.data]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        before[offsets[:-1]] = False
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[offsets[1:]] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.rolling = Rolling(BYTE_CODE[self.data])
        self.hash = self.rolling.of(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x
