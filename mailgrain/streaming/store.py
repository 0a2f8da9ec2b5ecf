"""Tables that grow by batches: committed whole, read by the keys a batch touches, compacted now and then.

A table is a folder.  Every batch writes ``batch=<n>`` there; it counts once the batch is committed, so a batch that failed
half-way leaves nothing behind and its number is written again.  Compaction gathers all committed batches of a table in
``upto=<n>``, divided into folders by a number of the row (a hash bucket of its key, or its day).  A lookup reads the
folders of the numbers it asks for, and the batches since.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def bucket_of(key: str | Column) -> Column:
    """Hash bucket of a key; nulls have one of their own."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), F.lit(-1))


class BatchTables:
    """The tables of an ingest job as parquet folders under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: rows of the newest write to each table
        self.written: dict[str, int] = {}

    # ------------------------------------------------------------ folders

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        return sorted(int(n.removeprefix(prefix)) for n in self._names(folder) if n.startswith(prefix))

    def _mark(self, name: str) -> None:
        self._files().create(self._path(name), True).close()

    # ------------------------------------------------------------ batches

    def committed(self) -> int:
        """Number of the newest committed batch, -1 before the first."""
        return max(self._numbers("_commits", "batch="), default=-1)

    def commit(self, batch: int) -> None:
        self._mark(f"_commits/batch={batch}")

    def discard(self) -> None:
        """Delete what was written under numbers that are not committed."""
        newest, files = self.committed(), self._files()
        for name in self._names(""):
            for n in self._numbers(name, "batch=") if not name.startswith("_") else []:
                if n > newest:
                    files.delete(self._path(f"{name}/batch={n}"), True)

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        """Write the rows of a batch, over what a failed run of the batch left there, and read them back.

        The rows are counted as they are written (:attr:`written`).
        """
        path = f"{self.root}/{name}/batch={batch}"
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        self.written[name] = counted.get["rows"]
        return self.spark.read.schema(df.schema).parquet(path)

    def _base(self, name: str, upto: int) -> int:
        done = [n for n in self._numbers(f"_compacted/{name}", "upto=") if n <= upto]
        return max(done, default=-1)

    def _paths(self, name: str, upto: int | None, parts: Iterable[int] | None) -> list[str]:
        upto = self.committed() if upto is None else upto
        base = self._base(name, upto)
        paths = [f"{self.root}/{name}/batch={n}" for n in self._numbers(name, "batch=") if base < n <= upto]
        if base >= 0:
            folder = f"{name}/upto={base}"
            kept = self._numbers(folder, "part=")
            if parts is not None:
                wanted = set(parts)
                kept = [p for p in kept if p in wanted]
            paths += [f"{self.root}/{folder}/part={p}" for p in kept]
        return paths

    def read(self, name: str, schema, upto: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """Rows of all committed batches (or those up to one), empty without any.

        With ``parts`` the compacted rows are those of these folders only; the rows of later batches come whole, so
        the caller filters by key.
        """
        paths = self._paths(name, upto, parts)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, name: str, schema, part: Column, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Gather the committed batches of a table by ``part`` (an int); ``merge`` may sum rows up.

        The gathered folder counts once it is marked; a stop before that leaves the table as it was.  Old folders stay for
        readers that opened them; :meth:`forget` deletes them.
        """
        upto = self.committed()
        if upto < 0 or self._base(name, upto) == upto:
            return
        rows = self.read(name, schema)
        rows = (merge(rows) if merge else rows).withColumn("part", part)
        # a few files a folder at most: a hot part is split by the rebalance of the shuffle
        rows.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{name}/upto={upto}")
        self._mark(f"_compacted/{name}/upto={upto}")

    def forget(self, name: str) -> None:
        """Delete what the newest compaction of a table replaced."""
        base, files = self._base(name, self.committed()), self._files()
        for prefix in ("batch=", "upto="):
            for n in self._numbers(name, prefix):
                if n < base or (prefix == "batch=" and n == base):
                    files.delete(self._path(f"{name}/{prefix}{n}"), True)
