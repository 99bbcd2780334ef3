"""Tables in buckets of a key whose versions become visible together (I12, and the state of S5).

Below a path, data/<table>/v=<version>/bucket=<b> holds what a commit wrote for a bucket, and manifest/v=<version> has a row
for each bucket of each table that there is. Readers take the newest whole manifest, and of it only the buckets they ask
for. A commit writes the buckets that it changes and then a manifest, so one that fails leaves the version before as it
was, and buckets that it doesn't change keep their files. Where buckets get too large on average their number doubles, in
one job that deals all rows anew; so what a small batch reads and writes doesn't grow with the rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.store import latest

BUCKETS, BUCKET_ROWS = 16, 1_000_000
_MANIFEST = "name string, bucket int, folder string, rows long, buckets int"


class Buckets:
    """schemas are the tables' columns; rows are dealt by the columns `by`, which all tables have."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], by: list[str], buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.schemas, self.by, self.least, self.bucket_rows = spark, path.rstrip("/"), schemas, by, buckets, bucket_rows
        self._read: tuple[int | None, list] = (None, [])  # the last manifest read, which never changes

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        return folder(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def version(self) -> int | None:
        """The newest version whose manifest is whole."""
        fs, folder = self._files()
        found = fs.globStatus(folder(f"{self.path}/manifest/v=*/_SUCCESS")) or []
        return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=None)

    def manifest(self, version: int | None = None) -> list[tuple[str, int, str, int, int]]:
        version = self.version() if version is None else version
        if version is not None and self._read[0] != version:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()  # a row for each bucket
            self._read = (version, [tuple(r) for r in rows])
        return [] if version is None else list(self._read[1])

    def number(self) -> int:
        return next((r[4] for r in self.manifest()), self.least)

    def bucket(self, n: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.number() if n is None else n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _paths(self, name: str, rows: list[tuple[str, int, str, int, int]]) -> list[str]:
        return [f"{self.path}/data/{name}/{folder}/bucket={b}" for t, b, folder, _, _ in rows if t == name]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or these buckets of it."""
        wanted = None if buckets is None else set(buckets)
        paths = self._paths(name, [r for r in self.manifest() if wanted is None or r[1] in wanted])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def commit(self, version: int, tables: dict[str, DataFrame], buckets: list[int] | None) -> None:
        """Makes tables the whole content of these buckets (None: of all); tables not named keep theirs.

        A version that is already there is done, so a batch that is run again changes nothing; a lower one is an error.
        """
        now = self.version()
        if now is not None and version <= now:
            if version == now:
                return
            raise ValueError(f"version {version} comes after {now}")
        n = self.number()
        gone = None if buckets is None else set(buckets)
        rows = [r for r in self.manifest() if r[0] not in tables or (gone is not None and r[1] not in gone)]
        rows += self._write(f"v={version}", tables, n)
        if sum(r[3] for r in rows) > n * self.bucket_rows * len(self.schemas):
            whole = {name: self._paths(name, rows) for name in self.schemas}
            rows = self._write(f"v={version}.{2 * n}", {name: self.spark.read.schema(self.schemas[name]).parquet(*paths) for name, paths in whole.items() if paths}, 2 * n)
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def _write(self, folder: str, tables: dict[str, DataFrame], n: int) -> list[tuple[str, int, str, int, int]]:
        out = []
        for name, df in tables.items():
            path = f"{self.path}/data/{name}/{folder}"
            df.withColumn("bucket", self.bucket(n)).repartition("bucket").sortWithinPartitions("bucket", *self.by).write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = self.spark.read.schema(f"{self.schemas[name]}, bucket int").parquet(path)
            out += [(name, r["bucket"], folder, r["count"], n) for r in written.groupBy("bucket").count().collect()]
        return out

    def vacuum(self) -> None:
        """Removes what the newest manifest doesn't name; no reader or commit may be at work."""
        fs, folder = self._files()
        now = self.version()
        if now is None:
            return
        live = {(t, where, str(b)) for t, b, where, _, _ in self.manifest(now)}
        for f in fs.globStatus(folder(f"{self.path}/data/*/v=*/bucket=*")) or []:
            p = f.getPath()
            if (p.getParent().getParent().getName(), p.getParent().getName(), p.getName()[7:]) not in live:
                fs.delete(p, True)
        for f in fs.globStatus(folder(f"{self.path}/manifest/v=*")) or []:
            if f.getPath().getName() != f"v={now}":
                fs.delete(f.getPath(), True)


def upsert(store: Buckets, version: int, name: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
    """Puts rows into a table that has the last row of each key by order; only the buckets of the rows' keys are written."""
    buckets = store.touched(rows)
    both = store.read(name, buckets).unionByName(rows.select(*store.read(name, []).columns))
    store.commit(version, {name: latest(both, keys, order)}, buckets)
