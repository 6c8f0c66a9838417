"""Tables bucketed by key with a manifest for each version: a merge rewrites the buckets it touches and no others.

    <path>/data/<write>/__b=<bucket>/part-*.parquet     files, never changed once written
    <path>/versions/<number>.json                        the files of each bucket, and marks of writers

A writer reads the buckets its keys fall into, writes their new files, and then puts the next version's manifest in place
by a rename that fails where that number exists already. So readers see whole versions, a write that fails leaves
nothing but unused files, and of two writers that start from one version the second gets an error. ``vacuum`` deletes
the files that no kept version names.

The manifest is as long as the table has files. Buckets are filled through a rebalancing exchange: one with more rows
than a task should write gets several files.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import released

#: Bytes of a file of a merged bucket, about.
FILE_BYTES = 32 << 20


class Conflict(Exception):
    """Another writer has put this version in place."""


class Folder:
    """Small files of a folder, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, under: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(under))) if self.fs.exists(self.at(under)) else []

    def files(self, under: str) -> list[tuple[str, int]]:
        """(path, bytes) of all files below."""
        out, each = [], self.fs.listFiles(self.at(under), True)
        while each.hasNext():
            s = each.next()
            out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file with this text, whole or not at all; Conflict where it exists."""
        temp = self.at(f"_{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.at(name).getParent())
        plain = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.hadoop.fs.FileContext.getFileContext(self.at("").toUri() if self.at("").toUri().getScheme() else self.fs.getUri(), self.conf).rename(self.fs.makeQualified(temp), self.fs.makeQualified(self.at(name)), plain)
        except Exception as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.hadoop.fs.Path(path), True)


@dataclass(frozen=True)
class Version:
    number: int = 0
    buckets: dict[int, list[tuple[str, int]]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    @property
    def files(self) -> list[str]:
        return [p for b in sorted(self.buckets) for p, _ in self.buckets[b]]


@dataclass(frozen=True)
class Change:
    """What a merge did: the version it made, the buckets it touched, files written and files taken over."""

    version: int
    touched: tuple[int, ...]
    written: int
    kept: int


class KeyedTable:
    """A table whose rows of one key are replaced and deleted together.

    The key column is of any type that casts to a string. Rows without a key are not stored. The number of buckets is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, schema: StructType | str | None = None, buckets: int = 64, sort: list[str] | None = None):
        """Opens the table at path, or makes it where there is none."""
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        if "table.json" not in self.folder.names():
            if key is None or schema is None:
                raise ValueError(f"no table at {path}: key and schema make one")
            schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
            self.folder.put("table.json", json.dumps({"key": key, "schema": schema.jsonValue(), "buckets": buckets, "sort": sort or []}))
        made = json.loads(self.folder.read("table.json"))
        self.key, self.schema, self.n_buckets, self.sort = made["key"], StructType.fromJson(made["schema"]), made["buckets"], made["sort"]

    # --- versions ---

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("versions")]

    def version(self, number: int | None = None) -> Version:
        """A version, the newest by default; number 0 is the empty table."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version()
        v = json.loads(self.folder.read(f"versions/{number:012d}.json"))
        return Version(number, {int(b): [tuple(x) for x in files] for b, files in v["buckets"].items()}, v["marks"])

    def _commit(self, v: Version) -> None:
        self.folder.put(f"versions/{v.number:012d}.json", json.dumps({"buckets": v.buckets, "marks": v.marks, "at": time.time()}))

    # --- rows ---

    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast("string")), F.lit(self.n_buckets)).cast("int")

    def read(self, buckets=None, number: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: other files are not opened."""
        v = self.version(number)
        return self._rows([p for b in sorted(v.buckets) if buckets is None or b in buckets for p, _ in v.buckets[b]])

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None, *, base: int | None = None, mark: tuple[str, int] | None = None, keys: DataFrame | None = None) -> Change:
        """All rows of the keys of ``rows`` are replaced by these; the keys of ``gone`` (key column) are deleted.

        keys: the keys of rows, where they can be had without making the rows. base: the version to start from, the newest by default. mark (writer, step): a step that is not beyond the writer's last one has been
        merged before and changes nothing, so a repeated batch does no harm.
        """
        old, number = self.version(base), self._next()
        if mark and old.marks.get(mark[0], -1) >= mark[1]:
            return Change(old.number, (), 0, len(old.files))
        keyed = lambda d: d.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull())
        rows = rows.select(*self.schema.names).where(F.col(self.key).isNotNull()) if rows is not None else None
        ids = [keyed(d).withColumn("n", F.lit(n)) for d, n in ((rows if keys is None else keys, 1), (gone, 0)) if d is not None]
        if not ids:
            raise ValueError("rows or gone")
        keys = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        new = {r[0]: r[1] for r in keys.groupBy(self.bucket()).agg(F.sum("n")).collect()}  # numbers of buckets, no more than there are
        touched = sorted(new)
        if not touched:
            if not mark:
                return Change(old.number, (), 0, len(old.files))
            return self._put(old, number, {}, (), mark)
        files = [f for b in touched for f in old.buckets.get(b, [])]
        if files:
            made = self._write(self._merged(files, rows, keyed(gone) if gone is not None else None, touched, sum(new.values())), F.col("__b"), dealt=True)
        else:
            made = self._write(rows) if rows is not None else {}
        return self._put(old, number, made, tuple(touched), mark)

    def _merged(self, files: list[tuple[str, int]], rows: DataFrame | None, gone: DataFrame | None, touched: list[int], n: int) -> DataFrame:
        """The rows of files without the keys of rows (n, about) and gone, and rows: old and new ones meet in one exchange, dealt by bucket, and by key where a bucket needs several files."""
        held = self._rows([p for p, _ in files])
        size = sum(s for _, s in files) * (1 + (n / max(held.count(), 1) if rows is not None else 0))
        parts = int(-(-size // (FILE_BYTES * len(touched)))) or 1
        both = held.withColumn("__new", F.lit(0))
        if gone is not None:
            both = both.unionByName(gone.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        if rows is not None:
            both = both.unionByName(rows.withColumn("__new", F.lit(2)))
        place = F.array_position(F.lit(touched), F.col("__b")).cast("int") - 1
        part = F.pmod(F.xxhash64(F.lit("file"), F.col(self.key).cast("string")), F.lit(parts)).cast("int")
        dealt = both.withColumn("__b", self.bucket()).withColumn("__p", place * parts + part).repartitionById(len(touched) * parts, F.col("__p"))
        last = dealt.withColumn("__last", F.max("__new").over(Win.partitionBy("__b", "__p", self.key)))
        return last.where((F.col("__new") == 2) | (F.col("__last") == 0))

    def replace_buckets(self, rows: DataFrame, buckets, bucket: str, *, base: int | None = None, mark: tuple[str, int] | None = None, also: dict[str, int] | None = None, dealt: bool = False) -> Change:
        """The named buckets hold these rows alone, dealt by the column ``bucket``, which need not follow from the key; also: further marks.

        dealt: the partitions of rows are such parts of few buckets as a task should write; they stay as they are.
        """
        old, number = self.version(base), self._next()
        return self._put(old, number, self._write(rows, F.col(bucket), dealt), tuple(sorted(buckets)), mark, also)

    def _write(self, rows: DataFrame, bucket: Column | None = None, dealt: bool = False) -> dict[int, list[tuple[str, int]]]:
        name = f"data/{uuid.uuid4().hex}"
        put = rows.select(*self.schema.names, (self.bucket() if bucket is None else bucket).alias("__b"))
        ordered = (put if dealt else put.hint("rebalance", F.col("__b"))).sortWithinPartitions("__b", *self.sort)
        with released(self.spark):
            ordered.write.partitionBy("__b").option("compression", "zstd").parquet(f"{self.path}/{name}")
        out: dict[int, list[tuple[str, int]]] = {}
        for path, size in self.folder.files(name):
            if "/__b=" in path:
                out.setdefault(int(path.rpartition("/__b=")[2].partition("/")[0]), []).append((path, size))
        return out

    def _next(self) -> int:
        """The number that a write which starts now has to get."""
        return max(self.numbers(), default=0) + 1

    def _put(self, old: Version, number: int, made: dict[int, list[tuple[str, int]]], touched: tuple[int, ...], mark: tuple[str, int] | None, also: dict[str, int] | None = None) -> Change:
        rest = {b: f for b, f in old.buckets.items() if b not in touched}
        self._commit(Version(number, rest | made, old.marks | ({mark[0]: mark[1]} if mark else {}) | (also or {})))
        return Change(number, touched, sum(map(len, made.values())), sum(map(len, rest.values())))

    def vacuum(self, keep: list[int] | int = 1) -> int:
        """Deletes the versions beyond the newest ``keep``, or all but the given ones, and the files that none of the rest names; how many files went.

        Not beside a running merge: its files are not named yet.
        """
        numbers = self.numbers()
        stay = set(numbers[-keep:] if isinstance(keep, int) else keep)
        named = {p for n in stay for p in self.version(n).files}
        for n in set(numbers) - stay:
            self.folder.delete(f"{self.path}/versions/{n:012d}.json")
        lost = [p for p, _ in self.folder.files("data") if p not in named] if self.folder.names("data") else []
        for p in lost:
            self.folder.delete(p)
        return len(lost)
