"""Size-tiered compaction of immutable shards under a versioned manifest (operator 8).

Arrivals become small immutable Parquet shards. Compaction takes shards of a
similar size, merges runs of them into files of about the target size, and
commits a new manifest version in one rename. Readers see a version entirely or
not at all; a writer that dies leaves files that no manifest names. DataFrame
reads and writes only; a merge reads its run's files in one task and streams
them into one file, without a shuffle.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import documents, filesystem, scratch, text_or_empty


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    """The shards of a version, and all columns that any of them has had."""

    shards: tuple[Shard, ...] = ()
    schema: StructType = StructType()


def merged(old: StructType, new: StructType) -> StructType:
    """Columns of both, in the order of their first arrival; all may be null. A type that changes is refused."""
    fields = {f.name: f for f in old.fields}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values()))


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards below ``root``: ``data/`` with Parquet files, ``manifest/`` with versions.

    ``target``: bytes of a full shard, which is never merged again. ``fanout``:
    how many times larger the shards of the next tier are, and how many shards
    of a tier are needed before it is merged (a final ``compact(all=True)`` also
    merges fewer). ``wave``: runs that one Spark job merges.

    The manifest has the columns of every arrival: a shard that lacks one gives
    null there, before and after a merge. Rows are kept as they are: nulls,
    repeated rows and texts of any length take no special way, and order does
    not matter. A column may have any name that Parquet takes.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20, wave: int = 256):
        self.spark, self.root, self.target, self.fanout, self.smallest, self.wave = spark, root.rstrip("/"), target, fanout, smallest, wave
        self.fs, _ = filesystem(spark, root)
        for d in ("data", "manifest"):
            self.fs.mkdirs(self._path(f"{self.root}/{d}"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size > self.smallest else 0

    # -- manifest ------------------------------------------------------------

    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> Manifest:
        """A version (default: the latest); version 0 is empty."""
        version = self.version() if version is None else version
        if version == 0:
            return Manifest()
        stream = self.fs.open(self._path(f"{self.root}/manifest/v{version:012d}.json"))
        try:
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        found = json.loads(raw)
        return Manifest(tuple(Shard(**x) for x in found["shards"]), StructType.fromJson(found["schema"]))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version (default: the latest)."""
        return list(self.state(version).shards)

    def commit(self, based_on: int, state: Manifest) -> int:
        """Make ``state`` the version after ``based_on``, or raise ``Conflict``.

        The file is written under another name and renamed; the rename refuses
        an existing version.
        """
        jvm, new = self.spark._jvm, based_on + 1
        final = self._path(f"{self.root}/manifest/v{new:012d}.json")
        temp = self._path(f"{self.root}/manifest/.{new}-{jvm.java.util.UUID.randomUUID()}")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": new, "shards": [asdict(s) for s in state.shards], "schema": state.schema.jsonValue()}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kind, 0)
        try:
            context.rename(temp, final, none)
        except Exception as e:
            self.fs.delete(temp, False)
            if self.fs.exists(final):
                raise Conflict(f"version {new} exists") from e
            raise
        return new

    # -- data ----------------------------------------------------------------

    def _files(self, directory: str) -> list[tuple[str, int]]:
        found = [(s.getPath().toString(), s.getLen()) for s in self.fs.listStatus(self._path(directory)) if s.isFile() and s.getPath().getName().endswith(".parquet")]
        return sorted(found)

    def append(self, df: DataFrame, arrivals: str | None = None) -> int:
        """Write the rows of ``df`` as small shards and commit them; returns the version.

        Every task writes its rows where it is, one shard per task (and per value
        of the column ``arrivals``, null among them, each value a commit of its
        own). No rows: a version with the same shards and the columns of ``df``.
        A column of the type that another arrival does not have raises
        ``ValueError`` before anything is committed.
        """
        merged(self.state().schema, df.schema)
        where = f"{self.root}/data/a-{self.spark._jvm.java.util.UUID.randomUUID()}"
        apart = "__arrival"
        while apart in df.columns:
            apart += "_"
        writer = df.withColumn(apart, F.col(f"`{arrivals}`") if arrivals else F.lit(0))
        writer.write.partitionBy(apart).option("compression", "zstd").parquet(where)
        version = self.version()
        parts = sorted(s.getPath().toString() for s in self.fs.listStatus(self._path(where)) if s.isDirectory())
        for part in parts or [None]:
            new = tuple(Shard(p, n, self.tier(n)) for p, n in self._files(part)) if part else ()
            version = self._retry(version, lambda old, new=new: Manifest(old.shards + new, merged(old.schema, df.schema)))
        return version

    def _retry(self, version: int, change) -> int:
        for _ in range(20):
            try:
                return self.commit(version, change(self.state(version)))
            except Conflict:
                version = self.version()
        raise Conflict("too many concurrent commits")

    def plan(self, shards: list[Shard], all: bool = False) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, in the order of their names, up to the target size.

        A shard of at least half the target is full. ``all``: the rest of every
        tier is merged across tiers as well, smallest first.
        """
        runs: list[list[Shard]] = []

        def cut(row: list[Shard], least: int) -> list[Shard]:
            run: list[Shard] = []
            for s in row:
                if run and sum(x.bytes for x in run) + s.bytes > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            if len(run) >= least:
                runs.append(run)
                return []
            return run

        rest: list[Shard] = []
        by_tier: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target:
                by_tier.setdefault(s.tier, []).append(s)
        for tier in sorted(by_tier):
            row = sorted(by_tier[tier], key=lambda s: s.path)
            rest += cut(row, self.fanout) if len(row) >= self.fanout else row
        if all and len(rest) > 1:
            cut(sorted(rest, key=lambda s: (s.bytes, s.path)), 2)
        return [r for r in runs if len(r) > 1]

    def compact(self, all: bool = False) -> int:
        """Merge until no tier has a run left; returns the version. Replaced files stay until ``vacuum``."""
        while runs := self.plan((state := self.state()).shards, all):
            for at in range(0, len(runs), self.wave):
                wave = runs[at : at + self.wave]
                where = f"{self.root}/data/m-{self.spark._jvm.java.util.UUID.randomUUID()}"
                frames = [self._rows(state.schema, r).coalesce(1) for r in wave]
                rows = frames[0]
                for f in frames[1:]:
                    rows = rows.unionByName(f)
                rows.write.option("compression", "zstd").parquet(where)
                gone = {s.path for r in wave for s in r}
                # the tier after a merge is above that of its parts, so a run is merged log(target) times at most
                floor = 1 + max(s.tier for r in wave for s in r)
                new = tuple(Shard(p, n, max(floor, self.tier(n))) for p, n in self._files(where))

                def change(old: Manifest, gone=gone, new=new) -> Manifest:
                    if not gone <= {s.path for s in old.shards}:
                        raise RuntimeError("a shard of the run has been replaced by another writer")
                    return Manifest(tuple(s for s in old.shards if s.path not in gone) + new, old.schema)

                self._retry(self.version(), change)
        return self.version()

    def _rows(self, schema: StructType, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with all its columns; a version without shards has no rows."""
        state = self.state(version)
        return self._rows(state.schema, list(state.shards)) if state.shards else self.spark.createDataFrame([], state.schema)

    def vacuum(self, keep: int = 2, age: float = 86_400.0) -> int:
        """Delete data files that none of the latest ``keep`` versions names and that are ``age`` seconds old; returns how many.

        A writer's files are there before its commit and readers hold on to a
        version for a while, so ``age`` must be longer than either takes.
        """
        last = self.version()
        named = {self._path(s.path).toUri().getPath() for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)}
        n, todo, before = 0, self.fs.listFiles(self._path(f"{self.root}/data"), True), (time.time() - age) * 1000
        old = []
        while todo.hasNext():
            f = todo.next()
            p = f.getPath()
            if p.getName().endswith(".parquet") and p.toUri().getPath() not in named and f.getModificationTime() <= before:
                old.append(p)
        for p in old:
            n += bool(self.fs.delete(p, False))
        return n


def shard(df: DataFrame, root: str, arrivals: str, **sizes: int) -> ShardStore:
    """Append the arrivals of ``df`` and compact everything; an empty ``df`` gives a version without rows.

    Replaced files stay until ``vacuum``.
    """
    store = ShardStore(df.sparkSession, root, **sizes)
    store.append(df, arrivals)
    store.compact()
    store.compact(all=True)
    return store


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the committed shards, with their arrival and a digest of the text."""
    docs = documents(spark, sf_dir).withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0)).cast("int"))
    store = shard(docs, scratch(spark, "shards"), "arrival")
    store.vacuum(keep=1, age=0.0)  # nobody else knows this store yet
    return store.read().select("doc_id", "arrival", "lang", "source", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), F.md5(text_or_empty()).alias("text_md5"))


OP8_SQL = """
SELECT doc_id, CAST(COALESCE(doc_id % 4, 0) AS INTEGER) AS arrival, lang, source,
       CAST(OCTET_LENGTH(ENCODE(COALESCE(text, ''))) AS BIGINT) AS n_bytes, MD5(COALESCE(text, '')) AS text_md5
FROM documents
"""
