"""Sharding with size-tiered compaction (DataFrame functions only).

A store is a folder of immutable runs and numbered manifests.  Each arrival is written as
a run of small shards and committed; ``compact`` merges runs of similar size (the same
power of ``fan_in``), as soon as ``fan_in`` of them are there, into one run of files of
about ``target_bytes``.  Runs of ``target_bytes * fan_in ** 4`` and more are settled:
merging them again would rewrite much and save few files.  A merge reads its inputs in
packed splits and writes them as they come: nothing is shuffled (but for targets below
the size of a split).  No file is ever changed.

A manifest lists a version's schema and runs: their folder, number of files and bytes.
Tiers keep the runs few (some ``fan_in`` a tier), so a manifest stays small whatever the
number of files, and readers list a run's folder in parallel.  It is written under
another name and moved to its own by a rename that fails if the name is taken: of two
writers one wins, and the other reads the winner's manifest, applies its change to that,
and tries again.  A commit first compares the folder of what it adds with what was
written.  Readers see one version, whole.

``vacuum`` removes old manifests and the runs that only those list.  Folders that no
manifest lists may belong to a writer that has not committed yet: they go only once they
have not been touched for ``orphan_seconds``.

Schemas: an arrival may add columns; the store then has them, null in older runs.  A
column whose type differs from the store's is refused, before anything is committed.

Defined results: null columns and repeated rows are stored as they are; an empty arrival
is a run without rows; all columns are kept, whatever their names (but two that differ by
case alone are one, as in Spark); rows without doc_id are dealt to one arrival.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Taken, new_path, read_text, table, write_text

TARGET_BYTES, FAN_IN, ARRIVALS = 128 << 20, 4, 8
#: An unlisted folder is a crashed writer's after a week.
ORPHAN_SECONDS = 7 * 24 * 3600


class Conflict(RuntimeError):
    """A change rests on runs that another writer has replaced, or on files that are gone."""


def merged_schema(old: StructType, new: StructType) -> StructType:
    """``old`` with the columns that ``new`` adds; all may be null."""
    known = {f.name.lower(): f for f in old.fields}
    fields = [StructField(f.name, f.dataType, True) for f in old.fields]
    for f in new.fields:
        before = known.get(f.name.lower())
        if before is None:
            fields.append(StructField(f.name, f.dataType, True))
        elif before.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {before.dataType.simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
    return StructType(fields)


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # files -------------------------------------------------------------------------------
    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        where = self._path(folder)
        if not self._system().exists(where):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._system().listStatus(where))

    def files(self, run: dict) -> list[tuple[str, int]]:
        """Names and sizes of a run's files."""
        return [(f"{run['id']}/{n}", size) for n, size in self._names(run["id"]) if n.endswith(".parquet")]

    def _run(self, folder: str) -> dict:
        sizes = [size for _, size in self.files({"id": folder})]
        return {"id": folder, "files": len(sizes), "bytes": sum(sizes)}

    def _check(self, run: dict) -> None:
        if self._run(run["id"]) != run:
            raise Conflict(f"files of {run['id']} are gone")

    # manifests ---------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._names("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest (None: the latest); version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        return json.loads(read_text(self.spark, f"{self.root}/manifests/v{version:012d}.json"))

    def commit(self, change) -> dict:
        """Apply ``change(manifest)`` to the latest version and commit the next one, atomically."""
        while True:
            now = self.manifest()
            new = change(json.loads(json.dumps(now))) | {"version": now["version"] + 1}
            try:
                write_text(self.spark, f"{self.root}/manifests/v{new['version']:012d}.json", json.dumps(new))
                return new
            except Taken:
                continue

    # changes -----------------------------------------------------------------------------
    def append(self, df: DataFrame) -> dict:
        """Write ``df`` as one run of small shards, and commit it."""
        self._fits(df.schema)
        folder = f"data/run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self._add(folder, df.schema)

    def append_each(self, df: DataFrame, arrival: str) -> dict:
        """Write many arrivals, told apart by a column, in one pass; commit each as a run of its own, in order."""
        schema = StructType([f for f in df.schema.fields if f.name != arrival])
        self._fits(schema)
        folder = f"data/bulk-{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(f"{self.root}/{folder}")
        done = self.manifest()
        for name in sorted((n for n, _ in self._names(folder) if n.startswith(f"{arrival}=")), key=lambda n: (len(n), n)):
            done = self._add(f"{folder}/{name}", schema)
        return done

    def _fits(self, schema: StructType) -> None:
        now = self.manifest()["schema"]
        if now:
            merged_schema(StructType.fromJson(now), schema)

    def _add(self, folder: str, schema: StructType) -> dict:
        run = self._run(folder)

        def change(m: dict) -> dict:
            self._check(run)
            now = merged_schema(StructType.fromJson(m["schema"]) if m["schema"] else StructType([]), schema)
            return m | {"schema": json.loads(now.json()), "runs": [*m["runs"], run]}

        return self.commit(change)

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fan_in))

    def plan(self) -> list[dict] | None:
        """The smallest tier's oldest ``fan_in`` runs, if some tier has that many."""
        tiers: dict[int, list[dict]] = {}
        for run in self.manifest()["runs"]:
            if run["bytes"] < self.target_bytes * self.fan_in**4:  # very large runs are settled
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        full = [t for t, runs in tiers.items() if len(runs) >= self.fan_in]
        return tiers[min(full)][: self.fan_in] if full else None

    def compact(self) -> int:
        """Merge until no tier is full; the number of merges."""
        done = 0
        while runs := self.plan():
            self.merge(runs)
            done += 1
        return done

    def merge(self, runs: list[dict]) -> dict:
        size = sum(r["bytes"] for r in runs)
        folder = f"data/run-{uuid.uuid4().hex}"
        files = max(1, round(size / self.target_bytes))
        rows = self._read(runs, self.manifest()["schema"])
        # read splits are packed up to this size; only files smaller than that need a shuffle
        split = self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        rows = rows.coalesce(files) if self.target_bytes >= split or files == 1 else rows.repartition(files)
        rows.write.parquet(f"{self.root}/{folder}")
        merged, old = self._run(folder), {r["id"] for r in runs}

        def change(m: dict) -> dict:
            if not old <= {r["id"] for r in m["runs"]}:
                raise Conflict("runs were merged by another writer")
            self._check(merged)
            return m | {"runs": [merged, *(r for r in m["runs"] if r["id"] not in old)]}

        return self.commit(change)

    def _folders(self) -> list[tuple[str, float]]:
        """Folders of runs, listed or not, with the seconds since the last change of theirs or of a file in them."""
        now, found = time.time(), []
        for name, _ in self._names("data"):
            inside = [f"data/{name}/{n}" for n, _ in self._names(f"data/{name}") if "=" in n] if name.startswith("bulk-") else []
            for folder in inside or [f"data/{name}"]:
                times = [s.getModificationTime() for s in (self._system().getFileStatus(self._path(folder)), *self._system().listStatus(self._path(folder)))]
                found.append((folder, now - max(times) / 1000))
        return found

    def vacuum(self, keep: int = 1, orphan_seconds: float = ORPHAN_SECONDS) -> int:
        """Remove manifests but the last ``keep``, the runs that only those list, and unlisted folders
        that nobody has touched for ``orphan_seconds``; the number of folders removed."""
        versions = sorted(self.versions())
        kept = {r["id"] for v in versions[-keep:] for r in self.manifest(v)["runs"]}
        replaced = {r["id"] for v in versions[:-keep] for r in self.manifest(v)["runs"]} - kept
        for v in versions[:-keep]:
            self._system().delete(self._path(f"manifests/v{v:012d}.json"), False)
        replaced |= {folder for folder, age in self._folders() if folder not in kept and age > orphan_seconds}
        for folder in replaced:
            self._system().delete(self._path(folder), True)
        return len(replaced)

    # reading -----------------------------------------------------------------------------
    def _read(self, runs: list[dict], schema: dict) -> DataFrame:
        shape = StructType.fromJson(schema)
        full = [f"{self.root}/{r['id']}" for r in runs if r["files"]]
        return self.spark.read.schema(shape).parquet(*full) if full else self.spark.createDataFrame([], shape)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        return self._read(m["runs"], m["schema"])


def sharded(docs: DataFrame, arrivals: int = ARRIVALS, **settings) -> ShardStore:
    """A store of ``docs``, which come as ``arrivals`` arrivals (by hash of the doc_id), compacted."""
    store = ShardStore(docs.sparkSession, new_path(docs.sparkSession, "shards"), **settings)
    name = "_arrival"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    store.append_each(docs.withColumn(name, F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(arrivals)).cast("int")), name)
    if not store.versions():  # no rows, no arrivals
        store.append(docs)
    store.compact()
    store.vacuum()
    return store


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The stored rows of the compacted version, read through its manifest."""
    rows = sharded(table(spark, sf_dir, "documents")).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
