"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, in doc_id order.  A *run* is an immutable table of (h1, h2,
owner): the 128-bit hash of a line's key and the smallest doc_id that holds it, bucketed
by the hash, one sorted file a bucket.  Each batch finds its own keys (a grouped minimum),
merge-anti-joins them with every run, and adds the rest as a new run of level 0; as soon
as a level has ``FAN_IN`` runs they are merged into one of the next.  A batch's keys are
dealt into the runs' buckets and sorted; the runs are read in their order, neither dealt
nor sorted again.

A line is dropped where its key's owner is another document: an earlier batch's, or the
smallest of its own batch.

Runs live in a folder with numbered lists of the levels, each committed by a rename that
fails if its name is taken; ``LineRuns`` opened on a folder goes on from the last one, in
any session, so that later arrivals lose what earlier ones held (``dedup(docs, runs)``).

Defined results: null or empty text is one empty line; keys shorter than ``MIN_CHARS``
code points are never dropped; rows without doc_id count as one document that comes
last; repeated rows are the same document and lose the same lines; empty tables give
empty results; further columns are handed through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CHARS, Taken, ascii_lower, let, materialize, names_in, new_path, read_text, remove, table, write_text

MIN_CHARS, BATCHES, FAN_IN = 10, 4, 3
#: Stands for a missing doc_id: after all others.
LAST = 2**63 - 1
KEY = ["h1", "h2"]


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a scan of buckets with one sorted file each is known to be sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled runs.  ``levels[i]`` lists the run tables of level i, oldest first.

    Without ``root`` they last as long as the driver.  One writer at a time: a second one's commit fails.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.levels = spark, fan_in, []
        self.root = (root or new_path(spark, "line-runs")).rstrip("/")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = max((int(n[1:-5]) for n in names_in(spark, f"{self.root}/levels") if n.endswith(".json")), default=0)
        if self.version:
            found = json.loads(read_text(spark, self._list(self.version)))
            self.buckets, self.levels = found["buckets"], found["levels"]
            for name in (n for level in self.levels for n in level):
                self._forget(name)
                spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _list(self, version: int) -> str:
        return f"{self.root}/levels/v{version:09d}.json"

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # dealt as the buckets are, so that a task writes one file: a bucket
        dealt = rows.select(*KEY, "owner").repartition(self.buckets, *KEY)
        dealt.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, rows: DataFrame) -> None:
        """Add rows whose keys no run holds yet; merge levels that have grown full; commit."""
        levels, gone, name, level = [list(x) for x in self.levels], [], self._write(rows), 0
        made = [name]
        while True:
            levels += [[]] * (level + 1 - len(levels))
            levels[level] = [*levels[level], name]
            if len(levels[level]) < self.fan_in:
                break
            merged = self.spark.table(levels[level][0])
            for other in levels[level][1:]:
                merged = merged.unionByName(self.spark.table(other))
            gone += levels[level]
            name, levels[level], level = self._write(merged), [], level + 1
            made.append(name)
        try:
            write_text(self.spark, self._list(self.version + 1), json.dumps({"buckets": self.buckets, "levels": levels}))
        except Taken as e:
            for new in made:
                self._forget(new)
                remove(self.spark, f"{self.root}/{new}")
            raise RuntimeError(f"another writer has changed the runs of {self.root}") from e
        self.version, self.levels = self.version + 1, levels
        for old in gone:
            self._forget(old)
            remove(self.spark, f"{self.root}/{old}")

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay

    def close(self) -> None:
        """Take the runs' names from the catalog; the folder stays as it is."""
        for level in self.levels:
            for name in level:
                self._forget(name)

    def new_keys(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys(h1, h2, ...)`` that no run holds: a merge anti-join with each run."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): every line whose key is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(ascii_lower(text), "\n")).alias("pos", "_line"),
    ).withColumn("_line", F.btrim("_line", F.lit(BLANK_CHARS)))
    return lines.where(F.char_length("_line") >= min_chars).select("doc_id", "text_hash", "pos", F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit("second"), F.col("_line")).alias("h2"))


def batch_drops(own: DataFrame, runs: LineRuns, keep: bool = True) -> DataFrame:
    """(doc_id, text_hash, drops) of one batch's lines: the sorted places of each document's dropped
    lines, where it has any.  With ``keep``, the batch's new keys become a run."""
    keys = materialize(own.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_most")), "line-keys")
    held_before = bool(runs.runs())
    with sorted_scans(runs.spark):
        fresh = materialize(runs.new_keys(keys), "fresh-keys") if held_before else keys
    # lines to drop have a key held before, or a smaller holder in this batch
    shared = fresh.where("owner < _most").select(*KEY, "owner")
    if held_before:
        held = keys.join(fresh.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(None).cast("long").alias("owner"))
        shared = shared.unionByName(held)
    gone = own.join(shared, KEY).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = materialize(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("drops")), "line-drops")
    if keep:
        runs.add(fresh)
    return drops


def dropped_lines(docs: DataFrame, n_batches: int = BATCHES, min_chars: int = MIN_CHARS, fan_in: int = FAN_IN) -> DataFrame:
    """The drops of a whole table, in ``n_batches`` batches by doc_id."""
    spark = docs.sparkSession
    ends = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n_batches for i in range(1, n_batches)], 10_000)).first()[0] or []
    ends = sorted(set(ends))
    batch = sum([(F.col("doc_id") > e).cast("int") for e in ends], F.lit(0))
    path = new_path(spark, "lines")
    line_keys(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(path)
    found = None
    with LineRuns(spark, fan_in=fan_in) as runs:
        for b in range(len(ends) + 1):
            drops = batch_drops(lines.where(F.col("batch") == b).drop("batch"), runs, b < len(ends))
            found = drops if found is None else found.unionByName(drops)
    return found


def without(lines: Column, drops: Column) -> Column:
    """``lines`` but for the places in ``drops`` (sorted): the slices between them, joined."""
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(drops, k - 1) + 1)
    stop = lambda k, all_lines: F.when(k == F.size(drops), F.size(all_lines)).otherwise(F.get(drops, k))
    return let(lines, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), lambda k: F.slice(x, start(k) + 1, stop(k, x) - start(k)))))


def dedup(docs: DataFrame, runs: LineRuns | None = None, **settings) -> DataFrame:
    """One row per row of ``docs``: _doc (the whole row), n_lines, n_dropped, kept (the text that stays).

    With ``runs``, ``docs`` is one arrival: it also loses what the runs hold, and its own keys are added to them.
    """
    if runs is None:
        drops = dropped_lines(docs, **settings)
    else:
        drops = batch_drops(materialize(line_keys(docs, **settings), "lines"), runs)
    drops = drops.withColumnsRenamed({"doc_id": "_i", "text_hash": "_h"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_hash"))
    joined = rows.join(drops, (F.col("_id") == F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    split = F.split(text, "\n")
    kept = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(without(split, F.col("drops")), "\n"))
    return joined.select("_doc", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def deduplicated_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the kept text; n_chars follows.  A document that loses all lines stays, with empty text."""
    found = dedup(docs, **settings)
    changed = F.col("n_dropped") > 0
    value = {"text": F.when(changed, F.col("kept")).otherwise(F.col("_doc.text")), "n_chars": F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[value.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
