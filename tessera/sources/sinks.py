"""Sinks: tables by property, dimension tables, token TSV, reports, and a cache by settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import nested_hash
from tessera.storage import shared_folder


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges partitioned by property, sorted by source inside files; properties that are there already stay."""
    edges.sortWithinPartitions("prop", "src", "pos").write.mode("append").partitionBy("prop").parquet(path)


def missing_properties(spark: SparkSession, path: str, props: list[str]) -> list[str]:
    """Those of ``props`` that the edge table has no partition of."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [p for p in props if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, f"prop={p}"))]


def write_dimension(names: DataFrame, path: str) -> None:
    """A dictionary of strings and dense ids, sorted by the string so that prefixes lie together."""
    names.repartitionByRange("anchor").sortWithinPartitions("anchor").write.parquet(path)


def with_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The entries of a dictionary that start with ``prefix``: a range of the sorted column, so files and row
    groups without any are skipped by their least and greatest value."""
    names = spark.read.parquet(path)
    return names.where((F.col("anchor") >= prefix) & F.col("anchor").startswith(prefix))


def lookup(spark: SparkSession, path: str, keys: list[str]) -> dict[str, int]:
    """Ids of some strings of a dictionary, for a few at a time (a join serves many)."""
    found = spark.read.parquet(path).where(F.col("anchor").isin(keys)).collect()  # a row a key
    return {r["anchor"]: r["anchor_id"] for r in found}


def write_examples(examples: DataFrame, path: str, chunk: int = 1500) -> None:
    """Windowed examples in files of at most ``chunk``."""
    examples.write.option("maxRecordsPerFile", chunk).parquet(path)


def write_token_tsv(tokens: DataFrame, path: str) -> None:
    """Token rows as TSV, a blank line after each paragraph: one text line group for each (doc_id, para), in order."""
    line = F.concat_ws("\t", "token", "qid", "context_qid", F.col("anchor_id").cast("string"))
    paragraphs = tokens.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    text = F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n"))
    paragraphs.orderBy("doc_id", "para").select(text.alias("value")).write.text(path)


def html_rows(examples: DataFrame) -> DataFrame:
    """``examples(doc_id, text, predicted, label)`` to a table row of HTML each; wrong ones are marked."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    mark = F.when(F.col("predicted").eqNullSafe(F.col("label")), F.lit("right")).otherwise(F.lit("wrong"))
    return examples.select("doc_id", F.concat(F.lit('<tr class="'), mark, F.lit('"><td>'), esc("text"), F.lit("</td><td>"), esc("predicted"), F.lit("</td><td>"), esc("label"), F.lit("</td></tr>")).alias("html"))


def stamp(spark: SparkSession, path: str) -> list:
    """Name, size and time of the file at ``path``, or of each file below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    walk, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while walk.hasNext():
        f = walk.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found)


def cached(spark: SparkSession, settings: dict, make: Callable[[], DataFrame], inputs: tuple[str, ...] = ()) -> DataFrame:
    """The table that ``make`` gives, stored under a hash of the settings and of what files lie at ``inputs``:
    computed once, read after that, anew when an input has changed.  It is written under another name and moved
    whole; of two writers the first wins."""
    path = f"{shared_folder(spark)}/tessera/cache-{nested_hash(settings | {'_inputs': [stamp(spark, p) for p in inputs]})}"
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final, draft = fs.Path(path), fs.Path(f"{path}-{uuid.uuid4().hex}")
    system = final.getFileSystem(conf)
    if not system.exists(final):
        make().write.parquet(draft.toString())
        try:
            none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
            fs.FileContext.getFileContext(system.makeQualified(draft).toUri(), conf).rename(system.makeQualified(draft), system.makeQualified(final), none)
        except Exception:
            system.delete(draft, True)
            if not system.exists(final):
                raise
    return spark.read.parquet(path)
