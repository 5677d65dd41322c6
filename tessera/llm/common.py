"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import drop, materialize, new_path, shared_folder  # noqa: F401  (for the operators)

#: Characters that separate words, as a regular-expression class body (space, TAB to CR).
BLANK = r"\x20\x09-\x0D"
#: The same characters, spelled out for trim functions.
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is far cheaper and the same where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, even where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Taken(RuntimeError):
    """A file of that name is there already."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    where, system = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file whole: under another name first, then by a rename that raises ``Taken`` if the name is."""
    final, system = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f"draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    try:
        none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        fs.FileContext.getFileContext(system.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(draft), system.makeQualified(final), none)
    except Exception as e:
        system.delete(draft, False)
        raise (Taken(path) if "FileAlreadyExists" in str(e) else e) from e


def remove(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)
