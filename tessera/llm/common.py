"""What the operators of this subpackage share: word splitting, slices of Arrow batches, labelled samples, input."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.staging import drop_stage, stage  # noqa: F401  (operators take them from here)

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """array<string> of the words of ``text``; a null text has none.

    Mapping the other blanks to a space first lets the JVM split on one character without a regex engine.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Whole texts can be long: ``batches`` in parts of few rows, so that what a Python worker holds beside the batch,
    which Spark bounds in bytes, stays small whatever the session's settings are."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. In fewer files than there are cores, which are small tables, its rows are dealt out once so
    that all cores work; a table of many files is read as it lies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: str, rows: int, chars: int) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most ``rows`` labelled documents of the training ``fold`` (SQL over doc_id), taken by
    a hash of the id; texts of more than ``chars`` characters are left out. This bounds what a fit sees, not what is
    scored. The ids of the sample, ``rows`` at most, are broadcast, so texts are not shuffled."""
    known = labels.where(f"{label} in (0, 1) and doc_id is not null").where(fold).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    got = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").select("text", "y").toArrow()
    return got.column("text").to_pylist(), got.column("y").to_pylist()
