"""FASTA and FASTQ, read and written by Spark's own text source, so from any store and in parallel.

Sequences come as (seq_idx, header, seq): numbered from 0 by file path and place in the file, with
the whole header line and wrapped lines joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.session import cut

_PLACE = ["_file", "_start", "_row"]


def _numbered(rows: DataFrame, name: str, within_file: bool) -> DataFrame:
    """Numbers rows from 0 in the order of file, split and place in the split, in the whole or in each file.

    Splits are counted, and only those counts are accumulated in one task.
    """
    rows = cut(rows)
    splits = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    order = W.partitionBy("_file").orderBy("_start") if within_file else W.orderBy("_file", "_start")
    before = splits.select("_file", "_start", "_first", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    return rows.join(before, ["_file", "_start"]).withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first")).cast("long")).drop("_before", "_first")


def _text(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records are cut at lines that begin with ``>``; what stands before the first is ignored."""
    rows = _text(spark, path, "\n>")
    body = F.regexp_replace(F.regexp_replace("value", r"\A>", ""), r"\r", "")
    rows = _numbered(rows.withColumn("_body", body), "_at", True)
    rows = rows.where((F.col("_at") > 0) | F.col("value").startswith(">"))
    rows = rows.select("_file", "_at", F.regexp_extract("_body", r"\A([^\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace("_body", r"\A[^\n]*", ""), r"\s", "").alias("seq"))
    return _in_order(rows)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records are four lines each, by count: qualities may begin with any sign. Qualities are dropped."""
    lines = _numbered(_text(spark, path, "\n"), "_line", True)
    part = F.col("_line") % 4
    line = F.regexp_replace("value", r"\r\z", "")
    rows = lines.groupBy("_file", F.floor(F.col("_line") / 4).alias("_at")).agg(F.max(F.when(part == 0, line)).alias("header"), F.max(F.when(part == 1, line)).alias("seq"))
    return _in_order(rows.where(F.col("header").startswith("@")).select("_file", "_at", F.expr("substring(header, 2)").alias("header"), F.coalesce(F.trim("seq"), F.lit("")).alias("seq")))


def _in_order(rows: DataFrame) -> DataFrame:
    """Numbers on from file to file; records of a file are numbered already."""
    rows = cut(rows)
    ends = rows.groupBy("_file").agg(F.max("_at").alias("_last"), F.min("_at").alias("_least"))
    n = F.col("_last") - F.col("_least") + 1
    before = ends.select("_file", "_least", (F.sum(n).over(W.orderBy("_file")) - n).alias("_before"))
    return rows.join(before, "_file").select((F.col("_before") + F.col("_at") - F.col("_least")).cast("long").alias("seq_idx"), "header", "seq")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ by the endings .fastq and .fq (also gzipped), else FASTA."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    return (read_fastq if name.endswith((".fastq", ".fq")) else read_fasta)(spark, path)


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """Header line and sequence lines of ``width`` letters, in the order of seq_idx."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    sequences.repartitionByRange("seq_idx").sortWithinPartitions("seq_idx").select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def write_fastq(sequences: DataFrame, path: str) -> None:
    """Four lines a record, with the quality I throughout."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), "header"), "seq", F.lit("+"), F.expr("repeat('I', length(seq))"))
    sequences.repartitionByRange("seq_idx").sortWithinPartitions("seq_idx").select(record.alias("value")).write.mode("overwrite").text(path)
