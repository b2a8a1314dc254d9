"""Line JSON, gated loads, write-once snapshots and range overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a retrieval chunk.
CHUNK = (
    "chunk_id string, content string, document_id string, page_number int, printed_page_number int, section_title string, chunk_type string, language string, "
    "source_type string, validation_status string, content_version string, provenance map<string,string>, gold_artifact_path string"
)
QA = "id string, question string, reference_answer string, source_page int, source_text string, question_type string"


def read_lines(spark: SparkSession, path: str, schema: str = CHUNK, strict: bool = False) -> DataFrame:
    """Line JSON with a fixed schema and the file that each record came from; strict loads raise on a bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_tables(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON files, one table each."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("source_file", F.col("_metadata.file_path"))


def read_questions(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Gold questions; a bad line or another number of them raises."""
    held = read_lines(spark, path, QA, strict=True)
    if expected is not None and (n := held.count()) != expected:
        raise ValueError(f"{n} questions, not {expected}")
    return held


def promote(records: DataFrame, rejected: F.Column, status: str = "validation_status") -> DataFrame:
    """Records that aren't rejected, as accepted ones."""
    return records.filter(~F.coalesce(rejected, F.lit(False))).withColumn(status, F.lit("accepted"))


def split_by_gate(records: DataFrame, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """(records that pass, records that don't with their reason)."""
    held = records.withColumn("reject_reason", reason)
    return held.filter("reject_reason = 'ok'").drop("reject_reason"), held.filter("reject_reason <> 'ok'")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write once (an existing snapshot raises) and return its manifest: files with their rows and a hash of their content."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    held = df.sparkSession.read.parquet(path)
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])
    return held.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.bit_xor(row).alias("content_hash"))


def overwrite_pages(old: DataFrame, new: DataFrame, page: str, start: int, end: int) -> DataFrame:
    """Records outside the pages, then the new ones of the pages."""
    return old.filter(F.coalesce(~F.col(page).between(start, end), F.lit(True))).unionByName(new.filter(F.col(page).between(start, end)), allowMissingColumns=True)


def swap_in(df: DataFrame, path: str) -> None:
    """The table's next state in place of its last one: written beside it, then renamed by the file system of the path.

    For a single writer; readers see the old or the new folder.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    df.write.mode("overwrite").parquet(f"{path}.next")
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    last = jvm.org.apache.hadoop.fs.Path(f"{path}.last")
    fs.delete(last, True)
    if fs.exists(target):
        fs.rename(target, last)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.next"), target)
