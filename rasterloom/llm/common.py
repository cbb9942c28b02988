"""What several of the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dealt, fresh_path, shared_dir  # noqa: F401

#: ASCII space and the controls from tab to carriage return separate words.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: Words of lower-cased text: ASCII digits and letters, and all beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: For bytes.translate: ASCII upper case to lower, what separates PLAIN_WORDs to a space.
PLAIN_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: For bytes.translate: what separates BLANK_WORDs to a space; nothing else changes.
BLANK_BYTES = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """The PLAIN_WORDs of the lower-cased text, as UTF-8; none for null."""
    return [] if text is None else text.encode("utf-8").translate(PLAIN_BYTES).split()


def blank_words(text: str | None) -> list[bytes]:
    """The BLANK_WORDs of the text, as UTF-8; none for null.

    bytes.split() without an argument would also split at 0x1C-0x1F on no
    Python version; it splits at ASCII space and 0x09-0x0D alone.
    """
    return [] if text is None else text.encode("utf-8").split()


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage.

    Unlike localCheckpoint, the table outlives every executor. Columns of
    equal name must be renamed before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt by ``key`` as a shuffle would deal it, so that grouping by it later moves no row.

    The catalog's entry is there for the writing only; the folder stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    entry = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, which has been written, with a hint to broadcast it if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def named(back: dict[str, str]) -> list:
    """The columns that go along under other names, under their own."""
    return [F.col(o).alias(c) for o, c in back.items()]


def partitions(spark: SparkSession) -> int:
    """Reduce partitions of this session; set it in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on at most so many rows go to a Python worker at once in this session: texts and arrays can be long.

    A smaller number that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
