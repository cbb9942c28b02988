"""Readers of rasters, masks, maps, models and saved settings."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The newest schema of saved settings that is understood; newer ones are refused.
SCHEMA_VERSION = 1


def channels(df: DataFrame, rgb: bool = False) -> list[str]:
    """The channel columns of a raster; hue and saturation only of RGB ones."""
    return [c for c in df.columns if c not in ("img", "y", "x") and (rgb or c.lower() not in ("hue", "saturation"))]


def channel_index(df: DataFrame, name: str) -> int:
    """The place of a channel, or -1."""
    return channels(df).index(name) if name in channels(df) else -1


def checked_gray(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """The raster, if its gray is of a type that holds 8- or 16-bit unsigned numbers; another type fails the call. With ``most``, a row beyond 0 to ``most`` fails the job."""
    if df.schema[column].dataType.simpleString() not in ("smallint", "int"):
        raise ValueError(f"pixel type {df.schema[column].dataType.simpleString()} of {column} is not supported")
    if most is None:
        return df
    bad = (F.col(column) < 0) | (F.col(column) > most)
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit("gray out of range")).cast("int")).otherwise(F.col(column)))


def read_masks(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """path, y, x of the nonzero places of each .npy or .npz (its first array) under path; another shape fails the job."""

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                loaded = np.load(io.BytesIO(raw), allow_pickle=False)
                mask = loaded[loaded.files[0]] if hasattr(loaded, "files") else loaded
                if mask.shape != (height, width):
                    raise ValueError(f"{name} is {mask.shape}, not {(height, width)}")
                y, x = np.nonzero(mask)
                yield pd.DataFrame({"path": name, "y": y.astype("i4"), "x": x.astype("i4")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, y int, x int")


def read_map(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A map (img, gy, gx, channels), or its cells in a box (gy0, gx0, gy1, gx1), half-open, which the scan is told."""
    df = spark.read.parquet(path)
    return df if box is None else df.where((F.col("gy") >= box[0]) & (F.col("gx") >= box[1]) & (F.col("gy") < box[2]) & (F.col("gx") < box[3]))


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved JSON settings; rows of a newer schema_version fail the job."""
    df = spark.read.schema(f"schema_version int, {schema}").json(path)
    return df.withColumn("schema_version", F.when(F.col("schema_version") > SCHEMA_VERSION, F.raise_error(F.lit("saved by a newer version")).cast("int")).otherwise(F.col("schema_version")))


def read_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """file, row and float columns of the two-dimensional little-endian f4, f8 or i4 arrays under path; other types are refused."""

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                loaded = np.load(io.BytesIO(raw), allow_pickle=False)
                a = loaded[loaded.files[0]] if hasattr(loaded, "files") else loaded
                if a.dtype.str not in ("<f4", "<f8", "<i4") or a.ndim != 2 or a.shape[1] != len(names):
                    raise ValueError(f"{name}: {a.dtype} of shape {a.shape} is not supported")
                yield pd.DataFrame(a.astype("f8"), columns=names).assign(file=name, row=np.arange(len(a)))[["file", "row", *names]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, " + ", ".join(f"{n} double" for n in names))


def catalog_entries(spark: SparkSession, root: str, needed: tuple[str, ...]) -> DataFrame:
    """folder of each entry under root that has all the needed files: maps by image, or models (metadata and model)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return parts.where(F.col("file").isin(*needed)).groupBy("folder").agg(F.countDistinct("file").alias("n")).where(F.col("n") == len(needed)).select("folder")
