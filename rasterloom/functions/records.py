"""Records that a run writes: windows, results, provenance, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import finite, fingerprint, threshold_label

#: What a window below the gate keeps, in order.
STUB = ("x", "y", "w", "h", "included", "n_fiber_px", "fiber_coverage_percent")


def window_record(included: Column, fields: list[str]) -> Column:
    """JSON of a window; below the gate a stub of seven keys. Numbers that are not finite are null and shown so."""
    return F.when(included, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(*STUB), {"ignoreNullFields": "false"}))


def clean_numbers(df: DataFrame) -> DataFrame:
    """All floating columns with null for NaN and infinities; array columns are left out."""
    kept = [f for f in df.schema.fields if f.dataType.typeName() != "array"]
    return df.select(*((finite(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)) for f in kept))


def summary_lines(df: DataFrame) -> DataFrame:
    """One line, key: value, for each column of each row."""
    return df.select(F.explode(F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in df.columns))).alias("line"))


def normed(value: Column, lo: Column, hi: Column) -> Column:
    """Min-max for display; a flat plane gives 0."""
    return (value - lo) / F.greatest(hi - lo, F.lit(1e-12))


def provenance(params: dict, version: str) -> list[tuple[str, str]]:
    """The triple that reruns a run: its parameters as JSON and as text, and a script."""
    import json
    as_json = json.dumps(params, sort_keys=True)
    text = "\n".join(f"{k} = {params[k]}" for k in sorted(params))
    return [("params.json", as_json), ("params.txt", text), ("rerun.py", f"# version {version}\nfrom rasterloom.plans.run import analyze\nanalyze(px, **{params!r})\n")]


def to_full_image(at: Column, downsample: float, offset: Column | int) -> Column:
    """From coordinates as read to those of the whole image."""
    return F.round(at * downsample).cast("long") + offset


#: The line that the fingerprint of segmentation settings is of, its sigmas, and what a record calls a cut without a unit.
SETTINGS_LINE, SIGMAS, NO_UNIT = "channel=%s;ridge=%s;sigmas=%s;invert=%s;rb=%.6g;minarea=%.6g", "%.6g,%.6g,%.6g", "fraction of full scale"
#: Columns of settings that a threshold record lists.
SETTINGS = ("channel", "ridge_filter", "sigma_min_um", "sigma_max_um", "sigma_step_um", "invert_intensity", "rolling_ball_radius_um", "min_fiber_area_um2", "analysis_downsample")


def threshold_records(runs: DataFrame) -> DataFrame:
    """``runs`` with identity, settings_key and record: the line that tells which cut results were made at, and threshold.json.

    Columns: threshold_method, value (in gray levels or on the response if the
    method is manual, else what a method resolved to), source, pixel_um (that
    of the image) and ``SETTINGS``. Without a value a method is one fitted per
    region, and the value is left out; so is an unknown pixel size. A null
    method is Otsu, a null filter none, a null switch false, a null length or area 0.
    """
    c = F.col
    method, ridge = F.lower(F.trim(F.coalesce(c("threshold_method"), F.lit("")))), F.lower(F.trim(F.coalesce(c("ridge_filter"), F.lit(""))))
    ridged, manual = ~ridge.isin("", "none"), method == "manual"
    number = lambda name: F.coalesce(c(name).cast("double"), F.lit(0.0))
    sigmas = F.when(ridged, F.format_string(SIGMAS, *(number(f"sigma_{n}_um") for n in ("min", "max", "step")))).otherwise("")
    line = F.format_string(SETTINGS_LINE, F.trim(F.coalesce(c("channel"), F.lit(""))), F.when(ridged, ridge).otherwise("none"), sigmas,
                           F.coalesce(c("invert_intensity"), F.lit(False)).cast("string"), number("rolling_ball_radius_um"), number("min_fiber_area_um2"))
    named = F.when(manual, "Manual").when(method.startswith("project") | method.contains("calibrated"), "Calibrated").when(method == "triangle", "Triangle").otherwise("Otsu")
    unit = F.when(ridged, "response").when(manual, "gray level").otherwise("")
    source = F.when(manual, "set by hand").when(c("value").isNull(), "fitted per region").otherwise(F.coalesce(c("source"), F.lit("")))
    size = c("pixel_um") * F.greatest(F.lit(1.0), F.coalesce(c("analysis_downsample"), F.lit(1.0)))
    told = runs.withColumns({"settings_key": fingerprint(line), "_method": named, "_unit": unit, "_source": source, "_um": F.when(size > 0, size)})
    told = told.withColumn("identity", threshold_label(c("_method"), c("_unit"), c("value"), c("_source"), c("settings_key"), F.coalesce("_um", F.lit(0.0))))
    record = F.to_json(F.struct(
        "identity", "threshold_method", F.substring_index("identity", " | ", 1).alias("cut"), "value", F.coalesce(F.nullif("_unit", F.lit("")), F.lit(NO_UNIT)).alias("unit"),
        c("_source").alias("source"), c("settings_key").alias("settings_fingerprint"), c("_um").alias("analysed_pixel_um"), F.struct(*SETTINGS).alias("settings")))
    return told.withColumn("record", record).drop("_method", "_unit", "_source", "_um")


def stamped(objects: DataFrame, records: DataFrame, key: str = "img") -> DataFrame:
    """Objects with threshold: the identity of their image's record; null where it has none."""
    return objects.join(records.select(key, F.col("identity").alias("threshold")), key, "left")
