"""Scalar expressions: names, units, hashes, labels, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_list(text: Column) -> Column:
    """A comma-separated list as an ordered set of trimmed, non-empty names."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != ""))


def in_classes(name: Column, wanted: Column) -> Column:
    """Exact membership; null is Unclassified, an empty set has no member."""
    return F.array_contains(wanted, F.coalesce(name, F.lit("Unclassified")))


def name_matches(name: Column, part: Column) -> Column:
    """Case-insensitive substring; a blank one matches every name."""
    return (F.trim(part) == "") | F.contains(F.lower(name), F.lower(F.trim(part)))


def beyond(value: Column, cut: float, above: bool = True) -> Column:
    """Strictly above (or below) the cut; false for null and NaN."""
    value = F.nanvl(value, F.lit(None).cast("double"))
    return F.coalesce(value > cut if above else value < cut, F.lit(False))


def cut_name(channel: str, cut: float, above: bool = True) -> str:
    """Display name of a positivity rule: whole numbers without a fraction, others to four digits."""
    shown = str(int(cut)) if float(cut).is_integer() else f"{cut:.4g}"
    return f"Pixel positive: {channel} {'>' if above else '<'} {shown}"


def to_unit(gray: Column, full_scale: float) -> Column:
    return gray / F.lit(float(full_scale))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue and saturation in [0, 1], and value, of channels in [0, 1]; hue and saturation of gray are 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sixth = (F.when(span == 0, F.lit(0.0)).when(top == r, F.pmod((g - b) / F.nullif(span, F.lit(0.0)), F.lit(6.0)))
             .when(top == g, (b - r) / F.nullif(span, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(span, F.lit(0.0)) + 4))
    return sixth / 6, F.when(top == 0, F.lit(0.0)).otherwise(span / F.nullif(top, F.lit(0.0))), top


def window_px(window_um: Column, pixel_um: Column) -> Column:
    """Whole pixels of a window, two at least; half rounds to even."""
    return F.greatest(F.lit(2), F.bround(window_um / pixel_um).cast("int"))


def stride_px(window: Column, overlap: Column) -> Column:
    """Whole pixels between windows, one at least, of an overlap held to [0, 0.95]; half rounds to even."""
    return F.greatest(F.lit(1), F.bround(window * (1 - F.least(F.greatest(overlap, F.lit(0.0)), F.lit(0.95)))).cast("int"))


def distances_px(listed: Column, pixel_um: Column) -> Column:
    """Distinct whole pixels, one at least, of a list of microns, in order; malformed and non-positive ones go; half rounds up."""
    numbers = F.transform(F.split(listed, ","), lambda s: F.try_to_number(F.trim(s), F.lit("999999.999")).cast("double"))
    return F.array_distinct(F.transform(F.filter(numbers, lambda v: v > 0), lambda v: F.greatest(F.lit(1), F.floor(v / pixel_um + 0.5).cast("int"))))


def axial_difference(a: Column, b: Column, period: float = 180.0) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, period - d)


def axial_angle(c: Column, s: Column, period: float = 180.0) -> Column:
    """The angle of a vector sum over the doubled circle, wrapped to [0, period)."""
    return F.pmod(F.atan2(s, c) * (period / (2 * 3.141592653589793)), F.lit(period))


def safe_file_name(name: Column, most: int = 200) -> Column:
    """Runs of reserved characters and space as one underscore, no dots at the end; longer names are cut and end in a CRC; image for none."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\s]+', "_"), r"[. ]+$", "")
    short = F.concat(F.substring(clean, 1, most - 9), F.lit("_"), F.lower(F.lpad(F.hex(F.crc32(name)), 8, "0")))
    return F.when(F.coalesce(F.trim(name), F.lit("")).isin("") | (clean == ""), F.lit("image")).when(F.length(clean) > most, short).otherwise(clean)


def fingerprint(canonical: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, digits)


def threshold_label(method: Column, unit: Column, value: Column, source: Column, settings: Column, pixel_um: Column) -> Column:
    """method unit value | source | settings key at size um/px: the line that outputs record; gray levels are whole, an unknown size is left out."""
    shown = F.when(unit == "gray level", F.round(value).cast("long").cast("string")).when(value.isNull() | F.isnan(value), F.lit("?")).otherwise(F.format_string("%.4g", value))
    size = F.format_string("%.4g", pixel_um)
    size = F.when(size.contains(".") & ~size.contains("e"), F.regexp_replace(F.regexp_replace(size, "0+$", ""), r"\.$", "")).otherwise(size)
    at = F.when(pixel_um > 0, F.concat(F.lit(" at "), size, F.lit(" um/px"))).otherwise(F.lit(""))
    return F.concat_ws(" | ", F.concat_ws(" ", method, F.nullif(unit, F.lit("")), shown), source, F.concat(F.lit("settings "), settings, at))


def parse_threshold(label: Column) -> Column:
    """The parts of a threshold label; null for other text."""
    pattern = r"^\s*(\S+)(?: (.*?))? (\S+) \| (.*) \| settings (\w+)(?: at ([0-9.eE+-]+) um/px)?\s*$"
    part = lambda k: F.regexp_extract(label, pattern, k)
    return F.when(label.rlike(pattern), F.struct(part(1).alias("method"), part(2).alias("unit"), part(3).try_cast("double").alias("value"), part(4).alias("source"),
                                                 part(5).alias("settings"), part(6).try_cast("double").alias("pixel_um")))


def comparable(key_a: Column, um_a: Column, key_b: Column, um_b: Column, within: float = 1.02) -> Column:
    """The same key, and pixel sizes within the ratio, where both are known."""
    close = F.greatest(um_a, um_b) <= F.least(um_a, um_b) * within
    return (key_a == key_b) & F.coalesce(close, F.lit(True))


def placement_line(**fields: Column) -> Column:
    """The line of a map's description that says where its cells lie: name=value fields in their order."""
    return F.concat(F.lit("placement "), F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items())))


def parse_placement(text: Column) -> Column:
    """The fields of the placement line in a text, carriage returns left out; null without one."""
    line = F.regexp_extract(F.regexp_replace(text, "\r", ""), r"(?m)^placement (.*)$", 1)
    return F.when(line != "", F.str_to_map(line, F.lit("; "), F.lit("=")))


def finite(value: Column) -> Column:
    """null for NaN and infinities, which JSON has no numbers for."""
    return F.when(F.abs(value) <= 1.7976931348623157e308, value)


def mismatches(pairs: dict[str, tuple[Column, Column]], tolerance: float = 1e-6) -> Column:
    """Names of the settings that differ, comma-joined: numbers by more than the tolerance, others at all; null equals null."""
    parts = []
    for name, (a, b) in pairs.items():
        parts.append(F.when(~a.eqNullSafe(b) & F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) > tolerance, F.lit(True)), F.lit(name)))
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def duration(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    whole = F.round(F.greatest(seconds, F.lit(0))).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return (F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s))
            .otherwise(F.format_string("%ds", s)))
