"""Size estimates of the five levels, and sizes in words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LIMITS, PROFILES, SENTENCES


@F.pandas_udf(T.StringType())
def size_label(sizes: pd.Series) -> pd.Series:
    """``840 KB``, ``12.4 MB``: decimal units, rounded as C's printf does."""

    def one(n) -> str | None:
        if pd.isna(n):
            return None
        n = max(0, int(n))
        if n < 1000:
            return f"{n} bytes"
        value, unit, places = next(((n / s, u, p) for s, u, p in ((1e3, "KB", 1), (1e6, "MB", 1)) if n / s < 1000), (n / 1e9, "GB", 2))
        return f"{value:.{0 if value >= 100 else places}f} {unit}"

    return sizes.map(one)


#: Share of each part that a level keeps: (other streams, structure), and of images that can be encoded again, (small, large).
KEPT = {1: (0.92, 0.96), 2: (0.90, 0.95), 3: (0.88, 0.94), 4: (0.86, 0.93)}
IMAGES_KEPT = {1: (1.0, 1.0), 2: (0.92, 0.30), 3: (0.85, 0.20), 4: (0.78, 0.05)}
TEXT_FLOORS = {2: 0.96, 3: 0.95, 4: 0.94}
LARGE_IMAGES = 100_000
#: Relative width to either side, (text-heavy, others), and confidence, (text-heavy, others), of levels 0, 1 and above.
BANDS, CONFIDENCE = ((0.25, 0.08), (0.25, 0.10), (0.20, 0.45)), ((0.80, 0.80), (0.70, 0.70), (0.55, 0.60))


def derived(inventory: DataFrame) -> DataFrame:
    """``inventory`` with overhead_bytes, image_fraction and text_heavy."""
    out = inventory.withColumn("overhead_bytes", F.expr("greatest(0, file_bytes - image_bytes - metadata_bytes - other_bytes)"))
    out = out.withColumn("image_fraction", F.expr("case when file_bytes > 0 then cast(image_bytes as double) / file_bytes else 0D end"))
    return out.withColumn("text_heavy", F.col("image_fraction") < 0.15)


def midpoints(out: DataFrame) -> DataFrame:
    """``derived`` rows with m0 .. m4: the middle of each level's estimate; none is above the one before."""
    out = out.withColumn("_o", F.expr("cast(greatest(1, file_bytes) as double)")).withColumn("_s", F.expr("cast(least(image_bytes, recompressible_bytes) as double)"))
    out = out.withColumn("_r0", F.expr("least(greatest(_o - (metadata_bytes * 0.95D + _o * 0.01D), _o * 0.85D), _o * 1.06D)"))
    for level in range(1, 5):
        (other, overhead), (small, large) = KEPT[level], IMAGES_KEPT[level]
        raw = f"_s * (case when _s >= {LARGE_IMAGES} then {large}D else {small}D end) + (cast(image_bytes as double) - _s) + other_bytes * {other}D + metadata_bytes * 0.02D + overhead_bytes * {overhead}D"
        if level in TEXT_FLOORS:
            raw = f"case when text_heavy then greatest({raw}, _r0 * {TEXT_FLOORS[level]}D) else {raw} end"
        out = out.withColumn(f"_r{level}", F.expr(raw))
    for level in range(1, 5):
        out = out.withColumn(f"_r{level}", F.expr(f"least(greatest(least(_r{level}, _r{level - 1} * 0.999D), _o * 0.001D), _o * 1.08D)"))
    out = out.withColumn("m0", F.expr("least(greatest(_r0, _o * 0.001D), _o * 1.08D)"))
    for level in range(1, 5):
        out = out.withColumn(f"m{level}", F.expr(f"case when _r{level} > m{level - 1} then m{level - 1} * 0.998D else _r{level} end"))
    return out


def estimates(inventory: DataFrame) -> DataFrame:
    """(doc_id, level, bytes_low, bytes_high, confidence, method), a row a document and level."""
    out = midpoints(derived(inventory)).withColumn("_cap", F.expr("cast(_o * 1.05D as long)"))
    for level in range(5):
        (heavy, light), (sure_heavy, sure_light) = BANDS[min(level, 2)], CONFIDENCE[min(level, 2)]
        band = f"case when text_heavy then {heavy}D else {light}D end"
        low = f"least(greatest(1, cast(round(m{level} * (1.0D - ({band}))) as long)), _cap)"
        high = f"least(greatest({low}, cast(round(m{level} * (1.0D + ({band}))) as long)), _cap)"
        high = high if not level else f"least({high}, _h{level - 1})"
        out = out.withColumn(f"_h{level}", F.expr(high)).withColumn(f"_l{level}", F.expr(f"least({low}, _h{level})"))
        out = out.withColumn(f"_c{level}", F.expr(f"case when text_heavy then {sure_heavy}D else {sure_light}D end"))
    rows = ", ".join(f"struct({i} as level, _l{i} as bytes_low, _h{i} as bytes_high, _c{i} as confidence)" for i in range(5))
    return out.select("doc_id", F.explode(F.expr(f"array({rows})")).alias("e")).select("doc_id", "e.*", F.lit("heuristic").alias("method"))


def probed(sizes: DataFrame) -> DataFrame:
    """Exact estimates from the sizes of cleaned files: (doc_id, level, length) with input_bytes."""
    pad = "greatest(32, length div 100)"
    out = sizes.where(should_probe(F.col("input_bytes")))
    return out.selectExpr("doc_id", "level", f"greatest(1, length - {pad}) as bytes_low", f"length + {pad} as bytes_high", "0.98D as confidence", "'exact' as method")


def estimate_text(estimates: DataFrame) -> DataFrame:
    """``estimates`` with bytes_mid, display and caption."""
    out = estimates.withColumn("bytes_mid", F.expr("(bytes_low + bytes_high) div 2"))
    lo, hi, mid = size_label("bytes_low"), size_label("bytes_high"), size_label("bytes_mid")
    out = out.withColumns({"_lo": lo, "_hi": hi, "_mid": mid}).withColumn("_span", F.expr("cast(bytes_high - bytes_low as double) / greatest(1, bytes_high)"))
    display = F.expr("case when bytes_high <= 0 then '0 bytes' when method = 'exact' and (_lo = _hi or _span < 0.04D) then _mid when _span < 0.08D or _lo = _hi then concat('~', _hi) else concat('~', _lo, '–', _hi) end")
    caption = F.expr("case when method = 'exact' then 'Measured from a dry-run export' when confidence >= 0.8D then 'Estimate' when confidence >= 0.6D then 'Rough estimate' else 'Rough estimate — actual may differ' end")
    return out.withColumns({"display": display, "caption": caption}).drop("_lo", "_hi", "_mid", "_span")


def text_heavy_note(level: Column, text_heavy: Column) -> Column:
    """A warning for the lossy levels of files that are mostly text; else null."""
    return F.when(is_lossy(level) & text_heavy, SENTENCES["mostly text"])


def is_lossy(level: Column) -> Column:
    """Whether a level (clamped) encodes images again."""
    lossy = [p.level for p in PROFILES if p.edge is not None or p.quality is not None]
    return F.greatest(F.lit(0), F.least(F.lit(4), level)).isin(lossy)


def should_probe(size: Column) -> Column:
    """Whether a file is small enough for an exact estimate."""
    return (size > 0) & (size <= LIMITS.probe_bytes)


def savings(original: Column, mid: Column) -> Column:
    """``−12%``, or null where less than 1 % is saved."""
    share = F.round((original - mid) / original * 100).cast("long")
    return F.when((original > 0) & (mid < original) & (share >= 1), F.concat(F.lit("−"), share.cast("string"), F.lit("%")))


def within_band(actual: Column, low: Column, high: Column, method: Column, slack: float = 0.55) -> Column:
    """Whether a size is inside an estimate, or near enough to it."""
    mid = F.floor((low + high) / 2).cast("double")
    off = F.abs(actual - mid) / mid
    near = F.when(method == "exact", off <= 0.05).otherwise((off <= slack) | ((actual <= high) & (actual >= F.floor(low / 2))))
    return F.when((actual >= low) & (actual <= high), True).when(mid <= 0, False).otherwise(near)


def target_pixels(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Width and height after the longer side is cut to ``edge``."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.round(side * scale).cast("int")) for side in (width, height))


def output_name(path: Column, level: Column) -> Column:
    """``name-clean.pdf`` and so on, by level (clamped to 0 .. 4)."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    suffix = F.element_at(F.array(*(F.lit(p.suffix) for p in PROFILES)), F.greatest(F.lit(0), F.least(F.lit(4), level)) + 1)
    return F.concat(stem, F.lit("-"), suffix, F.lit(".pdf"))
