"""Per-image pixel aggregates: ink, luminance, saturation, gamut, histogram, clusters.

All of them are partial aggregates keyed by the image (or image and a bounded
bin), so a task sends one short row per image it saw, however many pixels one
image holds. Sums run over integers wherever the measure allows it, which makes
results independent of the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.rounding import fixed_avg, js_round, jr_int, nano

LUM_UNIT = 0.0039215686
INK_PERCENT = 100.0 / 255.0


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _exceeds(threshold: float) -> Column:
    return color.tac(*_rgb()) > threshold


def _int_sum(c: Column) -> Column:
    return F.sum(c.cast("bigint"))


def ink_columns(df: DataFrame, threshold: int = 300) -> DataFrame:
    """Finishes ``n, ink_max, ink_sum, exceeded_count`` into the ink analysis."""
    return df.withColumns({
        "max_tac": jr_int(F.col("ink_max")),
        "avg_tac": jr_int(F.col("ink_sum") * INK_PERCENT / F.col("n")),
        "exceeded_ratio": F.col("exceeded_count") / F.col("n"),
        "has_overflow": F.col("exceeded_count") > 0,
        "limit_threshold": F.lit(threshold)})


def analyze_ink(pixels: DataFrame, threshold: int = 300) -> DataFrame:
    """Maximum, average and share of total ink per image."""
    agg = pixels.groupBy("image_id").agg(
        F.count("*").alias("n"), F.max(color.tac(*_rgb())).alias("ink_max"),
        _int_sum(color.ink_units(*_rgb())).alias("ink_sum"),
        F.count_if(_exceeds(threshold)).alias("exceeded_count"))
    return ink_columns(agg, threshold).select(
        "image_id", "max_tac", "avg_tac", "exceeded_count", "exceeded_ratio", "has_overflow", "limit_threshold")


def lum_bin() -> Column:
    """256-step luminance bin; odd sums fall to the lower bin."""
    s = F.greatest(*_rgb()) + F.least(*_rgb())
    return F.shiftright(s, 1)


def strided(pixels: DataFrame, limit: int | None) -> DataFrame:
    """Every second pixel (in row-major order) of images larger than ``limit``; all of them without a limit."""
    if limit is None:
        return pixels
    big = F.col("w").cast("bigint") * F.col("h") > limit
    odd = (F.col("y").cast("bigint") * F.col("w") + F.col("x")) % 2 == 1
    return pixels.filter(~(big & odd))


def luminance_histogram(pixels: DataFrame) -> DataFrame:
    return (pixels.groupBy("image_id", lum_bin().alias("bin"))
            .agg(F.count("*").alias("cnt")))


def percentile_spread(hist: DataFrame) -> DataFrame:
    """P5/P95 bins and their spread from a per-image histogram (at most 256 rows each)."""
    w = Window.partitionBy("image_id")
    run = hist.withColumns({
        "_cum": F.sum("cnt").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.sum("cnt").over(w)})
    b0 = F.min(F.when(F.col("_cum") >= F.col("_n") * 0.05, F.col("bin")))
    b95 = F.min(F.when(F.col("_cum") >= F.col("_n") * 0.95, F.col("bin")))
    out = run.groupBy("image_id").agg(b0.alias("_b0"), b95.alias("p95_bin"))
    p5 = F.when(F.col("p95_bin") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.col("_b0")))
    out = out.withColumn("p5_bin", p5.cast("int"))
    spread = F.greatest(F.lit(0.0), F.col("p95_bin") / 255.0 - F.col("p5_bin") / 255.0)
    return out.select("image_id", "p5_bin", "p95_bin", spread.alias("spread"))


def _stat_sums() -> list[Column]:
    s = (F.greatest(*_rgb()) + F.least(*_rgb())).cast("bigint")
    return [F.count("*").alias("n"), F.sum(s).alias("sum_s"), F.sum(s * s).alias("sum_s2"),
            F.sum(nano(color.saturation(*_rgb()))).alias("sum_sat"),
            F.count_if(F.col("a") < 255).alias("transparent")]


def _stat_columns(df: DataFrame) -> DataFrame:
    lum = F.col("sum_s") * (0.5 * LUM_UNIT) / F.col("n")
    lum2 = F.col("sum_s2") * (0.25 * LUM_UNIT * LUM_UNIT) / F.col("n")
    df = df.withColumns({"avg_lum": lum, "_lum2": lum2, "avg_sat": F.col("sum_sat") / F.lit(1e9) / F.col("n"),
                         "transparent_ratio": F.col("transparent") / F.col("n")})
    raw = F.sqrt(F.greatest(F.lit(0.0), F.col("_lum2") - F.col("avg_lum") * F.col("avg_lum")))
    return df.withColumn("raw_std", raw).drop("_lum2")


def pixel_stats(pixels: DataFrame, stride_above: int | None = None) -> DataFrame:
    """Luminance, saturation, contrast and transparency per image.

    One pass over the pixels: sums are kept per (image, bin), so the histogram
    percentiles come from the same aggregate instead of a second scan. Every
    pixel counts; ``stride_above`` asks for every second pixel of images with
    more pixels than that.
    """
    by_bin = (strided(pixels, stride_above).groupBy("image_id", lum_bin().alias("bin")).agg(*_stat_sums()))
    return _finish_stats(by_bin, [])


def _finish_stats(by_bin: DataFrame, extra: list[Column]) -> DataFrame:
    w = Window.partitionBy("image_id")
    run = by_bin.withColumns({
        "_cum": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("n").over(w)})
    return _spread_columns(run.groupBy("image_id").agg(
        F.sum("n").alias("n"), F.sum("sum_s").alias("sum_s"), F.sum("sum_s2").alias("sum_s2"),
        F.sum("sum_sat").alias("sum_sat"), F.sum("transparent").alias("transparent"),
        F.min(F.when(F.col("_cum") >= F.col("_all") * 0.05, F.col("bin"))).alias("_b0"),
        F.min(F.when(F.col("_cum") >= F.col("_all") * 0.95, F.col("bin"))).alias("p95_bin"), *extra))


def _spread_columns(out: DataFrame) -> DataFrame:
    p5 = F.when(F.col("p95_bin") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.col("_b0")))
    out = _stat_columns(out.withColumn("p5_bin", p5.cast("int")))
    out = out.withColumn("spread", F.greatest(F.lit(0.0), F.col("p95_bin") / 255.0 - F.col("p5_bin") / 255.0))
    return out.withColumn("std_lum", F.col("raw_std") * 0.7 + F.col("spread") * 0.15).drop("_b0")


def with_gamut_flag(pixels: DataFrame, limit: int = 38) -> DataFrame:
    """Marks pixels whose ink round trip moves the colour by more than ``limit`` codes."""
    df = color.with_round_trip(pixels, 0.8, ("_br", "_bg", "_bb"))
    moved = f"abs(r - _br) + abs(g - _bg) + abs(b - _bb) > {limit}"
    return color.stage(df, oog=moved).drop("_br", "_bg", "_bb")


def gamut_severity(ratio: Column) -> Column:
    return F.when(ratio > 0.15, "high").when(ratio > 0.05, "moderate").otherwise("low")


def analyze_gamut(pixels: DataFrame, stride_above: int | None = None) -> DataFrame:
    flagged = with_gamut_flag(strided(pixels, stride_above))
    out = flagged.groupBy("image_id", "w", "h").agg(F.count("*").alias("n"), F.count_if("oog").alias("hits"))
    ratio = F.col("hits") / F.col("n")
    return out.select("image_id", js_round(ratio * (F.col("w") * F.col("h"))).alias("oog_count"),
                      ratio.alias("oog_ratio"), gamut_severity(ratio).alias("severity"))


def in_stats_gamut_ratio(pixels: DataFrame) -> DataFrame:
    """The simple ink round trip of the statistics pass, kept for parity.

    It is an algebraic identity, so the ratio stays at zero by construction; the
    usable gamut measure is :func:`analyze_gamut`.
    """
    r, g, b = [F.col(c) * LUM_UNIT for c in "rgb"]
    df = pixels.withColumns({"_r": r, "_g": g, "_b": b, "_mx": F.greatest(r, g, b), "_mn": F.least(r, g, b)})
    k = F.lit(1.0) - F.col("_mx")

    def back(ch: str) -> Column:
        ink = F.when(F.col("_mx") < 1, (F.lit(1.0) - F.col(ch) - k) / (F.lit(1.0) - k)).otherwise(F.lit(0.0))
        return F.abs(F.col(ch) - (F.lit(1.0) - ink) * (F.lit(1.0) - k))

    vivid = (F.col("_mx") > 0.3) & ((F.col("_mx") - F.col("_mn")) > F.col("_mx") * 0.6)
    moved = F.when(vivid, back("_r") + back("_g") + back("_b")).otherwise(F.lit(0.0))
    return (df.groupBy("image_id")
            .agg((F.count_if(moved > 0.15) / F.count("*")).alias("in_stats_oog_ratio")))


def measure(pixels: DataFrame, threshold: int = 300) -> DataFrame:
    """Ink, statistics, histogram percentiles and gamut in a single pass.

    One aggregate over (image, bin) feeds every measure; the second stage works
    on at most 256 rows per image.
    """
    flagged = with_gamut_flag(pixels)
    by_bin = flagged.groupBy("image_id", "w", "h", lum_bin().alias("bin")).agg(
        *_stat_sums(), F.max(color.tac(*_rgb())).alias("ink_max"),
        _int_sum(color.ink_units(*_rgb())).alias("ink_sum"),
        F.count_if(_exceeds(threshold)).alias("exceeded_count"), F.count_if("oog").alias("oog_hits"))
    out = _finish_stats(by_bin, [
        F.max("w").alias("w"), F.max("h").alias("h"), F.max("ink_max").alias("ink_max"),
        F.sum("ink_sum").alias("ink_sum"), F.sum("exceeded_count").alias("exceeded_count"),
        F.sum("oog_hits").alias("oog_hits")])
    return _measure_columns(out, threshold)


def _measure_columns(out: DataFrame, threshold: int) -> DataFrame:
    out = ink_columns(out, threshold)
    ratio = F.col("oog_hits") / F.col("n")
    return out.withColumns({"oog_ratio": ratio, "gamut_severity": gamut_severity(ratio)}).drop(
        "sum_s", "sum_s2", "sum_sat", "ink_max", "ink_sum", "oog_hits", "raw_std", "transparent")


def plate_coverage(pixels: DataFrame, dot_above: float = 0.02) -> DataFrame:
    """Mean density of each plate and the share of pixels that carry a dot."""
    df = pixels.withColumn("_mx", F.greatest(*_rgb()))
    dens = {n: F.when(F.col("_mx") > 0, (F.col("_mx") - F.col(ch)).cast("double") / F.col("_mx")).otherwise(F.lit(0.0))
            for n, ch in (("c", "r"), ("m", "g"), ("y", "b"))}
    dens["k"] = F.lit(1.0) - F.col("_mx") / 255.0
    df = df.select("image_id", *[d.alias(f"_{n}") for n, d in dens.items()])
    return df.groupBy("image_id").agg(
        *[fixed_avg(F.col(f"_{n}")).alias(f"mean_{n}") for n in dens],
        *[(F.count_if(F.col(f"_{n}") > dot_above) / F.count("*")).alias(f"dots_{n}") for n in dens])


def tac_severity(tac: Column, threshold: int = 300) -> Column:
    """0 up to the threshold, then linear up to 1 at 400 %."""
    return F.when(tac > threshold, F.least(F.lit(1.0), (tac - threshold) / (400.0 - threshold))).otherwise(F.lit(0.0))


def ink_hot_spots(pixels: DataFrame, tile: int = 8, threshold: int = 300) -> DataFrame:
    """Severity per square tile."""
    sev = tac_severity(color.tac(*_rgb()), threshold)
    return (pixels.withColumns({"tile_x": F.floor(F.col("x") / tile).cast("int"),
                                "tile_y": F.floor(F.col("y") / tile).cast("int"), "_s": sev})
            .groupBy("image_id", "tile_x", "tile_y")
            .agg(F.max("_s").alias("max_severity"), fixed_avg(F.col("_s")).alias("avg_severity"),
                 F.count_if(F.col("_s") > 0).alias("hot_pixels")))


def colour_clusters(pixels: DataFrame, step: int = 1) -> DataFrame:
    """Pixels per quantised colour, with the first position seen; ``step`` above 1 asks for a sampling grid."""
    grid = pixels.filter(F.col("a") >= 50)
    if step > 1:
        grid = grid.filter((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return (grid.withColumn("hex", color.quantise_hex(*_rgb()))
            .groupBy("image_id", "hex")
            .agg(F.count("*").alias("pixels"),
                 F.min(F.col("y").cast("bigint") * F.col("w") + F.col("x")).alias("first_pos")))


def top_clusters(clusters: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most frequent colours per image; ties keep first appearance.

    An image has at most 729 quantised colours, so its window stays small.
    """
    w = Window.partitionBy("image_id").orderBy(F.desc("pixels"), F.asc("first_pos"))
    return clusters.withColumn("cluster_rank", F.row_number().over(w)).filter(F.col("cluster_rank") <= k)


def dark_coverage(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    """Share of opaque pixels darker than the one-bit threshold."""
    dark = (F.col("a") > 64) & (color.luma601(*_rgb()) < threshold)
    return pixels.groupBy("image_id").agg(
        F.count_if(dark).alias("dark_pixels"), (F.count_if(dark) / F.count("*")).alias("dark_coverage"))


def corner_background(pixels: DataFrame) -> DataFrame:
    """Mean colour of the four corner pixels; only corner rows reach the shuffle."""
    corners = pixels.filter(F.col("x").isin(0) | (F.col("x") == F.col("w") - 1)).filter(
        (F.col("y") == 0) | (F.col("y") == F.col("h") - 1))
    return corners.groupBy("image_id").agg(
        *[(F.sum(ch) / F.count("*")).alias(f"bg_{ch}") for ch in "rgb"])


def alpha_counts(pixels: DataFrame) -> DataFrame:
    """Solid and transparent pixels with the three transparency verdicts."""
    out = pixels.groupBy("image_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("a") > 20).alias("solid"),
        F.count_if(F.col("a") <= 20).alias("clear"), F.count_if(F.col("a") < 255).alias("not_opaque"))
    return out.select(
        "image_id", "solid", "clear", (F.col("clear") > 100).alias("sticker_transparency"),
        (F.col("clear") > F.col("n") * 0.05).alias("matte_transparency"),
        (F.col("not_opaque") / F.col("n") > 0.03).alias("suggest_dieline"))


def pixel_predicates() -> dict[str, Column]:
    return {"is_solid": F.col("a") > 20, "is_transparent": F.col("a") < 20, "is_skipped": F.col("a") < 50,
            "is_dark": (F.col("a") > 64) & (color.luma601(*_rgb()) < 128)}
