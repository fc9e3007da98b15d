"""Pixel aggregates and point transforms over whole pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions import color
from proofline.functions.rounding import fixed_avg, r6
from proofline.operators import lookup, measure, score, sizing, stencil, transforms
from proofline.plans import readiness
from proofline.sources import derive

from . import sql as S

RGB = ("r", "g", "b")


def _rgb():
    return [F.col(c) for c in RGB]


def checksum(df: DataFrame, channels=("r", "g", "b", "a"), x="x", y="y") -> list:
    """Position-sensitive digest of a pixel table, per group."""
    weights = (3, 5, 7, 11)
    code = sum((F.col(c) * w for c, w in zip(channels, weights)), F.lit(0))
    place = (F.col(x) * 31 + F.col(y) * 17) % 101 + 1
    sums = [F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}") for c in channels]
    return [*sums, F.sum((code * place).cast("bigint")).alias("digest")]


def checksum_sql(channels=("r", "g", "b", "a"), x="x", y="y") -> str:
    code = "+".join(f"{c}*{w}" for c, w in zip(channels, (3, 5, 7, 11)))
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in channels)
    return f"{sums}, CAST(sum(CAST(({code})*(({x}*31+{y}*17)%101+1) AS BIGINT)) AS BIGINT) AS digest"


def pixel_digest(spark, d):
    p = derive.pixels(spark, d)
    return p.groupBy("image_id").agg(F.count("*").alias("n"), *checksum(p))


def style_overview(spark, d):
    """Synthetic generator families with their pixel counts and mean channels."""
    p = derive.pixels(spark, d).withColumn("style", (F.col("image_id") % len(derive.STYLES)).cast("int"))
    return p.groupBy("style").agg(
        F.count("*").alias("n"), *[r6(F.sum(c) / F.count("*")).alias(f"mean_{c}") for c in RGB],
        F.count_if(F.col("a") < 255).alias("not_opaque"))


def ink_analysis(spark, d):
    return measure.analyze_ink(derive.pixels(spark, d)).withColumn("exceeded_ratio", r6(F.col("exceeded_ratio")))


def pixel_statistics(spark, d):
    out = measure.pixel_stats(derive.pixels(spark, d))
    return out.select("image_id", "n", *[r6(F.col(c)).alias(c) for c in (
        "avg_lum", "avg_sat", "raw_std", "std_lum", "spread", "transparent_ratio")])


def luminance_histogram(spark, d):
    return measure.luminance_histogram(derive.pixels(spark, d))


def histogram_spread(spark, d):
    out = measure.percentile_spread(measure.luminance_histogram(derive.pixels(spark, d)))
    return out.select("image_id", "p5_bin", "p95_bin", r6(F.col("spread")).alias("spread"))


def strided_statistics(spark, d):
    """Statistics with the large-image stride, with its limit lowered to thumbnails."""
    out = measure.pixel_stats(derive.pixels(spark, d), stride_above=1200)
    return out.select("image_id", "n", r6(F.col("avg_lum")).alias("avg_lum"), r6(F.col("avg_sat")).alias("avg_sat"))


def gamut_analysis(spark, d):
    return measure.analyze_gamut(derive.pixels(spark, d)).withColumn("oog_ratio", r6(F.col("oog_ratio")))


def in_stats_gamut(spark, d):
    return measure.in_stats_gamut_ratio(derive.pixels(spark, d))


def fused_measurement(spark, d):
    out = measure.measure(derive.pixels(spark, d))
    return out.select("image_id", "n", "max_tac", "avg_tac", "exceeded_count", "p5_bin", "p95_bin", "gamut_severity",
                      *[r6(F.col(c)).alias(c) for c in ("avg_lum", "avg_sat", "std_lum", "oog_ratio")])


def plate_coverage(spark, d):
    out = measure.plate_coverage(derive.pixels(spark, d))
    return out.select("image_id", *[r6(F.col(c)).alias(c) for c in out.columns if c != "image_id"])


def ink_hot_spots(spark, d):
    out = measure.ink_hot_spots(derive.pixels(spark, d))
    return out.select("image_id", "tile_x", "tile_y", "hot_pixels", r6(F.col("max_severity")).alias("max_severity"),
                      r6(F.col("avg_severity")).alias("avg_severity"))


def colour_clusters(spark, d):
    return measure.colour_clusters(derive.pixels(spark, d))


def top_clusters(spark, d):
    out = measure.top_clusters(measure.colour_clusters(derive.pixels(spark, d)), 8)
    return out.select("image_id", "hex", "pixels", "cluster_rank")


def dark_coverage(spark, d):
    return measure.dark_coverage(derive.pixels(spark, d)).withColumn("dark_coverage", r6(F.col("dark_coverage")))


def corner_background(spark, d):
    return measure.corner_background(derive.pixels(spark, d))


def alpha_counts(spark, d):
    return measure.alpha_counts(derive.pixels(spark, d))


def pixel_predicates(spark, d):
    p = derive.pixels(spark, d)
    return p.groupBy("image_id").agg(*[F.count_if(c).alias(n) for n, c in measure.pixel_predicates().items()])


def luma_variants(spark, d):
    p = derive.pixels(spark, d)
    forms = {"luma601": color.luma601(*_rgb()), "luma709": color.luma709(*_rgb()),
             "mid": color.lightness_mid(*_rgb()), "mean": color.luma_mean(*_rgb()),
             "saturation": color.saturation(*_rgb())}
    return p.groupBy("image_id").agg(*[r6(fixed_avg(c)).alias(n) for n, c in forms.items()])


def srgb_round_trip(spark, d):
    p = derive.pixels(spark, d)
    lin = color.srgb_to_linear(F.col("r"))
    return p.groupBy("image_id").agg(r6(fixed_avg(lin)).alias("mean_linear"),
                                     F.count_if(color.linear_to_srgb(lin) == F.col("r")).alias("stable"))


def lab_colour(spark, d):
    p = color.with_lab(derive.pixels(spark, d))
    return p.groupBy("image_id").agg(*[r6(fixed_avg(F.col(c))).alias(c) for c in ("lab_l", "lab_a", "lab_b")],
                                     r6(fixed_avg(color.lab_lightness(*_rgb()))).alias("lightness"))


def cmyk_separation(spark, d):
    p = color.with_cmyk(derive.pixels(spark, d))
    back = color.cmyk_to_rgb(F.col("c"), F.col("m"), F.col("y_ink"), F.col("k"))
    p = p.withColumns(dict(zip(("br", "bg", "bb"), back)))
    return p.groupBy("image_id").agg(*[r6(fixed_avg(F.col(c))).alias(f"mean_{c}") for c in ("c", "m", "y_ink", "k")],
                                     *[F.sum(c).alias(f"sum_{c}") for c in ("br", "bg", "bb")])


def ink_clamp(spark, d):
    p = transforms.clamp_ink(derive.pixels(spark, d), 300)
    return p.groupBy("image_id").agg(F.count_if("modified").alias("modified"), *checksum(p))


def ink_clamp_check(spark, d):
    """Ink analysis of the clamped pixels: the limit must hold everywhere."""
    p = transforms.clamp_ink(derive.pixels(spark, d), 280)
    out = measure.analyze_ink(p, 280)
    return out.select("image_id", "max_tac", "avg_tac", "exceeded_count")


def soft_proof(spark, d):
    p = transforms.soft_proof(derive.pixels(spark, d))
    return p.groupBy("image_id").agg(F.sum("residual").alias("residual"), F.max("residual").alias("worst_residual"),
                                     *checksum(p, ("proof_r", "proof_g", "proof_b")))


def tac_severity(spark, d):
    sev = measure.tac_severity(color.tac(*_rgb()))
    return derive.pixels(spark, d).groupBy("image_id").agg(
        r6(fixed_avg(sev)).alias("mean_severity"), r6(F.max(sev)).alias("max_severity"))


def background_removal(spark, d):
    p = transforms.remove_background(derive.scanlines(spark, d))
    return p.groupBy("image_id").agg(F.count_if("cleared").alias("cleared"),
                                     (F.count_if("cleared") > F.count("*") * 0.05).alias("has_transparency"),
                                     *checksum(p))


def alpha_mask(spark, d):
    p = transforms.alpha_mask(derive.pixels(spark, d))
    return p.groupBy("image_id").agg(F.count_if("mask").alias("solid"), F.count_if(~F.col("mask")).alias("clear"))


def scanline_round_trip(spark, d):
    p = stencil.to_pixels(stencil.to_scanlines(derive.pixels(spark, d)))
    return p.groupBy("image_id").agg(F.count("*").alias("n"), *checksum(p))


def measured_scores(spark, d):
    out = readiness.measured(derive.images(spark, d), derive.scanlines(spark, d))
    return score.score_readiness(out).select("image_id", "preset_id", *[f"s_{n}" for n in score.FACTORS], "score",
                                             "level")


def measured_report(spark, d):
    return readiness.readiness_report(derive.images(spark, d), derive.scanlines(spark, d))


PX = S.PIXELS
_MX, _MN = "greatest(r,g,b)", "least(r,g,b)"
_TAC = ("((1.0-r/255.0)+(1.0-g/255.0)+(1.0-b/255.0)+least(1.0-r/255.0,1.0-g/255.0,1.0-b/255.0))*100")
_SAT = f"CASE WHEN {_MX}=0 THEN 0.0 ELSE ({_MX}-{_MN})/CAST({_MX} AS DOUBLE) END"
_LUM = f"(({_MX}*0.0039215686+{_MN}*0.0039215686)*0.5)"
_BIN = f"CAST(least(255,floor({_LUM}*255+0.5)) AS INTEGER)"


def _lin(c: str) -> str:
    return f"CAST(CAST(CASE WHEN {c}/255.0<=0.04045 THEN {c}/255.0/12.92 ELSE pow(({c}/255.0+0.055)/1.055,2.4) END AS FLOAT) AS DOUBLE)"


def _code(v: str) -> str:
    g = f"CASE WHEN {v}<=0.0031308 THEN 12.92*({v}) ELSE 1.055*pow({v},1/2.4)-0.055 END"
    return f"CAST(least(255,greatest(0,floor(({g})*255+0.5))) AS INTEGER)"


def _mul(m, names) -> list[str]:
    return ["(" + "+".join(f"({c})*{n}" for c, n in zip(row, names)) + ")" for row in m]


def cmyk_sql(source: str, gcr: float = 0.8) -> str:
    a = f"SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM ({source})"
    x = _mul(color.RGB_TO_XYZ, ("lr", "lg", "lb"))
    b = f"SELECT *, {x[0]} AS xx, {x[1]} AS yy, {x[2]} AS zz FROM ({a})"
    x = _mul(color.D65_TO_D50, ("xx", "yy", "zz"))
    c = f"SELECT *, {x[0]} AS x5, {x[1]} AS y5, {x[2]} AS z5 FROM ({b})"
    x = _mul(color.D50_TO_RGB, ("x5", "y5", "z5"))
    e = "SELECT *, " + ", ".join(f"least(1.0,greatest(0.0,{v})) AS {n}" for v, n in zip(x, ("r5", "g5", "b5"))) + f" FROM ({c})"
    f = f"SELECT *, 1.0-greatest(r5,g5,b5) AS kb FROM ({e})"
    ink = ", ".join(f"CASE WHEN kb<1 THEN least(1.0,greatest(0.0,(1.0-{n}-kb)/(1.0-kb))) ELSE 0.0 END AS {o}"
                    for n, o in (("r5", "c0"), ("g5", "m0"), ("b5", "y0")))
    g = f"SELECT *, {ink} FROM ({f})"
    st = f"CASE WHEN kb>0.6 THEN {min(0.95, gcr * 1.15)!r} WHEN kb>0.3 THEN {gcr!r} ELSE {max(0.3, gcr * 0.75)!r} END"
    h = f"SELECT *, least(c0,m0,y0)*({st}) AS cut FROM ({g})"
    out = ", ".join(f"least(1.0,greatest(0.0,{i}-cut)) AS {o}" for i, o in (("c0", "c"), ("m0", "m"), ("y0", "y_ink")))
    inner = f"SELECT *, {out}, least(1.0,greatest(0.0,kb+cut*0.6)) AS kk FROM ({h})"
    back = ", ".join(f"{_code(f'((1.0-{i})*(1.0-kk))')} AS {o}" for i, o in (("c", "br"), ("m", "bg"), ("y_ink", "bb")))
    return f"SELECT *, {back} FROM ({inner})"


def gamut_sql(source: str) -> str:
    return f"SELECT *, abs(r-br)+abs(g-bg)+abs(b-bb)>38 AS oog FROM ({cmyk_sql(source)})"


def stats_sql(source: str) -> str:
    base = f"SELECT image_id, a, {_LUM} AS lum, {_BIN} AS bin, {_SAT} AS sat FROM ({source})"
    hist = f"SELECT image_id, bin, count(*) AS c FROM ({base}) GROUP BY 1,2"
    run = (f"SELECT *, sum(c) OVER (PARTITION BY image_id ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY image_id) AS t"
           f" FROM ({hist})")
    pct = (f"SELECT image_id, min(bin) FILTER (WHERE cum>=t*0.05) AS b0, min(bin) FILTER (WHERE cum>=t*0.95) AS p95_bin"
           f" FROM ({run}) GROUP BY 1")
    pct = f"SELECT *, CASE WHEN p95_bin=0 THEN 0 ELSE greatest(1,b0) END AS p5_bin FROM ({pct})"
    agg = (f"SELECT image_id, count(*) AS n, avg(lum) AS avg_lum, {S.fixed_avg('sat')} AS avg_sat,"
           f" sqrt(greatest(0.0,avg(lum*lum)-avg(lum)*avg(lum))) AS raw_std,"
           f" count(*) FILTER (WHERE a<255)/CAST(count(*) AS DOUBLE) AS transparent_ratio FROM ({base}) GROUP BY 1")
    both = f"SELECT s.*, p.p5_bin, p.p95_bin, greatest(0.0,p95_bin/255.0-p5_bin/255.0) AS spread FROM ({agg}) s JOIN ({pct}) p USING (image_id)"
    return f"SELECT *, raw_std*0.7+spread*0.15 AS std_lum FROM ({both})"


def ink_sql(source: str, limit: int = 300) -> str:
    return f"""SELECT image_id, {S.jr('max(t)')} AS max_tac, {S.jr('avg(t)')} AS avg_tac,
 count(*) FILTER (WHERE t>{limit}) AS exceeded_count, {S.r6(f"count(*) FILTER (WHERE t>{limit})/CAST(count(*) AS DOUBLE)")} AS exceeded_ratio,
 count(*) FILTER (WHERE t>{limit})>0 AS has_overflow, {limit} AS limit_threshold
 FROM (SELECT image_id, {_TAC} AS t FROM ({source})) GROUP BY 1"""


_CLUSTER = """SELECT image_id, hex, count(*) AS pixels, min(CAST(y AS BIGINT)*w+x) AS first_pos FROM (SELECT *,
 '#'||lower(lpad(printf('%x', qr*65536+qg*256+qb),6,'0')) AS hex FROM (SELECT *,
 CAST(least(255,floor(r/32.0+0.5)*32) AS BIGINT) AS qr, CAST(least(255,floor(g/32.0+0.5)*32) AS BIGINT) AS qg,
 CAST(least(255,floor(b/32.0+0.5)*32) AS BIGINT) AS qb FROM ({px}) WHERE a>=50)) GROUP BY 1,2"""
_CLUSTER = _CLUSTER.replace("{px}", PX)
_LUMA601 = "(r*0.299+g*0.587+b*0.114)"


def _lab(source: str) -> str:
    a = f"SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM ({source})"
    x = _mul(color.RGB_TO_XYZ, ("lr", "lg", "lb"))
    b = f"SELECT *, {x[0]}/0.95047 AS xx, {x[1]} AS yy, {x[2]}/1.08883 AS zz, lr*0.2126+lg*0.7152+lb*0.0722 AS yl FROM ({a})"
    f = ", ".join(f"CASE WHEN {v}>0.008856 THEN cbrt({v}) ELSE {v}*7.787+16.0/116.0 END AS f{v}" for v in ("xx", "yy", "zz", "yl"))
    c = f"SELECT *, {f} FROM ({b})"
    return (f"SELECT *, fyy*116-16 AS lab_l, (fxx-fyy)*500 AS lab_a, (fyy-fzz)*200 AS lab_b, fyl*116-16 AS lightness"
            f" FROM ({c})")


def clamp_sql(source: str, limit: int = 300) -> str:
    a = f"SELECT *, {_TAC} AS tac0 FROM ({_lab(source)})"
    b = f"""SELECT *, CAST({limit} AS DOUBLE)/greatest(tac0,1.0) AS f, 1.0-r/255.0 AS c0, 1.0-g/255.0 AS m0, 1.0-b/255.0 AS y0
 FROM ({a})"""
    c = f"""SELECT *, greatest(abs(c0-m0),abs(m0-y0),abs(c0-y0))>0.06 AND least(c0,m0,y0)<0.6 AS chromatic,
 (lab_l*f+16)/116 AS gy FROM ({b})"""
    e = f"SELECT *, lab_a*(f*0.1+0.9)/500+gy AS gx, gy-lab_b*(f*0.1+0.9)/200 AS gz FROM ({c})"
    inv = ", ".join(f"(CASE WHEN {v}*{v}*{v}>0.008856 THEN {v}*{v}*{v} ELSE ({v}-16.0/116.0)/7.787 END)*{w} AS {o}"
                    for v, w, o in (("gx", 0.95047, "x2"), ("gy", 1.0, "y2"), ("gz", 1.08883, "z2")))
    f = f"SELECT *, {inv} FROM ({e})"
    rgb = _mul(color.XYZ_TO_RGB, ("x2", "y2", "z2"))
    g = "SELECT *, " + ", ".join(f"least(1.0,greatest(0.0,{v})) AS {n}" for v, n in zip(rgb, ("nr", "ng", "nb"))) + f" FROM ({f})"
    h = "SELECT *, " + ", ".join(
        f"CASE WHEN chromatic THEN {_code(n)} ELSE CAST(least(255,greatest(0,floor((1.0-least(1.0,{i}*f))*255+0.5))) AS INTEGER) END AS {o}"
        for n, i, o in (("nr", "c0", "r1"), ("ng", "m0", "g1"), ("nb", "y0", "b1"))) + f" FROM ({g})"
    t1 = _TAC.replace("r/", "r1/").replace("g/", "g1/").replace("b/", "b1/")
    k = f"SELECT *, {t1} AS tac1 FROM ({h})"
    m = "SELECT *, " + ", ".join(
        f"CASE WHEN tac1>{limit} THEN CAST(least(255,greatest(0,floor((1.0-least(1.0,(1.0-{o}/255.0)*({limit}/tac1)))*255+0.5))) AS INTEGER) ELSE {o} END AS {p}"
        for o, p in (("r1", "r2"), ("g1", "g2"), ("b1", "b2"))) + f" FROM ({k})"
    return f"""SELECT image_id, w, h, x, y, a, tac0>{limit} AS modified, CASE WHEN tac0>{limit} THEN r2 ELSE r END AS r,
 CASE WHEN tac0>{limit} THEN g2 ELSE g END AS g, CASE WHEN tac0>{limit} THEN b2 ELSE b END AS b FROM ({m})"""


def edge_sql(source: str) -> str:
    """Mean gradient of the interior points, by brute-force neighbour joins."""
    lag = ", ".join(f"lag(l,{1}) OVER (PARTITION BY image_id,y ORDER BY x) AS lw, lead(l,1) OVER (PARTITION BY image_id,y ORDER BY x) AS le"
                    for _ in (0,))
    a = f"SELECT image_id,w,h,x,y,(r+g+b)*0.0013071895 AS l FROM ({source})"
    b = f"SELECT *, {lag} FROM ({a})"
    cols = ", ".join(f"lag({c}) OVER v AS n_{c}, lead({c}) OVER v AS s_{c}" for c in ("lw", "l", "le"))
    c = f"SELECT *, {cols} FROM ({b}) WINDOW v AS (PARTITION BY image_id,x ORDER BY y)"
    pts = f"""SELECT image_id, -n_lw-2*lw-s_lw+n_le+2*le+s_le AS gx, -n_lw-2*n_l-n_le+s_lw+2*s_l+s_le AS gy,
 -n_l-2*n_le+lw+le-2*s_lw+s_l AS gd FROM ({c}) WHERE x>=1 AND x<w-1 AND y>=1 AND y<h-1"""
    return (f"SELECT image_id, {S.fixed_avg('sqrt(gx*gx+gy*gy+0.5*gd*gd)*0.5')} AS edge_score, count(*) AS edge_points FROM ({pts})"
            " GROUP BY 1")


def background_sql(source: str, tol: float = 25.0) -> str:
    bg = f"""SELECT image_id, avg(r) AS br, avg(g) AS bgc, avg(b) AS bb FROM ({source})
 WHERE x IN (0,w-1) AND y IN (0,h-1) GROUP BY 1"""
    j = (f"SELECT p.*, sqrt((r-br)*(r-br)+(g-bgc)*(g-bgc)+(b-bb)*(b-bb)) AS dist FROM ({source}) p JOIN ({bg})"
         " USING (image_id)")
    al = f"""CASE WHEN a<20 OR dist<{tol} THEN 0 WHEN dist<{tol}*1.8 THEN CAST(floor((dist-{tol})/({tol}*0.8)*255+0.5) AS INTEGER)
 ELSE 255 END"""
    return f"""SELECT image_id, x, y, CASE WHEN z THEN 0 ELSE r END AS r, CASE WHEN z THEN 0 ELSE g END AS g,
 CASE WHEN z THEN 0 ELSE b END AS b, {al} AS a, z AS cleared FROM (SELECT *, a<20 OR dist<{tol} AS z FROM ({j}))"""


def measured_sql() -> str:
    """Images with measured columns, detected preset and DPI."""
    m = f"""SELECT s.image_id, s.avg_lum, s.avg_sat, s.std_lum, i.max_tac, i.has_overflow, g.oog_ratio, coalesce(e.edge_score,0.04) AS edge_score
 FROM ({stats_sql('SELECT * FROM px')}) s JOIN ({ink_sql('SELECT * FROM px')}) i USING (image_id)
 JOIN (SELECT image_id, count(*) FILTER (WHERE oog)/CAST(count(*) AS DOUBLE) AS oog_ratio FROM ({gamut_sql('SELECT * FROM px')}) GROUP BY 1) g
 USING (image_id) LEFT JOIN ({edge_sql('SELECT * FROM px')}) e USING (image_id)"""
    return S.dpi(S.with_preset(S.detected(f"SELECT * FROM ({S.IMAGES}) JOIN ({m}) USING (image_id)")))


_WITH = f"WITH px AS ({PX}) "
_P = "SELECT * FROM px"
_SEV = f"CASE WHEN t>300 THEN least(1.0,(t-300)/100.0) ELSE 0.0 END"
_HALF = "1200"
_DENS = {"c": "r", "m": "g", "y": "b"}
_PLATE = ", ".join(f"CASE WHEN {_MX}=0 THEN 0.0 ELSE ({_MX}-{ch})/CAST({_MX} AS DOUBLE) END AS d{n}" for n, ch in _DENS.items())
_PLATE += f", 1.0-{_MX}/255.0 AS dk"
_FACTORS = ", ".join(f"s_{n}" for n in score.FACTORS)

ENTRIES = {
    "measured_report": (measured_report, S.dbl(_WITH + f"""SELECT category, count(*) AS images,
 floor(sum(pre_score)/count(*)*10+0.5)/10 AS avg_pre, floor(sum(post_score)/count(*)*10+0.5)/10 AS avg_post,
 floor((sum(post_score)-sum(pre_score))/count(*)*10+0.5)/10 AS avg_delta, min(post_score) AS min_post, max(post_score) AS max_post,
 count(*) FILTER (WHERE regressed) AS regressions, count(*) FILTER (WHERE post_score>=88) AS ready
 FROM ({S.before_after(measured_sql())}) GROUP BY category""")),
    "measured_scores": (measured_scores, S.dbl(
        _WITH + f"SELECT image_id, preset_id, {_FACTORS}, score, level FROM ({S.score(measured_sql())})")),
    "pixel_digest": (pixel_digest, f"SELECT image_id, count(*) AS n, {checksum_sql()} FROM ({PX}) GROUP BY 1"),
    "style_overview": (style_overview, S.dbl(f"""SELECT CAST(image_id%8 AS INTEGER) AS style, count(*) AS n,
 {', '.join(f"{S.r6(f'sum({c})/CAST(count(*) AS DOUBLE)')} AS mean_{c}" for c in RGB)},
 count(*) FILTER (WHERE a<255) AS not_opaque FROM ({PX}) GROUP BY 1""")),
    "ink_analysis": (ink_analysis, S.dbl(ink_sql(PX))),
    "pixel_statistics": (pixel_statistics, S.dbl(_WITH + "SELECT image_id, n, " + ", ".join(
        f"{S.r6(c)} AS {c}" for c in ("avg_lum", "avg_sat", "raw_std", "std_lum", "spread", "transparent_ratio"))
        + f" FROM ({stats_sql(_P)})")),
    "luminance_histogram": (luminance_histogram, S.dbl(
        f"SELECT image_id, {_BIN} AS bin, count(*) AS cnt FROM ({PX}) GROUP BY 1,2")),
    "histogram_spread": (histogram_spread, S.dbl(
        _WITH + f"SELECT image_id, p5_bin, p95_bin, {S.r6('spread')} AS spread FROM ({stats_sql(_P)})")),
    "strided_statistics": (strided_statistics, S.dbl(f"""SELECT image_id, count(*) AS n, {S.r6(f'avg({_LUM})')} AS avg_lum,
 {S.r6(S.fixed_avg(_SAT))} AS avg_sat FROM ({PX}) WHERE w*h<={_HALF} OR (y*w+x)%2=0 GROUP BY 1""")),
    "gamut_analysis": (gamut_analysis, S.dbl(f"""SELECT image_id, CAST(floor(o/CAST(n AS DOUBLE)*n+0.5) AS BIGINT) AS oog_count,
 {S.r6('o/CAST(n AS DOUBLE)')} AS oog_ratio, CASE WHEN o/CAST(n AS DOUBLE)>0.15 THEN 'high' WHEN o/CAST(n AS DOUBLE)>0.05
 THEN 'moderate' ELSE 'low' END AS severity FROM (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE oog) AS o
 FROM ({gamut_sql(PX)}) GROUP BY 1)""")),
    "in_stats_gamut": (in_stats_gamut, f"SELECT DISTINCT image_id, CAST(0 AS DOUBLE) AS in_stats_oog_ratio FROM ({PX})"),
    "fused_measurement": (fused_measurement, S.dbl(_WITH + f"""SELECT s.image_id, s.n, i.max_tac, i.avg_tac, i.exceeded_count,
 s.p5_bin, s.p95_bin, CASE WHEN oog>0.15 THEN 'high' WHEN oog>0.05 THEN 'moderate' ELSE 'low' END AS gamut_severity,
 {S.r6('avg_lum')} AS avg_lum, {S.r6('avg_sat')} AS avg_sat, {S.r6('std_lum')} AS std_lum, {S.r6('oog')} AS oog_ratio
 FROM ({stats_sql(_P)}) s JOIN ({ink_sql(_P)}) i USING (image_id) JOIN (SELECT image_id,
 count(*) FILTER (WHERE oog)/CAST(count(*) AS DOUBLE) AS oog FROM ({gamut_sql(_P)}) GROUP BY 1) g USING (image_id)""")),
    "plate_coverage": (plate_coverage, S.dbl("SELECT image_id, " + ", ".join(
        f"{S.r6(S.fixed_avg(f'd{n}'))} AS mean_{n}, {S.r6(f'count(*) FILTER (WHERE d{n}>0.02)/CAST(count(*) AS DOUBLE)')} AS dots_{n}"
        for n in "cmyk") + f" FROM (SELECT image_id, {_PLATE} FROM ({PX})) GROUP BY 1")),
    "ink_hot_spots": (ink_hot_spots, S.dbl(f"""SELECT image_id, tile_x, tile_y, count(*) FILTER (WHERE s>0) AS hot_pixels,
 {S.r6('max(s)')} AS max_severity, {S.r6(S.fixed_avg('s'))} AS avg_severity FROM (SELECT image_id, x//8 AS tile_x, y//8 AS tile_y, {_SEV} AS s
 FROM (SELECT image_id, x, y, {_TAC} AS t FROM ({PX}))) GROUP BY 1,2,3""")),
    "colour_clusters": (colour_clusters, S.dbl(_CLUSTER)),
    "top_clusters": (top_clusters, S.dbl(f"""SELECT image_id, hex, pixels, cluster_rank FROM (SELECT *, CAST(row_number() OVER
 (PARTITION BY image_id ORDER BY pixels DESC, first_pos) AS INTEGER) AS cluster_rank FROM ({_CLUSTER})) WHERE cluster_rank<=8""")),
    "dark_coverage": (dark_coverage, S.dbl(f"""SELECT image_id, count(*) FILTER (WHERE a>64 AND {_LUMA601}<128) AS dark_pixels,
 {S.r6(f'count(*) FILTER (WHERE a>64 AND {_LUMA601}<128)/CAST(count(*) AS DOUBLE)')} AS dark_coverage FROM ({PX}) GROUP BY 1""")),
    "corner_background": (corner_background, f"""SELECT image_id, avg(r) AS bg_r, avg(g) AS bg_g, avg(b) AS bg_b FROM ({PX})
 WHERE x IN (0,w-1) AND y IN (0,h-1) GROUP BY 1"""),
    "alpha_counts": (alpha_counts, S.dbl(f"""SELECT image_id, count(*) FILTER (WHERE a>20) AS solid,
 count(*) FILTER (WHERE a<=20) AS clear, count(*) FILTER (WHERE a<=20)>100 AS sticker_transparency,
 count(*) FILTER (WHERE a<=20)>count(*)*0.05 AS matte_transparency,
 count(*) FILTER (WHERE a<255)/CAST(count(*) AS DOUBLE)>0.03 AS suggest_dieline FROM ({PX}) GROUP BY 1""")),
    "pixel_predicates": (pixel_predicates, S.dbl(f"""SELECT image_id, count(*) FILTER (WHERE a>20) AS is_solid,
 count(*) FILTER (WHERE a<20) AS is_transparent, count(*) FILTER (WHERE a<50) AS is_skipped,
 count(*) FILTER (WHERE a>64 AND {_LUMA601}<128) AS is_dark FROM ({PX}) GROUP BY 1""")),
    "luma_variants": (luma_variants, S.dbl(f"""SELECT image_id, {S.r6(S.fixed_avg(_LUMA601))} AS luma601,
 {S.r6(S.fixed_avg('r*0.2126+g*0.7152+b*0.0722'))} AS luma709, {S.r6(S.fixed_avg(f'({_MX}+{_MN})/2.0'))} AS mid,
 {S.r6(S.fixed_avg('(r+g+b)/3.0'))} AS mean, {S.r6(S.fixed_avg(_SAT))} AS saturation FROM ({PX}) GROUP BY 1""")),
    "srgb_round_trip": (srgb_round_trip, S.dbl(f"""SELECT image_id, {S.r6(S.fixed_avg('l'))} AS mean_linear,
 count(*) FILTER (WHERE {_code('l')}=r) AS stable FROM (SELECT image_id, r, {_lin('r')} AS l FROM ({PX})) GROUP BY 1""")),
    "lab_colour": (lab_colour, S.dbl("SELECT image_id, " + ", ".join(
        f"{S.r6(S.fixed_avg(c))} AS {c}" for c in ("lab_l", "lab_a", "lab_b", "lightness")) + f" FROM ({_lab(PX)}) GROUP BY 1")),
    "cmyk_separation": (cmyk_separation, S.dbl("SELECT image_id, " + ", ".join(
        f"{S.r6(S.fixed_avg(c))} AS mean_{o}" for c, o in (("c", "c"), ("m", "m"), ("y_ink", "y_ink"), ("kk", "k"))) + ", " + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in ("br", "bg", "bb")) + f" FROM ({cmyk_sql(PX)}) GROUP BY 1")),
    "ink_clamp": (ink_clamp, S.dbl(
        f"SELECT image_id, count(*) FILTER (WHERE modified) AS modified, {checksum_sql()} FROM ({clamp_sql(PX)}) GROUP BY 1")),
    "ink_clamp_check": (ink_clamp_check, S.dbl(
        f"SELECT image_id, max_tac, avg_tac, exceeded_count FROM ({ink_sql(clamp_sql(PX, 280), 280)})")),
    "soft_proof": (soft_proof, S.dbl(f"""SELECT image_id, CAST(sum(abs(r-br)+abs(g-bg)+abs(b-bb)) AS BIGINT) AS residual,
 max(abs(r-br)+abs(g-bg)+abs(b-bb)) AS worst_residual, {checksum_sql(('proof_r', 'proof_g', 'proof_b'))} FROM (SELECT *,
 br AS proof_r, bg AS proof_g, bb AS proof_b FROM ({cmyk_sql(PX, 0.85)})) GROUP BY 1""")),
    "tac_severity": (tac_severity, S.dbl(f"""SELECT image_id, {S.r6(S.fixed_avg('s'))} AS mean_severity, {S.r6('max(s)')} AS max_severity
 FROM (SELECT image_id, {_SEV} AS s FROM (SELECT image_id, {_TAC} AS t FROM ({PX}))) GROUP BY 1""")),
    "background_removal": (background_removal, S.dbl(_WITH + f"""SELECT image_id, count(*) FILTER (WHERE cleared) AS cleared,
 count(*) FILTER (WHERE cleared)>count(*)*0.05 AS has_transparency, {checksum_sql()} FROM ({background_sql(_P)}) GROUP BY 1""")),
    "alpha_mask": (alpha_mask, f"""SELECT image_id, count(*) FILTER (WHERE a>20) AS solid,
 count(*) FILTER (WHERE a<=20) AS clear FROM ({PX}) GROUP BY 1"""),
    "scanline_round_trip": (scanline_round_trip, f"SELECT image_id, count(*) AS n, {checksum_sql()} FROM ({PX}) GROUP BY 1"),
}
