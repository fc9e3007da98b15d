"""Stencils, masks, bleed, resampling and sharpening."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofline.functions import text as tx
from proofline.functions.rounding import fixed_avg, r6
from proofline.operators import bands, bleed, distance, masks, separable, stencil
from proofline.plans import optimise, readiness
from proofline.session import shared_dir
from proofline.sources import derive

from . import sql as S
from .pixels import _P, _WITH, checksum, checksum_sql, edge_sql


def edge_scores(spark, d):
    out = stencil.edge_score(derive.scanlines(spark, d))
    return out.select("image_id", "edge_points", r6(F.col("edge_score")).alias("edge_score"))


def sobel_peaks(spark, d):
    out = stencil.sobel(derive.scanlines(spark, d))
    return out.groupBy("image_id").agg(r6(F.max("magnitude")).alias("peak"),
                                       F.count_if(F.col("magnitude") > 0.25).alias("strong_points"))


def contrast_grid(spark, d):
    g = bands.contrast_grid(derive.scanlines(spark, d))
    return g.groupBy("image_id").agg(
        F.count_if("contrast").alias("flagged"),
        F.sum(F.when(F.col("contrast"), F.col("gx") * 7 + F.col("gy") * 13)).alias("place"))


def row_density(spark, d):
    out = bands.row_density(bands.contrast_grid(derive.scanlines(spark, d)))
    return out.select("image_id", "gy", "hits", r6(F.col("density")).alias("density"), "min_x", "max_x")


def hysteresis_state(spark, d):
    out = bands.row_density(bands.contrast_grid(derive.scanlines(spark, d)))
    return bands.hysteresis(out, "density", "image_id", "gy").select("image_id", "gy", "in_band")


def density_bands(spark, d):
    out = bands.density_bands(bands.row_density(bands.contrast_grid(derive.scanlines(spark, d))))
    return out.select("image_id", F.col("start").alias("band_start"), F.col("end").alias("band_end"), "min_x", "max_x",
                      "contrast_points")


def text_bands(spark, d):
    out = bands.text_bands(derive.scanlines(spark, d))
    return out.select("image_id", "band_no", "box_x", "box_y", "box_w", "box_h", "contrast_points",
                      r6(F.col("edge_score")).alias("edge_score"),
                      r6(tx.region_confidence(F.col("edge_score"))).alias("confidence"),
                      tx.is_blurry(F.col("edge_score")).alias("blurry"))


def first_bands(spark, d):
    """The first two bands of every image, the limit as a caller's wish."""
    out = bands.text_bands(derive.scanlines(spark, d), max_bands=2)
    return out.select("image_id", "band_no", "box_x", "box_y", "box_w", "box_h")


def mask_runs(spark, d):
    out = masks.mask_runs(masks.mask_rows(derive.scanlines(spark, d)))
    return out.select("image_id", "y", "x0", "x1")


def contour(spark, d):
    out = masks.contour_pixels(masks.mask_rows(derive.scanlines(spark, d)))
    return out.groupBy("image_id").agg(F.count("*").alias("edge_pixels"),
                                       F.sum(F.col("x") * 7 + F.col("y") * 13).alias("place"))


def erosion(spark, d):
    return masks.erode(masks.mask_rows(derive.scanlines(spark, d)), 3).select("image_id", "y", "x0", "x1")


def dilation(spark, d):
    return masks.dilate(masks.mask_rows(derive.scanlines(spark, d)), 8).select("image_id", "y", "x0", "x1")


def distance_erosion(spark, d):
    """The erosion by exact distances, whatever the radius."""
    return distance.erode(masks.mask_rows(derive.scanlines(spark, d)), 5).select("image_id", "y", "x0", "x1")


def distance_dilation(spark, d):
    """Bright red pixels grown by a wide disc."""
    rows = derive.scanlines(spark, d).select("image_id", "w", "h", "y", F.transform("r", lambda v: v > 240).alias("mask"))
    return masks.dilate(rows, 20).select("image_id", "y", "x0", "x1")


def cut_line(spark, d):
    """Contour of the dilated mask, the full die-line chain."""
    rows = masks.mask_rows(derive.scanlines(spark, d))
    grown = masks.runs_to_mask(masks.dilate(rows, 3), rows)
    return masks.contour_pixels(grown).groupBy("image_id").agg(
        F.count("*").alias("edge_pixels"), F.sum(F.col("x") * 7 + F.col("y") * 13).alias("place"))


def bleed_padding(spark, d):
    out = bleed.bleed_pad(derive.pixels(spark, d))
    return out.groupBy("image_id", "part").agg(F.count("*").alias("n"), *checksum(out, x="out_x", y="out_y"))


def local_variance(spark, d):
    out = separable.local_variance(derive.scanlines(spark, d))
    cells = out.select("image_id", F.explode("variance").alias("v"))
    return cells.groupBy("image_id").agg(F.count("*").alias("n"), r6(fixed_avg(F.col("v"))).alias("mean_variance"),
                                         r6(F.max("v")).alias("max_variance"))


def _scan_digest(scan):
    p = stencil.to_pixels(scan)
    return p.groupBy("image_id", "w", "h").agg(F.count("*").alias("n"), *checksum(p))


def resample_2x(spark, d):
    p = stencil.to_pixels(separable.resample_once(derive.scanlines(spark, d), 2.0))
    return p.groupBy("image_id").agg(F.count("*").alias("n"), *checksum(p))


def resample_3x(spark, d):
    return _scan_digest(separable.resample(derive.scanlines(spark, d), 3.0))


def sharpening(spark, d):
    return _scan_digest(separable.unsharp(derive.scanlines(spark, d)))


def optimise_chain(spark, d):
    """Upscale threefold where the thumbnail is narrow, sharpen, limit ink."""
    scan = derive.scanlines(spark, d)
    scales = derive.thumbnails(spark, d).select("image_id", F.when(F.col("w") < 30, 3).otherwise(1).alias("scale_factor"))
    return _scan_digest(optimise.optimise(scan, scales))


def optimised_report(spark, d):
    """Optimise, measure and score again, per category."""
    work = f"{shared_dir(spark)}/optimised-{uuid.uuid4().hex}"
    return readiness.optimised_report(derive.images(spark, d), derive.scanlines(spark, d), work)


def named_steps(spark, d):
    out = optimise.run_steps(derive.scanlines(spark, d), ["limit_ink"]).transform(optimise.ANALYSES["ink"])
    return out.select("image_id", "max_tac", "avg_tac", "exceeded_count")


_NEIGH = f"""SELECT *, lead(l) OVER (PARTITION BY image_id,y ORDER BY x) AS lr, lead(l) OVER (PARTITION BY image_id,x ORDER BY y) AS ld
 FROM (SELECT image_id,w,h,x,y,r*0.299+g*0.587+b*0.114 AS l, 1 AS step FROM ({_P}))"""
_GRID = f"""SELECT image_id,w,h,step,w//step AS gw,h//step AS gh,x//step AS gx,y//step AS gy,
 x//step>=1 AND x//step<w//step-1 AND y//step>=1 AND y//step<h//step-1 AND abs(l-lr)+abs(l-ld)>38.0 AS c FROM ({_NEIGH})
 WHERE x%step=0 AND y%step=0 AND x//step<w//step AND y//step<h//step"""
_DENSITY = f"""SELECT image_id,w,h,step,gw,gh,gy,count(*) FILTER (WHERE c) AS hits,
 count(*) FILTER (WHERE c)/CAST(gw AS DOUBLE) AS density, min(gx*step) FILTER (WHERE c) AS min_x, max(gx*step) FILTER (WHERE c) AS max_x
 FROM ({_GRID}) GROUP BY image_id,w,h,step,gw,gh,gy"""
_HYST = f"""SELECT *, coalesce(last_value(CASE WHEN density>0.08 THEN 1 WHEN density<=0.04 THEN 0 END IGNORE NULLS) OVER
 (PARTITION BY image_id ORDER BY gy ROWS UNBOUNDED PRECEDING),0) AS in_band FROM ({_DENSITY})"""
_BANDS = f"""SELECT image_id,w,h,step,gh,band_start,
 CASE WHEN last_on=gh-1 THEN last_on ELSE last_on+1 END AS band_end, min_x, max_x, contrast_points FROM (
 SELECT image_id,w,h,step,gh,bid, min(gy) FILTER (WHERE in_band=1) AS band_start, max(gy) FILTER (WHERE in_band=1) AS last_on,
 min(min_x) AS min_x, max(max_x) AS max_x, CAST(sum(hits) AS BIGINT) AS contrast_points FROM (
 SELECT *, sum(CASE WHEN in_band=1 AND pv=0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY gy ROWS UNBOUNDED PRECEDING) AS bid
 FROM (SELECT *, coalesce(lag(in_band) OVER (PARTITION BY image_id ORDER BY gy),0) AS pv FROM ({_HYST}))) WHERE in_band=1 OR pv=1
 GROUP BY image_id,w,h,step,gh,bid) WHERE CASE WHEN last_on=gh-1 THEN gh-band_start>=2 ELSE last_on+1-band_start>=2 AND last_on+1-band_start<=gh*0.4 END"""
_BOXES = f"""SELECT *, box_w0 AS box_w, box_h0 AS box_h, contrast_points/((box_w0/CAST(step AS DOUBLE))*(box_h0/CAST(step AS DOUBLE))) AS es
 FROM (SELECT *, greatest(0,min_x-2*step) AS box_x, band_start*step AS box_y, least(w-min_x,max_x-min_x+4*step) AS box_w0,
 least(h,band_end*step+2*step)-band_start*step AS box_h0 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY band_start)
 AS INTEGER) AS band_no FROM ({_BANDS})) WHERE max_x>min_x AND max_x-min_x>w*0.08)"""
_RUNS = """SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT image_id, y, x,
 x-row_number() OVER (PARTITION BY image_id,y ORDER BY x) AS isle FROM ({src})) GROUP BY image_id, y, isle"""
_EDGE4 = """SELECT image_id, count(*) AS edge_pixels, CAST(sum(x*7+y*13) AS BIGINT) AS place FROM (SELECT *,
 lag(m) OVER (PARTITION BY image_id,y ORDER BY x) AS wl, lead(m) OVER (PARTITION BY image_id,y ORDER BY x) AS wr,
 lag(m) OVER (PARTITION BY image_id,x ORDER BY y) AS wu, lead(m) OVER (PARTITION BY image_id,x ORDER BY y) AS wd FROM ({src}))
 WHERE m AND x>=1 AND x<w-1 AND y>=1 AND y<h-1 AND NOT (wl AND wr AND wu AND wd) GROUP BY 1"""


def _near(value: str, radius: int) -> str:
    """Pixels within the disc of a pixel whose mask equals ``value``: two-pass distance."""
    col = f"""SELECT image_id,w,h,x,y, least(y-coalesce(max(CASE WHEN m={value} THEN y END) OVER (PARTITION BY image_id,x ORDER BY y
 ROWS UNBOUNDED PRECEDING),-1000), coalesce(min(CASE WHEN m={value} THEN y END) OVER (PARTITION BY image_id,x ORDER BY y
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),100000)-y) AS g FROM mk"""
    return f"""SELECT a.image_id,a.w,a.h,a.y,a.x+d.dx AS x FROM (SELECT * FROM ({col}) WHERE g<={radius}) a,
 (SELECT unnest(range(-{radius},{radius}+1)) AS dx) d WHERE d.dx*d.dx+a.g*a.g<={radius * radius} AND a.x+d.dx BETWEEN 0 AND a.w-1"""


_MK = "mk AS (SELECT image_id,w,h,x,y,a>20 AS m FROM px) "


def _dilated(radius: int) -> str:
    return f"SELECT DISTINCT image_id,w,h,CAST(x AS INTEGER) AS x,y FROM ({_near('TRUE', radius)})"


def _eroded(radius: int) -> str:
    return f"""SELECT image_id,x,y FROM mk WHERE m AND x>={radius} AND x<w-{radius} AND y>={radius} AND y<h-{radius}
 AND (image_id,x,y) NOT IN (SELECT image_id,x,y FROM ({_near('FALSE', radius)}))"""


def _bleed_sql() -> str:
    src = f"""SELECT *, greatest(16,{S.jr('w/210.0*3.0')}) AS bl, greatest(16,{S.jr('h/297.0*3.0')}) AS bt FROM ({_P})"""
    parts = [("centre", "TRUE", "x+bl", "y+bt"), ("top", "y<bt", "x+bl", "bt-1-y"), ("bottom", "y>=h-bt", "x+bl", "bt+2*h-1-y"),
             ("left", "x<bl", "bl-1-x", "y+bt"), ("right", "x>=w-bl", "bl+2*w-1-x", "y+bt"),
             ("corner", "x<bl AND y<bt", "x", "y"), ("corner", "x>=w-bl AND y<bt", "x+2*bl", "y"),
             ("corner", "x<bl AND y>=h-bt", "x", "y+2*bt"), ("corner", "x>=w-bl AND y>=h-bt", "x+2*bl", "y+2*bt")]
    body = " UNION ALL ".join(f"SELECT image_id,'{n}' AS part,r,g,b,a,{ox} AS out_x,{oy} AS out_y FROM bp WHERE {c}"
                              for n, c, ox, oy in parts)
    return (f"WITH px AS ({S.PIXELS}), bp AS ({src}) SELECT image_id, part, count(*) AS n, {checksum_sql(x='out_x', y='out_y')}"
            f" FROM ({body}) GROUP BY 1,2")


def _lin32(c: str) -> str:
    return f"CASE WHEN {c}/255.0<=0.04045 THEN {c}/255.0/12.92 ELSE pow(({c}/255.0+0.055)/1.055,2.4) END"


def _variance_sql() -> str:
    y = f"(({_lin32('r')})*0.2126+({_lin32('g')})*0.7152+({_lin32('b')})*0.0722)"
    lum = f"CAST(CAST(116*(CASE WHEN yy>0.008856 THEN cbrt(yy) ELSE 7.787*yy+16/116.0 END)-16 AS FLOAT) AS DOUBLE)/100"
    v = f"SELECT image_id,x,y,{lum} AS v FROM (SELECT image_id,x,y,{y} AS yy FROM ({_P}))"
    rows = f"""SELECT image_id,x,y,sum(v) OVER w AS s, sum(v*v) OVER w AS q, count(*) OVER w AS n FROM ({v})
 WINDOW w AS (PARTITION BY image_id,y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"""
    cols = f"""SELECT image_id,sum(s) OVER w AS s,sum(q) OVER w AS q,sum(n) OVER w AS n FROM ({rows})
 WINDOW w AS (PARTITION BY image_id,x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"""
    var = f"SELECT image_id, CAST(CAST(greatest(0.0,q/n-(s/n)*(s/n)) AS FLOAT) AS DOUBLE) AS v FROM ({cols})"
    return (f"SELECT image_id, count(*) AS n, {S.r6(S.fixed_avg('v'))} AS mean_variance, {S.r6('max(v)')} AS max_variance"
            f" FROM ({var}) GROUP BY 1")


def _kernel(d: str) -> str:
    t = f"(least(1024,floor(abs({d})/3.0*1024+0.5))/1024.0*3.0)"
    k = f"CASE WHEN abs({d})>=3 OR {t}>=3 THEN 0.0 WHEN {t}=0 THEN 1.0 ELSE sin(pi()*{t})/(pi()*{t})*sin(pi()*{t}/3)/(pi()*{t}/3) END"
    return f"CAST(CAST({k} AS FLOAT) AS DOUBLE)"


def _resample_ctes(src: str, scale: float, out: str) -> str:
    """``out``, the relation ``src`` of pixels enlarged once: two separable passes as joins with tap tables by image side."""
    from .pixels import _code, _lin

    sc, size = f"CAST({scale!r} AS DOUBLE)", f"CAST(floor(side*{scale!r}+0.5) AS BIGINT)"
    taps = f"""SELECT side, o, t, {_kernel(f'((o+0.5)/{sc}-0.5-t)')} AS wt FROM (SELECT side, o, unnest(range(
 greatest(0,CAST(floor((o+0.5)/{sc}-0.5-3) AS BIGINT)), least(side-1,CAST(ceil((o+0.5)/{sc}-0.5+3) AS BIGINT))+1)) AS t
 FROM (SELECT side, unnest(range({size})) AS o FROM (SELECT DISTINCT w AS side FROM {src} UNION SELECT DISTINCT h FROM {src})))"""

    def blend(v: str) -> str:
        return f"least(max({v}),greatest(min({v}),sum({v}*wt)/sum(wt)))"

    lin = f"SELECT image_id,w,h,x,y,{_lin('r')} AS lr,{_lin('g')} AS lg,{_lin('b')} AS lb,a/255.0 AS la FROM {src}"
    f32 = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
    row = ("SELECT image_id,w,h,y,o AS x," + ",".join(f"{f32.format(blend(c))} AS {c}" for c in ("lr", "lg", "lb"))
           + f",{f32.format('sum(la*wt)/sum(wt)')} AS la FROM ({lin}) s JOIN tp_{out} tp ON tp.side=s.w AND tp.t=s.x AND wt<>0 GROUP BY 1,2,3,4,5")
    col = ("SELECT image_id,w,h,x,o AS y," + ",".join(f"{blend(c)} AS {c}" for c in ("lr", "lg", "lb"))
           + f",sum(la*wt)/sum(wt) AS la FROM ({row}) s JOIN tp_{out} tp ON tp.side=s.h AND tp.t=s.y AND wt<>0 GROUP BY 1,2,3,4,5")
    grown = "CAST(floor({}*" + repr(scale) + "+0.5) AS INTEGER)"
    return (f"tp_{out} AS ({taps}), {out} AS MATERIALIZED (SELECT image_id,{grown.format('w')} AS w,{grown.format('h')} AS h,CAST(x AS INTEGER) AS x,CAST(y AS INTEGER) AS y,"
            f"{_code('lr')} AS r,{_code('lg')} AS g,{_code('lb')} AS b,CAST(least(255,greatest(0,floor(la*255+0.5))) AS INTEGER) AS a FROM ({col}))")


def _resample_sql() -> str:
    return (f"WITH px AS ({S.PIXELS}), {_resample_ctes('px', 2.0, 'two')}"
            f" SELECT image_id, count(*) AS n, {checksum_sql()} FROM two GROUP BY 1")


def _digest_sql(src: str) -> str:
    return f"SELECT image_id,w,h,count(*) AS n,{checksum_sql()} FROM {src} GROUP BY 1,2,3"


def _threefold_sql() -> str:
    """Factor 3 is a doubling and a pass by 1.5."""
    return f"WITH px AS ({S.PIXELS}), {_resample_ctes('px', 2.0, 'two')}, {_resample_ctes('two', 1.5, 'three')} {_digest_sql('three')}"


def _optimised_sql() -> str:
    """Narrow images enlarged, all sharpened, ink limited."""
    from .pixels import clamp_sql

    return (f"WITH RECURSIVE px AS MATERIALIZED ({S.PIXELS}), nar AS (SELECT * FROM px WHERE w<30), {_resample_ctes('nar', 2.0, 'two')},"
            f" {_resample_ctes('two', 1.5, 'three')}, sized AS MATERIALIZED (SELECT * FROM three UNION ALL SELECT * FROM px WHERE w>=30),"
            f" {_sharpen_ctes('sized')}, lim AS ({clamp_sql('SELECT * FROM sharp')}) {_digest_sql('lim')}")


def _blur_kernels(lengths: str, sigmas: dict[str, float]) -> str:
    """``kern(n, i, j, <name>...)``: weight of entry j in output i after both sweeps over n entries.

    The answer of the recurrence to a single one comes from a recursive query; a backward sweep is the same in reverse.
    """
    steps, sums = [], []
    for name, sigma in sigmas.items():
        gain, b1, b2, b3 = separable._recursive_coefficients(sigma)
        steps.append((f"{gain!r}::DOUBLE AS {name}0, 0::DOUBLE AS {name}1, 0::DOUBLE AS {name}2",
                      f"{b1!r}::DOUBLE*{name}0+{b2!r}::DOUBLE*{name}1+{b3!r}::DOUBLE*{name}2,{name}0,{name}1"))
        sums.append(f"sum(a.{name}0*b.{name}0) AS {name}")
    return (f"imp AS (SELECT 0 AS k, {','.join(s[0] for s in steps)} UNION ALL SELECT k+1, {','.join(s[1] for s in steps)} FROM imp"
            f" WHERE k+1<(SELECT max(n) FROM ({lengths}))),"
            f" kern AS MATERIALIZED (SELECT n, i, j, {','.join(sums)} FROM (SELECT n, unnest(range(n)) AS i FROM ({lengths})) li,"
            f" LATERAL (SELECT unnest(range(n)) AS j) lj, LATERAL (SELECT unnest(range(greatest(i,j),n)) AS m) lm"
            f" JOIN imp a ON a.k=m-i JOIN imp b ON b.k=m-j GROUP BY n, i, j)")


def _sharpen_ctes(src: str) -> str:
    """``sharp(image_id, w, h, x, y, r, g, b, a)`` after the relation ``src``, for the default strengths."""
    y = f"(({_lin32('r')})*0.2126+({_lin32('g')})*0.7152+({_lin32('b')})*0.0722)"
    light = "CAST(CAST(116*(CASE WHEN yy>0.008856 THEN cbrt(yy) ELSE 7.787*yy+16/116.0 END)-16 AS FLOAT) AS DOUBLE)"
    kernels = _blur_kernels(f"SELECT DISTINCT w AS n FROM {src} UNION SELECT DISTINCT h FROM {src}", {"f": 0.8, "c": 2.5})
    return f"""{kernels},
 lt AS MATERIALIZED (SELECT *, {light} AS l FROM (SELECT *, {y} AS yy FROM {src})),
 bx AS (SELECT image_id,y,i AS x,sum(l*k.f) AS f,sum(l*k.c) AS c FROM lt JOIN kern k ON k.n=w AND k.j=x GROUP BY ALL),
 hs AS (SELECT DISTINCT image_id,h FROM {src}),
 by_ AS (SELECT image_id,x,i AS y,sum(b.f*k.f) AS f,sum(b.c*k.c) AS c FROM bx b JOIN hs USING (image_id) JOIN kern k ON k.n=h AND k.j=y GROUP BY ALL),
 vr AS (SELECT image_id,x,y,sum(v) OVER w AS s, sum(v*v) OVER w AS q, count(*) OVER w AS n FROM (SELECT *, l/100 AS v FROM lt)
  WINDOW w AS (PARTITION BY image_id,y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
 vc AS (SELECT image_id,x,y,sum(s) OVER w AS s,sum(q) OVER w AS q,sum(n) OVER w AS n FROM vr
  WINDOW w AS (PARTITION BY image_id,x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
 va AS (SELECT image_id,x,y,CAST(CAST(greatest(0.0,q/n-(s/n)*(s/n)) AS FLOAT) AS DOUBLE) AS v FROM vc),
 dd AS (SELECT lt.*, v, l-f AS df, l-c AS ds FROM lt JOIN by_ USING (image_id,x,y) JOIN va USING (image_id,x,y)),
 de AS (SELECT *, CASE WHEN df*ds>0 THEN df*0.65+ds*0.35 ELSE df*0.4+ds*0.6 END AS d FROM dd),
 dg AS (SELECT *, d*1.5*(0.8+0.4*least(1.2,abs(d)/15.0))*CASE WHEN v<0.0003 THEN 0.05 WHEN v<0.004 THEN 0.05+0.95*pow((v-0.0003)/(0.004-0.0003),2) ELSE 1.0 END AS g0 FROM de),
 dh AS (SELECT *, CASE WHEN abs(d)<3.0 THEN 0.0 WHEN abs(g0)<=15 THEN g0
  ELSE sign(g0)*least(15+7.5*(1-1/(1+(abs(g0)-15)/15.0)),22.5) END AS g1 FROM dg),
 sharp AS MATERIALIZED (SELECT image_id,w,h,x,y,{','.join(f"CAST(least(255,greatest(0,floor({c}+g1+0.5))) AS INTEGER) AS {c}" for c in "rgb")},a FROM dh)"""


def _sharpening_sql() -> str:
    return (f"WITH RECURSIVE px AS MATERIALIZED ({S.PIXELS}), {_sharpen_ctes('px')}"
            f" {_digest_sql('sharp')}")


def _sobel_sql() -> str:
    return edge_sql(_P).replace(f"{S.fixed_avg('sqrt(gx*gx+gy*gy+0.5*gd*gd)*0.5')} AS edge_score, count(*) AS edge_points",
                                f"{S.r6('max(sqrt(gx*gx+gy*gy+0.5*gd*gd)*0.5)')} AS peak,"
                                " count(*) FILTER (WHERE sqrt(gx*gx+gy*gy+0.5*gd*gd)*0.5>0.25) AS strong_points")


def _named_sql() -> str:
    from .pixels import clamp_sql, ink_sql
    return f"SELECT image_id, max_tac, avg_tac, exceeded_count FROM ({ink_sql(clamp_sql(S.PIXELS))})"


OPTIMISED_SQL = S.dbl(_optimised_sql())

ENTRIES = {
    "edge_scores": (edge_scores, S.dbl(
        _WITH + f"SELECT image_id, edge_points, {S.r6('edge_score')} AS edge_score FROM ({edge_sql(_P)})")),
    "sobel_peaks": (sobel_peaks, S.dbl(_WITH + _sobel_sql())),
    "contrast_grid": (contrast_grid, S.dbl(_WITH + f"""SELECT image_id, count(*) FILTER (WHERE c) AS flagged,
 CAST(sum(gx*7+gy*13) FILTER (WHERE c) AS BIGINT) AS place FROM ({_GRID}) GROUP BY 1""")),
    "row_density": (row_density, S.dbl(
        _WITH + f"SELECT image_id, gy, hits, {S.r6('density')} AS density, min_x, max_x FROM ({_DENSITY})")),
    "hysteresis_state": (hysteresis_state, S.dbl(_WITH + f"SELECT image_id, gy, in_band FROM ({_HYST})")),
    "density_bands": (density_bands, S.dbl(
        _WITH + f"SELECT image_id, band_start, band_end, min_x, max_x, contrast_points FROM ({_BANDS})")),
    "first_bands": (first_bands, S.dbl(_WITH + f"SELECT image_id, band_no, box_x, box_y, box_w, box_h FROM ({_BOXES}) WHERE band_no<=2")),
    "text_bands": (text_bands, S.dbl(_WITH + f"""SELECT image_id, band_no, box_x, box_y, box_w, box_h, contrast_points,
 {S.r6('es')} AS edge_score, {S.r6('least(0.99,greatest(0.65,es*0.2+0.75))')} AS confidence, es<0.15 AS blurry FROM ({_BOXES})""")),
    "mask_runs": (mask_runs, _WITH + _RUNS.format(src="SELECT image_id,x,y FROM px WHERE a>20")),
    "contour": (contour, _WITH + _EDGE4.format(src="SELECT image_id,w,h,x,y,a>20 AS m FROM px")),
    "erosion": (erosion, _WITH + ", " + _MK + _RUNS.format(src=_eroded(3))),
    "dilation": (dilation, _WITH + ", " + _MK + _RUNS.format(src=_dilated(8))),
    "distance_erosion": (distance_erosion, _WITH + ", " + _MK + _RUNS.format(src=_eroded(5))),
    "distance_dilation": (distance_dilation, _WITH + ", " + _MK.replace("a>20", "r>240") + _RUNS.format(src=_dilated(20))),
    "cut_line": (cut_line, _WITH + ", " + _MK + _EDGE4.format(
        src=f"SELECT mk.image_id, mk.w, mk.h, mk.x, mk.y, d.x IS NOT NULL AS m FROM mk LEFT JOIN ({_dilated(3)}) d USING (image_id,x,y)")),
    "bleed_padding": (bleed_padding, S.dbl(_bleed_sql())),
    "local_variance": (local_variance, S.dbl(_WITH + _variance_sql())),
    "resample_2x": (resample_2x, S.dbl(_resample_sql())),
    "resample_3x": (resample_3x, S.dbl(_threefold_sql())),
    "sharpening": (sharpening, S.dbl(_sharpening_sql())),
    "optimise_chain": (optimise_chain, None),  # OPTIMISED_SQL takes minutes at sf0.01; tests run it on the small table
    "optimised_report": (optimised_report, None),
    "named_steps": (named_steps, S.dbl(_named_sql())),
}
