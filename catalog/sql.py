"""Building blocks of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

import re

from proofline.sources import derive, dims


def dbl(sql: str) -> str:
    """Decimal literals become doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\de.])", r"\1e0", sql)


def q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def lst(values) -> str:
    return "[" + ",".join(q(v) for v in values) + "]"


def values(rows, cols: str) -> str:
    body = ",".join("(" + ",".join(q(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({cols}))"


def jr(e: str) -> str:
    return f"CAST(floor(({e})+0.5) AS INTEGER)"


def r6(e: str) -> str:
    return f"floor(({e})*1e6+0.5)/1e6"


def fixed_avg(e: str) -> str:
    """Mean over nano-units summed as integers, so the order of rows cannot matter."""
    return f"CAST(sum(CAST(floor(({e})*1e9+0.5) AS BIGINT)) AS DOUBLE)/1e9/count(*)"


def case_list(key: str, pairs, default: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in pairs) + f" ELSE {default} END"


IMAGES = f"""SELECT p_partkey AS image_id, replace(p_name,' ','_')||'_'||p_partkey||'.png' AS name, p_type AS category,
 {lst(derive.MIMES)}[p_partkey%5+1] AS mime, (p_partkey*7919)%160000000 AS size_bytes,
 CAST(200+(p_partkey*37)%4800 AS INTEGER) AS width_px,
 CAST(200+(p_partkey*53+p_size*97)%4800 AS INTEGER) AS height_px,
 p_partkey//32 AS batch_id, CAST(p_partkey%32 AS INTEGER) AS seq FROM part"""

STATS = f"""SELECT *, ((image_id*31)%1000)/1000.0 AS avg_lum, ((image_id*17)%1000)/1000.0 AS avg_sat,
 ((image_id*13)%400)/1000.0 AS std_lum, ((image_id*7)%100)/1000.0 AS edge_score,
 CAST(200+(image_id*11)%201 AS INTEGER) AS max_tac FROM ({IMAGES})"""

THUMBS = """SELECT p_partkey AS image_id, CAST(24+p_size%24 AS INTEGER) AS w, CAST(24+p_partkey%17 AS INTEGER) AS h,
 CAST(p_partkey%8 AS INTEGER) AS style, CAST(p_partkey%1000 AS INTEGER) AS k, p_size AS s FROM part"""

_INK = "((y//5)%3=1 AND x*6>=w AND x*6<=w*5 AND ((x*7+k)//2)%3=0)"
_STRIPE = "CASE WHEN x%4<2 THEN 0 ELSE 255 END"
_LINE = "(x%9=0 OR y%9=0)"
PIXELS = f"""SELECT image_id, w, h, x, y,
 CAST(CASE style WHEN 0 THEN (x*(65280//w))//256 WHEN 1 THEN (x*11+y*7+k*13)%256 WHEN 2 THEN CASE WHEN {_INK} THEN 20 ELSE 240 END
  WHEN 3 THEN {_STRIPE} WHEN 4 THEN 8+(x+k)%17 WHEN 5 THEN 224+(x*3)%32 WHEN 6 THEN 244+(x+y)%8
  ELSE CASE WHEN {_LINE} THEN 40 ELSE 14 END END AS INTEGER) AS r,
 CAST(CASE style WHEN 0 THEN (y*(65280//h))//256 WHEN 1 THEN (x*5+y*17+s*29)%256 WHEN 2 THEN CASE WHEN {_INK} THEN 24 ELSE 236 END
  WHEN 3 THEN {_STRIPE} WHEN 4 THEN 6+y%13 WHEN 5 THEN (y*5)%40 WHEN 6 THEN 240+(x+k)%9
  ELSE CASE WHEN {_LINE} THEN 95 ELSE 48 END END AS INTEGER) AS g,
 CAST(CASE style WHEN 0 THEN (k*37)%256 WHEN 1 THEN (x*y+k*3)%256 WHEN 2 THEN CASE WHEN {_INK} THEN 30 ELSE 228 END
  WHEN 3 THEN {_STRIPE} WHEN 4 THEN 10+(x+y)%19 WHEN 5 THEN 200+(x+y)%56 WHEN 6 THEN 238+(y+s)%11
  ELSE CASE WHEN {_LINE} THEN 185 ELSE 115 END END AS INTEGER) AS b,
 CAST(CASE WHEN style IN (1,5) THEN CASE WHEN (2*x-w)*(2*x-w)+(2*y-h)*(2*y-h) <= least(w,h)*least(w,h) THEN 255 ELSE 0 END
  WHEN style=6 THEN (x*(65280//w))//256 ELSE 255 END AS INTEGER) AS a
 FROM (SELECT *, CAST(i%w AS INTEGER) AS x, CAST(i//w AS INTEGER) AS y
       FROM (SELECT *, unnest(range(w*h)) AS i FROM ({THUMBS})))"""

PRESETS = values([(p[0], p[2], p[3], p[4], p[5], p[9], p[10], p[11], p[1], p[12]) for p in dims.PRESETS],
                 "preset_id,width_mm,height_mm,target_dpi,bleed_mm,crop_marks,color_bars,registration_marks,"
                 "preset_name,ordinal")
PRESETS = (f"(SELECT preset_id, CAST(width_mm AS DOUBLE) width_mm, CAST(height_mm AS DOUBLE) height_mm, target_dpi,"
           f" CAST(bleed_mm AS DOUBLE) bleed_mm, crop_marks, color_bars, registration_marks, preset_name, ordinal"
           f" FROM {PRESETS})")

DETECT = """CASE WHEN width_px=0 OR height_px=0 THEN 'poster-a4'
 WHEN asp BETWEEN 0.92 AND 1.08 AND lp<=1200 THEN 'sticker' WHEN asp BETWEEN 0.92 AND 1.08 THEN 'social'
 WHEN asp BETWEEN 1.58 AND 1.78 AND sp<=1400 THEN 'business-card' WHEN asp BETWEEN 1.44 AND 1.55 THEN 'postcard'
 WHEN asp BETWEEN 1.35 AND 1.44 AND lp>=3400 THEN 'poster-a3' ELSE 'poster-a4' END"""


def detected(source: str) -> str:
    return (f"SELECT * EXCLUDE (asp,lp,sp), {DETECT} AS preset_id FROM (SELECT *, greatest(width_px,height_px) AS lp,"
            f" least(width_px,height_px) AS sp, greatest(width_px,height_px)/CAST(least(width_px,height_px) AS DOUBLE)"
            f" AS asp FROM ({source}))")


def with_preset(source: str) -> str:
    known = ",".join(q(p[0]) for p in dims.PRESETS)
    return (f"SELECT s.*, d.* EXCLUDE (preset_id, ordinal) FROM (SELECT *, CASE WHEN preset_id IN ({known}) THEN"
            f" preset_id ELSE 'poster-a4' END AS pk FROM ({source})) s JOIN {PRESETS} d ON s.pk=d.preset_id")


_DIG = "(preset_id='social' OR width_mm<=0 OR height_mm<=0)"


def dpi(source: str) -> str:
    """Effective resolution of rows with image and preset columns."""
    fit = ("least(greatest(width_px,height_px)/greatest(width_mm,height_mm),"
           "least(width_px,height_px)/least(width_mm,height_mm))*25.4")
    base = f"SELECT *, CASE WHEN {_DIG} THEN 72 ELSE {jr(fit)} END AS current_dpi FROM ({source})"
    tier = (f"CASE WHEN {_DIG} THEN CASE WHEN least(width_px,height_px)>=1080 THEN 'excellent' ELSE 'warning' END "
            "WHEN current_dpi>=280 THEN 'excellent' WHEN current_dpi>=200 THEN 'good' "
            "WHEN current_dpi>=140 THEN 'warning' ELSE 'critical' END")
    want = "least(8,greatest(2,CAST(ceil(target_dpi/CAST(greatest(1,current_dpi) AS DOUBLE)) AS INTEGER)))"
    # largest allowed factor by enumeration, unlike the closed form on the Spark side
    scale = (f"CASE WHEN {_DIG} THEN CASE WHEN least(width_px,height_px)<1080 THEN "
             "CAST(ceil(1080/CAST(least(width_px,height_px) AS DOUBLE)) AS INTEGER) ELSE 1 END "
             "WHEN current_dpi<target_dpi AND greatest(width_px,height_px)<6000 THEN "
             f"greatest(1,list_max([f for f in [1,2,3,4,5,6,7,8] if f<={want} AND "
             "f*greatest(width_px,height_px)<=6000])) ELSE 1 END")
    mid = (f"SELECT *, {tier} AS quality_tier, CAST({scale} AS INTEGER) AS scale_factor,"
           f" CASE WHEN {_DIG} THEN 1080 ELSE {jr('width_mm/25.4*target_dpi')} END AS target_width_px,"
           f" CASE WHEN {_DIG} THEN 1080 ELSE {jr('height_mm/25.4*target_dpi')} END AS target_height_px FROM ({base})")
    return (f"SELECT *, CASE WHEN {_DIG} THEN scale_factor>1 ELSE current_dpi<target_dpi AND scale_factor>1 END"
            f" AS needs_upscale FROM ({mid})")


def score(source: str) -> str:
    """Seven sub-scores, total and level; ``source`` carries oog_ratio and has_overflow."""
    a = f"""SELECT *, width_px/CAST(height_px AS DOUBLE) AS ia, CASE WHEN {_DIG} THEN NULL ELSE width_mm/height_mm END AS ta,
 CASE WHEN {_DIG} THEN NULL ELSE height_mm/width_mm END AS tf FROM ({source})"""
    b = f"""SELECT *, abs(ia-ta)/greatest(ia,ta) AS dn, CASE WHEN ta IS NOT NULL THEN abs(ia-tf)/greatest(ia,tf) END AS df,
 greatest(ia,1.0/ia) AS ie, greatest(ta,1.0/ta) AS te FROM ({a})"""
    c = f"SELECT *, greatest(ie,te)/least(ie,te) AS gap, least(dn,df) AS opt FROM ({b})"
    sp, d = "least(width_px,height_px)", "current_dpi"
    res = f"""CASE WHEN {_DIG} THEN CASE WHEN {sp}>=1080 THEN 100.0 WHEN {sp}>=720 THEN ({sp}-720)/360.0*15+85
   ELSE greatest(30.0,floor({sp}/720.0*85+0.5)) END
  WHEN {d}>=280 THEN 100.0 WHEN {d}>=200 THEN ({d}-200)/80.0*15+85 WHEN {d}>=140 THEN ({d}-140)/60.0*25+60
  ELSE greatest(20.0,{d}/140.0*60) END"""
    asp = f"""CASE WHEN {_DIG} THEN 100.0 WHEN gap>1.8 THEN 75.0 WHEN opt>0.15 THEN
  greatest(75.0,floor((1.0-opt*0.5)*100+0.5)) ELSE 100.0 END"""
    bri = """CASE WHEN avg_lum<0.04 THEN 75.0 WHEN avg_lum<0.16 THEN greatest(70.0,floor(avg_lum/0.16*100+0.5))
  WHEN avg_lum>0.92 THEN greatest(60.0,floor((1.0-avg_lum)/0.08*100+0.5)) ELSE 100.0 END"""
    oog = "coalesce(oog_ratio,0.0)"
    sat = f"""CASE WHEN {oog}>0.12 THEN greatest(78.0,100.0-{oog}*160) WHEN avg_sat>0.82 AND {oog}<=0.02 THEN 92.0
  WHEN avg_sat>0.82 THEN 88.0 ELSE 100.0 END"""
    con = "CASE WHEN std_lum<0.05 THEN greatest(70.0,floor(std_lum/0.05*100+0.5)) ELSE 100.0 END"
    shp = "CASE WHEN edge_score<0.03 THEN greatest(55.0,floor(edge_score/0.03*100+0.5)) ELSE 100.0 END"
    over = f"(coalesce(has_overflow,FALSE) AND NOT {_DIG})"
    ink = f"CASE WHEN {over} AND max_tac>340 THEN greatest(60.0,100.0-(max_tac-300)) WHEN {over} THEN 90.0 ELSE 100.0 END"
    parts = {"resolution": res, "aspect": asp, "brightness": bri, "saturation": sat, "contrast": con,
             "sharpness": shp, "ink_safety": ink}
    e = "SELECT *, " + ", ".join(f"{jr(v)} AS s_{n}" for n, v in parts.items()) + f" FROM ({c})"
    tot = ("s_resolution*0.35+s_aspect*0.15+s_brightness*0.10+s_saturation*0.10+s_contrast*0.10+s_sharpness*0.10"
           "+s_ink_safety*0.10")
    f = f"SELECT *, greatest(0,least(100,{jr(tot)})) AS score FROM ({e})"
    return f"SELECT *, CASE WHEN score>=88 THEN 'high' WHEN score>=75 THEN 'mid' ELSE 'low' END AS level FROM ({f})"


def stats_scored() -> str:
    src = f"SELECT *, CAST(NULL AS DOUBLE) AS oog_ratio, max_tac>300 AS has_overflow FROM ({STATS})"
    return score(dpi(with_preset(detected(src))))


def before_after(dpi_source: str) -> str:
    """Pre and post score per image; the source carries DPI columns."""
    keep = "image_id, category, preset_id, width_mm, height_mm, target_dpi, avg_lum, avg_sat, std_lum, oog_ratio"
    pre = score(dpi_source)
    post_in = f"""SELECT {keep}, score AS pre_score, current_dpi AS pre_dpi,
 width_px*(CASE WHEN needs_upscale THEN scale_factor ELSE 1 END) AS width_px,
 height_px*(CASE WHEN needs_upscale THEN scale_factor ELSE 1 END) AS height_px,
 CASE WHEN needs_upscale THEN scale_factor ELSE 1 END AS applied_scale,
 least(0.08,edge_score*1.5) AS edge_score, least(300,max_tac) AS max_tac, FALSE AS has_overflow FROM ({pre})"""
    post = score(dpi(post_in))
    return (f"SELECT image_id, category, preset_id, applied_scale, pre_score, score AS post_score, pre_dpi,"
            f" current_dpi AS post_dpi, score-pre_score AS score_delta, score<pre_score AS regressed FROM ({post})")


def stats_before_after() -> str:
    src = f"SELECT *, CAST(NULL AS DOUBLE) AS oog_ratio, max_tac>300 AS has_overflow FROM ({STATS})"
    return before_after(dpi(with_preset(detected(src))))


PRINT_ORDERS = f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id,
 {lst([p[0] for p in dims.PRESETS])}[o_orderkey%{len(dims.PRESETS)}+1] AS preset_id,
 {lst([p[0] for p in dims.PAPERS])}[o_orderkey%{len(dims.PAPERS)}+1] AS paper_id,
 {lst(dims.QTY_TIERS)}[o_custkey%{len(dims.QTY_TIERS)}+1] AS qty FROM orders"""

USERS = """SELECT c_custkey AS user_id, 22+((c_custkey*7919)%3300)/1000.0 AS lat,
 120+((c_custkey*104729)%1900)/1000.0 AS lng FROM customer"""

QUEUE = """SELECT user_id*8+event_id%8 AS image_id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done'
 WHEN 'error' THEN 'error' ELSE 'idle' END AS status, ts, event_id, value FROM events"""

QUOTA = f"""SELECT event_id, ts, user_id, {lst([p[0] for p in dims.PLANS])}[user_id%3+1] AS plan_id,
 strftime(ts,'%Y-%m') AS month, CAST(1+event_id%5 AS INTEGER) AS cost FROM events WHERE event_type='purchase'"""
