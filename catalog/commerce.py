"""Quotes, imposition, shops, order papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import geo
from proofline.functions.rounding import r6
from proofline.operators import commerce, lookup, nearest, score, sizing
from proofline.sources import derive, dims

from . import sql as S


def vendor_quotes(spark, d):
    out = commerce.quote(commerce.with_vendors(derive.print_orders(spark, d)))
    return out.select("order_id", "vendor_id", "total_price", F.col("unit_price").cast("double").alias("unit_price"),
                      "lead_days", "rush", "best_value",
                      F.concat_ws(",", "notes").alias("notes"))


def paper_quotes(spark, d):
    o = derive.print_orders(spark, d).withColumn("vendor_id", F.lit("unlisted")).drop("paper_id")
    out = commerce.quote(commerce.with_papers(o))
    return out.select("order_id", "vendor_id", "paper_id", "total_price", "lead_days")


def quote_matrix(spark, d):
    """Order counts per specification priced at every vendor."""
    spec = derive.print_orders(spark, d).groupBy("preset_id", "paper_id", "qty").agg(F.count("*").alias("orders"))
    out = commerce.quote(commerce.with_vendors(spec))
    return out.select("vendor_id", "preset_id", "paper_id", "qty", "orders", "total_price",
                      (F.col("orders") * F.col("total_price")).alias("turnover"))


def best_vendor(spark, d):
    out = commerce.best_vendors(derive.print_orders(spark, d))
    return out.select("order_id", "cheapest_vendor", "cheapest_total", "fastest_vendor", "fastest_days", "fastest_total")


def quote_ranking(spark, d):
    out = commerce.rank_quotes(derive.print_orders(spark, d))
    return out.select("order_id", "vendor_id", "total_price", "price_rank")


def dimension_turnover(spark, d):
    """Orders by named paper and named preset, with the dimension attributes."""
    o = derive.print_orders(spark, d).groupBy("preset_id", "paper_id").agg(F.count("*").alias("orders"),
                                                                          F.sum("qty").alias("pieces"))
    papers = dims.table(spark, "papers").select("paper_id", "paper_name", "weight_gsm")
    out = lookup.with_preset(o).join(F.broadcast(papers), "paper_id")
    return out.select("preset_name", "paper_name", "weight_gsm", "width_mm", "height_mm", "orders", "pieces")


def _items(spark, d):
    p = derive.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"), (20.0 + F.col("p_size") * 3).alias("item_w"),
                    (15.0 + F.col("p_partkey") % 180).alias("item_h"),
                    F.when(F.col("p_partkey") % 2 == 0, "A4").otherwise("A3").alias("sheet"),
                    (1 + F.col("p_partkey") % 4).cast("int").alias("sources"))


LAYOUT = ["item_id", "sheet", "cols", "rows", "cells", "cell_w", "cell_h", "rotated", "fits", "savings_pct", "sheet_w_px",
          "sheet_h_px", "cell_w_px", "cell_h_px"]


def imposition_layouts(spark, d):
    return commerce.imposition_layout(_items(spark, d)).select(*LAYOUT)


def imposition_cells(spark, d):
    out = commerce.imposition_cells(commerce.imposition_layout(_items(spark, d)), F.col("sources"))
    return out.select("item_id", "cell_index", "cell_row", "cell_col", "source_index", r6(F.col("cell_x")).alias("cell_x"),
                      r6(F.col("cell_y")).alias("cell_y"))


def nearest_shop(spark, d):
    out = commerce.nearest_shop(derive.users_geo(spark, d))
    return out.select("user_id", "shop_id", "distance_m", "distance_text")


CITIES = ["all", "台北市", "新北市", "台中市", "高雄市", "台南市", "新竹市"]


def city_shops(spark, d):
    users = derive.users_geo(spark, d).withColumn(
        "wanted", F.get(F.array(*[F.lit(c) for c in CITIES]), (F.col("user_id") % len(CITIES)).cast("int")))
    return commerce.rank_shops(users, F.col("wanted")).select("user_id", "wanted", "shop_id", "distance_m", "shop_rank")


def shop_ranking(spark, d):
    return commerce.rank_shops(derive.users_geo(spark, d)).select("user_id", "shop_id", "distance_m", "shop_rank")


def nearest_places(spark, d):
    """Three nearest suppliers of every customer, both spread over the whole globe."""
    def globe(key, name):
        return (F.col(key).alias(name), ((F.col(key) * 7919) % 18001 / 100.0 - 90).alias("lat"), ((F.col(key) * 104729) % 36001 / 100.0 - 180).alias("lng"))

    users = derive.read(spark, d, "customer").select(*globe("c_custkey", "user_id"))
    places = derive.read(spark, d, "supplier").select(*globe("s_suppkey", "place_id"))
    return nearest.nearest_places(users, places, k=3)


def shop_cards(spark, d):
    """Nearest shop of each user with its first services and a map link."""
    near = commerce.nearest_shop(derive.users_geo(spark, d)).select("user_id", "shop_id", "distance_m")
    side = dims.table(spark, "shops").select("shop_id", "shop_name", "services", F.col("lat").alias("s_lat"),
                                             F.col("lng").alias("s_lng"))
    out = near.join(F.broadcast(side), "shop_id")
    return out.select("user_id", "shop_id", "distance_m",
                      F.concat_ws("、", F.slice("services", 1, 4)).alias("first_services"),
                      geo.map_link(F.col("s_lat"), F.col("s_lng"), F.col("shop_name")).alias("link"))


def order_files(spark, d):
    o = derive.print_orders(spark, d)
    out = lookup.with_preset(commerce.best_vendors(o))
    papers = dims.table(spark, "papers").select("paper_id", "paper_name")
    vendors = dims.table(spark, "vendors").select(F.col("vendor_id").alias("cheapest_vendor"), "short_name")
    out = out.join(F.broadcast(papers), "paper_id").join(F.broadcast(vendors), "cheapest_vendor")
    art = F.when(F.col("order_id") % 11 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("art no."), F.col("order_id").cast("string"), F.lit("/v2")))
    return out.select("order_id", commerce.order_file_name(art, F.col("short_name"), F.col("preset_name"),
                                                           F.col("paper_name"), F.col("qty")).alias("file_name"))


def order_tickets(spark, d):
    """Text tickets for every order; images are dealt to the orders in turn by their numbers."""
    o = lookup.with_preset(derive.print_orders(spark, d)).withColumn("vendor_id", F.lit("gainhow"))
    stats = derive.image_stats(spark, d).withColumns(
        {"oog_ratio": F.lit(None).cast("double"), "has_overflow": F.col("max_tac") > 300}).drop("name", "category")
    images = derive.images(spark, d).count()
    joined = commerce.quote(o).join(stats, o["order_id"] % F.lit(images) == stats["image_id"], "left")
    scored = score.score_readiness(sizing.analyze_dpi(joined))
    return commerce.order_ticket(scored).select("order_id", "ticket", "ticket_sha256")


_VENDORS = S.values([(v[0], v[4], v[5], v[3], v[7]) for v in dims.VENDORS], "vendor_id,fee,curve,base_days,v_ord")
_SIZE = S.case_list("preset_id", dims.SIZE_RATES.items(), "1.0")
_PAPER = S.case_list("paper_id", [(p[0], p[3]) for p in dims.PAPERS], str(dims.PAPERS[0][3]))
_VOL = "CASE " + " ".join(f"WHEN qty>={q} THEN {r}" for q, r in dims.VOLUME_STEPS) + " ELSE 1.0 END"
_LEAD = "CASE WHEN vendor_id='classic' THEN CASE WHEN qty<=50 THEN 1 ELSE 2 END ELSE base_days END"


def priced(source: str, vendors: str = _VENDORS) -> str:
    """Every row of ``source`` with every vendor row, priced."""
    total = f"greatest(90,{S.jr(f'fee+8.5*({_SIZE})*({_PAPER})*curve*({_VOL})*qty')})"
    return f"SELECT *, {total} AS total_price, {_LEAD} AS lead_days FROM ({source}), {vendors}"


_FIRST_VENDOR = f"(SELECT * FROM {_VENDORS} WHERE v_ord=0)"
_UNIT = "CAST((total_price*20+qty)//(qty*2)/10.0 AS DECIMAL(12,1))"
_ITEMS = """SELECT p_partkey AS item_id, 20.0+p_size*3 AS item_w, 15.0+p_partkey%180 AS item_h,
 CASE WHEN p_partkey%2=0 THEN 'A4' ELSE 'A3' END AS sheet, CAST(1+p_partkey%4 AS INTEGER) AS sources FROM part"""


def _layout_sql() -> str:
    a = f"""SELECT *, CASE WHEN sheet='A3' THEN 297.0 ELSE 210.0 END AS sw, CASE WHEN sheet='A3' THEN 420.0 ELSE 297.0 END AS sh FROM ({_ITEMS})"""
    fit = "greatest(1,CAST(floor(({s}-16.0+3.0)/({i}+3.0)) AS INTEGER))"
    b = (f"SELECT *, {fit.format(s='sw', i='item_w')} AS c0, {fit.format(s='sh', i='item_h')} AS r0,"
         f" {fit.format(s='sw', i='item_h')} AS c1, {fit.format(s='sh', i='item_w')} AS r1 FROM ({a})")
    c = f"""SELECT *, c1*r1>c0*r0 AS rotated FROM ({b})"""
    e = f"""SELECT *, CASE WHEN rotated THEN c1 ELSE c0 END AS cols, CASE WHEN rotated THEN r1 ELSE r0 END AS rows,
 CASE WHEN rotated THEN item_h ELSE item_w END AS cell_w, CASE WHEN rotated THEN item_w ELSE item_h END AS cell_h FROM ({c})"""
    f = f"SELECT *, cols*rows AS cells FROM ({e})"
    px = {n: S.jr(f"{v}/25.4*300") for n, v in (("sheet_w_px", "sw"), ("sheet_h_px", "sh"), ("cell_w_px", "cell_w"), ("cell_h_px", "cell_h"))}
    return (f"SELECT *, CASE WHEN cells>1 THEN least(85,{S.jr('(cells-1)/CAST(cells AS DOUBLE)*100')}) ELSE 0 END AS savings_pct,"
            f" cell_w<=sw-16.0 AND cell_h<=sh-16.0 AS fits, " + ", ".join(f"{v} AS {n}" for n, v in px.items()) + f" FROM ({f})")


def _cells_sql() -> str:
    k = "(300/25.4)"
    a = f"""SELECT *, cell_w*{k} AS cw, cell_h*{k} AS ch, 3.0*{k} AS gp, CAST(unnest(range(cells)) AS INTEGER) AS cell_index FROM ({_layout_sql()})"""
    b = f"""SELECT *, cell_index//cols AS cell_row, cell_index%cols AS cell_col, (sheet_w_px-(cols*cw+(cols-1)*gp))/2 AS x0,
 70+(sheet_h_px-70-(rows*ch+(rows-1)*gp))/2 AS y0 FROM ({a})"""
    return f"""SELECT item_id, cell_index, cell_row, cell_col, cell_index%sources AS source_index,
 {S.r6('x0+cell_col*(cw+gp)')} AS cell_x, {S.r6('y0+cell_row*(ch+gp)')} AS cell_y FROM ({b})"""


_SHOPS = S.values([(s[0], s[1], s[2], s[7], s[8], s[10]) for s in dims.SHOPS], "shop_id,shop_name,city,slat,slng,s_ord")
_HAV = """CAST(floor(6371000*2*atan2(sqrt(ha),sqrt(1-ha))+0.5) AS BIGINT)"""
_DIST = f"""SELECT *, {_HAV} AS distance_m FROM (SELECT *, sin(radians(slat-lat)/2)*sin(radians(slat-lat)/2)+cos(radians(lat))*cos(radians(slat))
 *sin(radians(slng-lng)/2)*sin(radians(slng-lng)/2) AS ha FROM ({S.USERS}), {_SHOPS})"""
_RANKED = f"SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY distance_m, s_ord) AS INTEGER) AS shop_rank FROM ({_DIST})"
_WANTED = f"{S.lst(CITIES)}[user_id%{len(CITIES)}+1]"
_DTEXT = """CASE WHEN distance_m<1000 THEN distance_m||' m' ELSE ((distance_m+50)//100)//10||'.'||((distance_m+50)//100)%10||' km' END"""
_SERVICES = S.values([(s[0], "、".join(s[9][:4])) for s in dims.SHOPS], "shop_id,first_services")
_NAMES = S.values([(p[0], p[1], p[2]) for p in dims.PAPERS], "paper_id,paper_name,weight_gsm")
_SHORT = S.values([(v[0], v[2]) for v in dims.VENDORS], "vendor_id,short_name")
_BEST = f"""SELECT order_id, arg_min(vendor_id,CAST(total_price AS BIGINT)*1000000+lead_days*1000+v_ord) AS cheapest_vendor,
 min(total_price) AS cheapest_total, arg_min(vendor_id,CAST(lead_days AS BIGINT)*1000000000+total_price*10+v_ord) AS fastest_vendor,
 min(lead_days) AS fastest_days, arg_min(total_price,CAST(lead_days AS BIGINT)*1000000000+total_price*10+v_ord) AS fastest_total
 FROM ({priced(S.PRINT_ORDERS)}) GROUP BY 1"""
_ART = "CASE WHEN order_id%11=0 THEN 'Artwork' ELSE regexp_replace('art no.'||order_id||'/v2','[^A-Za-z0-9_一-龥-]','_','g') END"
_FILES = f"""SELECT o.order_id, '['||short_name||']_'||{_ART.replace('order_id', 'o.order_id')}||'_'||split_part(preset_name,' ',1)||'_'||
 split_part(paper_name,' ',1)||'_'||qty||'張_正面.pdf' AS file_name FROM ({S.with_preset(S.PRINT_ORDERS)}) o JOIN ({_BEST}) b USING (order_id)
 JOIN {_NAMES} n USING (paper_id) JOIN {_SHORT} s ON s.vendor_id=cheapest_vendor"""


def _ticket_sql() -> str:
    src = f"""SELECT q.*, st.* EXCLUDE (name, category), CAST(NULL AS DOUBLE) AS oog_ratio, max_tac>300 AS has_overflow
 FROM ({priced(S.with_preset(S.PRINT_ORDERS), _FIRST_VENDOR)}) q LEFT JOIN ({S.STATS}) st ON st.image_id=q.order_id%(SELECT count(*) FROM part)"""
    scored = S.score(S.dpi(src))
    lines = ["format('order {} at {}',order_id,vendor_id)", "format('item {} on {}, {} pcs',preset_id,paper_id,qty)",
             "format('trim {:.1f} x {:.1f} mm, with bleed {:.1f} x {:.1f} mm',width_mm,height_mm,width_mm+2*bleed_mm,height_mm+2*bleed_mm)",
             f"format('total {{}}, unit {{}}, lead {{}} days',total_price,CAST({_UNIT} AS VARCHAR),lead_days)",
             "format('resolution {} dpi: {}',current_dpi,CASE WHEN current_dpi>=280 THEN 'pass' ELSE 'fail' END)",
             "format('ink {} %: {}',max_tac,CASE WHEN max_tac<=300 THEN 'pass' ELSE 'fail' END)",
             "format('score {} of 100',score)"]
    return (f"SELECT order_id, ticket, sha256(ticket) AS ticket_sha256 FROM (SELECT order_id, concat_ws(chr(10),{','.join(lines)})"
            f" AS ticket FROM ({scored}))")


_GLOBE = "SELECT {k} AS {n}, ({k}*7919)%18001/100.0-90 AS {a}lat, ({k}*104729)%36001/100.0-180 AS {a}lng FROM {t}"

ENTRIES = {
    "nearest_places": (nearest_places, S.dbl(f"""SELECT user_id, place_id, distance_m, place_rank FROM (SELECT *, CAST(row_number() OVER
 (PARTITION BY user_id ORDER BY distance_m, place_id) AS INTEGER) AS place_rank FROM (SELECT user_id, place_id, {_HAV} AS distance_m FROM (
 SELECT *, sin(radians(slat-lat)/2)*sin(radians(slat-lat)/2)+cos(radians(lat))*cos(radians(slat))*sin(radians(slng-lng)/2)*sin(radians(slng-lng)/2) AS ha
 FROM ({_GLOBE.format(k='c_custkey', n='user_id', a='', t='customer')}), ({_GLOBE.format(k='s_suppkey', n='place_id', a='s', t='supplier')})))) WHERE place_rank<=3""")),
    "vendor_quotes": (vendor_quotes, S.dbl(f"""SELECT order_id, vendor_id, total_price, CAST({_UNIT} AS DOUBLE) AS unit_price, lead_days,
 lead_days=1 AS rush, qty IN (100,500) AS best_value, concat_ws(',',CASE WHEN qty>=100 THEN 'volume_rate' END,
 CASE WHEN vendor_id='classic' AND qty<=50 THEN 'same_day_pickup' END, CASE WHEN paper_id='250g-matte' THEN 'matte_lamination' END) AS notes
 FROM ({priced(S.PRINT_ORDERS)})""")),
    "paper_quotes": (paper_quotes, S.dbl(f"""SELECT order_id, vendor_id, paper_id, total_price, lead_days FROM ({priced(
        f"SELECT o.* EXCLUDE (paper_id), p.paper_id FROM ({S.PRINT_ORDERS}) o, {_NAMES} p", _FIRST_VENDOR)})""")),
    "quote_matrix": (quote_matrix, S.dbl(f"""SELECT vendor_id, preset_id, paper_id, qty, orders, total_price,
 orders*total_price AS turnover FROM ({priced(f"SELECT preset_id, paper_id, qty, count(*) AS orders FROM ({S.PRINT_ORDERS}) GROUP BY 1,2,3")})""")),
    "best_vendor": (best_vendor, S.dbl(_BEST)),
    "quote_ranking": (quote_ranking, S.dbl(f"""SELECT order_id, vendor_id, total_price, CAST(row_number() OVER (PARTITION BY order_id
 ORDER BY total_price, v_ord) AS INTEGER) AS price_rank FROM ({priced(S.PRINT_ORDERS)})""")),
    "dimension_turnover": (dimension_turnover, S.dbl(f"""SELECT preset_name, paper_name, weight_gsm, width_mm, height_mm,
 count(*) AS orders, CAST(sum(qty) AS BIGINT) AS pieces FROM ({S.with_preset(S.PRINT_ORDERS)}) JOIN {_NAMES} USING (paper_id) GROUP BY 1,2,3,4,5""")),
    "imposition_layouts": (imposition_layouts, S.dbl(f"SELECT {', '.join(LAYOUT)} FROM ({_layout_sql()})")),
    "imposition_cells": (imposition_cells, S.dbl(_cells_sql())),
    "nearest_shop": (nearest_shop, S.dbl(f"""SELECT user_id, shop_id, distance_m, {_DTEXT} AS distance_text FROM ({_RANKED}) WHERE shop_rank=1""")),
    "city_shops": (city_shops, S.dbl(f"""SELECT user_id, wanted, shop_id, distance_m, CAST(row_number() OVER (PARTITION BY user_id
 ORDER BY distance_m, s_ord) AS INTEGER) AS shop_rank FROM (SELECT *, {_WANTED} AS wanted FROM ({_DIST})) WHERE wanted='all' OR wanted=city""")),
    "shop_ranking": (shop_ranking, S.dbl(f"SELECT user_id, shop_id, distance_m, shop_rank FROM ({_RANKED})")),
    "shop_cards": (shop_cards, S.dbl(f"""SELECT user_id, shop_id, distance_m, first_services,
 'https://www.google.com/maps/dir/?api=1&destination='||slat||','||slng||'&destination_place_id='||replace(replace(url_encode(shop_name),'%28','('),'%29',')')
 AS link FROM ({_RANKED}) JOIN {_SERVICES} USING (shop_id) WHERE shop_rank=1""")),
    "order_files": (order_files, S.dbl(_FILES)),
    "order_tickets": (order_tickets, S.dbl(_ticket_sql())),
}
