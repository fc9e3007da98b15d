"""Quotes, imposition, nearest shops, order tickets.

Fixed dimensions (4 vendors, 5 papers, 13 shops) enter as literal structs, so
choosing the best of them is ``least`` over a handful of expressions: no
expansion, no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geo import format_distance, haversine_m
from ..functions.rounding import js_round, jr_int
from ..functions.units import mm_to_px
from ..sources import dims

BASE_UNIT = 8.5
MIN_TOTAL = 90


def volume_discount(qty: Column) -> Column:
    col = F.lit(1.0)
    for at_least, rate in reversed(dims.VOLUME_STEPS):
        col = F.when(qty >= at_least, F.lit(rate)).otherwise(col)
    return col


def size_rate(preset: Column) -> Column:
    col = F.lit(1.0)
    for pid, rate in dims.SIZE_RATES.items():
        col = F.when(preset == pid, F.lit(rate)).otherwise(col)
    return col


def paper_rate(paper: Column) -> Column:
    """Multiplier of the paper; an unknown paper counts as the first one."""
    col = F.lit(dims.PAPERS[0][3])
    for p in dims.PAPERS:
        col = F.when(paper == p[0], F.lit(p[3])).otherwise(col)
    return col


def lead_days(vendor_id: str, base: int, qty: Column) -> Column:
    return F.when(qty <= 50, F.lit(1)).otherwise(F.lit(2)) if vendor_id == "classic" else F.lit(base)


def quote_total(fee, curve, preset: Column, paper: Column, qty: Column) -> Column:
    unit = F.lit(BASE_UNIT) * size_rate(preset) * paper_rate(paper) * curve * volume_discount(qty)
    return F.greatest(F.lit(MIN_TOTAL), jr_int(fee + unit * qty))


def unit_price(total: Column, qty: Column) -> Column:
    """Half-up tenths; null for a quantity of zero."""
    return (F.floor(F.try_divide(total.cast("bigint") * 20 + qty, qty * 2)) / 10.0).cast("decimal(12,1)")


def quote(df: DataFrame) -> DataFrame:
    """Price and lead time for rows with ``vendor_id, preset_id, paper_id, qty``."""
    vendor = F.when(F.col("vendor_id").isin([v[0] for v in dims.VENDORS]), F.col("vendor_id")).otherwise(
        F.lit(dims.VENDORS[0][0]))
    df = df.withColumn("_v", vendor)
    fee, curve, lead = F.lit(0.0), F.lit(0.0), F.lit(0)
    for v in dims.VENDORS:
        hit = F.col("_v") == v[0]
        fee, curve = F.when(hit, F.lit(v[4])).otherwise(fee), F.when(hit, F.lit(v[5])).otherwise(curve)
        lead = F.when(hit, lead_days(v[0], v[3], F.col("qty"))).otherwise(lead)
    df = df.withColumns({"_fee": fee, "_curve": curve, "lead_days": lead})
    df = df.withColumn("total_price", quote_total(
        F.col("_fee"), F.col("_curve"), F.col("preset_id"), F.col("paper_id"), F.col("qty")))
    notes = F.array_compact(F.array(
        F.when(F.col("qty") >= 100, F.lit("volume_rate")),
        F.when((F.col("_v") == "classic") & (F.col("qty") <= 50), F.lit("same_day_pickup")),
        F.when(F.col("paper_id") == "250g-matte", F.lit("matte_lamination"))))
    return df.withColumns({
        "unit_price": unit_price(F.col("total_price"), F.col("qty")),
        "best_value": F.col("qty").isin(100, 500), "rush": F.col("lead_days") == 1, "notes": notes,
    }).withColumn("vendor_id", F.col("_v")).drop("_v", "_fee", "_curve")


def with_vendors(df: DataFrame) -> DataFrame:
    """Each row once per vendor (map-side expansion by four)."""
    ids = F.array(*[F.lit(v[0]) for v in dims.VENDORS])
    return df.select("*", F.explode(ids).alias("vendor_id"))


def with_papers(df: DataFrame) -> DataFrame:
    ids = F.array(*[F.lit(p[0]) for p in dims.PAPERS])
    return df.select("*", F.explode(ids).alias("paper_id"))


def best_vendors(df: DataFrame) -> DataFrame:
    """Cheapest and fastest vendor per order."""
    preset, paper, qty = F.col("preset_id"), F.col("paper_id"), F.col("qty")

    def cell(v, *lead_fields):
        total = quote_total(F.lit(v[4]), F.lit(v[5]), preset, paper, qty).alias("total")
        days = lead_days(v[0], v[3], qty).alias("days")
        first, second = (days, total) if lead_fields else (total, days)
        return F.struct(first, second, F.lit(v[-1]).alias("ordinal"), F.lit(v[0]).alias("vendor_id"))

    df = df.withColumns({"_cheap": F.least(*[cell(v) for v in dims.VENDORS]),
                         "_fast": F.least(*[cell(v, True) for v in dims.VENDORS])})
    return df.withColumns({
        "cheapest_vendor": F.col("_cheap.vendor_id"), "cheapest_total": F.col("_cheap.total"),
        "fastest_vendor": F.col("_fast.vendor_id"), "fastest_days": F.col("_fast.days"),
        "fastest_total": F.col("_fast.total")}).drop("_cheap", "_fast")


def rank_quotes(df: DataFrame) -> DataFrame:
    """All vendors of an order by price, ranked inside one sorted literal array."""
    preset, paper, qty = F.col("preset_id"), F.col("paper_id"), F.col("qty")
    cells = [F.struct(quote_total(F.lit(v[4]), F.lit(v[5]), preset, paper, qty).alias("total"),
                      F.lit(v[-1]).alias("ordinal"), F.lit(v[0]).alias("vendor_id")) for v in dims.VENDORS]
    out = df.select("*", F.posexplode(F.array_sort(F.array(*cells))).alias("_pos", "_q"))
    return out.withColumns({"vendor_id": F.col("_q.vendor_id"), "total_price": F.col("_q.total"),
                            "price_rank": F.col("_pos") + 1}).drop("_pos", "_q")


# Sheet sizes in mm, gap between cells, sheet margin, header strip in pixels.
SHEETS = {"A4": (210.0, 297.0), "A3": (297.0, 420.0)}
GAP_MM, MARGIN_MM, HEADER_PX = 3.0, 8.0, 70


def imposition_layout(df: DataFrame, item_w: str = "item_w", item_h: str = "item_h", sheet: str = "sheet") -> DataFrame:
    """Best grid of equal items on an A4 or A3 sheet; oversize items keep one cell."""
    a3 = F.col(sheet) == "A3"
    df = df.withColumns({"sheet_w": F.when(a3, SHEETS["A3"][0]).otherwise(SHEETS["A4"][0]),
                         "sheet_h": F.when(a3, SHEETS["A3"][1]).otherwise(SHEETS["A4"][1])})
    room_w = F.col("sheet_w") - 2 * MARGIN_MM
    room_h = F.col("sheet_h") - 2 * MARGIN_MM

    def fit(room: Column, item: Column) -> Column:
        return F.greatest(F.lit(1), F.floor((room + GAP_MM) / (item + GAP_MM)).cast("int"))

    w, h = F.col(item_w), F.col(item_h)
    df = df.withColumns({"_c0": fit(room_w, w), "_r0": fit(room_h, h), "_c1": fit(room_w, h), "_r1": fit(room_h, w)})
    df = df.withColumn("rotated", F.col("_c1") * F.col("_r1") > F.col("_c0") * F.col("_r0"))
    rot = F.col("rotated")
    df = df.withColumns({
        "cols": F.when(rot, F.col("_c1")).otherwise(F.col("_c0")),
        "rows": F.when(rot, F.col("_r1")).otherwise(F.col("_r0")),
        "cell_w": F.when(rot, h).otherwise(w), "cell_h": F.when(rot, w).otherwise(h)})
    df = df.withColumn("cells", F.col("cols") * F.col("rows"))
    save = F.least(F.lit(85), jr_int((F.col("cells") - 1) / F.col("cells") * 100))
    return df.withColumns({
        "savings_pct": F.when(F.col("cells") > 1, save).otherwise(F.lit(0)),
        "fits": (F.col("cell_w") <= room_w) & (F.col("cell_h") <= room_h),
        "sheet_w_px": mm_to_px(F.col("sheet_w"), F.lit(300)), "sheet_h_px": mm_to_px(F.col("sheet_h"), F.lit(300)),
        "cell_w_px": mm_to_px(F.col("cell_w"), F.lit(300)), "cell_h_px": mm_to_px(F.col("cell_h"), F.lit(300)),
    }).drop("_c0", "_r0", "_c1", "_r1")


def imposition_cells(layout: DataFrame, items: Column | None = None) -> DataFrame:
    """One row per placed cell with its pixel origin; sources repeat in turn."""
    px = 300 / 25.4
    df = layout.withColumns({"_w": F.col("cell_w") * px, "_h": F.col("cell_h") * px})
    gap = GAP_MM * px
    grid_w = F.col("cols") * F.col("_w") + (F.col("cols") - 1) * gap
    grid_h = F.col("rows") * F.col("_h") + (F.col("rows") - 1) * gap
    df = df.withColumns({"_x0": (F.col("sheet_w_px") - grid_w) / 2,
                         "_y0": (F.col("sheet_h_px") - HEADER_PX - grid_h) / 2 + HEADER_PX,
                         "cell_index": F.explode(F.sequence(F.lit(0), F.col("cells") - 1))})
    df = df.withColumns({"cell_row": F.floor(F.col("cell_index") / F.col("cols")).cast("int"),
                         "cell_col": (F.col("cell_index") % F.col("cols")).cast("int")})
    source = F.lit(0) if items is None else (F.col("cell_index") % items).cast("int")
    return df.withColumns({
        "cell_x": F.col("_x0") + F.col("cell_col") * (F.col("_w") + gap),
        "cell_y": F.col("_y0") + F.col("cell_row") * (F.col("_h") + gap),
        "source_index": source}).drop("_w", "_h", "_x0", "_y0")


def _shop_cells(city: Column | None) -> list[Column]:
    cells = []
    for s in dims.SHOPS:
        dist = haversine_m(F.col("lat"), F.col("lng"), F.lit(s[7]), F.lit(s[8]))
        cell = F.struct(dist.alias("metres"), F.lit(s[-1]).alias("ordinal"), F.lit(s[0]).alias("shop_id"))
        cells.append(cell if city is None else F.when((city == "all") | (city == s[2]), cell))
    return cells


def nearest_shop(users: DataFrame, city: Column | None = None) -> DataFrame:
    """Closest shop per user (optionally inside one city, ``'all'`` is a wildcard)."""
    df = users.withColumn("_best", F.least(*_shop_cells(city)))
    return df.withColumns({"shop_id": F.col("_best.shop_id"), "distance_m": F.col("_best.metres"),
                           "distance_text": format_distance(F.col("_best.metres"))}).drop("_best")


def rank_shops(users: DataFrame, city: Column | None = None) -> DataFrame:
    """Every shop by distance per user; sorted inside the row, so nothing is shuffled."""
    cells = F.array_sort(F.array_compact(F.array(*_shop_cells(city))))
    out = users.select("*", F.posexplode(cells).alias("_pos", "_s"))
    return out.withColumns({"shop_id": F.col("_s.shop_id"), "distance_m": F.col("_s.metres"),
                            "shop_rank": F.col("_pos") + 1}).drop("_pos", "_s")


def city_matches(city: Column, wanted: Column) -> Column:
    return (wanted == "all") | (city == wanted)


def order_file_name(art: Column, shop: Column, preset_name: Column, paper_name: Column, qty: Column) -> Column:
    """``[shop]_art_preset_paper_qty張_正面.pdf`` with a sanitised artwork name."""
    clean = tx.safe_file_part(F.when(F.coalesce(art, F.lit("")) == "", F.lit("Artwork")).otherwise(art))
    return F.concat(F.lit("["), shop, F.lit("]_"), clean, F.lit("_"), tx.first_word(preset_name), F.lit("_"),
                    tx.first_word(paper_name), F.lit("_"), qty.cast("string"), F.lit("張_正面.pdf"))


def order_ticket(df: DataFrame) -> DataFrame:
    """Plain-text ticket with measured verdicts and a content digest.

    Needs ``order_id, vendor_id, preset_id, paper_id, qty, total_price,
    unit_price, lead_days, width_mm, height_mm, bleed_mm, current_dpi, max_tac,
    score``.
    """
    total_w = F.col("width_mm") + F.col("bleed_mm") * 2
    total_h = F.col("height_mm") + F.col("bleed_mm") * 2

    def verdict(ok: Column) -> Column:
        return F.when(ok, "pass").otherwise("fail")

    lines = [
        F.format_string("order %d at %s", F.col("order_id"), F.col("vendor_id")),
        F.format_string("item %s on %s, %d pcs", F.col("preset_id"), F.col("paper_id"), F.col("qty")),
        F.format_string("trim %.1f x %.1f mm, with bleed %.1f x %.1f mm",
                        F.col("width_mm"), F.col("height_mm"), total_w, total_h),
        F.format_string("total %d, unit %s, lead %d days", F.col("total_price"),
                        F.col("unit_price").cast("string"), F.col("lead_days")),
        F.format_string("resolution %d dpi: %s", F.col("current_dpi"), verdict(F.col("current_dpi") >= 280)),
        F.format_string("ink %d %%: %s", F.col("max_tac"), verdict(F.col("max_tac") <= 300)),
        F.format_string("score %d of 100", F.col("score")),
    ]
    df = df.withColumn("ticket", F.concat_ws("\n", *lines))
    return df.withColumn("ticket_sha256", F.sha2(F.col("ticket"), 256))
