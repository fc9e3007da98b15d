"""Reference dimensions: presets, vendors, papers, shops, products, profiles, plans, words.

Every list is a fixed set of values (at most 118 rows), so each dimension has a
proven size bound and may be broadcast or written into a plan as literals.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Print presets (sizes in mm; zero means screen only).
PRESET_SCHEMA = ("preset_id string, preset_name string, width_mm double, height_mm double, target_dpi int, "
                 "bleed_mm double, safe_margin_mm double, color_mode string, paper string, "
                 "crop_marks boolean, color_bars boolean, registration_marks boolean, ordinal int")
PRESETS = [
    ("poster-a4", "A4 經典海報", 210.0, 297.0, 300, 3.0, 5.0, "cmyk", "glossy", True, True, True, 0),
    ("poster-a3", "A3 大圖展示海報", 297.0, 420.0, 300, 3.0, 8.0, "cmyk", "matte", True, True, True, 1),
    ("postcard", "藝術紀念明信片", 148.0, 100.0, 300, 2.0, 4.0, "cmyk", "cotton", True, True, False, 2),
    ("business-card", "專業商業名片", 90.0, 54.0, 350, 1.5, 3.0, "cmyk", "linen", True, False, False, 3),
    ("sticker", "精緻模切貼紙", 50.0, 50.0, 350, 2.0, 3.0, "cmyk", "glossy", True, False, False, 4),
    ("social", "社群高畫質發布", 0.0, 0.0, 72, 0.0, 0.0, "rgb", "glossy", False, False, False, 5),
]
DEFAULT_PRESET = "poster-a4"

# Vendors with set-up fee, unit curve and base lead time.
VENDOR_SCHEMA = ("vendor_id string, vendor_name string, short_name string, lead_base_days int, "
                 "startup_fee double, unit_curve double, features array<string>, ordinal int")
VENDORS = [
    ("gainhow", "健豪印刷 (Gainhow)", "健豪", 2, 70.0, 0.9,
     ["線上直接拋單傳檔", "全台門市自取免運", "支援大批次合版輪轉"], 0),
    ("cardhome", "卡之屋 (CardHome)", "卡之屋", 2, 90.0, 1.0,
     ["特殊紙材在庫豐富", "線上自動檢檔系統", "色彩管理嚴格"], 1),
    ("classic", "經典數位印刷 (Classic Print)", "經典數位", 1, 120.0, 1.2,
     ["最快當日/1小時急件", "現場門市即時對色打樣", "少量10張起印友善"], 2),
    ("lange", "藍格印刷 (Lange)", "藍格", 3, 60.0, 0.85,
     ["超低起印門檻", "標準合版高性價比", "大台北固定配送點"], 3),
]

# Papers with price multiplier.
PAPER_SCHEMA = "paper_id string, paper_name string, weight_gsm int, paper_rate double, ordinal int"
PAPERS = [
    ("250g-matte", "250P 頂級雙面霧膜", 250, 1.15, 0),
    ("150g-art", "150P 經濟亮面銅版紙", 150, 1.0, 1),
    ("300g-ivory", "300P 頂級厚磅象牙卡", 300, 1.25, 2),
    ("220g-linen", "220P 日本萊妮紙", 220, 1.35, 3),
    ("sticker-gloss", "特黏亮膜模切貼紙", 90, 1.4, 4),
]

# Quantity tiers, size multipliers, volume discount steps.
QTY_TIERS = [10, 20, 50, 100, 200, 500, 1000]
SIZE_RATES = {"poster-a4": 1.0, "poster-a3": 1.85, "postcard": 0.55, "business-card": 0.35,
              "sticker": 0.45, "social": 1.0}
VOLUME_STEPS = [(1000, 0.25), (500, 0.35), (200, 0.5), (100, 0.65), (50, 0.8), (20, 0.92)]

# Shops.
SHOP_SCHEMA = ("shop_id string, shop_name string, city string, district string, address string, phone string, "
               "hours string, lat double, lng double, services array<string>, ordinal int")
SHOPS = [
    ("tp-gainhow-1", "健豪印刷 (台北忠孝門市)", "台北市", "中正區", "台北市中正區忠孝西路一段66號",
     "02-2388-7788", "週一至週五 09:00-21:00", 25.0465, 121.5152,
     ["合版印刷", "獨立版印刷", "A4/A3海報", "名片/卡片", "數位打樣", "UV局部上光"], 0),
    ("tp-classic-1", "經典數位印刷 (站前旗艦店)", "台北市", "中正區", "台北市中正區重慶南路一段75號",
     "02-2382-6000", "週一至週六 09:00-22:00", 25.0441, 121.5135,
     ["急件快速直出", "大圖海報輸出", "藝術微噴", "膠裝/精裝", "350P象牙棉卡"], 1),
    ("tp-cardhome-1", "卡之屋網路印刷 (台北總公司)", "台北市", "中山區", "台北市中山區民生東路二段143號",
     "02-2508-3333", "週一至週五 08:30-18:30", 25.0583, 121.5332,
     ["專業名片印刷", "明信片/酷卡", "貼紙模切", "DM傳單", "特殊紙材"], 2),
    ("tp-qianye-1", "千業快速印刷 (同人誌/藝術專門)", "台北市", "中正區", "台北市中正區開封街一段2號3樓",
     "02-2381-1234", "週一至週五 09:00-19:00", 25.0461, 121.5159,
     ["藝術畫冊", "同人誌印刷", "特殊燙金", "日本萊妮/棉紙", "明信片套組"], 3),
    ("tp-jetprint-1", "捷可印 (台北松江門市)", "台北市", "中山區", "台北市中山區松江路101號",
     "02-2507-6888", "週一至週五 09:00-20:00", 25.0512, 121.5331,
     ["商業型錄", "無摺痕海報", "展場易拉寶", "精裝硬殼本", "紙袋包裝"], 4),
    ("ntp-gainhow-1", "健豪印刷 (新北板橋門市)", "新北市", "板橋區", "新北市板橋區文化路一段188號",
     "02-2250-8899", "週一至週五 09:00-21:00", 25.0182, 121.4682,
     ["合版印刷", "A4/A3海報", "展覽大圖", "各式貼紙", "商業手冊"], 5),
    ("ntp-lange-1", "藍格印刷 (中和門市)", "新北市", "中和區", "新北市中和區中山路二段350號",
     "02-2240-5588", "週一至週五 08:30-18:00", 25.0035, 121.4988,
     ["合版名片", "DM海報", "貼紙標籤", "桌曆/掛曆", "紙箱包裝"], 6),
    ("tc-gainhow-hq", "健豪印刷 (台中全球營運總部)", "台中市", "南屯區", "台中市南屯區工業區二十四路26號",
     "04-2359-5959", "24小時自動化生產 / 門市 08:00-22:00", 24.1592, 120.6031,
     ["全系列印刷", "工業級Indigo數位印刷", "八色高速輪轉機", "包裝彩盒", "精品裝訂"], 7),
    ("tc-classic-1", "經典數位印刷 (台中中港店)", "台中市", "西區", "台中市西區台灣大道二段300號",
     "04-2326-8000", "週一至週六 09:00-21:30", 24.1528, 120.6658,
     ["急件快速輸出", "展覽大圖", "明信片", "精裝書冊", "建築圖面"], 8),
    ("kh-gainhow-1", "健豪印刷 (高雄七賢門市)", "高雄市", "新興區", "高雄市新興區七賢一路120號",
     "07-236-8899", "週一至週五 09:00-21:00", 22.6322, 120.3095,
     ["合版印刷", "商業型錄", "海報/名片", "手提紙袋", "大圖輸出"], 9),
    ("kh-hongguo-1", "宏國數位印刷 (高雄總店)", "高雄市", "三民區", "高雄市三民區建國二路180號",
     "07-235-6677", "週一至週五 09:00-20:00", 22.6385, 120.3045,
     ["數位急件印刷", "海報打樣", "畫冊裝訂", "貼紙/名片", "展示板"], 10),
    ("tn-times-1", "時代數位印刷 (台南成功店)", "台南市", "北區", "台南市北區成功路200號",
     "06-228-5566", "週一至週五 09:00-20:00", 22.9998, 120.2052,
     ["商業海報", "名片酷卡", "精裝手冊", "特殊標籤", "展場立牌"], 11),
    ("hc-jetprint-1", "捷可印 (新竹光復店)", "新竹市", "東區", "新竹市東區光復路二段100號",
     "03-571-8899", "週一至週五 09:00-19:30", 24.7965, 120.9982,
     ["科技業商業型錄", "研討會海報", "無摺痕展布", "工程手冊", "名片"], 12),
]

# Convenience-store products (size in mm and in 300-DPI pixels).
PRODUCT_SCHEMA = ("product_id string, store string, width_mm double, height_mm double, width_px300 int, "
                  "height_px300 int, price int, margin_mm double, ordinal int")
PRODUCTS = [
    ("711-photo-4x6", "7-11", 100.0, 148.0, 1181, 1748, 6, 2.0, 0),
    ("711-a4-special", "7-11", 210.0, 297.0, 2480, 3508, 15, 4.0, 1),
    ("711-a4-normal", "7-11", 210.0, 297.0, 2480, 3508, 10, 5.0, 2),
    ("fami-sticker-4x6", "familymart", 100.0, 148.0, 1181, 1748, 20, 2.0, 3),
    ("fami-photo-4x6", "familymart", 100.0, 148.0, 1181, 1748, 6, 2.0, 4),
    ("fami-a4-special", "familymart", 210.0, 297.0, 2480, 3508, 15, 4.0, 5),
]

# Colour profiles of both lists; the two lists disagree and are
# told apart by ``source``.
PROFILE_SCHEMA = ("source string, profile_id string, profile_name string, max_tac int, dot_gain int, "
                  "cmyk_matrix struct<c:array<double>,m:array<double>,y:array<double>,k:array<double>>, ordinal int")
PROFILES = [
    ("client", "japan-color-2001-coated", "Japan Color 2001 Coated", 350, 14, None, 0),
    ("client", "iso-coated-v2-fogra39", "ISO Coated v2 (ECI) / FOGRA39", 300, 13, None, 1),
    ("client", "gracol-2006-coated", "GRACoL 2006 Coated1v2", 320, 15, None, 2),
    ("client", "japan-color-2001-uncoated", "Japan Color 2001 Uncoated", 260, 22, None, 3),
    ("server", "japan-color-2001", "Japan Color 2001 Coated", 350, None,
     ([0.98, 0.02, 0.01, 0.0], [0.01, 0.96, 0.03, 0.0], [0.0, 0.02, 0.97, 0.0], [0.02, 0.03, 0.02, 0.98]), 4),
    ("server", "fogra-39", "FOGRA39 (ISO Coated v2)", 330, None,
     ([0.97, 0.03, 0.01, 0.0], [0.02, 0.95, 0.04, 0.0], [0.01, 0.03, 0.96, 0.0], [0.03, 0.03, 0.02, 0.97]), 5),
    ("server", "us-swop-v2", "U.S. Web Coated (SWOP) v2", 300, None,
     ([0.96, 0.04, 0.02, 0.0], [0.03, 0.94, 0.05, 0.0], [0.01, 0.04, 0.95, 0.0], [0.04, 0.04, 0.03, 0.96]), 6),
    ("server", "pso-coated-v3", "PSO Coated v3 (FOGRA51)", 300, None,
     ([0.99, 0.02, 0.01, 0.0], [0.01, 0.97, 0.03, 0.0], [0.0, 0.01, 0.98, 0.0], [0.02, 0.02, 0.01, 0.99]), 7),
]

# Plans with price, batch cap, monthly quota and feature gates.
PLAN_FEATURES = ["doubleSided", "dieline", "imposition", "pdfx", "vipAi", "bleedExpander", "aiMatting",
                 "aiVectorizer", "pipelineCustomizer", "batch"]
PLAN_SCHEMA = ("plan_id string, price_monthly int, max_batch int, monthly_quota int, gates map<string,boolean>, "
               "ordinal int")
PLANS = [
    ("free", 0, 1, 0,
     {"doubleSided": False, "dieline": False, "imposition": False, "pdfx": False, "vipAi": False, "bleedExpander":
     False, "aiMatting": False, "aiVectorizer": False, "pipelineCustomizer": False, "batch": False}, 0),
    ("pro", 399, 20, 500,
     {"doubleSided": True, "dieline": True, "imposition": True, "pdfx": True, "vipAi": False, "bleedExpander":
     False, "aiMatting": True, "aiVectorizer": False, "pipelineCustomizer": True, "batch": True}, 1),
    ("vip", 699, 100, 1000,
     {"doubleSided": True, "dieline": True, "imposition": True, "pdfx": True, "vipAi": True, "bleedExpander": True,
     "aiMatting": True, "aiVectorizer": True, "pipelineCustomizer": True, "batch": True}, 2),
]

# Built-in vocabulary, in lookup order.
VOCABULARY = [
    "coffee", "cafe", "espresso", "latte", "cappuccino", "special", "edition", "exhibition", "summer", "sale",
    "premium", "cyberpunk", "tokyo", "design", "limited", "studio", "print", "creative", "art", "collection",
    "autumn", "winter", "spring", "fashion", "music", "festival", "grand", "opening", "classic", "vintage",
    "delicious", "fresh", "menu", "happy", "birthday", "congratulations", "typography", "poster", "gallery",
    "modern", "future", "night", "neon", "city", "magic", "quality", "nature", "organic", "handcraft", "vector",
    "artisan", "original", "authentic", "official", "welcome", "discount", "super", "mega", "flash", "world",
    "dream", "space", "cosmic", "universe", "retro", "glitch", "synthwave", "anime", "manga", "club", "party",
    "lounge", "restaurant", "bakery", "tea", "matcha", "dessert", "sweet", "best", "choice", "number", "one",
    "exclusive", "style", "boutique", "brand", "logo", "market", "store", "shop", "travel", "guide",
    "adventure", "explore", "holiday", "vacation", "peace", "love", "hope", "life", "story", "memory", "golden",
    "silver", "black", "white", "sunset", "sunrise", "star", "moon", "ocean", "forest", "flower", "bloom",
    "garden", "green", "clean", "pure",
]

# Known misspellings.
TYPOS = {
    "cofee": "coffee", "coffe": "coffee", "welcom": "welcome", "welcomee": "welcome", "spcial": "special",
    "specal": "special", "exhibtion": "exhibition", "exibition": "exhibition", "exhibishon": "exhibition",
    "desing": "design", "disign": "design", "summmer": "summer", "festval": "festival", "festivl": "festival",
    "premum": "premium", "primium": "premium", "limitd": "limited", "limted": "limited", "creativ": "creative",
    "creativve": "creative", "edtion": "edition", "clasic": "classic", "cllasic": "classic", "vintag": "vintage",
    "fashon": "fashion", "galery": "gallery", "orginal": "original", "origanal": "original",
    "typogrphy": "typography", "cybrpunk": "cyberpunk", "neonn": "neon", "tokiyo": "tokyo",
}

_TABLES = {
    "presets": (PRESETS, PRESET_SCHEMA),
    "vendors": (VENDORS, VENDOR_SCHEMA),
    "papers": (PAPERS, PAPER_SCHEMA),
    "shops": (SHOPS, SHOP_SCHEMA),
    "products": (PRODUCTS, PRODUCT_SCHEMA),
    "profiles": (PROFILES, PROFILE_SCHEMA),
    "plans": (PLANS, PLAN_SCHEMA),
    "qty_tiers": ([(q, i) for i, q in enumerate(QTY_TIERS)], "qty int, ordinal int"),
    "vocab": ([(w, i) for i, w in enumerate(VOCABULARY)], "word string, ordinal int"),
    "typos": (list(TYPOS.items()), "bad string, good string"),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    """One reference dimension by name (an in-plan local relation)."""
    return local_table(spark, *_TABLES[name])


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Small fixed rows handed over as one Arrow table, planned as LocalTableScan."""
    schema = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)
    cols = [pa.array([_arrow_value(r[i], f.dataType) for r in rows], type=arrow.field(i).type)
            for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(cols, schema=arrow), schema)


def _arrow_value(v, dtype):
    if v is not None and isinstance(dtype, T.StructType):
        return dict(zip(dtype.names, v))
    if v is not None and isinstance(dtype, T.MapType):
        return list(v.items())
    return v


def names() -> list[str]:
    return list(_TABLES)


def key_position(name: str) -> int:
    return 1 if name == "profiles" else 0


def keys(name: str) -> list:
    return [r[key_position(name)] for r in _TABLES[name][0]]
