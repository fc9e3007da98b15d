"""SQL surface: temporary SQL functions (inlined by the optimizer), one of them a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "mm_to_px(mm DOUBLE, dpi INT) RETURNS INT":
        "CASE WHEN mm <= 0 THEN 0 ELSE int(floor(mm / 25.4D * dpi + 0.5D)) END",
    "px_to_mm(px DOUBLE, dpi INT) RETURNS DOUBLE":
        "CASE WHEN dpi <= 0 THEN 0D ELSE px / dpi * 25.4D END",
    "js_round(v DOUBLE) RETURNS BIGINT": "floor(v + 0.5D)",
    "tac(r INT, g INT, b INT) RETURNS DOUBLE":
        "((1D - r / 255D) + (1D - g / 255D) + (1D - b / 255D) + least(1D - r / 255D, 1D - g / 255D, 1D - b / 255D)) * 100",
    "haversine_m(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) RETURNS BIGINT":
        "floor(12742000D * asin(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) "
        "* power(sin(radians(lng2 - lng1) / 2), 2))) + 0.5D)",
    "clean_token(word STRING) RETURNS STRING": "regexp_replace(lower(word), '[^a-z0-9]', '')",
    "match_case(original STRING, target STRING) RETURNS STRING":
        "CASE WHEN original = upper(original) THEN upper(target) "
        "WHEN left(original, 1) = upper(left(original, 1)) THEN concat(upper(left(target, 1)), lower(substr(target, 2))) "
        "ELSE lower(target) END",
}


GRID_CELLS = """CREATE OR REPLACE TEMPORARY FUNCTION grid_cells(cols INT, rows INT)
RETURNS TABLE (cell_index INT, cell_row INT, cell_col INT) RETURN
SELECT i, int(i div cols), i % cols FROM (SELECT explode(IF(cols * rows > 0, sequence(0, cols * rows - 1), array())) AS i)"""


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(GRID_CELLS)
    return [h.split("(")[0] for h in SQL_FUNCTIONS] + ["grid_cells"]
