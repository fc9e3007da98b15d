"""Seven-factor readiness score, issue codes, and before/after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import stage
from .fence import fenced
from .sizing import DIGITAL_SQL, DPI_COLUMNS, analyze_dpi

FACTORS = ["resolution", "aspect", "brightness", "saturation", "contrast", "sharpness", "ink_safety"]
WEIGHTS = {"resolution": 0.35, "aspect": 0.15, "brightness": 0.10, "saturation": 0.10, "contrast": 0.10,
           "sharpness": 0.10, "ink_safety": 0.10}


def _floored(low: int, share: str) -> str:
    """Share in percent, rounded, but never under ``low``."""
    return f"greatest({low}, floor({share} * 100 + 0.5D))"


# Sub-score formulas over the columns of the row; every one yields 0..100.
FORMULAS = {
    "resolution": """CASE WHEN _dig THEN CASE WHEN _short >= 1080 THEN 100D
        WHEN _short >= 720 THEN (_short - 720) / 360D * 15 + 85
        ELSE greatest(30D, floor(_short / 720D * 85 + 0.5D)) END
      WHEN current_dpi >= 280 THEN 100D WHEN current_dpi >= 200 THEN (current_dpi - 200) / 80D * 15 + 85
      WHEN current_dpi >= 140 THEN (current_dpi - 140) / 60D * 25 + 60
      ELSE greatest(20D, current_dpi / 140D * 60) END""",
    "aspect": f"""CASE WHEN _dig THEN 100 WHEN _gap > 1.8D THEN 75
      WHEN _opt > 0.15D THEN {_floored(75, '(1D - _opt * 0.5D)')} ELSE 100 END""",
    "brightness": f"""CASE WHEN avg_lum < 0.04D THEN 75 WHEN avg_lum < 0.16D THEN {_floored(70, 'avg_lum / 0.16D')}
      WHEN avg_lum > 0.92D THEN {_floored(60, '(1D - avg_lum) / 0.08D')} ELSE 100 END""",
    "saturation": """CASE WHEN _oog > 0.12D THEN greatest(78D, 100D - _oog * 160)
      WHEN avg_sat > 0.82D AND _oog <= 0.02D THEN 92D WHEN avg_sat > 0.82D THEN 88D ELSE 100D END""",
    "contrast": f"CASE WHEN std_lum < 0.05D THEN {_floored(70, 'std_lum / 0.05D')} ELSE 100 END",
    "sharpness": f"CASE WHEN edge_score < 0.03D THEN {_floored(55, 'edge_score / 0.03D')} ELSE 100 END",
    "ink_safety": """CASE WHEN _over AND max_tac > 340 THEN greatest(60, 100 - (max_tac - 300))
      WHEN _over THEN 90 ELSE 100 END""",
}


# Intermediate terms shared by the sub-scores and the issue codes.
TERMS = {
    "_dig": DIGITAL_SQL, "_short": "least(width_px, height_px)", "_oog": "coalesce(oog_ratio, 0D)",
    "_a": "try_divide(double(width_px), height_px)", "_over": "coalesce(has_overflow, false) AND NOT _dig",
    "_t": "CASE WHEN NOT _dig THEN width_mm / height_mm END",
    "_f": "CASE WHEN NOT _dig THEN height_mm / width_mm END",
    "_dn": "try_divide(abs(_a - _t), greatest(_a, _t))",
    "_df": "CASE WHEN _f IS NOT NULL THEN try_divide(abs(_a - _f), greatest(_a, _f)) END",
    "_ai": "greatest(_a, try_divide(1D, _a))", "_ti": "greatest(_t, 1D / _t)",
    "_gap": "try_divide(greatest(_ai, _ti), least(_ai, _ti))", "_opt": "least(_dn, _df)",
}


def score_readiness(df: DataFrame, issues: bool = False) -> DataFrame:
    """Adds the seven sub-scores, ``score`` and ``level``.

    Needs DPI columns (:func:`analyze_dpi`), ``avg_lum, avg_sat, std_lum,
    edge_score``, ``oog_ratio`` (may be null) and ``max_tac, has_overflow`` (may
    be null). An image without a size has neither score nor level. Everything is
    a projection: no shuffle, no Python.
    """
    df = stage(df, **TERMS, **{f"s_{n}": f"int(floor({FORMULAS[n]} + 0.5D))" for n in FACTORS})
    df = fenced(df if issues else df.drop(*TERMS), [f"s_{n}" for n in FACTORS])
    total = " + ".join(f"s_{n} * {WEIGHTS[n]!r}D" for n in FACTORS)
    df = stage(df, score=f"CASE WHEN width_px > 0 AND height_px > 0 AND {total} IS NOT NULL THEN greatest(0, least(100, int(floor({total} + 0.5D)))) END",
               level="CASE WHEN score IS NULL THEN NULL WHEN score >= 88 THEN 'high' WHEN score >= 75 THEN 'mid' ELSE 'low' END")
    return _with_codes(df).drop(*TERMS) if issues else df


# Code and condition of each issue and of each piece of advice.
ISSUES = {
    "screen_small": "_dig AND _short < 720",
    "dpi_basic": "NOT _dig AND current_dpi >= 200 AND current_dpi < 280",
    "dpi_low": "NOT _dig AND current_dpi >= 140 AND current_dpi < 200",
    "dpi_critical": "NOT _dig AND current_dpi < 140",
    "aspect_wide": "_gap > 1.8D AND _a > 2",
    "aspect_tall": "_gap > 1.8D AND _a < 0.5D",
    "aspect_extreme": "_gap > 1.8D AND _a >= 0.5D AND _a <= 2",
    "aspect_crop": "_gap <= 1.8D AND _opt > 0.15D",
    "very_dark": "avg_lum < 0.04D",
    "dark": "avg_lum >= 0.04D AND avg_lum < 0.16D",
    "very_bright": "avg_lum > 0.92D",
    "out_of_gamut": "_oog > 0.12D",
    "over_saturated": "_oog <= 0.12D AND _oog > 0.02D AND avg_sat > 0.82D",
    "flat_contrast": "std_lum < 0.05D",
    "soft_edges": "edge_score < 0.03D",
    "ink_heavy": "_over AND max_tac > 340",
    "ink_trace": "_over AND max_tac <= 340",
}
ADVICE = {
    "upscale": "NOT _dig AND current_dpi < 200",
    "auto_rotate": "_df < _dn AND _dn > 0.15D",
    "use_landscape": "_gap > 1.8D AND _a > 2",
    "use_postcard": "_gap > 1.8D AND _a < 0.5D",
    "align_subject": "_gap <= 1.8D AND _opt > 0.15D",
    "coated_paper": "avg_lum < 0.04D",
    "shadow_lift": "avg_lum >= 0.04D AND avg_lum < 0.16D",
    "soft_proof": "_oog > 0.12D OR (_oog > 0.02D AND avg_sat > 0.82D)",
    "quality_ink": "_oog <= 0.02D AND avg_sat > 0.82D",
    "sharpen": "edge_score < 0.03D",
    "limit_ink": "_over AND max_tac > 340",
}


def _with_codes(df: DataFrame) -> DataFrame:
    """Code lists; the aspect rules need a physical preset."""
    def codes(rules: dict[str, str]) -> str:
        cells = []
        for code, cond in rules.items():
            physical = any(term in cond for term in ("_gap", "_dn"))
            cells.append(f"CASE WHEN {'NOT _dig AND ' if physical else ''}{cond} THEN '{code}' END")
        return f"array_compact(array({', '.join(cells)}))"

    return stage(df, issues=codes(ISSUES), recommendations=codes(ADVICE))


def badge(score: Column) -> Column:
    return F.when(score >= 88, "success").when(score >= 70, "warning").otherwise("danger")


def colour_band(score: Column) -> Column:
    return F.when(score >= 85, "green").when(score >= 65, "amber").otherwise("red")


# Pass thresholds of the four overview tiles.
TILE_PASS = {"resolution": 90, "aspect": 90, "ink_safety": 80, "saturation": 90}


def tile_passes() -> dict[str, Column]:
    return {f"pass_{n}": F.col(f"s_{n}") >= t for n, t in TILE_PASS.items()}


def action_list() -> Column:
    """Codes of the automatic steps an optimised image went through."""
    return F.array_compact(F.array(
        F.when(F.col("scale_factor") > 1, F.concat(F.lit("upscale_x"), F.col("scale_factor").cast("string"))),
        F.lit("sharpen"), F.lit("limit_ink"), F.lit("bleed_box")))


def simulate_optimised(df: DataFrame) -> DataFrame:
    """Statistics after the standard optimisation, ready to be scored again.

    Applies the recommended factor to the size, lifts the edge score by half up
    to 0.08 and clamps the ink to the 300 % limit; DPI columns are recomputed.
    """
    changed = {"width_px": "width_px * applied_scale", "height_px": "height_px * applied_scale",
               "edge_score": "least(0.08D, edge_score * 1.5D)", "max_tac": "least(300, max_tac)",
               "has_overflow": "false"}
    out = df.withColumn("applied_scale", F.expr("IF(needs_upscale, scale_factor, 1)")).drop(*DPI_COLUMNS)
    return analyze_dpi(out.withColumns({n: F.expr(e) for n, e in changed.items()}))


def before_after(df: DataFrame) -> DataFrame:
    """Scores each row before and after :func:`simulate_optimised` in one pass.

    Both sides stem from the same row, so the comparison is a projection and the
    self-join on the image id disappears.
    """
    factors = [f"s_{n}" for n in FACTORS]
    pre = score_readiness(df).withColumnsRenamed({"score": "pre_score", "level": "pre_level"}).drop(*factors)
    pre = pre.withColumn("pre_dpi", F.col("current_dpi"))
    post = score_readiness(simulate_optimised(pre))
    post = post.withColumnsRenamed({"score": "post_score", "level": "post_level", "current_dpi": "post_dpi"})
    post = stage(post.drop(*factors, *DPI_COLUMNS, "width_px", "height_px", "edge_score", "max_tac", "has_overflow"),
                 score_delta="post_score - pre_score", regressed="score_delta < 0")
    return fenced(post, ["post_score", "score_delta", "regressed"])
