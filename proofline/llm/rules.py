"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions.

The statistics of a text are computed inside its row: no rows are exploded and nothing is shuffled. Words are maximal
runs without white space. Learning uses the statistics of a bounded sample of labelled rows (``max_train``, smallest
hashes of the id), collected to the driver as at most that many rows of a few numbers. A rule is a conjunction of
thresholds that predicts "bad": it grows by information gain on two thirds of the sample, is pruned on the rest, and
covers its rows; rules are added while they are right often enough on the pruning rows. The list becomes a chain of
``when`` expressions, the first match decides, and everything else is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.fence import fenced

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios and counts that rules may test; all are doubles computed from the statistics.
FEATURES = {
    "mean_word": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "dup_lines_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words", "upper_share": "n_upper / word_chars", "digit_share": "n_digits / word_chars",
    "exclaim_per_word": "n_exclaim / n_words", "stop_share": "n_stops / n_words", "n_words": "n_words",
    "words_per_line": "n_words / n_lines",
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``BASE`` and n_lines, n_upper, n_digits, n_exclaim, n_stops (all bigint).

    A null or empty text has zeros. Existing columns of these names are replaced. n_repeat_words counts the words that
    lie in a three-word window found twice or more: windows are hashed and sorted within the row.
    """
    made = [*BASE, "n_lines", "n_upper", "n_digits", "n_exclaim", "n_stops"]
    # the text is the only input, so a passing column may have any name
    rest = [c for c in docs.columns if c not in made]
    clean = docs.select(F.struct(*rest).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed = F.btrim(F.col("_text"), F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    upper = F.length(F.regexp_replace("_text", "[^\\p{Lu}]+", "")).cast("bigint")
    step = fenced(clean.select("_row", "_text", F.transform(words, lambda w: F.xxhash64(w)).alias("_w"), lines.alias("_l")), ["_w", "_l"])
    n = F.size("_w")
    windows = F.zip_with(F.zip_with(F.col("_w"), F.slice("_w", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)),
                         F.slice("_w", 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    windows = F.transform(F.slice(windows, 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    step = step.select(
        "_row", n.cast("bigint").alias("n_words"),
        F.length(F.translate("_text", _SPACE, "")).cast("bigint").alias("word_chars"),
        _count_of(F.col("_text"), _SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), F.size("_l").cast("bigint").alias("n_lines"),
        upper.alias("n_upper"), _count_of(F.col("_text"), "0123456789").alias("n_digits"), _count_of(F.col("_text"), "!").alias("n_exclaim"),
        _count_of(F.col("_text"), ".?").alias("n_stops"), F.sort_array(windows).alias("_s"))
    step = fenced(step, ["_s"])
    nxt = F.concat(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), F.slice("_s", 1, 0))
    # a window is repeated if its neighbour in the sorted array has the same hash
    twice_next = F.zip_with("_s", nxt, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    step = fenced(step.withColumn("_e", twice_next), ["_e"])
    shifted = F.concat(F.array(F.lit(False)), F.col("_e"))
    twice = F.zip_with(F.col("_e"), F.slice(shifted, 1, F.greatest(F.size("_e"), F.lit(1))), lambda a, b: a | F.coalesce(b, F.lit(False)))
    at = F.zip_with("_s", twice, lambda s, t: F.when(t, s["p"]))
    step = fenced(step.withColumn("_p", F.sort_array(F.array_compact(at))), ["_p"])
    gaps = F.zip_with(F.col("_p"), F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeat = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    return step.select("_row.*", *[c for c in made if c != "n_repeat_words"], repeat.alias("n_repeat_words"))


def features(stats: DataFrame) -> DataFrame:
    """Adds the struct ``_f`` of rule features; a ratio over nothing is 0."""
    cols = []
    for name, expr in FEATURES.items():
        if " / " in expr:
            a, b = expr.split(" / ")
            cols.append(f"'{name}', coalesce(try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0D)")
        else:
            cols.append(f"'{name}', CAST({expr} AS DOUBLE)")
    return stats.withColumn("_f", F.expr("named_struct(" + ", ".join(cols) + ")"))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, value in rule:
        column = x[:, names.index(name)]
        hit &= column >= value if op == ">=" else column <= value
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int) -> Rule:
    """Adds the condition with the highest information gain until only bad rows are covered."""
    rule, hit = [], np.ones(len(x), bool)
    while len(rule) < most and (hit & ~bad).any():
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        best = (0.0, None)
        for j, name in enumerate(names):
            values, is_bad = x[hit, j], bad[hit]
            if not len(cuts[j]):
                continue
            for op in (">=", "<="):
                inside = values[:, None] >= cuts[j] if op == ">=" else values[:, None] <= cuts[j]
                pp = (inside & is_bad[:, None]).sum(axis=0)
                nn = inside.sum(axis=0) - pp
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - np.log2(p / (p + n))), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, op, float(cuts[j][k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = hit & _covers([best[1]], x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], most_rules: int = 12, most_conditions: int = 4,
          precision: float = 0.9, n_cuts: int = 64, seed: int = 5) -> list[Rule]:
    """Ordered rules for ``bad`` rows. Thresholds lie half-way between sample quantiles."""
    rng = np.random.default_rng(seed)
    grow = rng.random(len(x)) < 2 / 3
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules:
        g, v = left & grow, left & ~grow
        if (g & bad).sum() < 5:
            break
        cuts = []
        for j in range(x.shape[1]):
            values = np.unique(np.concatenate((np.quantile(x[g & bad, j], np.linspace(0, 1, n_cuts)), np.quantile(x[g, j], np.linspace(0, 1, n_cuts)))))
            cuts.append((values[1:] + values[:-1]) / 2)
        rule = _grow(x[g], bad[g], names, cuts, most_conditions)

        def worth(r: Rule) -> float:
            hit = _covers(r, x[v], names)
            p, n = (hit & bad[v]).sum(), (hit & ~bad[v]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and (shorter := max((rule[:i] for i in range(1, len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        hit = _covers(rule, x[v], names) if rule else np.zeros(v.sum(), bool)
        if not rule or not hit.sum() or (bad[v] & hit).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~_covers(rule, x, names)
    return rules


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 20_000, doc_id: str = "doc_id") -> list[Rule]:
    """Rules from labelled rows (label 0 is bad). At most ``max_train`` labelled rows reach the driver."""
    sample = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train))
    rows = features(statistics(stats.join(F.broadcast(sample), F.col(doc_id) == F.col("_id")))).select("_id", "_y", "_f.*").toPandas()
    rows = rows.sort_values(["_id", "_y"])
    names = list(FEATURES)
    if not len(rows):
        return []
    return learn(rows[names].to_numpy(float), rows["_y"].to_numpy() == 0, names)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that matches (from 1), 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, value in rule:
            column = F.col(f"_f.{name}")
            test = test & (column >= value if op == ">=" else column <= value)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the statistics of ``BASE``, base_failed, rule (number of the deciding rule or 0) and kept."""
    stats = features(statistics(docs, text))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = [c for c in stats.columns if c not in ("_f", "base_failed", "rule", "kept", "n_lines", "n_upper", "n_digits", "n_exclaim", "n_stops")]
    return stats.select(*rest, failed.alias("base_failed"), verdict(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
