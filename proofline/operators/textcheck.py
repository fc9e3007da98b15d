"""Spelling and gibberish checks over whole texts.

Texts become one row per word; every rule that depends only on the cleaned word
is evaluated once per distinct word. Vocabulary and misspelling lists may have
any size: the planner broadcasts what is small and splits frequent words where it
is not; keys for fuzzy matching are broadcast after a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stage, task_parallelism
from ..sources import dims
from .fence import fenced

BROADCAST_KEYS = 1_000_000


def split_words(texts: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """``(ids, pos, word)`` for every word as it is written."""
    return texts.select(*id_cols, F.posexplode(tx.tokens(F.col(text))).alias("pos", "word"))


def _cleaned(words: DataFrame) -> DataFrame:
    # fenced, so that length filters do not repeat the cleaning expression
    cleaned = fenced(words.withColumn("clean", tx.clean_token(F.col("word"))), ["clean"])
    return cleaned.filter(F.length("clean") >= 2)


def tokenize(texts: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """``(ids, pos, word, clean)`` for every word whose cleaned form has two characters or more."""
    return _cleaned(split_words(texts, id_cols, text))


def spellings(words: DataFrame) -> DataFrame:
    """``(word, n, clean)`` per distinct way a word is written: cleaned once, however often it occurs."""
    return _cleaned(words.groupBy("word").agg(F.count("*").alias("n")))


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("clean").agg(F.count("*").alias("n"))


def ranked_words(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent words of four characters or more, ties by word."""
    top = counts.filter(F.length("clean") >= 4).orderBy(F.desc("n"), F.asc("clean")).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("clean")))
    return top.select("clean", (rank - 1).alias("rank"))


def corpus_vocabulary(counts: DataFrame, limit: int) -> DataFrame:
    """Built-in words first, then the corpus words not among them.

    The ``limit`` most frequent words are taken, as the caller asks; the checks
    below take a vocabulary of any size.
    """
    builtin = dims.table(counts.sparkSession, "vocab")
    base = len(dims.VOCABULARY)
    top = ranked_words(counts, limit).filter(~F.col("clean").isin(dims.VOCABULARY))
    return builtin.unionByName(top.select(F.col("clean").alias("word"), (F.col("rank") + base).alias("ordinal")))


def frequent_words(counts: DataFrame, one_in: int) -> DataFrame:
    """``clean, n, rank`` of the words of four characters or more that make up at least ``1 / one_in`` of all such words.

    There are at most ``one_in`` of them, whatever the corpus, so ranking them in one task is bounded.
    """
    long = counts.filter(F.length("clean") >= 4)
    total = long.agg(F.sum("n")).first()[0] or 0
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("clean")))
    return long.filter(F.col("n") * one_in >= total).select("clean", "n", (rank - 1).alias("rank"))


def corpus_lists(counts: DataFrame, vocabulary_one_in: int, typo_one_in: int) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and misspellings of a corpus by relative frequency, built-in entries first.

    Words that make up ``1 / vocabulary_one_in`` of the corpus are vocabulary. Those below that but above
    ``1 / typo_one_in`` count as misspellings, each of the word as many ranks ahead as there are vocabulary words. The
    counts are read several times: hand them over staged.
    """
    ranked = stage(frequent_words(counts, typo_one_in), "ranked")
    known = frequent_words(counts, vocabulary_one_in).count()
    base = len(dims.VOCABULARY)
    top = ranked.filter((F.col("rank") < known) & ~F.col("clean").isin(dims.VOCABULARY))
    vocab = dims.table(counts.sparkSession, "vocab").unionByName(top.select(F.col("clean").alias("word"), (F.col("rank") + base).alias("ordinal")))
    bad = ranked.filter(F.col("rank") >= known).select(F.col("clean").alias("bad"), (F.col("rank") - known).alias("_to"))
    good = ranked.select(F.col("clean").alias("good"), F.col("rank").alias("_to"))
    pairs = bad.filter(~F.col("bad").isin(list(dims.TYPOS))).join(good, "_to").select("bad", "good")
    return stage(vocab, "vocabulary"), stage(dims.table(counts.sparkSession, "typos").unionByName(pairs), "typos")


def deletion_keys(words: DataFrame, word: str) -> DataFrame:
    """Each row once per string left after removing up to two characters (column ``_key``).

    Two row generators choose the removed positions ``_i <= _j`` (0 removes
    none, equal positions remove one), so the strings come from compiled
    substring calls. A column ``limit`` of 1 keeps a row to one removed character.
    """
    w, i, j = F.col(word), F.col("_i"), F.col("_j")
    last = F.when(F.col("limit") < 2, i).otherwise(F.length(w)) if "limit" in words.columns else F.length(w)
    out = words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length(w))))
    out = out.withColumn("_j", F.explode(F.when(i == 0, F.array(F.lit(0))).otherwise(F.sequence(i, last))))
    key = F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.greatest(j - i - 1, F.lit(0))),
                   F.substring(w, j + 1, F.length(w)))
    return out.withColumn("_key", F.when(i == 0, w).otherwise(key)).drop("_i", "_j")


LONG = 7


def piece_keys(words: DataFrame, word: str) -> DataFrame:
    """Each row once per third of its word (columns ``_key``, ``_n`` its length, ``_piece``).

    Two edits leave one of three pieces whole, at most two places away.
    """
    w, n, i = F.col(word), F.col("_n"), F.col("_piece")
    out = words.withColumn("_n", F.length(w)).withColumn("_piece", F.explode(F.array(*map(F.lit, range(3)))))
    return out.withColumn("_key", F.substring(w, F.expr("int(_n * _piece div 3)") + 1, F.expr("int(_n * (_piece + 1) div 3) - int(_n * _piece div 3)")))


def piece_index(vocab: DataFrame) -> DataFrame:
    """Where the pieces of a word two edits away may lie in the vocabulary: ``word, ordinal, _n, _piece, _key``."""
    out = vocab.select("word", "ordinal").withColumn("_n", F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)))
    out = out.filter(F.col("_n") >= LONG).withColumn("_piece", F.explode(F.array(*map(F.lit, range(3)))))
    out = out.withColumn("_by", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("_at", F.expr("int(_n * _piece div 3) + _by"))
    out = out.filter(F.abs("_by") + F.abs(F.length("word") - F.col("_n") - F.col("_by")) <= 2)  # edits before the piece and behind it
    size = F.expr("int(_n * (_piece + 1) div 3) - int(_n * _piece div 3)")
    out = out.filter((F.col("_at") >= 0) & (F.col("_at") + size <= F.length("word")))
    return out.withColumn("_key", F.substring("word", F.col("_at") + 1, size)).drop("_at", "_by").distinct()


def closest_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(clean, closest, distance)`` for words within two edits of the vocabulary.

    Two words at edit distance d share a string reachable from both by at most d
    deletions, so candidates come from an equi-join on deletion keys. Words of
    ``LONG`` characters have too many of these and join by their thirds. Up to
    ``BROADCAST_KEYS`` keys of the vocabulary are broadcast, which is counted
    first; more are joined by shuffling. Words whose length rules out a match
    never get expanded. Ties go to the earlier vocabulary word. A word with a
    column ``limit`` of 1 asks for one edit only, and has far fewer keys.
    """
    lengths = (vocab.select(F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)).alias("_len"))
               .distinct())
    kept = [c for c in ("clean", "limit") if c in words.columns]
    near = words.select(*kept).distinct().withColumn("_len", F.length("clean"))
    near = near.join(F.broadcast(lengths), "_len", "left_semi")  # one row per word length
    # a fixed partition count: these few bytes grow about fiftyfold in the next step
    near = near.select(*kept).repartition(task_parallelism(words.sparkSession), "clean")
    long = F.length("clean") >= LONG
    edits = F.levenshtein(F.col("clean"), F.col("word"), 2).alias("distance")
    size = vocab.agg(F.sum((F.length("word") + 1) * (F.length("word") + 2) / 2 + 75)).first()[0] or 0
    hint = F.broadcast if size <= BROADCAST_KEYS else (lambda index: index)
    index = hint(deletion_keys(vocab.select("word", "ordinal"), "word").distinct())
    pairs = deletion_keys(near.filter(~long), "clean").join(index, "_key").select(*kept, "word", "ordinal", edits)
    pieces = piece_keys(near.filter(long), "clean").join(hint(piece_index(vocab)), ["_n", "_piece", "_key"]).select(*kept, "word", "ordinal", edits)
    pairs = pairs.unionByName(pieces)
    if "limit" in kept:
        pairs = pairs.filter(F.col("distance") <= F.col("limit"))
    # distance and ordinal as one number, which a hash aggregate takes; a struct would have all pairs sorted
    best = F.min(F.shiftleft(F.col("distance").cast("bigint"), 32) + F.col("ordinal")).alias("_best")
    out = pairs.filter("distance >= 0").groupBy("clean").agg(best)
    out = out.select("clean", F.shiftright("_best", 32).cast("int").alias("distance"), F.expr("int(_best & 4294967295)").alias("ordinal"))
    names = vocab.groupBy(F.col("ordinal").cast("int").alias("ordinal")).agg(F.min("word").alias("closest"))
    return out.join(names, "ordinal").select("clean", "closest", "distance")


def fuzzy_matches(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words outside the vocabulary that are one edit (two from seven characters on) from it."""
    known = vocab.select(F.col("word").alias("clean"))
    hits = closest_words(words.filter(F.length("clean") >= 4).join(known, "clean", "left_anti"), vocab)
    allowed = F.when(F.length("clean") >= 7, 2).otherwise(1)
    return hits.filter(F.col("distance") <= allowed)


def _ids(tokens: DataFrame) -> list[str]:
    return [c for c in tokens.columns if c not in ("pos", "word", "clean")]


def judge_vocabulary(counts: DataFrame, vocab: DataFrame, typos: DataFrame, vocab_first: bool = False) -> DataFrame:
    """Verdict per distinct word: ``(clean, word_reason, good, closest)`` of the failing ones.

    Everything that depends on the cleaned word alone is settled here, once per
    distinct word instead of once per occurrence.
    """
    typo_side = typos.select(F.col("bad").alias("clean"), "good")
    vocab_side = vocab.select(F.col("word").alias("clean"), F.lit(True).alias("_known"))
    words = counts.select("clean").join(typo_side, "clean", "left").join(vocab_side, "clean", "left")
    gib = tx.gibberish_reason(F.col("clean"), F.col("clean"))  # cleaned words have no capitals
    if vocab_first:
        gib = F.when(F.col("_known").isNull(), gib)
    words = words.withColumn("_gib", F.when(F.col("good").isNull(), gib))
    ask = words.filter((F.col("_gib") == "consonants") | (
        F.col("good").isNull() & F.col("_gib").isNull() & F.col("_known").isNull() & (F.length("clean") >= 4)))
    allowed = F.when(F.length("clean") >= 7, 2).otherwise(1)
    # a short word two edits away is no near match; only the fix of a consonant run asks that far
    limit = F.when(F.col("_gib") == "consonants", 2).otherwise(allowed)
    found = words.join(closest_words(ask.withColumn("limit", limit), vocab), "clean", "left")
    near = F.col("_known").isNull() & (F.length("clean") >= 4) & (F.col("distance") <= allowed)
    reason = (F.when(F.col("good").isNotNull(), "misspelling").when(F.col("_gib").isNotNull(), F.col("_gib"))
               .when(near, "near_vocabulary"))
    return found.select("clean", reason.alias("word_reason"), "good", "closest").filter("word_reason IS NOT NULL")


def judge_words(tokens: DataFrame, vocab: DataFrame, typos: DataFrame, vocab_first: bool = False,
                spelled: DataFrame | None = None) -> DataFrame:
    """Adds ``reason`` and ``fix`` to every failing word; other words are dropped.

    Rules in order: known misspelling; repeated letters, consonant run or mixed
    case; close to a vocabulary word. ``vocab_first`` exempts vocabulary words
    from the letter-pattern rules. All rules depend on the word alone, so they are
    settled once per spelling; only the failing ones meet the texts again. Where
    the :func:`spellings` of ``tokens`` are known, ``spelled`` spares a pass.
    """
    spelled = spellings(tokens.select("word")) if spelled is None else spelled
    verdicts = judge_vocabulary(spelled.select("clean").distinct(), vocab, typos, vocab_first)
    df = spelled.select("word", "clean").join(verdicts, "clean", "left")
    mixed = (F.length("word") >= 4) & F.col("word").rlike("[a-z][A-Z][a-z]")
    if vocab_first:
        known = vocab.select(F.col("word").alias("clean"), F.lit(True).alias("_known"))
        df = df.join(known, "clean", "left")
        mixed = mixed & F.col("_known").isNull()
    reason = (F.when(F.col("word_reason").isin("misspelling", "repeat", "consonants"), F.col("word_reason"))
               .when(mixed, "mixed_case").otherwise(F.col("word_reason")))
    df = df.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    cased = tx.match_case(F.col("word"), F.coalesce("good", "closest"))
    fix = (F.when(F.col("reason") == "repeat", tx.collapse_repeats(F.col("clean")))
            .when(F.col("reason") == "mixed_case", F.lower("word"))
            .when(F.col("reason") == "consonants", F.coalesce("closest", F.lit("")))
            .otherwise(cased))
    failing = df.select("word", "clean", "reason", fix.alias("fix"))
    # the adaptive join splits a frequent word, or broadcasts the failing words while they are few
    return tokens.select(*_ids(tokens), "pos", "word").join(failing, "word").select(*_ids(tokens), "pos", "word", "clean", "reason", "fix")


def first_issue(judged: DataFrame, id_cols: list[str]) -> DataFrame:
    """First failing word per text; a partial aggregate, so long texts do not gather."""
    first = F.min_by(F.struct("word", "clean", "reason", "fix"), "pos")
    out = judged.groupBy(*id_cols).agg(F.min("pos").alias("pos"), first.alias("_f"))
    return out.select(*id_cols, "pos", F.col("_f.word").alias("word"), F.col("_f.clean").alias("clean"),
                      F.col("_f.reason").alias("reason"), F.col("_f.fix").alias("fix"))


def suggest_text(texts: DataFrame, issues: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """Suggested wording: the failing word replaced in place, or the fix alone for gibberish."""
    joined = texts.join(issues, id_cols, "inner")
    replaced = tx.with_word(F.col(text), F.col("pos"), F.col("fix"))
    in_place = F.col("reason").isin("misspelling", "near_vocabulary")
    suggestion = F.when(in_place, replaced).otherwise(F.col("fix"))
    return joined.select(*id_cols, tx.trimmed(F.col(text)).alias("raw_text"), "pos", "word", "reason", suggestion.alias("suggestion"))


def text_summary(tokens: DataFrame, judged: DataFrame, id_cols: list[str]) -> DataFrame:
    """Words, failing words and verdict per text, merged by union instead of a join."""
    both = tokens.select(*id_cols, F.lit(1).alias("w"), F.lit(0).alias("t")).unionByName(
        judged.select(*id_cols, F.lit(0).alias("w"), F.lit(1).alias("t")))
    out = both.groupBy(*id_cols).agg(F.sum("w").alias("words"), F.sum("t").alias("typo_count"))
    return out.withColumn("has_issues", F.col("typo_count") > 0)


def match_typos(tokens: DataFrame, typos: DataFrame) -> DataFrame:
    side = typos.select(F.col("bad").alias("clean"), "good")
    hits = tokens.join(side, "clean", "inner")
    return hits.select(*_ids(tokens), "pos", "word", "clean",
                       tx.match_case(F.col("word"), F.col("good")).alias("fix"))
