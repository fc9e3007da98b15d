"""Text quality over whole documents and conversations."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from proofline.functions import text as tx
from proofline.operators import textcheck
from proofline.session import stage
from proofline.sources import derive, dims

from . import sql as S

#: Words that make up one in so many words of the corpus are vocabulary; those behind them, to the second share, misspellings.
VOCABULARY_ONE_IN, TYPO_ONE_IN = 4000, 5000
#: The report of the most frequent words.
TOP_WORDS = 500


def _tokens(spark, d):
    return textcheck.tokenize(derive.read(spark, d, "documents"), ["doc_id"])


def _spelled(spark, d):
    return stage(textcheck.spellings(textcheck.split_words(derive.read(spark, d, "documents"), ["doc_id"])), "spellings")


def _counts(spark, d, spelled=None):
    spelled = _spelled(spark, d) if spelled is None else spelled
    return stage(spelled.groupBy("clean").agg(F.sum("n").alias("n")), "words")


def _lists(spark, d):
    return textcheck.corpus_lists(_counts(spark, d), VOCABULARY_ONE_IN, TYPO_ONE_IN)


def _judged(spark, d, table="documents", ids=("doc_id",)):
    """Judged words of a table; vocabulary and misspellings always come from the documents."""
    spelled = _spelled(spark, d)
    vocab, typos = textcheck.corpus_lists(_counts(spark, d, spelled), VOCABULARY_ONE_IN, TYPO_ONE_IN)
    texts = derive.read(spark, d, table)
    judged = textcheck.judge_words(textcheck.split_words(texts, list(ids)), vocab, typos, spelled=spelled if table == "documents" else None)
    return textcheck.tokenize(texts, list(ids)), judged


def token_statistics(spark, d):
    return _tokens(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("words"), F.sum(F.length("clean")).alias("clean_chars"),
        F.sum(F.col("pos").cast("bigint")).alias("pos_sum"))


def word_frequencies(spark, d):
    return textcheck.word_counts(_tokens(spark, d))


def corpus_vocabulary(spark, d):
    """The ``TOP_WORDS`` most frequent words behind the built-in ones."""
    return textcheck.corpus_vocabulary(textcheck.word_counts(_tokens(spark, d)), TOP_WORDS)


def typo_hits(spark, d):
    return textcheck.match_typos(_tokens(spark, d), _lists(spark, d)[1])


def gibberish_words(spark, d):
    t = _tokens(spark, d).withColumn("reason", tx.gibberish_reason(F.col("clean"), F.col("word")))
    return t.filter(F.col("reason").isNotNull()).groupBy("doc_id", "reason").agg(F.count("*").alias("words"))


def collapsed_words(spark, d):
    w = _tokens(spark, d).select("clean").distinct()
    return w.select("clean", tx.collapse_repeats(F.col("clean")).alias("collapsed")).filter("clean <> collapsed")


def edit_distances(spark, d):
    p = derive.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("part_id"),
                    F.levenshtein(F.lower("p_name"), F.lower("p_type")).alias("distance"))


def closest_words(spark, d):
    counts = _counts(spark, d)
    return textcheck.closest_words(counts, textcheck.corpus_lists(counts, VOCABULARY_ONE_IN, TYPO_ONE_IN)[0])


def fuzzy_matches(spark, d):
    counts = _counts(spark, d)
    return textcheck.fuzzy_matches(counts, textcheck.corpus_lists(counts, VOCABULARY_ONE_IN, TYPO_ONE_IN)[0])


def word_verdicts(spark, d):
    return _judged(spark, d)[1].groupBy("doc_id", "reason").agg(F.count("*").alias("words"),
                                                               F.sum(F.length("fix")).alias("fix_chars"))


def first_issues(spark, d):
    return textcheck.first_issue(_judged(spark, d)[1], ["doc_id"])


def text_summary(spark, d):
    tokens, judged = _judged(spark, d)
    return textcheck.text_summary(tokens, judged, ["doc_id"])


def conversation_summary(spark, d):
    tokens, judged = _judged(spark, d, "conversations", ("conv_id", "turn"))
    return textcheck.text_summary(tokens, judged, ["conv_id", "turn"])


def text_suggestions(spark, d):
    issues = textcheck.first_issue(_judged(spark, d)[1], ["doc_id"])
    out = textcheck.suggest_text(derive.read(spark, d, "documents").select("doc_id", "text"), issues, ["doc_id"])
    return out.select("doc_id", "pos", "reason", "suggestion")


def escaped_pages(spark, d):
    esc = tx.html_escape(F.col("html"))
    return derive.read(spark, d, "pages").select("page_id", esc.alias("escaped"))


_TRIMMED = f"trim(text, '{tx.BLANKS}')"
_CHARS = string.ascii_lowercase + string.digits
_REPEAT = "|".join(f"{c}{{3,}}" for c in _CHARS)


def _collapse(e: str) -> str:
    for c in _CHARS:
        e = f"regexp_replace({e},'{c}{{3,}}','{c}{c}','g')"
    return e


def tokens_sql(table: str, ids: str) -> str:
    return f"""SELECT {ids}, CAST(pos AS INTEGER) AS pos, word, clean FROM (SELECT *,
 regexp_replace(lower(word),'[^a-z0-9]','','g') AS clean FROM (SELECT {ids}, pos, ws[pos+1] AS word FROM (
 SELECT {ids}, ws, unnest(range(len(ws))) AS pos FROM (SELECT {ids},
 regexp_split_to_array({_TRIMMED},'[{tx.BLANKS}]+') AS ws FROM {table})))) WHERE length(clean)>=2"""


_GIB = f"""CASE WHEN regexp_matches(clean,'{_REPEAT}') THEN 'repeat'
 WHEN regexp_matches(clean,'[bcdfghjklmnpqrstvwxyz]{{4,}}') THEN 'consonants'
 WHEN length(word)>=4 AND regexp_matches(word,'[a-z][A-Z][a-z]') THEN 'mixed_case' END"""
_BUILTIN = S.values([(w, i) for i, w in enumerate(dims.VOCABULARY)], "word,ordinal")
_TYPOS = S.values(list(dims.TYPOS.items()), "bad,good")
_TOP = f"""SELECT word, CAST(ordinal AS INTEGER) AS ordinal FROM {_BUILTIN} UNION ALL SELECT clean, CAST(rank+118 AS INTEGER)
  FROM rk WHERE rank<{TOP_WORDS} AND clean NOT IN (SELECT word FROM {_BUILTIN})"""
_CTE = f"""WITH tok AS MATERIALIZED ({tokens_sql('documents', 'doc_id')}),
 cnt AS MATERIALIZED (SELECT clean, count(*) AS n FROM tok GROUP BY 1),
 rk AS MATERIALIZED (SELECT clean, n, row_number() OVER (ORDER BY n DESC, clean)-1 AS rank, sum(n) OVER () AS total FROM cnt WHERE length(clean)>=4),
 kn AS MATERIALIZED (SELECT count(*) AS known FROM rk WHERE n*{VOCABULARY_ONE_IN}>=total),
 voc AS MATERIALIZED (SELECT word, CAST(ordinal AS INTEGER) AS ordinal FROM {_BUILTIN} UNION ALL SELECT clean, CAST(rank+118 AS INTEGER)
  FROM rk WHERE n*{VOCABULARY_ONE_IN}>=total AND clean NOT IN (SELECT word FROM {_BUILTIN})),
 typ AS MATERIALIZED (SELECT bad, good FROM {_TYPOS} UNION ALL SELECT a.clean, b.clean FROM rk a, kn, rk b WHERE b.rank=a.rank-known
  AND a.rank>=known AND a.n*{TYPO_ONE_IN}>=a.total AND a.clean NOT IN (SELECT bad FROM {_TYPOS})),
 near AS MATERIALIZED (SELECT clean, arg_min(word, dist*100000+ordinal) AS closest, CAST(min(dist) AS INTEGER) AS distance FROM (
  SELECT c.clean, v.word, v.ordinal, levenshtein(c.clean,v.word) AS dist FROM words c JOIN voc v
  ON length(c.clean) BETWEEN length(v.word)-2 AND length(v.word)+2) WHERE dist<=2 GROUP BY 1)"""


def cte(words: str = "SELECT clean FROM cnt") -> str:
    return _CTE.replace(" near AS", f" words AS MATERIALIZED ({words}), near AS")


def _case(target: str) -> str:
    return (f"CASE WHEN word=upper(word) THEN upper({target}) WHEN left(word,1)=upper(left(word,1)) THEN "
            f"upper(left({target},1))||lower(substr({target},2)) ELSE lower({target}) END")


def judged_sql(tok: str = "tok", ids: str = "doc_id") -> str:
    gib = _GIB.replace("clean", "t.clean").replace("(word", "(t.word")
    base = f"""SELECT t.*, y.good, n.closest, n.distance, {gib} AS gib, v.word IS NOT NULL AS known FROM {tok} t
 LEFT JOIN typ y ON y.bad=t.clean LEFT JOIN near n ON n.clean=t.clean LEFT JOIN (SELECT DISTINCT word FROM voc) v ON v.word=t.clean"""
    reason = """CASE WHEN good IS NOT NULL THEN 'misspelling' WHEN gib IS NOT NULL THEN gib
 WHEN NOT known AND length(clean)>=4 AND distance<=(CASE WHEN length(clean)>=7 THEN 2 ELSE 1 END) THEN 'near_vocabulary' END"""
    fix = f"""CASE WHEN good IS NOT NULL THEN {_case('good')} WHEN gib='repeat' THEN {_collapse('clean')}
 WHEN gib='mixed_case' THEN lower(word) WHEN gib='consonants' THEN coalesce(closest,'') ELSE {_case('closest')} END"""
    return (f"SELECT {ids}, pos, word, clean, reason, fix FROM (SELECT *, {reason} AS reason, {fix} AS fix FROM ({base}))"
            " WHERE reason IS NOT NULL")


def _summary_sql(tok: str, ids: str) -> str:
    return f"""SELECT {ids}, words, typo_count, typo_count>0 AS has_issues FROM (SELECT {ids}, CAST(sum(w) AS BIGINT) AS words,
 CAST(sum(t) AS BIGINT) AS typo_count FROM (SELECT {ids}, 1 AS w, 0 AS t FROM {tok} UNION ALL SELECT {ids}, 0, 1 FROM ({judged_sql(tok, ids)}))
 GROUP BY {ids})"""


_FIRST = f"""SELECT doc_id, min(pos) AS pos, arg_min(word,pos) AS word, arg_min(clean,pos) AS clean, arg_min(reason,pos) AS reason,
 arg_min(fix,pos) AS fix FROM ({judged_sql()}) GROUP BY 1"""
_ESC = "replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),chr(39),'&#39;')"
_SUGGEST = f"""SELECT doc_id, pos, reason, s AS suggestion FROM (SELECT *, CASE WHEN reason IN
 ('misspelling','near_vocabulary') THEN array_to_string([gaps[k]||CASE WHEN k=pos+1 THEN fix ELSE coalesce(ws[k],'') END FOR k IN range(1,len(gaps)+1)],'') ELSE fix END AS s FROM (
 SELECT i.*, regexp_split_to_array({_TRIMMED},'[{tx.BLANKS}]+') AS ws, regexp_split_to_array({_TRIMMED},'[^{tx.BLANKS}]+') AS gaps FROM ({_FIRST}) i
 JOIN documents USING (doc_id)))"""
_CONV = cte("SELECT clean FROM cnt UNION SELECT clean FROM ctok").replace(
    "WITH tok AS", f"WITH ctok AS MATERIALIZED ({tokens_sql('conversations', 'conv_id, turn')}), tok AS", 1)

ENTRIES = {
    "token_statistics": (token_statistics, f"""SELECT doc_id, count(*) AS words, CAST(sum(length(clean)) AS BIGINT) AS clean_chars,
 CAST(sum(pos) AS BIGINT) AS pos_sum FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY 1"""),
    "word_frequencies": (word_frequencies, f"SELECT clean, count(*) AS n FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY 1"),
    "corpus_vocabulary": (corpus_vocabulary, cte() + " " + _TOP),
    "typo_hits": (typo_hits, cte() + f" SELECT doc_id, pos, word, clean, {_case('good')} AS fix FROM tok JOIN typ ON bad=clean"),
    "gibberish_words": (gibberish_words, f"""SELECT doc_id, reason, count(*) AS words FROM (SELECT doc_id, {_GIB} AS reason
 FROM ({tokens_sql('documents', 'doc_id')})) WHERE reason IS NOT NULL GROUP BY 1,2"""),
    "collapsed_words": (collapsed_words, f"""SELECT clean, collapsed FROM (SELECT clean, {_collapse('clean')} AS collapsed FROM
 (SELECT DISTINCT clean FROM ({tokens_sql('documents', 'doc_id')}))) WHERE clean<>collapsed"""),
    "edit_distances": (edit_distances, """SELECT p_partkey AS part_id, CAST(levenshtein(lower(p_name),lower(p_type)) AS INTEGER)
 AS distance FROM part"""),
    "closest_words": (closest_words, cte() + " SELECT clean, closest, distance FROM near"),
    "fuzzy_matches": (fuzzy_matches, cte() + """ SELECT clean, closest, distance FROM near WHERE length(clean)>=4 AND clean NOT IN
 (SELECT word FROM voc) AND distance<=(CASE WHEN length(clean)>=7 THEN 2 ELSE 1 END)"""),
    "word_verdicts": (word_verdicts, cte() + f""" SELECT doc_id, reason, count(*) AS words, CAST(sum(length(fix)) AS BIGINT) AS fix_chars
 FROM ({judged_sql()}) GROUP BY 1,2"""),
    "first_issues": (first_issues, cte() + " " + _FIRST),
    "text_summary": (text_summary, cte() + " " + _summary_sql("tok", "doc_id")),
    "conversation_summary": (conversation_summary, _CONV + " " + _summary_sql("ctok", "conv_id, turn")),
    "text_suggestions": (text_suggestions, cte() + " " + _SUGGEST),
    "escaped_pages": (escaped_pages, f"SELECT page_id, {_ESC} AS escaped FROM pages"),
}
