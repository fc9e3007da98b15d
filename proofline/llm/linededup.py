"""Line deduplication with a log-template tree.

Digits of a line are generalised first (every run becomes ``0``; a line of at most ``depth`` tokens stays as it is). The
tree has a fixed depth: number of tokens, then the ``depth`` leading tokens. In a leaf that many documents reach, a token
that ``min_variants`` documents have at its position is fixed, every other token is a variable field. Lines with the same
fixed tokens are one template, so a leaf holds as many templates as its lines call for, and more data does not blur
them. A line with too few fixed tokens is a template of its own.

The number of documents decides, wherever in a document a line stands. Documents with the same set of lines are copies
and count once. A line that stands word for word in ``min_documents`` documents, or whose template stands in
``min_variants``, is dropped from all of them but the one with the smallest id. Lines of at most ``depth`` tokens and
``HEADING_CHARS`` characters, such as headings, take ``min_variants`` documents; lines without a letter or digit, such as brackets and rules, are left alone.

DataFrame functions only. Rows between the stages are hashes; the text is shuffled once, by document id, to meet its
drop list. Hot templates are pre-aggregated by (template, copies) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.fence import fenced

from .common import staged

HEADING_CHARS = 32


def _line(masked: Column) -> Column:
    """A line without blanks at its ends; its tokens are what stands between single blanks."""
    return F.btrim(F.replace(F.replace(masked, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit(" "))


def _masked(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "0")


def _blanks() -> Column:
    return F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))


def _members(seen: DataFrame, lines: DataFrame, leaves: DataFrame, min_variants: int, agreement: float) -> DataFrame:
    """h, member_of (a template) of the lines of busy leaves that have enough fixed tokens."""
    # the distinct lines of busy leaves, with the number of documents
    busy = seen.join(leaves, "leaf").select("leaf", "h", "copies").distinct().groupBy("leaf", "h").agg(F.count("*").alias("n"))
    wording = lines.select("leaf", "h", "line").join(leaves, "leaf").groupBy("leaf", "h").agg(F.max("line").alias("line"))
    distinct = staged(busy.join(wording, ["leaf", "h"]), "wording")
    tokens = distinct.select("leaf", "h", "n", F.posexplode(F.split("line", " ")).alias("i", "token"))
    fixed = tokens.groupBy("leaf", "i", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_variants).select("leaf", "i", "token")
    kept = tokens.select("leaf", "h", "i", "token").join(staged(fixed, "fixed"), ["leaf", "i", "token"])
    form = kept.groupBy("leaf", "h").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("form"))
    lengths = distinct.select("leaf", "h", (_blanks() + 1).alias("size"))
    form = form.join(lengths, ["leaf", "h"]).filter(F.size("form") >= F.ceil(F.lit(agreement) * F.col("size")))
    return staged(form.select("h", F.xxhash64("leaf", "form").alias("member_of")), "members")


def _counted(seen: DataFrame, key: str, least: Column) -> DataFrame:
    """key, keeper of what stands in at least ``least`` documents; a group of copies is one document."""
    groups = seen.groupBy(key, "copies").agg(F.min("id").alias("keeper"), F.max("short").alias("short"))
    counts = groups.groupBy(key).agg(F.count("*").alias("n"), F.min("keeper").alias("keeper"), F.max("short").alias("short"))
    return counts.filter(F.col("n") >= least).select(key, "keeper")


def repeated(docs: DataFrame, depth: int = 2, min_documents: int = 2, min_variants: int = 10, agreement: float = 0.7,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h of the lines to drop."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.explode(F.split(text, "\n")).alias("raw"))
    rows = fenced(rows.withColumn("exact", _line(F.col("raw"))), ["exact"]).filter(F.col("exact").rlike("[\\p{L}\\p{N}]"))
    few = F.length("exact") - F.length(F.replace("exact", F.lit(" "), F.lit(""))) < depth
    short = few & (F.length("exact") <= HEADING_CHARS)
    rows = rows.select("id", F.xxhash64("exact").alias("e"), short.alias("short"), F.when(few, F.col("exact")).otherwise(_masked(F.col("exact"))).alias("line"))
    lines = fenced(rows, ["line"]).withColumns({"leaf": F.xxhash64(_blanks(), F.substring_index("line", " ", depth)), "h": F.xxhash64("line")})
    sets = lines.groupBy("id").agg(F.collect_set(F.struct("e", "h", "leaf", "short")).alias("lines"))
    # fenced, so that the name of the set is made once and not with every line taken out of it
    sets = fenced(sets.withColumn("copies", F.xxhash64(F.array_sort(F.array_distinct("lines.h")))), ["copies"])
    seen = staged(sets.select("id", "copies", F.explode("lines").alias("l")).select("id", "copies", "l.*"), "lines")
    leaves = seen.select("leaf", "copies").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
    leaves = staged(leaves.filter(F.col("n") >= min_variants).select("leaf"), "leaves")
    members = _members(seen, lines, leaves, min_variants, agreement)
    varied = seen.join(members, "h", "left").withColumn("t", F.coalesce("member_of", "h"))
    exact = _counted(seen, "e", F.when(F.col("short"), min_variants).otherwise(min_documents))
    same = seen.join(staged(exact, "same"), "e").select("id", "e", "keeper")
    alike = varied.join(staged(_counted(varied, "t", F.lit(min_variants)), "alike"), "t").select("id", "e", "keeper")
    return same.unionByName(alike).filter(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", F.col("e").alias("h"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``; options as in :func:`repeated`.

    Rows are kept, whatever is left of them: a document of recurring lines alone ends with an empty text. A null text
    stays null with zero lines. Rows with one id share their decisions and are one document; rows with a null id are
    one document too, never the keeper as long as another document has the line. Other columns pass through; existing
    columns ``n_lines`` and ``n_dropped`` are replaced.
    """
    return _without(docs, repeated(docs, doc_id=doc_id, text=text, **options), doc_id, text)


def _without(docs: DataFrame, dropped: DataFrame, doc_id: str, text: str) -> DataFrame:
    drops = dropped.groupBy("id").agg(F.collect_set("h").alias("_drop")).withColumnRenamed("id", "_id")
    # a long drop list is cut by hash into about as many parts as each of them has entries, so that looking up all lines
    # of a long document does not take the square of their number
    parts = F.floor(F.sqrt(F.size("_drop"))).cast("int")
    drops = drops.withColumn("_n", F.greatest(parts, F.lit(1)))
    drops = fenced(drops.withColumn("_drops", F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                                                          lambda b: F.filter("_drop", lambda h: F.pmod(h, F.col("_n")) == b))), ["_drops"])
    plain = docs.drop("n_lines", "n_dropped")
    joined = plain.join(drops.select("_id", "_n", "_drops"), F.col(doc_id).eqNullSafe(F.col("_id")), "left")
    lines = F.split(F.col(text), "\n")

    def stays(line: Column) -> Column:
        h = F.xxhash64(_line(line))
        return ~F.array_contains(F.get("_drops", F.pmod(h, F.col("_n")).cast("int")), h)

    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    out = joined.withColumn("_kept", F.when(F.col("_drops").isNotNull() & F.col(text).isNotNull(), F.filter(lines, stays)))
    return out.select(*[F.coalesce(F.array_join("_kept", "\n"), F.col(c)).alias(c) if c == text else F.col(c) for c in plain.columns],
                      n_lines.cast("bigint").alias("n_lines"),
                      F.when(F.col("_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("bigint").alias("n_dropped"))


def oracle(depth: int = 2, min_documents: int = 2, min_variants: int = 10, agreement: float = 0.7) -> str:
    """DuckDB SQL for ``doc_id, n_lines, n_dropped, text``."""
    lead = " || ' ' || ".join(f"tokens[{i + 1}]" for i in range(depth))
    return f"""WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS raws FROM documents),
 flat AS (SELECT doc_id, trim(translate(unnest(raws), chr(9) || chr(13), '  '), ' ') AS exact FROM split),
 cut AS (SELECT *, len(string_split(exact, ' ')) <= {depth} AS few, len(string_split(exact, ' ')) <= {depth} AND length(exact) <= {HEADING_CHARS} AS short FROM flat WHERE regexp_matches(exact, '[\\p{{L}}\\p{{N}}]')),
 toks AS (SELECT *, string_split(line, ' ') AS tokens FROM (SELECT *, CASE WHEN few THEN exact ELSE regexp_replace(exact, '[0-9]+', '0', 'g') END AS line FROM cut)),
 uniq AS MATERIALIZED (SELECT DISTINCT doc_id, exact, short, line, len(tokens) || ' ' || CASE WHEN few THEN line ELSE {lead} END AS leaf FROM toks),
 cop AS (SELECT doc_id, list_sort(list(DISTINCT line)) AS copies FROM uniq GROUP BY 1),
 seen AS MATERIALIZED (SELECT u.*, dense_rank() OVER (ORDER BY copies) AS copies FROM uniq u JOIN cop ON u.doc_id IS NOT DISTINCT FROM cop.doc_id),
 busy AS (SELECT leaf FROM seen GROUP BY 1 HAVING count(DISTINCT copies) >= {min_variants}),
 wording AS MATERIALIZED (SELECT leaf, line, count(DISTINCT copies) AS n, string_split(line, ' ') AS tokens FROM seen JOIN busy USING (leaf) GROUP BY leaf, line),
 tk AS MATERIALIZED (SELECT leaf, line, n, i, tokens[i] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM wording)),
 fixed AS (SELECT leaf, i, token FROM tk GROUP BY ALL HAVING sum(n) >= {min_variants}),
 form AS (SELECT leaf, line, list((i, token) ORDER BY i) AS form FROM tk JOIN fixed USING (leaf, i, token) GROUP BY 1, 2),
 mem AS (SELECT leaf, line, form FROM form WHERE len(form) >= ceil({agreement} * len(string_split(line, ' ')))),
 t AS MATERIALIZED (SELECT s.*, CASE WHEN form IS NULL THEN 'line ' || line ELSE 'form ' || leaf || ' ' || CAST(form AS VARCHAR) END AS t FROM seen s LEFT JOIN mem USING (leaf, line)),
 same AS (SELECT exact, min(doc_id) AS keeper FROM seen GROUP BY 1 HAVING count(DISTINCT copies) >= CASE WHEN bool_or(short) THEN {min_variants} ELSE {min_documents} END),
 alike AS (SELECT t, min(doc_id) AS keeper FROM t GROUP BY 1 HAVING count(DISTINCT copies) >= {min_variants}),
 drops AS (SELECT doc_id, list(DISTINCT exact) AS d FROM (SELECT doc_id, exact, keeper FROM t JOIN same USING (exact) UNION ALL SELECT doc_id, exact, keeper FROM t JOIN alike USING (t))
  WHERE doc_id IS DISTINCT FROM keeper GROUP BY 1),
 kept AS (SELECT s.doc_id, s.text, s.raws, CASE WHEN d IS NOT NULL THEN list_filter(raws, lambda x: NOT list_contains(d, trim(translate(x, chr(9) || chr(13), '  '), ' '))) END AS ks
  FROM split s LEFT JOIN drops ON s.doc_id IS NOT DISTINCT FROM drops.doc_id)
 SELECT doc_id, CAST(coalesce(len(raws), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN ks IS NULL THEN 0 ELSE len(raws) - len(ks) END AS BIGINT) AS n_dropped,
 CASE WHEN ks IS NULL THEN text ELSE coalesce(array_to_string(ks, chr(10)), '') END AS text FROM kept"""
