"""Conversation structure repair as a lightest derivation, found with Knuth's agenda.

The rows of a conversation are edited so that the initials of its roles read ``(s?(ua)+)?``: an optional system turn,
then exchanges of user and assistant. Edits and costs: K(eep) 0, R(erole) to user or assistant 3, D(elete) 4, I(nsert)
an empty user or assistant turn 3. Blank rows and rows seen before must be deleted; a truncated row that stays adds 3.

Items of the hypergraph are ``(i, q)``: the first ``i`` pieces are edited, and state ``q`` says what may follow (nothing
yet, after s, after u, after a). A piece is a row, or a run of rows already solved: for every state before it the best
derivation to every state after it. The deductions are

    (i, q), piece i from q to r   |-  (i + 1, r)      cost and audit of both, added and joined
    (i, q)                        |-  (i, next of q)   an insertion
    (n, q), q final               |-  goal

A value is ``(cost, audit)``, the audit being the initials of the edits. Extending a derivation never makes it smaller
(costs are not negative, and a string is not smaller than its beginning), so the first value popped for an item is its
best. It is also monotone where it has to be: two derivations of one item that cost the same are never one the
beginning of the other, since the longer one could only go on with insertions, which cost. The agenda ends when the goal
item is popped.

Conversations of ordinary size are solved in one piece, in a stream over rows sorted by conversation. For the others no
task holds or solves the whole: rows are dealt by range of (conversation, turn, role, text), each task folds its runs 64
to 1 into pieces, the pieces of a conversation are solved in turn, and the repaired rows pass by in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
GOAL = 4
#: What an insertion or a new role gives in each state, and what a kept row may be.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
CUT = 3
FAN = 64
#: Faults of a row.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LARGE_ROWS, LARGE_BYTES = 4096, 16 << 20
Piece = tuple  # by state before: tuple of (state after, cost, audit)
REPORT = T.StructType([T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                      + [T.StructField("audit", T.StringType())])


@lru_cache(64)
def row_piece(initial: str, fault: int) -> Piece:
    """What one row allows."""
    out = []
    for q in NEXT:
        ways = [(q, COSTS["D"], "D")]
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            if (q, initial) in KEPT:
                ways.append((KEPT[q, initial], COSTS["K"] + cut, "K"))
            ways.append((NEXT[q], COSTS["R"] + cut, "R"))
        out.append(tuple(ways))
    return tuple(out)


def lightest(pieces: list[Piece], start: int = START, goal: bool = True) -> tuple[int, str] | dict[int, tuple[int, str]]:
    """Value of the goal item, or (``goal=False``) the values of all states after the last piece."""
    n, agenda, final, ends = len(pieces), [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if q == GOAL:
            return cost, audit
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            if not goal:
                ends[q] = cost, audit
            elif q in (START, ASSISTANT):
                heappush(agenda, (cost, audit, n, GOAL))
        else:
            for r, c, w in pieces[i][q]:
                if (i + 1, r) not in final:
                    heappush(agenda, (cost + c, audit + w, i + 1, r))
        if (i, NEXT[q]) not in final:
            heappush(agenda, (cost + COSTS["I"], audit + "I", i, NEXT[q]))
    return ends


def merged(pieces: list[Piece]) -> Piece:
    """Several pieces as one."""
    return tuple(tuple((r, c, w) for r, (c, w) in sorted(lightest(pieces, q, goal=False).items())) for q in NEXT)


def times(piece: Piece, n: int) -> Piece:
    """A piece ``n >= 1`` times in a row."""
    out = None
    while n:
        if n & 1:
            out = piece if out is None else merged([out, piece])
        n >>= 1
        if n:
            piece = merged([piece, piece])
    return out


class Fold:
    """Pieces in order, folded ``FAN`` to one; holds a logarithmic number of them."""

    def __init__(self):
        self.levels: list[list[Piece]] = [[]]

    def add(self, piece: Piece, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(piece)
        if len(self.levels[level]) == FAN:
            whole, self.levels[level] = merged(self.levels[level]), []
            self.add(whole, level + 1)

    def pieces(self) -> list[Piece]:
        return [p for level in reversed(self.levels) for p in level]


def replay(audit: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation; ``rows`` is read along with the audit."""
    q = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            q = KEPT[q, role[:1]]
        else:
            q = NEXT[q]
            role = NAMES[q]
        yield edit, role, text


def fault_of(text: str) -> int:
    """Blank or truncated; that a row was seen before is for the caller to say."""
    solid = text.rstrip(BLANKS)
    return BLANK if not solid else NONE if solid[-1] in ".!?" else TRUNCATED


def turn_gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def solved(rows: list[tuple]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Report and repaired rows of one conversation, given (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = fault_of(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        faults.append(fault)
    initials = [role[:1] for _, role, _ in rows]
    fold = Fold()
    for initial, fault in zip(initials, faults):
        fold.add(row_piece(initial if initial in ("s", "u", "a") else "", fault))
    cost, audit = lightest(fold.pieces())
    report = {"gaps": turn_gaps([t for t, _, _ in rows]), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
              "truncated": faults.count(TRUNCATED), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
              "cost": cost, "audit": audit}
    return report, list(replay(audit, iter([r[1:] for r in rows])))


class Log:
    """Collects rows of the result and hands them out in batches."""

    def __init__(self, id_type: pa.DataType):
        self.schema = pa.schema([("conv_id", id_type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
                                 ("report", pa.struct([(f.name, pa.string() if f.name == "audit" else pa.int64()) for f in REPORT.fields]))])
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, conv_id, position: int, edit: str, role: str | None, text: str | None, report: dict | None = None) -> None:
        self.rows.append((conv_id, position, edit, role, text, report))
        self.size += 64 + len(text or "")

    def full(self) -> bool:
        return self.size > 4 << 20

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _log_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
                         T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("report", REPORT)])


def _ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, copies), sorted, of conversations that fit into memory."""
    log, here, rows, any_row = None, None, [], False

    def close() -> None:
        report, turns = solved(rows)
        log.add(here, 0, "", None, None, report)
        for n, (edit, role, text) in enumerate(turns):
            log.add(here, n + 1, edit, role, text)

    for batch in batches:
        log = log or Log(batch.schema.field("conv_id").type)
        for conv_id, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
            if not any_row or conv_id != here:
                if any_row:
                    close()
                here, rows, any_row = conv_id, [], True
            rows += [(turn, role, text)] * copies
            if log.full():
                yield log.batch()
    if any_row:
        close()
        yield log.batch()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece for each conversation of a range: rows (conv_id, initial, fault, first, copies), sorted."""
    part, here, fold, counts, ends = TaskContext.get().partitionId(), None, None, None, None
    out, id_type = [], None

    def close() -> None:
        piece = merged(fold.pieces())
        ways = [{"p": p, "q": q, "cost": c, "audit": w} for p, to in enumerate(piece) for q, c, w in to]
        out.append({"conv_id": here, "part": part, "ways": ways, "head": ends[0], "tail": ends[1], "blank": counts[BLANK],
                    "duplicate": counts[DUPLICATE], "truncated": counts[TRUNCATED], "illegal": counts[4]})

    def batch_out() -> pa.RecordBatch:
        way = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        schema = pa.schema([("conv_id", id_type), ("part", pa.int32()), ("ways", pa.list_(way)), ("head", pa.string()), ("tail", pa.string()),
                            *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]])
        return pa.RecordBatch.from_pylist(out, schema)

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for conv_id, initial, fault, first, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "first", "copies"))):
            if fold is None or conv_id != here:
                if fold is not None:
                    close()
                    if len(out) >= 64:
                        yield batch_out()
                        out.clear()
                here, fold, counts, ends = conv_id, Fold(), [0] * 5, None
            known = initial if initial in ("s", "u", "a") else ""
            again = BLANK if fault == BLANK else DUPLICATE  # what further copies are
            one = fault if first or fault == BLANK else DUPLICATE
            fold.add(row_piece(known, one))
            counts[one] += 1
            if copies > 1:
                fold.add(times(row_piece(known, again), copies - 1))
                counts[again] += copies - 1
                counts[4] += copies - 1 if initial + initial not in ("su", "ua", "au") else 0
            if ends is None:
                ends = (initial, initial)
            else:
                counts[4] += ends[1] + initial not in ("su", "ua", "au")
                ends = (ends[0], initial)
    if fold is not None:
        close()
        yield batch_out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each conversation, in order, to (conv_id, blank, duplicate, truncated, illegal, cost, audit)."""
    here, fold, sums, tail, id_type = None, None, None, None, None

    def close() -> pa.RecordBatch:
        cost, audit = lightest(fold.pieces())
        return pa.RecordBatch.from_arrays([pa.array([here], id_type), *(pa.array([v], pa.int64()) for v in (*sums, cost)), pa.array([audit], pa.large_string()).cast(pa.string())],
                                          ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for row in range(batch.num_rows):
            r = batch.slice(row, 1).to_pylist()[0]
            if fold is None or r["conv_id"] != here:
                if fold is not None:
                    yield close()
                here, fold, sums, tail = r["conv_id"], Fold(), [0] * 4, None
            piece: list[list] = [[] for _ in NEXT]
            for w in r["ways"]:
                piece[w["p"]].append((w["q"], w["cost"], w["audit"]))
            fold.add(tuple(map(tuple, piece)))
            sums = [s + r[c] for s, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"))]
            sums[3] += tail is not None and tail + r["head"] not in ("su", "ua", "au")
            tail = r["tail"]
    if fold is not None:
        yield close()


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of long conversations: first a row with the report, then its rows in order, read as they come."""
    def source() -> Iterator[dict]:
        for batch in batches:
            kinds.append(batch.schema.field("conv_id").type)
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()

    kinds: list[pa.DataType] = []
    rows = source()
    row = next(rows, None)
    log = Log(kinds[0]) if kinds else None
    ready: list[dict] = [row] if row is not None else []

    def turns(conv_id) -> Iterator[tuple[str, str]]:
        for r in rows:
            if r["report"] is not None:
                ready.append(r)
                return
            for _ in range(r["copies"]):
                yield r["role"], r["text"]

    while ready:
        head = ready.pop()
        log.add(head["conv_id"], 0, "", None, None, head["report"])
        source_rows = turns(head["conv_id"])
        for n, (edit, role, text) in enumerate(replay(iter(head["report"]["audit"]), source_rows)):
            log.add(head["conv_id"], n + 1, edit, role, text)
            if log.full():
                yield log.batch()
        for _ in source_rows:  # on to the next conversation
            pass
    if log is not None:
        yield log.batch()


def _long(rows: DataFrame) -> DataFrame:
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(solid == "", BLANK).when(F.substring(solid, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    same = rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = staged(same.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.sha2("text", 256).alias("hash")), "same")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min(turn).alias("least"))
    marked = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")))
    earliest = F.col("turn").eqNullSafe(F.col("least.turn"))
    marked = staged(marked.select("conv_id", "turn", "role", "text", "copies", "initial", "fault", earliest.alias("first")), "marked")
    way = "array<struct<p int, q int, cost bigint, audit string>>"
    id_type = rows.schema["conv_id"].dataType.simpleString()
    runs = (marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "initial", "fault", "first", "copies")
            .mapInArrow(_runs, f"conv_id {id_type}, part int, ways {way}, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"))
    found = (staged(runs, "runs").repartition("conv_id").sortWithinPartitions("conv_id", "part")
             .mapInArrow(_joined, f"conv_id {id_type}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"))
    known = marked.filter("turn IS NOT NULL").select("conv_id", "turn").distinct()
    gaps = known.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    found = staged(found, "found").join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    report = F.struct(F.coalesce("gaps", F.lit(0).cast("bigint")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    none = F.lit(None)
    heads = found.select("conv_id", none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
                         none.cast("bigint").alias("copies"), report.alias("report"))
    turns = marked.select("conv_id", "turn", "role", "text", F.col("copies").cast("bigint").alias("copies"), none.cast(REPORT).alias("report"))
    dealt = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("report").isNull(), *order[1:])
    return dealt.mapInArrow(_passing, _log_schema(rows))


def repair(conversations: DataFrame, copies: Column | None = None, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """Repairs each conversation of ``conv_id, turn, role, text``; returns one row per conversation and repaired turn.

    ``position`` 0 carries the ``report`` (gaps, blank, duplicate, truncated, illegal, cost, audit) and no turn; positions
    from 1 are the repaired turns with the ``edit`` that gave them (K, R or I) and no report. The rows of a conversation
    are together and in order. ``copies`` says how often a row stands there, 0 leaves it out; a conversation whose rows
    are all left out has a report of zeros with an empty audit.

    Rows are taken by turn, null turns first; rows of one turn by role and text (in bytes), so equal rows are neighbours.
    A null role or text is one blank. A null ``conv_id`` is a conversation of its own. A row with an empty role, or
    one whose initial is not s, u or a, cannot be kept; any role with one of these initials can, as it stands. Equal audits
    mean equal results, so ties are decided by the audit alone. Very long texts and conversations of any length are
    processed whole; other columns are not looked at. An empty table gives an empty result.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    large = staged(sizes.filter((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select(F.col("conv_id").alias("c")), "large")
    several = not large.isEmpty()
    meets = F.col("conv_id").eqNullSafe(F.col("c"))
    ordinary = rows.join(large, meets, "left_anti") if several else rows
    ordinary = ordinary.withColumns({c: F.when(F.col("copies") > 0, F.col(c)) for c in ("role", "text")})
    out = (ordinary.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
           .mapInArrow(_ordinary, _log_schema(rows)))
    return out.unionByName(_long(rows.join(large, meets, "left_semi"))) if several else out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, sha, out, id_type = None, None, [], None

    def batch_out() -> pa.RecordBatch:
        schema = pa.schema([("conv_id", id_type), *[(f.name, pa.string() if f.name == "audit" else pa.int64()) for f in REPORT.fields], ("repaired_sha256", pa.string())])
        return pa.RecordBatch.from_pylist(out, schema)

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for conv_id, n, role, text, report in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text", "report"))):
            if report is not None:
                if here is not None:
                    out.append(here | {"repaired_sha256": sha.hexdigest()})
                here, sha = {"conv_id": conv_id} | report, hashlib.sha256()
            else:
                sha.update(f"{chr(10) if n > 1 else ''}{role}:{text}".encode())
        if out:
            yield batch_out()
            out.clear()
    if here is not None:
        out.append(here | {"repaired_sha256": sha.hexdigest()})
        yield batch_out()


def digested(repaired: DataFrame) -> DataFrame:
    """conv_id, the report's columns and the SHA-256 of the repaired turns (``role:text``, joined by newlines).

    Takes the result of :func:`repair` as it comes, the rows of a conversation together and in order.
    """
    id_type = repaired.schema["conv_id"].dataType.simpleString()
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REPORT.fields)
    return repaired.mapInArrow(_digests, f"conv_id {id_type}, {columns}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with planted faults and the number of copies, by crc32 of ``conv_id:turn`` (nulls: one blank) modulo 20.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", fault.alias("fault"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    return rows, F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)


def oracle() -> str:
    """DuckDB SQL for the damaged and repaired ``conversations``: a table of the best derivations, row by row."""
    inserts = [(q, q, 0, "") for q in NEXT] + [(START, USER, 3, "I"), (START, ASSISTANT, 6, "II"), (SYSTEM, USER, 3, "I"), (SYSTEM, ASSISTANT, 6, "II"),
                                               (USER, ASSISTANT, 3, "I"), (ASSISTANT, USER, 3, "I")]
    keeps = [(START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER)]
    values = lambda rows: ", ".join(str(r).replace('"', "'") for r in rows)
    return f"""WITH RECURSIVE o AS (SELECT DISTINCT conv_id FROM conversations), cs AS (SELECT conv_id, row_number() OVER () AS cid FROM o),
 k AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_reduce(list_concat([4294967295], flatten([[unicode(ch), 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')])),
   lambda acc, x: CAST(xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1)) AS BIGINT)) AS crc FROM conversations v JOIN cs ON v.conv_id IS NOT DISTINCT FROM cs.conv_id),
 f AS (SELECT *, xor(crc, 4294967295) % 20 AS fault FROM k),
 d AS (SELECT cid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM f, range(0, 2) t(copy)
  WHERE copy < CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
 n AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini FROM d),
 m AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE 'n' END AS fl,
  coalesce(lag(ini) OVER (PARTITION BY cid ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM n),
 ins(p, q, c, w) AS (VALUES {values(inserts)}), keep(p, ini, q) AS (VALUES {values(keeps)}), nxt(p, q) AS (VALUES {values(NEXT.items())}),
 ed AS (SELECT cid, i, q AS p, q, 4 AS c, 'D' AS w FROM m, (SELECT DISTINCT p AS q FROM nxt)
  UNION ALL SELECT cid, i, p, q, CASE fl WHEN 't' THEN 3 ELSE 0 END, 'K' FROM m JOIN keep USING (ini) WHERE fl IN ('n', 't')
  UNION ALL SELECT cid, i, p, q, CASE fl WHEN 't' THEN 6 ELSE 3 END, 'R' FROM m, nxt WHERE fl IN ('n', 't')),
 st AS MATERIALIZED (SELECT cid, i, ins.p, ed.q, min({{'c': ins.c + ed.c, 'w': ins.w || ed.w}}) AS v FROM ed JOIN ins ON ins.q = ed.p GROUP BY ALL),
 dp AS (SELECT cid, CAST(0 AS BIGINT) AS i, 0 AS q, {{'c': 0, 'w': ''}} AS v FROM cs
  UNION ALL SELECT dp.cid, st.i, st.q, min({{'c': dp.v.c + st.v.c, 'w': dp.v.w || st.v.w}}) AS v FROM dp JOIN st ON st.cid = dp.cid AND st.i = dp.i + 1 AND st.p = dp.q GROUP BY ALL),
 g AS (SELECT dp.cid, min({{'c': v.c + ins.c, 'w': v.w || ins.w}}) AS v FROM dp JOIN ins ON ins.p = dp.q
  JOIN (SELECT cid, max(i) AS n FROM dp GROUP BY cid) e ON e.cid = dp.cid AND e.n = dp.i WHERE ins.q IN ({START}, {ASSISTANT}) GROUP BY dp.cid),
 a AS (SELECT cid, k, w, sum(CAST(w <> 'I' AS BIGINT)) OVER (PARTITION BY cid ORDER BY k) AS i, sum(CAST(w <> 'D' AS BIGINT)) OVER (PARTITION BY cid ORDER BY k) AS e
  FROM (SELECT cid, k, substr(v.w, CAST(k AS INTEGER), 1) AS w FROM (SELECT cid, v, unnest(range(1, len(v.w) + 1)) AS k FROM g))),
 e AS (SELECT a.*, role, text, max(CAST(w = 'K' AND e = 1 AND ini = 's' AS INTEGER)) OVER (PARTITION BY a.cid) AS sys FROM a LEFT JOIN m ON a.cid = m.cid AND a.i = m.i AND a.w <> 'I' WHERE w <> 'D'),
 r AS (SELECT cid, string_agg((CASE WHEN w = 'K' THEN role WHEN (e - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(CASE WHEN w <> 'I' THEN text END, ''), chr(10) ORDER BY k) AS t FROM e GROUP BY cid),
 s AS (SELECT cid, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fl = 'b') AS blank, count(*) FILTER (fl = 'd') AS duplicate,
  count(*) FILTER (fl = 't') AS truncated, count(*) FILTER (bad) AS illegal FROM m GROUP BY cid)
 SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
 CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(v.c AS BIGINT) AS cost, v.w AS audit,
 sha256(coalesce(t, '')) AS repaired_sha256 FROM cs JOIN g USING (cid) LEFT JOIN s USING (cid) LEFT JOIN r USING (cid)"""
