"""Operator 11: faults of conversations, and the cheapest repair of each, found in linear space."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stitchrank.llm.common import partitions, table, written

# A repaired conversation's role initials match (s?(ua)+)?: nothing read yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (EMPTY, ASSISTANT)
AFTER = {(EMPTY, "s"): SYSTEM, **{(p, "u"): USER for p in (EMPTY, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INITIALS = "sua"  # any other is class 3
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
INFINITE = 1 << 60
# Rows of one piece of a conversation; longer ones are repaired piece by piece.
PIECE = 4096


def _inserts() -> list[list[int | None]]:
    """Insertions that lead from one state to another."""
    found = [[None] * 4 for _ in range(4)]
    for p in range(4):
        state, n = p, 0
        while found[p][state] is None:
            found[p][state] = n
            state, n = (ASSISTANT if state == USER else USER), n + 1
    return found


INSERTS = _inserts()


def _moves(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> cheapest (cost, audit) of one row, insertions before it included.

    ``code`` is 4 * class of the role's initial + fault.
    """
    initial, fault = (INITIALS + "?")[code // 4], code % 4
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        for q in range(4):
            if INSERTS[p][q] is None:
                continue
            edits = [(DELETE, "D", q)]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT else 0
                edits.append((REROLE + extra, "R", ASSISTANT if q == USER else USER))
                if (q, initial) in AFTER:
                    edits.append((KEEP + extra, "K", AFTER[q, initial]))
            for cost, letter, c in edits:
                way = (cost + INSERT * INSERTS[p][q], "I" * INSERTS[p][q] + letter)
                best[p, c] = min(best.get((p, c), way), way)
    return best


MOVES = [_moves(code) for code in range(16)]
TRAIL = [min((INSERT * INSERTS[p][q] for q in FINAL if INSERTS[p][q] is not None), default=INFINITE) for p in range(4)]


class Vectors:
    """Forward and backward cost vectors over the four states, one row at a time.

    Every audit of a stretch of rows has one letter of K, R, D per row and ends with one, and an audit fixes the
    roles; so of audits that end in different states none is a prefix of another, and their order is a rank. A
    forward vector is (costs, ranks); what one row makes of it is remembered up to a constant, so that a row costs one lookup.
    """

    def __init__(self) -> None:
        self.ahead: dict = {}
        self.behind: dict = {}

    def start(self, state: int) -> tuple:
        return tuple(0 if s == state else INFINITE for s in range(4)), (0, 0, 0, 0)

    def forward(self, codes: bytes, vector: tuple) -> tuple[int, tuple]:
        """(constant, (costs, ranks)) after ``codes``."""
        base = 0
        for code in codes:
            known = self.ahead.get((code, vector))
            if known is None:
                known = self.ahead[code, vector] = self._forward(code, vector)
            base, vector = base + known[0], known[1]
        return base, vector

    @staticmethod
    def _forward(code: int, vector: tuple) -> tuple[int, tuple]:
        costs, ranks = vector
        best: list = [None] * 4
        for (p, c), (cost, audit) in MOVES[code].items():
            if costs[p] < INFINITE:
                way = (costs[p] + cost, ranks[p], audit)
                if best[c] is None or way < best[c]:
                    best[c] = way
        least = min(b[0] for b in best if b)
        order = sorted(b[1:] for b in best if b)
        return least, (tuple(b[0] - least if b else INFINITE for b in best), tuple(order.index(b[1:]) if b else 0 for b in best))

    def backward(self, codes: bytes, costs: tuple) -> tuple:
        """Cost from each state before ``codes`` to the end, up to a constant."""
        for code in reversed(codes):
            known = self.behind.get((code, costs))
            if known is None:
                known = [INFINITE] * 4
                for (p, c), (cost, _) in MOVES[code].items():
                    known[p] = min(known[p], cost + costs[c])
                least = min(known)
                known = self.behind[code, costs] = tuple(min(k - least, INFINITE) for k in known)
            costs = known
        return costs


def crossing(costs, ranks, rest) -> int:
    """The state of a cheapest way through; of several, the one whose audit up to here is least."""
    return min((s for s in range(4) if costs[s] < INFINITE), key=lambda s: (costs[s] + rest[s], ranks[s]))


def repair(codes: bytes, start: int, end: int, vectors: Vectors) -> str:
    """The least audit of a cheapest repair of ``codes`` that leads from ``start`` to ``end``, by Hirschberg's division.

    Forward costs of the first half and backward costs of the second meet in the middle; the crossing
    splits the task in two. Space is linear: the audit, and a few vectors per level.
    """
    audit, tasks = [], [(0, len(codes), start, end)]
    while tasks:
        low, high, p, c = tasks.pop()
        if high - low == 1:
            audit.append(MOVES[codes[low]][p, c][1])
        elif high > low:
            middle = (low + high) // 2
            _, (costs, ranks) = vectors.forward(codes[low:middle], vectors.start(p))
            rest = vectors.backward(codes[middle:high], vectors.start(c)[0])
            meet = crossing(costs, ranks, rest)
            tasks += [(middle, high, meet, c), (low, middle, p, meet)]
    return "".join(audit)


def summary(codes: bytes, vectors: Vectors) -> list[int]:
    """Costs and ranks of the least audits of a piece, for each state before it and after it: 16 and 16 numbers."""
    costs, ranks = [], []
    for p in range(4):
        base, vector = vectors.forward(codes, vectors.start(p))
        costs += [base + x if x < INFINITE else INFINITE for x in vector[0]]
        ranks += vector[1]
    return costs + ranks


def states(pieces: list[list[int]]) -> tuple[int, list[int]]:
    """(cost, states) of the least audit among the cheapest repairs of a conversation given by its pieces' summaries.

    ``states`` has the state before each piece and after the last. The division is that of :func:`repair`, with
    whole pieces in place of rows.
    """

    def forward(low, high, p):
        costs, ranks = [0 if s == p else INFINITE for s in range(4)], [0] * 4
        for piece in pieces[low:high]:
            best: list = [None] * 4
            for q in range(4):
                for c in range(4):
                    if costs[q] < INFINITE and piece[4 * q + c] < INFINITE:
                        way = (costs[q] + piece[4 * q + c], ranks[q], piece[16 + 4 * q + c])
                        if best[c] is None or way < best[c]:
                            best[c] = way
            order = sorted(b[1:] for b in best if b)
            costs, ranks = [b[0] if b else INFINITE for b in best], [order.index(b[1:]) if b else 0 for b in best]
        return costs, ranks

    def backward(low, high, rest):
        for piece in reversed(pieces[low:high]):
            rest = [min(piece[4 * p + c] + rest[c] for c in range(4)) for p in range(4)]
        return rest

    costs, ranks = forward(0, len(pieces), EMPTY)
    last = crossing(costs, ranks, TRAIL)
    found, tasks = [EMPTY], [(0, len(pieces), EMPTY, last)]
    while tasks:
        low, high, p, c = tasks.pop()
        if high - low == 1:
            found.append(c)
        elif high > low:
            middle = (low + high) // 2
            ahead = forward(low, middle, p)
            meet = crossing(*ahead, backward(middle, high, [0 if s == c else INFINITE for s in range(4)]))
            tasks += [(middle, high, meet, c), (low, middle, p, meet)]
    return costs[last] + TRAIL[last], found


# Rows to pieces


def told(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``rows``: nulls of role and text are one space, other columns are left behind."""
    blank = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))


# Rows of a turn: by role, then the text's first characters, then its digest; equal rows are interchangeable.
ORDER = ["conv_id", "turn", "role", "head", "mark"]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.substring("text", 1, 32)).withColumn("mark", F.md5(F.col("text").cast("binary")))


def _keys(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in [*ORDER, *more]]


def pieces(rows: DataFrame, size: int) -> DataFrame:
    """conv_id, piece (a number that rises through the conversation), the order keys of its first row, and codes.

    Narrow rows (no texts) are range-sorted; the place in the scan cuts equal rows. Those of a conversation in one
    partition are cut every ``size`` rows, so no piece outgrows it, whatever the length of the conversation. A
    row is a duplicate if the smallest place of its digest of conversation, role and text is before its own.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    identity = F.concat_ws("|", F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("")), F.octet_length("role").cast("string"), "role", "mark")
    narrow = ordered(rows).select(
        *ORDER, F.md5(identity.cast("binary")).alias("same"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NO_FAULT).otherwise(CUT).alias("fault"),
        F.monotonically_increasing_id().alias("tie"),
    )
    lined = narrow.repartitionByRange(partitions(rows.sparkSession), *_keys("tie")).sortWithinPartitions(*_keys("tie")).drop("tie")
    lined = written(lined.withColumn("at", F.monotonically_increasing_id()))
    # Only texts that occur again have a first place to compare with: a small table, whose join Spark may split.
    firsts = lined.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    kind = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first") < F.col("at"), DUPLICATE).otherwise(F.col("fault"))
    coded = lined.join(firsts, "same", "left").select(*ORDER, "at", (kind * 4 + fault).cast("int").alias("code"))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    found = coded.groupBy("conv_id", part.alias("part"), F.floor(row / size).alias("block")).agg(
        F.min("at").alias("piece"), F.min_by(F.struct("turn", "role", "head", "mark"), "at").alias("key"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("listed")
    )
    # Codes as characters, one a row.
    return found.select("conv_id", "piece", "key.*", F.array_join(F.transform("listed", lambda x: F.chr(x["code"] + 65)), "").alias("codes"))


def _summaries(batches):
    vectors = Vectors()
    for batch in batches:
        lists = [summary(bytes(ord(c) - 65 for c in codes), vectors) for codes in batch.column("codes").to_pylist()]
        yield batch.append_column("summary", pa.array(lists, pa.list_(pa.int64())))


def _states(batches):
    """The states before and after each piece, per conversation; its last piece carries the cost."""
    for batch in batches:
        piece, before, after, cost = [], [], [], []
        for listed in batch.column("listed").to_pylist():
            total, found = states([x["summary"] for x in listed])
            piece += [x["piece"] for x in listed]
            before += found[:-1]
            after += found[1:]
            cost += [0] * (len(listed) - 1) + [total]
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(cost, pa.int64())], ["piece", "before", "after", "cost"])


def _audits(batches):
    vectors = Vectors()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("codes", "before", "after")]
        audits = [repair(bytes(ord(c) - 65 for c in codes), p, c, vectors) for codes, p, c in zip(*columns)]
        yield batch.append_column("audit", pa.array(audits, pa.string()))


def audited(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """The pieces of all conversations, each with its codes, audit and part of the cost.

    Pieces are summarised where they are; per conversation only the summaries meet (32 numbers for ``size`` rows),
    choose the states between pieces, and each piece is then repaired on its own.
    """
    cut = pieces(rows, size)
    summed = written(cut.mapInArrow(_summaries, StructType([*cut.schema.fields, StructField("summary", ArrayType(LongType()))])))
    listed = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "summary"))).alias("listed"))
    chosen = listed.select("listed").mapInArrow(_states, "piece bigint, before int, after int, cost bigint")
    joined = summed.drop("summary").join(chosen, "piece")
    return joined.mapInArrow(_audits, StructType([*joined.schema.fields, StructField("audit", StringType())]))


# Pieces and texts to repaired conversations

REPORT = (
    "conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# Kinds of streamed rows, in their order under equal keys: a conversation's name, a piece with its audit, a row.
NAME_ROW, PIECE_ROW, TEXT_ROW = range(3)


class Report:
    """One conversation as its rows stream past: counts, audit, and the digest of the repaired lines."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.audits = [0, 0, 0, 0], 0, 0, []
        self.letters, self.taken, self.state, self.kind = "", 0, EMPTY, None
        self.turns, self.low, self.high = 0, None, None
        self.digest, self.lines = hashlib.sha256(), 0

    def piece(self, codes: str, audit: str, cost: int) -> None:
        for code in map(ord, codes):
            self.faults[(code - 65) % 4] += 1
            kind = (INITIALS + "?")[(code - 65) // 4]
            self.illegal += self.kind is not None and self.kind + kind not in ("su", "ua", "au")
            self.kind = kind
        self.cost += cost
        self.audits.append(audit)
        self.letters, self.taken = self.letters[self.taken :] + audit, 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> None:
        self.state = ASSISTANT if self.state == USER else USER
        self.line(ROLES[self.state], "")

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        while self.letters[self.taken] == "I":
            self.insert()
            self.taken += 1
        letter = self.letters[self.taken]
        self.taken += 1
        if letter == "R":
            self.state = ASSISTANT if self.state == USER else USER
            self.line(ROLES[self.state], text)
        elif letter == "K":
            self.state = AFTER[self.state, role[0]]
            self.line(role, text)

    def values(self) -> tuple:
        trail = 0
        while self.state not in FINAL:
            self.insert()
            trail += 1
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        audit = "".join(self.audits) + "I" * trail
        return gaps, *self.faults[1:], self.illegal, self.cost, audit, self.digest.hexdigest()


def _reports(batches):
    """Reports of sorted rows and pieces. A piece comes before its first row; what is held is one line and the audit."""
    conversation, report, ids, out, kind_of_id = None, None, [], [], None
    for batch in batches:
        kind_of_id = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "audit", "cost")]
        for conv, kind, turn, role, text, audit, cost in zip(*columns):
            if report is None or conv != conversation:
                if report is not None:
                    ids.append(conversation)
                    out.append(report.values())
                conversation, report = conv, Report()
            if kind == PIECE_ROW:
                report.piece(text, audit, cost)
            elif kind == TEXT_ROW:
                report.row(turn, role, text)
        if len(out) >= 1000:
            yield _table(ids, out, kind_of_id)
            ids, out = [], []
    if report is not None:
        ids.append(conversation)
        out.append(report.values())
        yield _table(ids, out, kind_of_id)


def _table(ids, out, kind):
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], ["conv_id", *FIELDS])


def repaired(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """A report per conversation of ``rows`` (conv_id, turn, role, text): its faults and its cheapest repair.

    A null role or text counts as one space, null ids are one conversation, null turns come first. Rows of one turn are ordered by
    role, then text (its first 32 characters, then its MD5); equal rows are duplicates of the first. A row whose ``present`` is false,
    where that column exists, only names its conversation. A role without a character has no initial and cannot be
    kept. Further columns of any name are ignored. An empty table gives no rows.

    The digest of a repaired conversation is a chain over its lines: they stream through one task, one line at a
    time, in order; texts are shuffled once. Everything else is done in pieces of ``size`` rows.
    """
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    flagged = rows.withColumn("present", present)
    kept = told(flagged.where("present"))
    none = F.lit(None)
    cut = audited(kept, size)
    heads = cut.select("conv_id", F.lit(PIECE_ROW).alias("kind"), "turn", "role", F.col("codes").alias("text"), "head", "mark", "piece", "audit", "cost")
    lines = ordered(kept).select("conv_id", F.lit(TEXT_ROW).alias("kind"), "turn", "role", "text", "head", "mark", none.cast("long").alias("piece"), none.cast("string").alias("audit"), none.cast("long").alias("cost"))
    named = flagged.where("not present").select(
        "conv_id", F.lit(NAME_ROW).alias("kind"), none.cast(kept.schema["turn"].dataType).alias("turn"), *[none.cast("string").alias(c) for c in ("role", "text", "head", "mark")],
        none.cast("long").alias("piece"), none.cast("string").alias("audit"), none.cast("long").alias("cost"),
    )
    mixed = heads.unionByName(lines).unionByName(named)
    lined = mixed.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*_keys("kind", "piece"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return lined.select("conv_id", "kind", "turn", "role", "text", "audit", "cost").mapInArrow(_reports, REPORT.format(id=kind))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` after seeded damage, by crc32 of ``conv_id:turn`` modulo 20; ``present`` is false for dropped rows."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(F.coalesce("text", space), "[.!?]", "")).otherwise(F.coalesce("text", space))
    role = F.when(draw == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (draw != 0).alias("present"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir):
    return repaired(damaged(table(spark, sf_dir, "conversations")))


# The same dynamic programme forwards over whole rows, with audits and lines in its states; CRC-32 by its rule.
OP11_SQL = r"""
with recursive crc_table as (
  select list(v order by n) as t from (
    select n, list_reduce(list_concat([n::bigint], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                          lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
    from range(256) r(n))),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h
  from conversations),
drawn as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint % 20 as draw
  from keyed, crc_table),
damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
         case draw when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from drawn join (values (0), (1)) c(copy) on draw <> 0 and (copy = 0 or draw = 3)),
lined as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, substr(text, 1, 32), md5(text)) as rn,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as last_char, left(role, 1) as initial
  from damaged),
faulty as (
  select *, case when last_char = '' then 'blank' when row_number() over (partition by conv_id, role, text order by rn) > 1 then 'duplicate'
                 when last_char not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by rn) as before
  from lined),
ways(p, q, added, audit, lines) as (
  values ('e', 'e', 0, '', []::varchar[]), ('e', 'u', 5, 'I', ['user:']), ('e', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 's', 0, '', []),
         ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']), ('u', 'u', 0, '', []), ('u', 'a', 5, 'I', ['assistant:']),
         ('a', 'a', 0, '', []), ('a', 'u', 5, 'I', ['user:'])),
edits(q, initial, letter, cost, c) as (
  values ('e', 's', 'K', 0, 's'), ('e', 'u', 'K', 0, 'u'), ('s', 'u', 'K', 0, 'u'), ('a', 'u', 'K', 0, 'u'), ('u', 'a', 'K', 0, 'a'),
         ('e', null, 'R', 1, 'u'), ('s', null, 'R', 1, 'u'), ('a', null, 'R', 1, 'u'), ('u', null, 'R', 1, 'a'),
         ('e', null, 'D', 2, 'e'), ('s', null, 'D', 2, 's'), ('u', null, 'D', 2, 'u'), ('a', null, 'D', 2, 'a')),
moves as (
  select w.p, e.c, e.initial, e.letter, w.added + e.cost as cost, w.audit || e.letter as audit, w.lines from ways w join edits e on w.q = e.q),
named as (select distinct conv_id from conversations),
dp(conv_id, rn, state, best) as (
  select conv_id, 0::bigint, 'e', {'cost': 0, 'audit': '', 'lines': []::varchar[]} from named
  union all
  (select f.conv_id, f.rn, m.c,
          min({'cost': d.best.cost + m.cost + case when f.fault = 'truncated' and m.letter <> 'D' then 5 else 0 end, 'audit': d.best.audit || m.audit,
               'lines': list_concat(d.best.lines, list_concat(m.lines, case m.letter when 'D' then []::varchar[] when 'K' then [f.role || ':' || f.text]
                                    else [case m.c when 'u' then 'user:' else 'assistant:' end || f.text] end))})
   from dp d join faulty f on d.conv_id is not distinct from f.conv_id and f.rn = d.rn + 1
   join moves m on m.p = d.state and (m.initial is null or m.initial = f.initial) and (m.letter = 'D' or f.fault not in ('blank', 'duplicate'))
   group by f.conv_id, f.rn, m.c)),
sizes as (
  select n.conv_id, count(f.rn) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank,
         count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
         count_if(before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from named n left join faulty f on n.conv_id is not distinct from f.conv_id group by n.conv_id),
ended as (
  select s.conv_id, min({'cost': d.best.cost + w.added, 'audit': d.best.audit || w.audit, 'lines': list_concat(d.best.lines, w.lines)}) as best
  from sizes s join dp d on s.conv_id is not distinct from d.conv_id and s.n = d.rn join ways w on w.p = d.state and w.q in ('e', 'a') group by s.conv_id)
select s.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost as cost, best.audit as audit,
       sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
from sizes s join ended e on s.conv_id is not distinct from e.conv_id
"""
