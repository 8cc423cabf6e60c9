"""Conversation structure repair at least cost, by bitset layers.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its grammar has four states: nothing
yet, after s, after u, after a. For each turn, a machine word holds a layer of these four bits for
each cost: bit 4 * c + q is set if the rest of the conversation can be repaired from state q at
cost c. A step over a turn shifts the layers by the edit's cost and maps the state bits through the
grammar. All four states differ by at most 7 (two insertions, or one and a deletion), so
layers are counted from the lowest one and twelve are enough; words of earlier turns go no higher.
The first layer that holds the start state gives the cost; a trace over the bits, from the first
turn on, takes the least letter that a cheapest repair can have.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows),
Insert an empty user or assistant row 3; a truncated row that stays adds 3.

First only (conversation, turn, role, hash of the text) rows are sorted and walked, then the texts
with the audits, both as streams: a task holds a letter or two for each turn of one conversation,
however long it is. An audit is one value and a digest one hash over rows in order, so the rows of
one conversation pass one task; what finds duplicates before (a minimum over equal rows, summed
before the shuffle) does not.

Defined edge cases: null role or text is one space, a null turn sorts first, rows without a
conv_id are one conversation; rows of equal turn are ordered by role and hash of the text; a
conversation without rows is repaired by nothing at cost 0; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FINE, DOOMED, CUT = range(3)
_START, _SYSTEM, _USER, _ASSISTANT = (1 << k for k in range(4))
_LAYERS = 12
_FIRST = sum(1 << 4 * c for c in range(_LAYERS + 8))  # the lowest state of every layer
_ALL = (1 << 4 * _LAYERS) - 1
#: Turns whose words are kept at once; those of other blocks are made again in the trace.
BLOCK = 4096
ROLES = {"u": "user", "a": "assistant"}


def _before(word: int, initial: str) -> int:
    """The states, in every layer, from which a row of this initial leads into the word's states."""
    if initial == "u":
        into = word >> 2 & _FIRST
        return into | into << 1 | into << 3
    if initial == "a":
        return (word >> 3 & _FIRST) << 2
    return word >> 1 & _FIRST if initial == "s" else 0


def _after(states: int, initial: str) -> int:
    """The states that a row of this initial leads to."""
    if initial == "u":
        return _USER if states & (_START | _SYSTEM | _ASSISTANT) else 0
    if initial == "a":
        return _ASSISTANT if states & _USER else 0
    return _SYSTEM if initial == "s" and states & _START else 0


def _inserted(word: int) -> int:
    for _ in range(2):
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT
    return word


def _lowered(word: int) -> tuple[int, int]:
    """The word counted from its lowest layer, and that layer."""
    low = ((word & -word).bit_length() - 1) // 4
    return word >> 4 * low & _ALL, low


class Repairs:
    """Cheapest repairs of rows given as classes (initial, fault); steps are remembered, as there are few different ones."""

    def __init__(self):
        self.last = _inserted(_START | _ASSISTANT) & _ALL
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}

    @staticmethod
    def code(initial: str, fault: int) -> int:
        return "sua".find(initial or "-") % 4 * 3 + fault

    def _step(self, word: int, code: int) -> tuple[int, int]:
        known = self.steps.get((word, code))
        if known is None:
            initial, fault = "sua-"[code // 3], code % 3
            out = word << 4 * DELETE
            if fault != DOOMED:
                more = TRUNCATED if fault == CUT else 0
                out |= _before(word, initial) << 4 * (KEEP + more)
                out |= (_before(word, "u") | _before(word, "a")) << 4 * (REROLE + more)
            known = self.steps[word, code] = _lowered(_inserted(out))
        return known

    def _words(self, codes: bytes, begin: int, end: int, word: int, base: int) -> list[tuple[int, int]]:
        """(word, base) of the turns begin..end, where that of end is given."""
        out = [(word, base)]
        for k in range(end - 1, begin - 1, -1):
            word, more = self._step(word, codes[k])
            base += more
            out.append((word, base))
        out.reverse()
        return out

    def repair(self, codes: bytes) -> tuple[int, str]:
        """(cost, audit)."""
        n = len(codes)
        begins = list(range(0, n, BLOCK)) or [0]
        ends = [(self.last, 0)]
        for begin in reversed(begins):
            block = self._words(codes, begin, min(begin + BLOCK, n), *ends[-1])
            ends.append(block[0])
        word, base = ends.pop()
        layer = next(c for c in range(_LAYERS) if word >> 4 * c & _START)
        cost = left = base + layer
        audit, states = [], _START
        for begin in begins:
            end = min(begin + BLOCK, n)
            if begin or not ends:
                block = self._words(codes, begin, end, *ends.pop())
            else:
                ends.pop()
            at = begin

            def can(states: int, k: int, left: int) -> int:
                word, base = block[k - begin]  # noqa: B023
                return states & word >> 4 * (left - base) if 0 <= left - base < _LAYERS else 0

            while at < end or (end == n and left):
                inserted = can(_after(states, "u") | _after(states, "a"), at, left - INSERT)
                if at == end:
                    audit.append("I")
                    states, left = inserted, left - INSERT
                    continue
                initial, fault = "sua-"[codes[at] // 3], codes[at] % 3
                more = TRUNCATED if fault == CUT else 0
                stays = 0 if fault == DOOMED else _after(states, initial)
                turned = 0 if fault == DOOMED else _after(states, "u") | _after(states, "a")
                for letter, to, price in (("D", states, DELETE), ("I", None, INSERT), ("K", stays, KEEP + more), ("R", turned, REROLE + more)):
                    found = inserted if to is None else can(to, at + 1, left - price)
                    if found:
                        break
                audit.append(letter)
                states, left = found, left - price
                at += letter != "I"
        return cost, "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by a checksum of ``conv_id:turn``: (conv_id, turn, role, text, copies); copies is 0 for a lost row, 2 for a repeated one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def as_turns(conversations: DataFrame) -> DataFrame:
    """Rows as they are, in the form of damaged()."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "h")


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Walk:
    """Counts of one conversation while its rows pass."""

    def __init__(self):
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.initial = ""

    def add(self, turn: int | None, role: str, ending: str, first: bool, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        self.illegal += bool(self.codes) and self.initial + initial not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.initial = initial
        again = copies - 1
        if ending == "blank":
            self.blank += copies
            fault = DOOMED
        elif not first:
            self.duplicate += copies
            fault = DOOMED
        else:
            self.duplicate += again
            self.truncated += ending == "cut"
            fault = CUT if ending == "cut" else FINE
        self.codes.append(Repairs.code(initial, fault))
        self.codes += bytes([Repairs.code(initial, DOOMED)]) * again

    def result(self, repairs: Repairs) -> tuple:
        cost, audit = repairs.repair(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairs, walk, conv, any_rows, kind = Repairs(), _Walk(), None, False, None

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *_STATS, "audit"])

    for batch in batches:
        kind, found = batch.column("conv_id").type, []
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "ending", "is_first", "copies")), strict=True):
            if any_rows and key != conv:
                found.append((conv, *walk.result(repairs)))
                walk = _Walk()
            conv, any_rows = key, True
            walk.add(*row)
        if found:
            yield out(found)
    if any_rows:
        yield out([(conv, *walk.result(repairs))])


def plans(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows (conv_id, turn, role, text, copies)."""
    end = F.rtrim("text", F.lit(_SPACE))
    ending = F.when(end == "", "blank").when(F.substring(end, -1, 1).isin(".", "!", "?"), "whole").otherwise("cut")
    rows = turns.select("conv_id", "turn", "role", F.md5("text").alias("h"), ending.alias("ending"), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "h", "ending").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    firsts = rows.where("copies > 0").groupBy(F.col("conv_id").alias("conv"), F.col("role").alias("who"), F.col("h").alias("what")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("who")) & (F.col("h") == F.col("what"))
    marked = rows.join(firsts, same, "left").select("conv_id", "turn", "role", "h", "ending", "copies", F.coalesce(F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)).alias("is_first"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _in_order(marked).mapInArrow(_plan, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string")


class _Replay:
    """The repaired rows of one conversation, by its audit, while its rows pass."""

    def __init__(self, plan: tuple):
        self.plan, self.audit, self.at, self.out = plan, plan[-1], 0, 0
        stays = len(self.audit) - self.audit.count("D")
        # The length alone tells the roles: an odd one begins with s.
        self.odd = stays % 2

    def _role(self) -> str:
        return "assistant" if (self.out - self.odd) % 2 else "user"

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._role(), ""
            self.at += 1
            self.out += 1

    def add(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            yield from self._insertions()
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                yield self._role() if letter == "R" else role, text
                self.out += 1

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insertions()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple, object]]:
    """("row", (role, text), conversation's key) of every repaired row, and ("end", plan, key) after each conversation."""
    now, conv = None, None
    names = ("conv_id", "kind", "role", "text", "copies", *_STATS, "audit")
    for batch in batches:
        for key, kind, role, text, copies, *plan in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if kind == 0:
                if now:
                    for row in now.end():
                        yield "row", row, conv
                    yield "end", now.plan, conv
                now, conv = _Replay(tuple(plan)), key
            else:
                for row in now.add(role, text, copies):
                    yield "row", row, conv
    if now:
        for row in now.end():
            yield "row", row, conv
        yield "end", now.plan, conv


def _with_plans(turns: DataFrame) -> DataFrame:
    """Plans and texts, sorted so that each conversation's plan comes before its rows."""
    heads = plans(turns).withColumn("kind", F.lit(0))
    rows = turns.where("copies > 0").select("*", F.md5("text").alias("h"), F.lit(1).alias("kind"))
    return _in_order(rows.unionByName(heads, allowMissingColumns=True), "kind")


def repaired(turns: DataFrame, batch_chars: int = 1 << 22) -> DataFrame:
    """The rows of the repaired conversations: (conv_id, place, role, text), place from 0."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place, size, arrow_kind = [], 0, 0, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "place", "role", "text"])

        def typed(batches):
            nonlocal arrow_kind
            for batch in batches:
                arrow_kind = batch.column("conv_id").type
                yield batch

        for what, row, conv in _replayed(typed(batches)):
            if what == "end":
                place = 0
                continue
            rows.append((conv, place, *row))
            place += 1
            size += len(row[1]) + 32
            if size > batch_chars:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return _with_plans(turns).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def digest(turns: DataFrame) -> DataFrame:
    """plans() with repaired_sha256, the hash of the repaired ``role:text`` lines."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            break
        else:
            return

        def whole():
            yield batch
            yield from batches

        arrow_kind, found, state, begun = batch.column("conv_id").type, [], hashlib.sha256(), False

        def out() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(columns[0], arrow_kind), *(pa.array(c, pa.int64()) for c in columns[1:-2]), *(pa.array(c, pa.string()) for c in columns[-2:])]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *_STATS, "audit", "repaired_sha256"])

        for what, row, conv in _replayed(whole()):
            if what == "row":
                state.update(f"{chr(10) if begun else ''}{row[0]}:{row[1]}".encode())
                begun = True
                continue
            found.append((conv, *row, state.hexdigest()))
            state, begun = hashlib.sha256(), False
            if len(found) == 1000:
                yield out()
                found = []
        if found:
            yield out()

    return _with_plans(turns).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string, repaired_sha256 string")


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k
  FROM conversations),
f AS (
  SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::bigint)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)::bigint[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault
  FROM c),
r AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n,
         left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM r),
w AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS what,
         lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair
  FROM o),
s AS (
  SELECT conv_id, max(n) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (what = 'blank') AS blank, count(*) FILTER (what = 'duplicate') AS duplicate, count(*) FILTER (what = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM w GROUP BY conv_id),
-- e is the cheapest (cost, audit) of each grammar state: nothing yet, after s, after u, after a.
e AS (
  SELECT conv_id, 0::bigint AS n, {'c': 0::bigint, 'a': ''} AS e0, {'c': 1000000000::bigint, 'a': ''} AS e1, {'c': 3::bigint, 'a': 'I'} AS e2, {'c': 6::bigint, 'a': 'II'} AS e3
  FROM s
  UNION ALL
  SELECT conv_id, n, e0, e1, list_min([e2, {'c': e0.c + 3, 'a': e0.a || 'I'}, {'c': e1.c + 3, 'a': e1.a || 'I'}, {'c': e3.c + 3, 'a': e3.a || 'I'}]) AS e2,
         list_min([e3, {'c': e2.c + 3, 'a': e2.a || 'I'}, {'c': e0.c + 6, 'a': e0.a || 'II'}, {'c': e1.c + 6, 'a': e1.a || 'II'}]) AS e3
  FROM (
    SELECT e.conv_id, w.n,
      {'c': e0.c + 4, 'a': e0.a || 'D'} AS e0,
      list_min([{'c': e1.c + 4, 'a': e1.a || 'D'}, {'c': CASE WHEN i = 's' THEN e0.c + k ELSE 1000000000 END, 'a': e0.a || 'K'}]) AS e1,
      list_min([{'c': e2.c + 4, 'a': e2.a || 'D'}]
        || list_transform([e0, e1, e3], lambda x: {'c': CASE WHEN i = 'u' THEN x.c + k ELSE 1000000000 END, 'a': x.a || 'K'})
        || list_transform([e0, e1, e3], lambda x: {'c': x.c + k + 3, 'a': x.a || 'R'})) AS e2,
      list_min([{'c': e3.c + 4, 'a': e3.a || 'D'}, {'c': CASE WHEN i = 'a' THEN e2.c + k ELSE 1000000000 END, 'a': e2.a || 'K'}, {'c': e2.c + k + 3, 'a': e2.a || 'R'}]) AS e3
    FROM e JOIN (SELECT *, CASE WHEN what IN ('blank', 'duplicate') THEN 1000000000 WHEN what = 'truncated' THEN 3 ELSE 0 END AS k FROM w) w
      ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = e.n + 1)),
best AS (SELECT e.conv_id, list_min([e0, e3]) AS x FROM e JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.n = s.rows_),
letters AS (SELECT conv_id, x.a AS audit, unnest(range(1, length(x.a) + 1)) AS j FROM best),
edits AS (
  SELECT conv_id, j, audit[j] AS letter, length(replace(audit[1:j], 'I', '')) AS n, length(replace(audit[1:j], 'D', '')) AS place, length(replace(audit, 'D', '')) % 2 AS odd
  FROM letters),
lines AS (
  SELECT edits.conv_id, j, CASE WHEN letter = 'K' THEN role WHEN (place - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END AS line
  FROM edits JOIN w ON edits.conv_id IS NOT DISTINCT FROM w.conv_id AND greatest(edits.n, 1) = w.n
  WHERE letter <> 'D'),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS whole FROM lines GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
       coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(best.x.c, 0)::bigint AS cost,
       coalesce(best.x.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id
"""
