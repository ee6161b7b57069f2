"""Conversation structure repair by a dynamic program over runs.

A row is a symbol: the class of its role and its fault. Equal symbols in a row are one run. What a row can cost is a
matrix over the states of the wanted order (nothing yet, after system, user, assistant), and what a run of n rows can
cost is its n-th power, where costs add up and the least one counts; the powers to 2, 4, 8, ... are made once and kept.
A conversation is one product, run by run, from its end. Each entry holds the cost and how it came about: the letter of an
edit, or the two entries it was put together from; the audit is unrolled from them at the end.

Of equal costs the ASCII-least audit counts. Entries can be compared before they are put together: from one state, one
row of letters is one way through the states, so that of two audits of equal cost over the same rows none begins
with the other (what it had beyond would be insertions, which cost), and their order stays whatever follows.

Rows are damaged and judged by built-in functions. A task reads the symbols of its conversations as a sorted stream,
then their texts as another one, with the audit in front of its conversation's rows. So a conversation of any
length needs the memory of its symbols and audit (the result holds both in one value anyway), never of its texts; SHA-256
takes a text in order, so one task has to see all of one conversation. One symbol (two numbers) a row is all that
is shuffled for the first stream.

Defined cases: a null in any column counts as one space where it is text; a null conv_id is a conversation; rows of one
turn go by role, then by MD5 of the text; repeated rows are rows (of which the later are duplicates); a conversation
whose rows are all dropped gives zeros, an empty audit and the hash of no text; an empty table gives an empty
table; other columns are left out, whatever their names. Very long texts are hashed as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, staged, table

#: States: nothing yet, after the system's row, after a user's, after an assistant's. They end well at the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where a row of each role leads from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Classes of roles by their first letter, and faults; a symbol is 4 * class + fault.
ROLES, SOUND, CUT, BLANK, DUPLICATE = "sua?", 0, 1, 2, 3
DROPPED = -1
#: Symbol strings whose repairs a task remembers, up to this length.
REMEMBERED, REMEMBERED_LENGTH = 50_000, 64


# --- the dynamic program


class Audit:
    """Letters, or two audits one after the other; `str` unrolls it."""

    __slots__ = ("first", "length", "second")

    def __init__(self, first, second=None):
        self.first, self.second = first, second
        self.length = len(first) if second is None else first.length + second.length

    def letters(self) -> Iterator[str]:
        left = [self]
        while left:
            x = left.pop()
            if x.second is None:
                yield x.first
            else:
                left += [x.second, x.first]

    def __str__(self) -> str:
        return "".join(self.letters())

    def before(self, other: Audit) -> bool:
        """Whether this audit is the ASCII-lesser one. Shared parts are passed over unread."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b:
                continue
            if a.second is not None and (b.second is None or a.length >= b.length):
                mine += [a.second, a.first]
                theirs.append(b)
            elif b.second is not None:
                mine.append(a)
                theirs += [b.second, b.first]
            else:
                n = min(len(a.first), len(b.first))
                if a.first[:n] != b.first[:n]:
                    return a.first < b.first
                mine += [Audit(a.first[n:])] if a.first[n:] else []
                theirs += [Audit(b.first[n:])] if b.first[n:] else []
        return bool(theirs)


Entry = tuple[int, Audit]
Matrix = list[list[Entry | None]]


def lesser(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or a[1].before(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * len(b[0]) for _ in a]
    for p, row in enumerate(a):
        for q in range(len(b[0])):
            for k, x in enumerate(row):
                y = b[k][q]
                if x is not None and y is not None and (out[p][q] is None or x[0] + y[0] <= out[p][q][0]):
                    out[p][q] = lesser(out[p][q], (x[0] + y[0], Audit(x[1], y[1])))
    return out


def inserted() -> dict[int, dict[int, tuple[int, str]]]:
    """Insertions that lead from each state to each: none, one or two. More would pass a state again."""
    out = {p: {p: (0, "")} for p in range(4)}
    for p in range(4):
        for q in {STEPS[r][p] for r in "ua" if p in STEPS[r]}:
            out[p].setdefault(q, (INSERT, "I"))
            for z in {STEPS[r][q] for r in "ua" if q in STEPS[r]}:
                out[p].setdefault(z, (2 * INSERT, "II"))
    return out


INSERTED = inserted()


def of_row(symbol: int) -> Matrix:
    """What one row can cost from each state to each, insertions before it included."""
    role, fault = ROLES[symbol // 4], symbol % 4
    out: Matrix = [[None] * 4 for _ in range(4)]

    def offer(p: int, q: int, cost: int, letters: str) -> None:
        out[p][q] = lesser(out[p][q], (cost, Audit(letters)))

    for p in range(4):
        for at, (cost, letters) in INSERTED[p].items():
            offer(p, at, cost + DELETE, letters + "D")
            if fault in (SOUND, CUT):
                extra = TRUNCATED if fault == CUT else 0
                if at in STEPS.get(role, {}):
                    offer(p, STEPS[role][at], cost + KEEP + extra, letters + "K")
                for r in "ua":
                    if at in STEPS[r]:
                        offer(p, STEPS[r][at], cost + REROLE + extra, letters + "R")
    return out


class Repairs:
    """Cheapest repairs of symbol strings."""

    def __init__(self):
        self.powers: dict[tuple[int, int], Matrix] = {}
        self.known: dict[bytes, tuple[int, str]] = {}
        #: from each state to a good end
        self.last = []
        for p in range(4):
            cost, letters = min(way for q, way in INSERTED[p].items() if q in ENDS)
            self.last.append((cost, Audit(letters)))

    def power(self, symbol: int, k: int) -> Matrix:
        """The matrix of 2^k rows of a symbol."""
        if (found := self.powers.get((symbol, k))) is None:
            half = self.power(symbol, k - 1) if k else None
            found = self.powers[symbol, k] = product(half, half) if k else of_row(symbol)
        return found

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(cost, audit); symbols of which only deletion remains count as one."""
        if (found := self.known.get(symbols)) is None:
            ends: Matrix = [[last] for last in self.last]
            plain = bytes(BLANK if s % 4 in (BLANK, DUPLICATE) else s for s in symbols)
            for symbol, run in reversed([(s, sum(1 for _ in rows)) for s, rows in groupby(plain)]):
                for k in range(run.bit_length()):
                    if run >> k & 1:
                        ends = product(self.power(symbol, k), ends)
            cost, audit = ends[START][0]
            found = cost, str(audit)
            if len(symbols) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[symbols] = found
        return found


# --- damage and faults


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): a test's damage by a rule of conversation and turn. Dropped rows stay, marked."""
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")).alias("text"),
        (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.sequence(F.lit(1), "times")).alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, symbol) of the rows that `damaged` gives, each conversation in order in one partition."""
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), "dropped",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("class"),
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), BLANK).when(F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), SOUND).otherwise(CUT).alias("fault"),
    )
    same = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    again = F.row_number().over(same) > 1
    seen = narrow.repartition("conv_id").withColumn("fault", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")))
    symbol = F.when(F.col("dropped"), DROPPED).otherwise(4 * F.col("class") + F.col("fault"))
    return seen.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "turn", symbol.cast("int").alias("symbol"))


REPAIRS_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FOLLOWS = {(0, 1), (1, 2), (2, 1)}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """The rows as a batch; schema is DDL of longs and strings."""
    fields = pa.schema([(name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in map(str.split, schema.split(", "))])
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types, strict=True)], schema=fields)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """REPAIRS_SQL of each conversation of damaged rows."""

    def judged(conv_id: int | None, own: Iterable[tuple], repairs: Repairs) -> tuple:
        symbols, low, high, turns = bytearray(), None, None, 0
        for _, turn, symbol in own:
            if symbol == DROPPED:
                continue
            symbols.append(symbol)
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        gaps = high - low + 1 - turns if turns else 0
        count = [sum(symbols.count(4 * c + fault) for c in range(len(ROLES))) for fault in (BLANK, DUPLICATE, CUT)]
        illegal = sum((a // 4, b // 4) not in FOLLOWS for a, b in pairwise(symbols))
        return conv_id, gaps, *count, illegal, *repairs.repair(bytes(symbols))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = (judged(conv_id, own, repairs) for conv_id, own in groupby(stream, key=itemgetter(0)))
        while some := list(islice(found, 1000)):
            yield batch_of(some, REPAIRS_SQL)

    return faults(rows).mapInArrow(run, REPAIRS_SQL)


class Repairer:
    """Follows an audit through a conversation's rows; gives the lines that stay, role and text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def wanted(self) -> str:
        """The role of a row that an edit makes here."""
        role = "a" if self.state == USER else "u"
        self.state = STEPS[role][self.state]
        return NAMES[role]

    def insertions(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.wanted(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[0]][self.state]
            yield role, text
        elif edit == "R":
            yield self.wanted(), text


def repaired_stream(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Audits and rows of conversations as one ordered stream: (conv_id, is_row, role, text), the audit as text first."""
    own = rows.filter("not dropped").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "text", F.md5("text").alias("digest"))
    first = repairs.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"))
    whole = own.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.asc_nulls_first("turn"), "role", "digest")
    return whole.select("conv_id", "is_row", "role", "text")


def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[tuple[int | None, str | None, str | None]]]:
    """For each batch of the stream its repaired (conv_id, role, text); a conversation begins with role and text null."""
    conv_id = repairer = None

    def lines(batch: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal conv_id, repairer
        for c, is_row, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if is_row:
                found = repairer.row(role, text)
            else:
                yield from ((conv_id, *line) for line in (repairer.insertions() if repairer else ()))
                conv_id, repairer, found = c, Repairer(text), [(None, None)]
            yield from ((conv_id, *line) for line in found)

    for batch in batches:
        yield lines(batch)
    yield ((conv_id, *line) for line in (repairer.insertions() if repairer else ()))


LINES_SQL = "conv_id long, role string, text string"


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations' rows, each conversation in order in one partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in followed(batches):
            yield batch_of([x for x in lines if x[1] is not None], LINES_SQL)

    return repaired_stream(rows, repairs).mapInArrow(run, LINES_SQL)


DIGESTS_SQL = "id long, repaired_sha256 string"


def digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(id, repaired_sha256): the hash of each repaired conversation's lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, begun = None, None, False
        for lines in followed(batches):
            out = []
            for conv_id, role, text in lines:
                if role is None:
                    if digest:
                        out.append((current, digest.hexdigest()))
                    current, digest, begun = conv_id, hashlib.sha256(), False
                else:
                    digest.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                    begun = True
            yield batch_of(out, DIGESTS_SQL)
        if digest:
            yield batch_of([(current, digest.hexdigest())], DIGESTS_SQL)

    return repaired_stream(rows, repairs).mapInArrow(run, DIGESTS_SQL)


def op12(spark, sf_dir):
    rows = damaged(table(spark, sf_dir, "conversations"))
    repairs = staged(plan_repairs(rows), "repairs")
    found = digests(rows, repairs)
    return repairs.join(found, repairs.conv_id.eqNullSafe(found.id)).drop("id")


# --- the same in SQL: the program row by row


def _step(cost: int, letter: str, after: str) -> str:
    """A way (ten digits of cost, then letters) with an edit before it."""
    return f"printf('%010d', CAST({after}[1:10] AS INT) + {cost}) || '{letter}' || {after}[11:]"


def _row(state: str) -> str:
    keep = {"e": "WHEN 's' THEN %s WHEN 'u' THEN %s", "s": "WHEN 'u' THEN %s", "u": "WHEN 'a' THEN %s", "a": "WHEN 'u' THEN %s"}[state]
    leads = {"e": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]
    kept = keep % tuple(_step(KEEP, "K", f"w.{x}") for x in leads)
    cut = "CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END"
    plus = lambda way: f"(SELECT printf('%010d', CAST(x[1:10] AS INT) + {cut}) || x[11:] FROM (SELECT {way} AS x))"
    edits = f"least({plus(f'CASE r.initial {kept} END')}, {plus(_step(REROLE, 'R', f'w.{leads[-1]}'))})"
    return f"least({_step(DELETE, 'D', f'w.{state}')}, CASE WHEN r.fault IN ('blank', 'duplicate') THEN NULL ELSE {edits} END)"


_CRC = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295)"

OP12_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT *, {_CRC} % 20 AS kind FROM given
), hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt
), judged AS (
  SELECT conv_id, turn, role, text, i, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'sound' END AS fault
  FROM placed
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), ways AS (
  SELECT conv_id, n AS i, '0000000000' AS e, '0000000004II' AS s, '0000000002I' AS u, '0000000000' AS a FROM figures
  UNION ALL
  SELECT conv_id, i - 1, least(ge, {_step(2, "I", "gu")}, {_step(4, "II", "ga")}), least(gs, {_step(2, "I", "gu")}, {_step(4, "II", "ga")}),
    least(gu, {_step(2, "I", "ga")}), least(ga, {_step(2, "I", "gu")})
  FROM (SELECT w.conv_id, w.i, {_row("e")} AS ge, {_row("s")} AS gs, {_row("u")} AS gu, {_row("a")} AS ga
    FROM ways w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE w.i > 0)
), found AS (
  SELECT conv_id, CAST(e[1:10] AS BIGINT) AS cost, e[11:] AS audit FROM ways WHERE i = 0
), letters AS (
  SELECT conv_id, j, audit[j:j] AS letter, length(replace(audit[1:j], 'I', '')) AS i FROM found, unnest(range(1, length(audit) + 1)) AS t(j)
), kept AS (
  SELECT l.conv_id, l.j, l.letter, r.role, r.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS place,
    first_value(l.letter = 'K' AND r.initial = 's') OVER (PARTITION BY l.conv_id ORDER BY l.j) AS led
  FROM letters l LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE l.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
  coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit,
  sha256(coalesce(t.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN found w ON w.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
