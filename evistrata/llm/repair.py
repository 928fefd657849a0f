"""Cheapest repair of conversation structure by grammar-compressed dynamic programming.

A conversation is a string with one symbol per row: the initial of its role and its first fault.
Repairing it means walking a four-state machine of the legal role orders: before any row, after
the system row, after a user row, after an assistant row.  What a symbol costs between any two
states is a matrix over (min, +), and a string's matrix is the product of its symbols'.

1. Rows become symbols.  Copies are counted before anything moves; a text seen before is known
   from the least turn of each text.  Rows travel as digests, dealt by ranges of their order, so
   a conversation with a third of all rows is cut into stretches.
2. Re-Pair over the distinct strings of all conversations: each round counts neighbouring
   symbols in one distributed aggregate and gives the most frequent pairs new symbols.  The
   rules alone reach the driver, ``Settings.rules`` of them at most; fewer cost time only.
3. Bottom-up, each rule's matrix is the product of its two parts' matrices.  An entry is a
   cost and a rope of edit initials, which shares its halves with other ropes; ropes of equal
   cost are compared through hashes of their halves.
4. Each distinct string is the product of the few symbols left of it, computed once for all
   conversations that have it.
5. The repaired rows are made by reading a conversation in order behind its edits.  Nothing is
   held but the edits, one byte per row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evistrata.llm.base import map_batches, stage

# Costs of the edits, and white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

#: A symbol for each role initial (other roles last): sound, truncated, blank, duplicate rows.
SOUND, CUT, BLANK, TWICE = "suao", "SUAO", "1234", "5678"
#: In strings of symbols for the machine, rows that must go look alike.
GONE = "d"
BEFORE, SYSTEM, USER, ASSISTANT = range(4)
FIRST_RULE = 0x100
#: Symbols that a stretch of a conversation has at most.
STRETCH = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Bounds of the grammar, which change cost only: rules in all and per round, and occurrences that earn a rule."""

    rules: int = 4096
    per_round: int = 64
    least: int = 4


# --- ropes ------------------------------------------------------------------------

class Ropes:
    """Strings made by joining earlier ones; number 0 is empty.  Equal strings have equal hashes."""

    PRIME, BASE = (1 << 61) - 1, 911382323

    def __init__(self) -> None:
        self.halves: list = [None]
        self.sizes, self.hashes, self.powers = [0], [0], [1]

    def _add(self, halves, size: int, hashed: int, power: int) -> int:
        self.halves.append(halves)
        self.sizes.append(size)
        self.hashes.append(hashed)
        self.powers.append(power)
        return len(self.sizes) - 1

    def letter(self, value: str) -> int:
        return self._add(value, 1, ord(value), self.BASE)

    def join(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        hashed = (self.hashes[a] * self.powers[b] + self.hashes[b]) % self.PRIME
        return self._add((a, b), self.sizes[a] + self.sizes[b], hashed, self.powers[a] * self.powers[b] % self.PRIME)

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` sorts before string ``b``: both are opened only where they differ."""
        left, right = [a] if a else [], [b] if b else []
        while left and right:
            x, y = left.pop(), right.pop()
            if x == y or self.sizes[x] == self.sizes[y] and self.hashes[x] == self.hashes[y]:
                continue
            if self.sizes[x] == self.sizes[y] == 1:
                return self.halves[x] < self.halves[y]
            if self.sizes[x] >= self.sizes[y]:
                left += reversed(self.halves[x])
                right.append(y)
            else:
                right += reversed(self.halves[y])
                left.append(x)
        return bool(right)

    def text(self, a: int) -> str:
        out, todo = [], [a] if a else []
        while todo:
            x = todo.pop()
            if self.sizes[x] == 1:
                out.append(self.halves[x])
            else:
                todo += reversed(self.halves[x])
        return "".join(out)

    def forget(self, count: int) -> None:
        """Drop all ropes but the first ``count``."""
        del self.halves[count:], self.sizes[count:], self.hashes[count:], self.powers[count:]


class Machine:
    """Transfer matrices over (cost, ASCII-least edits); an entry is ``(cost, rope)``, None if there is no way.

    A rope cannot be the start of another of equal cost between the same states: both have an
    edit per row, so the longer one has more inserts and costs more.  Hence the least rope of a
    whole is made of the least ropes of its parts.
    """

    def __init__(self) -> None:
        self.ropes = Ropes()
        keep, rerole, delete, insert = map(self.ropes.letter, "KRDI")
        two = self.ropes.join(insert, insert)
        self.inserts = [
            [(0, 0), None, (INSERT, insert), (2 * INSERT, two)],
            [None, (0, 0), (INSERT, insert), (2 * INSERT, two)],
            [None, None, (0, 0), (INSERT, insert)],
            [None, None, (INSERT, insert), (0, 0)],
        ]
        self.matrices: dict[str, list] = {}
        ways = [(BEFORE, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a")]
        for symbol in SOUND + CUT + GONE:
            step: list[list] = [[None] * 4 for _ in range(4)]
            for state in range(4):
                step[state][state] = (DELETE, delete)
            if symbol != GONE:
                more, role = TRUNCATED * (symbol in CUT), symbol.lower()
                if role == "s":
                    step[BEFORE][SYSTEM] = (KEEP + more, keep)
                for start, end, wanted in ways:
                    step[start][end] = (KEEP + more, keep) if role == wanted else (REROLE + more, rerole)
            self.matrices[symbol] = self.product(step, self.inserts)

    @classmethod
    def known(cls, ropes: dict, matrices: dict) -> Machine:
        machine = cls()
        vars(machine.ropes).update(ropes)
        machine.matrices = matrices
        return machine

    def row_times(self, row: list, matrix: list) -> list:
        out: list = [None] * 4
        for middle, entry in enumerate(row):
            if entry is None:
                continue
            for end, step in enumerate(matrix[middle]):
                if step is None or out[end] is not None and entry[0] + step[0] > out[end][0]:
                    continue
                way = (entry[0] + step[0], self.ropes.join(entry[1], step[1]))
                if out[end] is None or way[0] < out[end][0] or self.ropes.less(way[1], out[end][1]):
                    out[end] = way
        return out

    def product(self, left: list, right: list) -> list:
        return [self.row_times(row, right) for row in left]

    def learn(self, rules: list[str]) -> Machine:
        """Matrices of the rules, each a pair of symbols known before it."""
        for number, pair in enumerate(rules):
            self.matrices[chr(FIRST_RULE + number)] = self.product(self.matrices[pair[0]], self.matrices[pair[1]])
        return self

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """Cost and edits of a string; the ropes made on the way are dropped."""
        known = len(self.ropes.sizes)
        row = self.inserts[BEFORE]
        for symbol in symbols:
            row = self.row_times(row, self.matrices[symbol])
        nothing, ended = row[BEFORE], row[ASSISTANT]
        best = ended
        if nothing is not None and (nothing[0] < ended[0] or nothing[0] == ended[0] and self.ropes.less(nothing[1], ended[1])):
            best = nothing
        found = best[0], self.ropes.text(best[1])
        self.ropes.forget(known)
        return found


# --- rows to symbols --------------------------------------------------------------

def prepared(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times, digest``: null roles and texts are one space; ``times`` defaults to 1."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _symbol(place: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), place, F.lit(1))


def _marked(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, times, symbol, again`` (the symbol of further copies); equal rows are one."""
    blank, cut = ~F.col("text").rlike(NOT_BLANK), ~F.col("text").rlike(ENDED)
    narrow = rows.select("conv_id", "turn", "role", "digest", "times", blank.alias("blank"), cut.alias("cut"))
    once = narrow.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = once.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("earliest"))
    same = [F.col(f"o.{name}").eqNullSafe(F.col(f"e.{name}")) for name in ("conv_id", "role", "digest")]
    joined = once.alias("o").join(earliest.alias("e"), same).select("o.*", (order.eqNullSafe(F.col("earliest"))).alias("first"))
    initial = F.instr(F.lit(SOUND[:3]), F.substring("role", 1, 1))
    place = F.when((F.length("role") > 0) & (initial > 0), initial).otherwise(len(SOUND))
    again = F.when(F.col("blank"), _symbol(place, BLANK)).otherwise(_symbol(place, TWICE))
    symbol = F.when(F.col("blank") | ~F.col("first"), again).when(F.col("cut"), _symbol(place, CUT)).otherwise(_symbol(place, SOUND))
    return joined.select("conv_id", "turn", "role", "digest", "times", symbol.alias("symbol"), again.alias("again"))


def _strings(marked: DataFrame) -> DataFrame:
    """``conv_id`` and ``symbols``: its rows in order.

    Rows are dealt by ranges of (conversation, order), so a long conversation is spread over
    tasks; what comes together in one row is a byte per row of the conversation.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        current, pieces, size = None, [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal pieces, size, number
            if pieces:
                out.append((current, part, number, "".join(pieces)))
                number += 1
                pieces, size = [], 0

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 4
            ready = pa.RecordBatch.from_arrays([pa.array(list(columns[i]), field.type) for i, field in enumerate(fields)], schema=fields)
            out.clear()
            return ready

        fields = None
        for batch in batches:
            if fields is None:
                fields = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("number", pa.int64()), ("symbols", pa.string())])
            for conv_id, times, symbol, again in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "times", "symbol", "again"))):
                if conv_id != current or size >= STRETCH:
                    close()
                    current = conv_id
                pieces.append(symbol)
                left = times - 1
                while left:
                    some = min(left, STRETCH)
                    pieces.append(again * some)
                    left -= some
                    size += some
                    if size >= STRETCH:
                        close()
                size += 1
            yield table()
        close()
        if fields is not None:
            yield table()

    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "times", "symbol", "again")
    cut = ordered.mapInArrow(stretches, f"conv_id {kind}, part int, number long, symbols string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "symbols"))), lambda s: s["symbols"]), "")
    return cut.groupBy("conv_id").agg(joined.alias("symbols"))


# --- grammar ------------------------------------------------------------------------

def grammar(strings: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[str]]:
    """``dp, now`` (``dp`` shortened by the rules) for the distinct strings ``dp``, and the rules.

    Pairs of one round do not share a symbol as left of one and right of another, so their
    replacements do not get in each other's way.
    """
    now = stage(strings.select("dp", F.col("dp").alias("now")), "grammar")
    rules: list[str] = []

    def make():
        def work(batch):
            pairs: Counter = Counter()
            for text in batch.column("now").to_pylist():
                pairs.update(map("".join, zip(text, text[1:])))
            return {"pair": list(pairs), "times": list(pairs.values())}

        return work

    while len(rules) < settings.rules:
        counts = map_batches(now.select("now"), make, "pair string, times long").groupBy("pair").agg(F.sum("times").alias("times"))
        room = min(settings.per_round, settings.rules - len(rules))
        chosen: list[str] = []
        for row in counts.filter(F.col("times") >= settings.least).orderBy(F.desc("times"), "pair").limit(4 * settings.per_round).collect():
            pair = row["pair"]
            if len(chosen) < room and not any(pair[0] == other[1] or pair[1] == other[0] for other in chosen):
                chosen.append(pair)
        if not chosen:
            break
        shorter = F.col("now")
        for pair in chosen:
            shorter = F.replace(shorter, F.lit(pair), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append(pair)
        now = stage(now.select("dp", shorter.alias("now")), "grammar")
    return now, rules


def _edits(strings: DataFrame, settings: Settings) -> DataFrame:
    """``dp, cost, audit`` of the distinct strings."""
    short, rules = grammar(strings, settings)
    machine = Machine().learn(rules)
    shared = strings.sparkSession.sparkContext.broadcast((vars(machine.ropes), machine.matrices))

    def make():
        machine = Machine.known(*shared.value)

        def work(batch):
            found = [machine.cheapest(text) for text in batch.column("now").to_pylist()]
            return {"dp": batch.column("dp"), "cost": [cost for cost, _ in found], "audit": [audit for _, audit in found]}

        return work

    return map_batches(short, make, "dp string, cost long, audit string")


# --- the operator -------------------------------------------------------------------

def plan_repair(rows: DataFrame, ids: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and optionally ``times`` (copies that
    follow each other); further columns do not matter.  Rows are taken by turn, nulls first, and
    rows of one turn by role and digest of the text.  A null role or text is one space.  A row's
    first fault counts: blank, duplicate (role and text of an earlier row), truncated.
    ``audit`` has the initials of the cheapest edits (keep, rerole, delete, insert) that leave an
    optional system row and pairs of user and assistant rows, or nothing; the ASCII-least of
    them.  ``gaps`` counts the turns that lack between the least and the greatest (0 if that is no
    long).  ``ids`` names the conversations to report, also those without rows: zeros and no edits.  Null
    ids are a conversation of their own.  No rows and no ids give an empty result.
    """
    marked = stage(_marked(prepared(rows)), "marked")
    strings = stage(_strings(marked), "strings")
    strings = strings.withColumn("dp", F.translate("symbols", BLANK + TWICE, GONE * 8))
    edits = _edits(strings.select("dp").distinct(), settings)
    turns = marked.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    width = F.try_add(F.try_subtract(F.col("high").cast("long"), F.col("low").cast("long")), 1 - F.col("turns"))
    gaps = turns.select("conv_id", F.coalesce(width, F.lit(0)).cast("long").alias("gaps"))

    def number(symbols: str) -> Column:
        return (F.length("symbols") - F.length(F.translate("symbols", symbols, ""))).cast("long")

    roles = F.translate("symbols", CUT + BLANK + TWICE, SOUND * 3)
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    planned = strings.join(edits, "dp").select(
        "conv_id", number(BLANK).alias("blank"), number(TWICE).alias("duplicate"), number(CUT).alias("truncated"),
        (F.length("symbols") - 1 - legal).cast("long").alias("illegal"), "cost", "audit",
    )
    same = F.col("p.conv_id").eqNullSafe(F.col("g.conv_id"))
    found = planned.alias("p").join(gaps.alias("g"), same).select("p.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    if ids is None:
        return found
    wanted = ids.select("conv_id").distinct()
    zero = [F.coalesce(name, F.lit(0)).alias(name) for name in found.columns[1:-1]]
    joined = wanted.alias("w").join(found.alias("f"), F.col("w.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return joined.select("w.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


class _Walk:
    """Goes through the rows of one conversation behind its edits."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.state, self.out = conv_id, audit, 0, BEFORE, 0

    def _next_role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.out += 1
            yield self.conv_id, self.out, self._next_role(), "", "I", None

    def row(self, role: str, text: str, turn) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.out += 1
        if edit == "K" and role[:1] == "s":
            self.state = SYSTEM
        else:
            wanted = self._next_role()
            role = role if edit == "K" else wanted
        yield self.conv_id, self.out, role, text, edit, turn


def _walked(rows: DataFrame, plan: DataFrame, make_sink, schema: str) -> DataFrame:
    """Read every conversation in order, its plan first; ``make_sink`` takes repaired rows and gives output rows.

    One task reads a conversation from beginning to end, which a digest of it needs, but holds
    no more than its edits and one batch of rows.
    """
    rows = prepared(rows)
    nothing = {name: F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in ("turn", "role", "text", "times", "digest")}
    heads = plan.select("conv_id", *nothing.values(), "audit", F.lit(0).alias("kind"))
    both = rows.withColumn("audit", F.lit(None).cast("string")).withColumn("kind", F.lit(1)).unionByName(heads)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    names = ("conv_id", "kind", "turn", "role", "text", "times", "audit")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, sink, out = None, make_sink(), []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(target)
            ready = pa.RecordBatch.from_arrays([pa.array(list(values), field.type) for values, field in zip(columns, target)], schema=target)
            out.clear()
            return ready

        def end() -> None:
            if walk is not None:
                for repaired in walk.inserted():
                    out.extend(sink.take(repaired))
                out.extend(sink.end(walk.conv_id))

        for batch in batches:
            for conv_id, kind, turn, role, text, times, audit in zip(*(batch.column(name).to_pylist() for name in names)):
                if kind == 0:
                    end()
                    walk = _Walk(conv_id, audit)
                    continue
                if walk is None or conv_id != walk.conv_id:
                    continue  # not planned
                for _ in range(times):
                    for repaired in walk.row(role, text, turn):
                        out.extend(sink.take(repaired))
            yield table()
        end()
        if out:
            yield table()

    return both.select(*names).mapInArrow(run, schema)


class _Rows:
    def take(self, row: tuple) -> list[tuple]:
        return [row]

    def end(self, conv_id) -> list[tuple]:
        return []


class _Digest:
    def __init__(self) -> None:
        self.hash, self.empty = sha256(), True

    def take(self, row: tuple) -> list[tuple]:
        self.hash.update(("" if self.empty else "\n").encode() + f"{row[2]}:{row[3]}".encode())
        self.empty = False
        return []

    def end(self, conv_id) -> list[tuple]:
        found = [(conv_id, self.hash.hexdigest())]
        self.__init__()
        return found


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit, turn`` of the repaired conversations; inserted rows have no turn.

    ``plan`` is a written table made by :func:`plan_repair` of the same ``rows``.
    """
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("conv_id", "turn")}
    return _walked(rows, plan, _Rows, f"conv_id {kinds['conv_id']}, position long, role string, text string, edit string, turn {kinds['turn']}")


def repaired_digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``: the SHA-256 of each repaired conversation's ``role:text``, joined by line ends."""
    return _walked(rows, plan, _Digest, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
