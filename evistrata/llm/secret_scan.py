"""Secret scans by one deterministic automaton over all rules.

All rules are compiled together.  Their expressions, read backwards, become one automaton by
subset construction, which is minimised and kept as a transition array over classes of bytes
that no rule tells apart.  One pass over the bytes of a text, from its end to its start, marks
for every rule where a match begins.  A second array, of the rules read forwards, gives the
longest match from such a place; it runs over matches only.  Matches of one rule are taken from
the left and do not overlap; a match that fails its rule's test still uses up its characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from evistrata.llm.base import map_batches, texts, worker_state

SPAN = "struct<kind:string,start:long,end:long>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are secrets if ``keep`` (default: the same) matches just as far from their start.

    Expressions may hold ASCII literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``,
    ``{m,}`` and ``{m,n}``.  What they match must not be empty.
    """

    kind: str
    pattern: str
    keep: str | None = None


# The rules' expressions.
KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGNMENT = KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?"
BASE_RULES = (
    Rule("assign", ASSIGNMENT + "[A-Za-z0-9+/_.=-]+", ASSIGNMENT + "[A-Za-z0-9+/_.=-]{12,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14,}"),
    # the same as all runs of such characters that are long enough: a run is one match
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{16,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# --- expressions ------------------------------------------------------------------
# A node is ("bytes", set), ("all", nodes), ("any", nodes) or ("repeat", node, least, most or None).

class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        char = self.peek()
        if not char or ord(char) > 127:
            raise ValueError(f"cannot read {self.pattern!r} at {self.at}")
        self.at += 1
        return char

    def escaped(self) -> int:
        char = self.take()
        if char != "\\":
            return ord(char)
        char = self.take()
        if char == "x":
            return int(self.take() + self.take(), 16)
        if char.isalnum():
            raise ValueError(f"unknown escape in {self.pattern!r}")
        return ord(char)

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("any", options)

    def sequence(self):
        nodes = []
        while self.peek() not in ("", "|", ")"):
            nodes.append(self.repeated())
        return ("all", nodes)

    def repeated(self):
        node = self.single()
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[mark]
            if mark == "{":
                end = self.pattern.index("}", self.at)
                low, comma, high = self.pattern[self.at : end].partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
                self.at = end + 1
            node = ("repeat", node, least, most)
        return node

    def single(self):
        if self.peek() == "(":
            self.take()
            node = self.choice()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.pattern!r}")
            return node
        if self.peek() == "[":
            return self.members()
        return ("bytes", frozenset([self.escaped()]))

    def members(self):
        self.take()
        found: set[int] = set()
        while self.peek() != "]":
            low = self.escaped()
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                found.update(range(low, self.escaped() + 1))
            else:
                found.add(low)
        self.take()
        return ("bytes", frozenset(found))


def parse(pattern: str):
    reader = _Reader(pattern)
    node = reader.choice()
    if reader.peek():
        raise ValueError(f"unbalanced group in {pattern!r}")
    return node


def backwards(node):
    if node[0] == "bytes":
        return node
    if node[0] == "repeat":
        return ("repeat", backwards(node[1]), *node[2:])
    parts = [backwards(part) for part in node[1]]
    return (node[0], parts[::-1] if node[0] == "all" else parts)


# --- automata ---------------------------------------------------------------------

class _Graph:
    """States with free moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """The state reached from ``start`` by what ``node`` matches."""
        if node[0] == "bytes":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if node[0] == "all":
            for part in node[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if node[0] == "any":
            for part in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``classes`` maps a byte to its column; ``table[state, column]`` is the next state; state 0 is the first.

    ``accepts`` has a bit for each expression that a state ends, ``alive`` one for each that it can still end.
    """

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    alive: np.ndarray

    def rows(self) -> list[list]:
        """A list per state: its bits, then for each column the list of the next state."""
        rows = [[int(bits)] for bits in self.accepts]
        for row, line in zip(rows, self.table.tolist()):
            row += [rows[after] for after in line]
        return rows


def compile_all(nodes: list, anywhere: bool) -> Automaton:
    """One minimal automaton for all expressions, matching from the start of its input or from ``anywhere``."""
    graph = _Graph()
    first = graph.state()
    ends = []
    for node in nodes:
        start = graph.state()
        graph.free[first].append(start)
        ends.append(graph.add(node, start))
    bit_of = {state: 1 << i for i, state in enumerate(ends)}
    used = {allowed for moves in graph.moves for allowed, _ in moves}
    member = {byte: tuple(byte in allowed for allowed in used) for byte in range(256)}
    columns = {key: i for i, key in enumerate(dict.fromkeys(member.values()))}
    classes = np.array([columns[member[byte]] for byte in range(256)], np.uint8)
    example = {columns[member[byte]]: byte for byte in range(256)}

    opening = graph.closure([first])
    number, order, table = {opening: 0}, [opening], []
    for states in order:  # grows while it is read
        line = []
        for column in range(len(columns)):
            byte = example[column]
            after = graph.closure([target for state in states for allowed, target in graph.moves[state] if byte in allowed])
            after = after | opening if anywhere else after
            if after not in number:
                number[after] = len(order)
                order.append(after)
            line.append(number[after])
        table.append(line)
    accepts = np.array([sum(bit_of.get(state, 0) for state in states) for states in order], np.int64)
    return _alive(*_minimal(np.array(table, np.int32), accepts), classes)


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that no input tells apart become one; the first state stays number 0."""
    label = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == label.max():
            break
        label = finer
    _, where, label = np.unique(label, return_index=True, return_inverse=True)
    label = label.ravel()
    order = np.argsort(where)  # by first state, so that the first stays first
    rename = np.empty_like(order)
    rename[order] = np.arange(len(order))
    return rename[label[table[where[order]]]].astype(np.int32), accepts[where[order]]


def _alive(table: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Automaton:
    alive = accepts.copy()
    while True:
        further = alive | np.bitwise_or.reduce(alive[table], axis=1)
        if (further == alive).all():
            return Automaton(classes, table, accepts, alive)
        alive = further


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton]:
    """Where matches begin (read backwards), and how far patterns and tests reach (read forwards)."""
    if not 0 < len(rules) < 32:
        raise ValueError("from 1 to 31 rules are supported")
    patterns = [parse(rule.pattern) for rule in rules]
    tests = [parse(rule.keep or rule.pattern) for rule in rules]
    forwards = compile_all(patterns + tests, anywhere=False)
    if forwards.accepts[0]:
        raise ValueError("a rule matches the empty text")
    return compile_all([backwards(node) for node in patterns], anywhere=True), forwards


# --- scanning ---------------------------------------------------------------------

def scanner(rules: tuple[Rule, ...], compiled: tuple[Automaton, Automaton]) -> Callable[[str], list[tuple[int, int, int]]]:
    """A function from a text to its spans: rule number, start and end (exclusive) in code points, by start and rule."""
    begins, reaches = compiled
    first = begins.rows()[0]
    columns = (begins.classes + 1).astype(np.uint8).tobytes()  # place 0 of a row holds its bits
    forward, forward_columns = reaches.table.tolist(), reaches.classes.tobytes()
    accepts, alive, count = reaches.accepts.tolist(), reaches.alive.tolist(), len(rules)

    def longest(codes: bytes, start: int, rule: int) -> tuple[int, bool]:
        state, end, kept = 0, start, False
        bit, test = 1 << rule, 1 << (rule + count)
        for at in range(start, len(codes)):
            state = forward[state][codes[at]]
            if accepts[state] & bit:
                end, kept = at + 1, bool(accepts[state] & test)
            elif not alive[state] & bit:
                break
        return end, kept

    def scan(text: str) -> list[tuple[int, int, int]]:
        data = text.encode()
        row, marks = first, []
        for at, column in enumerate(data[::-1].translate(columns)):
            row = row[column]
            if row[0]:
                marks.append((len(data) - 1 - at, row[0]))
        if not marks:
            return []
        codes = data.translate(forward_columns)
        found, free = [], [0] * count
        for start, bits in reversed(marks):
            for rule in range(count):
                if bits >> rule & 1 and start >= free[rule]:
                    free[rule], kept = longest(codes, start, rule)
                    if kept:
                        found.append((start, rule, free[rule]))
        if not found:
            return []
        before = np.zeros(len(data) + 1, np.int64)  # code points before each byte
        np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=before[1:])
        return [(rule, int(before[start]), int(before[end])) for start, rule, end in sorted(found)]

    return scan


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` (``kind``, ``start`` and ``end``, exclusive, in code points) per row.

    Spans are ordered by start, then by the order of ``rules``.  Whole texts are scanned,
    however long; null and empty texts have no spans.  Rows that repeat give a row each, null
    ids stay, and an empty table gives an empty result.  The automata are compiled once, on the
    driver, and their arrays sent along; their size depends on the rules alone.
    """
    compiled = compile_rules(rules)
    key = repr(rules)
    rows = texts(docs)

    def make():
        state = worker_state("secrets", key)
        if "scan" not in state:
            state["scan"] = scanner(rules, compiled)
        find, kinds = state["scan"], [rule.kind for rule in rules]

        def work(batch):
            found = [
                [{"kind": kinds[rule], "start": start, "end": end} for rule, start, end in find(text)]
                for text in batch.column("text").to_pylist()
            ]
            return {"doc_id": batch.column("doc_id"), "spans": found}

        return work

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")
