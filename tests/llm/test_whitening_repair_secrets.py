"""Whitening, conversation repair and secret scans: exact versions, and nulls, empty values, ties, repeats, no rows, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evistrata.llm import repair, secret_scan, whitening
from evistrata.llm.queries import QUERIES, damage

SF_DIR = "/root/testdata/sf0.001"


# --- whitening -----------------------------------------------------------------

def symmetric(kind: int, d: int, draw) -> np.ndarray:
    turn = np.linalg.qr(draw.normal(size=(d, d)))[0]
    if kind == 0:
        return np.cov(draw.normal(size=(d, d + 5))).reshape(d, d)
    if kind == 1:  # eigenvalues three by three
        return turn @ np.diag(np.repeat(draw.uniform(1, 3, (d + 2) // 3), 3)[:d]) @ turn.T
    if kind == 2:
        return np.diag(draw.integers(0, 4, d).astype(float))
    if kind == 3:  # half the rank
        half = draw.normal(size=(max(1, d // 2), d))
        return half.T @ half
    return turn @ np.diag(10.0 ** draw.uniform(-8, 8, d)) @ turn.T


@pytest.mark.parametrize("kind", range(5))
def test_components_are_eigenvectors_to_double_precision(kind):
    draw = np.random.default_rng(kind)
    for d in [1, 2, 3, 5, 17, 40, 64]:
        matrix = symmetric(kind, d, draw)
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.leading_components(matrix, 8)
        want = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
        top = max(want.max(initial=0.0), 1e-300)
        assert np.abs(values - want).max(initial=0.0) <= 1e-12 * top
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0.0) <= 1e-12
        assert np.abs(matrix @ vectors - vectors * values).max(initial=0.0) <= 1e-11 * top
        if kind in (0, 1):
            assert len(values) == min(8, d)


def test_sturm_counts_are_ranks():
    draw = np.random.default_rng(3)
    diagonal, off = draw.normal(size=20), draw.normal(size=19)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    points = draw.uniform(-4, 4, 50)
    assert whitening.sturm_counts(diagonal, off, points).tolist() == [int((values < p).sum()) for p in points]


def check_whitened(rows, vectors):
    """Rows of ``components_of`` beside a plain computation; ``vectors`` maps ids to usable embeddings."""
    ids = list(vectors)
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in vectors[i]] for i in ids])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    got = {}
    for r in rows:
        got.setdefault(r.component, {})[r.vec_id] = r
    count = len(got)
    assert sorted(got) == list(range(1, count + 1)) and count == min(8, int((values > 1e-9 * values[0]).sum()))
    for k, of in got.items():
        assert set(of) == set(ids)
        want = centred @ axes[:, k - 1] / np.sqrt(values[k - 1])
        found = np.array([of[i].whitened for i in ids])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-8
        for i, row, whole in zip(ids, (of[i] for i in ids), x):
            assert row.n == n and row.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(whole, sums))
            assert abs(row.explained - values[k - 1] / values.sum()) < 1e-10 and row.identity_error < 1e-9


def test_whitening_query_equals_a_plain_computation(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    check_whitened(QUERIES["op11_embedding_whitening"](spark, SF_DIR).collect(), vectors)


def test_whitening_of_awkward_vectors(spark):
    draw = np.random.default_rng(2)
    good = {i: [float(v) for v in draw.normal(size=5)] for i in range(40)}
    good[40] = good[41] = good[7]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, label int, n string, whitened string"
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in [*good.items(), *bad]], schema).repartition(6)
    stored = {r.vec_id: r.embedding for r in frame.collect()}
    check_whitened(whitening.components_of(frame).collect(), {i: stored[i] for i in good})
    assert whitening.components_of(frame.filter("vec_id >= 100 and vec_id <> 105")).count() == 0
    assert whitening.components_of(frame.filter("vec_id = 7")).count() == 0  # no variance, no component
    twice = whitening.whiten(frame.filter("vec_id < 3").unionByName(frame.filter("vec_id < 3")).withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(twice) == 6 and all(r.vec_id is None and r.n == 6 for r in twice)
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def test_covariance_is_added_up_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    vectors = {i: [float(v) for v in np.random.default_rng(i).normal(size=3)] for i in range(30)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(9)
    check_whitened(whitening.components_of(frame).collect(), vectors)


# --- conversation repair ----------------------------------------------------------

SPACE = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cost, edits and repaired rows by trying everything: every edit of every row and up to two inserts between rows."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for extra in inserts:
                whole = out + [(role, "") for role in extra]
                way = (cost + 3 * len(extra), audit + "I" * len(extra), whole)
                if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in whole)) and (best is None or way[:2] < best[:2]):
                    best = way
            return
        role, text = rows[i]
        for extra in inserts:
            head, paid, said = out + [(r, "") for r in extra], cost + 3 * len(extra), audit + "I" * len(extra)
            if not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in head)):
                continue
            go(i + 1, paid + 4, said + "D", head)
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                go(i + 1, paid + more, said + "K", head + [(role, text)])
                for wanted in ("user", "assistant"):
                    go(i + 1, paid + 3 + more, said + "R", head + [(wanted, text)])

    go(0, 0, "", [])
    return best


def test_machine_finds_the_cheapest_and_least_edits():
    draw = random.Random(4)
    rules = ["ua", "uu", "dd", "aU", "oa", chr(0x100) * 2, chr(0x104) + chr(0x100), "SU", "s" + chr(0x100)]
    machine = repair.Machine().learn(rules)
    plain = repair.Machine()
    for _ in range(250):
        kinds = [(draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["", "truncated", "blank"])) for _ in range(draw.randint(0, 5))]
        rows = [(role, {"": "a.", "truncated": "b", "blank": ""}[fault]) for role, fault in kinds]
        symbols = "".join("d" if fault == "blank" else (repair.CUT if fault else repair.SOUND)["suao".index(role[0] if role[0] in "sua" else "o")] for role, fault in kinds)
        short = symbols
        for number, pair in enumerate(rules):
            short = short.replace(pair, chr(repair.FIRST_RULE + number))
        want = cheapest(rows, [fault for _, fault in kinds])
        assert machine.cheapest(short) == plain.cheapest(symbols) == want[:2], symbols


def test_ropes_compare_like_strings():
    draw, ropes = random.Random(1), repair.Ropes()
    known = [(0, "")] + [(ropes.letter(c), c) for c in "DIKR"]
    for _ in range(300):
        (a, x), (b, y) = draw.choice(known), draw.choice(known)
        known.append((ropes.join(a, b), x + y))
    for _ in range(2000):
        (a, x), (b, y) = draw.choice(known), draw.choice(known)
        assert ropes.less(a, b) == (x < y) and ropes.text(a) == x


def plain_reports(rows):
    """Reports and digests of (conv_id, turn, role, text) rows, in order of turn, role and digest of the text."""
    by_id = {}
    for row in rows:
        by_id.setdefault(row[0], []).append(row)
    out = {}
    for conv_id, own in by_id.items():
        own = [(turn, " " if role is None else role, " " if text is None else text) for _, turn, role, text in own]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        pairs, turns = [r[1:] for r in own], [r[0] for r in own if r[0] is not None]
        found = faults(pairs)
        cost, audit, repaired = cheapest(pairs, found)
        initials = [role[:1] for role, _ in pairs]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def reports(rows, ids=None):
    plan = repair.stage(repair.plan_repair(rows, ids), "plan")
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(rows, plan).collect()}
    return {r.conv_id: (*tuple(r)[1:], digests[r.conv_id]) for r in plan.collect()}


def test_repair_of_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 5, "user", "cut off"), (1, 6, "assistant", "No."),
        (2, None, "system", "Be."), (2, None, None, None), (2, 3, "user", "Hi."), (2, 3, "user", "Hi."), (2, 4, "", "Oh!"),
        (None, 0, "assistant", "A?"), (None, 1, "assistant", "A? \n"), (3, None, "user", ""), (3, None, "user", " \t"),
        (4, 0, "system", "S."), (5, 0, "tool", "x" * 100_000 + "."), (5, 1, "usher", "é."), (6, 1, "user", "a."), (6, 1, "assistant", "a."),
    ]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int, digest string").repartition(5)
    ids = spark.createDataFrame([(1,), (9,), (None,), (9,)], "conv_id long")
    want = plain_reports(rows)
    assert reports(frame) == want
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reports(frame, ids) == {1: want[1], None: want[None], 9: nothing}
    plan = repair.stage(repair.plan_repair(frame), "plan")
    got = {}
    for r in sorted(repair.repaired_rows(frame, plan).collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.edit, r.turn))
    assert 4 not in got and [edit for _, _, edit, _ in got[1]] == list("KKKK")
    assert got[None] == [("user", "A?", "R", 0), ("assistant", "A? \n", "K", 1)] and got[5][1][:3] == ("assistant", "é.", "R")
    empty = frame.filter("false")
    assert repair.plan_repair(empty).count() == 0 and repair.repaired_digests(empty, repair.plan_repair(empty)).count() == 0
    copies = frame.filter("conv_id = 6").withColumn("times", F.lit(200_000))
    assert reports(copies)[6][:5] == (0, 0, 399_998, 0, 399_998) and len(reports(copies)[6][6]) >= 400_000


def test_repair_equals_brute_force_with_few_and_many_rules(spark):
    draw = random.Random(8)
    texts = ["Yes.", "No!", "cut", "", " ", "What?", "so on"]
    rows = [(c, draw.choice([t, t, t + 1, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]), draw.choice(texts)) for c in range(60) for t in range(draw.randint(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = plain_reports(rows)
    assert reports(frame) == want
    for settings in (repair.Settings(rules=0), repair.Settings(rules=5, per_round=1, least=1)):
        assert {r.conv_id: tuple(r)[1:] for r in repair.plan_repair(frame, settings=settings).collect()} == {c: v[:-1] for c, v in want.items()}


def test_one_long_conversation_is_read_in_stretches(spark, monkeypatch):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(3000)] + [(2, 0, "user", "a.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    monkeypatch.setattr(repair, "STRETCH", 100)
    got = reports(frame)
    assert got[1][:-1] == (0, 0, 0, 0, 0, 0, "K" * 3000)
    assert got[1][-1] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:3000]).encode()).hexdigest()


def test_damage_is_as_told(spark):
    stored = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in damage(stored).collect()}
    for r in stored.collect():
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if code == 0:
            assert (r.conv_id, r.turn) not in got
            continue
        text = {1: "", 2: re.sub("[.!?]", "", r.text)}.get(code, r.text)
        now = got[r.conv_id, r.turn]
        assert (now.role, now.text, now.times) == ("user" if code == 4 else r.role, text, 2 if code == 3 else 1)


# --- secret scans --------------------------------------------------------------------

def plain_spans(text, rules=secret_scan.RULES):
    found = []
    for number, rule in enumerate(rules):
        for match in re.finditer("[0-9a-f]+" if rule.kind == "hex" else rule.pattern, text):
            if re.fullmatch(rule.keep or rule.pattern, match[0]):
                found.append((match.start(), number, match.end()))
    return [(number, start, end) for start, number, end in sorted(found)]


def test_one_pass_finds_what_each_rule_finds_alone():
    scan = secret_scan.scanner(secret_scan.RULES, secret_scan.compile_rules(secret_scan.RULES))
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "api_", "=", ":", " ", "  ", '"', "'", "abc", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEF0123", "é", "中",
             "-", ".", "/", "ghp_", "xoxb-", "AIza", "sk_live_", "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "aaaaaaaaaaaa", "Z9", "_", "\n", "ſecret", "toKen", "\0"]
    draw, spans = random.Random(1), 0
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert scan(text) == plain_spans(text), text
        spans += len(scan(text))
    assert spans > 1000


def test_a_match_that_fails_uses_up_its_characters():
    scan = secret_scan.scanner(secret_scan.BASE_RULES, secret_scan.compile_rules(secret_scan.BASE_RULES))
    assert scan("token=pw-secret:abcdefghijklmnop") == []
    assert scan("token=short secret:abcdefghijklmnop") == [(0, 12, 35)]
    assert scan("é password = 'abcdefghijkl'") == [(0, 2, 26)]


@pytest.mark.parametrize("pattern", ["a(b|cd)*e", "[a-c]{2,3}d?", "x{2}|y{1,}", "\\x41\\.b", "(ab?)+c", "[a\\]]+", "a-[b-]c"])
def test_expressions_match_like_re(pattern):
    rule = secret_scan.Rule("own", pattern)
    scan = secret_scan.scanner((rule,), secret_scan.compile_rules((rule,)))
    draw = random.Random(2)
    for _ in range(500):
        text = "".join(draw.choice("abcdexyA.]-") for _ in range(draw.randint(0, 12)))
        longest, at = [], 0
        while at < len(text):  # leftmost, then longest
            end = max((e for e in range(at + 1, len(text) + 1) if re.fullmatch(pattern, text[at:e])), default=None)
            if end is not None:
                longest.append((0, at, end))
            at = end or at + 1
        assert scan(text) == longest, text


def test_automata_are_minimal():
    rules = (secret_scan.Rule("a", "ab|cb"), secret_scan.Rule("b", "(a|c)b"))
    automaton = secret_scan.compile_rules(rules)[1]
    assert len(automaton.table) == 4  # first, after one letter, ended, dead
    with pytest.raises(ValueError):
        secret_scan.compile_rules((secret_scan.Rule("empty", "a*"),))
    for broken in ("(a", "a)", "é", "\\w"):
        with pytest.raises(ValueError):
            secret_scan.parse(broken)


def test_scan_of_awkward_rows(spark, awkward, no_docs):
    long = "x " * 300_000 + "secret=" + "A" * 50_000 + " é AKIA" + "B" * 14
    extra = spark.createDataFrame([(50, long, "x"), (50, long, "x")], "doc_id long, text string, spans string")
    got = secret_scan.scan(extra).collect()
    assert [tuple(s) for s in got[0].spans] == [("assign", 600_000, 650_007), ("access", 650_010, 650_028)] and got[0] == got[1]
    rows = {repr((r.doc_id, [tuple(s) for s in r.spans])) for r in secret_scan.scan(awkward).collect()}
    want = {repr((r.doc_id, [(secret_scan.RULES[n].kind, s, e) for n, s, e in plain_spans(r.text or "")])) for r in awkward.collect()}
    assert rows == want and secret_scan.scan(awkward).count() == awkward.count()
    assert secret_scan.scan(no_docs).count() == 0
