"""The repair of conversations against an exhaustive search."""

import hashlib
import itertools
import re
from functools import cache
from random import Random

import pytest
from oracle import connect
from pyspark.sql import functions as F

from tidegate.llm import queries, repair

GOOD = re.compile(r"(s?(ua)+)?")


def brute_audit(rows):
    """Every sequence of edits with at most two inserts between rows."""
    best = None
    kinds = [["D"] if must_go else ["D", "K", "Ru", "Ra"] for _, must_go, _ in rows]
    gaps = ["", "Iu", "Ia", "IuIa", "IaIu"]
    for edits in itertools.product(*kinds):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, roles = 0, "", ""
            for k, gap in enumerate(between):
                for one in (gap[i : i + 2] for i in range(0, len(gap), 2)):
                    cost, audit, roles = cost + 2, audit + "I", roles + one[1]
                if k < len(rows):
                    initial, _, truncated = rows[k]
                    cost += {"D": 3, "K": 0, "R": 2}[edits[k][0]] + (truncated and edits[k] != "D")
                    audit += edits[k][0]
                    roles += "" if edits[k] == "D" else initial or "?" if edits[k] == "K" else edits[k][1]
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


CASES = [(i, g, t) for i in ("s", "u", "a", "x", "") for g, t in ((False, False), (False, True), (True, False))]


def test_audits_are_the_cheapest_and_least():
    assert repair.cheapest([]) == (0, "")
    assert all(repair.cheapest([c]) == brute_audit([c]) for c in CASES)
    random = Random(4)
    for n, times in ((2, 60), (3, 25)):
        for _ in range(times):
            rows = random.choices(CASES, k=n)
            assert repair.cheapest(rows) == brute_audit(rows)


@cache
def search(rows, state=0):
    """The least (cost, audit) from here on, by recursion."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    found = [(0, "")] if not rows and state in (0, 3) else []
    found += [(2, "I")] if not rows and state == 2 else [(4, "II")] if not rows and state == 1 else []
    if rows:
        (initial, must_go, truncated), rest = rows[0], rows[1:]
        for inserts in range(3):
            at = state
            for _ in range(inserts):
                at = after[at]
            ways = [("D", 3, at)]
            if not must_go:
                ways.append(("R", 2 + truncated, after[at]))
                to = {"s": 1 if at == 0 else None, "u": 2 if at != 2 else None, "a": 3 if at == 2 else None}.get(initial)
                ways += [("K", int(truncated), to)] if to is not None else []
            for letter, cost, to in ways:
                more, audit = search(rest, to)
                found.append((2 * inserts + cost + more, "I" * inserts + letter + audit))
    return min(found)


def test_longer_audits_and_segments():
    random = Random(8)
    for n in (5, 9, 14, 40):
        for _ in range(60):
            rows = tuple(random.choices(CASES, k=n))
            expected = search(rows)
            assert repair.cheapest(rows) == expected
            cuts = sorted(random.sample(range(1, n), min(n - 1, 3)))
            parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
            cost, chosen = repair.chained([repair.segment(p) for p in parts])
            assert (cost, "".join(a for _, a in chosen)) == expected


@pytest.mark.parametrize("base", [1_000_003, 1, 0])
def test_comparison_of_audits(base, monkeypatch):
    """Also with hashes that are equal for different audits."""
    monkeypatch.setattr(repair, "_BASE", base)
    random, audits = Random(2), repair.Audits()
    nodes = {"": 0}
    for _ in range(150):
        text = random.choice(sorted(nodes))
        more = "".join(random.choices("DIKR", k=random.randrange(1, 6)))
        nodes[text + more] = audits.longer(nodes[text], more)
    for (a, x), (b, y) in itertools.product(nodes.items(), repeat=2):
        assert audits.text(x) == a
        assert audits.less(x, y) == (a < b) or base != 1_000_003 and a == b


def conversation(n, random, role=None):
    texts = ["Yes.", "No", "", " \t", "Why?", "So!  ", "…", "a.b"]
    return [(random.choice(["user", "assistant", "system", "tool", ""]) if role is None else role, random.choice(texts) + random.choice(["", f" {n}."])) for _ in range(n)]


def brute(turns):
    """turns: (turn, role, text) of one conversation, copies side by side."""
    key = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}:{t[2]}".encode()).digest()
    turns = sorted(((n, r, t) for n, r, t in turns), key=lambda t: (t[0] is not None, t[0] or 0, key(t)))
    seen, rows, faults = set(), [], []
    for turn in turns:
        text = turn[2].rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not text else "duplicate" if turn[1:] in seen else "truncated" if text[-1] not in ".!?" else ""
        seen.add(turn[1:])
        faults.append(fault)
        rows.append((turn[1][:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = search(tuple(rows))
    lines, state, left = [], 0, iter(turns)
    for letter in audit:
        turn = next(left) if letter != "I" else None
        if letter != "D":
            state = {"s": 1, "u": 2, "a": 3}[turn[1][0]] if letter == "K" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
            role = turn[1] if letter == "K" else {2: "user", 3: "assistant"}[state]
            lines.append((role, "" if letter == "I" else turn[2]))
    numbers = {t[0] for t in turns if t[0] is not None}
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns[:-1], turns[1:], strict=True))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, digest), lines


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("limit", [20_000, 3])
def test_conversations(spark, limit, monkeypatch, uncoalesced):
    monkeypatch.setattr(repair, "LONG_ROWS", limit)
    random = Random(11)
    by_id = {c: [(random.choice([None, 0, 1, 2, 3, 5, k, k, k]), *t) for k, t in enumerate(conversation(random.randrange(1, 9), random))] for c in range(60)}
    by_id[None] = [(k, *t) for k, t in enumerate(conversation(6, random))]
    by_id[77] = [(k, *t) for k, t in enumerate(conversation(300, random))]  # on several tasks
    by_id[78] = [(4, "user", "same.")] * 40 + [(None, "assistant", "x")]
    data = [(c, *t) for c, turns in by_id.items() for t in turns]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    clashing = table.withColumn("copies", F.lit("x")).withColumn("gone", F.lit(1)).withColumn("seg", F.lit(2))
    work = repair.Repair(clashing.repartition(7))
    found = {r.conv_id: tuple(r)[1:] for r in work.summary().collect()}
    lines = {}
    for r in sorted(work.turns().collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(found) == set(by_id)
    for c, turns in by_id.items():
        expected, texts = brute(turns)
        assert found[c] == expected, c
        assert lines.get(c, []) == texts


def test_rows_that_are_gone_and_empty_tables(spark):
    table = spark.createDataFrame([(1, 0, "user", "x."), (2, 0, None, None)], "conv_id int, turn int, role string, text string")
    found = {r.conv_id: tuple(r)[1:] for r in repair.Repair(table, gone=F.col("conv_id") == 1).summary().collect()}
    assert found == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()), 2: brute([(0, " ", " ")])[0]}
    nothing = repair.Repair(table.limit(0))
    assert nothing.summary().count() == 0 and nothing.turns().count() == 0
    assert nothing.summary().schema["conv_id"].dataType.simpleString() == "int"


def test_a_long_conversation_is_solved_in_parts(spark, uncoalesced):
    work = repair.Repair(spark.range(400).selectExpr("id % 2 as conv_id", "id as turn", "'user' as role", "concat('t', id, '.') as text").repartition(5))
    assert work.rows.select("conv", "seg").distinct().count() > 2
    assert {(r.cost, r.audit) for r in work.summary().collect()} == {(200, "KR" * 100)}


def test_query_over_damaged_nulls(spark, tmp_path):
    random = Random(5)
    data = [(random.choice([None, 1, 2, 3, 4, 50]), k, random.choice(["user", "assistant", "system", None]), random.choice(["Hi.", "no", None, "", "Eh? "])) for k in range(80)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted(map(str, map(tuple, queries.op12_conversations(spark, str(tmp_path)).collect())))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, con.execute(queries.CONVERSATIONS_SQL).fetchall())) == found
