"""Conversations whose turns are broken, the cheapest edits that mend them, and the conversations after those edits.

Each row's first fault counts: ``blank`` (no character but blanks), ``duplicate`` (role and text seen earlier in the
conversation), ``truncated`` (the last character that is no blank does not end a sentence). Edits: Keep costs 0, Rerole
to user or assistant 2, Delete 3 (a must for blank and duplicate rows), Insert an empty user or assistant text 2; a
truncated row that stays adds 1. Afterwards the roles' initials read ``(s?(ua)+)?``. Of the cheapest edits the audit, the
edits' initials in order, is the least by ASCII.

The search holds, for each state of that pattern, the cheapest audit so far. Audits share their prefixes as linked nodes
with ancestors at distances of powers of two and a hash of the way from the root, so that two audits of equal cost
are compared by a search for their longest common prefix; equal hashes are verified letter by letter.

Rows are dealt by ranges of conversation and turn, so that a conversation with any share of all rows lies on as many
tasks as its rows need. What lies within one task is solved there. Conversations at a task's edges, and those too
long for a task, go on as segments: each yields the cheapest audit from every state to every other one, one task for each conversation picks
the cheapest chain of states (it holds audits, a letter for each row, and no texts), and the segments replay it over their texts. The last
hash reads a conversation's texts in order, since SHA-256 has no other way, but holds none of them.

Rows of one turn are ordered by a digest of role and text; a null turn comes first. Null roles and texts are one blank.
Repeated rows are duplicates; a conversation without rows has an empty audit. A null conversation is one of its own. An
empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.store import importable, saved

#: Rows, and bytes of their texts, up to which a conversation is solved in one task as a whole.
LONG_ROWS, LONG_BYTES = 20_000, 32 << 20
#: Letters of hashes.
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where a user's or an assistant's turn leads from each state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")


class Audits:
    """Sequences of letters as nodes of a tree; node 0 is the empty one."""

    def __init__(self):
        self.letter, self.hash, self.depth = [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def longer(self, node: int, letters: str) -> int:
        for letter in letters:
            up, k = [node], 0
            while k < len(self.up[up[k]]):
                up.append(self.up[up[k]][k])
                k += 1
            self.letter.append(letter)
            self.hash.append((self.hash[node] * _BASE + ord(letter)) % _MODULUS)
            self.depth.append(self.depth[node] + 1)
            self.up.append(up)
            node = len(self.up) - 1
        return node

    def _prefix(self, node: int, length: int) -> int:
        while (rest := self.depth[node] - length) > 0:
            node = self.up[node][rest.bit_length() - 1]
        return node

    def _parted(self, x: int, y: int) -> tuple[int, int] | None:
        """Where two sequences of one length that were told equal by hash differ first; None if they are equal."""
        found = None
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = x, y
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the one sequence comes before the other."""
        length = min(self.depth[a], self.depth[b])
        x, y = self._prefix(a, length), self._prefix(b, length)
        if x == y or self.hash[x] == self.hash[y]:
            parted = self._parted(x, y)
            if parted is None:
                return self.depth[a] < self.depth[b]
            return self.letter[parted[0]] < self.letter[parted[1]]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        # their parents have equal hashes
        x, y = self._parted(self.up[x][0], self.up[y][0]) or (x, y)
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


Reached = dict[int, tuple[int, int]]  # state: cost and audit


def _better(audits: Audits, into: Reached, state: int, cost: int, node: int, letters: str) -> None:
    old = into.get(state)
    if old is not None and old[0] < cost:
        return
    new = audits.longer(node, letters)
    if old is None or cost < old[0] or audits.less(new, old[1]):
        into[state] = cost, new


def inserted(audits: Audits, reached: Reached) -> Reached:
    """With turns inserted; more than two in a row lead back to where they began."""
    out = dict(reached)
    for state, (cost, node) in reached.items():
        after = NEXT[state]
        _better(audits, out, after, cost + 2, node, "I")
        if NEXT[after] != state:
            _better(audits, out, NEXT[after], cost + 4, node, "II")
    return out


def edited(audits: Audits, reached: Reached, initial: str, must_go: bool, truncated: bool) -> Reached:
    """One row further."""
    out: Reached = {}
    for state, (cost, node) in inserted(audits, reached).items():
        _better(audits, out, state, cost + 3, node, "D")
        if not must_go:
            after = KEPT[state].get(initial)
            if after is not None:
                _better(audits, out, after, cost + truncated, node, "K")
            if after != NEXT[state]:
                _better(audits, out, NEXT[state], cost + 2 + truncated, node, "R")
    return out


Row = tuple[str, bool, bool]  # initial of the role, whether it must go, whether it is truncated


def cheapest(rows: Iterable[Row]) -> tuple[int, str]:
    audits, reached = Audits(), {START: (0, 0)}
    for row in rows:
        reached = edited(audits, reached, *row)
    reached = inserted(audits, reached)
    cost, node = reached[START] if START in reached else reached[ASSISTANT]
    for state in ENDS:
        if state in reached:
            other, at = reached[state]
            if other < cost or (other == cost and audits.less(at, node)):
                cost, node = other, at
    return cost, audits.text(node)


def segment(rows: Sequence[Row]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) for every way through some rows of a conversation."""
    out = []
    for before in NEXT:
        audits, reached = Audits(), {before: (0, 0)}
        for row in rows:
            reached = edited(audits, reached, *row)
        out += [(before, after, cost, audits.text(node)) for after, (cost, node) in reached.items()]
    return out


def chained(segments: Sequence[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cheapest cost, and state before and audit of each segment and of the inserts at the end.

    Ways through one segment that end in different states differ in a letter of it, as both end with its last row: so
    of the ways that stay cheapest the least letter by letter is the least of the whole.
    """
    def ending(state: int) -> tuple[int, str]:
        found = [(0, "")] if state in ENDS else []
        found += [(2, "I")] if NEXT[state] in ENDS else []
        return min([*found, *([(4, "II")] if NEXT[NEXT[state]] in ENDS else [])])

    rest = [{state: ending(state)[0] for state in NEXT}]
    for ways in reversed(segments):
        best: dict[int, int] = {}
        for before, after, cost, _ in ways:
            if after in rest[-1]:
                best[before] = min(best.get(before, cost + rest[-1][after]), cost + rest[-1][after])
        rest.append(best)
    rest.reverse()
    state, chosen = START, []
    for ways, here, there in zip(segments, rest[:-1], rest[1:], strict=True):
        fits = [(audit, after) for before, after, cost, audit in ways if before == state and cost + there[after] == here[state]]
        audit, after = min(fits)
        chosen.append((state, audit))
        state = after
    return rest[0][START], [*chosen, (state, ending(state)[1])]


def replayed(state: int, letters: str, initial: str) -> tuple[int, list[tuple[str | None, bool]]]:
    """State after a row's edit and the inserts before it, and the turns they leave: role (None: the row's), and whether the text is the row's."""
    out: list[tuple[str | None, bool]] = []
    for letter in letters:
        if letter == "K":
            state = KEPT[state][initial]
            out.append((None, True))
        elif letter != "D":
            state = NEXT[state]
            out.append((NAME[state], letter == "R"))
    return state, out


def steps(audit: str) -> Iterator[str]:
    """The audit cut behind each edit of a row; what is left are inserts at the end."""
    held = ""
    for letter in audit:
        held += letter
        if letter != "I":
            yield held
            held = ""


def spread(turns: Iterable[int]) -> int:
    seen = set(turns)
    return max(seen) - min(seen) + 1 - len(seen) if seen else 0


def illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))


ORDER = ["known", "conv", "dated", "turn", "digest"]
ROWS = (
    "known boolean, conv long, dated boolean, turn long, digest binary, role string, text string, initial string, "
    "blank boolean, truncated boolean, gone boolean, copies long"
)
TURNS = "array<struct<role:string,text:string>>"
RESULT = (
    "known boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    f"audit string, turns {TURNS}"
)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_KIND = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), TURNS: pa.list_(_TURN)}
_WAY = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _struct(schema: str) -> str:
    return f"struct<{schema.replace(', ', ',').replace(' ', ':')}>"


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KIND[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


BLANKS = " \t\n\x0b\x0c\r"


def _prepared(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, copies, gone) with what the search asks of a row."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    return turns.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("dated"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone",
        F.col("copies").cast("long").alias("copies"),
    ).select(
        *ORDER[:-1], F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)).alias("digest"),
        "role", "text", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
        ((trimmed != "") & ~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"), "gone", "copies",
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated rows of a batch as one with their number."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            keys = [n for n in table.column_names if n != "copies"]
            found = table.group_by(keys, use_threads=False).aggregate([("copies", "sum")]).rename_columns([*keys, "copies"])
            yield from found.combine_chunks().to_batches()


def _flags(rows: list[dict]) -> Iterator[tuple[str, str]]:
    """For each copy of the rows of a conversation, in order, initial and fault."""
    seen = set()
    for row in rows:
        for _ in range(row["copies"]):
            again = row["digest"] in seen
            seen.add(row["digest"])
            fault = "blank" if row["blank"] else "duplicate" if again else "truncated" if row["truncated"] else ""
            yield row["initial"], fault


def _solved(rows: list[dict]) -> dict:
    known, conv = rows[0]["known"], rows[0]["conv"]
    rows = [r for r in rows if not r["gone"]]
    flags = list(_flags(rows))
    cost, audit = cheapest((i, f in ("blank", "duplicate"), f == "truncated") for i, f in flags)
    copies = (row for row in rows for _ in range(row["copies"]))
    state, turns, at = START, [], 0
    for letters, row in zip(steps(audit), copies, strict=True):
        at += len(letters)
        state, found = replayed(state, letters, row["initial"])
        turns += [{"role": role or row["role"], "text": row["text"] if own else ""} for role, own in found]
    turns += [{"role": role, "text": ""} for role, _ in replayed(state, audit[at:], "")[1]]
    return {
        "known": known, "conv": conv, "gaps": spread(r["turn"] for r in rows if r["dated"]),
        **{f: sum(x == f for _, x in flags) for f in ("blank", "duplicate", "truncated")},
        "illegal": illegal([i for i, _ in flags]), "cost": cost, "audit": audit, "turns": turns,
    }


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie within this task; rows of the others, for later."""
    results = _arrow(RESULT)
    held: list[pa.RecordBatch] = []
    key, first, size, rows = None, True, 0, 0

    def out(solved: list[dict], raw: pa.RecordBatch | None) -> pa.RecordBatch:
        """Both kinds of rows as structs."""
        if raw is None:
            done = pa.RecordBatch.from_pylist(solved, results).to_struct_array()
            return pa.RecordBatch.from_arrays([done, pa.nulls(len(done), row_type)], ["done", "row"])
        later = raw.to_struct_array()
        return pa.RecordBatch.from_arrays([pa.nulls(len(later), pa.struct(list(results))), later], ["done", "row"])

    row_type = None
    for batch in batches:
        if not batch.num_rows:
            continue
        row_type = pa.struct(list(batch.schema))
        known, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "conv"))
        change = np.flatnonzero((known[1:] != known[:-1]) | (conv[1:] != conv[:-1])) + 1
        solved = []
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(conv)], strict=True):
            if (known[a], conv[a]) != key:
                if held:
                    solved.append(_solved(pa.Table.from_batches(held).to_pylist()))
                first = first and key is None
                key, held, size, rows = (known[a], conv[a]), [], 0, 0
            part = batch.slice(a, b - a)
            rows, size = rows + b - a, size + part.nbytes
            if first or (rows > LONG_ROWS or size > LONG_BYTES):
                yield from (out([], p) for p in (*held, part))
                held = []
                if not first:
                    rows = LONG_ROWS + 1
            else:
                held.append(part)
        if solved:
            yield out(solved, None)
    yield from (out([], p) for p in held)


SEGMENT = "known boolean, conv long, seg long, head string, tail string, illegal long"
WAYS = "array<struct<before:int,after:int,cost:long,audit:string>>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, segment and position; one result for each segment."""
    for t in tx.runs(batches, ("known", "conv", "seg")):
        rows, initials = [], []
        for row in t.select(["initial", "blank", "fresh", "truncated", "copies"]).to_pylist():
            for k in range(row["copies"]):
                again = k > 0 or not row["fresh"]
                rows.append((row["initial"], row["blank"] or again, row["truncated"] and not again))
                initials.append(row["initial"])
        ways = [dict(zip(("before", "after", "cost", "audit"), w, strict=True)) for w in segment(rows)]
        same = {c: t.column(c)[0].as_py() for c in ("known", "conv", "seg")}
        yield pa.RecordBatch.from_pylist(
            [{**same, "head": initials[0], "tail": initials[-1], "illegal": illegal(initials), "ways": ways}],
            pa.schema([*_arrow(SEGMENT), ("ways", pa.list_(_WAY))]),
        )


CHAIN = "known boolean, conv long, seg long, before int, audit string, cost long, illegal long, whole string"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment, and for the end (no segment), the state before it and its part of the cheapest audit."""
    for t in tx.runs(batches, ("known", "conv")):
        rows = t.to_pylist()
        cost, chosen = chained([[(w["before"], w["after"], w["cost"], w["audit"]) for w in r["ways"]] for r in rows])
        wrong = sum(r["illegal"] for r in rows)
        wrong += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True))
        out = []
        for seg, (before, audit) in zip([*(r["seg"] for r in rows), None], chosen, strict=True):
            out.append({"known": rows[0]["known"], "conv": rows[0]["conv"], "seg": seg, "before": before, "audit": audit})
        out[-1] |= {"cost": cost, "illegal": wrong, "whole": "".join(audit for _, audit in chosen)}
        yield pa.RecordBatch.from_pylist(out, _arrow(CHAIN))


EDITS = "array<struct<role:string,own:boolean>>"


def _replays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each row leaves. Rows sorted by conversation, segment and position, a segment's audit before its rows."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("own", pa.bool_())]))
    state, letters = START, iter(())
    for batch in batches:
        out = []
        for row in batch.select(["pos", "initial", "copies", "before", "audit"]).to_pylist():
            if row["pos"] < 0:
                state, letters = row["before"], steps(row["audit"])
                continue
            left = []
            for _ in range(row["copies"]):
                state, found = replayed(state, next(letters), row["initial"])
                left += [{"role": role, "own": own} for role, own in found]
            if left:
                out.append({"pos": row["pos"], "edits": left})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("pos", pa.int64()), ("edits", kind)]))


HASHED = "known boolean, conv long, repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; none are held."""
    key, hasher = None, None
    for batch in batches:
        out = []
        for known, conv, line in zip(*(batch.column(c) for c in ("known", "conv", "line")), strict=True):
            if (known, conv) != key:
                if key is not None:
                    out.append({"known": key[0].as_py(), "conv": key[1].as_py(), "repaired_sha256": hasher.hexdigest()})
                key, hasher = (known, conv), hashlib.sha256()
            else:
                hasher.update(b"\n")
            hasher.update(line.as_buffer())
        yield pa.RecordBatch.from_pylist(out, _arrow(HASHED))
    if key is not None:
        out = [{"known": key[0].as_py(), "conv": key[1].as_py(), "repaired_sha256": hasher.hexdigest()}]
        yield pa.RecordBatch.from_pylist(out, _arrow(HASHED))


class Repair:
    """The repair of ``turns`` (conv_id, turn, role, text).

    ``gone`` marks rows whose conversation is to appear even if nothing else is left of it, ``copies`` tells how often
    a row stands there, one after the other.
    """

    def __init__(self, turns: DataFrame, gone: Column | None = None, copies: Column | None = None):
        importable(turns.sparkSession)
        self.id_type = turns.schema["conv_id"].dataType
        gone, copies = F.lit(False) if gone is None else gone, F.lit(1) if copies is None else copies
        rows = _prepared(turns.select("conv_id", "turn", "role", "text", gone.alias("gone"), copies.alias("copies")))
        rows = rows.mapInArrow(_combined, ROWS).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        self.found = saved(rows.mapInArrow(_within, f"done {_struct(RESULT)}, row {_struct(ROWS)}"), "repaired")
        self._replay_long()

    def _replay_long(self) -> None:
        """Conversations that no task held as a whole: faults, segments, chains, turns."""
        conv, pos = ["known", "conv"], F.monotonically_increasing_id()
        order = [*conv, "seg", "pos"]
        rows = self.found.filter("row is not null").select("row.*").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        self.rows = rows = saved(rows.withColumn("pos", pos).withColumn("seg", F.shiftright("pos", 33)), "long")
        left = rows.filter("not gone").drop("text", "role")
        once = left.groupBy(*conv, "digest").agg(F.min("pos").alias("since"))
        marked = left.join(once, [*conv, "digest"]).withColumn("fresh", F.col("pos") == F.col("since"))
        marked = saved(marked.drop("since", "digest"), "marked")
        turn, stays = F.when(F.col("dated"), F.col("turn")), F.col("fresh") & ~F.col("blank")
        again = F.col("copies") - F.col("fresh").cast("long")
        self.counts = marked.groupBy(*conv).agg(
            F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(~F.col("blank"), again).otherwise(0)).alias("duplicate"),
            F.count_if(stays & F.col("truncated")).alias("truncated"),
        )
        segments = marked.repartition(*conv, "seg").sortWithinPartitions(*order).mapInArrow(_segments, f"{SEGMENT}, ways {WAYS}")
        chains = segments.repartition(*conv).sortWithinPartitions(*conv, "seg").mapInArrow(_chains, CHAIN)
        chains = saved(chains, "chains")
        ends = chains.filter("seg is null")
        self.sums = ends.select(*conv, "cost", "illegal", F.col("whole").alias("audit"))
        starts = chains.filter("seg is not null").select(
            *conv, "seg", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("initial"),
            F.lit(0).cast("long").alias("copies"), "before", "audit",
        )
        edits = marked.select(*order, "initial", "copies", F.lit(0).alias("before"), F.lit("").alias("audit")).union(starts)
        edits = edits.repartition(*conv, "seg").sortWithinPartitions(*order).mapInArrow(_replays, f"pos long, edits {EDITS}")
        kept = rows.join(edits, "pos").select(*order, "role", "text", F.posexplode("edits").alias("place", "edit"))
        kept = kept.select(
            *order, "place", F.coalesce("edit.role", "role").alias("role"),
            F.when(F.col("edit.own"), F.col("text")).otherwise("").alias("text"),
        )
        roles = F.when(F.col("audit") == "I", F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
        last = F.lit((1 << 63) - 1)
        closing = ends.filter("audit <> ''").select(*conv, last.alias("seg"), last.alias("pos"), F.posexplode(roles).alias("place", "role"))
        self.lines = saved(kept.union(closing.select(*order, "place", "role", F.lit("").alias("text"))), "long-turns")

    def _named(self, df: DataFrame, *more: str | Column) -> DataFrame:
        return df.select(F.when(F.col("known"), F.col("conv")).cast(self.id_type).alias("conv_id"), *more)

    def turns(self) -> DataFrame:
        """The conversations after the edits: ``conv_id, place, role, text``, places from 0."""
        whole = self.found.filter("done is not null").select("done.known", "done.conv", F.posexplode("done.turns").alias("place", "turn"))
        before = Window.partitionBy("known", "conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.lines.groupBy("known", "conv", "seg").agg(F.count("*").alias("n"))
        counts = counts.select("known", "conv", "seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy("known", "conv", "seg").orderBy("pos", "place"))
        long = self.lines.withColumn("within", within).join(counts, ["known", "conv", "seg"])
        long = self._named(long, (F.col("before") + F.col("within") - 1).alias("place"), "role", "text")
        return self._named(whole, F.col("place").cast("long").alias("place"), "turn.role", "turn.text").union(long)

    def summary(self) -> DataFrame:
        """Per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

        The hash is over the lines ``role:text`` of its turns.
        """
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        whole = self.found.filter("done is not null").select("done.*")
        whole = self._named(whole, *counts, "audit", F.sha2(joined, 256).alias("repaired_sha256"))
        line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
        order = ["known", "conv", "pos", "place"]
        digests = self.lines.select(*order, line).repartition("known", "conv").sortWithinPartitions(*order)
        long = self.rows.select("known", "conv").distinct()
        for part in (self.counts, self.sums, digests.select("known", "conv", "line").mapInArrow(_hashed, HASHED)):
            long = long.join(part, ["known", "conv"], "left")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        long = self._named(
            long, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
        )
        return whole.union(long)
