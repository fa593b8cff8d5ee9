"""Conversation structure repair by weighted finite-state composition.

Three machines: an acceptor of a conversation's rows in order (each row a symbol: its role's first
letter and its fault), a transducer of edits (keep, give another role, delete, insert a turn; each with
a cost and a label) and an acceptor of the roles that a conversation may have, `(s?(ua)+)?`.  Their
composition is never built whole: a state is (row, role state), its arcs are made when a row is reached,
and as there are few role states and few symbols, what a symbol does to the states' weights is worked
out once for each way that those differ.  Weights are (cost, labels) compared in that order, and the
shortest path is taken from the last row to the first, so that labels are put before what follows, which
keeps their order.  Rows are topologically ordered; inserts, which stay at a row, all cost something, so
their circle is never worth going round.

Faults: a row is blank (nothing but white space), else a duplicate (its role and text stand earlier in
the conversation), else truncated (its last character that isn't white space is none of .!?).  Blank and
duplicate rows must be deleted; a truncated one that stays costs more.  `illegal` counts neighbours,
before any edit, whose initials aren't su, ua or au; an empty role has an initial that no role has.

A conversation's rows are never gathered: rows are numbered over ranges, earlier copies are found by a
table of digests that occur twice or more, and only symbols, some bytes a row, of one conversation at a
time meet in a task, as its audit is one string of a letter or more for each row.  Edits come back to the
rows in segments.

Rows are in the order of turn, nulls first, those of one turn by role, then text.  Null roles and texts
are one blank; a null conv_id is a conversation of its own.  gaps is the largest turn less the smallest
plus 1 less the number of turns, nulls left out; 0 if all are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import frozen
from glossaria.llm.turns import by_key, in_order, runs_of

# What edits cost, the grammar of roles, white space and what ends a sentence.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = frozenset({0, 3})
GIVEN = {"u": "user", "a": "assistant"}
_BLANK = r"[\x20\x09-\x0D]"
SEGMENT = 4096
_INITIALS, _FAULTS = "sua-", ("fine", "blank", "duplicate", "truncated")
TURNS = "conv_id long, position long, nth int, edit string, role string, text string"
REPORT = "conv_id long, segment long, edits array<string>, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, tail string"


class Composed:
    """The composition, a level (a row, or the end) at a time, from the end."""

    def __init__(self):
        self.known: dict = {}

    @staticmethod
    def edits(initial: str, fault: str) -> list[tuple[str, int, str]]:
        """The transducer's arcs that read a row: (label, cost, role written)."""
        out = [("D", DELETE, "")]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            out += [("K", KEEP + more, initial), *(("R", REROLE + more, x) for x in GIVEN)]
        return out

    @staticmethod
    def closed(best: dict[int, tuple]) -> tuple[tuple, tuple, tuple, int]:
        """After inserts: each state's cost over the least, the rank of its labels, its way (inserts, edit, next state), and the least cost."""
        changed = True
        while changed:
            changed = False
            for s, arcs in GRAMMAR.items():
                for role in GIVEN:
                    if (t := arcs.get(role)) in best:
                        cost, labels, way = best[t]
                        found = (cost + INSERT, ("I", labels), (role + way[0], *way[1:]))
                        if s not in best or found[:2] < best[s][:2]:
                            best[s], changed = found, True
        order = {x: k for k, x in enumerate(sorted({b[1] for b in best.values()}))}
        states = [best[s] for s in GRAMMAR]
        least = min(b[0] for b in states)
        return tuple(b[0] - least for b in states), tuple(order[b[1]] for b in states), tuple(b[2] for b in states), least

    def end(self):
        return self.closed({s: (0, (), ("", "", s)) for s in ACCEPTING})

    def level(self, symbol: tuple[str, str], costs: tuple, ranks: tuple):
        key = symbol, costs, ranks
        if key not in self.known:
            best: dict[int, tuple] = {}
            for s, arcs in GRAMMAR.items():
                for label, cost, role in self.edits(*symbol):
                    t = s if label == "D" else arcs.get(role)
                    if t is not None:
                        act = role.upper() if label == "R" else label
                        found = (cost + costs[t], (label, ranks[t]), ("", act, t))
                        if s not in best or found[:2] < best[s][:2]:
                            best[s] = found
            self.known[key] = self.closed(best)
        return self.known[key]


def shortest(symbols: list[tuple[str, str]], composed: Composed) -> tuple[int, list[str], str]:
    """(cost, for each row the roles inserted before it and its edit, the roles inserted at the end).

    An edit is K, D, or the initial of the role that is given, in upper case; inserted roles are initials in lower case.
    """
    costs, ranks, tail, total = composed.end()
    ways = []
    for symbol in reversed(symbols):
        costs, ranks, way, least = composed.level(symbol, costs, ranks)
        ways.append(way)
        total += least
    state, edits = 0, []
    total += costs[0]
    for way in reversed(ways):
        roles, act, state = way[state]
        edits.append(roles + act)
    return total, edits, tail[state][0]


_LABELS = str.maketrans("uaUA", "IIRR")


def labels(edits: list[str], tail: str) -> str:
    """The edits as one string of K, R, D and I."""
    return ("".join(edits) + tail).translate(_LABELS)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a faulty collector would leave them: by the CRC-32 of `conv_id:turn` modulo 20 a row is
    dropped (0), emptied (1), robbed of its [.!?] (2), repeated (3) or given to the user (4).  Nulls but in conv_id and turn are one blank from here on."""
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    spoilt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"), F.explode(times).alias("nth")).drop("nth")


class Repaired:
    """What repair found, from written tables, so it may be read again.

    reports: (conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.
    turns: (conv_id, position, nth, edit, role, text), the repaired conversations in the order of (position, nth).
    """

    def __init__(self, rows: DataFrame, plans: DataFrame, segment: int):
        self._rows, self._plans, self._segment = rows, plans, segment
        self.reports = plans.where("segment < 0").drop("segment", "edits", "tail")

    @property
    def turns(self) -> DataFrame:
        return self.edited("conv_id", "segment")

    def edited(self, *together: str) -> DataFrame:
        """The turns, in order within each partition and those that agree in the columns `together` in one: segments by themselves, or whole conversations."""
        none, size = F.lit(None).cast("string"), F.lit(self._segment).cast("long")
        rows = self._rows.select("conv_id", F.floor(F.col("position") / size).cast("long").alias("segment"), "position", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("array<string>").alias("edits"))
        plans = self._plans.where("segment >= 0").select("conv_id", "segment", (F.col("segment") * size).alias("position"), F.lit(0).alias("kind"), none.alias("role"), none.alias("text"), "edits")
        ends = self._plans.where("segment < 0 AND tail <> ''").select("conv_id", F.floor(F.col("rows") / size).cast("long").alias("segment"), F.col("rows").alias("position"), F.lit(2).alias("kind"), none.alias("role"), F.col("tail").alias("text"), F.lit(None).cast("array<string>").alias("edits"))
        every = rows.unionByName(plans).unionByName(ends)
        return every.repartition(*together).sortWithinPartitions("conv_id", "position", "kind").mapInArrow(_edit(self._segment), TURNS)


def repair(conversations: DataFrame, segment: int = SEGMENT) -> Repaired:
    """The cheapest edits that make conversations(conv_id, turn, role, text) lawful, and the rows after them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    stripped = F.regexp_replace("text", f"{_BLANK}+$", "")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({
        "initial": F.when(initial.isin(*"sua"), initial).otherwise("-"),
        "digest": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))),
        "state": F.when(stripped == "", "blank").when(~stripped.rlike(r"[.!?]\z"), "truncated").otherwise("fine"),
    })
    numbered = in_order(rows, "conv_id", ("turn", "role", "text"), {}, "repair-order")
    copies = numbered.groupBy("conv_id", "digest").agg(F.min("position").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("its_conv"), F.col("digest").alias("its_digest"), "first")
    copies = frozen(copies, "repair-copies")
    narrow = numbered.select("conv_id", "position", "turn", "initial", "state", "digest").join(copies, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("digest") == F.col("its_digest")), "left")
    fault = F.when(F.col("state") == "blank", "blank").when(F.col("position") > F.col("first"), "duplicate").otherwise(F.col("state"))
    plans = frozen(by_key(narrow.select("conv_id", "position", "turn", "initial", fault.alias("fault")), "conv_id", "position").mapInArrow(_planner(segment), REPORT), "repair-plans")
    return Repaired(numbered.select("conv_id", "position", "role", "text"), plans, segment)


def _edit(segment: int) -> Callable:
    """Applies edits to rows that come after those of their segment."""
    names, kinds = TURNS.replace(" long", "").replace(" int", "").replace(" string", "").split(", "), [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def edit(batches):
        edits: list[str] = []
        for b in batches:
            out = []
            for conv, _, position, kind, role, text, more in runs_of([b]):
                if not kind:
                    edits = more
                    continue
                for nth, act in enumerate(text if kind == 2 else edits[position % segment]):
                    if act == "K":
                        out.append((conv, position, nth, "K", role, text))
                    elif act != "D":
                        new = act.islower()
                        out.append((conv, position, nth, "I" if new else "R", GIVEN[act.lower()], "" if new else text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return edit


def _planner(segment: int) -> Callable:
    schema = ["conv_id", "segment", "edits", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "tail"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 7, pa.string(), pa.string()]
    symbols = [(i, f) for i in _INITIALS for f in _FAULTS]
    numbers = {x: k for k, x in enumerate(symbols)}
    lawful = {("s", "u"), ("u", "a"), ("a", "u")}

    def plan(batches):
        composed, now, codes, rows = Composed(), (), bytearray(), []

        def done():
            own = [symbols[c] for c in codes]
            cost, edits, tail = shortest(own, composed)
            count = dict.fromkeys(_FAULTS, 0)
            for _, f in own:
                count[f] += 1
            illegal = sum((a[0], b[0]) not in lawful for a, b in zip(own, own[1:]))
            gaps = last - first + 1 - n_turns if n_turns else 0
            rows.append((now[0], -1, None, len(own), gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, labels(edits, tail), tail))
            rows.extend((now[0], k // segment, edits[k : k + segment], *[None] * 9) for k in range(0, len(edits), segment))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema)

        for conv, _, turn, initial, fault in runs_of(batches):
            if now != (conv,):
                if now:
                    done()
                if len(rows) > 5_000:
                    yield out()
                    rows.clear()
                now, codes, first, last, n_turns = (conv,), bytearray(), None, None, 0
            codes.append(numbers[initial, fault])
            if turn is not None and turn != last:
                first, last, n_turns = turn if first is None else first, turn, n_turns + 1
        if now:
            done()
            yield out()

    return plan


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id, its rows damaged and then repaired."""
    out = repair(damaged(conversations))
    names = "conv_id", "repaired_sha256"

    def read(batches):
        now, rows = (), []

        def part():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string()))], list(names))

        for conv, _, _, _, role, text in runs_of(batches):
            if now != (conv,):
                if now:
                    rows.append((now[0], digest.hexdigest()))
                if len(rows) == 10_000:
                    yield part()
                    rows.clear()
                now, digest = (conv,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if now:
            rows.append((now[0], digest.hexdigest()))
            yield part()

    own = out.edited("conv_id").mapInArrow(read, "conv_id long, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    joined = every.join(out.reports.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left").join(own.alias("o"), F.col("e.conv_id").eqNullSafe(F.col("o.conv_id")), "left")
    zero = [F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("e.conv_id", *zero, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("o.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
