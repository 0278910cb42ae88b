"""Repair of conversations' structure by A* on the lattice of edits.

A repaired conversation's roles are ``(system? (user assistant)+)?``. A row may be kept, get the other
role, be deleted, and empty user or assistant rows may be put in anywhere. Blank rows and rows whose role
and text came before must go; a truncated row that stays costs something. Of the cheapest edits the
list that is least as a text of initials (D < I < K < R) is taken.

The search goes from (row, last role) to (row, last role). What the rows ahead cost at least - deletions
that must be, truncations that are charged or deleted - is a suffix sum, so it never overrates, and the
queue is keyed by (cost so far plus that, initials so far): the first arrival at a node is the cheapest and
the least of the cheapest.

Rows get global numbers in order of conversation and turn and are cut into blocks of ``BLOCK`` numbers.
Searches see only marks of rows, a conversation in a block at a time. A conversation that goes over
block bounds is searched from each last role at its entry to each at its exit; what these cost, and how their
initials compare, is enough to choose where the best way crosses the bounds. So a conversation that has
a third of all rows is many searches of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.ordered import in_order
from quillon.llm.shared import written

#: Rows of one search at most.
BLOCK = 1024
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated"}
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The last role after a kept row of a role, by (initial, last role) where that is legal.
_KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: The only role that may come after the last one, but for a system row at the start.
_NEXT = (USER, USER, ASSISTANT, USER)
#: What must be put in at a conversation's end, by its last role.
_CLOSE = ("", "II", "I", "")
_COST = {"b": DELETE, "d": DELETE, "t": min(TRUNCATED, DELETE), ".": 0}


def search(roles: str, faults: str, entry: int = START, exits: tuple[int, ...] = (START, ASSISTANT), closed: bool = True, every: bool = False) -> dict[int, tuple[int, str]]:
    """The cheapest edits of rows as {last role: (cost, initials)}, for the best of ``exits`` or for every one.

    ``roles`` has the rows' initials, ``faults`` a letter of ``FAULTS`` or a dot for each. Unless
    ``closed``, nothing is put in after the last row. Exits out of reach are left out.
    """
    n = len(roles)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + _COST[faults[i]]
    queue: list[tuple[int, str, int, int]] = [(ahead[0], "", 0, entry)]
    seen: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        total, audit, i, last = heappop(queue)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == n and last in exits:
            found[last] = (total, audit)
            if not every or len(found) == len(exits):
                break
        if i < n or closed:
            heappush(queue, (total + INSERT, audit + "I", i, _NEXT[last]))
        if i == n:
            continue
        spent = total - ahead[i] + ahead[i + 1]
        heappush(queue, (spent + DELETE, audit + "D", i + 1, last))
        if faults[i] in "bd":
            continue
        spent += TRUNCATED * (faults[i] == "t")
        heappush(queue, (spent + REROLE, audit + "R", i + 1, _NEXT[last]))
        if (roles[i], last) in _KEEP:
            heappush(queue, (spent, audit + "K", i + 1, _KEEP[roles[i], last]))
    return found


def replay(audit: str, roles: str, entry: int = START) -> list[str]:
    """The edits by rows: for each row what is put in before it (u or a), then K, D, or its new role U or A; after the last row what ends it."""
    out, part, last, i = [], "", entry, 0
    for edit in audit:
        if edit in "IR":
            last = _NEXT[last]
            part += ("u" if last == USER else "a") if edit == "I" else "U" if last == USER else "A"
        else:
            last = _KEEP[roles[i], last] if edit == "K" else last
            part += edit
        if edit != "I":
            out.append(part)
            part, i = "", i + 1
    return [*out[:-1], out[-1] + part] if out else out


def _orders(tables: list[dict[int, tuple[int, str]]]) -> tuple[list[int], list[int]]:
    """Costs and ranks of initials by (entry, exit), -1 where there is no way."""
    cost, rank = [-1] * 16, [-1] * 16
    for entry, table in enumerate(tables):
        for place, (_, last) in enumerate(sorted((audit, last) for last, (_, audit) in table.items())):
            cost[4 * entry + last], rank[4 * entry + last] = table[last][0], place
    return cost, rank


def crossings(costs: list[list[int]], ranks: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, exit) of each part of a conversation on the best way, from ``_orders`` of its parts.

    Ways of two parts end with the same row, so none's initials begin with another's whole, and an order
    of the parts before decides before one within a part.
    """
    best = {START: (0, 0)}
    back: list[dict[int, int]] = []
    for cost, rank in zip(costs, ranks, strict=True):
        ways = {}
        for last in range(4):
            found = [(best[e][0] + cost[4 * e + last], best[e][1], rank[4 * e + last], e) for e in best if cost[4 * e + last] >= 0]
            if found:
                ways[last] = min(found)
        order = {last: place for place, last in enumerate(sorted(ways, key=lambda x: ways[x][1:3]))}
        best = {last: (w[0], order[last]) for last, w in ways.items()}
        back.append({last: w[3] for last, w in ways.items()})
    last = min(best, key=lambda x: (best[x][0] + INSERT * len(_CLOSE[x]), best[x][1]))
    out = []
    for steps in reversed(back):
        out.append((steps[last], last))
        last = steps[last]
    return out[::-1]


def _key(conv: str) -> Column:
    """A text for a conversation's id, null ids too."""
    return F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit("n"))


def _marked(rows: DataFrame) -> DataFrame:
    """(block, key, at, role's initial, fault as far as the row tells, digest of role and text)."""
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t")
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("?")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("block", "key", "at", initial.alias("role"), fault.alias("fault"), digest.alias("digest"))


def _pieces(rows: DataFrame) -> DataFrame:
    """Conversations within blocks: (block, key, first number, roles, faults, digests by row)."""
    row = F.struct("at", "role", "fault", "digest")
    g = _marked(rows).groupBy("block", "key").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return g.select("block", "key", F.get("r", F.lit(0))["at"].alias("first"), F.array_join("r.role", "").alias("roles"), F.array_join("r.fault", "").alias("faults"), F.col("r.digest").alias("digests"))


def _with_bounds(pieces: DataFrame) -> DataFrame:
    """The pieces with ``part``: does their conversation go on in the next block or come from the one before?"""
    ends = pieces.groupBy("block").agg(F.min_by("key", "first").alias("head"), F.max_by("key", "first").alias("tail"))
    before = ends.select((F.col("block") + 1).alias("block"), F.col("tail").alias("before"))
    after = ends.select((F.col("block") - 1).alias("block"), F.col("head").alias("after"))
    around = before.join(after, "block", "full_outer")
    same = lambda c: F.coalesce(F.col("key") == F.col(c), F.lit(False))
    return pieces.join(around, "block", "left").withColumn("part", same("before") | same("after")).drop("before", "after")


def _late(parts: DataFrame) -> DataFrame:
    """(block, key, late): numbers of rows in a block whose role and text an earlier block has."""
    row = F.explode(F.transform("digests", lambda d, i: F.struct((F.col("first") + i).alias("at"), d.alias("digest"))))
    firsts = parts.select("block", "key", row.alias("r")).groupBy("key", "r.digest", "block").agg(F.min("r.at").alias("at"))
    seen = firsts.groupBy("key", "digest").agg(F.min("at").alias("seen"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return firsts.join(seen, ["key", "digest"]).where("at > seen").groupBy("block", "key").agg(F.collect_list("at").alias("late"))


_PIECE = "block long, key string, first long, roles string, faults string"


def _with_duplicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults with those of repeated rows: known in the block, or among the numbers of ``late``."""
    for batch in batches:
        columns = batch.to_pydict()
        faults = []
        for first, marks, digests, late in zip(columns["first"], columns["faults"], columns["digests"], columns["late"], strict=True):
            seen: set[bytes] = set()
            again = {at - first for at in late or ()}
            # a row that repeats one in its block repeats it whether or not that one is late
            own = []
            for i, (mark, digest) in enumerate(zip(marks, digests, strict=True)):
                own.append("d" if mark != "b" and (digest in seen or i in again) else mark)
                seen.add(digest)
            faults.append("".join(own))
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("block", "key", "first", "roles")}, "faults": pa.array(faults, pa.string())})


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and ranks of the parts of conversations that go over block bounds."""
    for batch in batches:
        columns = batch.to_pydict()
        found = [_orders([search(r, f, entry, (0, 1, 2, 3), closed=False, every=True) for entry in range(4)]) for r, f in zip(columns["roles"], columns["faults"], strict=True)]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "key": batch.column("key"), "costs": pa.array([c for c, _ in found], kind), "ranks": pa.array([r for _, r in found], kind)})


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block")
    ways = crossings([list(c) for c in group["costs"]], [list(r) for r in group["ranks"]])
    ends = [False] * (len(ways) - 1) + [True]
    return pd.DataFrame({"block": group["block"], "key": group["key"], "entry": [e for e, _ in ways], "leave": [x for _, x in ways], "last": ends})


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each piece by rows."""
    for batch in batches:
        columns = batch.to_pydict()
        out = []
        for roles, faults, entry, leave, ends in zip(columns["roles"], columns["faults"], columns["entry"], columns["leave"], columns["last"], strict=True):
            if entry is None:
                audit, entry = min(search(roles, faults).values())[1], START
            else:
                audit = search(roles, faults, entry, (leave,), closed=False)[leave][1] + _CLOSE[leave] * ends
            out.append(replay(audit, roles, entry))
        yield pa.RecordBatch.from_pydict({"first": batch.column("first"), "faults": batch.column("faults"), "script": pa.array(out, pa.list_(pa.string()))})


def repair(messages: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation, an edit a row.

    ``messages`` has conv_id, turn (null first), role and text; other columns aren't read. Null roles and
    texts are one space, rows with a null conv_id are one conversation. Rows of one turn come by role, then by
    the first 200 characters and a hash of the text. Returns conv_id, at (the row's number over all rows),
    step (edits at a row, those put in before it first), edit (Keep, Rerole, Delete, Insert by initial), turn,
    old_role, fault (null, blank, duplicate, truncated), role and text after the edit (null where deleted)
    and cost. Inserted rows have no turn, old_role or fault. Roles count by their first letter; any but s, u
    and a must be changed or deleted, and so must an empty role. An empty table has no edits.
    """
    one_space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = messages.select("conv_id", "turn", one_space("role"), one_space("text"))
    rows = in_order(rows, ["conv_id", "turn", "role", F.left("text", F.lit(200)), F.xxhash64("text")], "at", "turns")
    rows = rows.withColumn("block", F.expr(f"at DIV {BLOCK}")).withColumn("key", _key("conv_id"))
    bounds = _with_bounds(written(_pieces(rows), "pieces"))
    late = _late(bounds.where("part"))
    pieces = written(bounds.join(late, ["block", "key"], "left").select("block", "key", "first", "roles", "faults", "digests", "late", "part"), "pieces")
    known = pieces.drop("part").mapInArrow(_with_duplicates, _PIECE).join(pieces.select("block", "key", "part"), ["block", "key"])
    ways = known.where("part").drop("part").mapInArrow(_tables, "block long, key string, costs array<int>, ranks array<int>")
    # a row of 32 numbers for each part: of a conversation with n rows n / BLOCK
    chosen = ways.groupBy("key").applyInPandas(_chosen, "block long, key string, entry int, leave int, last boolean")
    scripts = known.join(chosen, ["block", "key"], "left").select("first", "roles", "faults", "entry", "leave", "last").mapInArrow(_scripts, "first long, faults string, script array<string>")
    by_row = scripts.select("first", "faults", F.posexplode("script").alias("i", "edits")).select((F.col("first") + F.col("i")).alias("at"), F.substr("faults", F.col("i") + 1, F.lit(1)).alias("mark"), "edits")
    step = F.posexplode(F.split("edits", "")).alias("step", "e")
    edits = rows.select("conv_id", "at", "turn", "role", "text").join(by_row, "at").select("*", step).where("e <> ''")
    own, kept = ~F.col("e").isin("u", "a"), F.col("e").isin("K", "U", "A")
    edit = F.when(~own, "I").when(F.col("e").isin("U", "A"), "R").otherwise(F.col("e"))
    role = F.when(F.lower("e") == "u", "user").when(F.lower("e") == "a", "assistant").when(kept, F.col("role"))
    base = F.when(~own, INSERT).when(F.col("e") == "D", DELETE).when(F.col("e") == "K", 0).otherwise(REROLE)
    fault = F.when(F.col("mark") == "b", "blank").when(F.col("mark") == "d", "duplicate").when(F.col("mark") == "t", "truncated")
    return edits.select(
        "conv_id",
        "at",
        "step",
        edit.alias("edit"),
        F.when(own, F.col("turn")).alias("turn"),
        F.when(own, F.col("role")).alias("old_role"),
        F.when(own, fault).alias("fault"),
        role.alias("role"),
        F.when(kept, F.col("text")).when(~own, "").alias("text"),
        (base + F.when(kept & (F.col("mark") == "t"), TRUNCATED).otherwise(0)).cast("long").alias("cost"),
    )


_SUMMARY = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = frozenset(("su", "ua", "au"))


class _Digest:
    """What is told of one conversation whose edits come in order."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS.values(), 0)
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, edit: str, turn: int | None, old_role: str | None, fault: str | None, role: str | None, text: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if self.initial is not None and self.initial + old_role[:1] not in _LEGAL:
                self.illegal += 1
            self.initial = old_role[:1]
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.turn:
                self.low = turn if self.low is None else self.low
                self.high = self.turn = turn
                self.turns += 1
        if role is not None:
            self.hash.update(f"{chr(10) * self.begun}{role}:".encode())
            self.hash.update(text.encode())
            self.begun = True

    def row(self, key: str) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, own = None, _Digest()
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in _SUMMARY.split(", "))])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        done = []
        for now, *values in zip(*(batch.column(c).to_pylist() for c in ("key", "edit", "turn", "old_role", "fault", "role", "text", "cost")), strict=True):
            if now != key:
                if key is not None:
                    done.append(own.row(key))
                key, own = now, _Digest()
            own.add(*values)
        if done:
            yield table(done)
    if key is not None:
        yield table([own.row(key)])


def summary(edits: DataFrame) -> DataFrame:
    """A row for each conversation with edits: what was wrong, what the repair costs, its initials and the hash of its texts.

    Edits stream through in order, so of a conversation only its initials are held.
    """
    ordered = edits.withColumn("key", _key("conv_id")).drop("conv_id").repartition("key").sortWithinPartitions("key", "at", "step")
    return ordered.mapInArrow(_digests, _SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults that depend on conv_id and turn; nulls in the key, roles and texts are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), twice.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; one without rows after the damage has zeros and the hash of an empty text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    found = summary(repair(damaged(rows)))
    every = rows.select("conv_id").distinct().withColumn("key", _key("conv_id")).join(found, "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
