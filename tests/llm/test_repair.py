"""Repair: the search against all lists of edits, crossings against one search, the query against a second implementation."""

import hashlib
import random
import re
import zlib

import pytest

from quillon.llm import op11_repair as R

SHAPE = re.compile(r"(s?(ua)+)?")


def every_list(roles, faults, most):
    """All (cost, initials) of legal edits that cost no more than ``most``."""
    out = []

    def go(i, made, audit, cost):
        if cost > most:
            return
        if i == len(roles) and SHAPE.fullmatch(made):
            out.append((cost, audit))
        for r in "ua":
            go(i, made + r, audit + "I", cost + 2)
        if i == len(roles):
            return
        go(i + 1, made, audit + "D", cost + 3)
        if faults[i] not in "bd":
            extra = faults[i] == "t"
            go(i + 1, made + roles[i], audit + "K", cost + extra)
            for r in "ua":
                go(i + 1, made + r, audit + "R", cost + extra + 2)

    go(0, "", "", 0)
    return out


def random_rows(rng, n):
    return "".join(rng.choice("suaua?") for _ in range(n)), "".join(rng.choice("...tbd") for _ in range(n))


def test_search_is_the_least_of_all():
    rng = random.Random(1)
    for _ in range(150):
        roles, faults = random_rows(rng, rng.randint(0, 3))
        assert min(R.search(roles, faults).values()) == min(every_list(roles, faults, 3 * len(roles)))


def test_known_repairs():
    assert R.search("ua", "..") == {R.ASSISTANT: (0, "KK")}
    assert min(R.search("uua", "...").values()) == (2, "KIKK")
    assert min(R.search("s", ".").values()) == (3, "D")
    assert min(R.search("u", "t").values()) == (3, "D")  # as dear as KI, and D comes first
    assert R.replay("KIKK", "uua") == ["K", "aK", "K"]
    assert R.replay("KI", "u") == ["Ka"]
    assert R.replay("RI", "?") == ["Ua"]


def test_crossings_equal_one_search():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(2, 12)
        roles, faults = random_rows(rng, n)
        cuts = sorted({0, n, *(rng.randint(1, n - 1) for _ in range(rng.randint(1, 4)))})
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        tables = [R._orders([R.search(roles[a:b], faults[a:b], e, (0, 1, 2, 3), False, True) for e in range(4)]) for a, b in parts]
        ways = R.crossings([c for c, _ in tables], [r for _, r in tables])
        found = [R.search(roles[a:b], faults[a:b], e, (x,), False)[x] for (a, b), (e, x) in zip(parts, ways, strict=True)]
        close = R._CLOSE[ways[-1][1]]
        assert (sum(c for c, _ in found) + 2 * len(close), "".join(a for _, a in found) + close) == min(R.search(roles, faults).values())


def plain(given):
    """The query's rows by conversation, row by row."""
    out = {}
    for conv in {r[0] for r in given}:
        rows = []
        for c, turn, role, text in given:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
                rows += [row] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = "", set()
        for _, role, text in rows:
            ended = text.rstrip(" \t\n\x0b\x0c\r")
            faults += "b" if not ended else "d" if (role, text) in seen else "." if ended[-1] in ".!?" else "t"
            seen.add((role, text))
        roles = "".join(r[1][:1] if r[1][:1] in tuple("sua") else "?" for r in rows)
        best = {(0, 0): (0, "")}  # forwards over nodes, cheapest and least first
        for i in range(len(rows) + 1):
            for _ in range(4):
                for last in range(4):
                    if (i, last) in best:
                        cost, audit = best[i, last]
                        to = (i, R._NEXT[last])
                        best[to] = min(best.get(to, (9e9, "")), (cost + 2, audit + "I"))
            if i == len(rows):
                break
            for last in range(4):
                if (i, last) not in best:
                    continue
                cost, audit = best[i, last]
                steps = [(last, 3, "D")]
                if faults[i] not in "bd":
                    charge = faults[i] == "t"
                    steps.append((R._NEXT[last], 2 + charge, "R"))
                    legal = {"s": last == 0, "u": last in (0, 1, 3), "a": last == 2}.get(roles[i], False)
                    if legal:
                        steps.append(("suaa".index(roles[i]) + 1, charge, "K"))
                for after, extra, edit in steps:
                    to = (i + 1, after)
                    best[to] = min(best.get(to, (9e9, "")), (cost + extra, audit + edit))
        cost, audit = min(best[len(rows), x] for x in (0, 3) if (len(rows), x) in best)
        lines, i, made = [], 0, ""
        for e in audit:
            if e in "IR":
                role = "assistant" if made[-1:] == "u" else "user"
            if e == "I":
                lines.append(f"{role}:")
            elif e in "KR":
                role = rows[i][1] if e == "K" else role
                lines.append(f"{role}:{rows[i][2]}")
            made += role[:1] if e in "IKR" else ""
            i += e != "I"
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def given_rows():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice((1, 2, 5, 9, 40))):
            text = rng.choice(("Fine.", "So!", "cut off", " \n", "", None, "Ends. \t", f"No {rng.random()}?", "é" * 300, "z\x85"))
            rows.append((conv, rng.choice((None, turn, turn, turn + 3)), rng.choice(("user", "assistant", "system", "tool", "", None, "user", "assistant")), text))
    return rows + rows[:20]


@pytest.mark.parametrize("block", [3, 1024])
def test_query_against_plain(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    given = given_rows()
    d = spark.createDataFrame([(*r, "x") for r in given], "conv_id long, turn long, role string, text string, audit string")
    d.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    out = R.op11_repair(spark, str(tmp_path)).collect()
    # 300 equal characters and more never tie in their turn and role but as repeated rows
    assert {r["conv_id"]: tuple(r)[1:] for r in out} == plain(given)


def test_the_table(spark):
    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = R.op11_repair(spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in out} == plain(given) and len(out) == 100


def test_repaired_shape_and_empty(spark):
    d = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (2, 0, "system", "x.")], "conv_id long, turn long, role string, text string")
    edits = R.repair(d).orderBy("at", "step").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"], r["fault"], r["cost"]) for r in edits] == [
        (1, "I", "user", "", None, 2), (1, "K", "assistant", "Hi.", None, 0), (1, "D", None, None, "truncated", 3), (2, "D", None, None, None, 3)
    ]
    assert R.repair(d.where("false")).collect() == [] and R.summary(R.repair(d.where("false"))).collect() == []
