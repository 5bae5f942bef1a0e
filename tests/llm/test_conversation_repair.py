import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from corpusloom.llm import conversation_repair
from corpusloom.llm.queries import OP12_SQL, oracle_sql, queries

BLANK = " \t\n\v\f\r"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_repair(rows):
    """Counts, and the cheapest edits by trying all with few insertions."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows} - {None}
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(BLANK)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {(0, ""): (0, "", "")}  # by initials kept in mind as a legal beginning: (cost, audit, roles and texts)

    def legal(x):
        return re.fullmatch("s?(ua)*u?", x) is not None

    def state(x):
        return "" if not x else x[-1]

    def widened(found):
        for _ in range(3):
            for (n, x), (c, w, out) in list(found.items()):
                for role in ("user", "assistant"):
                    y = x + role[0]
                    if legal(y):
                        put(found, n, y, (c + 2, w + "I", f"{out}\n{role}:"))
        return found

    def put(found, n, x, value):
        key = n, "s" if x == "s" else state(x)
        x = {"": "", "s": "s", "u": "u", "a": "ua"}[key[1]]
        if (n, x) not in found or value < found[n, x]:
            found[n, x] = value

    best = widened({(0, ""): (0, "", "")})
    for i, ((_, _, role, text), fault) in enumerate(zip(rows, faults, strict=True), 1):
        found = {}
        for (_, x), (c, w, out) in best.items():
            put(found, i, x, (c + 3, w + "D", out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                for new, price, initial in [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")]:
                    if new[:1] in "sua" and new and legal(x + new[0]):
                        put(found, i, x + new[0], (c + price + late, w + initial, f"{out}\n{new}:{text}"))
        best = widened(found)
    cost, audit, out = min(v for (_, x), v in best.items() if x in ("", "ua"))
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(out[1:].encode()).hexdigest())


def made(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "no", "", None, " \t\n", "What? ", "x.\x0b", " ", "é!", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as copy", "'x' as audit")


def expected(rows, damaged):
    by = {r[0]: [] for r in rows}
    for r in damaged:
        by[r[0]].append(r)
    return {c: plain_repair(rs) for c, rs in by.items()}


@pytest.mark.parametrize("bits", [10, 1])
def test_against_plain_dynamic_programming(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    rows = made(150)
    df = frame(spark, rows)
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(conversation_repair.damage(df), df).collect()}
    assert got == expected(rows, list(plain_damage(rows))) and len(got) > 100


def test_a_conversation_with_most_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", 4)
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{'w' * (200_000 if i == 7 else 3)}{i}.") for i in range(700)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = frame(spark, rows)
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df).collect()}
    assert got == expected(rows, rows) and got[2][5:7] == (0, "KK")
    turns = sorted(conversation_repair.repaired_turns(df).where("conv_id = 1").collect(), key=lambda r: r["place"])
    assert [r["role"] for r in turns] == ["user", "assistant"] * (len(turns) // 2) and [r["place"] for r in turns] == list(range(len(turns)))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == got[1][-1]


def test_nothing_left_and_empty_tables(spark):
    df = frame(spark, [])
    assert conversation_repair.repair(df).collect() == [] and conversation_repair.repaired_turns(df).collect() == []
    row = conversation_repair.repair(df, spark.sql("SELECT 5L AS conv_id")).collect()
    assert [tuple(r) for r in row] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_equals_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    answer = con.execute(oracle_sql()["op12_conversation_repair"])
    names = [d[0] for d in answer.description]
    got = queries()["op12_conversation_repair"](spark, sf)
    assert got.columns == names and OP12_SQL
    rows = sorted(map(tuple, answer.fetchall()))
    assert sorted(map(tuple, got.collect())) == rows and sum("D" in r[7] for r in rows) > 5
