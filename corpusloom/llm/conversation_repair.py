"""Repair of damaged conversations by the cheapest edits that give a legal order of roles.

Roles have to be an optional system turn followed by pairs of user and
assistant, or nothing at all.  A conversation's turns and the states of that
grammar span a lattice; an edit of a turn leads to the next turn, an insertion to
another state of the same turn.  Dijkstra's search over it has the priority
(cost, audit), audit being the initials of the edits so far, and stops at the
first accepting node that it pops behind the last turn.  Two ways to one node of
equal cost never have audits of which one begins with the other (they differ in
the number of insertions, hence in cost), so the order of audits holds however
they go on.

Turns are sorted over all conversations at once, so a conversation with very many
turns is spread over tasks.  What the search needs of a turn is one character.
Conversations of up to BLOCK turns are searched whole; longer ones in blocks,
from every state to every state, and the blocks' tables are multiplied.  A
digest of all repaired turns reads a conversation in order, a batch at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.runtime import materialise, partitions, tidy

#: Bits of a position within a block.
BLOCK_BITS = 10
BLANKS = " \t\n\x0b\x0c\r"

#: A turn's code: class of its role (system, user, assistant, other), by lack of faults, truncated, or to be deleted.
CODES = "suaoSUAO1234"
#: Grammar states: nothing yet, system, user, assistant; and what each initial leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The initial that an insertion or a new role has in each state.
NEXT = "uuau"
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

Table = dict[tuple[int, int], tuple[int, str]]


def _edits(code: str | None, state: int) -> Iterator[tuple[int, str, bool, int]]:
    """(cost, initial, whether the turn is consumed, next state)."""
    other = STEP[state, NEXT[state]]
    yield 2, "I", False, other
    if code is None:
        return
    place = CODES.index(code)
    yield 3, "D", True, state
    if place < 8:
        late, kept = place // 4, STEP.get((state, CODES[place % 4]))
        if kept is not None:
            yield late, "K", True, kept
        yield 2 + late, "R", True, other


def search(codes: str, start: int = 0, every_end: bool = False) -> Table:
    """The cheapest edits from a state before the first turn to the first accepting state behind the last, or to each state there."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(codes) and (every_end or state in ACCEPTING):
            found[start, state] = cost, audit
            if not every_end:
                break
        for more, initial, consumed, to in _edits(codes[at] if at < len(codes) else None, state):
            if (at + consumed, to) not in done:
                heapq.heappush(heap, (cost + more, audit + initial, at + consumed, to))
    return found


def product(one: Table, two: Table) -> Table:
    out: Table = {}
    for (a, b), (cost, audit) in one.items():
        for (c, d), (more, rest) in two.items():
            if b == c and ((a, d) not in out or cost + more <= out[a, d][0]):
                found = cost + more, audit + rest
                out[a, d] = min(out.get((a, d), found), found)
    return out


def composed(tables: list[Table]) -> tuple[int, str]:
    """The cheapest accepted edits of a conversation from the tables of its blocks, multiplied in pairs."""
    while len(tables) > 1:
        tables = [product(*pair) if len(pair) == 2 else pair[0] for pair in (tables[i : i + 2] for i in range(0, len(tables), 2))]
    return min(found for (a, b), found in tables[0].items() if a == 0 and b in ACCEPTING)


def _illegal(codes: str) -> int:
    kinds = "".join(CODES[CODES.index(c) % 4] for c in codes)
    return sum(kinds[i : i + 2] not in ("su", "ua", "au") for i in range(len(kinds) - 1))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        best = [min(search(c).values()) for c in codes]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([_illegal(c) for c in codes], pa.int64()), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())], names=["conv_id", "illegal", "cost", "audit"])


_ENTRY = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of each block, and how many of its neighbouring turns, the one before it included, are illegal."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes, before = batch.column("codes")[i].as_py(), batch.column("before")[i].as_py() or ""
            entries = [{"a": a, "b": b, "cost": c, "audit": w} for start in range(4) for (a, b), (c, w) in search(codes, start, every_end=True).items()]
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([row.column("conv_id"), row.column("block"), pa.array([_illegal(before + codes)], pa.int64()), pa.array([entries], pa.list_(_ENTRY))], names=["conv_id", "block", "illegal", "entries"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [composed([{(e["a"], e["b"]): (e["cost"], e["audit"]) for e in t["entries"]} for t in tables]) for tables in batch.column("tables").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("illegal"), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())], names=["conv_id", "illegal", "cost", "audit"])


def _rebuilt(rows: Iterator[tuple[object, str | None, str, str]]) -> Iterator[tuple[object, int, str | None, str | None, str]]:
    """(conversation, place, role, text, edit) of repaired turns; a conversation's audit comes before its turns.

    Each conversation ends with a row without a role.
    """
    conv, audit, at, place, state, running = None, "", 0, 0, 0, False

    def inserted() -> Iterator[tuple[object, int, str | None, str | None, str]]:
        nonlocal at, place, state
        while audit[at : at + 1] == "I":
            role = NEXT[state]
            yield conv, place, ROLES[role], "", "I"
            at, place, state = at + 1, place + 1, STEP[state, role]

    for of, new, role, text in rows:
        if new is not None:
            if running:
                yield from inserted()
                yield conv, place, None, None, ""
            conv, audit, at, place, state, running = of, new, 0, 0, 0, True
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        role = role if edit == "K" else ROLES[NEXT[state]]
        yield conv, place, role, text, edit
        place, state = place + 1, STEP[state, role[:1]]
    if running:
        yield from inserted()
        yield conv, place, None, None, ""


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str, str]]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")], strict=True)


def _digests(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, out = hashlib.sha256(), []
        for conv, place, role, text, _ in _rebuilt(_flat(batches)):
            if role is None:
                out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                sha = hashlib.sha256()
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())]))
                    out = []
            else:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())]))

    return run


def _turns(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in _rebuilt(_flat(batches)):
            if row[2] is not None:
                out.append(dict(zip(schema.names, row, strict=True)))
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one of five damages in a quarter of the rows, chosen by a CRC-32 of conversation and turn.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it a user's.  Null
    roles and texts, and nulls in what is hashed, are one space.
    """
    shown = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    rows = df.select(df["conv_id"].alias("conv_id"), df["turn"].cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _sorted(df: DataFrame) -> DataFrame:
    """A written table of all turns with a position that follows conversation, turn (nulls first) and, on ties, role and text.

    Texts of one turn and role are told apart by their first 64 characters, then
    by a hash; equal rows by where they are read.
    """
    rows = df.select(df["conv_id"].alias("conv_id"), df["turn"].cast("long").alias("turn"), F.coalesce(df["role"], F.lit(" ")).alias("role"), F.coalesce(df["text"], F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("came"))
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "h": F.xxhash64("text")})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "h", "came"]
    dealt = rows.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return materialise(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, role class 0 to 3, fault) of sorted turns: null, 'blank', 'duplicate' or 'truncated', the first that is true."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = turns.select("conv_id", "turn", "pos", "role", F.md5("text").alias("digest"), (end == "").alias("blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("ended"))
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return narrow.join(first, same, "left").select("conv_id", "turn", "pos", kind.cast("int").alias("kind"), fault.alias("fault"))


def _solved(flagged: DataFrame) -> DataFrame:
    """A written table (conv_id, illegal, cost, audit)."""
    kind = flagged.schema["conv_id"].dataType.simpleString()
    level = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    code = F.substr(F.lit(CODES), F.col("kind") + 4 * level + 1, F.lit(1))
    blocks = flagged.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x["code"]), "").alias("codes"))
    # a character for each turn, as many as the result's audit has at least
    whole = materialise(blocks.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "codes"))), lambda x: x["codes"]).alias("blocks")), "codes")
    result = f"conv_id {kind}, illegal long, cost long, audit string"
    short = whole.where(F.size("blocks") == 1).select("conv_id", F.col("blocks")[0].alias("codes")).mapInArrow(tidy(_searched), result)
    with_last = F.transform("blocks", lambda x, i: F.struct(x.alias("codes"), F.when(i > 0, F.right(F.get("blocks", i - 1), F.lit(1))).alias("before")))
    long_ = whole.where(F.size("blocks") > 1).select("conv_id", F.posexplode(with_last).alias("block", "part")).select("conv_id", "block", "part.codes", "part.before")
    tables = long_.repartition(partitions(flagged.sparkSession), "conv_id", "block").mapInArrow(tidy(_tables), f"conv_id {kind}, block int, illegal long, entries array<struct<a: int, b: int, cost: long, audit: string>>")
    together = tables.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.transform(F.array_sort(F.collect_list(F.struct("block", "entries"))), lambda x: F.struct(x["entries"].alias("entries"))).alias("tables"))
    return materialise(short.unionByName(together.mapInArrow(tidy(_joined), result)), "repairs")


def _streamed(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, conversation after conversation."""
    rows = turns.select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "role", "text").unionByName(solved.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", F.lit("").alias("role"), F.lit("").alias("text")))
    return rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "audit", "role", "text")


def _arrow_kind(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def repaired_turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of every conversation after the cheapest repair, inserted ones with empty text."""
    turns = _sorted(df)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _streamed(turns, _solved(faults(turns))).mapInArrow(tidy(_turns(_arrow_kind(turns))), f"conv_id {kind}, place long, role string, text string, edit string")


def repair(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps`` are numbers missing between the least and the largest turn; the three
    faults count the turns whose first fault they are, in order of turn (nulls
    first; ties by role and text); ``illegal`` counts neighbours whose roles may
    not follow each other.  ``audit`` has an initial for each of the cheapest
    edits in order (Keep, Rerole, Delete, Insert), the least one of those that
    cost the same; the digest is that of the repaired turns.

    Null roles and texts are one space.  Null ids are one conversation.  ``ids``
    may name conversations (conv_id) that have no turn left: zeros, no edits, the
    digest of nothing.  Repeated rows are turns of their own, and duplicates.
    Further columns are ignored, an empty table gives an empty one.
    """
    turns = _sorted(df)
    flagged = materialise(faults(turns), "faults")
    solved = _solved(flagged)
    kind = turns.schema["conv_id"].dataType.simpleString()
    digests = _streamed(turns, solved).mapInArrow(tidy(_digests(_arrow_kind(turns))), f"conv_id {kind}, repaired_sha256 string")
    counted = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = flagged.groupBy("conv_id").agg(gaps.alias("gaps"), *[counted(c) for c in ("blank", "duplicate", "truncated")])
    named = turns.select("conv_id") if ids is None else ids.select(ids["conv_id"].alias("conv_id"))
    parts = [named.distinct(), counts, solved, digests]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    filled: list[Column] = [F.coalesce(F.max(c), F.lit(v).cast("string" if isinstance(v, str) else "long")).alias(c) for c, v in none.items()]
    return out.groupBy("conv_id").agg(*filled)
