"""Target encoding in the order of time, without looking at the own fold or ahead.

For every fact and column the history is all facts of other folds that happened
more than ``gap`` before; its count and its positives among facts of the same
value give a rate, smoothed towards the rate of a coarser column.

1. Facts are written once, and pass by pass they get the sums of their history
   for one column; all columns of at most FEW values share one pass.  A pass is
   one shuffle of the facts: each goes to its cell and leaves it with its sums,
   so that nothing is joined back.  The table before and the shuffle's files are
   deleted when the table with the sums is written.
2. A cell is a key and a time chunk, of which keys with few rows have one; for
   the columns of few values it is a time chunk of all facts.  It starts from
   carried totals: running sums of the chunks' totals by column, key and fold.
3. Inside a cell, running sums of the key less those of the key and own fold are
   the history of a fact.
4. A coarser column that is a function of a finer one comes with its pass, from
   one row of the dimension for each cell.
5. Many facts of one key, fold and instant go to their cell as one sum, whose
   history is joined to them.

Only lists of at most KEYS rows are broadcast: keys that are cut, cells that are
overfull, and instants of many facts.  A key that is not cut has at most
max(CELL, rows / KEYS) rows; one that is cut has at most CHUNKS chunks, whose
totals are one short group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, LongType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.llm.runtime import materialise, rewritten, tidy, unused

#: Rows of a key from which it is cut, chunks of a key, and cut keys of a column, at most.
CELL, CHUNKS, KEYS = 4_096, 16_384, 4_096
#: Values of columns that share a pass, at most; rows of their cells, and rows from which a cell is searched for hot instants, in units of CELL.
FEW, WIDE, FULL = 256, 8, 16
#: Rows that a task sums at a time.
PART = 131_072

NULL = -(2**63)
def _key(df: DataFrame, column: str) -> Column:
    """Whole numbers are their own keys, other values are hashed; null is one more value."""
    whole = isinstance(df.schema[column].dataType, IntegralType)
    return F.when(df[column].isNull(), F.lit(NULL)).otherwise(df[column].cast("long") if whole else F.xxhash64(df[column]))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before; the first row too."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _before(new: np.ndarray, running: np.ndarray) -> np.ndarray:
    """What had been added up where each row's run began."""
    first = np.flatnonzero(new)
    return np.repeat(np.r_[0, running[first[1:] - 1]], np.diff(np.r_[first, len(running)]))


#: Kinds of rows that a cell receives: facts that count as history in another cell, and in this one; sums of facts of one instant,
#: likewise; history of another cell's facts; a dimension's row; from CARRIED on, by column, totals of the chunks before.
PROBE, BOTH, SUM_PROBE, SUM_BOTH, HISTORY, DIMENSION, CARRIED = range(7)


def _whole_cells(batches: Iterator[pa.RecordBatch], cell: list[str], rows: int) -> Iterator[pa.Table]:
    """About ``rows`` rows at a time, cut where a cell ends; cells come one after the other."""
    held: list[pa.RecordBatch] = []
    left: list[pa.Table] = []
    n, last = 0, None

    def cut(part: pa.Table) -> Iterator[pa.Table]:
        nonlocal left, last
        ids = [part.column(c).to_numpy() for c in cell]
        new = np.flatnonzero(_runs(*ids))
        if last == tuple(x[0] for x in ids):
            new = new[1:]
        last = tuple(x[-1] for x in ids)
        at = int(new[-1]) if len(new) else 0
        if len(new) and (left or at):
            yield pa.concat_tables([*left, part.slice(0, at)]).combine_chunks()
            left = []
        left.append(part.slice(at))

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from cut(pa.Table.from_batches(held).combine_chunks())
            held, n = [], 0
    if n:
        yield from cut(pa.Table.from_batches(held).combine_chunks())
    if left:
        yield pa.concat_tables(left).combine_chunks()


def _attached(own: list[str], roles: list[str], cell: list[str], mark: str, keys: list[str], found: list[str], of: str | None, gap: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Facts with the sums of their history, and with the value of a dimension; ``roles`` are time, fold, n and s."""

    def solved(table: pa.Table) -> pa.Table:
        at, fold, n, s = (pc.fill_null(table.column(c), 0).to_numpy() for c in roles)
        kind = table.column(mark).to_numpy()
        place = np.cumsum(_runs(*[table.column(c).to_numpy() for c in cell]))
        fact = kind <= SUM_BOTH
        probe = np.flatnonzero(fact)
        out = table.select(own).filter(pa.array(fact)) if len(probe) < len(fact) else table.select(own)
        values = []
        for i in range(len(found) // 2):
            past = np.flatnonzero((kind == BOTH) | (kind == SUM_BOTH) | (kind == HISTORY) | (kind == CARRIED + i))
            row = np.r_[probe, past]
            # carried totals have the least time, which the gap must not wrap around
            when = np.r_[at[probe] * 2, np.where(at[past] == NULL, NULL // 2, (at[past] + gap) * 2 + 1)]
            group = [table.column(keys[i]).to_numpy()[row]] if keys else []
            group.append(place[row])
            add = [np.r_[np.zeros(len(probe), np.int64), x[past]] for x in (n, s)]
            sums = [np.zeros(len(row), np.int64) for _ in add]
            for by, sign in ((group, 1), ([fold[row], *group], -1)):
                order = np.lexsort((when, *by))
                new = _runs(*[x[order] for x in by])
                for x, total in zip(add, sums, strict=True):
                    running = np.cumsum(x[order])
                    total[order] += sign * (running - _before(new, running))
            values += [total[: len(probe)] for total in sums]
        if of:
            value = np.full(place[-1] + 1, NULL, np.int64)
            row = np.flatnonzero(kind == DIMENSION)
            value[place[row]] = s[row]
            values.append(value[place[probe]])
        for name, x in zip([*found, *([of] if of else [])], values, strict=True):
            out = out.append_column(name, pa.array(x, pa.int64()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, cell, rows):
            # rows of a dimension can be alone in their cells
            if pc.min(table.column(mark)).as_py() <= SUM_BOTH:
                yield from solved(table).to_batches(max_chunksize=32_768)

    return run


def _with_history(facts: DataFrame, keys: dict[str, Column], shared: bool, at: str, fold: str, n: str, s: str, gap: int, span: tuple[int, int, int], spent: list[str], dimension: tuple[str, DataFrame] | None = None) -> DataFrame:
    """``facts``, a written table, with <label>_n and <label>_s for each of ``keys``: one column, or several that share their cells.

    ``dimension`` is a name and a table (key, value) of longs: facts get the value of their key as a further column, NULL without one.
    ``spent`` gets the path of a table that the result reads besides ``facts``.
    """
    rows, low, high = span
    width = float(high - low + 1)
    cell, chunk, mark, chunks = unused(facts, "cell", "chunk", "mark", "chunks")
    named = unused(facts, *[f"key_of_{i}" for i in range(len(keys))]) if shared else ()
    found = [f"{label}_{x}" for label in keys for x in "ns"]
    limit = max(CELL, rows // KEYS)

    def chunk_of(when: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most - 1, F.floor((when - low) / F.lit(width) * most))).cast("int")

    if shared:
        most = F.lit(min(CHUNKS, max(1, -(-rows // (WIDE * CELL)))))
        dealt = facts.select("*", F.lit(0).cast("long").alias(cell), most.alias(chunks), *[k.alias(c) for k, c in zip(keys.values(), named, strict=True)])
        cut_facts, own_keys = dealt, [F.col(c) for c in named]
    else:
        key = next(iter(keys.values()))
        counts = facts.select(key.alias(cell)).groupBy(cell).count().where(F.col("count") > limit)
        cut = F.broadcast(materialise(counts.select(cell, F.least(F.lit(CHUNKS), F.ceil(F.col("count") / CELL)).cast("int").alias(chunks)), "cut-keys"))
        keyed = facts.select("*", key.alias(cell))
        dealt = keyed.join(cut, cell, "left").withColumn(chunks, F.coalesce(chunks, F.lit(1)))
        cut_facts, own_keys = keyed.join(cut, cell), [F.col(cell)]

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), k.alias("key")) for i, k in enumerate(own_keys)]))
    totals = cut_facts.select(each.alias("e"), F.col(chunks).alias("chunks"), chunk_of(F.col(at) + gap, F.col(chunks)).alias("chunk"), F.col(fold).alias("fold"), F.col(n).alias("n"), F.col(s).alias("s")).groupBy("e.col", "e.key", "chunks", "chunk", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    so_far = Window.partitionBy("col", "key", "fold").orderBy("chunk")
    after = F.sequence(F.col("chunk") + 1, F.least(F.coalesce(F.lead("chunk").over(so_far), F.lit(CHUNKS)), F.col("chunks") - 1))
    carried = totals.withColumns({"n": F.sum("n").over(so_far), "s": F.sum("s").over(so_far), "next": F.when(F.col("chunk") + 1 < F.col("chunks"), after)}).select("col", "key", F.explode("next").alias("chunk"), "fold", "n", "s")

    dealt = dealt.withColumn(chunk, chunk_of(F.col(at), F.col(chunks)))
    own = facts.columns
    # instants of many facts, in cells of many facts
    instant = [cell, chunk, at, fold]
    crowded = cut_facts.groupBy(cell, chunk_of(F.col(at), F.col(chunks)).alias(chunk)).count().where(F.col("count") > max(FULL * CELL, limit)).select(cell, chunk)
    inside = cut_facts.withColumn(chunk, chunk_of(F.col(at), F.col(chunks))).select(*instant).join(F.broadcast(crowded), [cell, chunk])
    hot = materialise(inside.groupBy(*instant).count().where(F.col("count") > limit).select(*instant), "hot-instants")
    is_hot = hot.first() is not None
    cold = dealt.join(F.broadcast(hot), instant, "left_anti") if is_hot else dealt

    def partial(df: DataFrame, given: dict[str, Column]) -> DataFrame:
        return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in facts.schema], *[given[c].alias(c) for c in (cell, chunk, mark, *named)])

    moved = chunk_of(F.col(at) + gap, F.col(chunks))
    parts = [cold.select(*own, cell, chunk, F.when(moved == F.col(chunk), BOTH).otherwise(PROBE).alias(mark), *named) if gap else cold.select(*own, cell, chunk, F.lit(BOTH).alias(mark), *named)]
    if is_hot:
        hot_facts = dealt.join(F.broadcast(hot), instant, "left_semi")
        groups = hot_facts.groupBy(*instant, chunks, *named).agg(F.sum(n).alias(n), F.sum(s).alias(s))
        same = {c: F.col(c) for c in (*instant, n, s, *named)}
        parts.append(partial(groups, same | {mark: F.when(moved == F.col(chunk), SUM_BOTH).otherwise(SUM_PROBE)}))
    if gap:
        same = {c: F.col(c) for c in (cell, at, fold, n, s, *named)}
        parts.append(partial(cold.where(moved != F.col(chunk)), same | {chunk: moved, mark: F.lit(HISTORY)}))
        if is_hot:
            parts.append(partial(groups.where(moved != F.col(chunk)), same | {chunk: moved, mark: F.lit(HISTORY)}))
    key_of = {c: F.when(F.col("col") == i, F.col("key")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(named)}
    parts.append(partial(carried, {cell: F.lit(0).cast("long") if shared else F.col("key"), chunk: F.col("chunk"), at: F.lit(NULL), fold: F.col("fold"), n: F.col("n"), s: F.col("s"), mark: F.col("col") + CARRIED} | key_of))
    if dimension:
        name, values = dimension
        placed = values.select(F.col("key").alias(cell), "value").join(cut, cell, "left").select(cell, "value", F.explode(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1)).alias(chunk))
        parts.append(partial(placed, {c: F.col(c) for c in (cell, chunk)} | {at: F.lit(0), fold: F.lit(0), n: F.lit(0), s: F.col("value"), mark: F.lit(DIMENSION)}))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    # a hash first, whose order is that of most comparisons
    sorted_ = united.repartition(cell, chunk).sortWithinPartitions(F.xxhash64(cell, chunk), cell, chunk)
    kept = [*own, *([cell, chunk, mark, *named] if is_hot else [])]
    more = [*found, *([dimension[0]] if dimension else [])]
    schema = StructType([StructField(f.name, f.dataType) for f in sorted_.select(*kept).schema] + [StructField(c, LongType()) for c in more])
    out = sorted_.mapInArrow(tidy(_attached(kept, [at, fold, n, s], [cell, chunk], mark, list(named), found, dimension[0] if dimension else None, gap, PART)), schema)
    if not is_hot:
        return out
    done, path = rewritten(out, "history-with-sums")
    spent.append(path)
    sums = done.where(F.col(mark) >= SUM_PROBE).select(*instant, *named, *more)
    sums = F.broadcast(sums) if sums.count() <= 16 * KEYS else sums.hint("shuffle_hash")
    return done.where(F.col(mark) < SUM_PROBE).select(*own, *more).unionByName(hot_facts.join(sums, [*instant, *named]).select(*own, *more))


def _encoded(facts: DataFrame, chains: list[list[str]], *, at: str, fold: str, n: str, s: str, prior: Column, gap: int = 0, weight: int = 50, scale: int = 1_000_000, of: dict[str, tuple[str, DataFrame]] | None = None, spent: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """As ``encode``; also the paths of what the result reads. Tables at ``spent``, which ``facts`` reads, are deleted when no longer needed.

    ``of``: columns that ``facts`` does not have, as functions of those that it has: the column, and a table (key, value) of longs.
    """
    names, columns, of = list(dict.fromkeys(c for chain in chains for c in chain)), facts.columns, of or {}
    roles = [at, fold, n, s]
    short = unused(facts, "fact_at", "fact_fold", "fact_n", "fact_s")
    kinds = [LongType(), IntegerType(), LongType(), LongType()]
    cast = {c: h for c, h, t in zip(roles, short, kinds, strict=True) if facts.schema[c].dataType != t}
    table, path = rewritten(facts.select("*", *[facts[c].cast(t).alias(cast[c]) for c, t in zip(roles, kinds, strict=True) if c in cast]), "facts", spent or ())
    paths = [path]
    roles = [cast.get(c, c) for c in roles]
    rows, low, high = table.agg(F.count("*"), F.min(roles[0]), F.max(roles[0])).first()
    span = (rows, low or 0, high or 0)
    derived: dict[str, str] = {}

    def keys(group: list[str]) -> dict[str, Column]:
        return {c or "all": F.col(derived[c]) if c in derived else _key(table, c) if c else F.lit(0).cast("long") for c in group}

    out, read = table, []

    def written() -> DataFrame:
        """What the last pass has found, as a table."""
        nonlocal table, out, paths, read
        if out is not table:
            table, path = rewritten(out, "history", [*paths, *read])
            out, paths, read = table, [path], []
        return table

    for name, (source, values) in of.items():
        table = written()
        hidden = unused(table, f"key_of_{name}")[0]
        out = _with_history(table, keys([source]), False, *roles, gap, span, read, (hidden, values))
        derived[name] = hidden
    rest = [c for c in names if c not in {source for source, _ in of.values()}]
    if rest:
        table = written()
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), k.alias("key")) for i, k in enumerate(keys(rest).values())]))
        values = dict(table.select(each.alias("e")).select("e.*").distinct().groupBy("col").count().collect())
        few = [c for i, c in enumerate(rest) if values.get(i, 0) <= FEW]
        for group in [*([c] for c in rest if c not in few), *([few] if few else [])]:
            table = written()
            out = _with_history(table, keys(group), group is few, *roles, gap, span, read)
    for chain in chains:
        rate = prior
        for c in chain:
            label = c or "all"
            count, hits = F.col(f"{label}_n"), F.col(f"{label}_s")
            above, below = hits * scale + rate * weight, count + weight
            out = out.withColumn(f"{label}_rate", F.when(count < 1, rate).otherwise(F.call_function("div", above, below)))
            rate = F.col(f"{label}_rate")
    found = [f"{c or 'all'}_{x}" for xs in (("n", "s"), ("rate",)) for c in names for x in xs]
    return out.select(*columns, *found), [*paths, *read]


def encode(facts: DataFrame, chains: list[list[str]], *, at: str, fold: str, n: str, s: str, prior: Column, gap: int = 0, weight: int = 50, scale: int = 1_000_000) -> DataFrame:
    """``facts`` with ``<column>_n``, ``<column>_s`` and ``<column>_rate`` for every column of the chains.

    A chain goes from coarse to fine: the rate of a column is the prior of the
    next one, ``prior`` that of the first.  The rate is its prior without history,
    else floor((scale * s + weight * prior) / (n + weight)) in whole numbers.
    An empty name stands for all history.  ``at`` (a whole number, like ``gap``)
    and ``fold`` must not be null; nulls of a column are one value.  Rows that
    repeat are rows.  Facts of no row give no row.  History of other folds counts
    from ``at`` + ``gap`` exclusive.
    """
    return _encoded(facts, chains, at=at, fold=fold, n=n, s=s, prior=prior, gap=gap, weight=weight, scale=scale)[0]




def encode_sales(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, *, folds: int = 5, gap_seconds: int = 0, flag: str = "returned") -> DataFrame:
    """Rates of lines with the given flag by item, vendor and client, each smoothed by kind, nation and segment.

    One row for each sale_id, item_id and vendor_id: n_lines, n_returned, and
    item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate.  Lines
    without a sale or sold_at are dropped; null item_id and client_id are -1; a
    null vendor_id is a value of its own and stays null.  Repeated lines and
    repeated sales count each time; where sales of one id differ in time or
    client, each has its own row, told apart by client_id and sold_at.  Ids that
    a dimension has twice have the least value there.  A fold is the CRC-32 of
    the sale's id modulo ``folds``.  Further columns are ignored, empty tables
    give an empty one.
    """
    lines = lines.select(lines["sale_id"].cast("long").alias("sale_id"), F.coalesce(lines["item_id"].cast("long"), F.lit(-1).cast("long")).alias("item_id"), lines["vendor_id"].cast("long").alias("vendor_id"), F.coalesce((lines["flag"] == flag).cast("long"), F.lit(0).cast("long")).alias("hit")).where("sale_id IS NOT NULL")
    sales = sales.select(sales["sale_id"].cast("long").alias("sale_id"), F.coalesce(sales["client_id"].cast("long"), F.lit(-1).cast("long")).alias("client_id"), sales["sold_at"].alias("sold_at")).where("sale_id IS NOT NULL AND sold_at IS NOT NULL")
    sums = [F.count("*").alias("n_lines"), F.sum("hit").alias("n_returned")]
    groups = lines.groupBy("sale_id", "item_id", "vendor_id").agg(*sums)
    per_sale = lines.groupBy("sale_id").agg(*sums)

    def dimension(df: DataFrame, key: str, value: str) -> DataFrame:
        least = df.select(df[key].cast("long").alias("key"), df[value].alias("least")).where(F.col("key").isNotNull()).groupBy("key").agg(F.min("least").alias("least"))
        return least.select("key", _key(least, "least").alias("value"))

    times = {c: F.col(c) * F.col("times") for c in ("n_lines", "n_returned")}
    fold = F.crc32(F.col("sale_id").cast("string")) % folds
    sold = sales.groupBy("sale_id", "client_id", "sold_at").agg(F.count("*").alias("times")).join(per_sale, "sale_id").withColumns(times)
    sold = sold.withColumns({"at": F.unix_micros(F.col("sold_at").cast("timestamp")), "fold": fold.cast("int")})
    same = {"at": "at", "fold": "fold", "n": "n_lines", "s": "n_returned", "gap": gap_seconds * 1_000_000}
    sold, read = _encoded(sold, [["", "segment", "client_id"]], prior=F.lit(500_000).cast("long"), of={"segment": ("client_id", dimension(clients, "client_id", "segment"))}, **same)
    sold = sold.select("sale_id", "client_id", "sold_at", "times", "at", "fold", "all_rate", F.col("client_id_n").alias("client_n"), F.col("client_id_rate").alias("client_rate"))
    facts = groups.join(sold, "sale_id").withColumns(times).drop("times")
    of = {"kind": ("item_id", dimension(items, "item_id", "kind")), "nation_id": ("vendor_id", dimension(vendors, "vendor_id", "nation_id"))}
    found, _ = _encoded(facts, [["kind", "item_id"], ["nation_id", "vendor_id"]], prior=F.col("all_rate"), of=of, spent=read, **same)
    return found.select("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", F.col("item_id_n").alias("item_n"), F.col("item_id_rate").alias("item_rate"), F.col("vendor_id_n").alias("vendor_n"), F.col("vendor_id_rate").alias("vendor_rate"), "client_n", "client_rate", "client_id", "sold_at")
