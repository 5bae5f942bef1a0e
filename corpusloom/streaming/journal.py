"""A journal as state by id: the last entry wins, errors are counted, what never ends becomes an error."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENTRY = "id string, status string, detail string, at timestamp"
#: The entries of a group of ids, an element of each array for each id.
STATE = "ids array<string>, status array<string>, detail array<string>, at array<long>, tries array<long>, version array<long>"
OUT = "id string, status string, detail string, tries long, version long"

STARTED, TIMED_OUT = "started", "timed out"
#: Groups of ids that have their state together: a call of Python costs some milliseconds, however little it has to do.
GROUPS = 4096


def states(entries: DataFrame, *, patience: str = "1 hour", late: str = "1 day", error: str = "error", groups: int = GROUPS) -> DataFrame:
    """(id, status, detail, tries, version) of every id that a batch of a stream changes.

    Of the entries (id, status, detail, at) of an id the one with the latest time
    wins, on ties the one with the greatest status and detail.  ``tries`` counts
    entries with the status ``error``.  An id whose last entry is ``started``
    becomes an error once the watermark (``late`` behind the latest entry) is
    ``patience`` past it; an entry after that wins again.  ``version`` ascends
    for each id.  Null details are empty; entries without id, status or time are
    left out.  Ids share their state with those of the same hash, ``groups`` in
    all; a checkpoint can only be taken up with the number that it began with.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, *columns = [list(c) for c in state.get] if state.exists else [[] for _ in range(6)]
        status, detail, at, tries, version = columns
        place = dict(zip(ids, count()))
        changed = set()
        latest, errors = {}, {}
        for batch in batches:
            for i, *entry in zip(batch["id"].tolist(), batch["at"].astype("datetime64[us]").astype("int64").tolist(), batch["status"].tolist(), batch["detail"].tolist(), strict=True):
                if i not in latest or entry > latest[i]:
                    latest[i] = entry
                if entry[1] == error:
                    errors[i] = errors.get(i, 0) + 1
        # entries for others of the group do not put off an id's time-out
        now = state.getCurrentWatermarkMs()
        for k, i in enumerate(ids):
            if status[k] == STARTED and at[k] // 1000 + wait < now and i not in latest:
                status[k], detail[k], tries[k] = error, TIMED_OUT, tries[k] + 1
                changed.add(k)
        for i, last in latest.items():
            k = place.setdefault(i, len(ids))
            if k == len(ids):
                for column, value in zip((ids, *columns), (i, "", "", -(2**62), 0, 0), strict=True):
                    column.append(value)
            tries[k] += errors.get(i, 0)
            # a time-out has the time of the entry that it follows, and any entry from then on wins
            ended = (status[k], detail[k]) == (error, TIMED_OUT)
            if last[0] >= at[k] if ended else last > [at[k], status[k], detail[k]]:
                at[k], status[k], detail[k] = last
            changed.add(k)
        for k in changed:
            version[k] += 1
        state.update((ids, status, detail, at, tries, version))
        open_ = [a for a, s in zip(at, status, strict=True) if s == STARTED]
        if open_:
            # behind the watermark the time-out is due at once
            state.setTimeoutTimestamp(max(min(open_) // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        rows = sorted(changed)
        yield pd.DataFrame({"id": [ids[k] for k in rows], "status": [status[k] for k in rows], "detail": [detail[k] for k in rows], "tries": [tries[k] for k in rows], "version": [version[k] for k in rows]})

    whole = entries.where("id IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL").withColumn("detail", F.coalesce("detail", F.lit("")))
    dealt = whole.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    return dealt.withWatermark("at", late).groupBy("group").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, *, files_per_batch: int = 1000, **options) -> None:
    """Takes up what is new in ``source`` (JSON lines), then stops; each batch is one folder, rewritten whole if it is run again."""
    entries = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    states(entries, **options).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """(id, status, detail, tries) as of the last batch."""
    last = F.max_by(F.struct("status", "detail", "tries"), "version").alias("e")
    return spark.read.schema(OUT).parquet(f"{sink}/batch=*").groupBy("id").agg(last).select("id", "e.*")
