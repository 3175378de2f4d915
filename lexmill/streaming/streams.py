"""Streams: windowed counts, latest progress, login throttling and the learned model.

Each stream ends under ``availableNow``; state is keyed, and bounded by a watermark or by the key's own cap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.operators.learned import MODEL


def windowed(events: DataFrame, when: str = "ts", size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows; events later than ``late`` are left out."""
    t = events.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return t.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str = "user_id", when: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    t = events.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(key, F.session_window("_t", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_progress(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest state of each document. Batch ``n`` is written to its own folder before
    the pointer moves on, so a batch that runs again writes the same rows again."""

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.select("document_id", "status", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))).alias("progress"), "updated_at")
        # only the first batch has none before it; a folder that is missing later is lost state, and an error
        old = spark.read.parquet(f"{path}/batch={n - 1}") if n else new.limit(0)
        both = old.unionByName(new)
        last = both.groupBy("document_id").agg(F.max_by(F.struct("status", "progress", "updated_at"), F.struct("updated_at", "progress")).alias("s")).select("document_id", "s.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return sink


def throttled(events: DataFrame, limit: int = 5, window_s: int = 7200, late: str = "1 hour") -> DataFrame:
    """(user_id, locked_at) of every lockout: ``limit`` failures within the window, cleared by a success. Events are
    ``(user_id, at, failed)`` with ``at`` in seconds; a user's state is the times of the failures that still count, at most
    ``limit``, and ends when the watermark passes the window. (Processing time would keep an ``availableNow`` run alive.)"""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "failed"])
        for at, failed in zip(rows["at"], rows["failed"], strict=True):
            kept = [x for x in kept if x > at - window_s]
            if not failed:
                kept = []
                continue
            kept = [*kept, int(at)][-limit:]
            if len(kept) == limit:
                out.append((key[0], int(at)))
                kept = []
        state.update((kept,))
        state.setTimeoutTimestamp(max((int(rows["at"].max()) + window_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "locked_at"])

    timed = events.withColumn("_t", F.timestamp_seconds("at")).withWatermark("_t", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, locked_at long", "failures array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def fold_example(weights: dict[str, float], terms: list[tuple[str, float]], cap: int = MODEL) -> dict[str, float]:
    """The model after one more example, cut to its heaviest terms; of equals those that came first."""
    for t, w in terms:
        weights[t] = round(weights.get(t, 0.0) + w, 4)
    return dict(sorted(weights.items(), key=lambda x: -x[1])[:cap])


def learn(examples: DataFrame, cap: int = MODEL) -> DataFrame:
    """(model, examples_seen, term, weight) after each batch, by the exact rule: the model is cut after every example.
    Examples are ``(model, id, terms)``, ordered by id within a batch; the state of a model is at most ``cap`` terms."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, names, values = state.get if state.exists else (0, [], [])
        weights = dict(zip(names, values, strict=True))
        rows = pd.concat(list(batches)).drop_duplicates("id").sort_values("id")
        for terms in rows["terms"]:
            weights = fold_example(weights, [(t["term"], float(t["weight"])) for t in terms], cap)
            seen += 1
        state.update((int(seen), list(weights), list(weights.values())))
        yield pd.DataFrame([(key[0], int(seen), t, w) for t, w in weights.items()], columns=["model", "examples_seen", "term", "weight"])

    return examples.groupBy("model").applyInPandasWithState(step, "model string, examples_seen long, term string, weight double", "seen long, names array<string>, weights array<double>", "update", GroupStateTimeout.NoTimeout)
