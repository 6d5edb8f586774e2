"""Running sums and decaying states of a stream of events (ts, node_id, rain)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_sum(events: DataFrame, hours: int = 6, late: str = "2 hours") -> DataFrame:
    """Sum over windows of some hours that start each hour; rows later than the watermark allows are left out."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", "1 hour").alias("w"), "node_id").agg(F.sum("rain").alias("cum"))
    return own.select("node_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cum")


def decaying_state(events: DataFrame, half_life: float = 4.0) -> DataFrame:
    """node_id, ts and state after each event: the larger of its trigger and the state before, decayed by the hours between.

    The state of a node is two numbers. An event older than the state's time is decayed to that time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, trigger in zip(rows["ts"], rows["rain"]):
            hour = ts.timestamp() / 3600
            if at is None or hour >= at:
                level = max(trigger, level * 0.5 ** ((hour - at) / half_life) if at is not None else 0.0)
                at = hour
            else:
                level = max(level, trigger * 0.5 ** ((at - hour) / half_life))
            out.append((key[0], ts, level))
        state.update((level, at))
        yield pd.DataFrame(out, columns=["node_id", "ts", "state"])

    return events.groupBy("node_id").applyInPandasWithState(
        step, "node_id long, ts timestamp, state double", "level double, at double", "append", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Work off what is there and stop; the result is an in-memory table (for tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
