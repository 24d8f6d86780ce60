"""Event ingest as streams: idempotent inbox with conflicts, and projections by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def inbox_stream(events: DataFrame, key: str, digest: str, seq: str) -> DataFrame:
    """key, seq, outcome of each event: accepted (first of its key), repeated (same digest), conflict (another digest).

    The state is one digest per key, kept for good, as a source may repeat a message at any time; order inside a
    micro-batch is by ``seq``.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(seq)
        out = []
        for s, d in zip(rows[seq], rows[digest], strict=True):
            outcome = "accepted" if known is None else "repeated" if d == known else "conflict"
            known = d if known is None else known
            out.append((name[0], s, outcome))
        state.update((known,))
        yield pd.DataFrame(out, columns=[key, seq, "outcome"])

    return events.select(key, digest, seq).groupBy(key).applyInPandasWithState(run, f"`{key}` {types[key]}, `{seq}` {types[seq]}, outcome string", "digest string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, label: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and label; events later than ``late`` behind the watermark are left out. The watermark is this library's own choice."""
    from pyspark.sql import functions as F

    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), label, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; exactly once by checkpoint and file sink."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
