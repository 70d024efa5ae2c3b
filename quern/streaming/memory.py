"""Conversation memory and monitoring windows, as batch and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def with_history(turns: DataFrame, sep: str = "\n") -> DataFrame:
    """Each turn with the turns before it in its conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.concat_ws(": ", "role", "text")
    return turns.withColumn("history", F.array_join(F.collect_list(said).over(before), sep))


def history_stream(turns: DataFrame, sep: str = "\n") -> DataFrame:
    """with_history() of a stream of (conv_id, turn, role, text): (conv_id, turn, history), in append mode.

    The state of a conversation is its history so far, so a turn is answered by those that came before
    it: in order of turn within a trigger. A turn that comes late, after a later one, sees that one too.
    """
    kind = dict(turns.dtypes)

    def run(key, parts, state):
        history = state.get[0] if state.exists else ""
        rows = pd.concat(list(parts)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
            out.append((key[0], turn, history))
            said = ": ".join(x for x in (role, text) if x is not None)
            history = f"{history}{sep}{said}" if history or state.exists or len(out) > 1 else said
        state.update((history,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, history string"
    return turns.groupBy("conv_id").applyInPandasWithState(run, schema, "history string", "append", GroupStateTimeout.NoTimeout)


def monitored(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type; `events` may be a stream, whose late rows a watermark bounds."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        own = own.withWatermark("ts", late)
    out = own.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
