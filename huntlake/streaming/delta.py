"""Time since the previous row of the same flow on a stream (H3), with the last
timestamp of each flow kept as keyed state and evicted by an event-time timeout
(state TTL) once the watermark passes it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from huntlake.operators.flow import flow_key

OUT_SCHEMA = "flow_id string, row_key long, t double, time_delta double"
STATE_SCHEMA = "last_t double"


def stream_flow_delta(df: DataFrame, src_col: str, dst_col: str, time_col: str = "timestamp",
                      key_col: str = "log_id", ttl_seconds: int = 3600) -> DataFrame:
    """Per row: flow key, row key, epoch seconds and the delta to the flow's previous
    row (rows of a micro-batch are ordered by (time, key); across batches the state
    carries the last time). Needs a watermark on ``time_col``. A row without a time has
    no place in its flow: it takes no part here, and the ingest keeps it aside (W7)."""
    keyed = df.select(flow_key(src_col, dst_col).alias("flow_id"), F.col(key_col).cast("long").alias("row_key"),
                      (F.unix_micros(F.col(time_col)).cast("double") / 1e6).alias("t"), F.col(time_col)) \
        .where(F.col(time_col).isNotNull())

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["t", "row_key"], kind="stable")
        last = state.get[0] if state.exists else np.nan
        t = pdf["t"].to_numpy()
        prev = np.concatenate([[last], t[:-1]])
        out = pd.DataFrame({"flow_id": key[0], "row_key": pdf["row_key"].to_numpy(), "t": t, "time_delta": t - prev})
        state.update((float(t[-1]) if np.isnan(last) else float(max(last, t[-1])),))
        state.setTimeoutTimestamp(int(max(last if not np.isnan(last) else t[-1], t[-1]) * 1000) + ttl_seconds * 1000)
        yield out

    return keyed.groupBy("flow_id").applyInPandasWithState(
        step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
