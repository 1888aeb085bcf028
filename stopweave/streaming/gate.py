"""The freshness gate as a stream: the rows of ``operators.status.freshness_gate`` from asks that arrive out of order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stopweave.operators.status import FRESH_MS

_STATE = "taken long, snapshot long, at binary, id binary"
#: Rows of the result that are held at a time.
ROWS = 100_000
#: Stands for an id that is null.
NONE = -(1 << 63)


def stream_gate(asks: DataFrame, key: str, max_age_ms: int = FRESH_MS, ts: str = "ts", id_col: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """A stream of (key, event_id, kind, snapshot_id, at_ms), as in the batch form, for asks no later than ``late``.

    The state of a key is its snapshot, as the id and time of the ask that ran the check, and the asks that the watermark
    has not passed, 16 bytes each, in the state as in the task. An ask is answered once nothing earlier can arrive. A snapshot falls due by a timer, without an ask;
    then its key is forgotten until somebody asks again. Asks behind the watermark are dropped by Spark, those without a
    time are left out.
    """
    when = F.col(ts).cast("timestamp")
    known = asks.select(F.col(key).alias("key"), when.alias("seen"), F.unix_millis(when).alias("at"), F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("id"))
    known = known.where("seen is not null").withWatermark("seen", late)

    def answer(group, frames, state: GroupState):
        taken, snapshot, *held = state.get if state.exists else (None, None, b"", b"")
        parts = [[np.frombuffer(x, np.int64)] for x in held]
        for frame in frames:
            for part, c in zip(parts, ("at", "id"), strict=True):
                part.append(frame[c].to_numpy(np.int64))
        at, number = map(np.concatenate, parts)
        order = np.lexsort((number, at))
        at, number = at[order], number[order]
        edge = state.getCurrentWatermarkMs()
        ready, here, told = int(np.searchsorted(at, edge)), 0, []
        while here < ready:
            if taken is None or at[here] - taken >= max_age_ms:
                if taken is not None:
                    told.append(([NONE], "due", snapshot, [taken + max_age_ms]))
                taken, snapshot = int(at[here]), int(number[here])
                told.append((number[here : here + 1], "check", snapshot, at[here : here + 1]))
                here += 1
            until = min(ready, int(np.searchsorted(at, taken + max_age_ms)))
            while here < until:  # what one snapshot serves may be long
                upto = min(here + ROWS, until)
                told.append((number[here:upto], "served", snapshot, at[here:upto]))
                here = upto
                if sum(len(x) for x, *_ in told) >= ROWS:
                    yield frame_of(group, told)
                    told = []
        at, number = at[ready:], number[ready:]
        if taken is not None and taken + max_age_ms <= edge:
            told.append(([NONE], "due", snapshot, [taken + max_age_ms]))
            taken, snapshot = None, None
        if told:
            yield frame_of(group, told)
        if len(at) or taken is not None:
            state.update((taken, snapshot, at.tobytes(), number.tobytes()))
            next_time = min([int(x) for x in at[:1]] + ([] if taken is None else [taken + max_age_ms]))
            state.setTimeoutTimestamp(max(edge, next_time) + 1)
        elif state.exists:
            state.remove()

    def frame_of(group, told) -> pd.DataFrame:
        sizes = [len(numbers) for numbers, *_ in told]
        each = lambda values: np.repeat(np.array(values), sizes)
        known = lambda ids: pd.array(ids, "Int64") if (ids != NONE).all() else pd.arrays.IntegerArray(ids, ids == NONE)
        numbers, ats = (np.concatenate([x[k] for x in told]).astype(np.int64) for k in (0, 3))
        columns = {id_col: known(numbers), "kind": each([x[1] for x in told]), "snapshot_id": known(each([x[2] for x in told])), "at_ms": ats}
        frame = pd.DataFrame(columns).astype({"at_ms": "Int64"})
        frame.insert(0, key, [group[0]] * len(frame))
        return frame

    out = StructType([StructField(key, known.schema["key"].dataType), StructField(id_col, LongType()), StructField("kind", StringType()), StructField("snapshot_id", LongType()), StructField("at_ms", LongType())])
    return known.groupBy("key").applyInPandasWithState(answer, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
