"""An extension: exact repeats of linear tasks while their events arrive.

Events of a task come in order of steps.  Each pair is emitted once, without a
verdict: that needs the task's last outcome, which a stream doesn't know yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.repeats import SIGNATURE
from ..schema import is_call

PAIRS = "task_id string, event_type string, name string, content_hash string, original_step long, repeat_step long"
#: Silence after which a call's state is dropped, in milliseconds.
TIMEOUT = 3_600_000


def _pairs(call: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, out = state.get[0] if state.exists else None, []
    for step in sorted(s for frame in frames for s in frame["step_index"].tolist()):
        if last is not None and last < step:
            out.append((*call, last, step))
        last = step
    state.update((last,))
    state.setTimeoutDuration(TIMEOUT)
    yield pd.DataFrame(out, columns=["task_id", *SIGNATURE, "original_step", "repeat_step"])


def streaming_repeats(events: DataFrame) -> DataFrame:
    """Pairs of a stream of events; the state is one step for each call of a task, and no group holds more."""
    calls = events.where(is_call()).select("task_id", *SIGNATURE, "step_index")
    found = calls.groupBy("task_id", *SIGNATURE).applyInPandasWithState(_pairs, PAIRS, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select("task_id", "original_step", "repeat_step", *SIGNATURE)
