"""An extension: verdicts on the exact repeats of linear tasks while their events arrive.

A task's state holds, for each signature, its last call and that call's result, the steps
of writes and of unflagged tool calls, and the pairs found so far.  A pair is emitted when
it is found and again whenever what judges it has changed: the repeat's result has come,
or the task's last outcome is another one.  So the latest row of a pair is what a batch
over all events so far says.  Once the watermark is ``TIMEOUT`` past a task's last event
a timer emits its pairs once more as final and drops its state.

Events of a task come in order of steps; one that comes after a later step is left out,
and so are those behind the watermark and those without a time.
Needs ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.repeats import SIGNATURE
from ..operators.verdicts import classified
from ..schema import CALL_TYPES

#: Silence after which a task is taken to have ended, in milliseconds, and how late events may come.
TIMEOUT, DELAY = 3_600_000, "1 hour"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CALL = "event_type string, name string, content_hash string"
_PAIR = f"{_CALL}, original_step long, repeat_step long, original_result string, repeat_result string, write_step long, unknown_step long"
PAIRS = f"task_id string, {_PAIR}, terminal_outcome string, as_of_step long, final boolean"
_COLUMNS = [c.split()[0] for c in PAIRS.split(", ")]


class Judge(StatefulProcessor):
    """One task's pairs; the timer is the only thing that ends it."""

    def __init__(self, timeout: int = TIMEOUT):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", _CALL, "step long, result string")
        self.marks = handle.getListState("marks", "step long, writes boolean")
        self.pairs = handle.getListState("pairs", _PAIR)
        #: The last step, the signature of a call whose result may come next, and the outcome so far.
        self.head = handle.getValueState("head", f"step long, {_CALL}, outcome string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, *waiting, outcome = self.head.get() if self.head.exists() else (None, None, None, None, None)
        before, pairs, marks = outcome, [list(p) for p in self.pairs.get()], list(self.marks.get())
        n_marks, changed, met = len(marks), set(), {}
        events = pd.concat(list(rows)).sort_values("step_index", kind="stable")
        for e in events.astype(object).where(events.notna(), None).to_dict("records"):
            step, sign = int(e["step_index"]), tuple(e[c] for c in SIGNATURE)
            if last is not None and step <= last:
                continue
            last = step
            if not e["billing_only"]:
                outcome = e["outcome"]
            if e["event_type"] == "tool_result" and waiting[0] == "tool_call" and not e["opaque"]:
                self._known(tuple(waiting), e["content_hash"], met, pairs, changed)
            waiting = list(sign)
            if e["event_type"] not in CALL_TYPES:
                continue
            original = met[sign] if sign in met else self.calls.getValue(sign) if self.calls.containsKey(sign) else None
            if original is not None:
                between = lambda writes, at=original[0]: next((s for s, w in marks if w == writes and at < s), None)
                changed.add(len(pairs))
                pairs.append([*sign, int(original[0]), step, original[1], e["response_hash"] if e["event_type"] == "llm_call" else None, between(True), between(False)])
            met[sign] = (step, e["response_hash"] if e["event_type"] == "llm_call" else None)
            if e["write"]:
                marks.append((step, True))
            elif e["write"] is None and e["event_type"] == "tool_call":
                marks.append((step, False))
        for sign, held in met.items():
            self.calls.updateValue(sign, held)
        if len(marks) > n_marks:
            self.marks.appendList(marks[n_marks:])
        if changed:
            self.pairs.put([tuple(p) for p in pairs])
        self.head.update((last, *waiting, outcome))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(events["ms"].max()), timerValues.getCurrentWatermarkInMs()) + self.timeout)
        shown = range(len(pairs)) if outcome != before else sorted(changed)
        yield self._rows(key, [pairs[i] for i in shown], outcome, last, False)

    def _known(self, sign: tuple, result: str, met: dict, pairs: list[list], changed: set) -> None:
        """The result of the call just before has come."""
        step = met[sign][0] if sign in met else self.calls.getValue(sign)[0]
        met[sign] = (step, result)
        for i in range(len(pairs) - 1, -1, -1):
            if pairs[i][4] == step:
                pairs[i][6] = result
                changed.add(i)
                break

    def _rows(self, key, pairs: list, outcome: str | None, step: int | None, final: bool) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *p, outcome, step, final) for p in pairs], columns=_COLUMNS)
        return out.astype({c: "Int64" for c in ("original_step", "repeat_step", "write_step", "unknown_step", "as_of_step")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, *_, outcome = self.head.get()
        yield self._rows(key, list(self.pairs.get()), outcome, step, True)
        for state in (self.calls, self.marks, self.pairs, self.head):
            state.clear()

    def close(self) -> None:
        pass


def streaming_verdicts(events: DataFrame, timeout: int = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """Judged pairs of a stream of events of linear tasks; of several rows of a pair the one of the greatest as_of_step holds."""
    meta = lambda c: F.col(f"metadata.{c}")
    flat = events.where("ts is not null").withWatermark("ts", delay).select("task_id", "ts", F.unix_millis("ts").alias("ms"), *SIGNATURE, "step_index", "outcome", meta("write").alias("write"), meta("response_hash").alias("response_hash"), (F.coalesce(meta("content_basis"), F.lit("")) == "opaque").alias("opaque"), F.coalesce(meta("synthesized_cost_only"), F.lit(False)).alias("billing_only"))
    pairs = flat.groupBy("task_id").transformWithStateInPandas(Judge(timeout), PAIRS, "Append", "EventTime")
    return classified(pairs)
