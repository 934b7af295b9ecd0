"""Stateful streams of runs: status, silence and spend latches, each state held until the watermark passes it.

Rows older than the watermark are dropped by the engine before they reach a
state; ``late_rows`` tells how many a query has dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events that end a run, and the status they leave it in.
TERMINAL = {"purchase": "completed", "click": "failed"}


def status_of(event: str) -> Column:
    """The status that a run's last event leaves it in."""
    out = F.lit("running")
    for name, status in reversed(TERMINAL.items()):
        out = F.when(F.col(event) == name, status).otherwise(out)
    return out


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _seen(pdfs: Iterator[pd.DataFrame], state: GroupState) -> tuple[int, int, str, int, int]:
    """(time, seq, event) of the latest event of a run by time and seq, the highest seq, and the number of events, with what the state knew."""
    at, seq, event, top, n = state.get if state.exists else (-(1 << 62), -(1 << 62), "", -(1 << 62), 0)
    for rows in pdfs:
        last = rows.assign(_us=_micros(rows["ts"])).sort_values(["_us", "seq"]).iloc[-1]
        if (last["_us"], last["seq"]) >= (at, seq):
            at, seq, event = int(last["_us"]), int(last["seq"]), str(last["event"])
        top, n = max(top, int(rows["seq"].max())), n + len(rows)
    return at, seq, event, top, n


_RUN = "at long, seq long, event string, top long, n long"


def live_status(events: DataFrame, late: str, idle_seconds: int) -> DataFrame:
    """(run_id, seq, status) of events (run_id, seq, event, ts) in update mode: a row whenever events of a run arrive.

    The status is that of the latest event by time and seq, ``seq`` the highest
    number. A run's state is dropped when the watermark, ``late`` behind the
    newest event, is ``idle_seconds`` past its latest event.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = _seen(pdfs, state)
        state.update(seen)
        state.setTimeoutTimestamp(seen[0] // 1000 + 1000 * idle_seconds)
        yield pd.DataFrame({"run_id": [key[0]], "seq": [seen[3]], "status": [TERMINAL.get(seen[2], "running")]})

    return events.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(step, "run_id long, seq long, status string", _RUN, "update", GroupStateTimeout.EventTimeTimeout)


def interrupted(events: DataFrame, late: str, silence_seconds: int) -> DataFrame:
    """(run_id, silent_from, events) of runs that fell silent without an event that ends them, in append mode.

    A run is interrupted when the watermark is ``silence_seconds`` past its
    latest event; it is told once and its state goes. Runs that ended go without
    a row. An event older than the watermark is dropped and counted as late; one
    after the interruption opens the run anew.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, _, event, _, n = state.get
            state.remove()
            if event not in TERMINAL:
                yield pd.DataFrame({"run_id": [key[0]], "silent_from": [pd.Timestamp(at, unit="us")], "events": [n]})
            return
        seen = _seen(pdfs, state)
        state.update(seen)
        state.setTimeoutTimestamp(seen[0] // 1000 + 1000 * silence_seconds)

    return events.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(step, "run_id long, silent_from timestamp, events long", _RUN, "append", GroupStateTimeout.EventTimeTimeout)


def latched_spend(usage: DataFrame, limit: float, late: str) -> DataFrame:
    """(event_id, day, provider, running, stopped) of usage (event_id, ts, provider, cost): spend up to each row within a day, and whether a latch was shut before it.

    The latch of a day and provider shuts when the spend reaches ``limit`` and
    stays shut, whatever is refunded after. Rows of a batch count by time and
    id; null costs are 0. A day's state goes when the watermark passes its end.
    A task holds a batch's rows of one day and provider.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spend, shut = state.get if state.exists else (0.0, False)
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        running = spend + rows["cost"].fillna(0.0).cumsum()
        reached = shut | (running >= limit).cummax()
        before = reached.shift(1, fill_value=shut)
        state.update((float(running.iloc[-1]), bool(reached.iloc[-1])))
        day = pd.Timestamp(key[0])
        state.setTimeoutTimestamp(int(day.tz_localize("UTC").timestamp() if day.tzinfo is None else day.timestamp()) * 1000 + 86_400_000)
        yield pd.DataFrame({"event_id": rows["event_id"], "day": day, "provider": key[1], "running": running, "stopped": before})

    kept = usage.withWatermark("ts", late).withColumn("day", F.date_trunc("day", "ts")).groupBy("day", "provider")
    return kept.applyInPandasWithState(step, "event_id long, day timestamp, provider long, running double, stopped boolean", "spend double, shut boolean", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query has dropped as older than its watermark, over the progress it still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """How many states a query holds after its latest batch."""
    p = query.lastProgress
    return sum(s["numRowsTotal"] for s in p["stateOperators"]) if p else 0
