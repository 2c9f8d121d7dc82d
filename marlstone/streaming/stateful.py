"""Keyed state machines, each as a plain fold, a batch operator and a streaming operator.

The fold over one key's ordered events holds the rules.  The batch form sorts
the events by key and time and folds them in one pass over each partition, the
streaming form uses ``applyInPandasWithState``; both give the same rows for the
same order of events.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fold = Callable[[tuple, float, dict], tuple[tuple, dict]]


def suppress(state: tuple, at: float, row: dict, window: float = 6 * 3600.0) -> tuple[tuple, dict]:
    """Alerts of one fingerprint: sent when the last was sent ``window`` seconds ago or more, else suppressed."""
    last, sent, held = state
    if last is None or at - last >= window:
        return (at, sent + 1, 0), {"action": "send", "count": sent + 1}
    return (last, sent, held + 1), {"action": "suppress", "count": held + 1}


def breaker(state: tuple, at: float, row: dict, failures: int = 5, wait: float = 60.0, successes: int = 2) -> tuple[tuple, dict]:
    """A circuit breaker: opens after ``failures`` in a row, lets a try through after ``wait`` seconds, closes after ``successes`` of them."""
    mode, n, since = state
    ok = bool(row["ok"])
    if mode == "open":
        if at - since < wait:
            return state, {"action": "reject", "count": n}
        mode, n = "half_open", 0
    if mode == "half_open":
        if not ok:
            return ("open", 0, at), {"action": "open", "count": 0}
        return (("closed", 0, at), {"action": "close", "count": 0}) if n + 1 >= successes else (("half_open", n + 1, since), {"action": "probe", "count": n + 1})
    n = 0 if ok else n + 1
    return (("open", 0, at), {"action": "open", "count": n}) if n >= failures else (("closed", n, since), {"action": "pass", "count": n})


def bucket(state: tuple, at: float, row: dict, capacity: float = 10.0, rate: float = 1.0) -> tuple[tuple, dict]:
    """A token bucket of ``capacity`` filled at ``rate`` a second."""
    tokens, last = state
    tokens = min(capacity, tokens + (at - last) * rate) if last is not None else capacity
    if tokens >= 1:
        return (tokens - 1, at), {"action": "pass", "count": int(tokens - 1)}
    return (tokens, at), {"action": "limit", "count": 0}


def batching(state: tuple, at: float, row: dict, gap: float = 300.0, most: int = 20, quiet: tuple[int, int] = (22, 7), hours_from_utc: float = 0.0) -> tuple[tuple, dict]:
    """Notifications: held in quiet hours of the local clock and until ``gap`` seconds after the last batch, then sent together, at most ``most``."""
    last, queued = state
    queued += 1
    hour = int((at + 3600 * hours_from_utc) // 3600) % 24
    still = hour >= quiet[0] or hour < quiet[1] if quiet[0] > quiet[1] else quiet[0] <= hour < quiet[1]
    if still or last is not None and at - last < gap:
        return (last, queued), {"action": "hold", "count": queued}
    n = min(queued, most)
    return (at, queued - n), {"action": "send", "count": n}


FOLDS: dict[str, tuple[Fold, tuple, str]] = {
    "suppress": (suppress, (None, 0, 0), "last double, sent long, held long"),
    "breaker": (breaker, ("closed", 0, 0.0), "mode string, n long, since double"),
    "bucket": (bucket, (0.0, None), "tokens double, last double"),
    "batching": (batching, (None, 0), "last double, queued long"),
}


def _rows(fold: Fold, state: tuple, pdf: pd.DataFrame, at: str, order: list[str]) -> tuple[tuple, pd.DataFrame]:
    pdf = pdf.sort_values([at, *order])
    out = []
    for row in pdf.to_dict("records"):
        state, said = fold(state, row[at], row)
        out.append((said["action"], int(said["count"])))
    return state, pdf.assign(action=[a for a, _ in out], count=[c for _, c in out])


def batch(df: DataFrame, name: str, key: str | list[str], at: str, order: list[str], **params) -> DataFrame:
    """``df`` with ``action`` and ``count`` of each event; ``at`` is seconds as a double.

    Events are sorted by key and time, and one pass folds them, starting anew
    where the key changes: a task holds a batch of rows and one key's state,
    however many keys or events there are.  A null key is a key of its own.
    Missing times and missing values of ``order`` come last, as in pandas, and a
    fold sees a missing time as no number.
    """
    fold, start, _ = FOLDS[name]
    keys = [key] if isinstance(key, str) else key
    names = df.columns
    needs = [c for c in ("ok",) if c in names]

    def run(batches):
        now, state = None, start
        for b in batches:
            of = {c: b.column(names.index(c)).to_pylist() for c in {*keys, at, *needs}}
            of[at] = [math.nan if x is None else x for x in of[at]]
            actions, counts = [], []
            for i, k in enumerate(zip(*[of[c] for c in keys], strict=True)):
                if k != now:
                    now, state = k, start
                state, said = fold(state, of[at][i], {c: of[c][i] for c in needs}, **params)
                actions.append(said["action"])
                counts.append(int(said["count"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(actions, pa.string()), pa.array(counts, pa.int64())], [*names, "action", "count"])

    schema = df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return df.repartition(*keys).sortWithinPartitions(*keys, *map(F.asc_nulls_last, (at, *order))).mapInArrow(run, f"{schema}, action string, count long")


def stream(df: DataFrame, name: str, key: str, at: str, order: list[str], timeout_ms: int | None = None, **params) -> DataFrame:
    """The streaming form: state by key, kept for good, or forgotten after ``timeout_ms`` without events.

    A timeout needs a trigger that goes on; with ``availableNow`` leave it unset.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fold, start, state_schema = FOLDS[name]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else start
        whole = pd.concat(list(pdfs))
        now, out = _rows(lambda s, t, r: fold(s, t, r, **params), tuple(now), whole, at, order)
        state.update(now)
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield out

    schema = df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return df.groupBy(key).applyInPandasWithState(run, f"{schema}, action string, count long", state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout)
