"""Following a route: when to ask for a new one, and how far along the old one is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

QUIET_S, RETRY_S, OFF_M = 5.0, 30.0, 40.0


def decide(state: tuple[float | None, bool, bool], t: float, off_m: float | None, accuracy: float, answer: str | None) -> tuple[tuple[float | None, bool, bool], bool]:
    """One fix. state: when last asked, whether there is a route, whether the last answer was an error. answer: 'route' or 'error' if one has come since. Not within QUIET_S of the last; without a route always, after an error only RETRY_S later; with one where the fix lies further off than its accuracy, OFF_M at least."""
    asked, route, error = state
    if answer is not None:
        route, error = answer == "route" or route, answer == "error"
    since = float("inf") if asked is None else t - asked
    if since < QUIET_S:
        ask = False
    elif not route:
        ask = not error or since > RETRY_S
    else:
        ask = off_m is not None and off_m > max(accuracy, OFF_M)
    return (t if ask else asked, route, error), ask


def asks(fixes: DataFrame) -> DataFrame:
    """(track, t) at which a route is asked for, of fixes (track, t seconds, off_m, accuracy, answer). The batch twin of stream_asks; a track's fixes are folded in order of t."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        state, out = (None, False, False), []
        for r in g.sort_values("t").itertuples():
            state, ask = decide(state, r.t, None if pd.isna(r.off_m) else r.off_m, r.accuracy, None if pd.isna(r.answer) else r.answer)
            if ask:
                out.append(r.t)
        return pd.DataFrame({"track": [g["track"].iloc[0]] * len(out), "t": pd.Series(out, dtype=float)}).astype({"track": "int64"})

    return fixes.groupBy("track").applyInPandas(fold, "track bigint, t double")


def stream_asks(fixes: DataFrame) -> DataFrame:
    """Streaming: as asks; three values of state a track."""

    def step(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        asked, route, error = held.get if held.exists else (None, False, False)
        state, out = (asked, route, error), []
        for b in batches:
            for r in b.sort_values("t").itertuples():
                state, ask = decide(state, r.t, None if pd.isna(r.off_m) else r.off_m, r.accuracy, None if pd.isna(r.answer) else r.answer)
                if ask:
                    out.append((key[0], r.t))
        held.update(state)
        yield pd.DataFrame(out, columns=["track", "t"]).astype({"track": "int64", "t": float})

    return fixes.groupBy("track").applyInPandasWithState(step, "track bigint, t double", "asked double, route boolean, error boolean", "append", "NoTimeout")
