"""Discovery sessions as a stateful stream: picks in, pairs out, state per session with a time-out.

The library that a session draws from is a bounded sample of vectors, sent to the tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.discover import AtHand, Session, next_pair, pick
from quern.operators.rank import unit_rows

TTL_MS = 1_800_000
OUT = "session string, round long, left_id long, right_id long, source string"


def discover(picks: DataFrame, ids: np.ndarray, vectors: np.ndarray, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(session, round, left_id, right_id, source) for a stream of (session, picked_id).

    A session's first row starts it, whatever it picks; a pick that is not of the shown
    pair gives nothing; a session without picks for ``ttl_ms`` is forgotten (never, if that is None).
    """
    shared = picks.sparkSession.sparkContext.broadcast((np.asarray(ids), unit_rows(np.asarray(vectors, float))))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        library = AtHand(*shared.value)
        session, out = pickle.loads(state.get[0]) if state.exists else None, []
        for frame in frames:
            for chosen in frame["picked_id"]:
                if session is None:
                    session = Session(key[0])
                    shown = next_pair(session, library)
                else:
                    shown = pick(session, int(chosen), library) if chosen is not None and chosen == chosen else None
                if shown:
                    pair, source = shown
                    out.append((key[0], session.round, pair[0], pair[1] if len(pair) > 1 else None, source))
        if session is not None:
            state.update((pickle.dumps(session),))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["session", "round", "left_id", "right_id", "source"])

    return picks.groupBy("session").applyInPandasWithState(step, OUT, "state binary", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
