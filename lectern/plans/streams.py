"""Queries that run a stream over what has arrived."""

from __future__ import annotations

from lectern.streaming import lifecycle as S

from .records import STATE
from .registry import query


@query("T01_stream_lifecycle", f"WITH {STATE} SELECT request_id, state, seq FROM st", ("requests",))
def t01s(spark, sf):
    return S.run_available(spark, S.live_states(S.event_stream(spark, sf, "events.parquet")), "complete").select("request_id", "state", "seq")
