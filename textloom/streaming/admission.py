"""Admission of requests under sliding budgets, exact: only admitted requests count."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of the window, requests per account and owner, at the same time, lease.
WINDOW, PER_ACCOUNT, PER_OWNER, ACTIVE, OWN_ACTIVE, LEASE = 60.0, 30, 10, 4, 2, 91.0

#: Rows that are decided, and given, at once.
ROWS_EACH = 50_000

SCHEMA = "account string, request_id long, admitted boolean"
STATE = "owners array<string>, started array<double>, expires array<double>"


def decide(held: list[tuple[str, float, float]], owner: str, now: float) -> tuple[bool, list[tuple[str, float, float]]]:
    """Whether a request is admitted at ``now``, and the leases that still matter."""
    held = [x for x in held if x[1] > now - WINDOW or x[2] > now]
    active = [x for x in held if x[2] > now]
    mine = sum(x[0] == owner for x in held)
    own = sum(x[0] == owner for x in active)
    good = len(held) < PER_ACCOUNT and mine < PER_OWNER and len(active) < ACTIVE and own < OWN_ACTIVE
    return good, [*held, (owner, now, now + LEASE)] if good else held


def _batch(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = list(zip(*state.get, strict=True)) if state.exists else []
    # owners as codes: a batch is held as numbers, thirty bytes a row
    codes: dict[str, int] = {}
    numbered = []
    for f in frames:
        own = f["owner"].map(lambda o: codes.setdefault(o, len(codes))).to_numpy(np.int32)
        numbered.append((f["seconds"].to_numpy(), f["request_id"].to_numpy(), own, f["took"].to_numpy(np.float64)))
    seconds, requests, owners, took = map(np.concatenate, zip(*numbered, strict=True))
    numbered.clear()
    names, order = list(codes), np.lexsort((requests, seconds))
    for begin in range(0, len(order), ROWS_EACH):
        part = order[begin : begin + ROWS_EACH]
        out = []
        for owner, now, length in zip(owners[part].tolist(), seconds[part].tolist(), took[part].tolist(), strict=True):
            good, held = decide(held, names[owner], now)
            if good and not math.isnan(length):  # released when the call ends
                held[-1] = (names[owner], now, now + min(length, LEASE))
            out.append(good)
        if begin + ROWS_EACH >= len(order):
            state.update(tuple(map(list, zip(*held, strict=True))) if held else ([], [], []))
        yield pd.DataFrame({"account": key[0], "request_id": requests[part], "admitted": out})


def admitted(requests: DataFrame) -> DataFrame:
    """account, request_id, admitted of a stream of (ts, account, owner, request_id, took) (STM3, AGG11).

    State is kept by account: at most as many leases as one window admits. ``took`` is the length of
    the call in seconds, null if unknown.
    """
    rows = requests.select("account", "owner", "request_id", (F.unix_micros("ts") / 1e6).alias("seconds"), F.col("took").cast("double").alias("took"))
    return rows.groupBy("account").applyInPandasWithState(_batch, SCHEMA, STATE, "append", "NoTimeout")
