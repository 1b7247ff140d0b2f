"""Streams over events and ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skylode.operators.ledger import GENESIS


def windowed_metrics(events: DataFrame, lateness: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows (start, event_type, n, total, least, most) of event-time windows; later events than ``lateness`` are left out. Works on streams and tables alike."""
    by = events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "event_type", "n", "total", "least", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Rows (user_id, start, end, n): runs of a user's events without a longer gap."""
    by = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def verify_live(events: DataFrame) -> DataFrame:
    """Rows (ledger, sequence, problem) for each appended event (ledger, sequence, previous, payload, sha) that breaks its ledger's chain.

    The state of a ledger is sequence and digest of its last good event, so what is chained to a bad event is bad too. Events of one batch are taken in order of sequence.
    """
    import hashlib
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sha = state.get if state.exists else (0, GENESIS)
        out = []
        for _, e in pd.concat(list(batches)).sort_values("sequence").iterrows():
            text = json.dumps({"payload": e["payload"], "previous_event_sha256": e["previous"], "sequence": int(e["sequence"])}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            if e["sequence"] != last + 1:
                out.append((key[0], e["sequence"], "sequence"))
            elif e["previous"] != sha:
                out.append((key[0], e["sequence"], "previous"))
            elif hashlib.sha256(text.encode()).hexdigest() != e["sha"]:
                out.append((key[0], e["sequence"], "digest"))
            else:
                last, sha = int(e["sequence"]), e["sha"]
        state.update((last, sha))
        yield pd.DataFrame(out, columns=["ledger", "sequence", "problem"])

    return events.groupBy("ledger").applyInPandasWithState(step, "ledger string, sequence long, problem string", "last long, sha string", "append", GroupStateTimeout.NoTimeout)
