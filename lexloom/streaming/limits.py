"""Request limits over a stream (GOV-01..03)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.limits import PER_DAY, PER_MINUTE


def counts_per_minute(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """GOV-01: tumbling minutes by key; a minute is final once the watermark has passed it."""
    return requests.withWatermark("ts", late).groupBy("key", F.window("ts", "1 minute")).agg(F.count("*").alias("n")).select("key", F.col("window.start").alias("minute"), "n")


def decisions(requests: DataFrame, minute_limit: int = PER_MINUTE, day_limit: int = PER_DAY, late: str = "10 minutes") -> DataFrame:
    """GOV-03: each request of (id, key, ts) as it comes, decided against counters kept by key.

    The state is the accepted requests of each minute and day of a key that the
    watermark has not passed, so that a late request is held to its own minute;
    it goes with the key's last day. Requests of one trigger are taken in order
    of time; across triggers, in order of arrival.
    """
    zone = requests.sparkSession.conf.get("spark.sql.session.timeZone")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = max(state.getCurrentWatermarkMs(), 0)
        now = pd.Timestamp(passed, unit="ms", tz="UTC").tz_convert(zone)
        minutes, days = json.loads(state.get[0]) if state.exists else ({}, {})
        rows = pd.concat(frames).sort_values(["ts", "id"])
        out = []
        for ts in rows["ts"]:
            minute, day = ts.strftime("%Y-%m-%dT%H:%M"), ts.strftime("%Y-%m-%d")
            if minutes.get(minute, 0) >= minute_limit:
                out.append("rate_limited")
            elif days.get(day, 0) >= day_limit:
                out.append("quota_exceeded")
            else:
                out.append("accepted")
                minutes[minute] = minutes.get(minute, 0) + 1
                days[day] = days.get(day, 0) + 1
        minutes = {k: n for k, n in minutes.items() if k >= now.strftime("%Y-%m-%dT%H:%M")}
        days = {k: n for k, n in days.items() if k >= now.strftime("%Y-%m-%d")}
        state.update((json.dumps([minutes, days]),))
        last = max([*days, rows["ts"].iloc[-1].strftime("%Y-%m-%d")])
        end = pd.Timestamp(last).tz_localize(zone) + pd.DateOffset(days=1)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), passed + 1))
        yield pd.DataFrame({"id": rows["id"], "key": key[0], "decision": out})

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "id long, key long, decision string", "counts string", "append", GroupStateTimeout.EventTimeTimeout)
