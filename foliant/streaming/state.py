"""Keyed state.

The batch forms fold each key's events in order and say what the streaming form would
emit; the streaming forms keep one small state for each key and drop it after its time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Idle time of a session, turns it keeps, tokens a second and at most.
IDLE_SECONDS, MAX_TURNS, RATE, BURST = 3600, 50, 10.0, 20.0


def micros(at: str) -> Column:
    """A time, with or without zone, as microseconds."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def sessions(events: DataFrame, key: str, at: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """Events with the number of their session: a new one begins after an idle time."""
    w = Window.partitionBy(key).orderBy(at)
    gap = micros(at) - F.lag(micros(at)).over(w)
    new = F.when(gap.isNull() | (gap > idle * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def session_totals(stream: DataFrame, key: str, at: str, value: str, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same as event-time session windows, for streams and tables."""
    held = stream.withWatermark(at, late) if stream.isStreaming else stream
    return held.groupBy(key, F.session_window(at, idle).alias("w")).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "events", "total")


def windowed(stream: DataFrame, at: str, by: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding windows; late events are dropped after the watermark."""
    held = stream.withWatermark(at, late) if stream.isStreaming else stream
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return held.groupBy(w.alias("w"), by).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("begins"), by, "events", "total")


def token_bucket(events: DataFrame, key: str, at: str, order: list[str], rate: float = RATE, burst: float = BURST) -> DataFrame:
    """(key, allowed, denied): which of a key's events a token bucket lets through, folded in order.

    The fold's state is two numbers, and a key's events are one array of small structs.
    """
    ordered = F.sort_array(F.collect_list(F.struct(micros(at).alias("t"), *[F.col(o) for o in order])))
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("denied"))

    def step(s: Column, e: Column) -> Column:
        filled = F.least(F.lit(burst), s["tokens"] + F.coalesce((e["t"] - s["last"]) / 1e6, F.lit(0.0)) * rate)
        ok = filled >= 1
        return F.struct(F.when(ok, filled - 1).otherwise(filled).alias("tokens"), e["t"].alias("last"), (s["allowed"] + ok.cast("long")).alias("allowed"), (s["denied"] + (~ok).cast("long")).alias("denied"))

    return events.groupBy(key).agg(F.aggregate(ordered, start, step).alias("s")).select(key, "s.allowed", "s.denied")


def token_bucket_stream(stream: DataFrame, key: str, at: str, rate: float = RATE, burst: float = BURST, idle_ms: int = IDLE_SECONDS * 1000) -> DataFrame:
    """The same over a stream: state (tokens, last) for each key, gone after an idle time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        allowed = denied = 0
        for t in sorted(x for f in frames for x in f[at].astype("int64").tolist()):
            tokens = min(burst, tokens + (0.0 if last is None else max(0, t - last) / 1e6 * rate))
            last = t if last is None else max(last, t)
            if tokens >= 1:
                tokens, allowed = tokens - 1, allowed + 1
            else:
                denied += 1
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [name[0]], "allowed": [allowed], "denied": [denied]})

    kind = dict(stream.dtypes)[key]
    held = stream.select(key, micros(at).alias(at))
    return held.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, allowed long, denied long", "tokens double, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_slots_stream(stream: DataFrame, session: str, turn: str, names: list[str], idle_ms: int = IDLE_SECONDS * 1000) -> DataFrame:
    """Each turn with the slots its session knew: the state is the latest value of each slot and the number of turns."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(stream.dtypes)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *known, turns = state.get if state.exists else (*[None] * len(names), 0)
        rows = pd.concat(list(frames)).sort_values(turn)
        out = []
        for row in rows.to_dict("records"):
            known = [row[n] if isinstance(row[n], str) else k for n, k in zip(names, known)]
            turns = min(turns + 1, MAX_TURNS)
            out.append((name[0], row[turn], *known))
        state.update((*known, turns))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[session, turn, *[f"carried_{n}" for n in names]])

    schema = f"{session} {kinds[session]}, {turn} {kinds[turn]}, " + ", ".join(f"carried_{n} string" for n in names)
    state = ", ".join(f"{n} string" for n in names) + ", turns int"
    return stream.select(session, turn, *names).groupBy(session).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def cache_hits(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, requests, hits): how many events a cache filled at a miss and good for `seconds` would have answered.

    The time of the fill is folded along each key: a hit doesn't renew an entry.
    """
    ordered = F.sort_array(F.collect_list(micros(at)))
    start = F.struct(F.lit(None).cast("long").alias("fill"), F.lit(0).cast("long").alias("hits"))

    def step(s: Column, t: Column) -> Column:
        hit = F.coalesce(t - s["fill"] < seconds * 1_000_000, F.lit(False))
        return F.struct(F.when(hit, s["fill"]).otherwise(t).alias("fill"), (s["hits"] + hit.cast("long")).alias("hits"))

    return events.groupBy(key).agg(F.count("*").alias("requests"), F.aggregate(ordered, start, step)["hits"].alias("hits"))


def distinct_within(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def keep_recent(states: DataFrame, key: str, used: str, most: int) -> DataFrame:
    """The `most` keys used last."""
    return states.orderBy(F.desc(used), F.asc(key)).limit(most)
