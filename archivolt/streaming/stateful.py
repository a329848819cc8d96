"""Stateful operators, batch and stream: admission control, ring buffers, routing, change watching, event-time windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def decide(times: list[float], kept: deque, limit: int, window: float) -> list[tuple[bool, float]]:
    """(admitted, retry after) of each request in time order; only admitted ones count against the limit."""
    out = []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.popleft()
        if len(kept) < limit:
            kept.append(t)
            out.append((True, 0.0))
        else:
            out.append((False, kept[0] + window - t))
    return out


def admit(df: DataFrame, key: str, ts: str, limit: int, window_s: int, row_id: str) -> DataFrame:
    """Sliding-window admission per key over a table: adds admitted and retry_after_s.

    Whether a request passes depends on those let in before it, which no window
    frame can say. A key's requests are a chain only where gaps stay below the
    window: a gap of ``window_s`` empties it. So each key falls into sessions,
    and each session is one group, however many requests a key makes.
    """
    w = Window.partitionBy(key).orderBy("__t", row_id)
    d = df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    d = d.withColumn("__new", F.coalesce((F.col("__t") - F.lag("__t").over(w) >= window_s).cast("int"), F.lit(1)))
    d = d.withColumn("__session", F.sum("__new").over(w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, deque()
        for pdf in batches:
            ok, retry = [], []
            for who, n, at in zip(pdf[key], pdf["__session"], pdf["__t"]):
                if (who, n) != now:
                    now, kept = (who, n), deque()
                ((a, r),) = decide([at], kept, limit, window_s)
                ok.append(a)
                retry.append(r)
            yield pd.DataFrame({row_id: pdf[row_id], "admitted": ok, "retry_after_s": retry})

    idt = dict(df.dtypes)[row_id]
    # Sessions lie together and in order; the batches of a task are one pass with the state of one session.
    chains = d.select(key, "__session", "__t", row_id).repartition(key, "__session").sortWithinPartitions(key, "__session", "__t", row_id)
    out = chains.mapInPandas(run, f"`{row_id}` {idt}, admitted boolean, retry_after_s double")
    return df.join(out, row_id)


def admit_stream(df: DataFrame, key: str, ts: str, limit: int, window_s: int, row_id: str, ttl_s: int | None = None) -> DataFrame:
    """The same over a stream with a watermark on ``ts``: state per key is the admitted times of the last window; idle keys are dropped."""
    idt, kt = dict(df.dtypes)[row_id], dict(df.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([ts, row_id], kind="stable")
        kept = deque(state.get[0] if state.exists else [])
        t = (pdf[ts].astype("int64") / 1e6 if str(pdf[ts].dtype).endswith("[us]") else pdf[ts].astype("int64") / 1e9).tolist()
        got = decide(t, kept, limit, window_s)
        state.update((list(kept),))
        state.setTimeoutTimestamp(max(int((t[-1] + (ttl_s or window_s)) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], row_id: pdf[row_id], "admitted": [g[0] for g in got], "retry_after_s": [g[1] for g in got]})

    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kt}, `{row_id}` {idt}, admitted boolean, retry_after_s double", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ring_buffer(df: DataFrame, order_col: str, n: int = 50, key: str | None = None, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows (per key), in order."""
    order = [F.desc(order_col)] + ([F.desc(tie)] if tie else [])
    if key is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def presence(df: DataFrame, key: str, session: str, ts: str, kind: str, cap: int = 3) -> DataFrame:
    """Open sessions per key after each join/leave event and whether they stay within ``cap``."""
    w = Window.partitionBy(key).orderBy(ts, session).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(kind) == "join", 1).when(F.col(kind) == "leave", -1).otherwise(0)
    return df.withColumn("open", F.sum(step).over(w)).withColumn("within", F.col("open") <= cap)


def route(df: DataFrame, kind: str, text: str, redact: Column, url_ok: Column, cap: int = 500) -> DataFrame:
    """Chat (redacted, capped), share (allowed links only), follow and unfollow; private kinds are dropped."""
    public = df.where(F.col(kind).isin("chat", "share", "follow", "unfollow"))
    public = public.where((F.col(kind) != "share") | url_ok)
    return public.withColumn(text, F.when(F.col(kind) == "chat", F.left(redact, F.lit(cap))).otherwise(F.col(text)))


def status_transitions(df: DataFrame, key: str, ts: str, status: str, tie: str) -> DataFrame:
    """Rows at which a key's status differs from the one before; a key's first row counts."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col(status)))


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], *aggs: Column, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Event-time windows, tumbling or (with ``slide``) sliding; ``late`` is the watermark of a stream."""
    d = df.withWatermark(ts, late) if late else df
    return d.groupBy(F.window(ts, width, slide), *keys).agg(*aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late else df
    return d.groupBy(F.session_window(ts, gap), *keys).agg(*aggs)


def first_seen(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Drop repeats that arrive within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def watch_changes(stream: DataFrame, state_path: str, log_path: str, key: str, hash_col: str, checkpoint: str):
    """Each micro-batch of snapshots is compared with the stored one; events are appended, the store is swapped."""
    from archivolt.operators.joins import snapshot_diff
    from archivolt.sources.writers import _fs, swap, upsert

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fs, p = _fs(spark, state_path)
        latest = batch.groupBy(key).agg(F.max_by(hash_col, "seen").alias(hash_col), F.max("seen").alias("seen"))
        if not fs.exists(p):
            latest.select(key, F.lit("added").alias("kind"), F.lit(None).cast("string").alias("old"), F.col(hash_col).alias("new"), F.lit(n).alias("batch")).write.mode("append").json(log_path)
            latest.write.parquet(state_path)
            return
        known = spark.read.parquet(state_path)
        diff = snapshot_diff(known.join(latest.select(key), key, "left_semi"), latest, key, hash_col)
        diff.withColumn("batch", F.lit(n)).write.mode("append").json(log_path)
        swap(upsert(known, latest, key, "seen"), state_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
