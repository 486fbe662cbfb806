"""Ticks, closing prices, settlement, notifications and ratings as streaming queries.

Every function takes and returns a streaming (or batch) DataFrame; state is bounded by watermarks or
by the number of open picks and teams. State and offsets live in the checkpoint folder.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def line_movement(ticks: DataFrame, keys: list[str], window: str = "1 hour", slide: str | None = None, delay: str = "2 hours", ts: str = "ts", odds: str = "odds") -> DataFrame:
    """Open, high, low, close and tick count per market and event-time window; late ticks beyond the delay are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    order = F.struct(ts, "tick_id")
    return (ticks.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(
        F.min_by(odds, order).alias("open"), F.max(odds).alias("high"), F.min(odds).alias("low"), F.max_by(odds, order).alias("close"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), "open", "high", "low", "close", "n"))


def quote_sessions(ticks: DataFrame, keys: list[str], gap: str = "30 minutes", delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Sessions of quote activity per market."""
    return (ticks.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n"))


def pre_start(ticks: DataFrame, ts: str = "ts", start: str = "start") -> DataFrame:
    """Snapshots captured after the start carry no pre-match information."""
    return ticks.where(F.col(ts) < F.col(start))


def new_picks_once(picks: DataFrame, delay: str = "3 days", ts: str = "detected_at") -> DataFrame:
    """Each (event, selection, book) is emitted once."""
    return picks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event", "selection", "book"])


def settle_stream(picks: DataFrame, results: DataFrame, days: int = 3, delay: str = "6 hours") -> DataFrame:
    """Left outer interval join: a result within `days` of the start settles the pick, the watermark emits the rest as expired.

    picks(pick_event, start, selection, odds), results(result_event, ended, outcome).
    """
    p, q = picks.withWatermark("start", delay), results.withWatermark("ended", delay)
    cond = (F.col("pick_event") == F.col("result_event")) & (F.col("ended") >= F.col("start")) & (F.col("ended") <= F.col("start") + F.expr(f"INTERVAL {days} DAYS"))
    j = p.join(q, cond, "left_outer")
    won = F.col("outcome") == F.col("selection")
    return j.withColumns({"result": F.when(F.col("outcome").isNull(), "expired").when(won, "won").otherwise("lost"),
                          "profit_units": F.when(F.col("outcome").isNotNull(), F.when(won, F.col("odds") - 1).otherwise(-1.0))})


class ClosingLine(StatefulProcessor):
    """Per market and selection: the pick price taken and the last fair price before the start.

    Input rows carry kind ('pick' or 'tick'), ts, start and price. Rows of a key may arrive in any
    order: the latest tick strictly after detection and strictly before the start wins. A timer at the start emits the
    frozen CLV and clears the key, so state is bounded by open picks.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pick = handle.getValueState("pick", "odds double, detected timestamp, start timestamp")
        self.last = handle.getValueState("last", "fair double, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for kind, ts, start, price in pdf[["kind", "ts", "start", "price"]].itertuples(index=False):
                if kind == "pick" and not self.pick.exists():
                    self.pick.update((float(price), ts.to_pydatetime(), start.to_pydatetime()))
                    self.handle.registerTimer(int(start.timestamp() * 1000))
                elif kind == "tick" and ts < start:
                    seen = self.last.get() if self.last.exists() else None
                    if seen is None or pd.Timestamp(seen[1]) < ts:
                        self.last.update((float(price), ts.to_pydatetime()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        odds, detected, start = self.pick.get()
        clv = None
        if self.last.exists():
            fair, ts = self.last.get()
            if pd.Timestamp(ts) > pd.Timestamp(detected):
                clv = odds / fair - 1
        self.pick.clear()
        self.last.clear()
        yield pd.DataFrame({"market_id": [key[0]], "side": [key[1]], "odds": [odds], "clv": [clv]})

    def close(self) -> None:
        pass


def freeze_clv(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming ledger: closing-line value of every pick, emitted once when its event starts."""
    return (rows.withWatermark("ts", delay).groupBy("market_id", "side").transformWithStateInPandas(
        ClosingLine(), "market_id int, side int, odds double, clv double", "append", "EventTime"))


#: Rows that leave the replay at a time.
OUT_ROWS = 10_000


class EloState(StatefulProcessor):
    """Incremental Elo: ratings per team of one group; each trigger's results are replayed in date order.

    A trigger's results of one group are held in one task, as narrow rows; `run_in_order` keeps triggers small.
    """

    def __init__(self, k: float = 20.0, hfa: float = 65.0, init: float = 1500.0):
        self.k, self.hfa, self.first = k, hfa, init

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "team string", "rating double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from ..models.ratings import _margin_weight, win_expectancy
        codes: dict = {}                                                     # a number for each team: rows hold no strings

        def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
            day = pdf["match_date"]
            team = {c: np.fromiter((codes.setdefault(x, len(codes)) for x in pdf[c]), np.int32, len(pdf)) for c in ("home", "away")}
            return pdf[["match_id", "gd"]].assign(match_date=day.astype("datetime64[s]") if day.dtype == object else day, **team)
        batch = pd.concat([narrow(pdf) for pdf in rows], ignore_index=True).sort_values(["match_date", "match_id"], ignore_index=True)
        known = {k[0]: float(v[0]) for k, v in self.ratings.iterator()}      # one row per team of the group
        rating = [known.get(x, self.first) for x in codes]
        for at in range(0, len(batch), OUT_ROWS):
            part, out = batch.iloc[at:at + OUT_ROWS], []
            for h, a, gd in part[["home", "away", "gd"]].itertuples(index=False):
                rh, ra = rating[h], rating[a]
                p = win_expectancy(rh + self.hfa - ra)
                gain = self.k * _margin_weight(gd) * ((1.0 if gd > 0 else 0.5 if gd == 0 else 0.0) - p)
                rating[h] = rh + gain
                rating[a] = ra - gain
                out.append((rh, ra, p))
            done = pd.DataFrame(out, columns=["elo_h", "elo_a", "elo_raw_ph"])
            done.insert(0, "match_id", part["match_id"].to_numpy())
            yield done
        for x, value in zip(codes, rating):
            self.ratings.updateValue((x,), (value,))

    def close(self) -> None:
        pass


def elo_stream(results: DataFrame, group: str = "country") -> DataFrame:
    """Pre-match ratings emitted as results arrive: (group, match_id, match_date, home, away, gd)."""
    kind = dict(results.dtypes)["match_id"]
    return results.groupBy(group).transformWithStateInPandas(EloState(), f"match_id {kind}, elo_h double, elo_a double, elo_raw_ph double", "append", "None")


def _drain(df: DataFrame, base: str, mode: str) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(df: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Process everything available now into a Parquet table under `folder` and read it back."""
    from uuid import uuid4
    base = f"{folder}/{name}-{uuid4().hex}"
    _drain(df, base, mode)
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def run_in_order(rows: DataFrame, stream: Callable[[DataFrame], DataFrame], name: str, folder: str, group: str, date_col: str = "match_date", slice_rows: int = 500_000) -> DataFrame:
    """What `stream` gives for rows that arrive in the order of their days: a trigger takes about `slice_rows` of a group, whole days, however
    large the table is. State lives on from trigger to trigger in one checkpoint. Rows without a day come last.

    Rows are dealt to time slices once; a slice is put into the folder that the stream reads when the one before it is done.
    """
    from uuid import uuid4
    from ..models.ratings import _slices
    from ..session import cut
    spark, base = rows.sparkSession, f"{folder}/{name}-{uuid4().hex}"
    days, n = _slices(rows, [group], date_col, slice_rows)

    def arrived() -> DataFrame:
        return stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    if n <= 1:
        rows.write.parquet(f"{base}/in")
        return run_available(arrived(), name, folder)
    first = cut(days.groupBy(group, "_slice").agg(F.min(date_col).alias("_from")))
    numbers = sorted(r[0] for r in first.select("_slice").distinct().collect())
    first = first.groupBy(F.col(group).alias("_group")).agg(F.collect_list(F.struct("_from", "_slice")).alias("_firsts"))
    begun = F.transform(F.filter("_firsts", lambda s: s["_from"] <= F.col(date_col)), lambda s: s["_slice"])
    dealt = rows.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("_group"))).withColumn("_in", F.when(F.col(date_col).isNull(), n - 1).otherwise(F.array_max(begun)))
    dealt.select(*rows.columns, "_in").write.partitionBy("_in").parquet(f"{base}/slices")
    for i in numbers:
        part = spark.read.schema(rows.schema).parquet(f"{base}/slices/_in={i}")
        part.write.mode("append").parquet(f"{base}/in")
        out = arrived()
        _drain(out, base, "append")
    return spark.read.schema(out.schema).parquet(f"{base}/out")
