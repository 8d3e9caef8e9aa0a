"""Anchored fixed-window rate limiting and alert rules.

A client's window opens at its first request, its anchor, and the next one opens at the first request *more than* the window length
later; a request is accepted while its window holds fewer than the limit. Anchors form a chain, which looks sequential per client, and a
client may send more than a task can hold, so the chain is composed of maps over parts of its time line:

* Only distinct times matter to the chain, so requests are counted by client and time first.
* A client's time line is cut into cells, and a window length is a whole number of cells (lanes): one for most clients, 16 a second for
  busy ones. From an anchor in a cell the next one lies in the same place of the cell one window later, or somewhat behind it; if that
  cell has nothing more, it is the first time of the next cell that has any. So a path stays in one lane until it falls out of it, and
  then it goes on at the first time of some cell.
* Each lane is a task's own: it follows the paths from the first times of all its cells at once, and says for each at which cell it
  falls out. That maps cells to cells, one row each, and the chain from a client's first cell is read off in order.
* The cells on the chain are replayed, lane by lane again, which gives the anchors. Requests since the anchor are counted by running
  totals of cells. Of the requests of one moment that only some are accepted of, the first by key are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.session import written

WINDOW_SECONDS = 60
LIMIT = 10
BUSY = 1 << 20  # distinct times of a client above which its windows are cut into lanes
CELL = 62_500  # microseconds of a busy client's cell; a whole second has 16
SALTS = 64


def _micros(ts: str):
    """Microseconds since the epoch, of the wall clock the column shows."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows with the same keys begin and end, of rows that lie in order."""
    fresh = np.zeros(len(keys[0]), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(fresh), len(fresh))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole cells, and where the cells begin; rows are in the order of client, lane and time. A cell holds a window's times of a
    client that is not busy, or a sixteenth of a second."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        at = _runs(pdf["c"].to_numpy(), pdf["cell"].to_numpy())
        held = pdf.iloc[at[-2]:]
        if len(at) > 2:
            yield pdf.iloc[:at[-2]], at[:-1]
    if held is not None:
        yield held.reset_index(drop=True), np.array([0, len(held)])


def _follow(span: int):
    """For each cell (c, cell): ``onward``, the cell at or behind which the path from its first time goes on; ``real`` is false where
    another path has met this one, and the cell named is where that one began."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_lane, came = None, 0
        anchors: list[int] = []  # of the paths in the lane, ascending, with the cells that they began at: the latest begun comes first
        began: list[int] = []
        for pdf, at in _cells(batches):
            us, (cs, cells, lanes, wides) = pdf["us"].tolist(), (pdf[x].to_numpy()[at[:-1]].tolist() for x in ("c", "cell", "lane", "lanes"))
            out: list[tuple[int, int, int, bool]] = []
            for a, b, c, cell, lane, wide in zip(at[:-1].tolist(), at[1:].tolist(), cs, cells, lanes, wides):
                if (c, lane, wide) != at_lane:
                    if at_lane is not None:
                        out += [(at_lane[0], x, came + at_lane[2] + 1, True) for x in began]
                    at_lane, anchors, began = (c, lane, wide), [], []
                reached, starts = [us[a]], [cell]
                i = a
                for k, anchor in enumerate(anchors):
                    i = bisect_right(us, anchor + span, i, b) if came + wide == cell else b
                    if i == b:  # nor do the anchors behind it find anything here
                        out += [(c, x, came + wide + 1, True) for x in began[k:]]
                        break
                    if us[i] == reached[-1]:
                        out.append((c, began[k], starts[-1], False))
                    else:
                        reached.append(us[i])
                        starts.append(began[k])
                anchors, began, came = reached, starts, cell
            yield _jumps(out)
        if at_lane is not None:
            yield _jumps([(at_lane[0], x, came + at_lane[2] + 1, True) for x in began])

    return run


def _jumps(rows: list[tuple[int, int, int, bool]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["c", "cell", "onward", "real"])
    return out.astype({"c": "int64", "cell": "int64", "onward": "int64", "real": bool})


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cells whose first time is an anchor, of rows of :func:`_follow` in the order of client and cell."""
    client, wanted = None, 0
    for pdf in batches:
        cs, cells, onward, real = (pdf[x].to_numpy() for x in ("c", "cell", "onward", "real"))
        keep = np.zeros(len(cs), dtype=bool)
        at = _runs(cs)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if cs[a] != client:
                client, wanted, began = int(cs[a]), cells[a], True
            i = bisect_left(cells, wanted, a, b)
            while i < b:
                keep[i] = began
                wanted, began = onward[i], real[i]
                i = bisect_left(cells, wanted, i, b)
        yield pdf.loc[keep, ["c", "cell"]]


def _replay(span: int):
    """Times with ``before``, the requests ahead in the cell, and ``anchored``, those ahead of the cell's last anchor up to here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_lane, anchor, came = None, 0, None
        for pdf, at in _cells(batches):
            us, n = pdf["us"].tolist(), pdf["n"].to_numpy()
            heads = (pdf[x].to_numpy()[at[:-1]].tolist() for x in ("c", "cell", "lane", "lanes", "begins"))
            first = np.zeros(len(us), dtype=bool)
            for a, b, c, cell, lane, wide, begins in zip(at[:-1].tolist(), at[1:].tolist(), *heads):
                if (c, lane) != at_lane:
                    at_lane, came = (c, lane), None
                if begins:
                    i = a
                elif came is not None and came + wide == cell:
                    i = bisect_right(us, anchor + span, a, b)
                else:
                    i = b
                came = None
                if i < b:  # a cell is no longer than a window: it has one anchor at most
                    first[i], anchor, came = True, us[i], cell
            sums = np.cumsum(n) - n
            which = np.repeat(np.arange(len(at) - 1), np.diff(at))
            before = sums - sums[at[:-1]][which]
            last = np.maximum.accumulate(np.where(first, np.arange(len(us)), -1))
            inside = last >= at[:-1][which]
            yield pd.DataFrame({"c": pdf["c"].to_numpy(), "cell": pdf["cell"].to_numpy(), "us": us, "n": n, "before": before,
                                "anchored": pd.arrays.IntegerArray(before[np.maximum(last, 0)], ~inside)})

    return run


def _moments(times: DataFrame, span: int) -> DataFrame:
    """c, us, n, used: of the distinct times of clients, how many requests of its window lie ahead of each."""
    busy = times.groupBy("c").agg(F.when(F.count("*") > BUSY, span // CELL).otherwise(1).cast("long").alias("lanes"))
    cells = times.join(busy, "c").withColumn("cell", F.expr(f"us div ({span} div lanes) - if(us % ({span} div lanes) < 0, 1, 0)"))
    cells = written(cells.withColumn("lane", F.pmod("cell", "lanes")), "limit-cells")
    # partitions by number, not by size: times are few bytes, but cost Python time
    n_part = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_lane = cells.repartition(n_part, "c", "lane").sortWithinPartitions("c", "lane", "us")
    jumps = by_lane.mapInPandas(_follow(span), "c long, cell long, onward long, real boolean")
    on_chain = jumps.repartition(n_part, "c").sortWithinPartitions("c", "cell").mapInPandas(_chain, "c long, cell long")
    begun = cells.join(on_chain.withColumn("begins", F.lit(True)), ["c", "cell"], "left").withColumn("begins", F.coalesce("begins", F.lit(False)))
    seen = begun.repartition(n_part, "c", "lane").sortWithinPartitions("c", "lane", "us").mapInPandas(
        _replay(span), "c long, cell long, us long, n long, before long, anchored long")
    seen = written(seen, "limit-times")
    # one row per cell from here
    totals = seen.groupBy("c", "cell").agg(F.max(F.col("before") + F.col("n")).alias("all"), F.max("anchored").alias("last"))
    ahead = Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("start", F.coalesce(F.sum("all").over(ahead), F.lit(0)))
    totals = totals.withColumn("entered", F.last(F.col("start") + F.col("last"), ignorenulls=True).over(ahead)).select("c", "cell", "start", "entered")
    return seen.join(totals, ["c", "cell"]).select(
        "c", "us", "n", (F.col("start") + F.col("before") - F.coalesce(F.col("start") + F.col("anchored"), "entered")).alias("used"))


def rate_limit(
    requests: DataFrame, client: str = "client", ts: str = "ts", key: str = "id",
    window_seconds: int = WINDOW_SECONDS, limit: int = LIMIT,
) -> DataFrame:
    """``client, key, ts, accepted`` for every request.

    Requests of one moment go by key. A null client is a client of its own; a request without a time has no decision.
    """
    span = window_seconds * 1_000_000
    r = requests.select(F.col(client).alias("client"), F.col(key).alias("key"), F.col(ts).alias("ts"), _micros(ts).alias("us"))
    clients = written(r.select("client").distinct().withColumn("c", F.monotonically_increasing_id()), "limit-clients")
    same = lambda a, b: a["client"].eqNullSafe(b["client"])
    counted = r.filter("us is not null").groupBy("client", "us").agg(F.count("*").alias("n"))
    times = written(counted.join(clients, same(counted, clients)).select("c", "us", "n"), "limit-moments")
    decided = _moments(times, span).join(clients, "c").select(
        F.col("client").alias("of"), F.col("us").alias("at"), (F.lit(limit) - F.col("used")).alias("free"), F.col("n").alias("together"))
    out = written(r.join(decided, r["client"].eqNullSafe(decided["of"]) & (r["us"] == decided["at"]), "left").drop("of", "at"), "limit-decided")
    some = F.coalesce((F.col("free") > 0) & (F.col("free") < F.col("together")), F.lit(False))
    whole = out.filter(~some).withColumn("accepted", F.col("free") > 0)
    # of a moment that is cut, the first by key: salted first, since a moment may hold any number of requests
    salted = Window.partitionBy("client", "us", F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy("key")
    near = out.filter(some).withColumn("nth", F.row_number().over(salted)).withColumn("near", F.col("nth") <= F.col("free"))
    far = near.filter(~F.col("near")).withColumn("accepted", F.lit(False))
    near = near.filter("near").withColumn("nth", F.row_number().over(Window.partitionBy("client", "us").orderBy("key")))
    near = near.withColumn("accepted", F.col("nth") <= F.col("free"))
    columns = [F.col("client").alias(client), F.col("key").alias(key), F.col("ts").alias(ts), "accepted"]
    return whole.select(*columns).unionByName(far.select(*columns)).unionByName(near.select(*columns))


def red_metrics(requests: DataFrame, every: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Rate, errors and duration per endpoint and tumbling window; works on streams too."""
    if watermark:
        requests = requests.withWatermark("ts", watermark)
    g = requests.groupBy(F.window("ts", every).alias("w"), "endpoint").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("status").startswith("2")).alias("errors"), F.sum("duration").alias("total_duration"))
    return g.select(F.col("w.start").alias("minute"), "endpoint", "requests", "errors", "total_duration")


def alert_error_rate(requests: DataFrame, share: float = 0.05, held: int = 5) -> DataFrame:
    """Five-minute windows, sliding by the minute, whose 5xx share was high for ``held`` slides running.

    A high slide votes for itself and the next ``held - 1``; a slide with all
    votes fires.  No global window is needed.
    """
    g = requests.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(
        F.count_if(F.col("status").startswith("5")).alias("bad"), F.count("*").alias("n"))
    high = g.filter(F.col("bad") / F.col("n") > share).select(F.col("w.end").alias("at"))
    minute = F.expr("INTERVAL 1 MINUTE")
    votes = high.select(F.explode(F.sequence("at", F.col("at") + minute * (held - 1), minute)).alias("at"))
    fired = votes.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") == held).select("at")
    return fired


def alert_size_drop(series: DataFrame, label: str, lookback: int = 3600, held: int = 300) -> DataFrame:
    """Points of ``label, ts, key, value`` whose one-hour increase stayed below zero for ``held`` seconds.

    Each point is read in its own time block and, as context, in the next, so
    a label with very many points is spread over blocks.
    """
    block = 2 * lookback * 1_000_000
    s = series.select(label, "ts", "key", "value", _micros("ts").alias("us")).withColumn("b", F.floor(F.col("us") / block))
    both = s.select("*", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("blk"))
    # a probe an hour before each point meets the first point at or after it
    point = F.struct(F.col("us").alias("at"), F.lit(0).alias("probe"), F.struct("value").alias("v"))
    probe = F.struct((F.col("us") - lookback * 1_000_000).alias("at"), F.lit(1).alias("probe"), F.lit(None).cast("struct<value:double>").alias("v"))
    rows = both.select("*", F.explode(F.array(point, probe)).alias("x")).select("*", "x.at", "x.probe", "x.v")
    back = Window.partitionBy(label, "blk").orderBy(F.desc("at"), "probe", F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("first", F.last("v", ignorenulls=True).over(back)).filter("probe = 1")
    peers = Window.partitionBy(label, "blk", "us")
    inc = found.withColumn("increase", F.max_by("value", "key").over(peers) - F.col("first.value"))
    # held: the latest point without a drop lies further back than the holding time
    so_far = Window.partitionBy(label, "blk").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    calm = F.max(F.when(F.col("increase") >= 0, F.col("us"))).over(so_far)
    fired = inc.withColumn("calm", calm).filter(F.coalesce(F.col("calm") < F.col("us") - held * 1_000_000, F.lit(True)))
    return fired.filter(F.col("blk") == F.col("b")).select(label, "ts", "key", "increase")
