"""Request-log analytics: body classes, latency, request bursts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .numbering import _POS, _SLICE, slice_by_range

INVALID_JSON = "Invalid JSON"
EMPTY_BODY = "Empty body"
EMPTY_RESPONSE = "Empty response"

BURST_LIMIT = 10
BURST_WINDOW_SECONDS = 60

_END = np.iinfo(np.int64).max


# strict JSON: nothing Spark's reader would let pass by default
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(col: Column) -> Column:
    """Is the text exactly one JSON value? Repeated keys are fine, as in any plain syntax check.

    Spark's JSON functions stop after the first value and overlook what follows.
    Inside an array and inside an object, trailing text breaks at least one of the two.
    """
    in_array = F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>", _STRICT)
    in_object = F.from_json(F.concat(F.lit('{"b":'), col, F.lit("}")), "map<string,string>", _STRICT)
    return in_array.isNotNull() & in_object.isNotNull()


def body_class(col: Column, empty_text: str = EMPTY_BODY) -> Column:
    """The body itself when it is valid JSON, else a fixed remark."""
    return (
        F.when(col.isNull() | (col == ""), F.lit(empty_text))
        .when(~is_json(col), F.lit(INVALID_JSON))
        .otherwise(col)
    )


def latency_by(df: DataFrame, group: str, start: str, stop: str) -> DataFrame:
    """Latency in microseconds per group: count, total, mean, maximum. Combined map-side, so hot uris are cheap."""
    micros = F.unix_micros(F.col(stop).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    timed = df.select(group, micros.alias("__us"))
    return timed.groupBy(group).agg(
        F.count("__us").alias("requests"),
        F.sum("__us").cast("bigint").alias("total_us"),
        F.expr("sum(__us) div count(__us)").cast("bigint").alias("mean_us"),
        F.max("__us").alias("max_us"),
    )


# --- bursts -----------------------------------------------------------------
#
# A client's window opens at its first request at least one window length after
# the previous opening; the first ``limit`` requests of a window pass. That is
# an ordered fold, but it only looks at a client's own open window, so a slice
# of a client's requests is summed up by a step function: "entering with a
# window that closes at e, the slice ends with window w holding n requests".
# Slices are cut by range over (client, time), so a client with a third of all
# requests is spread over many tasks:
#   1. every slice describes its first client's step function and its last
#      client's closing window,
#   2. the descriptions of a client are composed pairwise, level by level, up to
#      one for all its slices; going down again, the window open at the start of a
#      pair is taken through its left half, which gives that of the right half
#      (at the bottom at most one row per slice),
#   3. every slice marks its requests, starting from that window.


def mark_requests(
    t: np.ndarray, start: int | None, count: int, window: int, limit: int
) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """Fold one client's ordered times; returns pass flags, window openings, and the open window."""
    n = len(t)
    passed = np.zeros(n, dtype=bool)
    opened = np.empty(n, dtype=np.int64)
    i = 0
    while i < n:
        if start is None or t[i] - start >= window:
            start, count = int(t[i]), 0
        j = int(np.searchsorted(t, start + window, side="left"))
        room = max(0, min(limit - count, j - i))
        passed[i : i + room] = True
        opened[i:j] = start
        count = min(limit, count + j - i)
        i = j
    return passed, opened, start, count


def mark_sorted(
    clients: np.ndarray, t: np.ndarray, window: int, limit: int, carry: tuple[str | None, int | None, int],
    entered: np.ndarray | None = None, counts: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, tuple[str, int, int]]:
    """Fold rows ordered by client and time; ``carry`` is the last client with its open window and count.

    ``entered`` and ``counts`` are, for every row, the window its client had open before all rows (-1: none).

    A pause of a whole window length always opens a new window, so rows fall into
    runs that do not touch each other. A run shorter than a window is one window;
    only longer runs are walked.
    """
    n = len(t)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (clients[1:] != clients[:-1]) | (t[1:] - t[:-1] >= window)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    run = np.cumsum(fresh) - 1
    opened = t[starts][run]
    passed = np.arange(n) - starts[run] < limit
    walk = t[ends - 1] - t[starts] >= window
    carried = clients[0] == carry[0]
    walk[0] |= carried
    begins = np.r_[not carried, clients[starts[1:]] != clients[starts[1:] - 1]]  # runs that a client begins with
    if entered is not None:
        walk |= begins & (entered[starts] >= 0)
    start, count = int(t[starts[-1]]), min(limit, int(n - starts[-1]))
    for k in np.flatnonzero(walk):
        lo, hi = starts[k], ends[k]
        before = carry[1:] if k == 0 and carried else (None, 0)
        if entered is not None and begins[k] and entered[lo] >= 0:
            before = (int(entered[lo]), int(counts[lo]))
        passed[lo:hi], opened[lo:hi], s, c = mark_requests(t[lo:hi], *before, window, limit)
        if hi == n:
            start, count = s, c
    return passed, opened, (clients[-1], start, count)


def step_function(t: np.ndarray, window: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upto, exit start, exit count): entering with a window closing at e, the first ``upto >= e`` applies.

    Only requests inside the first window length can open the first new window.
    Neighbouring entries with the same exit are merged.
    """
    n = len(t)
    follow = np.searchsorted(t, t + window, side="left")
    follow = np.where(follow < n, follow, np.arange(n))
    while True:  # pointer doubling to the last window opened from each request
        jumped = follow[follow]
        if np.array_equal(jumped, follow):
            break
        follow = jumped
    m = min(int(np.searchsorted(t, t[0] + window, side="left")), n - 1) + 1
    exits = follow[:m]
    keep = np.append(exits[1:] != exits[:-1], True)
    return t[:m][keep], t[exits][keep], np.minimum(limit, n - exits)[keep]


_SUMMARY = "client string, slice int, upto long, exit_start long, exit_count int, n long, first long, e_start long, e_count int"


def _summarise(window: int, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = slice_id = None
        entered: dict = {}  # windows that the first and the last client had open before
        head, tail = [], []  # times of the slice's first client, and of its last one if that is another
        for b in batches:
            if len(b) == 0:
                continue
            clients, t = b["client"].to_numpy(), b["ts_us"].to_numpy()
            if slice_id is None:
                first, slice_id = clients[0], int(b[_SLICE].iloc[0])
                entered[first] = (int(b["e_start"].iloc[0]), int(b["e_count"].iloc[0]))
            if clients[0] == first:
                head.append(t[clients == first])
            if clients[-1] != last:
                last, tail = clients[-1], []
                entered = {first: entered[first], last: (int(b["e_start"].iloc[-1]), int(b["e_count"].iloc[-1]))}
            if last != first:
                tail.append(t[clients == last])
        if slice_id is None:
            return
        t = np.concatenate(head)
        upto, exit_start, exit_count = step_function(t, window, limit)
        yield pd.DataFrame(
            {
                "client": first, "slice": slice_id,
                # past every entry all requests still belong to the entering window
                "upto": np.append(upto, _END), "exit_start": np.append(exit_start, -1),
                "exit_count": np.append(exit_count, -1), "n": len(t), "first": t[0],
                "e_start": entered[first][0], "e_count": entered[first][1],
            }
        )
        if last != first:
            t = np.concatenate(tail)
            before = entered[last] if entered[last][0] >= 0 else (None, 0)
            _, _, start, count = mark_requests(t, *before, window, limit)
            yield pd.DataFrame(
                {
                    "client": [last], "slice": [slice_id], "upto": [_END],
                    "exit_start": [start], "exit_count": [count], "n": [len(t)], "first": [t[0]],
                    "e_start": [entered[last][0]], "e_count": [entered[last][1]],
                }
            )

    return run


def compose(left: pd.DataFrame, right: pd.DataFrame, window: int, limit: int) -> pd.DataFrame:
    """The step function of two neighbouring slices, the left one first.

    An entry of the left one leads to a window, and that to an entry of the right one. A window that closes after all
    requests of the left slice goes on into the right one; none does that opened a window length before the first request.
    Associative, so any tree of compositions gives the same function.
    """
    upto = right["upto"].to_numpy()
    starts, counts = left["exit_start"].to_numpy(), left["exit_count"].to_numpy()
    through = starts >= 0  # all but the entry of a window that takes in the whole slice
    at = np.searchsorted(upto, starts[through] + window, side="left")
    absorbed = right["exit_start"].to_numpy()[at] < 0
    exit_start = np.where(absorbed, starts[through], right["exit_start"].to_numpy()[at])
    exit_count = np.where(absorbed, np.minimum(limit, counts[through] + right["n"].iloc[0]), right["exit_count"].to_numpy()[at])
    made_upto, n, first = left["upto"].to_numpy()[through], int(left["n"].iloc[0] + right["n"].iloc[0]), int(left["first"].iloc[0])
    if not through.all():
        made_upto = np.append(made_upto, upto)
        exit_start = np.append(exit_start, right["exit_start"].to_numpy())
        exit_count = np.append(exit_count, right["exit_count"].to_numpy())
        # entries that no window reaches; the first one beyond stays for those that close in between
        most = int(np.searchsorted(made_upto, first + window, side="left")) + 1
        made_upto, exit_start, exit_count = made_upto[:most].copy(), exit_start[:most], exit_count[:most]
    made_upto[-1] = _END
    keep = np.append((exit_start[1:] != exit_start[:-1]) | (exit_count[1:] != exit_count[:-1]), True)
    return pd.DataFrame({"upto": made_upto[keep], "exit_start": exit_start[keep], "exit_count": exit_count[keep], "n": n, "first": first})


_NODE = "client string, node int, upto long, exit_start long, exit_count int, n long, first long"


def _pairs(window: int, limit: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "upto"], kind="stable")
        odd = pdf["node"].to_numpy() % 2 == 1
        made = compose(pdf[~odd], pdf[odd], window, limit) if odd.any() else pdf[["upto", "exit_start", "exit_count", "n", "first"]]
        return made.assign(client=key[0], node=key[1])[["client", "node", "upto", "exit_start", "exit_count", "n", "first"]]

    return run


def _entries(summaries: DataFrame, window: int, limit: int) -> DataFrame:
    """``(client, slice, open_start, open_count)``: the window open at the start of every slice but a client's first.

    A task of any level reads two descriptions, each of at most the requests of one window.
    """
    held = Window.partitionBy("client")
    slices = summaries.select("client", "slice", "e_start", "e_count").distinct()  # a row per slice, two where a client begins in it
    slices = slices.withColumns({"low": F.min("slice").over(held), "high": F.max("slice").over(held)}).where("high > low")
    level = cut_lineage(summaries.join(F.broadcast(slices.drop("e_start", "e_count")), ["client", "slice"]))
    levels, width = [level.withColumn("node", F.col("slice") - F.col("low"))], 0
    most = level.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    levels[0] = levels[0].select("client", "node", "upto", "exit_start", "exit_count", "n", "first")
    while most >> (width + 1):  # the last pair need not be composed: nothing follows it
        pair = F.floor(F.col("node") / 2).cast("int").alias("node")
        rows = levels[-1].groupBy("client", pair)
        levels.append(cut_lineage(rows.applyInPandas(_pairs(window, limit), _NODE)))
        width += 1
    before = F.when(F.col("e_start") >= 0, F.col("e_start")).alias("start")
    states = slices.select("client", F.lit(0).alias("node"), before, F.greatest("e_count", F.lit(0)).alias("count")).distinct()
    for i, nodes in enumerate(reversed(levels)):
        if i:  # a pair's window is that of its left half
            states = states.select("client", (F.col("node") * 2).alias("node"), "start", "count")
        closes = F.coalesce(F.col("start") + window, F.lit(-_END))
        at = nodes.join(states, ["client", "node"]).where(F.col("upto") >= closes)
        found = at.groupBy("client", "node", "start", "count").agg(F.min_by(F.struct("exit_start", "exit_count", "n"), "upto").alias("x"))
        took_all = F.col("x.exit_start") < 0
        right = found.select(
            "client", (F.col("node") + 1).alias("node"), F.when(took_all, F.col("start")).otherwise(F.col("x.exit_start")).alias("start"),
            F.when(took_all, F.least(F.lit(limit), F.col("count") + F.col("x.n"))).otherwise(F.col("x.exit_count")).cast("int").alias("count"),
        )
        known = nodes.select("client", "node").distinct()
        states = cut_lineage(states.unionByName(right.join(known, ["client", "node"], "left_semi")))
    entered = states.where("start is not null").join(F.broadcast(slices.select("client", "low").distinct()), "client")
    return entered.select("client", (F.col("node") + F.col("low")).alias("slice"), F.col("start").alias("open_start"), F.col("count").alias("open_count"))


def _mark(window: int, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, at = None, -1
        for b in batches:
            if len(b) == 0:
                continue
            entered, counts = b["e_start"].to_numpy(), b["e_count"].to_numpy()
            pos = b[_POS].to_numpy()
            if pos[0] <= at or (np.diff(pos) <= 0).any():
                raise RuntimeError("slice rows out of order")
            at = int(pos[-1])
            clients, t = b["client"].to_numpy(), b["ts_us"].to_numpy()
            if carry is None:
                open_start = b["open_start"].iloc[0]
                carry = (None, None, 0) if pd.isna(open_start) else (clients[0], int(open_start), int(b["open_count"].iloc[0]))
            passed, opened, carry = mark_sorted(clients, t, window, limit, carry, entered, counts)
            yield pd.DataFrame(
                {"client": clients, "request_id": b["request_id"], "ts_us": t, "allowed": passed, "window_us": opened}
            )

    return run


def burst_audit(
    df: DataFrame,
    client: str,
    ts: str,
    request_id: str,
    limit: int = BURST_LIMIT,
    window_seconds: int = BURST_WINDOW_SECONDS,
    slices: int | None = None,
    entering: DataFrame | None = None,
) -> DataFrame:
    """Which requests pass a limit of ``limit`` per window and client, exactly and for clients of any size.

    Returns ``(client, request_id, ts_us, allowed, window_us)``. ``request_id``
    is unique and orders requests of equal time. The windows are not tumbling:
    each opens at a request. ``entering`` has the windows that clients have open before these requests
    (``client``, ``open_start`` in microseconds, ``open_count``), one row per client.
    """
    window = window_seconds * 1_000_000
    narrow = df.select(
        F.coalesce(F.col(client).cast("string"), F.lit("")).alias("client"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"),
        F.col(request_id).cast("bigint").alias("request_id"),
    )
    if entering is None:
        narrow = narrow.withColumns({"e_start": F.lit(-1).cast("long"), "e_count": F.lit(0)})
    else:
        before = entering.select("client", F.col("open_start").alias("e_start"), F.col("open_count").alias("e_count"))
        narrow = narrow.join(before, "client", "left").fillna({"e_start": -1, "e_count": 0})
    ranged = slice_by_range(narrow, [F.col("client"), F.col("ts_us"), F.col("request_id")], slices)
    summaries = ranged.select("client", "ts_us", "e_start", "e_count", _SLICE).mapInPandas(_summarise(window, limit), _SUMMARY)
    entries = _entries(cut_lineage(summaries), window, limit)
    opened = ranged.join(
        F.broadcast(entries.withColumnRenamed("slice", _SLICE)),  # at most one row per slice
        ["client", _SLICE],
        "left",
    )
    return opened.select("client", "ts_us", "request_id", "e_start", "e_count", _POS, "open_start", "open_count").mapInPandas(
        _mark(window, limit), "client string, request_id long, ts_us long, allowed boolean, window_us long"
    )


def open_windows(marked: DataFrame, entering: DataFrame | None, limit: int, window_seconds: int) -> DataFrame:
    """Windows that are still open after the last of these requests, for the ``entering`` of the next ones.

    Windows that closed before it are dropped, so there are as many rows as clients of the last window length.
    """
    last = marked.groupBy("client", "window_us").agg(F.count(F.lit(1)).alias("n"))
    last = last.groupBy("client").agg(F.max_by("n", "window_us").alias("n"), F.max("window_us").alias("open_start"))
    if entering is not None:
        before = entering.select("client", F.col("open_start").alias("b_start"), F.col("open_count").alias("b_count"))
        last = last.join(before, "client", "full").select(
            "client", F.coalesce("open_start", "b_start").alias("open_start"),
            (F.coalesce("n", F.lit(0)) + F.when(F.coalesce("open_start", "b_start") == F.col("b_start"), F.col("b_count")).otherwise(0)).alias("n"),
        )
    now = marked.agg(F.max("ts_us")).first()[0]
    rows = last if now is None else last.where(F.col("open_start") + window_seconds * 1_000_000 > now)
    return rows.select("client", "open_start", F.least(F.lit(limit), F.col("n")).cast("int").alias("open_count"))


def burst_summary(marked: DataFrame) -> DataFrame:
    return marked.groupBy("client").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("allowed")).alias("refused"),
        F.count_distinct("window_us").alias("windows"),
    )
