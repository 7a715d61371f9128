"""Point-in-time feature table: what was known of a client at each sale's time t, in windows of several lengths.

A fact of event time e counts in the window of d days while t lies in [begin, e + d), where begin is the latest of e, its
arrival plus a lag and its shipping. So each fact is a plus at begin and a minus at e + d, sales to ask for are probes, and one
running sum a client answers all probes. Distinct items are counted by the union of an item's intervals, which a running
maximum of earlier event times gives. The last click is a running maximum too: the latest of those that have begun is within
the window or none is.

Clients (and pairs of client and item) with more than one row in HOT_SHARE are hot, of which there are fewer than HOT_SHARE.
Their rows are summed by time first and dealt out by hours; what stands before an hour comes from sums of days and of the
day's earlier hours, so no task gets all rows of a client. Nothing goes to the driver or into a broadcast but the hot keys.

Nulls: a sale without client_id or sold_at isn't asked for, one without sale_id has no t; a fact without client, event time,
arrival or (lines) shipping counts nowhere. Values that are null or not finite are 0 cents. Fully equal clicks count once,
equal lines as often as they occur; a sale_id in several rows of sales has its lines in each. Other columns are ignored.
Empty tables give no rows, or zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, written

HOUR, DAY = 3_600_000_000, 86_400_000_000
DAYS, LAG_MINUTES, LABEL_DAYS, SPREAD_SECONDS = (2, 14), 240, 7, 259_200
#: A key is hot if it has more than one of so many rows.
HOT_SHARE = 1000
CLICK, SALE, LINE, ITEM, LABEL, PROBE = range(6)
_ASKED = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is UTC whatever the session's zone is."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(c.cast("timestamp"))


def cents(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def deltas(rows: DataFrame, what: int, days: Sequence[int], n: Column | None = None, x: Column | None = None, m: Column | None = None, at: Column | None = None, id_: Column | None = None) -> DataFrame:
    """The plus and the minuses of facts (client, begin, event): a count n, a second count x, cents m; at and id of the fact."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    values = {"n": n if n is not None else F.lit(1).cast("long"), "x": zero if x is None else x, "m": zero if m is None else m}
    lives = {d: F.col("begin") < F.col("event") + d * DAY for d in days}

    def change(time: Column, signs: dict[int, int], keep: bool) -> Column:
        cells = [(F.when(lives[d], v * signs[d]).otherwise(zero) if d in signs else zero).alias(f"{k}{d}") for d in days for k, v in values.items()]
        return F.struct(time.alias("time"), *cells, (at if keep and at is not None else none).alias("at"), (id_ if keep and id_ is not None else none).alias("id"))

    plus = F.when(lives[max(days)], change(F.col("begin"), dict.fromkeys(days, 1), True))
    minus = [F.when(lives[d], change(F.col("event") + d * DAY, {d: -1}, False)) for d in days]
    return rows.select("client", F.lit(what).alias("what"), F.inline(F.array_compact(F.array(plus, *minus))))


def _single(rows: DataFrame, what: int, days: Sequence[int], time: Column, n: int, id_: Column | None = None) -> DataFrame:
    """One row a fact: a change of n in the first window's count, or a probe."""
    zero = F.lit(0).cast("long")
    cells = [(F.lit(n).cast("long") if d == days[0] and k == "n" else zero).alias(f"{k}{d}") for d in days for k in "nxm"]
    return rows.select("client", F.lit(what).alias("what"), time.alias("time"), *cells, F.lit(None).cast("long").alias("at"), (F.lit(None).cast("long") if id_ is None else id_).alias("id"))


def split(rows: DataFrame, keys: list[str], share: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys with more than one in `share` of all rows, which are fewer than `share` keys, and the others.

    Keys go by their hashes: what shares a hash with a hot key is handled like one.
    """
    total = rows.count()
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * share > total)
    hot = F.xxhash64(*keys).isin([r["h"] for r in large.select(F.xxhash64(*keys).alias("h")).collect()])
    return rows.filter(hot), rows.filter(~hot)


def opened(rows: DataFrame, keys: list[str], time: str, folds: dict) -> DataFrame:
    """rows with their hour, and for each hour an opening row, of null time, that holds the folds of all earlier hours.

    Two levels: sums of days, and of the hours of a day. folds: an aggregate function for each value column.
    """
    timed = rows.withColumn("hour", F.floor(F.col(time) / HOUR)).withColumn("day", F.floor(F.col(time) / DAY))
    hours = timed.groupBy(*keys, "day", "hour").agg(*(f(c).alias(c) for c, f in folds.items()))
    days = hours.groupBy(*keys, "day").agg(*(f(c).alias(c) for c, f in folds.items()))
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "day", F.lit(None).cast("long").alias("hour"), *(f(c).over(before).alias(c) for c, f in folds.items()))
    within = Window.partitionBy(*keys, "day").orderBy(F.col("hour").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    opening = hours.unionByName(days).select(*keys, "hour", *(f(c).over(within).alias(c) for c, f in folds.items())).filter(F.col("hour").isNotNull())
    return timed.drop("day").unionByName(opening, allowMissingColumns=True)


def item_deltas(lines: DataFrame, days: Sequence[int], share: int) -> DataFrame:
    """Changes of the number of distinct items: an interval counts from where the item's earlier ones have ended."""
    starts = lines.filter(F.col("item").isNotNull()).groupBy("client", "item", "begin").agg(F.max("event").alias("event"))
    starts = written(starts, "pit-starts")
    keys = ["client", "item"]
    hot, rest = split(starts, keys, share)
    earlier = lambda *by: F.max("event").over(Window.partitionBy(*by).orderBy(F.col("begin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    rest = rest.withColumn("before", earlier(*keys))
    hot = opened(hot, keys, "begin", {"event": F.max}).withColumn("before", earlier(*keys, "hour")).filter(F.col("begin").isNotNull()).drop("hour")
    new = rest.unionByName(hot).filter(F.col("before").isNull() | (F.col("before") < F.col("event")))
    parts = []
    for d in days:  # begin differs by window where an earlier interval overlaps
        begin = F.greatest(F.col("begin"), F.col("before") + d * DAY)
        parts.append(F.when(begin < F.col("event") + d * DAY, F.struct(begin.alias("begin"), F.lit(d).alias("d"))))
    each = new.select("client", "event", F.inline(F.array_compact(F.array(*parts))))
    zero = F.lit(0).cast("long")
    cells = lambda sign: [(F.when(F.col("d") == d, F.lit(sign).cast("long")).otherwise(zero) if k == "n" else zero).alias(f"{k}{d}") for d in days for k in "nxm"]
    none = F.lit(None).cast("long")
    both = F.array(F.struct(F.col("begin").alias("time"), *cells(1), none.alias("at"), none.alias("id")), F.struct((F.col("event") + F.col("d").cast("long") * DAY).alias("time"), *cells(-1), none.alias("at"), none.alias("id")))
    return each.select("client", F.lit(ITEM).alias("what"), F.inline(both))


def sold_lines(sales: DataFrame, sale_lines: DataFrame, lag: int, longest: int, share: int = HOT_KEYS) -> DataFrame:
    """(client, item, event, begin, m) of each line of a sale; the lines of a very large sale are salted, so that no task gets all."""
    lines = sale_lines.filter(F.col("sale_id").isNotNull() & F.col("shipped_at").isNotNull())
    lines = lines.select("sale_id", F.col("item_id").cast("long").alias("item"), micros(sale_lines, "shipped_at").alias("shipped"), cents("amount").alias("m"), F.xxhash64("line_no", "item_id", "vendor_id", "quantity", "amount", "shipped_at").alias("h"))
    sold = sales.filter("client IS NOT NULL AND event IS NOT NULL AND arrived IS NOT NULL").select("sale_id", "client", "event", "arrived")
    each = max(1, lines.count() // share)
    large = lines.groupBy("sale_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > each).select("sale_id", F.ceil(F.col("n") / each).alias("salts"))
    large = F.broadcast(large)  # fewer than `share` rows, with 2 * share salts at most
    salts = F.coalesce("salts", F.lit(1))
    lines = lines.join(large, "sale_id", "left").withColumn("salt", F.pmod("h", salts))
    sold = sold.join(large, "sale_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    out = lines.join(sold, ["sale_id", "salt"]).select("client", "item", "event", F.greatest("event", F.col("arrived") + lag, "shipped").alias("begin"), "m")
    return out.filter(F.col("begin") < F.col("event") + longest * DAY)


def _wide(rows: DataFrame, days: Sequence[int]) -> DataFrame:
    """A column for each sum that is asked for."""
    of = lambda what, c: F.when(F.col("what") == what, F.col(c)).otherwise(F.lit(0).cast("long"))
    sums = [of(w, f"{k}{d}").alias(f"{name}{d}") for d in days for name, w, k in zip(_ASKED, (CLICK, CLICK, CLICK, SALE, SALE, LINE, ITEM, LINE), "nxmnmnnm", strict=True)]
    last = F.when((F.col("what") == CLICK) & F.col("at").isNotNull(), F.struct("at", "id"))
    return rows.select("client", "time", *sums, of(LABEL, f"n{days[0]}").alias("later"), last.alias("last"), (F.col("what") == PROBE).alias("probe"), F.when(F.col("what") == PROBE, F.col("id")).alias("sale_id"))


def _answers(rows: DataFrame, by: list[str], folds: dict) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("time").asc_nulls_first())
    return rows.select("client", "time", "probe", "sale_id", *(f(c).over(w).alias(c) for c, f in folds.items())).filter("probe")


def features(clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, days: Sequence[int] = DAYS, lag_minutes: int = LAG_MINUTES, label_days: int = LABEL_DAYS, hot_share: int = HOT_SHARE) -> DataFrame:
    """A row for each sale with client, time and id, and each window of d days (see the module)."""
    days, lag = tuple(sorted(days)), lag_minutes * 60_000_000
    longest = max(days)
    seen = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").distinct()
    seen = seen.select(F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("event"), F.greatest(micros(clicks, "ts"), micros(clicks, "arrived_at") + lag).alias("begin"), F.col("click_id").cast("long").alias("click"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("long").alias("bought"), cents("value").alias("m"))
    sold = sales.select("sale_id", F.col("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("event"), micros(sales, "arrived_at").alias("arrived"), cents("total").alias("m"))
    known = sold.filter("client IS NOT NULL AND event IS NOT NULL")
    asked = known.filter(F.col("sale_id").isNotNull())
    t = F.col("event") + (F.crc32(F.col("sale_id").cast("string")) % SPREAD_SECONDS) * 1_000_000
    lines = written(sold_lines(sold, sale_lines, lag, longest), "pit-lines")
    arrived = known.filter(F.col("arrived").isNotNull()).withColumn("begin", F.greatest("event", F.col("arrived") + lag))
    events = [
        deltas(seen, CLICK, days, x=F.col("bought"), m=F.col("m"), at=F.col("event"), id_=F.col("click")),
        deltas(arrived, SALE, days, m=F.col("m")),
        deltas(lines, LINE, days, m=F.col("m")),
        item_deltas(lines, days, hot_share),
        _single(known, LABEL, days, F.col("event") - label_days * DAY, 1),
        _single(known, LABEL, days, F.col("event"), -1),
        _single(asked, PROBE, days, t, 0, F.col("sale_id").cast("long")),
    ]
    rows = written(reduce(DataFrame.unionByName, events), "pit-events")
    hot, rest = split(rows, ["client"], hot_share)
    folds = {f"{name}{d}": F.sum for d in days for name in _ASKED} | {"later": F.sum, "last": F.max}
    answers = _answers(_wide(rest.repartition("client"), days), ["client"], folds)
    hot = _wide(hot, days)
    summed = hot.filter("NOT probe").groupBy("client", "time").agg(*(f(c).alias(c) for c, f in folds.items()), F.lit(False).alias("probe"), F.lit(None).cast("long").alias("sale_id"))
    hot = opened(written(summed.unionByName(hot.filter("probe")), "pit-hot"), ["client"], "time", folds)
    hot = hot.withColumn("probe", F.coalesce("probe", F.lit(False)))
    answers = answers.unionByName(_answers(hot, ["client", "hour"], folds))
    out = []
    for d in days:
        last = F.when(F.col("last.at") > F.col("time") - d * DAY, F.col("last.id"))
        counts = {name: F.coalesce(F.col(f"{name}{d}"), F.lit(0)).cast("long") for name in _ASKED}
        first = [counts[k].alias(k) for k in _ASKED[:3]]
        out.append(F.struct(F.lit(d).alias("d"), F.col("time").alias("t_us"), (F.col("later") > 0).alias("label"), *first, last.alias("last_click_id"), *(counts[k].alias(k) for k in _ASKED[3:])))
    return answers.select("sale_id", F.inline(F.array(*out)))
