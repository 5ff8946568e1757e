"""Intervals that overlap: joins, counts and peaks, with open ends, by equal keys.

An interval is two long numbers (columns or their names), half open: ``start`` belongs to it, ``end`` does not.  A null start is open
to the past, a null end to the future; an interval whose end is not behind its start is empty and overlaps
nothing, nor does one with a null key.  Intervals that only touch do not overlap.

Joins place every interval on the level whose cells are about as long as it is, so it lies in one or two
cells there.  Two intervals meet on the level of the longer one: it waits in its own cells, the shorter one
visits the cells it lies in.  Levels that few intervals are on are left out, and those are cut into more
cells below, by the number of intervals a level (``used_levels``).  So no cell width has to be chosen, and
rows that meet overlap with a share that does not fall as data grow.  Intervals with an open end wait in one
cell a key, where all others of the key visit them.

Counts and peaks make no pairs: they are differences of ranks of starts and ends, which come from a range
sort with one row per task and key (``order.before``), so a key or a moment with many rows has many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.operators.order import before

OPEN, STEP = 66, 3  # the level of intervals with an open end; every third level is used
EVER, NEVER = -(2**63), 2**63 - 1

Span = tuple[Column | str, Column | str]


def days(first: Column, last: Column) -> Span:
    """The span of two texts with ISO dates, both days included; empty texts and nulls are open ends.
    A text that is no date makes the span empty."""
    n = lambda c: F.unix_date(F.try_to_date(F.trim(c), "yyyy-MM-dd")).cast("long")
    unset = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    broken = (~unset(first) & n(first).isNull()) | (~unset(last) & n(last).isNull())
    return F.when(broken, F.lit(0)).otherwise(n(first)), F.when(broken, F.lit(0)).otherwise(n(last) + 1)


def moments(first: Column, last: Column) -> Span:
    """The span of two timestamps in microseconds, as the clock showed them, the last one not included."""
    n = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    return n(first), n(last)


def _all_set(keys: list[str]) -> Column:
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    return whole


def _columns(span: Span) -> tuple[Column, Column]:
    return tuple(F.col(c) if isinstance(c, str) else c for c in span)


def _filled(span: Span) -> tuple[Column, Column]:
    start, end = _columns(span)
    return F.coalesce(start, F.lit(EVER)), F.coalesce(end, F.lit(NEVER))


def _cell(at: Column, level: Column) -> Column:
    return F.when(level == OPEN, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", at, F.least(level, F.lit(63))))


def _cells(level: Column) -> Column:
    return F.when(level == OPEN, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(_cell(F.col("low"), level), _cell(F.col("high"), level)))


def _placed(df: DataFrame, keys: list[str], span: Span) -> DataFrame:
    """Keys k0, k1, ..., the bounds low and high (both included), the level, and the other columns."""
    (start, end), (first, last) = _filled(span), _columns(span)
    own = {k.lower() for k in keys}
    rest = F.struct(*(c for c in df.columns if c.lower() not in own))
    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), start.alias("low"), end.alias("end"), (first.isNull() | last.isNull()).alias("open"), rest.alias("row"))
    rows = rows.where(_all_set([f"k{i}" for i in range(len(keys))]) & (F.col("low") < F.col("end"))).withColumn("high", F.col("end") - 1)
    length = F.try_subtract("high", "low")  # null where a long cannot hold it
    bits = F.when(length == 0, 0).otherwise(F.length(F.bin(length)))
    level = F.when(F.col("open") | length.isNull(), OPEN).otherwise(F.ceil(bits / STEP) * STEP).cast("int")
    return rows.withColumn("level", level).drop("end", "open")


def used_levels(rows: dict[int, int]) -> list[int]:
    """The levels on which intervals wait, given the number of intervals by level.

    A row visits every used level above its own, so levels cost rows; a level that few rows are on is left
    out where it is cheaper to cut those into more cells on the next one below."""
    closed = sorted(n for n in rows if n != OPEN)

    def cost(used: list[int]) -> float:
        total = 0.0
        for level, n in rows.items():
            if level != OPEN:
                home = max(u for u in used if u <= level)
                total += n * sum(2.0 ** (level - u) + 1 for u in used if u >= home)
        return total

    used = list(closed)
    while len(used) > 1:
        fewer = min(([u for u in used if u != out] for out in used[1:]), key=cost)
        if cost(fewer) > cost(used):
            break
        used = fewer
    return used + [OPEN] * (OPEN in rows)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: Span, right_span: Span) -> DataFrame:
    """Every pair of a left and a right row of equal keys whose spans overlap, once: the left row's columns,
    then the right row's without the keys.  Apart from the keys the two have no column in common.

    Rows travel with their cells, so they should be narrow; what is wide is joined to the pairs by id."""
    own = {k.lower() for k in keys}
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - own
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    a, b = _placed(left, keys, left_span), _placed(right, keys, right_span)
    ks = [f"k{i}" for i in range(len(keys))]
    counted = {r.level: r["count"] for r in a.select("level").unionByName(b.select("level")).groupBy("level").count().collect()}  # 23 rows at most
    used = used_levels(counted)
    levels = F.array(*(F.lit(n) for n in used)) if used else F.array().cast("array<int>")
    a, b = (x.withColumn("level", F.array_max(F.filter(levels, lambda n: n <= F.col("level")))) for x in (a, b))

    def meet(waiting: DataFrame, visiting: DataFrame, too: bool) -> DataFrame:
        """Pairs on the level of ``waiting``; rows of one level meet only where ``too`` says so."""
        home = waiting.select(*ks, F.col("level").alias("at"), F.explode(_cells(F.col("level"))).alias("cell"), F.col("low").alias("low_w"), F.col("high").alias("high_w"), F.col("row").alias("row_w"))
        abroad = visiting.withColumn("at", F.explode(F.filter(levels, lambda n: n >= F.col("level") if too else n > F.col("level"))))
        abroad = abroad.select(*ks, "at", F.explode(_cells(F.col("at"))).alias("cell"), "low", "high", "row")
        met = home.join(abroad, [*ks, "at", "cell"]).where((F.col("low") <= F.col("high_w")) & (F.col("low_w") <= F.col("high")))
        return met.where(F.col("cell") == _cell(F.greatest("low", "low_w"), F.col("at")))  # two may share many cells

    pairs = meet(b, a, True).select(*ks, F.col("row").alias("l"), F.col("row_w").alias("r"))
    pairs = pairs.unionByName(meet(a, b, False).select(*ks, F.col("row_w").alias("l"), F.col("row").alias("r")))
    named = {k.lower(): i for i, k in enumerate(keys)}
    of_left = (F.col(f"k{named[c.lower()]}" if c.lower() in own else f"l.`{c}`").alias(c) for c in left.columns)
    return pairs.select(*of_left, *(F.col("r")[c].alias(c) for c in right.columns if c.lower() not in own))


def overlap_counts(probes: DataFrame, stored: DataFrame, keys: list[str], id_column: str, probe_span: Span, stored_span: Span) -> DataFrame:
    """Per probe (``id_column``, unique) the number of stored rows of equal keys whose spans overlap its own
    (``n_overlaps``): the starts before its end, less the ends up to its start."""
    ks = [f"k{i}" for i in range(len(keys))]
    kind = probes.schema[id_column].dataType
    numbered = lambda df, span: df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), *(c.alias(n) for c, n in zip(_filled(span), ("start", "end"))), *([F.col(id_column).alias("id")] if df is probes else [F.lit(None).cast(kind).alias("id")]))

    def marks(df: DataFrame, asked: bool) -> DataFrame:
        """A row for the ranks of starts (side 0) and one for those of ends (side 1); ``turn`` orders equal moments."""
        at = ("end", "start") if asked else ("start", "end")
        turn = (0, 1) if asked else (1, 0)
        two = F.array(*(F.struct(F.lit(side).alias("side"), F.col(at[side]).alias("at"), F.lit(turn[side]).alias("turn")) for side in (0, 1)))
        # a spread of equal moments over tasks
        return df.where("start < end").where(_all_set(ks)).select(*ks, "id", F.inline(two)).withColumns({"asked": F.lit(asked), "spread": F.lit(0).cast("byte") if asked else (F.rand(7) * 100).cast("byte")})

    both = marks(numbered(probes, probe_span), True).unionByName(marks(numbered(stored, stored_span), False))
    ranked = before(both, F.when(F.col("asked"), 0).otherwise(1), [*ks, "side"], [F.col("at"), F.col("turn"), F.col("spread"), F.col("id")])
    counts = ranked.where("asked").groupBy("id").agg(F.sum(F.when(F.col("side") == 0, F.col("_before")).otherwise(-F.col("_before"))).alias("n_overlaps"))
    nothing = probes.select(F.col(id_column).alias("id"), F.lit(0).cast("long").alias("n_overlaps"))
    return counts.unionByName(nothing).groupBy(F.col("id").alias(id_column)).agg(F.sum("n_overlaps").alias("n_overlaps"))


def most_at_once(df: DataFrame, keys: list[str], span: Span) -> DataFrame:
    """Per key the largest number of its intervals that hold one moment (``most``), and the first such
    moment (``since``, null where it is open to the past).  Keys without an interval are not returned."""
    start, end = _filled(span)
    two = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))
    rows = df.select(*keys, start.alias("start"), end.alias("end")).where("start < end").where(_all_set(keys)).select(*keys, F.inline(two))
    moments_ = rows.groupBy(*keys, "at").agg(F.sum("step").cast("long").alias("step"))  # ends and starts of one moment cancel
    running = before(moments_, F.col("step"), keys, [F.col("at")]).withColumn("now", F.col("_before") + F.col("step"))
    best = running.groupBy(*keys).agg(F.max(F.struct("now", F.bitwise_not("at").alias("earlier"))).alias("best"))
    at = F.bitwise_not("best.earlier")
    return best.select(*keys, F.col("best.now").alias("most"), F.when(at != EVER, at).alias("since"))
