"""What holds at a time: joins with the last row at or before it, and events folded through a state machine.

Both need a key's rows in order. A key that holds much of a table is cut into slices of time, which are worked on apart;
only what a slice hands on, one row, is brought into order across slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slice(at: Column, seconds: int | None) -> Column:
    return F.lit(0).cast("long") if seconds is None else F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], tie: list[Column] | None = None, slice_seconds: int | None = None) -> DataFrame:
    """left with the columns take of the last row of right of the same keys at or before left_at, null where there is none.

    Both sides go through one sort by key and time, so no pairs are made. Of rows of right of one key and time that with
    the greatest tie counts (columns of right; by default take itself). With slice_seconds, keys are cut into slices so
    long, and the last row of all earlier slices is handed on to each. Rows of left without a key or time find nothing;
    such rows of right are not found. take must name no column of left.
    """
    known = right.where(F.forall(F.array(*[F.col(k).isNotNull() for k in [*keys, right_at]]), lambda x: x))
    at = known.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.max_by(F.struct(*take), F.struct(*(tie or take))).alias("_v")).withColumn("_slice", _slice(F.col("_at"), slice_seconds))
    usable = F.forall(F.array(*[F.col(k).isNotNull() for k in [*keys, left_at]]), lambda x: x)
    asked = left.where(usable).select(*keys, F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_row")).withColumn("_slice", _slice(F.col("_at"), slice_seconds))
    none, order = F.lit(None), [F.col("_at").asc_nulls_first(), F.col("_row").isNotNull()]
    parts = asked.withColumn("_v", none).unionByName(at.withColumn("_row", none))
    if slice_seconds is not None:
        ends = at.groupBy(*keys, "_slice").agg(F.max_by("_v", "_at").alias("_v"))
        both = ends.unionByName(asked.select(*keys, "_slice").distinct().withColumn("_v", none)).groupBy(*keys, "_slice").agg(F.first("_v", ignorenulls=True).alias("_v"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        handed = both.select(*keys, "_slice", F.last("_v", ignorenulls=True).over(earlier).alias("_v")).where("_v IS NOT NULL")
        parts = parts.unionByName(handed.withColumn("_at", none).withColumn("_row", none))
    until = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = parts.withColumn("_v", F.last("_v", ignorenulls=True).over(until)).where("_row IS NOT NULL").select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in take])
    return met.unionByName(left.where(~usable).select("*", *[none.cast(t).alias(c) for c, t in right.select(*take).dtypes]))


def appended_places(known: DataFrame, found: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The snapshots that found (a row for each key) adds to known: those that differ from the key's last one, or are its first."""
    last = known.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("_last"))
    new = found.where(F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)).join(last, key, "left")
    return new.where(~F.struct(*columns).eqNullSafe(F.col("_last"))).select(*found.columns)


@dataclass(frozen=True)
class Machine:
    """States, the first of which keys begin in, and for each event what it makes of which states; it is refused in others."""

    states: tuple[str, ...]
    events: dict[str, dict[str, str]]

    def __post_init__(self):
        named = {s for moves in self.events.values() for move in moves.items() for s in move}
        if not named.issubset(self.states):
            raise ValueError(f"no such states: {sorted(named.difference(self.states))}")

    def event_number(self, event: Column) -> Column:
        """Events are numbered from 1; 0 is any other, which is refused everywhere."""
        number = F.lit(0)
        for n, name in enumerate(self.events, 1):
            number = F.when(event == name, n).otherwise(number)
        return number

    def table(self) -> Column:
        """For each event number and each state's number the state that follows; -1: refused."""
        place = {s: n for n, s in enumerate(self.states)}
        rows = [{}, *self.events.values()]
        return F.array(*[F.array(*[F.lit(place[moves[s]] if s in moves else -1) for s in self.states]) for moves in rows])

    def name(self, number: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.states)), number + 1)


def folded(events: DataFrame, keys: list[str], at: str, ident: str, event: str, machine: Machine, slice_seconds: int | None = None) -> DataFrame:
    """Each event with the state before and after it, and whether it was refused, which leaves the state as it was.

    Events of a key are taken by at and ident. A slice (slice_seconds of a key, all of it by default) is first folded
    from every state it may begin in, which gives a row of as many states; these are handed on in order, and then each
    slice is folded from the state that it does begin in. A slice's events are gathered in one row. Other columns are
    not kept. Rows without keys or time form a key or come first.
    """
    table, first = machine.table(), F.lit(0)
    rows = events.select(*keys, _slice(F.col(at), slice_seconds).alias("_slice"), F.struct(F.col(at).alias("at"), F.col(ident).alias("ident"), machine.event_number(F.col(event)).alias("event")).alias("x"))
    slices = rows.groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list("x")).alias("_events"))

    def follow(state: Column, x: Column) -> Column:
        return F.element_at(F.element_at(table, x["event"] + 1), state + 1)

    def after(state: Column, x: Column) -> Column:
        to = follow(state, x)
        return F.when(to < 0, state).otherwise(to)

    if slice_seconds is None:
        begun = slices.withColumn("_begin", first)
    else:
        ends = F.transform(F.sequence(F.lit(0), F.lit(len(machine.states) - 1)), lambda s: F.aggregate("_events", s, after))
        handed = slices.select(*keys, F.struct("_slice", ends.alias("ends")).alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_all"))
        step = F.struct(first.alias("state"), F.array().cast("array<struct<slice:bigint,begin:int>>").alias("out"))
        walked = F.aggregate("_all", step, lambda acc, s: F.struct(F.element_at(s["ends"], acc["state"] + 1).alias("state"), F.array_append(acc["out"], F.struct(s["_slice"].alias("slice"), acc["state"].alias("begin"))).alias("out")))
        starts = handed.select(*keys, F.explode(walked["out"]).alias("_b")).select(*keys, F.col("_b.slice").alias("_slice"), F.col("_b.begin").alias("_begin"))
        begun = slices.join(starts, [*keys, "_slice"])
    kinds = dict(events.dtypes)
    empty = F.array().cast(f"array<struct<at:{kinds[at]},ident:{kinds[ident]},before:int,after:int,refused:boolean>>")
    told = lambda acc, x: F.struct(x["at"].alias("at"), x["ident"].alias("ident"), acc["state"].alias("before"), after(acc["state"], x).alias("after"), (follow(acc["state"], x) < 0).alias("refused"))
    walk = F.aggregate("_events", F.struct(F.col("_begin").alias("state"), empty.alias("out")), lambda acc, x: F.struct(after(acc["state"], x).alias("state"), F.array_append(acc["out"], told(acc, x)).alias("out")))
    out = begun.select(*keys, F.explode(walk["out"]).alias("_o"))
    return out.select(*keys, F.col("_o.at").alias(at), F.col("_o.ident").alias(ident), machine.name(F.col("_o.before")).alias("before"), machine.name(F.col("_o.after")).alias("after"), F.col("_o.refused").alias("refused"))


#: A run of a source: queued and started once, kept alive by heartbeats, and ended well or badly. Ended runs can be queued again.
RUN = Machine(
    ("idle", "queued", "running", "success", "failed"),
    {
        "queue": {"idle": "queued", "success": "queued", "failed": "queued"},
        "start": {"queued": "running"},
        "heartbeat": {"running": "running"},
        "finish": {"running": "success"},
        "fail": {"queued": "failed", "running": "failed"},
    },
)
