"""Dates, relative periods, time zones and cycles."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.registry import query

#: Sixty positions count from this day.
CYCLE_ANCHOR = "2000-01-07"


def relative_period(expression: str, reference: str, weekend_ahead: bool = False) -> Column:
    """First and last day of a period named relative to a date; null for an unknown name.

    Weeks begin on Monday. A weekend is the Saturday and Sunday of the date's week;
    with ``weekend_ahead`` days that are over are left out: on a Sunday only that day.
    """
    e, d = F.col(expression), F.col(reference).cast("date")
    week = F.date_trunc("week", d).cast("date")
    month = F.trunc(d, "month")
    year = F.trunc(d, "year")
    saturday = F.date_add(week, 5)
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    return (
        F.when(e == "today", pair(d, d)).when(e == "tomorrow", pair(F.date_add(d, 1), F.date_add(d, 1)))
        .when(e == "this_week", pair(F.greatest(week, d) if weekend_ahead else week, F.date_add(week, 6))).when(e == "next_week", pair(F.date_add(week, 7), F.date_add(week, 13)))
        .when(e == "weekend", pair(F.greatest(saturday, d) if weekend_ahead else saturday, F.date_add(week, 6)))
        .when(e == "this_month", pair(F.greatest(month, d) if weekend_ahead else month, F.last_day(d))).when(e == "next_month", pair(F.add_months(month, 1), F.last_day(F.add_months(month, 1))))
        .when(e == "this_year", pair(F.greatest(year, d) if weekend_ahead else year, F.date_add(F.add_months(year, 12), -1)))
    )


def scope_reason(first: str, last: str, reference: str, released: str, most_days: int = 31) -> Column:
    """Why a period isn't allowed, or ``ok``: it must be ordered, begin late enough, and be short."""
    a, b = F.col(first), F.col(last)
    least = F.greatest(F.col(reference).cast("date"), F.lit(released).cast("date"))
    return F.when(a.isNull() | b.isNull(), "missing").when(a > b, "reversed").when(a < least, "too_early").when(F.datediff(b, a) + 1 > most_days, "too_long").otherwise("ok")


def zone_transitions(df: DataFrame, zone: str, first_year: int, last_year: int) -> DataFrame:
    """(at, before, after): instants where a zone's offset from UTC changes, in seconds; at most a few for each year."""
    from datetime import timedelta

    own, rows = ZoneInfo(zone), []
    at, stop = datetime(first_year, 1, 1, tzinfo=timezone.utc), datetime(last_year + 1, 1, 1, tzinfo=timezone.utc)
    offset = lambda x: int(x.astimezone(own).utcoffset().total_seconds())
    while at < stop:
        after = at + timedelta(days=1)
        if offset(at) != offset(after):
            low, high = at, after
            while high - low > timedelta(seconds=1):
                middle = low + (high - low) / 2
                low, high = (middle, high) if offset(middle) == offset(low) else (low, middle)
            rows.append((int(high.timestamp()), offset(low), offset(high)))
        at = after
    return df.sparkSession.createDataFrame(rows, "at long, before int, after int")


def resolve_local(df: DataFrame, local: str, zone: str, first_year: int = 1950, last_year: int = 2050) -> DataFrame:
    """Each local time's instants in UTC: unique, ambiguous with two, or nonexistent with none.

    The few offset changes of the zone are joined: a local time within a change's hours
    has its status from it, and any other the offset of the latest change before it.
    """
    changes = zone_transitions(df, zone, first_year, last_year)
    order = Window.orderBy("at")
    spans = changes.select("at", "before", "after", F.coalesce(F.lead("at").over(order), F.lit(1 << 40)).alias("until"))
    first = changes.orderBy("at").limit(1).select(F.lit(-(1 << 40)).alias("at"), F.col("before").alias("before"), F.col("before").alias("after"), F.col("at").alias("until"))
    spans = spans.union(first)  # a few hundred rows
    wall = F.unix_seconds(F.col(local).cast("timestamp"))
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_wall", wall)
    near = rows.join(F.broadcast(spans), (F.col("_wall") - F.col("after") >= F.col("at")) & (F.col("_wall") - F.col("after") < F.col("until")), "left")
    keys = [c for c in df.columns]
    found = near.groupBy(*keys, "_id", "_wall").agg(F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.col("_wall") - F.col("after")))).alias("instants"))
    status = F.when(F.size("instants") == 0, "nonexistent").when(F.size("instants") == 1, "unique").otherwise("ambiguous")
    return found.select(*keys, status.alias("status"), F.transform("instants", lambda s: F.timestamp_seconds(s)).alias("instants"))


def date_range(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("day"))


def nearest_minute(c: Column) -> Column:
    """Halves of a minute go up."""
    return F.date_trunc("minute", c + F.expr("INTERVAL 30 SECONDS")).cast("timestamp_ntz")


def day_cycle(day: Column, size: int = 60) -> Column:
    """A day's position in a cycle that is 0 on the anchor day."""
    return F.pmod(F.datediff(day, F.lit(CYCLE_ANCHOR).cast("date")), F.lit(size))


def year_cycle(year: Column) -> tuple[Column, Column]:
    """Positions of a year among ten and among twelve; both are 0 in the year 4."""
    return F.pmod(year - 4, F.lit(10)), F.pmod(year - 4, F.lit(12))


def month_cycle(year: Column, month: Column) -> tuple[Column, Column]:
    """Positions of a month, numbered from 1, among ten and among twelve."""
    return F.pmod(F.pmod(year - 4, F.lit(10)) * 2 + 1 + month, F.lit(10)), F.pmod(month + 1, F.lit(12))


def hour_cycle(day_ten: Column, hour: Column, minute: Column) -> tuple[Column, Column]:
    """Two-hour bins that begin an hour before midnight, and their position among ten."""
    bin_ = F.floor(F.pmod(hour * 60 + minute + 60, F.lit(1440)) / 120)
    return F.pmod(F.pmod(day_ten, F.lit(5)) * 2 + bin_, F.lit(10)), bin_


def element_relation(own: Column, other: Column) -> Column:
    """How two of ten positions stand in the cycle of five elements, and whether their parity is equal."""
    step = F.pmod(F.floor(other / 2) - F.floor(own / 2), F.lit(5))
    kind = F.element_at(F.array(*map(F.lit, ("same", "output", "wealth", "authority", "resource"))), (step + 1).cast("int"))
    return F.concat_ws("_", kind, F.when(F.pmod(own, F.lit(2)) == F.pmod(other, F.lit(2)), "even").otherwise("odd"))


def stage(own_start: Column, position: Column, forward: Column) -> Column:
    """Steps from a start to a position among twelve, forward or backward."""
    return F.when(forward, F.pmod(position - own_start, F.lit(12))).otherwise(F.pmod(own_start - position, F.lit(12)))


def clock_hint(hour: Column, hint: Column) -> Column:
    """An hour of twelve with a word for the time of day, as minutes of the day."""
    h = F.pmod(hour, F.lit(12))
    return F.when(hint.isin("pm", "afternoon", "evening"), h * 60 + 720).when(hint.isin("am", "morning"), h * 60).when((hint == "night") & (h >= 6), h * 60 + 720).when(hint == "night", h * 60)


_WEEK = "date_trunc('week', d)::DATE"


@query("dat_01_relative_period", f"""
SELECT o_orderkey, e, CASE e WHEN 'today' THEN d WHEN 'next_week' THEN {_WEEK} + 7 WHEN 'weekend' THEN {_WEEK} + 5 ELSE date_trunc('month', d)::DATE END AS first,
    CASE e WHEN 'today' THEN d WHEN 'next_week' THEN {_WEEK} + 13 WHEN 'weekend' THEN {_WEEK} + 6 ELSE last_day(d) END AS last
FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (['today', 'next_week', 'weekend', 'this_month'])[(o_orderkey % 4)::INT + 1] AS e FROM orders)""")
def _(t):
    names = F.array(*map(F.lit, ("today", "next_week", "weekend", "this_month")))
    rows = t.orders.select("o_orderkey", "o_orderdate", F.get(names, F.col("o_orderkey") % 4).alias("e")).withColumn("p", relative_period("e", "o_orderdate"))
    return rows.select("o_orderkey", "e", "p.first", "p.last")


@query("dat_02_forward_period", f"""
SELECT o_orderkey, e, greatest(CASE e WHEN 'this_week' THEN {_WEEK} WHEN 'weekend' THEN {_WEEK} + 5 ELSE date_trunc('year', d)::DATE END, d) AS first,
    CASE e WHEN 'this_year' THEN make_date(year(d), 12, 31) ELSE {_WEEK} + 6 END AS last
FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (['this_week', 'weekend', 'this_year'])[(o_orderkey % 3)::INT + 1] AS e FROM orders)""")
def _(t):
    names = F.array(*map(F.lit, ("this_week", "weekend", "this_year")))
    rows = t.orders.select("o_orderkey", "o_orderdate", F.get(names, F.col("o_orderkey") % 3).alias("e")).withColumn("p", relative_period("e", "o_orderdate", True))
    return rows.select("o_orderkey", "e", "p.first", "p.last")


@query("dat_03_scope", """
SELECT l_orderkey, l_linenumber, CASE WHEN a > b THEN 'reversed' WHEN a < greatest(d, DATE '1995-01-01') THEN 'too_early' WHEN b - a + 1 > 31 THEN 'too_long' ELSE 'ok' END AS reason
FROM (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS d, l_shipdate::DATE AS a, (o_orderdate + INTERVAL 60 DAY)::DATE AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", "l_linenumber", "o_orderdate", F.col("l_shipdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", scope_reason("a", "b", "o_orderdate", "1995-01-01").alias("reason"))


@query("dat_04_local_times")
def _(t):
    local = (F.date_trunc("day", F.col("o_orderdate")) + F.expr("make_interval(0, 0, 0, 0, 2, 30)")).cast("timestamp_ntz")
    return resolve_local(t.orders.select("o_orderkey", local.alias("local")), "local", "America/New_York", 1990, 2030)


@query("dat_05_date_range", "SELECT unnest(generate_series(DATE '2024-02-20', DATE '2024-03-10', INTERVAL 1 DAY))::DATE AS day")
def _(t):
    return date_range(t.spark, "2024-02-20", "2024-03-10")


@query("dat_06_nearest_minute", "SELECT event_id, date_trunc('minute', ts + INTERVAL 30 SECOND) AS minute FROM events")
def _(t):
    return t.events.select("event_id", nearest_minute(F.col("ts")).alias("minute"))


@query("dat_07_day_cycle", "SELECT o_orderkey, ((((o_orderdate::DATE - DATE '2000-01-07') % 60) + 60) % 60)::INT AS position FROM orders")
def _(t):
    return t.orders.select("o_orderkey", day_cycle(F.col("o_orderdate").cast("date")).alias("position"))


@query("dat_08_year_cycle", "SELECT o_orderkey, ((year(o_orderdate) - 4) % 10)::INT AS ten, ((year(o_orderdate) - 4) % 12)::INT AS twelve FROM orders")
def _(t):
    ten, twelve = year_cycle(F.year("o_orderdate"))
    return t.orders.select("o_orderkey", ten.alias("ten"), twelve.alias("twelve"))


@query("dat_09_month_cycle", "SELECT o_orderkey, ((((year(o_orderdate) - 4) % 10) * 2 + 1 + month(o_orderdate)) % 10)::INT AS ten, ((month(o_orderdate) + 1) % 12)::INT AS twelve FROM orders")
def _(t):
    ten, twelve = month_cycle(F.year("o_orderdate"), F.month("o_orderdate"))
    return t.orders.select("o_orderkey", ten.alias("ten"), twelve.alias("twelve"))


@query("dat_10_hour_cycle", "SELECT event_id, ((user_id % 5) * 2 + ((hour(ts) * 60 + minute(ts) + 60) % 1440) // 120) % 10 AS ten, ((hour(ts) * 60 + minute(ts) + 60) % 1440) // 120 AS bin FROM events")
def _(t):
    ten, bin_ = hour_cycle(F.col("user_id"), F.hour("ts"), F.minute("ts"))
    return t.events.select("event_id", ten.alias("ten"), bin_.alias("bin"))


_REL = "(['same', 'output', 'wealth', 'authority', 'resource'])[(((b // 2 - a // 2) % 5 + 5) % 5)::INT + 1] || CASE WHEN a % 2 = b % 2 THEN '_even' ELSE '_odd' END"


@query("dat_11_relation", f"SELECT a, b, {_REL} AS relation FROM (SELECT x AS a, y AS b FROM generate_series(0, 9) f(x), generate_series(0, 9) g(y))")
def _(t):
    grid = t.spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"))
    return grid.select("a", "b", element_relation(F.col("a"), F.col("b")).alias("relation"))


@query("dat_12_day_facts", "SELECT o_orderkey, ((year(o_orderdate) - 4) % 12)::INT AS y, ((month(o_orderdate) + 1) % 12)::INT AS m, ((((o_orderdate::DATE - DATE '2000-01-07') % 12) + 12) % 12)::INT AS d FROM orders")
def _(t):
    day = F.col("o_orderdate")
    facts = F.struct(year_cycle(F.year(day))[1].alias("y"), month_cycle(F.year(day), F.month(day))[1].alias("m"), day_cycle(day.cast("date"), 12).alias("d"))
    return t.orders.select("o_orderkey", facts.alias("f")).select("o_orderkey", "f.*")


@query("dat_16_clock_hint", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN (hour(ts) % 12) * 60 + 720 WHEN event_type = 'error' THEN (hour(ts) % 12) * 60 + CASE WHEN hour(ts) % 12 >= 6 THEN 720 ELSE 0 END ELSE (hour(ts) % 12) * 60 END::INT AS minutes FROM events")
def _(t):
    hint = F.when(F.col("event_type").isin("click", "view"), "pm").when(F.col("event_type") == "error", "night").otherwise("am")
    return t.events.select("event_id", clock_hint(F.hour("ts"), hint).alias("minutes"))


def birth_reasons(day: Column, calendar: Column, leap: Column, minute: Column) -> Column:
    """What is wrong with an input of day, calendar, leap month and minute, in this order."""
    from corpusloom.operators.quality import reasons

    return reasons({
        "missing_day": day.isNull(), "unknown_calendar": ~F.coalesce(calendar.isin("solar", "lunar"), F.lit(False)), "leap_of_solar": (calendar == "solar") & leap, "minute_range": ~minute.between(0, 1439),
    })


@query("dat_17_input_reasons", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'unknown_calendar' END, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'leap_of_solar' END, CASE WHEN value * 20 > 1439 THEN 'minute_range' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events")
def _(t):
    calendar = F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "click", "solar").otherwise("lunar")
    return t.events.select("event_id", F.array_join(birth_reasons(F.col("ts").cast("date"), calendar, F.col("user_id") % 2 == 0, F.col("value") * 20), ",").alias("reasons"))


@query("dat_18_daily_labels", "SELECT day::DATE AS day, ((((day::DATE - DATE '2000-01-07') % 60) + 60) % 60)::INT AS position FROM (SELECT unnest(generate_series(DATE '1999-12-20', DATE '2000-04-01', INTERVAL 1 DAY)) AS day)")
def _(t):
    return date_range(t.spark, "1999-12-20", "2000-04-01").select("day", day_cycle(F.col("day")).alias("position"))


def candidate_facts(df: DataFrame, key: str, start: str, end: str, minutes: int, fact) -> DataFrame:
    """Of every instant of a grid over an uncertain time the fact; equal ones are one row with first, last and number."""
    grid = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {minutes} MINUTES"))).alias("at")
    rows = df.select(key, grid).withColumn("fact", fact(F.col("at")))
    return rows.groupBy(key, "fact").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


@query("dat_19_candidate_facts", """
WITH g AS (SELECT event_id, unnest(generate_series(ts, ts + INTERVAL 4 HOUR, INTERVAL 10 MINUTE)) AS x FROM events)
SELECT event_id, ((hour(x) * 60 + minute(x) + 60) % 1440) // 120 AS fact, min(x) AS first, max(x) AS last, count(*) AS n FROM g GROUP BY 1, 2""")
def _(t):
    rows = t.events.select("event_id", "ts", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("end"))
    return candidate_facts(rows, "event_id", "ts", "end", 10, lambda at: hour_cycle(F.lit(0), F.hour(at), F.minute(at))[1])


@query("dat_20_stages", "SELECT a, b, CASE WHEN a % 2 = 0 THEN (b - a + 12) % 12 ELSE (a - b + 12) % 12 END AS stage FROM (SELECT x AS a, y AS b FROM generate_series(0, 11) f(x), generate_series(0, 11) g(y))")
def _(t):
    grid = t.spark.range(144).select((F.col("id") % 12).alias("a"), F.floor(F.col("id") / 12).alias("b"))
    return grid.select("a", "b", stage(F.col("a"), F.col("b"), F.col("a") % 2 == 0).alias("stage"))


@query("dat_21_strength", "SELECT o_orderkey, s::INT AS score, CASE WHEN s >= 5 THEN 'strong' WHEN s <= 2 THEN 'weak' ELSE 'even' END AS class FROM (SELECT o_orderkey, (month(o_orderdate) % 3 = 0)::INT * 3 + (year(o_orderdate) % 2)::INT * 2 + (day(o_orderdate) % 5 = 0)::INT AS s FROM orders)")
def _(t):
    score = F.when(F.month("o_orderdate") % 3 == 0, 3).otherwise(0) + F.year("o_orderdate") % 2 * 2 + F.when(F.dayofmonth("o_orderdate") % 5 == 0, 1).otherwise(0)
    return t.orders.select("o_orderkey", score.alias("score")).withColumn("class", F.when(F.col("score") >= 5, "strong").when(F.col("score") <= 2, "weak").otherwise("even"))


@query("dat_22_day_relations", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN (m - d) % 12 IN (6, -6) THEN 'opposed' WHEN m = d THEN 'same' END AS kind FROM (SELECT (month(o_orderdate) + 1) % 12 AS m, (((o_orderdate::DATE - DATE '2000-01-07') % 12) + 12) % 12 AS d FROM orders)) WHERE kind IS NOT NULL GROUP BY kind")
def _(t):
    day = F.col("o_orderdate")
    gap = F.pmod(month_cycle(F.year(day), F.month(day))[1] - day_cycle(day.cast("date"), 12), F.lit(12))
    return t.orders.select(F.when(gap == 6, "opposed").when(gap == 0, "same").alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("dat_23_question_scope", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE < DATE '1995-06-01' THEN 'before' WHEN o_orderdate::DATE > DATE '1997-06-01' THEN 'after' ELSE 'inside' END AS scope FROM orders")
def _(t):
    from corpusloom.functions.text import iso_dates

    asked = F.get(iso_dates(F.date_format("o_orderdate", "'what of 'yyyy-MM-dd")), F.lit(0)).cast("date")
    scope = F.when(asked < F.lit("1995-06-01").cast("date"), "before").when(asked > F.lit("1997-06-01").cast("date"), "after").otherwise("inside")
    return t.orders.select("o_orderkey", scope.alias("scope"))


@query("dat_24_noon_facts", "SELECT o_orderkey, CAST(o_orderdate::DATE AS TIMESTAMP) + INTERVAL 12 HOUR AS noon, (b.ts IS NOT NULL) AS has_mark FROM orders o ASOF LEFT JOIN (SELECT DISTINCT l_shipdate::DATE + INTERVAL 6 HOUR AS ts FROM lineitem) b ON CAST(o.o_orderdate::DATE AS TIMESTAMP) + INTERVAL 12 HOUR >= b.ts")
def _(t):
    from corpusloom.operators.joins import as_of_bucketed

    noon = (F.date_trunc("day", F.col("o_orderdate")) + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz")
    marks = t.lineitem.select((F.date_trunc("day", F.col("l_shipdate")) + F.expr("INTERVAL 6 HOURS")).cast("timestamp_ntz").alias("at")).distinct()
    found = as_of_bucketed(t.orders.select("o_orderkey", noon.alias("noon")), marks, "noon", "at")
    return found.select("o_orderkey", "noon", F.col("at").isNotNull().alias("has_mark"))
