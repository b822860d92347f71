"""Queries over routes: aggregates, windows, folds, notes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeloom.functions.geo import band
from shapeloom.operators import folds
from shapeloom.operators.network import base_safety
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import GREEN, SAFETY, sql, view

STEPS = "with s as (" + sql("steps") + ")"
#: Safety in whole hundredths, so that sums do not depend on the order of addition.
_SAFE = "case hw " + " ".join(f"when '{c}' then {round(v * 100)}" for c, v in SAFETY.items()) + " else 50 end"
_GREEN = "hw in (" + ", ".join(f"'{c}'" for c in GREEN) + ")"
def along():
    """A route's steps in order."""
    return Window.partitionBy("route").orderBy("i")



def steps(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "steps")


def green(hw: Column) -> Column:
    return hw.isin(*GREEN)


def _band_sql(v: str, good: str, bad: str) -> str:
    return f"greatest(0e0, least(1e0, ({bad} - ({v})) / ({bad} - {good})))"


def aggregates(s: DataFrame) -> DataFrame:
    """Per route: length, weighted safety, greenway share, dark metres, repeated metres (a node seen before)."""
    again = F.row_number().over(Window.partitionBy("route", "node").orderBy("i")) > 1
    length = F.col("length")
    return s.withColumn("again", again).groupBy("route").agg(
        F.sum(length).alias("length_m"),
        (F.sum(F.round(base_safety(F.col("hw")) * 100) * length) / (100.0 * F.sum(length))).alias("safety_raw"),
        (F.sum(F.when(green(F.col("hw")), length).otherwise(0.0)) / F.sum(length)).alias("greenway"),
        F.sum(F.when(F.col("lit") == "no", length).otherwise(0.0)).alias("dark_m"),
        (F.sum(F.when(F.col("again"), length).otherwise(0.0)) / F.sum(length)).alias("retrace"),
    )


_AGG = (
    STEPS + ", t as (select *, row_number() over (partition by route, node order by i) > 1 as again from s), g as (select route, sum(length) as length_m, sum(" + _SAFE + " * length) / (100e0 * sum(length)) as safety_raw,"
    " sum(case when " + _GREEN + " then length else 0 end) / sum(length) as greenway, sum(case when lit = 'no' then length else 0 end) as dark_m,"
    " sum(case when again then length else 0 end) / sum(length) as retrace from t group by route)"
)
#: Lengths are whole metres, so all sums are exact; what is compared is cut to whole millionths.
_MILLI = lambda x: f"cast(floor(({x}) * 1e6 + 5e-1) as bigint)"


def milli(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


@query(_AGG + f" select route, length_m, {_MILLI('safety_raw')} as safety_micro, {_MILLI('greenway')} as greenway_micro, dark_m, {_MILLI('retrace')} as retrace_micro,"
       f" {_MILLI('45e-2 * safety_raw + 2e-1 * least(1e0, greenway / 35e-2) + 15e-2 * ' + _band_sql('retrace', '5e-2', '4e-1'))} as score_micro,"
       f" rank() over (order by {_MILLI('45e-2 * safety_raw + 2e-1 * least(1e0, greenway / 35e-2) + 15e-2 * ' + _band_sql('retrace', '5e-2', '4e-1'))} desc, route) as place from g order by place limit 100")
def m0_route_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The hundred routes with the best weighted safety score."""
    g = aggregates(steps(spark, d))
    score = milli(0.45 * F.col("safety_raw") + 0.2 * F.least(F.lit(1.0), F.col("greenway") / 0.35) + 0.15 * band(F.col("retrace"), 0.05, 0.4))
    top = g.withColumn("score_micro", score).orderBy(F.desc("score_micro"), "route").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("score_micro"), "route")).cast("long")
    return top.select("route", "length_m", milli(F.col("safety_raw")).alias("safety_micro"), milli(F.col("greenway")).alias("greenway_micro"), "dark_m", milli(F.col("retrace")).alias("retrace_micro"), "score_micro", place.alias("place"))


@query(_AGG + f" select route, length_m, dark_m, {_MILLI('safety_raw')} as safety, {_MILLI('greenway')} as greenway, {_MILLI('retrace')} as retrace from g")
def a2_a3_a4_a5_a6_route_sums(spark, d):
    """A2 length, A3 weighted safety, A4 greenway share, A5 W11 retrace, A6 dark metres of every route."""
    g = aggregates(steps(spark, d))
    return g.select("route", "length_m", "dark_m", milli(F.col("safety_raw")).alias("safety"), milli(F.col("greenway")).alias("greenway"), milli(F.col("retrace")).alias("retrace"))


@query(STEPS + " select route, i, node, next from (select route, i, node, lead(node) over (partition by route order by i) as next from s) x where next is not null")
def w1_consecutive_pairs(spark, d):
    """Node pairs of consecutive steps."""
    return steps(spark, d).withColumn("next", F.lead("node").over(along())).where("next is not null").select("route", "i", "node", "next")


@query(STEPS + " select route, i, coalesce(sum(length) over (partition by route order by i rows between unbounded preceding and 1 preceding), 0) as before_m from s")
def w2_cumulative_mileage(spark, d):
    """Metres before each step."""
    return steps(spark, d).select("route", "i", F.coalesce(F.sum("length").over(along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before_m"))


@query(STEPS + " select route, i, name from (select *, lag(name) over (partition by route order by i) as p from s) x where p is null or p <> name")
def w3_consecutive_duplicates(spark, d):
    """Steps whose road differs from the one before."""
    return steps(spark, d).withColumn("p", F.lag("name").over(along())).where("p is null or p <> name").select("route", "i", "name")


@query(
    "with recursive " + STEPS[5:] + ", f as (select route, 0 as i, [node % 3] as st from s where i = 0"
    " union all select f.route, f.i + 1, case when len(st) >= 2 and st[len(st) - 1] = s.node % 3 then st[1:len(st) - 1] else list_append(st, s.node % 3) end from f join s on s.route = f.route and s.i = f.i + 1),"
    " z as (select route, max(i) as i from f group by route) select f.route, cast(array_to_string(st, '-') as varchar) as nodes from f join z using (route, i)"
)
def w4_backtrack_collapse(spark, d):
    """Spurs A-B-A removed from each route's nodes, taken modulo 3 so that there are spurs."""
    rows = folds.ordered(steps(spark, d).withColumn("n", F.col("node") % 3), "route", ["i"], ["n"])
    nodes = folds.collapse_backtracks(F.transform("xs", lambda x: x["n"]))
    return rows.select("route", F.array_join(nodes.cast("array<string>"), "-").alias("nodes"))


@query(
    "with recursive " + STEPS[5:] + ", z as (select route, max(i) as last from s group by route),"
    " f as (select route, i, name as cur, cast(0 as double) as start_m, length as acc, cast(null as varchar) as out_road, cast(null as double) as out_start, cast(null as double) as out_len from s where i = 0"
    " union all select f.route, s.i, s.name, case when s.name <> cur and acc - start_m >= 45 then acc else start_m end, acc + s.length,"
    " case when s.name <> cur and acc - start_m >= 45 then cur end, case when s.name <> cur and acc - start_m >= 45 then start_m end, case when s.name <> cur and acc - start_m >= 45 then acc - start_m end"
    " from f join s on s.route = f.route and s.i = f.i + 1)"
    " select route, out_start as start_m, out_road as road, out_len as length_m from f where out_road is not null"
    " union all select f.route, start_m, cur, acc - start_m from f join z on z.route = f.route and z.last = f.i"
)
def w5_cue_sheet(spark, d):
    """Segments of every route's cue sheet."""
    rows = folds.ordered(steps(spark, d), "route", ["i"], ["name", "length"])
    return rows.select("route", F.inline(folds.cue_rows(F.col("xs"))))


@query(
    STEPS + ", m as (select *, coalesce(sum(length) over (partition by route order by i rows between unbounded preceding and 1 preceding), 0) as before_m, row_number() over (partition by route order by i) - row_number() over (partition by route, lit order by i) as isle from s)"
    " select route, min(before_m) as from_m, sum(length) as dark_m from m where lit = 'no' group by route, isle having sum(length) >= 120"
)
def w7_unlit_runs(spark, d):
    """Unlit runs of 120 metres and more."""
    before = F.coalesce(F.sum("length").over(along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    isle = F.row_number().over(along()) - F.row_number().over(Window.partitionBy("route", "lit").orderBy("i"))
    runs = steps(spark, d).withColumn("before_m", before).withColumn("isle", isle).where("lit = 'no'")
    return runs.groupBy("route", "isle").agg(F.min("before_m").alias("from_m"), F.sum("length").alias("dark_m")).where("dark_m >= 120").drop("isle")


_NOTES = (
    STEPS + ", m as (select *, coalesce(sum(length) over (partition by route order by i rows between unbounded preceding and 1 preceding), 0) as before_m from s),"
    " notes as (select route, before_m / 1000 as km, 0 as src, i, 'dark' as type from m where lit = 'no' union all select route, before_m / 1000, 1, i, 'main' from m where hw in ('primary', 'secondary') and length >= 200)"
)


def notes(s: DataFrame) -> DataFrame:
    before = F.coalesce(F.sum("length").over(along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    m = s.withColumn("km", before / 1000)
    dark = m.where("lit = 'no'").select("route", "km", F.lit(0).alias("src"), "i", F.lit("dark").alias("type"))
    main = m.where("hw in ('primary', 'secondary') and length >= 200").select("route", "km", F.lit(1).alias("src"), "i", F.lit("main").alias("type"))
    return dark.unionByName(main)


@query(_NOTES + " select route, km, src, i, type, row_number() over (partition by route order by km, src, i) as place from notes")
def p11_u2_t1_notes(spark, d):
    """Notes of two sources, in order along the route."""
    line = Window.partitionBy("route").orderBy("km", "src", "i")
    return notes(steps(spark, d)).withColumn("place", F.row_number().over(line).cast("long"))


@query(
    "with recursive " + _NOTES[5:] + ", r as (select *, row_number() over (partition by route order by km, src, i) as k from notes),"
    " f as (select route, k, km, src, type, km as last_km, type as last_type, true as kept from r where k = 1"
    " union all select r.route, r.k, r.km, r.src, r.type, case when r.type = last_type and abs(last_km - r.km) < 35e-2 then last_km else r.km end,"
    " case when r.type = last_type and abs(last_km - r.km) < 35e-2 then last_type else r.type end, not (r.type = last_type and abs(last_km - r.km) < 35e-2) from f join r on r.route = f.route and r.k = f.k + 1)"
    " select route, km, type from f where kept"
)
def w8_note_thinning(spark, d):
    """Of notes of one kind that follow each other closely the first is kept."""
    rows = folds.ordered(notes(steps(spark, d)), "route", ["km", "src", "i"], ["type"])
    return rows.select("route", F.explode(folds.thin_notes(F.col("xs"))).alias("n")).select("route", "n.km", "n.type")


@query(
    "with recursive e as (select user_id as track, value as v, row_number() over (partition by user_id order by ts, event_id) as k from events),"
    " f as (select track, k, v as ref, cast(0 as double) as gain from e where k = 1 union all select e.track, e.k, case when e.v < ref or e.v - ref >= 5 then e.v else ref end,"
    " case when e.v >= ref and e.v - ref >= 5 then gain + (e.v - ref) else gain end from f join e on e.track = f.track and e.k = f.k + 1),"
    " z as (select track, max(k) as k from f group by track) select track, cast(floor(gain * 1e3 + 5e-1) as bigint) as climb_mm from f join z using (track, k)"
)
def w9_climb(spark, d):
    """Ascent of every track, with hysteresis."""
    rows = folds.ordered(view(spark, d, "track"), "track", ["ts", "event_id"], ["elevation"])
    return rows.select("track", F.floor(folds.climb(F.transform("xs", lambda x: x["elevation"])) * 1e3 + 0.5).cast("long").alias("climb_mm"))


@query(
    STEPS + ", c as (select route, i, length, count(*) over (partition by route) as n from s), j as (select c.route, c.i, c.n, unnest(range(-3, 4)) as k from c)"
    " select j.route, j.i, sum(s.length) / 7 as mean_m from j join s on s.route = j.route and s.i = ((j.i + j.k) % j.n + j.n) % j.n group by j.route, j.i"
)
def w10_ring_mean(spark, d):
    """Mean of seven neighbours around a closed ring."""
    rows = folds.ordered(steps(spark, d), "route", ["i"], ["length"])
    n = F.size("xs")
    mean = F.transform("xs", lambda x: F.struct(x["i"].alias("i"), (F.aggregate(F.sequence(F.lit(-3), F.lit(3)), F.lit(0.0), lambda a, k: a + F.get(F.col("xs"), F.pmod(x["i"] + k, n).cast("int"))["length"]) / 7).alias("mean_m")))
    return rows.select("route", F.inline(mean))


@query(
    STEPS + ", p as (select route, sum(length) as total, list_sort(list_concat([cast(0 as double), sum(length)], list(length * i) filter (lit = 'no' and length * i <= 300))) as xs from s group by route)"
    " select route, list_max(list_transform(range(1, len(xs)), lambda k: xs[k + 1] - xs[k])) as gap_m from p"
)
def a10_w13_largest_gap(spark, d):
    """The largest gap between positions, with the route's start and end."""
    s = steps(spark, d)
    marks = s.where("lit = 'no' and length * i <= 300").select("route", (F.col("length") * F.col("i")).alias("x"))
    ends = s.groupBy("route").agg(F.sum("length").alias("x"))
    line = Window.partitionBy("route").orderBy("x")
    rows = marks.unionByName(ends).unionByName(ends.select("route", F.lit(0.0).alias("x")))
    return rows.withColumn("g", F.col("x") - F.lag("x").over(line)).groupBy("route").agg(F.max("g").alias("gap_m"))


@query(STEPS + ", g as (select route, avg(length) as mean_m, max(length) as max_m, count(*) as n, list_sort(list(length)) as xs from s group by route) select route, mean_m, max_m, xs[cast(floor(n * 9e-1) as bigint) + 1] as p90_m, n >= 4 and mean_m <= 260 and max_m <= 416 as accepted from g")
def a11_a12_p9_snap_quality(spark, d):
    """Mean, maximum and the ninth decile by index, and whether a snapped route is accepted."""
    g = steps(spark, d).groupBy("route").agg(F.avg("length").alias("mean_m"), F.max("length").alias("max_m"), F.count("*").alias("n"), F.sort_array(F.collect_list("length")).alias("xs"))
    return g.select("route", "mean_m", "max_m", F.get("xs", F.floor(F.col("n") * 0.9).cast("int")).alias("p90_m"), ((F.col("n") >= 4) & (F.col("mean_m") <= 260) & (F.col("max_m") <= 416)).alias("accepted"))


@query(_AGG + f", b as (select *, length_m / 250 as km from g) select route, km between 3 and 6 as fits, {_MILLI('46e-2 * (1 - retrace) + 16e-2 * safety_raw + 8e-2 * (1 - least(1e0, 25e-1 * retrace)) + 12e-2 + 1e-1 + 8e-2 * greenway')} as q from b")
def g7_p10_quick_score(spark, d):
    """The quick score of a candidate and whether its length lies in the band."""
    g, c = aggregates(steps(spark, d)), F.col
    q = 0.46 * (1 - c("retrace")) + 0.16 * c("safety_raw") + 0.08 * (1 - F.least(F.lit(1.0), 2.5 * c("retrace"))) + 0.12 + 0.1 + 0.08 * c("greenway")
    return g.select("route", (c("length_m") / 250).between(3, 6).alias("fits"), milli(q).alias("q"))


@query(STEPS + " select hw, count(*) as n, sum(length) as metres, count_if(" + _GREEN + ") as green from s where hw not in ('steps', 'track') group by hw")
def p3_p7_classes(spark, d):
    """Class exclusion and greenway classes."""
    s = steps(spark, d).where("hw not in ('steps', 'track')")
    return s.groupBy("hw").agg(F.count("*").alias("n"), F.sum("length").alias("metres"), F.count_if(green(F.col("hw"))).alias("green"))


@query(STEPS + " select route, count(*) as n, count_if(length > 450) as over from s group by route")
def a21_overflow_count(spark, d):
    """Edges beyond a length cap."""
    return steps(spark, d).groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("length") > 450).alias("over"))


@query(STEPS + " select route, i, length, place from (select route, i, length, row_number() over (partition by route order by length desc, i) as place from s) x where place <= 3")
def t2_top_marks(spark, d):
    """The three longest steps of each route."""
    top = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("length"), "i"))
    return steps(spark, d).withColumn("place", top.cast("long")).where("place <= 3").select("route", "i", "length", "place")


@query(STEPS + " select route, arg_max(i, (length, -i)) as best from s group by route")
def t6_arg_max(spark, d):
    """The best candidate, the first of equal ones."""
    return steps(spark, d).groupBy("route").agg(F.max_by("i", F.struct("length", -F.col("i"))).alias("best"))
