"""Queries over time series: events are facts with entity user_id and metric event_type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact as E
from ..operators import timeseries as T
from ..plans.compile import run_plan
from ..plans.model import QueryPlan, TimeRange
from .registry import load, query

START, END = "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"


def facts(spark, d):
    e = load(spark, d, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("row"))


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def rounded(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


@query("""SELECT event_type AS metric, count(value) AS n, round(sum(value::DECIMAL(38,12))::DOUBLE, 6) AS sum_value, min(value) AS min_value, arg_min(ts, (value, ts)) AS min_at,
    max(value) AS max_value, arg_max(ts, (value, -epoch_us(ts))) AS max_at, round(sum(value::DECIMAL(38,12))::DOUBLE / count(value), 6) AS average_value FROM events GROUP BY event_type""")
def ts_agg(spark, d):
    return rounded(ntz(T.totals(facts(spark, d), ["metric"]), "min_at", "max_at"), "sum_value", "average_value")


@query("""SELECT user_id AS entity, event_type AS metric, count(*) AS n, round(sum(value::DECIMAL(38,12))::DOUBLE, 6) AS sum_value, min(value) AS min_value, max(value) AS max_value,
    arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, count(*) - count(DISTINCT ts) AS duplicates FROM events GROUP BY ALL""")
def ts_full_series(spark, d):
    order = F.struct("ts", "row")
    x = facts(spark, d).groupBy(*T.KEY).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(38,12)")).cast("double"), 6).alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicates"),
    )
    return x


RESAMPLE = """SELECT user_id AS entity, event_type AS metric, date_trunc('{unit}', ts)::TIMESTAMP AS bucket, count(value) AS n, round(sum(value::DECIMAL(38,12))::DOUBLE, 6) AS sum_value,
    min(value) AS min_value, max(value) AS max_value, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL"""


@query(RESAMPLE.format(unit="hour"))
def ts_resample_hour(spark, d):
    return rounded(ntz(T.resampled(facts(spark, d), "hour"), "bucket"), "sum_value")


@query(RESAMPLE.format(unit="day"))
def ts_resample_day(spark, d):
    return rounded(ntz(T.resampled(facts(spark, d), "day"), "bucket"), "sum_value")


@query("""WITH o AS (SELECT user_id AS entity, event_type AS metric, ts, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    x AS (SELECT entity, metric, ((r - 1) // 20)::BIGINT AS part, count(value) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, min(value) AS min_value,
        max(value) AS max_value, round(avg(value), 6) AS mean_value, stddev_pop(value) AS s FROM o GROUP BY ALL)
    SELECT entity, metric, part, n, first_value, last_value, min_value, max_value, mean_value, last_value - first_value AS change, CASE WHEN n > 1 THEN
        CASE WHEN abs(last_value - first_value) / greatest(abs(first_value), abs(last_value), s, 1e-12) < 0.01 THEN 'stable' WHEN last_value > first_value THEN 'rising' ELSE 'falling' END END AS trend FROM x""")
def ts_window_summary(spark, d):
    return rounded(T.windows_of(facts(spark, d), 20), "mean_value")


@query("""WITH s AS (SELECT user_id AS entity, event_type AS metric, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS d, ts FROM events),
    o AS (SELECT entity, metric, CASE WHEN coalesce(bool_and(d >= 0), true) THEN 'ascending' WHEN bool_and(d <= 0) THEN 'descending' ELSE 'unsorted' END AS row_order, count(*) - count(DISTINCT ts) AS repeats FROM s GROUP BY ALL),
    t AS (SELECT DISTINCT user_id AS entity, event_type AS metric, ts FROM events), g AS (SELECT entity, metric, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity, metric ORDER BY ts)) / 1e6 AS d FROM t),
    m AS (SELECT entity, metric, quantile_cont(d, 0.5) AS md, max(d) AS mx, min(d) AS mn FROM g GROUP BY ALL)
    SELECT entity, metric, row_order, repeats, round(md, 6) AS median_seconds, coalesce(greatest(mx - md, md - mn) > greatest(1.0, 0.1 * abs(md)), false) AS irregular FROM o JOIN m USING (entity, metric)""")
def ts_sampling_profile(spark, d):
    return rounded(T.sampling(facts(spark, d)), "median_seconds")


@query("""WITH x AS (SELECT user_id AS entity, event_type AS metric, ts, value, event_id FROM events UNION ALL SELECT user_id, event_type, ts, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END, event_id + 1000000000 FROM events WHERE event_id % 10 < 4)
    SELECT entity, metric, ts, arg_min(value, event_id) AS value, count(*) AS copies, max(value) - min(value) > 0.5 AS conflict FROM x GROUP BY ALL""")
def dedup_samples(spark, d):
    f = facts(spark, d)
    again = f.where("row % 10 < 4").withColumns({"value": F.when(F.col("row") % 2 == 0, F.col("value")).otherwise(F.col("value") + 1), "row": F.col("row") + 1_000_000_000})
    return ntz(T.merged_samples(f.unionByName(again)), "ts")


INTERVALS = """WITH p AS (SELECT user_id AS entity, event_type AS metric, epoch_us(ts) AS t, CASE WHEN event_id % 17 <> 0 THEN value END AS v, event_id % 13 <> 0 AS s FROM events),
    q AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2, lead(s) OVER w AS s2 FROM p WINDOW w AS (PARTITION BY entity, metric ORDER BY t)),
    k AS (SELECT entity, metric, quantile_cont(t2 - t, 0.25) AS q25 FROM q GROUP BY ALL),
    i AS (SELECT q.*, q25, greatest(t, epoch_us(TIMESTAMP '2024-01-05')) AS b, least(t2, epoch_us(TIMESTAMP '2024-01-20')) AS f FROM q JOIN k USING (entity, metric) WHERE t2 IS NOT NULL),
    r AS (SELECT *, (f - b) / 1e6 AS sec, CASE WHEN NOT s OR NOT s2 THEN 'FILTERED_ENDPOINT' WHEN v IS NULL OR v2 IS NULL THEN 'NULL_OR_NON_NUMERIC_ENDPOINT'
        WHEN q25 > 0 AND t2 - t > 3 * q25 THEN 'GAP_GREATER_THAN_THREE_SOURCE_Q25_INTERVALS' END AS why FROM i WHERE f > b)"""


def _interval_facts(spark, d):
    f = facts(spark, d)
    return f.withColumns({"selected": F.col("row") % 13 != 0, "value": F.when(F.col("row") % 17 != 0, F.col("value"))})


@query(INTERVALS + """SELECT entity, metric, round(sum(CASE WHEN why IS NULL THEN (v + (v2 - v) * (b - t) / (t2 - t) + v + (v2 - v) * (f - t) / (t2 - t)) * sec / 2 END) / sum(CASE WHEN why IS NULL THEN sec END), 6) AS weighted_average,
    round(sum(CASE WHEN why IS NULL THEN sec END), 3) AS covered_seconds, round(sum(CASE WHEN why IS NULL THEN CASE WHEN v > 50 THEN sec ELSE 0 END END), 3) AS seconds_above, sum((why IS NULL)::INT)::BIGINT AS n_used,
    sum((why IS NOT NULL)::INT)::BIGINT AS n_excluded, CASE WHEN sum(CASE WHEN why IS NULL THEN sec END) IS NULL THEN 'NO_SUPPORTED_INTERVALS' ELSE 'OK' END AS status FROM r GROUP BY entity, metric""")
def time_weighted_average(spark, d):
    x = T.interval_statistics(_interval_facts(spark, d), START, END, 50.0)
    return rounded(rounded(x, "weighted_average"), "covered_seconds", "seconds_above", to=3)


@query(INTERVALS + """SELECT entity, metric, round(sum((v + (v2 - v) * (b - t) / (t2 - t) + v + (v2 - v) * (f - t) / (t2 - t)) * sec / 2) / sum(sec), 6) AS mean, (sum(f - b) // gcd(sum(f - b), 1000000))::BIGINT AS seconds_above_line FROM r WHERE why IS NULL GROUP BY entity, metric""")
def time_weighted_average_exact(spark, d):
    """The mean as a ratio of whole numbers, here as its double, and the numerator of the seconds that it covers."""
    x = E.exact_interval_mean(_interval_facts(spark, d), START, END)
    return x.select(*T.KEY, F.round(F.col("mean_value"), 6).alias("mean"), F.substring_index("seconds_ratio", "/", 1).cast("long").alias("seconds_above_line"))


@query("""WITH q AS (SELECT user_id AS entity, event_type AS metric, epoch_us(ts) AS t, value AS v, lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS t2 FROM events),
    k AS (SELECT entity, metric, quantile_cont(t2 - t, 0.25) AS q25 FROM q GROUP BY ALL),
    i AS (SELECT q.*, (least(t2, epoch_us(TIMESTAMP '2024-01-20')) - greatest(t, epoch_us(TIMESTAMP '2024-01-05'))) / 1e6 AS sec, NOT (q25 > 0 AND t2 - t > 3 * q25) AS used FROM q JOIN k USING (entity, metric) WHERE t2 IS NOT NULL)
    SELECT entity, metric, round(sum(CASE WHEN used THEN CASE WHEN v > 80 THEN sec ELSE 0 END END), 3) AS seconds_above FROM i WHERE sec > 0 AND metric = (SELECT min(event_type) FROM events) GROUP BY ALL""")
def duration_above(spark, d):
    f = facts(spark, d)
    metric = f.agg(F.min("metric")).first()[0]
    plan = QueryPlan(task_intent="time above 80", retrievers=["timeseries"], operation="duration_above", metric=metric, time_range=TimeRange(START, END), threshold_expression="80")
    return rounded(run_plan(plan, {"timeseries": f}).select("entity", "metric", "seconds_above"), "seconds_above", to=3)


@query(INTERVALS + "SELECT coalesce(why, 'USED') AS why, count(*) AS n, round(sum(sec), 3) AS seconds FROM r GROUP BY 1")
def excluded_intervals(spark, d):
    x = T.intervals(_interval_facts(spark, d), START, END)
    return x.groupBy(F.coalesce("why", F.lit("USED")).alias("why")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("f") - F.col("b")) / 1e6), 3).alias("seconds"))


@query("""SELECT user_id AS entity, event_type AS metric, round(a, 6) AS first_mean, round(b, 6) AS second_mean, round(b - a, 6) AS change FROM (SELECT user_id, event_type,
    avg(CASE WHEN ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' THEN value END) AS a, avg(CASE WHEN ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-20' THEN value END) AS b FROM events GROUP BY ALL)""")
def compare_periods(spark, d):
    x = T.compared_periods(facts(spark, d), (START, "2024-01-12T00:00:00Z"), ("2024-01-12T00:00:00Z", END))
    return rounded(x, "first_mean", "second_mean", "change")


@query("""WITH f AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, event_type)) / 1e6 AS x, coalesce(value >= lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), true) AS up FROM events)
    SELECT user_id AS entity, event_type AS metric, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS start_end, CASE WHEN count(*) = 1 THEN 0.0 ELSE round(coalesce(regr_slope(value, x), 0.0) * 1e6, 4) END AS slope, bool_and(up) AS monotonic FROM f GROUP BY ALL""")
def trends(spark, d):
    x = T.trends(facts(spark, d)).withColumn("slope", F.round(F.col("slope") * 1e6, 4))
    return rounded(x, "start_end")


@query("SELECT count(*) AS n_records, count(DISTINCT (user_id, event_type, ts)) AS n_samples FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def count_records_and_samples(spark, d):
    f = facts(spark, d).where(T.in_range(F.col("ts"), START, END))
    return f.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("entity", "metric", "ts").alias("n_samples"))


@query("""WITH f AS (SELECT user_id AS entity, event_type AS metric, ts, event_id, 0 AS copy FROM events UNION ALL SELECT user_id, event_type, ts, event_id, 1 FROM events WHERE event_id % 10 = 0),
    w AS (SELECT *, event_id % 17 > 0 AS has, entity % 23 = 5 AND event_id % 3 = 0 AS bad, CASE WHEN entity % 19 = 4 THEN 'W' ELSE 'kW' END AS unit, event_id % 70 = 0 AND event_id % 17 > 0 AND copy = 1 AS off FROM f WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'),
    i AS (SELECT entity, metric, ts, count(*) AS n, sum(has::INT) AS k, bool_or(bad) AS bad, bool_or(has AND unit <> 'kW') AS other, bool_or(off) AS off, min(CASE WHEN has THEN unit END) AS unit FROM w GROUP BY ALL),
    g AS (SELECT entity, metric, sum(n)::BIGINT AS n_records, sum((k > 0)::INT)::BIGINT AS samples, sum(n - k)::BIGINT AS n_excluded, sum(greatest(k - 1, 0))::BIGINT AS n_repeats, min(unit) AS unit, CASE WHEN bool_or(bad) THEN 'COUNT_METRIC_NOT_CALCULABLE' WHEN bool_or(other) THEN 'COUNT_MEASUREMENT_UNIT_MISMATCH' WHEN bool_or(off) THEN 'COUNT_DUPLICATE_SAMPLE_CONFLICT' ELSE 'COUNTED' END AS status FROM i GROUP BY ALL)
    SELECT entity, metric, n_records, CASE WHEN status = 'COUNTED' THEN samples END AS n_samples, n_excluded, n_repeats, unit, status FROM g""")
def guarded_sample_counts(spark, d):
    """Every tenth event comes twice, with other digits of the same number, now and then with another number; some series have
    cells that can't be calculated or another unit."""
    f = facts(spark, d).select("entity", "metric", "ts", "row", "value", F.explode(F.when(F.col("row") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    plain = F.col("value").cast("decimal(20,6)")
    number = F.when(F.col("copy") == 0, plain.cast("string")).when(F.col("row") % 70 == 0, (plain + 1).cast("string")).otherwise(F.concat(F.lit("+00"), (plain * 1000).cast("string"), F.lit("00e-3")))
    rows = f.select("entity", "metric", "ts", F.when(F.col("row") % 17 > 0, number).alias("number"), F.when(F.col("entity") % 19 == 4, "W").otherwise("kW").alias("unit"), (F.col("row") * 2 + F.col("copy")).alias("position"), (~((F.col("entity") % 23 == 5) & (F.col("row") % 3 == 0))).alias("eligible"))
    return E.guarded_counts(rows, START, END, "kW")


@query("SELECT user_id AS entity, min(ts) AS first_at, max(ts) AS last_at, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 6) AS minutes FROM events GROUP BY user_id")
def observed_extent(spark, d):
    x = facts(spark, d).groupBy("entity").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return ntz(x.withColumn("minutes", F.round((F.unix_micros("last_at") - F.unix_micros("first_at")) / 6e7, 6)), "first_at", "last_at")


@query("""SELECT user_id AS entity, event_type AS metric, count(*) AS samples, sum((event_id % 5 <> 0)::INT)::BIGINT AS eligible, sum((event_id % 5 = 0)::INT)::BIGINT AS uncalculable, min(ts) AS first_at, max(ts) AS last_at,
    CASE WHEN sum((event_id % 5 <> 0)::INT) = 0 THEN 'unavailable' WHEN sum((event_id % 5 = 0)::INT) = 0 THEN 'available' ELSE 'partial' END AS availability FROM events GROUP BY ALL""")
def series_catalog(spark, d):
    ok = F.col("row") % 5 != 0
    x = facts(spark, d).groupBy(*T.KEY).agg(F.count(F.lit(1)).alias("samples"), F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("uncalculable"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return ntz(x.withColumn("availability", F.when(F.col("eligible") == 0, "unavailable").when(F.col("uncalculable") == 0, "available").otherwise("partial")), "first_at", "last_at")


@query("""WITH c AS (SELECT user_id AS entity, event_type AS metric, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY ALL), w AS (SELECT *, least(128, greatest(8, len(v))) AS w FROM c),
    s AS (SELECT *, greatest(1, w // 2) AS stride, greatest(0, len(v) - w) AS last FROM w), u AS (SELECT DISTINCT entity, metric, v, w, unnest(list_append(range(0, last + 1, stride), last)) AS start FROM s)
    SELECT entity, metric, start::INT AS start, len(v[start + 1 : start + w])::INT AS n, round(list_sum(v[start + 1 : start + w]), 4) AS total FROM u""")
def sliding_segments(spark, d):
    total = F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4)
    return T.segments(facts(spark, d)).select(*T.KEY, "start", F.size("values").alias("n"), total.alias("total"))


@query()
def similar_curve(spark, d):
    plan = QueryPlan(task_intent="curves that rise and fall", retrievers=["timeseries"], operation="similar_shape", query_series=[float(min(i, 16 - i)) for i in range(17)], top_k=10)
    return run_plan(plan, {"timeseries": facts(spark, d)}).select("entity", "metric", "start", F.round("cosine", 6).alias("cosine"), F.round("distance", 6).alias("distance"))


@query("""SELECT event_type AS metric, CASE WHEN count(DISTINCT user_id) > 1 THEN 'TARGET_ENTITY_REQUIRED' END AS single, CASE WHEN count(DISTINCT event_id % 2) > 1 THEN 'NEEDS_UNIT_MAPPING' END AS many FROM events GROUP BY event_type""")
def ts_guards(spark, d):
    f = facts(spark, d).withColumns({"flag": F.lit(""), "unit": F.when(F.col("row") % 2 == 0, "m").otherwise("mm")})
    return f.groupBy("metric").agg(T.guarded(f, True).alias("single"), T.guarded(f, False).alias("many"))


@query("SELECT event_type AS metric, round(avg(value), 6) AS average_value, count(value) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND event_type = (SELECT max(event_type) FROM events) AND user_id = 3 GROUP BY event_type")
def ts_plan_average(spark, d):
    f = facts(spark, d)
    metric = f.agg(F.max("metric")).first()[0]
    plan = QueryPlan(task_intent="mean", retrievers=["timeseries"], operation="average", metric=metric, target_entity="3", time_range=TimeRange(START, END, closed=True))
    return run_plan(plan, {"timeseries": f}).where("n > 0").select(F.lit(metric).alias("metric"), F.round("average_value", 6).alias("average_value"), "n")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_group(spark, d):
    o = load(spark, d, "orders")
    newest = F.max_by("o_orderkey", F.struct(F.col("o_orderdate"), -F.col("o_orderkey")))
    return o.groupBy("o_custkey").agg(newest.alias("o_orderkey"))


@query("""WITH v AS (SELECT user_id AS entity, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY 1), m AS (SELECT entity, x, len(x) AS n, list_avg(x) AS m, coalesce(list_stddev_pop(x), 0) AS s FROM v),
    z AS (SELECT *, list_transform(x, lambda y: (y - m) / CASE WHEN s > 0 THEN s ELSE 1 END) AS z FROM m), d AS (SELECT *, list_transform(range(1, n), lambda i: abs(z[i + 1] - z[i])) AS d FROM z),
    f AS (SELECT entity, [list_aggregate(z, 'quantile_cont', 0.0), list_aggregate(z, 'quantile_cont', 0.1), list_aggregate(z, 'quantile_cont', 0.25), list_aggregate(z, 'quantile_cont', 0.5), list_aggregate(z, 'quantile_cont', 0.75), list_aggregate(z, 'quantile_cont', 0.9), list_aggregate(z, 'quantile_cont', 1.0),
        CASE WHEN n > 1 THEN (SELECT regr_slope(u.y, u.i) FROM (SELECT unnest(z) AS y, unnest(list_transform(range(n), lambda k: k / (n - 1))) AS i) u) ELSE 0 END, coalesce(list_avg(d), 0), coalesce(list_max(d), 0), ln(1 + n) / 10, s / (abs(m) + s + 1e-9)] AS f FROM d)
    SELECT entity, unnest(range(12))::INT AS place, unnest(list_transform(f, lambda y: round(y / sqrt(list_dot_product(f, f)), 6))) AS value FROM f""")
def shape12(spark, d):
    """The twelve numbers of each user's curve, by aggregates: no row holds a curve."""
    return T.shapes(facts(spark, d), "entity").select("entity", F.posexplode("shape").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("""WITH s AS (SELECT user_id AS entity, event_type AS metric, value AS v, lead(value) OVER w AS v2, nullif(greatest(lead(epoch_us(ts)) OVER w - epoch_us(ts), 0), 0) AS step FROM events
        WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
    k AS (SELECT *, quantile_cont(step, 0.25) OVER (PARTITION BY entity, metric) AS q25 FROM s), g AS (SELECT *, coalesce(step > 3 * q25, false) AS gap, CASE WHEN NOT step > 3 * q25 THEN step / 1e6 END AS sec FROM k)
    SELECT entity, metric, round(CASE WHEN count(*) = 1 THEN min(v) ELSE sum((v + v2) * sec / 2) / sum(sec) END, 6) AS weighted_average, round(coalesce(sum(CASE WHEN v > 50 THEN sec END), 0), 3) AS seconds_above,
    sum(gap::INT)::BIGINT AS gaps, CASE WHEN count(*) = 1 THEN 'TIME_WEIGHTING_UNDETERMINED' WHEN sum(gap::INT) > 0 THEN 'GAPS_EXCLUDED' ELSE '' END AS flags FROM g GROUP BY ALL""")
def legacy_interval_statistics(spark, d):
    """The older rule: samples of the window only, trapezoids between them, long gaps left out, window edges not looked at."""
    x = T.legacy_statistics(facts(spark, d), START, END, 50.0)
    return rounded(rounded(x, "weighted_average"), "seconds_above", to=3)


@query("""WITH f AS (SELECT DISTINCT ON (user_id, event_type, ts) user_id, event_type, ts, event_id FROM events ORDER BY user_id, event_type, ts, event_id), s AS (SELECT user_id AS entity, event_type AS metric, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
    w AS (SELECT entity, metric, n, least(128, greatest(8, n)) AS w FROM s GROUP BY ALL), u AS (SELECT DISTINCT entity, metric, n, w, unnest(list_append(range(0, greatest(0, n - w) + 1, greatest(1, w // 2)), greatest(0, n - w))) AS start FROM w)
    SELECT u.entity, u.metric, start::INT AS start, min(ts) AS first_at, max(ts) AS last_at FROM u JOIN s ON s.entity = u.entity AND s.metric = u.metric AND r > start AND r <= start + w GROUP BY ALL HAVING min(ts) >= TIMESTAMP '2024-01-05' AND max(ts) < TIMESTAMP '2024-01-20'""")
def segment_time_filter(spark, d):
    """Segments that lie inside a range as a whole."""
    return ntz(T.segments(facts(spark, d), times=True).where(T.in_range(F.col("first_at"), START, END) & T.in_range(F.col("last_at"), START, END)).select(*T.KEY, "start", "first_at", "last_at"), "first_at", "last_at")
