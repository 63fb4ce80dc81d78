"""Named queries of the sensor path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.config import Limits
from leeward.functions.numeric import epoch_s, quantize
from leeward.operators import alerts as board
from leeward.operators import late, neighbours, quality, rules
from leeward.operators.health import device_health as health_of
from leeward.plans import model_band, monitoring  # noqa: F401 (model_band enters v_band)
from leeward.plans.catalog import q6, query
from leeward.session import staged
from leeward.sources.fixtures import ORIGIN_S, Tables, with_views

LIMITS = Limits()


def event() -> F.Column:
    return epoch_s(F.col("event_time"))


def sent() -> F.Column:
    return epoch_s(F.col("sent_at"))


def flag(condition) -> F.Column:
    return condition.cast("bigint")


def clean(t: Tables) -> DataFrame:
    return monitoring.clean_readings(t.readings(), LIMITS)


def refreshed(t: Tables) -> DataFrame:
    return monitoring.refresh_quality(t.readings(), t.device_pos(), t.band(), ORIGIN_S, LIMITS)


def outcomes(t: Tables) -> DataFrame:
    """Good and bad readings of every device: by their quality, and those that a hard rule refused."""
    key = ["device_id", "event_time", "sent_at", "ingestion_path"]
    judged = refreshed(t).select(*key, F.col("quality_status").isin("frozen", "drift_suspect").alias("bad"))
    refused = monitoring.split_readings(t.readings(), LIMITS).refused.select(*key, F.lit(True).alias("bad"))
    return staged(judged.unionByName(refused), "outcomes")


# ---- SQL steps shared by the independent side ----
ROUTED = """select r.*, cast(epoch_us(event_time) // 1000000 as bigint) as event_s,
    cast(epoch_us(sent_at) // 1000000 as bigint) as sent_s,
    (epoch_us(sent_at) - epoch_us(event_time)) / 60000000.0 as lag_minutes,
    case when sent_at is null or event_time is null then 'bad_timestamp'
         when (epoch_us(sent_at) - epoch_us(event_time)) / 60000000.0 > 15 then 'late' else 'on_time' end as route,
    concat_ws(',', case when not coalesce(wind_speed_ms between 0 and 45, false) then 'wind_physical' end,
      case when dose_rate_usv_h is not null and not dose_rate_usv_h between 0 and 1000 then 'dose_in_detector_range' end,
      case when not coalesce(not (battery > 0 and dose_rate_usv_h is null), false) then 'no_null_when_powered' end,
      case when not coalesce(dose_rate_usv_h is not null or battery > 0, false) then 'measure_present' end) as reasons
    from v_readings r"""
ONCE = """select * from (select *, row_number() over (partition by device_id, event_time
    order by sent_at, ingestion_path) as rn from routed where route = 'on_time') where rn = 1"""
STEPS = {"routed": ROUTED, "once": ONCE, "cleaned": "select * from once where reasons = ''"}
HISTORY = STEPS | {
    "banded": """select c.*, b.median, b.p05, b.p95, cast(floor((event_s - 1300060800) / 3600) as bigint) as hour_no,
        event_s // 60 as minute
        from cleaned c left join v_band b on b.cell_id = c.cell_id
         and b.hour_no = cast(floor((event_s - 1300060800) / 3600) as bigint)""",
    "residuals": """select *, case when dose_rate_usv_h > 0 then ln(dose_rate_usv_h / (0.05 + median)) end as residual,
        dose_rate_usv_h = lag(dose_rate_usv_h) over (partition by device_id order by event_s, ingestion_path) as same
        from banded""",
    "marked": """select *, avg(residual) over (partition by device_id order by event_s
            range between 1800 preceding and current row) as residual_30m,
        sum(case when coalesce(same, false) then 0 else 1 end)
            over (partition by device_id order by event_s, ingestion_path) as run_no,
        event_s - min(event_s) over (partition by device_id) < 600 as is_warmup from residuals""",
    "numbered": """select *, row_number() over (partition by device_id, run_no order by event_s, ingestion_path) as run_len
        from marked""",
    "per_minute": """select device_id, minute, arg_max(residual_30m, event_s) as r from numbered
        where residual_30m is not null group by device_id, minute""",
    "pairs": """select a.device_id, b.device_id as other from v_device_pos a, v_device_pos b
        where a.device_id <> b.device_id and 2 * 6371.0 * asin(sqrt(least(1.0,
          pow(sin(radians(b.lat - a.lat) / 2), 2)
          + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 5""",
    "around": """select p.device_id, m.minute, median(m.r) as neighbour_median, count(*) as n_neighbours
        from pairs p join per_minute m on m.device_id = p.other group by p.device_id, m.minute""",
    "judged": """select n.*, a.neighbour_median, case when is_warmup then 'warmup' when run_len >= 10 then 'frozen'
        when residual_30m > 0.2 and not coalesce(a.neighbour_median > 0.2, false) then 'drift_suspect'
        else 'clean' end as quality_status,
        coalesce(residual_30m > 0.2, false) and coalesce(a.neighbour_median > 0.2, false) as plume_signal
        from numbered n left join around a on a.device_id = n.device_id and a.minute = n.minute""",
}
VIEWS = "v_readings v_device_pos"


def _sql(body: str, steps: dict[str, str] = STEPS, views: str = VIEWS) -> str:
    return with_views(views, body, steps)


@query(_sql(f"select event_id, device_id, ingestion_path, event_s, sent_s, {q6('lag_minutes')} as lag_minutes, route from routed"))
def late_split(t: Tables) -> DataFrame:
    on_time, behind = late.split_late(t.readings(), LIMITS.max_lag_minutes)
    untimed = late.without_time(t.readings())
    parts = [part.withColumn("route", F.lit(name)) for name, part in (("on_time", on_time), ("late", behind), ("bad_timestamp", untimed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("event_id", "device_id", "ingestion_path", event().alias("event_s"), sent().alias("sent_s"),
                       quantize(F.col("lag_minutes")).alias("lag_minutes"), "route")


@query(_sql(f"""select ingestion_path, device_id, count(*) as n_sent, count(*) filter (route = 'late') as n_late,
    {q6("avg(case when route = 'late' then cast(1 as double) else cast(0 as double) end)")} as late_share,
    {q6("max(lag_minutes)")} as max_lag from routed group by 1, 2"""))
def late_metrics(t: Tables) -> DataFrame:
    routed = late.with_route(t.readings(), LIMITS.max_lag_minutes)
    is_late = F.col("route") == "late"
    return routed.groupBy("ingestion_path", "device_id").agg(
        F.count(F.lit(1)).alias("n_sent"), F.count_if(is_late).alias("n_late"),
        quantize(F.avg(is_late.cast("double"))).alias("late_share"), quantize(F.max("lag_minutes")).alias("max_lag"))


@query(_sql("""select event_id, device_id, ingestion_path, event_s, reasons,
    cast(reasons = '' as bigint) as passed from routed where route = 'on_time'"""))
def hard_rules(t: Tables) -> DataFrame:
    routed = monitoring.route_readings(t.readings(), LIMITS).filter("route = 'on_time'")
    return routed.select("event_id", "device_id", "ingestion_path", event().alias("event_s"),
                         F.concat_ws(",", "reasons").alias("reasons"), flag(F.size("reasons") == 0).alias("passed"))


@query(_sql("""select u.reason, count(*) as n_readings, count(distinct o.device_id) as n_devices
    from once o, unnest(string_split(o.reasons, ',')) as u(reason) where o.reasons <> '' group by 1"""))
def quarantine_reasons(t: Tables) -> DataFrame:
    refused = monitoring.split_readings(t.readings(), LIMITS).refused
    return (refused.select("device_id", F.explode("reasons").alias("reason")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n_readings"), F.count_distinct("device_id").alias("n_devices")))


@query(_sql("""select device_id, count(*) as n_readings,
    count(*) filter (coalesce(battery <= 0, false)) as sends_without_power,
    count(*) filter (coalesce(battery > 0 and dose_rate_usv_h = 0, false)) as zero_when_powered
    from cleaned group by 1"""))
def record_consistency(t: Tables) -> DataFrame:
    checked = rules.apply_rules(clean(t), rules.record_checks(), "checks")
    has = lambda name: F.count_if(F.array_contains("checks", name)).alias(name)
    return checked.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_readings"),
                                            has("sends_without_power"), has("zero_when_powered"))


@query(_sql("""select device_id, event_s, sent_s, ingestion_path, event_id,
    floor(coalesce(dose_rate_usv_h, -1) * 10000 + 0.5) / 10000 as dose from once"""))
def dedup_exact(t: Tables) -> DataFrame:
    on_time, _ = late.split_late(t.readings(), LIMITS.max_lag_minutes)
    once = late.dedup_exact(on_time)
    return once.select("device_id", event().alias("event_s"), sent().alias("sent_s"), "ingestion_path", "event_id",
                       quantize(F.coalesce("dose_rate_usv_h", F.lit(-1.0)), 4).alias("dose"))


@query(_sql("""select device_id, min(event_s) as group_s, count(*) as copies,
    arg_min(ingestion_path, rank) as ingestion_path, arg_min(event_id, rank) as event_id from grouped
    group by device_id, group_no""", STEPS | {
        "stepped": """select *, event_s - lag(event_s) over (partition by device_id
            order by event_s, ingestion_path, lag_minutes) as gap from once""",
        "grouped": """select *, sum(case when gap <= 5 then 0 else 1 end) over (partition by device_id
            order by event_s, ingestion_path, lag_minutes) as group_no,
            row_number() over (partition by device_id order by lag_minutes, ingestion_path, event_id) as rank from stepped"""}))
def dedup_paths(t: Tables) -> DataFrame:
    on_time, _ = late.split_late(t.readings(), LIMITS.max_lag_minutes)
    kept = late.dedup_paths(staged(late.dedup_exact(on_time), "once"), LIMITS.path_tolerance_s)
    return kept.select("device_id", "group_s", "copies", "ingestion_path", "event_id")


@query(_sql(f"""select device_id, event_s, ingestion_path, {q6("abs(wind_speed_ms - prev)")} as step,
    cast(coalesce(abs(wind_speed_ms - prev) > 25, false) as bigint) as step_exceeded from (
    select *, lag(wind_speed_ms) over (partition by device_id order by event_s, ingestion_path) as prev from once)"""))
def max_delta(t: Tables) -> DataFrame:
    on_time, _ = late.split_late(t.readings(), LIMITS.max_lag_minutes)
    out = quality.max_delta(late.dedup_exact(on_time), "wind_speed_ms", LIMITS.wind_max_step)
    return out.select("device_id", event().alias("event_s"), "ingestion_path", quantize(F.col("step")).alias("step"),
                      flag(F.col("step_exceeded")).alias("step_exceeded"))


@query(_sql("""select device_id, event_s, ingestion_path, cast(coalesce(same, false) as bigint) as same_as_prev
    from residuals""", HISTORY))
def same_as_prev(t: Tables) -> DataFrame:
    out = quality.same_as_prev(clean(t), LIMITS)
    return out.select("device_id", event().alias("event_s"), "ingestion_path", flag(F.col("same_as_prev")).alias("same_as_prev"))


@query(_sql("""select device_id, min(event_s) as start_s, max(event_s) as end_s, count(*) as n_readings,
    max(dose_rate_usv_h) as dose_rate_usv_h from numbered group by device_id, run_no having count(*) >= 10""", HISTORY))
def frozen_runs(t: Tables) -> DataFrame:
    return quality.frozen_runs(clean(t), LIMITS)


@query(_sql("""select device_id, min(event_s) as first_s, count(*) filter (is_warmup) as n_warmup,
    count(*) as n_readings from marked group by 1""", HISTORY))
def warmup(t: Tables) -> DataFrame:
    out = quality.warmup(clean(t), LIMITS.warmup_minutes)
    return out.groupBy("device_id").agg(F.min("first_s").alias("first_s"), F.count_if("is_warmup").alias("n_warmup"),
                                        F.count(F.lit(1)).alias("n_readings"))


@query(_sql("""select device_id, sent_s, event_id, ingestion_path, event_s, prev_event_s,
    cast(coalesce(event_s < prev_event_s, false) as bigint) as is_disordered from (
    select *, case when route <> 'bad_timestamp' then lag(event_s) over (partition by device_id, route = 'bad_timestamp'
      order by sent_s, event_id, ingestion_path) end as prev_event_s from routed)"""))
def clock_disorder(t: Tables) -> DataFrame:
    out = late.clock_disorder(t.readings())
    return out.select("device_id", sent().alias("sent_s"), "event_id", "ingestion_path", event().alias("event_s"),
                      "prev_event_s", flag(F.col("is_disordered")).alias("is_disordered"))


# devices in cells 5 and 6 send km/h from minute 60 on, as after a firmware update
KMH = "case when cell_id in (5, 6) and {s} >= 1300060800 + 3600 then wind_speed_ms * 3.6 else wind_speed_ms end"


@query(_sql(f"""select device_id, block, n, {q6("level")} as level, {q6("level / prev")} as ratio,
    cast(coalesce(level / prev between 2.5 and 5, false) as bigint) as unit_suspect from (
    select *, lag(level) over (partition by device_id order by block) as prev from (
    select device_id, event_s // 1800 as block, median({KMH.format(s="event_s")}) as level, count(*) as n
    from cleaned group by 1, 2))"""))
def unit_shift(t: Tables) -> DataFrame:
    drifting = clean(t).withColumn("wind_speed_ms", F.expr(KMH.format(s="unix_seconds(event_time)")))
    out = quality.unit_shift(drifting, "wind_speed_ms", 30, LIMITS)
    return out.select("device_id", "block", "n", quantize(F.col("level")).alias("level"),
                      quantize(F.col("ratio")).alias("ratio"), flag(F.col("unit_suspect")).alias("unit_suspect"))


@query(_sql(f"""select device_id, event_s, ingestion_path, {q6("residual")} as residual,
    {q6("residual_30m")} as residual_30m from marked""", HISTORY))
def residual_30m(t: Tables) -> DataFrame:
    out = quality.residual_mean(quality.with_residual(
        quality.with_model_band(clean(t), t.band(), ORIGIN_S), LIMITS.background_usv_h), LIMITS)
    return out.select("device_id", event().alias("event_s"), "ingestion_path",
                      quantize(F.col("residual")).alias("residual"), quantize(F.col("residual_30m")).alias("residual_30m"))


@query(_sql(f"""select m.device_id, m.minute, coalesce(a.n_neighbours, 0) as n_neighbours,
    {q6("a.neighbour_median")} as neighbour_median
    from per_minute m left join around a on a.device_id = m.device_id and a.minute = m.minute""", HISTORY))
def neighbour_median(t: Tables) -> DataFrame:
    df = quality.residual_mean(quality.with_residual(
        quality.with_model_band(clean(t), t.band(), ORIGIN_S), LIMITS.background_usv_h), LIMITS)
    values = staged(neighbours.per_minute(df, "residual_30m"), "minute-values")
    out = neighbours.neighbour_median(values, *neighbours.neighbourhood(t.device_pos(), LIMITS.neighbour_km))
    return out.select("device_id", "minute", "n_neighbours", quantize(F.col("neighbour_median")).alias("neighbour_median"))


@query(_sql(f"""select device_id, event_s, ingestion_path, {q6("residual_30m")} as residual_30m, run_len,
    quality_status, cast(plume_signal as bigint) as plume_signal from judged""", HISTORY))
def quality_status(t: Tables) -> DataFrame:
    return refreshed(t).select(
        "device_id", event().alias("event_s"), "ingestion_path", quantize(F.col("residual_30m")).alias("residual_30m"),
        "run_len", "quality_status", flag(F.col("plume_signal")).alias("plume_signal"))


@query(_sql("""select device_id, event_s, ingestion_path, case when quality_status = 'drift_suspect'
    and row_number() over (partition by device_id, stretch order by event_s, ingestion_path) < 3
    then 'clean' else quality_status end as quality_status_stable from stretched""", HISTORY | {
        "turned": """select *, case when quality_status = lag(quality_status) over (partition by device_id
            order by event_s, ingestion_path) then 0 else 1 end as turn from judged""",
        "stretched": "select *, sum(turn) over (partition by device_id order by event_s, ingestion_path) as stretch from turned"}))
def quality_status_stable(t: Tables) -> DataFrame:
    out = quality.quality_status_stable(staged(refreshed(t), "quality"), LIMITS)
    return out.select("device_id", event().alias("event_s"), "ingestion_path", "quality_status_stable")


@query(_sql(f"""select device_id, minute, {q6("v")} as value, n_neighbours, {q6("mean")} as neighbour_mean,
    cast(coalesce(abs(v - mean) > 3 * sd, false) as bigint) as is_outlier from (
      select m.device_id, m.minute, m.v, coalesce(w.n, 0) as n_neighbours, w.s / w.n as mean,
        case when w.n > 1 then sqrt(greatest(0, (w.ss - w.s * (w.s / w.n)) / (w.n - 1))) end as sd from winds m left join (
        select p.device_id, m2.minute, count(*) as n, sum(m2.v) as s, sum(m2.v * m2.v) as ss
        from pairs p join winds m2 on m2.device_id = p.other group by 1, 2) w
      on w.device_id = m.device_id and w.minute = m.minute)""", STEPS | {
        "pairs": HISTORY["pairs"],
        "winds": """select device_id, event_s // 60 as minute, arg_max(wind_speed_ms, event_s) as v from once
            where wind_speed_ms is not null group by 1, 2"""}))
def cross_sensor_outlier(t: Tables) -> DataFrame:
    on_time, _ = late.split_late(t.readings(), LIMITS.max_lag_minutes)
    winds = staged(neighbours.per_minute(late.dedup_exact(on_time), "wind_speed_ms"), "minute-winds")
    out = neighbours.neighbour_outlier(winds, *neighbours.neighbourhood(t.device_pos(), LIMITS.neighbour_km),
                                       LIMITS.outlier_sigmas)
    return out.select("device_id", "minute", quantize(F.col("value")).alias("value"), "n_neighbours",
                      quantize(F.col("neighbour_mean")).alias("neighbour_mean"), flag(F.col("is_outlier")).alias("is_outlier"))


ALERTED = HISTORY | {
    "shares": """select event_s // 3600 * 3600 as window_s, count(*) as n_readings,
        count(*) filter (quality_status = 'clean') as n_clean from judged group by 1""",
    "alerts": """select *, case when quality_status = 'clean' and coalesce(not dose_rate_usv_h between p05 and p95, false)
        then 'outside_model_band' when quality_status = 'drift_suspect' then 'sensor_fault' end as alert_type from judged"""}


@query(_sql(f"""select a.device_id, a.event_s, a.ingestion_path, a.cell_id, a.alert_type,
    {q6("a.dose_rate_usv_h")} as dose, {q6("a.p95")} as p95, {q6("cast(s.n_clean as double) / s.n_readings")} as clean_share
    from alerts a join shares s on s.window_s = a.event_s // 3600 * 3600 where alert_type is not null""", ALERTED))
def live_alerts(t: Tables) -> DataFrame:
    found = monitoring.live_alerts(staged(refreshed(t), "quality"))
    return found.select("device_id", event().alias("event_s"), "ingestion_path", "cell_id", "alert_type",
                        quantize(F.col("dose_rate_usv_h")).alias("dose"), quantize(F.col("p95")).alias("p95"),
                        quantize(F.col("clean_share")).alias("clean_share"))


@query(_sql("""select alert_type, cell_id, count(*) as n_alerts, count(distinct device_id) as n_devices from (
    select alert_type, cell_id, device_id from alerts where alert_type is not null
    union all select 'sensor_fault', cell_id, device_id from once where reasons <> '') group by 1, 2""", ALERTED))
def active_alerts(t: Tables) -> DataFrame:
    parts = monitoring.split_readings(t.readings(), LIMITS)
    faults = board.fault_alerts(parts.refused).select("alert_type", "cell_id", "device_id")
    found = board.alerts(refreshed(t)).select("alert_type", "cell_id", "device_id")
    return board.active_alerts(found.unionByName(faults), ["cell_id"])


@query(_sql(f"""select window_s, n_readings, n_clean, {q6("cast(n_clean as double) / n_readings")} as clean_share
    from shares""", ALERTED))
def clean_share(t: Tables) -> DataFrame:
    out = board.clean_share(refreshed(t), 60)
    return out.withColumn("clean_share", quantize(F.col("clean_share")))


@query(_sql("""select device_id, quality_status, count(*) as n_readings, count(*) filter (alert_type is not null) as n_alerts
    from alerts group by 1, 2""", ALERTED))
def status_by_device(t: Tables) -> DataFrame:
    judged = refreshed(t)
    outside = F.coalesce(~F.col("dose_rate_usv_h").between(F.col("p05"), F.col("p95")), F.lit(False))
    alert = ((F.col("quality_status") == "clean") & outside) | (F.col("quality_status") == "drift_suspect")
    return judged.groupBy("device_id", "quality_status").agg(
        F.count(F.lit(1)).alias("n_readings"), F.count_if(alert).alias("n_alerts"))


@query(_sql(f"""select ingestion_path, count(*) as n_sent, count(*) filter (route = 'late') as n_late,
    count(*) filter (route = 'on_time' and reasons <> '') as n_refused,
    {q6("cast(count(*) filter (route = 'late') as double) / count(*)")} as late_share,
    {q6("cast(count(*) filter (route = 'on_time' and reasons <> '') as double) / count(*)")} as refused_share,
    count(distinct case when route = 'on_time' and reasons <> '' then device_id end) as devices_refused
    from routed group by 1"""))
def dq_metrics(t: Tables) -> DataFrame:
    out = board.dq_metrics(monitoring.route_readings(t.readings(), LIMITS), ["ingestion_path"])
    return out.withColumn("late_share", quantize(F.col("late_share"))).withColumn(
        "refused_share", quantize(F.col("refused_share")))


HEALTH = HISTORY | {
    "outcomes": """select device_id, event_s, ingestion_path, false as bad from judged where quality_status in ('clean', 'warmup')
        union all select device_id, event_s, ingestion_path, true from judged where quality_status in ('frozen', 'drift_suspect')
        union all select device_id, event_s, ingestion_path, true from once where reasons <> ''""",
    "turns": """select *, case when bad = lag(bad) over (partition by device_id order by event_s, ingestion_path)
        then 0 else 1 end as turn from outcomes""",
    "series": "select *, sum(turn) over (partition by device_id order by event_s, ingestion_path) as series_no from turns",
    "counted": """select *, row_number() over (partition by device_id, series_no order by event_s, ingestion_path) as n
        from series""",
    "asked": """select device_id, event_s as at_s, ingestion_path, case when bad then 'quarantined' else 'healthy' end as state
        from counted where (bad and n = 3) or (not bad and n = 5)""",
    "changes": """select * from (select *, lag(state, 1, 'healthy') over (partition by device_id
        order by at_s, ingestion_path) as before from asked) where state <> before"""}


@query(_sql("""select d.device_id, d.n_readings, d.n_bad, coalesce(l.state, 'healthy') as state, l.since_s,
    coalesce(l.n_quarantined, 0) as n_quarantined from
    (select device_id, count(*) as n_readings, count(*) filter (bad) as n_bad from outcomes group by 1) d left join
    (select device_id, arg_max(state, at_s) as state, max(at_s) as since_s,
       count(*) filter (state = 'quarantined') as n_quarantined from changes group by 1) l on l.device_id = d.device_id""",
    HEALTH))
def device_health(t: Tables) -> DataFrame:
    return health_of(outcomes(t), LIMITS)


@query(_sql(f"""select g.device_id, g.minute, {q6("sum(n.v) / count(n.v)")} as dose, count(n.v) as n_neighbours
    from (select device_id, unnest(range(prev + 1, minute)) as minute from (
        select device_id, minute, lag(minute) over (partition by device_id order by event_s, ingestion_path) as prev
        from (select *, event_s // 60 as minute from cleaned)) where minute - prev > 1) g
    left join pairs p on p.device_id = g.device_id
    left join (select device_id, event_s // 60 as minute, arg_max(dose_rate_usv_h, event_s) as v from cleaned
        where dose_rate_usv_h is not null group by 1, 2) n on n.device_id = p.other and n.minute = g.minute
    group by 1, 2""", STEPS | {"pairs": HISTORY["pairs"]}))
def gap_impute(t: Tables) -> DataFrame:
    out = quality.impute_gaps(clean(t), t.device_pos(), gap_minutes=1.0, limits=LIMITS)
    return out.select("device_id", "minute", quantize(F.col("dose_rate_usv_h")).alias("dose"), "n_neighbours")


@query(_sql(f"""select cell_id, count(*) as n_readings,
    {q6("avg(case when dose_rate_usv_h between p05 and p95 then cast(1 as double) else cast(0 as double) end)")} as in_band
    from banded where dose_rate_usv_h is not null and p05 is not null group by 1""", HISTORY))
def band_share(t: Tables) -> DataFrame:
    banded = quality.with_model_band(clean(t), t.band(), ORIGIN_S)
    out = board.band_share(banded, ["cell_id"])
    return out.withColumn("in_band", quantize(F.col("in_band")))


@query(_sql("""select ingestion_path, count(distinct device_id) as n_devices, count(distinct cell_id) as n_cells,
    count(*) as n_readings from v_readings group by 1""", {}))
def device_counts(t: Tables) -> DataFrame:
    return board.device_counts(t.readings(), ["ingestion_path"])


@query(with_views("v_band", f"select cell_id, hour_no, {q6('median')} as expected_dose from v_band"))
def expected_export(t: Tables) -> DataFrame:
    out = board.expected_dose(t.band())
    return out.withColumn("expected_dose", quantize(F.col("expected_dose")))
