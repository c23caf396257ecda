"""Report pieces: bands, verdicts, ranking, season lock and the composite report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import change_pct
from ..operators import air
from ..thresholds import HeatLoss, HotWater
from .analyses import MIN_POWER_DAYS, MIN_WATER_DAYS, analyses, uniform

#: Upper ends of gauge bands; the last has none.
HLC_BANDS = [(100, "excellent"), (180, "good"), (280, "fair"), (400, "poor"), (None, "beyond")]
VENTILATION_BANDS = [(120, "low"), (200, "usual"), (300, "high"), (None, "beyond")]
ACH_BANDS = [(0.35, "tight"), (0.7, "usual"), (1.0, "leaky"), (None, "beyond")]


def band(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    out = F.lit(None).cast("string")
    for top, name in reversed(bands):
        out = F.lit(name) if top is None else F.when(value < top, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def first_rule(rules: list[tuple[str, Column]], other: str | None = "other") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(other).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def ranked(summary: DataFrame, by: list[str]) -> DataFrame:
    """Adds place among a home's rooms, by time constant, those without at the end,
    and slowest_place, the other way round and null without."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("tau_median_h"), "room"))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("tau_median_h"), "room"))
    return summary.withColumns({"place": up, "slowest_place": F.when(F.col("tau_median_h").isNotNull(), down)})


def fastest(summary: DataFrame, by: list[str], n: int = 2) -> DataFrame:
    """(by, fastest): the ``n`` rooms that cool fastest, with a time constant, in order."""
    known = summary.where("tau_median_h is not null")
    order = F.array_sort(F.collect_list(F.struct("tau_median_h", "room")))
    rooms = F.transform(F.slice(order, 1, n), lambda x: x["room"])
    return known.groupBy(*by).agg(F.array_join(rooms, ", ").alias("fastest"))


def decision(fabric: Column, ventilation: Column) -> Column:
    """What to look at first."""
    return (
        F.when(fabric.isNull() | ventilation.isNull(), "no split available")
        .when(fabric > 2 * ventilation, "fabric first")
        .otherwise("ventilation matters")
    )


#: Words of names that tell a category, and endings that aren't part of a room's name.
NAME_WORDS = {
    "loft": ("loft", "attic"),
    "outdoors": ("outdoor", "outside", "external", "garden", "balcony"),
    "heating": ("heating",),
    "gas": ("gas",),
}
TEMPERATURE_ENDINGS = ("_temperature", "_temp", "_thermometer")


def categorised(entities: DataFrame) -> DataFrame:
    """Adds category to entities (entity_id, friendly_name, device_class, unit);
    null for those of no use. The first rule that holds decides."""
    domain = F.substring_index("entity_id", ".", 1)
    name = F.lower(F.coalesce(F.nullif("friendly_name", F.lit("")), F.col("entity_id")))
    unit, kind = F.coalesce("unit", F.lit("")), F.coalesce("device_class", F.lit(""))
    hinted = lambda words: reduce(lambda a, w: a | name.contains(w) | F.col("entity_id").contains(w), words, F.lit(False))
    temperature = (kind == "temperature") | unit.isin("°C", "°F")
    rate = (kind == "monetary") & F.lower(unit).contains("kwh")
    sensor = first_rule(
        [
            ("loft_temperature", temperature & hinted(NAME_WORDS["loft"])),
            ("outdoor_temperature", temperature & hinted(NAME_WORDS["outdoors"])),
            ("indoor_temperature", temperature),
            ("heating_power", (unit == "%") & hinted(NAME_WORDS["heating"])),
            ("energy", kind.isin("energy", "gas") | unit.isin("kWh", "m³")),
            ("co2", kind == "carbon_dioxide"),
            ("gas_rate", rate & hinted(NAME_WORDS["gas"])),
        ],
        None,
    )
    return entities.withColumn("category", F.when(domain.isin("climate", "weather"), domain).when(domain == "sensor", sensor))


def drafted_rooms(found: DataFrame) -> DataFrame:
    """(room, temp_series, heat_series): a room for each indoor temperature, with
    the heating sensor of the same name; of equal names the last entity counts."""
    bare = lambda c, suffix: F.regexp_replace(F.regexp_replace(c, "^sensor\\.", ""), suffix, "")
    # endings go one after the other, as names may bear several
    name = reduce(lambda c, s: F.regexp_replace(c, f"{s}$", ""), TEMPERATURE_ENDINGS, F.regexp_replace("entity_id", "^sensor\\.", ""))
    rooms = found.where("category = 'indoor_temperature'").groupBy(name.alias("room")).agg(F.max("entity_id").alias("temp_series"))
    heats = found.where("category = 'heating_power'").groupBy(bare("entity_id", "_heating$").alias("room")).agg(F.max("entity_id").alias("heat_series"))
    return rooms.join(heats, "room", "left")


def drafted_roles(found: DataFrame) -> DataFrame:
    """(role, entity_id): the first entity of each role that a configuration has one of."""
    roles = {"energy": "gas_kwh_entity", "gas_rate": "gas_unit_rate_entity", "outdoor_temperature": "outdoor_entity", "loft_temperature": "loft_entity", "co2": "co2_entity", "weather": "weather_entity"}
    role = reduce(lambda c, r: c.when(F.col("category") == r[0], r[1]), roles.items(), F.when(F.lit(False), ""))
    return found.withColumn("role", role).where("role is not null").groupBy("role").agg(F.min("entity_id").alias("entity_id"))


def model_day(days: DataFrame, by: list[str], rule: HeatLoss = HeatLoss()) -> DataFrame:
    """(by, model_day): the last day that was heated."""
    heated = (F.col("delta_t") > rule.min_delta_t) & (F.col("q") > rule.min_energy) & (F.col("heat_pct").isNull() | (F.col("heat_pct") > 1))
    return days.where(heated).groupBy(*by).agg(F.max("d").alias("model_day"))


def season_locked(days: DataFrame, by: list[str], window_days: int, rule: HeatLoss = HeatLoss()) -> DataFrame:
    """Days up to the last heated one and at most ``window_days`` before it; all
    days of homes that were never heated."""
    rows = days.join(model_day(days, by, rule), by, "left")
    age = F.datediff("model_day", "d")
    return rows.where(F.col("model_day").isNull() | age.between(0, window_days))


def suggested_rooms(thermostats: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, area, temp_series, heat_series) of thermostats (entity_id,
    device_id, area): the first smoothed temperature of the same device, and the
    heating sensor of the same area if there is just one. ``entities``:
    entity_id, device_id, area."""
    smooth = entities.where(F.col("entity_id").endswith("_ema_temperature")).groupBy("device_id").agg(F.min("entity_id").alias("temp_series"))
    power = entities.where(F.col("entity_id").endswith("_heating_power")).groupBy("area")
    power = power.agg(F.min("entity_id").alias("h"), F.countDistinct("entity_id").alias("n"))
    met = thermostats.join(smooth, "device_id", "left").join(power, "area", "left")
    return met.select("entity_id", "area", "temp_series", F.when(F.col("n") == 1, F.col("h")).alias("heat_series"))


def invalid_rooms(rooms: DataFrame) -> DataFrame:
    """(room, problem) of names with an empty or repeated slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("room"), "[^a-z0-9]+", "_"), "^_|_$", "")
    n = F.count(F.lit(1)).over(Window.partitionBy("slug"))
    marked = rooms.withColumn("slug", slug).withColumn("problem", F.when(F.col("slug") == "", "empty").when(n > 1, "duplicate"))
    return marked.where("problem is not null").select("room", "problem")


def complete_days(days: DataFrame, by: list[str]) -> DataFrame:
    """Days before each home's last one, which isn't over, with that one as ``today``."""
    marked = days.withColumn("today", F.max("d").over(Window.partitionBy(*by)))
    return marked.where("d < today")


def _shown(condition: Column, value: Column | str, digits: int | None = None) -> Column:
    value = F.when(condition, F.col(value) if isinstance(value, str) else value)
    return value if digits is None else F.round(value, digits)


def hot_water_rows(found: DataFrame, by: list[str], gas_water: DataFrame | None = None) -> DataFrame:
    """One row a home of ``analyses``: baseline, rate, attribution counts, dates and
    costs; with ``gas_water`` (by, wh_per_litre, hot_pct, usable) also what a litre
    takes. Homes without a baseline tell why."""
    if gas_water is not None:
        met = gas_water.where("usable").select(*by, "wh_per_litre", "hot_pct")
        found = found.join(met, by, "left")
    else:
        found = found.withColumns({"wh_per_litre": F.lit(None).cast("double"), "hot_pct": F.lit(None).cast("double")})
    ok = F.col("r_valid")
    used = F.col("r_used")
    return found.select(
        *by,
        _shown(ok, "r_baseline", 2).alias("kwh_per_day"),
        F.when(ok, F.when(used >= 14, "valid").otherwise("provisional")).alias("status"),
        _shown(ok, "r_used").alias("days_used"),
        _shown(ok, "r_away").alias("low_water_days_excluded"),
        _shown(ok, "away_litres").alias("min_occupied_water_litres"),
        _shown(ok & (F.col("r_away") >= 3), "r_idle", 2).alias("idle_gas"),
        F.round("r_rate", 3).alias("water_rate"),
        _shown(F.col("r_rate").isNotNull(), "r_rate_days").alias("water_rate_days_used"),
        *(_shown(ok, c).alias(name) for c, name in (("litres_days", "water_days"), ("mains_days", "fallback_days"), ("outlier_days", "outlier_days"))),
        _shown(ok, "r_limit", 0).alias("outlier_limit"),
        "latest_gas_day",
        "latest_water_day",
        (F.datediff("today", "latest_water_day") - 1).alias("water_lag_days"),
        _shown(ok, "hot_cost_day", 2).alias("cost_per_day"),
        _shown(ok, "hot_cost_year", 0).alias("cost_per_year"),
        _shown(ok, "hot_annual", 1).alias("annual_kwh"),
        _shown(ok, "wh_per_litre", 1).alias("wh_per_litre"),
        _shown(ok, "hot_pct", 0).alias("hot_fraction_pct"),
        F.when(~ok, F.format_string("%d of 7 days without heating", used)).alias("unavailable_reason"),
    )


def hot_water(days: DataFrame, by: list[str], window_days: int, rate: float, rule: HotWater = HotWater(), gas_water: DataFrame | None = None) -> DataFrame:
    return hot_water_rows(analyses(uniform(days, window_days=window_days, gas_rate=rate), by, water=rule), by, gas_water)


def gas_use_rows(found: DataFrame, by: list[str]) -> DataFrame:
    """One row a home: hot water and space heating over the last 7 and 30 days;
    homes without a hot-water baseline keep their row and tell so."""
    ok = F.col("r_valid")
    return found.select(
        *by,
        *(F.round(c, 2).alias(c) for c in ("hot_7d", "hot_30d", "space_7d", "space_30d")),
        F.round(F.col("hot_7d") * F.col("gas_rate"), 2).alias("hot_cost_7d"),
        F.round(F.col("space_7d") * F.col("gas_rate"), 2).alias("space_cost_7d"),
        *(_shown(ok, c).alias(name) for c, name in (("off_days", "heating_off_days"), ("modelled_days", "modelled_days"), ("from_power_days", "from_power_days"))),
        *(_shown(ok, c).alias(name) for c, name in (("litres_days", "water_days"), ("mains_days", "fallback_days"), ("outlier_days", "outlier_days"))),
        "latest_gas_day",
        "latest_water_day",
        F.when(~ok, "needs a gas meter and a hot-water baseline").alias("unavailable_reason"),
    )


def gas_use(days: DataFrame, by: list[str], window_days: int, rate: float, rule: HotWater = HotWater()) -> DataFrame:
    return gas_use_rows(analyses(uniform(days, window_days=window_days, gas_rate=rate), by, water=rule), by)


def electricity_rows(found: DataFrame, by: list[str]) -> DataFrame:
    """One row a home: baseload and use of the last 30 days against the 30
    before; without enough days only how many there are and are needed."""
    ok, base, mean, rate = F.col("power_ok"), F.col("power_base"), F.col("power_mean"), F.col("power_rate")
    return found.select(
        *by,
        _shown(ok, base * 1000, 0).alias("baseload_w"),
        _shown(ok, mean, 2).alias("kwh_per_day"),
        _shown(ok, "power_historical", 2).alias("historical"),
        _shown(ok, "power_7d", 2).alias("last_7d"),
        _shown(ok, "power_30d", 2).alias("last_30d"),
        _shown(ok, "power_previous", 2).alias("previous_30d"),
        _shown(ok, "power_change", 1).alias("change_pct"),
        _shown(ok, base * 24, 2).alias("baseload_kwh"),
        _shown(ok, "power_share", 1).alias("share_pct"),
        _shown(ok, mean * 1000 / 24, 0).alias("implied_gains_w"),
        _shown(ok, mean * rate, 2).alias("cost_day"),
        _shown(ok, mean * rate * 365, 0).alias("cost_year"),
        _shown(ok, base * 24 * rate * 365, 0).alias("baseload_cost_year"),
        _shown(ok, "power_n_7d").alias("days_7d"),
        _shown(ok, "power_n_30d").alias("days_30d"),
        _shown(ok, "power_latest").alias("latest_day"),
        _shown(ok, F.datediff("today", "power_latest") - 1).alias("lag_days"),
        *unavailable(ok, F.col("power_n"), MIN_POWER_DAYS),
    )


def electricity_use(days: DataFrame, by: list[str], window_days: int, rate: float) -> DataFrame:
    return electricity_rows(analyses(uniform(days, window_days=window_days, power_rate=rate), by), by)


def water_rows(found: DataFrame, by: list[str]) -> DataFrame:
    """One row a home: litres of the last 7 and 30 days, a typical day, days of
    high use and their limit; without enough days how many there are and are needed."""
    ok = F.col("water_ok")
    return found.select(
        *by,
        _shown(ok, "litres_7d", 1).alias("litres_7d"),
        _shown(ok, "litres_30d", 1).alias("litres_30d"),
        _shown(ok, "litres_typical", 1).alias("typical_30d"),
        _shown(ok, "high_days").alias("high_usage_days"),
        _shown(ok, "w_limit", 0).alias("threshold"),
        _shown(ok, "water_latest").alias("latest_day"),
        _shown(ok, F.datediff("today", "water_latest") - 1).alias("lag_days"),
        _shown(ok, "water_n_7d").alias("days_7d"),
        _shown(ok, "water_n_30d").alias("days_30d"),
        *unavailable(ok, F.col("water_n"), MIN_WATER_DAYS),
    )


def water_use(days: DataFrame, by: list[str], window_days: int) -> DataFrame:
    return water_rows(analyses(uniform(days, window_days=window_days), by), by)


def unavailable(usable: Column, have: Column, need: int) -> list[Column]:
    """Columns usable_days, required_days and unavailable_reason of a value that isn't shown."""
    return [
        F.when(~usable, have).alias("usable_days"),
        F.when(~usable, F.lit(need)).alias("required_days"),
        F.when(~usable & (have < need), F.format_string("%d of %d days", have.cast("int"), F.lit(need))).when(~usable, "too few recent days").alias("unavailable_reason"),
    ]


def heat_loss_rows(found: DataFrame, by: list[str]) -> DataFrame:
    """One row a home: the coefficient delivered, its limits and what it rests
    on, held at the last heated day; homes keep their row whatever a gate rejects."""
    shown, best, delivered, efficiency = F.col("hlc_shown"), F.col("hlc_best"), F.col("hlc_delivered"), F.col("boiler_efficiency")
    recent_ = F.col("hlc_recent")
    return found.select(
        *by,
        F.round(delivered, 1).alias("hlc_w_per_k"),
        F.coalesce(best["status"], F.lit("invalid")).alias("status"),
        F.round(best["r2"], 3).alias("r_squared"),
        best["n"].alias("days_used"),
        _shown(shown, "window_days").alias("window_days"),
        F.round(best["ci_low"] * efficiency, 1).alias("ci_low"),
        F.round(best["ci_high"] * efficiency, 1).alias("ci_high"),
        F.round(best["r1"], 2).alias("residual_autocorrelation"),
        F.round(best["effective_days"], 0).alias("effective_independent_days"),
        F.round(-best["intercept"] * efficiency * 1000 / 24, 0).alias("free_gains_w"),
        F.round(F.when(shown, F.col("fit_raw.hlc")), 1).alias("fuel_input_hlc"),
        F.round(best["hlc"], 1).alias("space_heating_fuel_input_hlc"),
        _shown(shown, "boiler_efficiency").alias("boiler_efficiency_used"),
        F.round(best["intercept"], 1).alias("regression_intercept"),
        F.round(delivered / F.col("floor_area_m2"), 2).alias("hlc_per_m2"),
        _shown(shown & F.col("l_valid"), "l_baseline", 1).alias("dhw_baseline"),
        _shown(shown & F.col("l_valid"), "l_used").alias("dhw_baseline_days_used"),
        _shown(shown, "model_day").alias("model_data_through"),
        F.round(recent_["hlc"] * efficiency, 1).alias("recent_hlc"),
        recent_["w"].alias("recent_window_days"),
        recent_["n"].alias("recent_days_used"),
        _shown(F.col("hlc_corrected"), "hlc_delivered", 1).alias("space_heating_hlc"),
        band(delivered, HLC_BANDS).alias("band"),
        F.col("why").alias("unavailable_reason"),
    )


def heat_loss(days: DataFrame, by: list[str], efficiency: float, area_m2: float, windows: list[int], rule: HeatLoss = HeatLoss(), water: HotWater = HotWater()) -> DataFrame:
    given = uniform(days, window_days=windows[-1], boiler_efficiency=efficiency, floor_area_m2=area_m2)
    return heat_loss_rows(analyses(given, by, rule, water, tuple(windows[:-1])), by)


def losses(loss: DataFrame, air_changes: DataFrame, by: list[str], volume_m3: Column) -> DataFrame:
    """One row a home: air changes (by, ach, windows, baseline, sensors,
    baseline_source), the loss they make of the home's volume, what the fabric
    loses, with bands and what to look at first. ``loss`` has hlc_w_per_k,
    boiler_efficiency_used and what ``volume_m3`` needs."""
    met = loss.join(air_changes, by, "left")
    split = air.split_losses(met, "hlc_w_per_k", "ach", volume_m3)
    rounded = lambda c, digits: F.round(c, digits).alias(c)
    return split.select(
        *by,
        rounded("ach", 3),
        "windows",
        F.round("baseline", 0).alias("baseline_ppm"),
        F.col("sensors").alias("sensors_used"),
        "baseline_source",
        F.when(F.col("sensors") > 0, F.format_string("median of %d sensors, for the home's whole volume", F.col("sensors"))).alias("scope"),
        rounded("ventilation_w_per_k", 1),
        rounded("fabric_w_per_k", 1),
        rounded("share_pct", 1),
        F.col("hlc_w_per_k").alias("hlc_delivered"),
        "boiler_efficiency_used",
        band(F.col("ach"), ACH_BANDS).alias("ach_band"),
        band(F.col("ventilation_w_per_k"), VENTILATION_BANDS).alias("ventilation_band"),
        decision(F.col("fabric_w_per_k"), F.col("ventilation_w_per_k")).alias("decision"),
    )


def recency(loss: DataFrame, by: list[str]) -> DataFrame:
    """(by, recent_change_pct): the recent coefficient against the full window's."""
    return loss.select(*by, F.round(change_pct(F.col("recent_hlc"), F.col("hlc_w_per_k")), 1).alias("recent_change_pct"))


PARTS = {"hlc": heat_loss_rows, "dhw": hot_water_rows, "gas": gas_use_rows, "elec": electricity_rows, "water": water_rows}


def _prefixed(found: DataFrame, by: list[str]) -> DataFrame:
    """All parts of the report side by side, as columns that bear the part's prefix."""
    columns = {}
    for prefix, part in PARTS.items():
        made = part(found.withColumn("__all", F.struct("*")), ["__all", *by])
        columns[prefix] = [c for c in made.columns if c not in ("__all", *by)]
        rest = made.select("__all", *by, *(F.col(c).alias(f"{prefix}_{c.removeprefix('hlc_')}") for c in columns[prefix]))
        kept = [F.col(c) for c in rest.columns if c not in ("__all", *by)]
        found = rest.select("__all.*", *kept)
    return found.select(*by, *(f"{prefix}_{c.removeprefix('hlc_')}" for prefix in PARTS for c in columns[prefix]))


def composite(days: DataFrame, by: list[str], efficiency: float, area_m2: float, gas_rate: float, electricity_rate: float, windows: list[int] = [60, 120, 365]) -> DataFrame:  # noqa: B006
    """The report of homes that share one configuration, one row a home: heat
    loss, hot water, gas, electricity and water use, their columns prefixed by
    hlc_, dhw_, gas_, elec_ and water_."""
    given = uniform(days, window_days=windows[-1], boiler_efficiency=efficiency, floor_area_m2=area_m2, gas_rate=gas_rate, power_rate=electricity_rate)
    return _prefixed(analyses(given, by, short=tuple(windows[:-1])), by)
