"""The whole report of homes, each by its own configuration, as one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import change_pct
from ..operators import air
from ..thresholds import HeatLoss, HotWater
from .analyses import MIN_POWER_DAYS, MIN_WATER_DAYS, analyses, configured


def _struct(**values: Column | str) -> Column:
    return F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()))


def _hot_water() -> Column:
    ok = F.col("r_valid")
    return F.when(
        ok,
        _struct(
            kwh_per_day="r_baseline", days_used="r_used", outdoor_mean="r_reference", low_water_days_excluded="r_away", min_occupied_water_litres="away_litres",
            status=F.when(F.col("r_used") >= 14, "valid").otherwise("provisional"), idle_gas_kwh_per_day=F.when(F.col("r_away") >= 3, F.col("r_idle")),
            latest_complete_gas_day="latest_gas_day", latest_complete_water_day="latest_water_day", water_source_lag_days=F.datediff("today", "latest_water_day") - 1,
            water_outlier_limit_litres="r_limit", water_attribution_days="litres_days", baseline_fallback_days="mains_days", water_outlier_days_ignored="outlier_days",
            water_rate_wh_per_litre_per_k="r_rate", water_rate_days_used=F.when(F.col("r_rate").isNotNull(), F.col("r_rate_days")),
            cost_per_day="hot_cost_day", cost_per_year="hot_cost_year", modelled_annual_kwh=F.when(F.col("gas_rate").isNotNull(), F.col("hot_annual")),
            wh_per_litre="wh_per_litre", hot_fraction_pct="hot_pct",
        ),
    )


def _usage() -> Column:
    rate = F.col("gas_rate")
    return F.when(
        F.col("r_valid") & (F.col("off_days") + F.col("modelled_days") > 0),
        _struct(
            dhw_kwh_per_day_7d="hot_7d", dhw_kwh_per_day_30d="hot_30d", space_heating_kwh_per_day_7d="space_7d", space_heating_kwh_per_day_30d="space_30d",
            heating_off_days="off_days", modelled_days="modelled_days", heating_off_from_power_days="from_power_days",
            water_attribution_days="litres_days", baseline_fallback_days="mains_days", water_outlier_days_ignored="outlier_days",
            latest_complete_gas_day="latest_gas_day", latest_complete_water_day="latest_water_day",
            dhw_cost_per_day_7d=F.col("hot_7d") * rate, space_heating_cost_per_day_7d=F.col("space_7d") * rate,
        ),
    )


def _water() -> tuple[Column, Column]:
    ok = F.col("water_ok")
    value = _struct(
        litres_per_day_7d="litres_7d", days_used_7d="water_n_7d", litres_per_day_30d="litres_30d", days_used_30d="water_n_30d", typical_day_litres_30d="litres_typical",
        high_usage_days_30d="high_days", outlier_limit_litres="w_limit", latest_complete_day="water_latest", days_used="water_n", source_lag_days=F.datediff("today", "water_latest") - 1,
    )
    missing = F.coalesce("has_water", F.lit(False)) & ~ok
    status = _struct(configured=F.coalesce("has_water", F.lit(False)), usable_days=F.when(missing, F.col("water_n")), required_days=F.when(missing, F.lit(MIN_WATER_DAYS)))
    return F.when(ok, value), status


def _electricity() -> tuple[Column, Column]:
    ok, mean, month, base, rate = F.col("power_ok"), F.col("power_mean"), F.col("power_30d"), F.col("power_base"), F.col("power_rate")
    value = _struct(
        kwh_per_day=mean, historical_kwh_per_day="power_historical", baseload_w=base * 1000, baseload_kwh_per_day=base * 24, implied_internal_gains_w=mean * 1000 / 24,
        days_used="power_n", current_period_days_used="power_n_30d", latest_complete_day="power_latest", baseload_share_pct="power_share", last_7d_kwh_per_day="power_7d",
        last_30d_kwh_per_day=month, days_used_7d="power_n_7d", days_used_30d="power_n_30d", previous_30d_kwh_per_day="power_previous", change_vs_previous_30d_pct="power_change",
        source_lag_days=F.datediff("today", "power_latest") - 1, cost_per_day=mean * rate, cost_per_year=mean * rate * 365, cost_per_day_30d=month * rate,
        cost_per_year_30d=month * rate * 365, baseload_cost_per_year=base * 24 * rate * 365,
    )
    missing = F.coalesce("has_power", F.lit(False)) & ~ok
    status = _struct(configured=F.coalesce("has_power", F.lit(False)), usable_days=F.when(missing, F.col("power_n")), required_days=F.when(missing, F.lit(MIN_POWER_DAYS)))
    return F.when(ok, value), status


def _heat_loss() -> Column:
    best, efficiency, delivered = F.col("hlc_best"), F.col("boiler_efficiency"), F.col("hlc_delivered")
    base = lambda c: F.when(F.col("l_valid"), F.col(c))
    gains = -best["intercept"]
    return F.when(
        F.col("hlc_shown"),
        _struct(
            hlc_w_per_k=delivered, hlc_ci_low_w_per_k=best["ci_low"] * efficiency, hlc_ci_high_w_per_k=best["ci_high"] * efficiency, r_squared=best["r2"], days_used=best["n"],
            residual_autocorrelation=best["r1"], effective_independent_days=best["effective_days"], free_gains_kwh_per_day=gains * efficiency, free_gains_w=gains * efficiency * 1000 / 24,
            fuel_input_free_gains_kwh_per_day=gains, regression_intercept_kwh_per_day=best["intercept"], fuel_input_hlc_w_per_k="fit_raw.hlc", fuel_input_r_squared="fit_raw.r2",
            space_heating_fuel_input_hlc_w_per_k=best["hlc"], delivered_hlc_w_per_k=delivered, boiler_efficiency_used=efficiency, window_days="window_days", status=best["status"],
            model_data_through="model_day", dhw_baseline_kwh_per_day=base("l_baseline"), dhw_baseline_days_used=base("l_used"), hlc_w_per_k_per_m2=delivered / F.col("floor_area_m2"),
            space_heating_hlc_w_per_k=F.when(F.col("hlc_corrected"), delivered), space_heating_r_squared=F.when(F.col("hlc_corrected"), best["r2"]),
            recent_hlc_w_per_k=F.col("hlc_recent.hlc") * efficiency, recent_window_days="hlc_recent.w", recent_days_used="hlc_recent.n",
            recent_change_pct=change_pct(F.col("hlc_recent.hlc") * efficiency, delivered),
        ),
    )


def _losses(out: DataFrame) -> DataFrame:
    """Adds losses: only of homes with a heat loss, air changes and a volume, and not if
    the air alone would lose more than the whole."""
    split = air.split_losses(out, "hlc_delivered", "ach", F.col("floor_area_m2") * F.col("ceiling_m"))
    value = _struct(
        ach="ach", windows="windows", baseline_ppm="baseline", co2_sensors_used="sensors", co2_baseline_source="baseline_source", ventilation_w_per_k="ventilation_w_per_k",
        fabric_w_per_k="fabric_w_per_k", hlc_delivered_w_per_k="hlc_delivered", ventilation_share_pct="share_pct", boiler_efficiency_used="boiler_efficiency",
        scope=F.format_string("median of %d sensors, for the home's whole volume", F.col("sensors")),
    )
    return split.withColumn("losses", F.when(F.col("ventilation_w_per_k").isNotNull(), value))


def whole_report(days: DataFrame, homes: DataFrame, by: list[str], rooms: DataFrame, air_changes: DataFrame, loft: DataFrame, gas_water: DataFrame, heat: HeatLoss = HeatLoss(), water: HotWater = HotWater()) -> DataFrame:
    """(by, config_problem, rooms, hlc, dhw, usage, water_usage, water_status,
    electricity, electricity_status, losses, loft): a struct for each analysis,
    null where its gates reject it, and ``rooms`` as a map of structs by name.

    ``days`` are complete days, read once (see ``analyses``); ``homes`` is the
    configuration with has_water, has_power and problem; the other tables have a
    row a home (a room for ``rooms``, of ``cooling.in_windows``): air changes,
    the loft report and the regression of gas on litres. Every home of ``homes``
    has its row, those with a problem and those without any days as well.
    """
    found = analyses(configured(days, homes, by), by, heat, water)
    out = homes.select(*by, "ceiling_m", F.col("problem").alias("config_problem")).join(found, by, "left")
    room = F.struct("tau_median_h", "nights_fitted", "last_night", "window_days")
    named = rooms.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("room", F.when(F.col("nights_fitted") > 0, room)))).alias("rooms"))  # a home's rooms
    litre = gas_water.where("usable").select(*by, "wh_per_litre", "hot_pct")
    roof = loft.where("ratio is not null").select(*by, F.struct("ratio", "verdict", "hours_used", "window_days", "iqr", "out_of_range_pct", "humidity_pct").alias("loft"))
    out = out.join(named, by, "left").join(litre, by, "left").join(air_changes, by, "left").join(roof, by, "left")
    water_usage, water_status = _water()
    power, power_status = _electricity()
    return _losses(out).select(
        *by, "config_problem", "rooms", _heat_loss().alias("hlc"), _hot_water().alias("dhw"), _usage().alias("usage"), water_usage.alias("water_usage"), water_status.alias("water_status"),
        power.alias("electricity"), power_status.alias("electricity_status"), "losses", "loft",
    )
