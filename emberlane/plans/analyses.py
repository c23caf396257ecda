"""All analyses of homes' days in one pass.

Days are shuffled once, by home. What an analysis needs of a whole home (the last
heated day, a baseline, a rate, a regression line) is a window aggregate over
the home's rows, and what needs that in turn is a window in the next level, so
nothing is joined and the table of days is read once. A home's history bounds a
window's rows. The last step makes one row a home of unrounded values; reports
round and name them.

Each threshold that a home's configuration sets is a column of the days
(``configured``), so homes are judged by their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import change_pct, variance_inflation
from ..operators import hotwater
from ..thresholds import BOILER_EFFICIENCY, HeatLoss, HotWater

#: Columns of a home's configuration, with the value of homes that don't set them.
CONFIG = {
    "window_days": (365, "int"), "away_litres": (50.0, "double"), "boiler_efficiency": (BOILER_EFFICIENCY, "double"), "floor_area_m2": (None, "double"),
    "gas_rate": (None, "double"), "power_rate": (None, "double"), "has_water": (True, "boolean"), "has_power": (True, "boolean"),
}
SHORT_WINDOWS = (60, 120)
RECENT = {7: 5, 30: 20}  # days, and how many of them have to be there
MIN_POWER_DAYS, MIN_WATER_DAYS = 14, 5


def uniform(days: DataFrame, **values) -> DataFrame:
    """Days with these configuration values for all homes, defaults for the rest."""
    given = {k: F.lit(values.get(k, default)).cast(kind) for k, (default, kind) in CONFIG.items() if k in values or k not in days.columns}
    return days.withColumns(given)


def configured(days: DataFrame, homes: DataFrame, by: list[str]) -> DataFrame:
    """Days with their home's configuration; homes without one get no values, so
    that they keep their days and every analysis of them is rejected."""
    known = homes.select(*by, *(F.col(k).cast(kind) for k, (_, kind) in CONFIG.items()))
    met = days.join(known, by, "left")
    return met.withColumns({"water": F.when(F.col("has_water"), F.col("water")), "kwh": F.when(F.col("has_power"), F.col("kwh"))})


def _limit(water: Column, over) -> Column:
    """Over a window: three medians, or the upper quartile and three interquartile
    ranges, whichever is more. The values are the wet ones of 30 days at most."""
    ordered, n = F.sort_array(F.collect_list(water).over(over)), F.count(water).over(over)
    at = lambda rank: F.get(ordered, rank.cast("int"))
    q1, q3 = at(F.floor(n / 4)), at(F.floor(n * 3 / 4))
    return F.when(n >= 5, F.greatest(3 * F.median(water).over(over), q3 + 3 * (q3 - q1)))


def _attributed(model: str, rule: HotWater) -> dict[str, Column]:
    """hot_kwh, how and outlier of a day by the values of this model."""
    col = lambda c: F.col(f"{model}_{c}")
    valid = col("used") >= rule.min_days
    rate = F.when((col("rate_days") >= rule.min_rate_days) & col("rate_raw").between(*rule.rate_bounds), col("rate_raw"))
    q, water, outdoor = F.col("q"), F.col("water"), F.col("outdoor")
    big = F.coalesce(water > col("limit"), F.lit(False))
    litres = rate.isNotNull() & water.isNotNull() & outdoor.isNotNull() & ~big
    how = F.when(F.col("off"), "off").when(litres, "litres").when(outdoor.isNotNull(), "mains")
    by_litres = F.least(hotwater.litres_kwh(water, rate, outdoor, rule), q)
    by_mains = F.least(hotwater.scaled_kwh(col("baseline"), outdoor, col("reference"), rule), q)
    hot = F.when(F.col("off"), q).when(litres, by_litres).when(outdoor.isNotNull(), by_mains)
    return {f"{model}_hot": F.when(valid, hot), f"{model}_how": F.when(valid, how), f"{model}_outlier": valid & ~F.col("off") & big, f"{model}_rate": F.when(valid, rate), f"{model}_valid": F.coalesce(valid, F.lit(False))}


def _marked(days: DataFrame, by: list[str], rule: HeatLoss) -> DataFrame:
    """Which days count: in the rolling window before today (r), and in that of the
    last heated day (l), after which nothing of the heating model is taken."""
    home = Window.partitionBy(*by)
    d, last = F.col("d"), lambda holds: F.max(F.when(holds, F.col("d"))).over(home)
    near = F.datediff("today", "d") <= F.col("window_days")
    wet, powered = F.col("water").isNotNull(), F.col("kwh").isNotNull()
    heated = (F.col("delta_t") > rule.min_delta_t) & (F.col("q") > rule.min_energy) & (F.col("heat_pct").isNull() | (F.col("heat_pct") > 1)) & near
    rows = days.withColumns({"r_near": F.coalesce(near, F.lit(False)), "model_day": last(heated), "r_wet": last(wet), "w_wet": last(wet & near), "last_power": last(powered & near)})
    locked = F.col("model_day").isNull() | (d <= F.col("model_day"))
    age = F.datediff(F.coalesce("model_day", "today"), d)
    rows = rows.withColumns({"l_in": locked, "l_age": age, "l_near": F.coalesce(locked & (age <= F.col("window_days")), F.lit(False)), "l_wet": last(locked & wet)})
    return rows.withColumns({"power_age": F.datediff("last_power", d), "wet_age": F.datediff("w_wet", d), "age": F.datediff("today", d) - 1})


def _modelled(rows: DataFrame, by: list[str], rule: HotWater) -> DataFrame:
    """Baseline, rate and limit of both hot-water models, and what they make of each day."""
    home = Window.partitionBy(*by)
    q, water, outdoor = F.col("q"), F.col("water"), F.col("outdoor")
    away = F.coalesce(water < F.col("away_litres"), F.lit(False))
    level: dict[str, Column] = {}
    for m in "rl":
        base = F.col("off") & q.isNotNull() & outdoor.isNotNull() & F.col(f"{m}_near")
        level |= {
            f"{m}_baseline": F.median(F.when(base & ~away, q)).over(home),
            f"{m}_reference": F.avg(F.when(base & ~away, outdoor)).over(home),
            f"{m}_used": F.count(F.when(base & ~away, q)).over(home),
            f"{m}_away": F.count(F.when(base & away, q)).over(home),
            f"{m}_idle": F.median(F.when(base & away, q)).over(home),
        }
        counted = F.col("l_in") if m == "l" else F.lit(True)
        level[f"{m}_limit"] = _limit(F.when(counted & (F.datediff(f"{m}_wet", "d") < 30), water), home)
    level["w_limit"] = _limit(F.when(F.col("r_near") & (F.col("wet_age") < 30), water), home)
    rows = rows.withColumns(level)
    level = {}
    for m in "rl":
        rated = F.col("off") & (q > 0) & (water >= F.col("away_litres")) & (water <= F.coalesce(f"{m}_limit", water)) & outdoor.isNotNull() & F.col(f"{m}_near")
        rate = F.when(rated, q * 1000 / water / (rule.tank_c - hotwater.mains_c(outdoor, rule)))
        level |= {f"{m}_rate_raw": F.median(rate).over(home), f"{m}_rate_days": F.count(rate).over(home)}
    rows = rows.withColumns(level)
    for m in "rl":
        rows = rows.withColumns(_attributed(m, rule))
    return rows.withColumn("space", F.greatest(q - F.col("r_hot"), F.lit(0.0)))


def _lines(rows: DataFrame, by: list[str], kinds: list[str], rule: HeatLoss) -> DataFrame:
    """Regression lines of each kind's energy (y_kind) on delta_t over a home, the
    residuals, and their products with those of the day before."""
    home = Window.partitionBy(*by)
    level: dict[str, Column] = {}
    for k in kinds:
        y = F.col(f"y_{k}")
        x = F.when(y.isNotNull(), F.col("delta_t"))
        flat_x, flat_y = F.min(x).over(home) == F.max(x).over(home), F.min(y).over(home) == F.max(y).over(home)
        level |= {
            f"slope_{k}": F.when(flat_x, 0.0).otherwise(F.regr_slope(y, x).over(home)),
            f"intercept_{k}": F.when(flat_x, F.avg(y).over(home)).otherwise(F.regr_intercept(y, x).over(home)),
            f"r2_{k}": F.when(flat_x | flat_y, 0.0).otherwise(F.regr_r2(y, x).over(home)),
            f"sxx_{k}": F.regr_sxx(y, x).over(home),
            f"n_{k}": F.count(y).over(home),
            f"spread_{k}": F.max(x).over(home) - F.min(x).over(home),
        }
    rows = rows.withColumns(level)
    rows = rows.withColumns({f"e_{k}": F.col(f"y_{k}") - F.col(f"intercept_{k}") - F.col(f"slope_{k}") * F.col("delta_t") for k in kinds})
    order = home.orderBy("d")
    next_day = F.datediff("d", F.lag("d").over(order)) == 1
    level = {f"m_{k}": F.avg(f"e_{k}").over(home) for k in kinds} | {f"before_{k}": F.when(next_day, F.lag(f"e_{k}").over(order)) for k in kinds}
    rows = rows.withColumns(level)
    return rows.withColumns({f"pair_{k}": (F.col(f"e_{k}") - F.col(f"m_{k}")) * (F.col(f"before_{k}") - F.col(f"m_{k}")) for k in kinds})


def _fit(k: str, rule: HeatLoss) -> Column:
    """Aggregate: the fit of a kind as a struct, with the reason for which a gate rejects it."""
    one = lambda c: F.max(F.col(f"{c}_{k}"))  # the same on all rows of a home
    e, pair, n = F.col(f"e_{k}"), F.col(f"pair_{k}"), one("n")
    spread_ = F.var_pop(e)
    r1 = F.when((F.count(pair) < rule.min_pairs) | (spread_ == 0), 0.0).otherwise(F.avg(pair) / spread_)
    vif = variance_inflation(r1, rule.max_lag1)
    error = F.sqrt(F.try_divide(F.try_divide(F.sum(e * e), n - 2), one("sxx"))) * F.sqrt(vif)
    slope, watts = one("slope"), 1000 / 24
    low = (slope - rule.z * error) * watts
    why = (
        F.when(n == 0, "no usable days")
        .when(n < rule.min_days, "too few days")
        .when(one("spread") < rule.min_spread, "too little spread")
        .when(slope <= 0, "slope isn't positive")
        .when(one("r2") < rule.min_r2, "weak fit")
        .when(~(slope * watts).between(*rule.bounds), "out of bounds")
        .when(low <= 0, "limits include zero")
    )
    return F.struct(
        (slope * watts).alias("hlc"), low.alias("ci_low"), ((slope + rule.z * error) * watts).alias("ci_high"), one("r2").alias("r2"), n.alias("n"), r1.alias("r1"),
        (n / vif).alias("effective_days"), one("intercept").alias("intercept"), F.when(n >= rule.valid_days, "valid").otherwise("provisional").alias("status"), why.alias("why"),
    ).alias(f"fit_{k}")


def _recent(value: str, age: str, days: int) -> Column:
    near = F.when((F.col(age) >= 0) & (F.col(age) < days), F.col(value))
    return F.when(F.count(near) >= RECENT[days], F.avg(near))


def analyses(days: DataFrame, by: list[str], heat: HeatLoss = HeatLoss(), water: HotWater = HotWater(), short: tuple[int, ...] = SHORT_WINDOWS) -> DataFrame:
    """One row a home of complete days (by, d, today, q, delta_t, outdoor, heat_pct,
    water, kwh, least, off and the columns of ``CONFIG``): every analysis'
    unrounded values, null where its gates reject them."""
    rows = _modelled(_marked(days, by, heat), by, water)
    fits = F.col("l_near") & (F.col("q") > heat.min_energy) & (F.col("delta_t") > heat.min_delta_t)
    rest = F.col("q") - F.coalesce(F.when(F.col("l_near"), F.col("l_hot")), F.lit(0.0))
    net = fits & (rest > 0)
    ys = {"raw": F.when(fits, F.col("q")), "net": F.when(net, rest)}
    ys |= {f"{w}": F.when(net & F.col("model_day").isNotNull() & (F.col("l_age") <= w) & (F.col("window_days") > w), rest) for w in short}
    rows = _lines(rows.withColumns({f"y_{k}": y for k, y in ys.items()}), by, list(ys), heat)

    one, now = (lambda c: F.max(c).alias(c)), lambda c: F.when(F.col("r_near") & (F.col("power_age") < 30), F.col(c))
    near_water = F.when(F.col("r_near"), F.col("water"))
    wet_30 = F.when(F.col("wet_age") < 30, near_water)
    known = F.col("r_hot").isNotNull()
    before = F.when(F.col("r_near") & F.col("power_age").between(30, 59), F.col("kwh"))
    values = [
        *(one(c) for c in (*CONFIG, "today", "model_day", "r_valid", "l_valid", "r_limit", "r_rate", "r_rate_days", "r_used", "r_away", "l_used", "w_limit")),
        *(F.max(c).alias(c) for c in ("r_baseline", "r_reference", "r_idle", "l_baseline")),
        *(_fit(k, heat) for k in ys),
        F.max(F.when(F.col("q").isNotNull(), F.col("d"))).alias("latest_gas_day"), F.max("r_wet").alias("latest_water_day"),
        F.count_if(known & ~F.col("off") & (F.col("r_how") == "litres")).alias("litres_days"), F.count_if(known & (F.col("r_how") == "mains")).alias("mains_days"), F.count_if("r_outlier").alias("outlier_days"),
        F.avg("r_hot").alias("hot_mean"), F.count_if(F.col("off") & known).alias("off_days"), F.count_if(~F.col("off") & known).alias("modelled_days"),
        F.count_if(F.col("off") & F.col("heat_pct").isNotNull()).alias("from_power_days"),
        *(_recent(c, "age", n).alias(f"{name}_{n}d") for c, name in (("r_hot", "hot"), ("space", "space")) for n in RECENT),
        F.count(near_water).alias("water_n"), F.count(F.when(F.col("wet_age") < 7, near_water)).alias("water_n_7d"), F.count(wet_30).alias("water_n_30d"),
        *(F.when(F.count(F.when(F.col("wet_age") < n, near_water)) >= RECENT[n], F.avg(F.when(F.col("wet_age") < n, near_water))).alias(f"litres_{n}d") for n in RECENT),
        F.when(F.count(wet_30) >= RECENT[30], F.median(wet_30)).alias("litres_typical"), F.count_if(wet_30 > F.col("w_limit")).alias("high_days"), F.max("w_wet").alias("water_latest"),
        F.count(F.when(F.col("r_near"), F.col("kwh"))).alias("power_n"), F.count(now("kwh")).alias("power_n_30d"), F.count_if(F.col("r_near") & F.col("kwh").isNotNull() & (F.col("power_age") < 7)).alias("power_n_7d"),
        F.avg(now("kwh")).alias("power_mean"), F.avg(F.when(F.col("r_near"), F.col("kwh"))).alias("power_historical"), F.median(F.when(F.col("kwh").isNotNull(), now("least"))).alias("power_base"),
        *(F.when(F.count(F.when(F.col("power_age") < n, now("kwh"))) >= RECENT[n], F.avg(F.when(F.col("power_age") < n, now("kwh")))).alias(f"power_{n}d") for n in RECENT),
        F.when(F.count(before) >= RECENT[30], F.avg(before)).alias("power_previous"), F.max("last_power").alias("power_latest"),
    ]
    return _assembled(rows.groupBy(*by).agg(*values), short)


def _assembled(found: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """Adds the delivered coefficient, costs, and whether each analysis holds."""
    raw, net = F.col("fit_raw"), F.col("fit_net")
    passed = lambda fit: fit["why"].isNull()
    shown = passed(raw)
    corrected = shown & F.col("l_valid") & passed(net)
    best = F.when(corrected, net).when(shown, raw)
    windows = F.array_compact(F.array(*(F.when(shown & passed(F.col(f"fit_{w}")), F.struct(F.lit(w).alias("w"), F.col(f"fit_{w}.hlc").alias("hlc"), F.col(f"fit_{w}.n").alias("n"))) for w in short)))
    efficiency = F.col("boiler_efficiency")
    annual = F.coalesce("hot_mean", "r_baseline") * 365
    power = (F.col("power_n") >= MIN_POWER_DAYS) & (F.col("power_n_30d") >= MIN_POWER_DAYS) & F.coalesce("has_power", F.lit(False))
    return found.withColumns(
        {
            "hlc_shown": shown, "hlc_corrected": corrected, "hlc_best": best, "hlc_recent": F.get(windows, F.lit(0)), "hlc_delivered": best["hlc"] * efficiency,
            "why": F.when(~shown, raw["why"]), "hot_annual": F.when(F.col("r_valid"), annual),
            "hot_cost_day": F.col("r_baseline") * F.col("gas_rate"), "hot_cost_year": annual * F.col("gas_rate"),
            "power_ok": power, "power_change": change_pct(F.col("power_30d"), F.col("power_previous")),
            "power_share": F.least(F.lit(100.0), F.try_divide(F.col("power_base") * 24, F.col("power_mean")) * 100),
            "water_ok": F.coalesce("has_water", F.lit(False)) & (F.col("water_n") >= MIN_WATER_DAYS) & F.col("litres_7d").isNotNull(),
        }
    )
