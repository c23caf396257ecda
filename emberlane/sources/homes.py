"""Configuration of many homes as a table."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.usage import tariff_per_kwh
from ..thresholds import HOME_BOUNDS, HOME_DEFAULTS, SHORT_WINDOWS

TYPES = {name: "int" if name == "window_days" else "double" for name in HOME_BOUNDS}


def _number(name: str) -> Column:
    number = F.col(name).try_cast("double")
    return F.floor(number) if TYPES[name] == "int" else number


def configured(forms: DataFrame, by: list[str]) -> DataFrame:
    """Typed configuration of forms, whose fields are text or null: by, timezone,
    the numbers of ``HOME_BOUNDS``, loft_since, and gas_tariff, gas_unit,
    power_tariff, power_unit.

    Fields that aren't given have their default. ``problem`` names the first field
    that breaks a rule (an unknown zone, a number that isn't one or is out of
    bounds, a date that isn't one); such a home has no values, so that nothing is
    computed from half a configuration. A tariff of an unknown unit is no tariff
    rather than a problem. ``windows`` lists the lookback windows, shortest first.
    """
    given = lambda name: F.nullif(F.trim(F.col(name)), F.lit(""))
    forms = forms.withColumns({name: given(name) for name in ("timezone", *HOME_BOUNDS, "loft_since")})
    rules = [("timezone: unknown", F.col("timezone").isNotNull() & ~F.col("timezone").isin(sorted(available_timezones())))]
    for name, (low, high) in HOME_BOUNDS.items():
        number = _number(name)
        rules.append((f"{name}: no number", F.col(name).isNotNull() & (number.isNull() | F.isnan(number))))
        rules.append((f"{name}: not in {low}..{high}", ~number.between(low, high)))
    rules.append(("loft_since: no date", F.col("loft_since").isNotNull() & F.col("loft_since").try_cast("date").isNull()))
    problem = F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))
    sound = F.col("problem").isNull()
    typed = forms.withColumn("problem", problem)
    kept = lambda value, kind: F.when(sound, value).cast(kind)
    window = F.coalesce(_number("window_days"), F.lit(HOME_DEFAULTS["window_days"])).cast("int")
    shorter = F.filter(F.array(*map(F.lit, (*SHORT_WINDOWS, 365))), lambda w: w < window)
    return typed.select(
        *by,
        kept(F.coalesce("timezone", F.lit(HOME_DEFAULTS["timezone"])), "string").alias("zone"),
        *(kept(F.coalesce(_number(n), F.lit(HOME_DEFAULTS.get(n))), TYPES[n]).alias(n) for n in HOME_BOUNDS),
        kept(F.col("loft_since").try_cast("date"), "date").alias("loft_since"),
        *(kept(tariff_per_kwh(F.col(f"{fuel}_tariff"), F.col(f"{fuel}_unit")), "double").alias(f"{fuel}_rate") for fuel in ("gas", "power")),
        F.when(sound, F.concat(shorter, F.array(window))).alias("windows"),
        "problem",
    )
