"""Thresholds of the analyses; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Meter:
    max_step: float = 40.0
    max_gap_s: int = 5400
    coverage: float = 0.9


@dataclass(frozen=True)
class HeatLoss:
    min_delta_t: float = 4.0
    min_energy: float = 0.5
    min_days: int = 20
    valid_days: int = 30
    min_r2: float = 0.5
    min_spread: float = 3.0
    bounds: tuple[float, float] = (10.0, 1500.0)
    min_pairs: int = 10
    max_lag1: float = 0.9
    z: float = 1.96


@dataclass(frozen=True)
class HotWater:
    off_delta_t: float = 3.0
    off_heat_pct: float = 1.0
    min_days: int = 7
    valid_days: int = 14
    away_litres: float = 50.0
    min_away_days: int = 3
    min_rate_days: int = 10
    rate_bounds: tuple[float, float] = (0.05, 1.5)
    tank_c: float = 55.0
    mains_c: tuple[float, float] = (4.0, 16.0)
    outdoor_c: tuple[float, float] = (2.0, 18.0)


@dataclass(frozen=True)
class Cooling:
    hours: tuple[int, int] = (0, 5)
    min_points: int = 5
    max_gap_s: int = 5400
    min_delta_t: float = 3.0
    min_drop: float = 0.3
    max_heat_pct: float = 1.0
    heat_coverage: float = 0.8
    grid: tuple[float, float, float] = (1.0, 200.0, 0.25)
    min_r2: float = 0.8
    min_nights: int = 3


@dataclass(frozen=True)
class Loft:
    hours: tuple[int, int] = (1, 5)
    min_delta_t: float = 6.0
    min_rows: int = 12
    max_iqr: float = 0.5
    max_outside: float = 0.2


@dataclass(frozen=True)
class AirChange:
    min_window_s: int = 14_400
    min_excess: float = 120.0
    min_r2: float = 0.9
    noise_ppm: float = 2.0
    max_gap_s: int = 5400
    min_windows: int = 10
    bounds: tuple[float, float] = (0.05, 3.0)
    baseline_p: float = 0.02


AIR_WH_PER_M3_K = 0.335
BOILER_EFFICIENCY = 0.88


#: Bounds of a home's numbers, and what holds where one isn't given.
HOME_BOUNDS = {"floor_area_m2": (1, 2000), "ceiling_m": (1.8, 10), "outdoor_ppm": (350, 550), "away_litres": (0, 2000), "boiler_efficiency": (0.5, 1), "window_days": (30, 730)}
HOME_DEFAULTS = {"timezone": "Europe/London", "ceiling_m": 2.4, "away_litres": 50.0, "boiler_efficiency": BOILER_EFFICIENCY, "window_days": 365}
SHORT_WINDOWS = (60, 120)


@dataclass(frozen=True)
class Home:
    """Configuration of one home, with its bounds. Numbers and the date may come
    as text, as a form gives them."""

    rooms: dict[str, str]
    timezone: str = "Europe/London"
    floor_area_m2: float | None = None
    ceiling_m: float = 2.4
    outdoor_ppm: float | None = None
    away_litres: float = 50.0
    boiler_efficiency: float = BOILER_EFFICIENCY
    window_days: int = 365
    co2_series: list[str] = field(default_factory=list)
    loft_since: date | None = None

    def __post_init__(self):
        if not self.rooms:
            raise ValueError("at least one room is needed")
        if isinstance(self.co2_series, str):  # an older form has a single id
            object.__setattr__(self, "co2_series", [self.co2_series])
        for name in ("floor_area_m2", "ceiling_m", "outdoor_ppm", "away_litres", "boiler_efficiency"):
            if (value := getattr(self, name)) is not None:
                object.__setattr__(self, name, float(value))
        object.__setattr__(self, "window_days", int(float(self.window_days)))
        if isinstance(self.loft_since, str):
            object.__setattr__(self, "loft_since", date.fromisoformat(self.loft_since))
        for name, (low, high) in HOME_BOUNDS.items():
            value = getattr(self, name)
            if value is not None and not low <= float(value) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")

    def loft_cutoff(self, since: date) -> date:
        """First day of loft readings: a sensor that moved there counts from then on."""
        return max(since, self.loft_since) if self.loft_since else since

    def windows(self) -> list[int]:
        """Lookback windows to try, shortest first."""
        return [d for d in (60, 120, 365) if d < self.window_days] + [self.window_days]
