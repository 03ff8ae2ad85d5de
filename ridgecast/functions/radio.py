"""Link budget, losses and radio profile rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an empty profile field becomes, fixed values (the gap factor is no profile field of its own).
DEFAULTS = {
    "cap_db": 138.0, "tx_power_dbm": 47.0, "tx_gain_dbd": 0.0, "rx_sens_dbm": -119.0, "rx_gain_dbd": 2.0, "digi_height_m": 20.0, "igate_height_m": 3.0, "target_height_m": 2.0, "freq_mhz": 144.39,
    "n_radials": 1080, "floor_db": 0.0, "max_db": 30.0, "dem_max_px": 2500, "climate": 4, "refractivity": 301.0, "conductivity": 0.001, "permittivity": 15.0, "polarization": 1, "gap_fill_factor": 0.25,
}
#: Values of earlier releases that are lifted to the present default.
MIGRATED = {"cap_db": 148.0, "n_radials": 720}
#: Field, lowest and highest allowed value, fixed values.
RANGES = [
    ("cap_db", 80, 200), ("tx_power_dbm", 0, 80), ("tx_gain_dbd", -20, 30), ("rx_sens_dbm", -160, -50), ("rx_gain_dbd", -20, 30), ("digi_height_m", 0.1, 500), ("igate_height_m", 0.1, 500), ("target_height_m", 0.1, 100),
    ("freq_mhz", 20, 1000), ("n_radials", 90, 2880), ("floor_db", -30, 20), ("max_db", 0, 100), ("dem_max_px", 500, 6000), ("climate", 1, 7), ("refractivity", 200, 450), ("conductivity", 1e-6, 1), ("permittivity", 1, 100), ("polarization", 0, 1),
]
#: Fields whose lowest value is itself not allowed, and fields of whole numbers only.
OPEN_BELOW, WHOLE = {"max_db"}, {"polarization"}
CUSTOM_RX_DB, CUSTOM_RX_GAIN, CUSTOM_RESERVE = 119.0, 2.0, 20.0


def watts_to_dbm(watts: Column) -> Column:
    return 10 * F.log10(watts * 1000)


def effective_budget_db(tx: Column, tx_gain: Column, rx_sens: Column, rx_gain: Column, cap: Column) -> Column:
    """The link budget, never over the cap; the cap alone when no radio figure is given."""
    given = (tx != 0) | (tx_gain != 0) | (rx_sens != 0) | (rx_gain != 0)
    return F.when(given, F.least(tx + F.abs(rx_sens) + tx_gain + rx_gain, cap)).otherwise(cap)


def custom_budget_db(tx_dbm: Column, gain: Column) -> Column:
    return tx_dbm + CUSTOM_RX_DB + gain + CUSTOM_RX_GAIN - CUSTOM_RESERVE


def fspl_db(distance_m: Column, freq_mhz: Column) -> Column:
    """Free-space path loss; nearer than a metre counts as a metre."""
    return 32.45 + 20 * F.log10(F.greatest(distance_m, F.lit(1.0)) / 1000) + 20 * F.log10(freq_mhz)


def link_margin_db(budget: Column, loss: Column) -> Column:
    return budget - loss


def antenna_height(kind: Column, digi_m: Column, igate_m: Column) -> Column:
    return F.when(kind == "digi", digi_m).otherwise(igate_m)


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Profiles with every known field filled and old defaults migrated."""
    out = profiles
    for name, default in DEFAULTS.items():
        value = F.col(name) if name in profiles.columns else F.lit(None).cast("double")
        if name in MIGRATED:
            value = F.when(value == MIGRATED[name], F.lit(default)).otherwise(value)
        out = out.withColumn(name, F.coalesce(value, F.lit(default)))
    return out


def range_violations(region: tuple[str, str, str] | None = None, ranges=RANGES, floor: str | None = None, ceiling: str | None = None) -> Column:
    """The names of the fields out of range, in order; region names latitude, longitude and radius columns."""

    def allowed(name: str, low: float, high: float) -> Column:
        value = F.col(name)
        inside = value.between(F.lit(float(low)), F.lit(float(high)))
        if name in OPEN_BELOW:
            inside &= value > low
        if name in WHOLE:
            inside &= value == F.floor(value)
        return F.coalesce(inside, F.lit(False))

    checks = [F.when(~allowed(n, lo, hi), F.lit(n)) for n, lo, hi in ranges]
    if region:
        lat, lon, radius = region
        checks += [F.when(~F.coalesce(F.col(lat).between(-90, 90), F.lit(False)), F.lit(lat)), F.when(~F.coalesce(F.col(lon).between(-180, 180), F.lit(False)), F.lit(lon)), F.when(~F.coalesce(F.col(radius) > 0, F.lit(False)), F.lit(radius))]
    if floor and ceiling:
        checks.append(F.when(~F.coalesce(F.col(floor) < F.col(ceiling), F.lit(False)), F.lit(f"{floor} < {ceiling}")))
    return F.array_compact(F.array(*checks))
