"""Weather features: rolling state of the observations, then the latest one per movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions import scalars as S
from rampwise.functions.clock import micros
from rampwise.operators import asof, trailing

REPORT_COLUMNS = ["station", "valid", "tmpc", "dwpc", "vsby", "sknt", "drct", "p01i", "wxcodes"]
# Present-weather codes that matter for de-icing.
SPELL_CODES = ("SN", "FZ")
INSTANT_CODES = ("SN", "FZ", "PL", "GS")


def observations(reports: DataFrame) -> DataFrame:
    """Typed observations from all-text reports; `M` is missing, `T` a trace of precipitation."""
    number = lambda c: S.parse_sentinel(c, {"M": None})
    return reports.where(F.col("valid").isNotNull()).select(
        F.col("station").alias("site"), S.parse_instant("valid", "yyyy-MM-dd HH:mm").alias("t"),
        number("tmpc").alias("temp_c"), number("dwpc").alias("dewp_c"), number("vsby").alias("vis_mi"),
        number("sknt").alias("wind_kt"), S.parse_sentinel("p01i", {"T": 0.001, "M": None}).alias("precip_in"),
        F.coalesce("wxcodes", F.lit("M")).alias("wx"))


def rolling_state(obs: DataFrame, cold: float = 3.0, spell_codes=SPELL_CODES, form: str = "scaled") -> DataFrame:
    """(site, t_us, cumulative columns) per distinct observation instant."""
    rain = F.coalesce("precip_in", F.lit(0.0))
    freezing = F.col("temp_c") <= cold
    risk = freezing & ((rain > 0) | S.coded_flag("wx", spell_codes))
    rolled = trailing.rolling(obs, "site", "t", {
        "precip_6h": ("sum", rain, 21_600), "precip_12h": ("sum", rain, 43_200),
        "precip_cold_12h": ("sum", F.when(freezing, rain).otherwise(0.0), 43_200),
        "deice_frac_6h": ("avg", F.when(risk, 1.0).otherwise(0.0), 21_600),
        "temp_min_12h": ("min", F.col("temp_c"), 43_200), "vis_min_3h": ("min", F.col("vis_mi"), 10_800),
        "vis_mean_3h": ("avg", F.col("vis_mi"), 10_800)}, form)
    return rolled.join(trailing.last_when(obs, "site", "t", F.col("temp_c") > 0, "last_thaw", form), ["site", "t_us"])


def weather_features(movements: DataFrame, obs: DataFrame, max_age_min: float = 90, cold: float = 3.0, low_vis: float = 1.5,
                     tie: str | None = None, spell_codes=SPELL_CODES, instant_codes=INSTANT_CODES,
                     snow: str = "SN", freezing: str = "FZ", form: str = "fine") -> DataFrame:
    """(id, wx_*): 18 columns from the latest observation at or before the finish time.

    Null where that observation is older than `max_age_min` minute boundaries.  A site that was never
    above freezing reads 240 hours since thaw.
    """
    known = obs.withColumn("t_us", micros(obs, "t")).where(F.col("t_us").isNotNull())
    rolled = rolling_state(obs, cold, spell_codes, form)
    wx, rain = F.col("wx"), F.coalesce("precip_in", F.lit(0.0))
    is_cold = F.col("temp_c") <= cold
    enriched = known.join(rolled, ["site", "t_us"]).select(
        "site", "t_us", *([tie] if tie else []), "temp_c", "vis_mi", "wind_kt", "precip_in",
        (F.col("temp_c") - F.col("dewp_c")).alias("spread_c"), S.flag(is_cold).alias("cold"),
        S.flag(is_cold & ((rain > 0) | S.coded_flag(wx, instant_codes))).alias("deice_risk"),
        S.flag(F.col("vis_mi") < low_vis).alias("lowvis"), S.flag(wx.contains(snow)).alias("snow"),
        S.flag(wx.contains(freezing)).alias("freezing"), "precip_6h", "precip_12h", "precip_cold_12h", "deice_frac_6h",
        "temp_min_12h", "vis_min_3h", "vis_mean_3h",
        S.capped(S.minutes_crossed("t_us", "last_thaw") / 60, 240).alias("hrs_since_thaw"))
    bring = [c for c in enriched.columns if c not in ("site", "t_us", tie)]
    moves = movements.select("id", "site", micros(movements, "fin").alias("fin_us"))
    linked = asof.asof_left(moves, enriched, ["site"], "fin_us", "t_us", bring, tie, form)
    fresh = S.null_if_stale(linked, S.minutes_crossed("fin_us", "asof_t"), max_age_min, bring)
    return fresh.select("id", *[F.col(c).alias(f"wx_{c}") for c in bring])


def summary(features: DataFrame) -> DataFrame:
    """Rows, rows with an observation, and the shares of its flags in percent."""
    pct = lambda c: (100 * F.avg(c)).alias(f"pct_{c[3:]}")
    return features.agg(
        F.count(F.lit(1)).alias("n"), F.count("wx_temp_c").alias("usable"), F.avg("wx_temp_c").alias("mean_temp_c"),
        F.avg("wx_vis_mi").alias("mean_vis_mi"), *[pct(c) for c in ("wx_cold", "wx_deice_risk", "wx_lowvis", "wx_snow")])
