"""Features and scores that need only the row itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Upper edges (inclusive) and names of the amount bands.
AMOUNT_BANDS = (
    (1_000.0, "0-1k"),
    (5_000.0, "1k-5k"),
    (10_000.0, "5k-10k"),
    (25_000.0, "10k-25k"),
    (50_000.0, "25k-50k"),
    (100_000.0, "50k-100k"),
)
AMOUNT_BAND_TOP = "100k+"
AMOUNT_BAND_NONE = "nan"
AMOUNT_BAND_FLOOR = -1.0

# Device brand, words found anywhere in the lower-cased model, words it starts with.
# The first brand that fits wins.
BRANDS = (
    ("iPhone", ("iphone",), ()),
    ("Samsung", ("samsung",), ("sm-",)),
    ("Xiaomi", ("redmi", "xiaomi"), ("mi ",)),
    ("Huawei", ("huawei",), ("hua",)),
    ("Oppo", ("oppo",), ()),
    ("Vivo", ("vivo",), ()),
    ("Realme", ("realme",), ()),
    ("Google", ("google", "pixel"), ()),
    ("OnePlus", ("oneplus",), ()),
    ("LG", ("lg",), ()),
    ("Honor", ("honor",), ()),
    ("TCL", ("tcl",), ()),
)
BRAND_MISSING, BRAND_OTHER = "Unknown", "Other"

# Label put in place of a missing day type, by variant.
DAY_TYPE_FILL = {"normal": "Normal", "unknown": "Unknown"}

# What the history columns are when a request does not send them.
HISTORY_DEFAULT, HISTORY_RATIO_DEFAULT = 0.0, 1.0


def amount_log(amount: Column) -> Column:
    return F.log1p(F.greatest(amount, F.lit(0.0)))


def amount_bucket(amount: Column) -> Column:
    band = F.when(amount.isNull() | F.isnan(amount) | (amount <= AMOUNT_BAND_FLOOR), AMOUNT_BAND_NONE)
    for edge, name in AMOUNT_BANDS:
        band = band.when(amount <= edge, name)
    return band.otherwise(AMOUNT_BAND_TOP)


def is_round_amount(amount: Column) -> Column:
    return (amount % 100 == 0).cast("int")


def amount_cents(amount: Column) -> Column:
    return F.pmod(F.rint(amount * 100).cast("bigint"), F.lit(100))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def day_type_clean(day_type: Column, variant: str = "unknown") -> Column:
    return F.coalesce(day_type, F.lit(DAY_TYPE_FILL[variant]))


def is_holiday(day_type: Column) -> Column:
    return day_type.isNotNull().cast("int")


def crossed(left: Column, right: Column) -> Column:
    """Two columns as one text, missing parts spelled ``None``."""
    text = [F.coalesce(c.cast("string"), F.lit("None")) for c in (left, right)]
    return F.concat_ws("_", *text)


def device_brand(model: Column) -> Column:
    low = F.lower(model)
    out = F.when(model.isNull(), BRAND_MISSING)
    for brand, words, starts in BRANDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        for w in starts:
            hit = hit | low.startswith(w)
        out = out.when(hit, brand)
    return out.otherwise(BRAND_OTHER)


@dataclass(frozen=True)
class RowColumns:
    """Input columns of the row features; leave a name out to skip what depends on it."""

    amount: str | None = "TransactionAmount"
    ts: str | None = "TransactionDate"
    day_type: str | None = "DayType"
    os: str | None = "DeviceOSName"
    flags: tuple[tuple[str, str], ...] = (
        ("os_l1h", "HasMobileActivationL1H"),
        ("os_l8h", "HasMobileActivationL8H"),
    )
    model: str | None = "DeviceModel"


def add_row_features(df: DataFrame, cols: RowColumns = RowColumns(), day_type_variant: str = "unknown") -> DataFrame:
    """All row features in one projection."""
    new: dict[str, Column] = {}
    if cols.model:
        new["DeviceParentBrand"] = device_brand(F.col(cols.model))
    if cols.amount:
        amount = F.col(cols.amount)
        new["amount_log"] = amount_log(amount)
        new["amount_bucket"] = amount_bucket(amount)
        new["is_round_amount"] = is_round_amount(amount)
        new["amount_cents"] = amount_cents(amount)
    if cols.ts:
        ts = F.col(cols.ts)
        new["hour"], new["dow"], new["is_weekend"] = hour_of_day(ts), day_of_week(ts), is_weekend(ts)
    if cols.day_type:
        new["DayType_clean"] = day_type_clean(F.col(cols.day_type), day_type_variant)
        new["is_holiday"] = is_holiday(F.col(cols.day_type))
    if cols.os:
        for name, flag in cols.flags:
            new[name] = crossed(F.col(cols.os), F.col(flag))
    return df.withColumns(new)


# -- rule score --------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleColumns:
    l1h: str = "HasMobileActivationL1H"
    l8h: str = "HasMobileActivationL8H"
    os: str = "DeviceOSName"
    fractional: str = "IsFractionalAmount"
    tx_type: str = "TransactionType"
    segment: str = "CustomerSegment"
    amount: str = "TransactionAmount"


# Weight of each rule, the risky segments, and the log-amount that counts as full.
RULE_WEIGHTS = {
    "l1h": 0.4,
    "l8h": 0.2,
    "android": 0.15,
    "fractional": 0.1,
    "eft": 0.1,
    "segment": 0.05,
    "amount": 0.05,
}
RISKY_SEGMENTS = ("P", "Y", "KP", "A1")
FULL_LOG_AMOUNT = 12.0


def weighted_rules(rules: Sequence[tuple[Column, float]]) -> Column:
    """Sum of weights of (condition or number, weight) pairs, kept in [0, 1]; missing counts as 0."""
    total = F.lit(0.0)
    for value, weight in rules:
        total = total + F.lit(weight) * F.coalesce(value.cast("double"), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def rule_score(cols: RuleColumns = RuleColumns(), eft: str = "Eft", android: str = "Android") -> Column:
    share = F.log1p(F.greatest(F.col(cols.amount), F.lit(0.0))) / FULL_LOG_AMOUNT
    w = RULE_WEIGHTS
    return weighted_rules(
        [
            (F.col(cols.l1h) == 1, w["l1h"]),
            (F.col(cols.l8h) == 1, w["l8h"]),
            (F.col(cols.os) == android, w["android"]),
            (F.col(cols.fractional), w["fractional"]),
            (F.col(cols.tx_type) == eft, w["eft"]),
            (F.col(cols.segment).isin(*RISKY_SEGMENTS), w["segment"]),
            (F.least(share, F.lit(1.0)), w["amount"]),
        ]
    )


# -- bands and actions ----------------------------------------------------------------------------

# Default cut-offs, and what is done with each band.
DEFAULT_CUTOFFS = {"HIGH": 0.95, "MEDIUM": 0.5}
BAND_ACTIONS = {"HIGH": "BLOCK_OR_STEP_UP", "MEDIUM": "MANUAL_REVIEW", "LOW": "ALLOW"}


def add_bands(df: DataFrame, score: str, cutoffs: Mapping[str, float] | None = None) -> DataFrame:
    """Band, the cut-off it was compared with, the decision and the action."""
    cut = {**DEFAULT_CUTOFFS, **(cutoffs or {})}
    s = F.col(score)
    band = F.when(s >= cut["HIGH"], "HIGH").when(s >= cut["MEDIUM"], "MEDIUM").otherwise("LOW")
    used = F.when(s >= cut["HIGH"], cut["HIGH"]).otherwise(cut["MEDIUM"])
    out = df.withColumns({"risk_band": band, "threshold_used": used})
    action = F.lit(None).cast("string")
    for name, act in BAND_ACTIONS.items():
        action = F.when(F.col("risk_band") == name, act).otherwise(action)
    return out.withColumns({"is_fraud": F.col("risk_band").isin("HIGH", "MEDIUM"), "action": action})


def expand_history(df: DataFrame, names: Sequence[str], prior: float, source: str = "historical_features") -> DataFrame:
    """One column per name from a map column; what a request did not send gets its neutral value."""

    def default(name: str) -> float:
        if name.endswith("_ratio_to_mean"):
            return HISTORY_RATIO_DEFAULT
        return prior if "fraud_rate" in name else HISTORY_DEFAULT

    sent = F.col(source)
    cols = {n: F.coalesce(F.try_element_at(sent, F.lit(n)), F.lit(default(n))) for n in names}
    return df.withColumns(cols).drop(source)


# -- feature selection ----------------------------------------------------------------------------


def feature_columns(df: DataFrame, roles: Mapping[str, str], drop_demographic: bool = False) -> tuple[list[str], list[str]]:
    """(numeric, text) columns a model may learn from: those without a role, by type.

    A column with a role (key, name, time, label, raw) is no feature; a demographic one is, unless left out.
    """
    learned = ("feature",) if drop_demographic else ("feature", "demographic")
    fields = [f for f in df.schema.fields if roles.get(f.name, "feature") in learned]
    text = [f.name for f in fields if isinstance(f.dataType, StringType)]
    return [f.name for f in fields if f.name not in text], text
