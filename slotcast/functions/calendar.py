"""Calendar features and flags derived from a time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast import fixed


def _pick(names: list[str], position: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(names)), ","), position)


def weekday_name(stamp: Column, abbreviated: bool = False) -> Column:
    names = [n[:3] for n in fixed.WEEKDAYS] if abbreviated else fixed.WEEKDAYS
    return _pick(names, F.dayofweek(stamp))


def month_name(stamp: Column, abbreviated: bool = False) -> Column:
    names = [n[:3] for n in fixed.MONTHS] if abbreviated else fixed.MONTHS
    return _pick(names, F.month(stamp))


def level_rank(value: Column, levels: list[str]) -> Column:
    """One-based place of a factor level; NULL for text outside the levels."""
    place = F.array_position(F.split(F.lit(",".join(levels)), ","), value)
    return F.when(place > 0, place.cast("int"))


def is_weekend(stamp: Column) -> Column:
    return F.dayofweek(stamp).isin(1, 7)


def is_holiday_date(stamp: Column) -> Column:
    keys = [int(text[3:]) * 100 + int(text[:2]) for text in fixed.HOLIDAYS]
    return (F.month(stamp) * 100 + F.dayofmonth(stamp)).isin(keys)


def holiday_flag(stamp: Column, mode: str = "all") -> Column:
    """1 for a holiday. ``mode="all"`` wants a fixed holiday that is also a weekend day;
    ``mode="any"`` takes either."""
    if mode == "all":
        flag = is_holiday_date(stamp) & is_weekend(stamp)
    elif mode == "any":
        flag = is_holiday_date(stamp) | is_weekend(stamp)
    else:
        raise ValueError("mode is 'all' or 'any'")
    return flag.cast("int")


def is_summer(stamp: Column) -> Column:
    return F.month(stamp).between(fixed.SUMMER_FIRST_MONTH, fixed.SUMMER_LAST_MONTH)


def season(stamp: Column) -> Column:
    # NULL stamps have no season
    return F.when(is_summer(stamp), "summer").when(~is_summer(stamp), "winter")


def evening_flag(stamp: Column) -> Column:
    starts = F.when(is_summer(stamp), fixed.EVENING_HOUR["summer"]).otherwise(fixed.EVENING_HOUR["winter"])
    return (F.hour(stamp) >= starts).cast("int")


def midnight_flag(stamp: Column) -> Column:
    return (F.hour(stamp) <= fixed.MIDNIGHT_LAST_HOUR).cast("int")


def hour_label(stamp: Column) -> Column:
    label = F.concat(F.lit("H"), F.hour(stamp).cast("string"))
    return F.when(label.isin(fixed.HOUR_LABELS), label)


def with_calendar(df: DataFrame, time: str = "datetime", abbreviated: bool = False) -> DataFrame:
    """Add Weekday, Day, Month, Year and Hour."""
    stamp = F.col(time)
    return df.withColumns({
        "Weekday": weekday_name(stamp, abbreviated),
        "Day": F.dayofmonth(stamp),
        "Month": month_name(stamp, abbreviated),
        "Year": F.year(stamp),
        "Hour": F.hour(stamp),
    })


def with_flags(df: DataFrame, time: str = "datetime", holiday_mode: str = "all") -> DataFrame:
    """Add weekend, holiday, season, evening, midnight and hour-label columns."""
    stamp = F.col(time)
    return df.withColumns({
        "f_weekend": is_weekend(stamp),
        "f_ferie": holiday_flag(stamp, holiday_mode),
        "f_season": season(stamp),
        "f_evening": evening_flag(stamp),
        "f_midnight": midnight_flag(stamp),
        "f_hour": hour_label(stamp),
    })
