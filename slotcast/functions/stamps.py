"""Parsing and rounding of time stamps. All functions are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_text(stamp: Column) -> Column:
    """The UTC offset after the plus sign, as ``+hh:mm``; NULL when there is none."""
    return F.concat(F.lit("+"), F.get(F.split(stamp, "[+]"), F.lit(1)))


def parse_offset_stamp(stamp: Column, align: str = "wall") -> Column:
    """Parse ``2015-09-13T00:59:59+02:00``.

    ``align="wall"`` cuts the offset off and keeps the local clock; ``align="utc"`` moves the
    stamp to UTC. Text that is no stamp gives NULL.
    """
    clock = F.try_to_timestamp(
        F.regexp_extract(stamp, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0),
        F.lit("yyyy-MM-dd'T'HH:mm:ss"),
    )
    if align == "wall":
        return clock
    if align != "utc":
        raise ValueError("align is 'wall' or 'utc'")

    def part(group: int) -> Column:
        found = F.regexp_extract(stamp, r"([+-])(\d{2}):?(\d{2})$", group)
        return F.when(found != "", found)

    minutes = part(2).cast("int") * 60 + part(3).cast("int")
    signed = F.when(part(1) == "-", -minutes).otherwise(minutes)
    return F.timestamp_add("MINUTE", -F.coalesce(signed, F.lit(0)), clock)


def parse_day_first_stamp(stamp: Column) -> Column:
    """Parse ``13/09/16 03h00``; two-digit years from 69 on belong to the 1900s."""
    parsed = F.try_to_timestamp(stamp, F.lit("d/M/yy H'h'm"))
    return F.when(F.year(parsed) >= 2069, F.timestamp_add("YEAR", F.lit(-100), parsed)).otherwise(parsed)


def round_to_hour(stamp: Column) -> Column:
    """The nearest full hour; half past rounds up."""
    return F.date_trunc("hour", F.timestamp_add("MINUTE", F.lit(30), stamp))


def shift_hours(stamp: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, stamp)


def slot_offset(stamp: Column, slot_hours: int) -> Column:
    """Hours since the start of the slot. Slots start at midnight, so their length must divide a day."""
    if slot_hours < 1 or 24 % slot_hours:
        raise ValueError("slot_hours must divide 24")
    return F.hour(stamp) % slot_hours


def slot_start(stamp: Column, slot_hours: int) -> Column:
    return shift_hours(F.date_trunc("hour", stamp), -slot_offset(stamp, slot_hours))
