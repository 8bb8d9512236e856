"""Labels of runs: time, job and error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd_HHmm")


def job_name(path: Column) -> Column:
    """The file name without folders and extension."""
    return F.try_element_at(F.split(path, "[/.]"), F.lit(-2))


def run_label(time: Column, path: Column, error: Column) -> Column:
    return F.format_string("%s_%s_%.3f", run_stamp(time), job_name(path), error)
