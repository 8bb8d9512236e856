"""From the two cleaned series to model-ready train and test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast import fixed
from slotcast.functions.calendar import with_calendar, with_flags
from slotcast.functions.direction import direction_class
from slotcast.operators.combine import join_covariates
from slotcast.operators.encode import OneHot
from slotcast.operators.fold import fold_hourly
from slotcast.operators.scaling import GroupImputeGlobalScale, GroupImputeGlobalScaleModel, Standardiser, StandardiserModel

PREPARATIONS = ("impute_global_scale_global", "impute_group", "impute_group_scale_global", "scale_group")


@dataclass(frozen=True)
class FeatureSet:
    factors: list[str]
    numerics: list[str]
    others: list[str]

    @property
    def variables(self) -> list[str]:
        return [*self.factors, *self.numerics, *self.others]


SCENARIOS = {number: FeatureSet(*parts) for number, parts in fixed.FEATURE_SETS.items()}
FINAL_SCENARIO = 7


def weather_features(weather: DataFrame, time: str = "datetime") -> DataFrame:
    """Covariates with calendar columns, flags and the direction class."""
    out = with_flags(with_calendar(weather, time), time)
    return out.withColumn("rose_vt", direction_class(F.col("vt_dir")))


def training_table(load: DataFrame, weather: DataFrame, required: list[str], keep_levels: bool = False,
                   on_duplicate: str = "error") -> DataFrame:
    """Folded series joined to the slot covariates, without slots that lack a required target."""
    slots = fold_hourly(load, on_duplicate=on_duplicate, keep_levels=keep_levels)
    return join_covariates(slots, weather, required=required)


def project(df: DataFrame, features: FeatureSet, extra: list[str] | None = None) -> DataFrame:
    """The time, any extra columns and the variables of a feature set."""
    return df.select("datetime", *(extra or []), *features.variables)


def union_of(sets: list[FeatureSet]) -> FeatureSet:
    """All variables of several feature sets; a variable in two roles is listed once, as factor."""
    factors = list(dict.fromkeys(v for s in sets for v in s.factors))
    numerics = list(dict.fromkeys(v for s in sets for v in s.numerics))
    others = list(dict.fromkeys(v for s in sets for v in s.others if v not in factors))
    return FeatureSet(factors, numerics, others)


def _scaler(preparation: str, numerics: list[str], by: list[str] | None, within: list[str] | None = None) -> Standardiser | GroupImputeGlobalScale:
    by = ["Month", "Hour"] if by is None else by
    within = within or []
    if preparation == "impute_global_scale_global":
        return Standardiser(numerics, within)
    if preparation == "impute_group":
        # models can not take what a group leaves unknown, and 0 is no mean here
        return GroupImputeGlobalScale(numerics, by, rescale=False, within=within)
    if preparation == "impute_group_scale_global":
        return GroupImputeGlobalScale(numerics, by, within=within)
    if preparation == "scale_group":
        return Standardiser(numerics, [*within, *by])
    raise ValueError(f"preparation is one of {PREPARATIONS}")


def fitted_scaler(train: DataFrame, numerics: list[str], preparation: str, by: list[str] | None = None,
                  within: list[str] | None = None) -> StandardiserModel | GroupImputeGlobalScaleModel:
    """The imputation and scaling of a preparation, fitted on ``train``."""
    return _scaler(preparation, numerics, by, within).fit(train)


def prepare_many(train: DataFrame, test: DataFrame, sets: dict[int, FeatureSet], preparation: str = "scale_group",
                 by: list[str] | None = None, within: list[str] | None = None) -> tuple[DataFrame, DataFrame, dict[int, list[str]]]:
    """Impute, scale and one-hot encode for several feature sets at once; everything is fitted
    on ``train``, separately for each value of the ``within`` columns (say, the repeats of a split) but in one pass. Returns both
    tables and the model columns of each set, in order."""
    every = union_of(list(sets.values()))
    fitted = fitted_scaler(train, every.numerics, preparation, by, within)
    encoder = OneHot(every.factors, remove=False).fit(train)

    def columns(features: FeatureSet) -> list[str]:
        flags = [column for (variable, _), column in encoder.names.items() if variable in features.factors]
        return [*[c for c in features.numerics if c in fitted.columns], *flags, *features.others]

    # the group columns may be factors too: scale first, encode afterwards
    return (
        encoder.transform(fitted.transform(train)),
        encoder.transform(fitted.transform(test)),
        {number: columns(features) for number, features in sets.items()},
    )


def prepare(train: DataFrame, test: DataFrame, features: FeatureSet, preparation: str = "scale_group",
            by: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """:func:`prepare_many` for one feature set."""
    ready, asked, columns = prepare_many(train, test, {0: features}, preparation, by)
    return ready, asked, columns[0]
