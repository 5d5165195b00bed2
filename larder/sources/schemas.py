"""Explicit schemas of the survey tables. Nothing is inferred from a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from larder import params

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DIARY = _table(interview_id=_S, day=_I, coicop4=_I, coicop=_I, unit=_I, quantity=_D)
EDIBLE_PORTIONS = _table(item_code=_I, edible_portion=_D)
ROSTER = _table(hhid=_S, interview_id=_S, roster_id=_I, adm1=_I, sex=_I, month_birth=_D, year_birth=_D,
                age=_D, survey_wgt=_D, popweight=_D, res=_I, hh_size=_I, adult_equiv=_D)
CONSUMPTION_AGGREGATES = _table(interview_id=_S, date=_S, exp_aeq_month=_D, cons_aeq_adj=_D, cons_decile=_I)
HH_INFORMATION = _table(survey=_S, hhid=_S, iso3=_S, zone=_S, adm1=_S, adm2=_S, ea=_S, res=_S,
                        sep_quintile=_I, res_quintile=_I, year=_I, month=_I, survey_wgt=_D, afe=_D,
                        pc_expenditure=_D)
FOOD_CONSUMPTION = _table(iso3=_S, survey=_S, hhid=_S, item_code=_I, quantity_g=_D, quantity_100g=_D)
FOOD_GROUPS = _table(item_code=_I, food_group=_S)
CHILDREN = _table(v001=_I, v002=_I, v005=T.LongType(), v024=_I, v008=_I, v008a=_I, b3=_I, b5=_I, b19=_I,
                  h33d=_I, h33m=_I, h33y=_I, h34=_I)
REGION_LABELS = _table(code=_I, label=_S)
REGIONS = _table(adm1=_S)
REGION_ESTIMATES = _table(adm1=_S, micronutrient=_S, estimate=_D)


def fct(nutrients: Sequence[str] = tuple(params.NUTRIENTS)) -> T.StructType:
    """Food composition per 100 g; nutrients are named, never taken by position."""
    return _table(iso3=_S, survey=_S, item_code=_I, item_name=_S, **dict.fromkeys(nutrients, _D))


def intake(nutrients: Sequence[str] = tuple(params.NUTRIENTS)) -> T.StructType:
    return _table(iso3=_S, survey=_S, hhid=_S, **dict.fromkeys(nutrients, _D))
