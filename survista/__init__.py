"""Mortality experience analytics on Spark: A/E, models, diagnosis, simulation over lives as DataFrames."""

from survista.functions.clicks import Instant, Span, instant, span
from survista.operators.aev import Aev, aev, create_aev, is_aev
from survista.operators.batch import batch, element, union_of
from survista.operators.compare import best_fit, compare_models, diagnose, diagnose_settings, is_diagnosis, is_model_comparison, measure_overdispersion
from survista.operators.covariates import covariates, disjoint, is_covariates, is_disjoint, is_model, model
from survista.operators.fit import coef, fit, is_fit, vcov
from survista.operators.include import (
    age,
    ages,
    band,
    bands,
    categories,
    category,
    duration,
    durations,
    include,
    includes,
    indicator,
    is_include,
    is_includes,
    is_indicator,
    is_static_variable,
    is_variable,
    logical_value,
    period,
    period_included,
    periods,
    static_variable,
    value,
    variable,
)
from survista.operators.mortality import default_mortality, end_age, gompertz_mortality, is_mortality, log_mu, mortality, mortality_const, mortality_table
from survista.operators.settings import Settings, is_settings, settings
from survista.operators.simulate import simulate
from survista.plans.expr import b, i, parse, pronouns, t, x
from survista.sources.data import ExpData, ValData, as_at, as_times, exp_data, exp_end, exp_start, is_exp_data, is_val_data, val_data, val_from_exp_data
