"""Declared schemas of the logical tables, and small checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepfall.constants import FORBIDDEN_COLUMNS

_S, _I, _L, _D, _B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                      T.BooleanType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_ATTRIBUTES = dict(os=_S, device_type=_S, device_age_months=_I, geo=_S, channel=_S,
                   is_returning=_B)

EVENTS = _struct(
    user_id=_S, session_id=_S, event_ts=T.TimestampNTZType(), event_name=_S, screen=_S,
    **_ATTRIBUTES, latency_ms=_I, is_crash=_B, payment_method=_S, instance_id=_S)

USERS = _struct(user_id=_S, **_ATTRIBUTES, acquired_ts=T.TimestampNTZType(), instance_id=_S)

CASES = _struct(
    instance_id=_S, base_date=T.DateType(), window_days=_I, changepoint_day=_I,
    is_confounder_trap=_B, is_simpson=_B, severity_pp_target=_D)

TASK = _struct(
    instance_id=_S, question=_S, funnel=_S, window_days=_I, changepoint_day=_I,
    cohort_whitelist_columns=T.ArrayType(_S), output_contract=_S)

DICTIONARY = _struct(event_name=_S, status=_S, description=_S)

SURFACE_FORMS = _struct(name=_S, canonical=_S, fires=_B, documented=_B, status=_S, weight=_D)

EVIDENCE = _struct(claim=_S, sql=_S, result_summary=_S)

HYPOTHESES = _struct(
    system=_S, instance_id=_S, rank=_I, mechanism_type=_S, mechanism=_S, affected_cohort=_S,
    evidence=T.ArrayType(EVIDENCE), confidence=_D, confounders_considered=T.ArrayType(_S))

COHORT_CLAUSES = _struct(
    claim_id=_S, disjunct_id=_I, clause_id=_I, column=_S, op=_S, str_value=_S, num_value=_D)

GOLD = _struct(
    instance_id=_S, seed=_L, has_fault=_B, fault_type=_S, affected_user_ids=T.ArrayType(_S),
    affected_cohort_predicate=_S, severity_pp_target=_D, severity_pp_realised=_D,
    confounder_type=_S, is_confounder_trap=_B, is_simpson=_B, decoy_screens=T.ArrayType(_S),
    acceptable_mechanisms=T.ArrayType(_S), changepoint_day=_I,
    persona_mix=T.MapType(_S, _D), notes=_S)


GOLD_USERS = _struct(instance_id=_S, user_id=_S)

PERSONAS = _struct(instance_id=_S, user_id=_S, persona=_S)

INDEX = _struct(instance_id=_S, base_date=T.DateType(), published=_B)


class ForbiddenColumns(ValueError):
    """A table meant for the public root carries answer columns."""


def forbidden_in(df: DataFrame, forbidden=FORBIDDEN_COLUMNS) -> list[str]:
    """Answer columns present in ``df`` (reads the schema only, runs no job)."""
    return sorted(set(df.columns) & set(forbidden))


def require_public(name: str, df: DataFrame, forbidden=FORBIDDEN_COLUMNS) -> DataFrame:
    found = forbidden_in(df, forbidden)
    if found:
        raise ForbiddenColumns(f"{name} exposes {', '.join(found)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to ``schema``; columns outside it are dropped, missing ones raise."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields))
