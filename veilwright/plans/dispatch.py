"""One entry point for all models, and one for the reports on classes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilwright.functions.chance import Chance
from veilwright.plans import classbased as models
from veilwright.plans.fulldomain import full_domain
from veilwright.plans.noisy import differential_privacy
from veilwright.spec import PrivacyRequest


def _share_deleted(df: DataFrame, r: PrivacyRequest) -> DataFrame:
    """A share of the rows of violating classes goes, or noise is added."""
    common = {
        "rules": r.rules,
        "threshold": r.threshold,
        "key": r.key,
        "seed": r.seed,
        "strict": r.strict,
        "style": r.style,
        "order_col": r.order_col,
    }
    two_phase = common | {"checkpoint": r.checkpoint}
    if r.model == "k-anonymity":
        return models.k_anonymity(df, r.qis, r.k, **common)
    if r.model == "l-diversity":
        return models.l_diversity(df, r.qis, r.sensitive[0], r.k, r.l, **two_phase)
    if r.model == "t-closeness":
        return models.t_closeness(df, r.qis, r.sensitive[0], r.k, r.t, distance=r.distance, **two_phase)
    if r.model == "km-anonymity":
        return models.km_anonymity(df, r.qis, r.sensitive, r.k, r.m, **two_phase)
    return differential_privacy(
        df,
        r.qis,
        r.epsilon,
        r.rules,
        budget=r.budget,
        threshold=r.threshold,
        delta=r.delta,
        sensitive=r.sensitive,
        variant=r.variant,
        order_col=r.order_col,
        chance=Chance(r.noise, r.seed, r.key),
    )


def _classes_removed(df: DataFrame, r: PrivacyRequest) -> DataFrame:
    """Violating classes go whole."""
    common = {"rules": r.rules, "order_col": r.order_col, "style": r.style}
    if r.model == "k-anonymity":
        return models.k_anonymity_strict(df, r.qis, r.k, importance=r.importance, **common)
    if r.model == "l-diversity":
        return models.l_diversity_strict(df, r.qis, r.sensitive[0], r.k, r.l, **common)
    if r.model == "t-closeness":
        return models.t_closeness_strict(df, r.qis, r.sensitive[0], r.k, r.t, **common)
    return models.km_anonymity_strict(df, r.qis, r.sensitive[0], r.k, r.m, **common)


def _grouped(df: DataFrame, r: PrivacyRequest) -> DataFrame:
    """Values are looked up, large classes kept, and sensitive values of poor ones overwritten."""
    if r.model == "k-anonymity":
        return models.k_anonymity_by_groups(df, r.qis, r.k, r.mappings)
    return models.l_diversity_suppress(df, r.qis, r.sensitive[0], r.k, r.l, r.mappings)


def _sized(df: DataFrame, r: PrivacyRequest) -> DataFrame:
    return models.t_closeness_l1(
        df, r.qis, r.sensitive[0], r.k, r.t, r.rules, r.threshold, r.key, r.seed, r.strict, r.checkpoint
    )


def _reported(df: DataFrame, r: PrivacyRequest) -> tuple[DataFrame, DataFrame]:
    common = {"rules": r.rules, "order_col": r.order_col, "style": r.style}
    if r.model == "l-diversity":
        return models.l_diversity_report(df, r.qis, r.sensitive[0], r.l, **common)
    return models.t_closeness_report(df, r.qis, r.sensitive[0], r.t, **common)


_TREATED = {
    "share": _share_deleted,
    "classes": _classes_removed,
    "cells": lambda df, r: models.k_anonymity_local(df, r.qis, r.k, r.rules, r.order_col, r.style),
    "keys": lambda df, r: models.k_anonymity_keys(df, r.qis, r.k),
    "new_nulls": lambda df, r: models.k_anonymity_new_nulls(df, r.qis, r.k, r.rules, r.order_col, r.importance),
    "groups": _grouped,
    "levels": lambda df, r: full_domain(df, r.qis, r.k, r.threshold),
    "sized": _sized,
    "report": lambda df, r: _reported(df, r)[0],
}


def anonymize(df: DataFrame, request: PrivacyRequest) -> DataFrame:
    """The plan a request describes.  Raises ``ValueError`` for a request that cannot be served.

    The threshold is the share of violating rows that is deleted, with the treatment ``levels`` the share of rows that
    may be.  With ``report`` the table is generalised and keeps all rows; ``report_classes`` gives the findings.
    """
    request.validate(df.columns)
    return _TREATED[request.treatment](df, request)


def report_classes(df: DataFrame, request: PrivacyRequest) -> DataFrame:
    """What a request with the treatment ``report`` finds: the diversity of every class (l-diversity), or the classes
    that are too far from the table and their distance (t-closeness)."""
    request.validate(df.columns)
    if request.treatment != "report":
        raise ValueError(f"the treatment {request.treatment!r} has no report on classes")
    return _reported(df, request)[1]
