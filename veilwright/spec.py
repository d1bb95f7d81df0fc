"""Requests and rules: small driver-side values, checked before any plan is built."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

# Marker texts, model names and request defaults.
MASKED = "Masked"
UNKNOWN = "Unknown"
SUPPRESSED = "Suppressed"
STAR = "*"
GENERAL = "General Category"
GENERAL_FIRST = "通用类别"  # the same label in the first rule generation
NOT_A_DATE = "NaT"
DEFAULT_MASK = "Masked"
DEFAULT_NOISY_MASK = "***"
MODELS = ("k-anonymity", "l-diversity", "t-closeness", "km-anonymity", "differential_privacy")
DEFAULT_MODEL = "k-anonymity"
#: What is done about violating classes, and the models that can: delete a share of their rows; remove them whole; blank
#: cells; blank cells of the table as it came and keep the quasi-identifiers; remove rows that lose a cell; look values up
#: and keep large classes; raise whole columns; require sizes and then delete by aligned shares; report only.
TREATMENTS = {
    "share": MODELS,
    "classes": ("k-anonymity", "l-diversity", "t-closeness", "km-anonymity"),
    "cells": ("k-anonymity",),
    "keys": ("k-anonymity",),
    "new_nulls": ("k-anonymity",),
    "groups": ("k-anonymity", "l-diversity"),
    "levels": ("k-anonymity",),
    "sized": ("t-closeness",),
    "report": ("l-diversity", "t-closeness"),
}
DEFAULT_TREATMENT = "share"
DEFAULT_QIS = ("Gender", "Age", "Zipcode")
DEFAULT_SENSITIVE = ("Disease",)
DEFAULT_THRESHOLD = 0.3
DEFAULT_DELTA = 1e-6
DEFAULT_BUDGET = 100.0
SAMPLE_SEED = 42


@dataclass(frozen=True)
class NumberLayer:
    low: float
    high: float

    @property
    def label(self) -> str:
        return f"{self.low}-{self.high}"


@dataclass(frozen=True)
class DateLayer:
    low: datetime
    high: datetime

    @property
    def label(self) -> str:
        return f"{self.low:%Y-%m-%d} - {self.high:%Y-%m-%d}"


@dataclass(frozen=True)
class Rule:
    """One column rule.  ``flat`` rules carry a name only and take their bins from the data."""

    method: str
    number_layers: tuple[NumberLayer, ...] = ()
    date_layers: tuple[DateLayer, ...] = ()
    mask: str | None = None
    flat: bool = False
    spelled: str = ""  # the name as written: the noise models compare it case-sensitively


def _moment(text: object) -> datetime:
    if isinstance(text, datetime):
        return text.replace(tzinfo=None)
    return datetime.fromisoformat(str(text).strip().replace("/", "-")).replace(tzinfo=None)


def _finite(value: object, column: str) -> float:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValueError(f"layer bound {value!r} of column {column!r} is not a number") from None
    if math.isnan(number):
        raise ValueError(f"layer bound of column {column!r} is not a number")
    return number


def _parse_rule(column: str, raw: object) -> Rule:
    if isinstance(raw, Rule):
        return raw
    if isinstance(raw, str):
        return Rule(method=raw.lower(), flat=True, spelled=raw)
    if not isinstance(raw, Mapping):
        raise ValueError(f"rule of column {column!r} must be a name or an object")
    spelled = str(raw.get("method", ""))
    method = spelled.lower()
    layers = raw.get("layers", [])
    numbers: tuple[NumberLayer, ...] = ()
    dates: tuple[DateLayer, ...] = ()
    if method == "ordering":
        numbers = tuple(NumberLayer(_finite(x["min"], column), _finite(x["max"], column)) for x in layers)
    elif method == "dates":
        dates = tuple(DateLayer(_moment(x["min"]), _moment(x["max"])) for x in layers)
    mask = raw.get("maskingString")
    return Rule(method, numbers, dates, None if mask is None else str(mask), spelled=spelled)


def parse_rules(document: str | Mapping[str, object] | None) -> dict[str, Rule]:
    """Rules by column, from a JSON text or an already decoded object."""
    if document is None:
        return {}
    if isinstance(document, str):
        document = json.loads(document or "{}")
    return {column: _parse_rule(column, raw) for column, raw in document.items()}


def _parse_mappings(document: str | Mapping[str, object] | None) -> dict[str, Mapping[object, str]]:
    """Labels of values by column, from a JSON text or an already decoded object."""
    decoded = json.loads(document or "{}") if isinstance(document, str) else document or {}
    for column, labels in decoded.items():
        if not isinstance(labels, Mapping):
            raise ValueError(f"the mapping of column {column!r} must be an object of values and labels")
    return dict(decoded)


def _split(value: object, default: tuple[str, ...]) -> tuple[str, ...]:
    if value is None:
        return default
    if isinstance(value, str):
        return tuple(value.split(","))
    return tuple(value)  # type: ignore[arg-type]


def check_fraction(value: float, name: str = "threshold") -> float:
    value = float(value)
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie between 0 and 1, got {value}")
    return value


def check_columns(columns: Sequence[str], wanted: Sequence[str], role: str) -> None:
    missing = [name for name in wanted if name not in columns]
    if missing:
        raise ValueError(f"{role} column(s) not in the table: {', '.join(missing)}")


def check_free(names: Sequence[str], taken: Sequence[str]) -> None:
    """Refuse input columns named like the result columns that would stand beside them."""
    clash = [name for name in names if name in taken]
    if clash:
        raise ValueError(f"rename {', '.join(clash)}: the result has columns of that name")


@dataclass(frozen=True)
class PrivacyRequest:
    """Everything one anonymisation needs.  ``key`` names columns that identify a row."""

    model: str = DEFAULT_MODEL
    k: int | None = None
    l: int | None = None  # noqa: E741
    t: float | None = None
    m: float | None = None
    epsilon: float | None = None
    delta: float = DEFAULT_DELTA
    budget: float = DEFAULT_BUDGET
    qis: tuple[str, ...] = DEFAULT_QIS
    sensitive: tuple[str, ...] = DEFAULT_SENSITIVE
    rules: Mapping[str, Rule] = field(default_factory=dict)
    threshold: float = DEFAULT_THRESHOLD
    key: tuple[str, ...] | None = None
    seed: int = SAMPLE_SEED
    strict: bool = False
    noise: str = "random"
    #: Bins for flat rules ("equal", "ranges", ...) or "types"; None takes layers as given.
    style: str | None = None
    #: Which generation of the noise model; how classes are compared; what numbered types are counted by.
    variant: str = "layered"
    distance: str = "shares"
    order_col: str | None = None
    #: Write the rows between the phases of a two-phase model to the checkpoint folder.
    checkpoint: bool = False
    #: What is done about violating classes, one of ``TREATMENTS``.
    treatment: str = DEFAULT_TREATMENT
    #: Labels of values by column, for the treatment "groups"; columns whose cells "new_nulls" keeps longest come first.
    mappings: Mapping[str, Mapping[object, str]] = field(default_factory=dict)
    importance: tuple[str, ...] | None = None

    @classmethod
    def from_form(cls, form: Mapping[str, object]) -> PrivacyRequest:
        """A request from text fields, as a web form or a command line would give them."""

        def number(name: str, kind: type) -> object:
            raw = form.get(name)
            return kind(raw) if raw not in (None, "") else None

        def text(name: str, default: str | None) -> str | None:
            return str(form[name]) if form.get(name) not in (None, "") else default

        def flag(name: str) -> bool:
            value = str(form.get(name, "")).strip().lower()
            if value not in ("", "0", "1", "true", "false", "yes", "no"):
                raise ValueError(f"{name} must be true or false, got {form[name]!r}")
            return value in ("1", "true", "yes")

        return cls(
            model=str(form.get("privacy_model", DEFAULT_MODEL)),
            k=number("k", int),  # type: ignore[arg-type]
            l=number("l", int),  # type: ignore[arg-type]
            t=number("t", float),  # type: ignore[arg-type]
            m=number("m", float),  # type: ignore[arg-type]
            epsilon=number("e", float),  # type: ignore[arg-type]
            delta=float(form.get("delta", DEFAULT_DELTA)),  # type: ignore[arg-type]
            budget=float(form.get("budget", DEFAULT_BUDGET)),  # type: ignore[arg-type]
            qis=_split(form.get("quasi_identifiers"), DEFAULT_QIS),
            sensitive=_split(form.get("sensitive_column"), DEFAULT_SENSITIVE),
            rules=parse_rules(form.get("hierarchy_rules")),  # type: ignore[arg-type]
            threshold=float(form.get("suppression_threshold", DEFAULT_THRESHOLD)),  # type: ignore[arg-type]
            key=_split(form.get("key") or None, ()) or None,
            seed=int(text("seed", str(SAMPLE_SEED))),  # type: ignore[arg-type]
            strict=flag("strict"),
            noise=text("noise", "random"),  # type: ignore[arg-type]
            style=text("style", None),
            variant=text("variant", "layered"),  # type: ignore[arg-type]
            distance=text("distance", "shares"),  # type: ignore[arg-type]
            order_col=text("order_column", None),
            checkpoint=flag("checkpoint"),
            treatment=text("treatment", DEFAULT_TREATMENT),  # type: ignore[arg-type]
            mappings=_parse_mappings(form.get("mappings")),  # type: ignore[arg-type]
            importance=_split(form.get("importance") or None, ()) or None,
        )

    def validate(self, columns: Sequence[str]) -> None:
        """Raise ``ValueError`` for a request that no plan can serve."""
        if self.model not in MODELS:
            raise ValueError(f"unknown privacy model {self.model!r}; choose one of {', '.join(MODELS)}")
        if self.model not in TREATMENTS.get(self.treatment, ()):
            fitting = [name for name, models in TREATMENTS.items() if self.model in models]
            raise ValueError(f"{self.model} has no treatment {self.treatment!r}; choose one of {', '.join(fitting)}")
        check_columns(columns, self.qis, "quasi-identifier")
        check_fraction(self.threshold)
        check_columns(columns, self.key or (), "key")
        check_columns(columns, [self.order_col] if self.order_col else [], "order")
        needs = {
            "k-anonymity": ("k",),
            "l-diversity": ("k", "l"),
            "t-closeness": ("k", "t"),
            "km-anonymity": ("k", "m"),
            "differential_privacy": ("epsilon",),
        }[self.model]
        if self.treatment == "report":  # looks at all classes, whatever their size
            needs = tuple(name for name in needs if name != "k")
        for name in needs:
            if getattr(self, name) is None:
                raise ValueError(f"{self.model} needs a value for {name}")
        if self.model == "differential_privacy" and not self.epsilon:
            raise ValueError("differential_privacy needs an epsilon other than 0")
        if self.model == "km-anonymity" and not self.m:
            raise ValueError("km-anonymity needs an m other than 0")
        if self.model in ("l-diversity", "t-closeness", "km-anonymity"):
            check_columns(columns, self.sensitive, "sensitive")
        check_columns(columns, list(self.mappings), "mapped")
        check_columns(self.qis, self.importance or (), "ranked")
