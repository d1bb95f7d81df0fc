import pytest

from veilwright import PrivacyRequest, anonymize, parse_rules
from veilwright.plans.dispatch import report_classes
from veilwright.spec import TREATMENTS


def test_form_defaults():
    request = PrivacyRequest.from_form({})
    assert request.model == "k-anonymity"
    assert request.qis == ("Gender", "Age", "Zipcode")
    assert request.sensitive == ("Disease",)
    assert (request.threshold, request.delta, request.budget) == (0.3, 1e-6, 100.0)
    assert request.k is None and request.epsilon is None and request.rules == {}


def test_form_numbers_and_lists():
    request = PrivacyRequest.from_form(
        {"k": "3", "l": "2", "t": "0.2", "m": "2.5", "e": "1.5", "quasi_identifiers": "a,b", "suppression_threshold": "1"}
    )
    assert (request.k, request.l, request.t, request.m, request.epsilon) == (3, 2, 0.2, 2.5, 1.5)
    assert request.qis == ("a", "b") and request.threshold == 1.0


def test_rule_forms():
    rules = parse_rules('{"a": {"method": "Ordering", "layers": [{"min": "20", "max": 30}]}, "b": "DATES"}')
    assert rules["a"].method == "ordering" and rules["a"].number_layers[0].label == "20.0-30.0"
    assert rules["b"].flat and rules["b"].method == "dates"
    dates = parse_rules({"d": {"method": "dates", "layers": [{"min": "1978-01-01", "max": "1989/12/31"}]}})
    assert dates["d"].date_layers[0].label == "1978-01-01 - 1989-12-31"


def test_bad_layer_bound():
    with pytest.raises(ValueError, match="not a number"):
        parse_rules({"a": {"method": "ordering", "layers": [{"min": "low", "max": 3}]}})


@pytest.mark.parametrize(
    ("form", "message"),
    [
        ({"privacy_model": "other"}, "unknown privacy model"),
        ({"k": "2", "quasi_identifiers": "a,zip"}, "zip"),
        ({"quasi_identifiers": "a"}, "needs a value for k"),
        ({"privacy_model": "differential_privacy", "quasi_identifiers": "a"}, "needs a value for epsilon"),
        ({"privacy_model": "differential_privacy", "quasi_identifiers": "a", "e": "0"}, "other than 0"),
        ({"privacy_model": "km-anonymity", "quasi_identifiers": "a", "k": "2", "m": "0"}, "other than 0"),
        ({"k": "2", "quasi_identifiers": "a", "suppression_threshold": "1.5"}, "between 0 and 1"),
        ({"privacy_model": "l-diversity", "quasi_identifiers": "a", "k": "2", "l": "2"}, "sensitive"),
        ({"quasi_identifiers": "a", "k": "2", "treatment": "other"}, "no treatment 'other'"),
        ({"quasi_identifiers": "a", "k": "2", "treatment": "sized"}, "choose one of share, classes, cells"),
        ({"privacy_model": "differential_privacy", "quasi_identifiers": "a", "e": "1", "treatment": "cells"}, "choose one of share$"),
        ({"quasi_identifiers": "a", "k": "2", "treatment": "groups", "mappings": '{"zip": {"1": "x"}}'}, "mapped"),
        ({"quasi_identifiers": "a", "k": "2", "treatment": "groups", "mappings": '{"a": "x"}'}, "must be an object"),
        ({"quasi_identifiers": "a", "k": "2", "treatment": "new_nulls", "importance": "s"}, "ranked"),
    ],
)
def test_rejected_requests(spark, form, message):
    df = spark.createDataFrame([(1, "x")], "a int, s string")
    with pytest.raises(ValueError, match=message):
        anonymize(df, PrivacyRequest.from_form(form))


@pytest.mark.parametrize("model", ["k-anonymity", "l-diversity", "t-closeness", "km-anonymity", "differential_privacy"])
def test_every_model_runs_from_a_form(spark, model):
    data = [(i, i % 3, "ab"[i % 2], "xyz"[i % 3 - 1]) for i in range(30)]
    df = spark.createDataFrame(data, "id int, a int, g string, s string")
    form = {"privacy_model": model, "quasi_identifiers": "a,g", "sensitive_column": "s"}
    form |= {"k": "6", "l": "2", "t": "0.1", "m": "2", "e": "1", "hierarchy_rules": '{"g": {"method": "category"}}'}
    out = anonymize(df, PrivacyRequest.from_form(form))
    assert out.columns == df.columns
    assert 0 < out.count() <= 30


TREATED = [(model, treatment) for treatment, models in TREATMENTS.items() for model in models if treatment != "share"]


@pytest.mark.parametrize(("model", "treatment"), TREATED)
def test_every_treatment_runs_from_a_form(spark, model, treatment):
    data = [(i, i % 3, "ab"[i % 2], "xyz"[i % 3 - 1]) for i in range(30)]
    df = spark.createDataFrame(data, "id int, a int, g string, s string")
    form = {"privacy_model": model, "treatment": treatment, "quasi_identifiers": "a,g", "sensitive_column": "s", "key": "id"}
    form |= {"k": "5", "l": "2", "t": "0.1", "m": "1", "mappings": '{"g": {"a": "first"}}', "importance": "g"}
    request = PrivacyRequest.from_form(form)
    out = anonymize(df, request)
    assert out.columns == (["a", "g"] if treatment == "keys" else df.columns)
    rows = out.collect()
    if treatment == "report":
        assert len(rows) == 30 and report_classes(df, request).count() == 6
    else:
        with pytest.raises(ValueError, match="no report"):
            report_classes(df, request)
    if treatment in ("cells", "keys", "new_nulls", "levels") or (model, treatment) == ("k-anonymity", "classes"):
        assert len(rows) == 30  # six classes of five rows: nothing to do
    if treatment == "groups":
        assert {r.g for r in rows} == {"first", "b"}
        assert {r.s for r in rows} == ({"x", "y", "z"} if model == "k-anonymity" else {"Suppressed"})
    if model == "l-diversity" and treatment == "classes":
        assert not rows  # one value a class


def test_flat_rules_and_all_fields_by_a_form(spark):
    from veilwright.plans.dispatch import anonymize

    df = spark.createDataFrame([(i, i % 40, "x") for i in range(40)], "ID int, Age int, Gender string")
    form = {
        "k": "5", "quasi_identifiers": "Age,Gender", "hierarchy_rules": '{"Age": "ordering"}', "style": "equal",
        "key": "ID", "seed": "7", "strict": "true", "order_column": "ID", "checkpoint": "no",
    }
    request = PrivacyRequest.from_form(form)
    assert (request.key, request.seed, request.strict, request.order_col) == (("ID",), 7, True, "ID")
    done = anonymize(df, request).toPandas()
    assert 0 < done.Age.nunique() <= 3 and done.groupby(["Age", "Gender"]).size().min() >= 5


def test_a_flag_must_be_true_or_false():
    with pytest.raises(ValueError, match="strict"):
        PrivacyRequest.from_form({"strict": "maybe"})
