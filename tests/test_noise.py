import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from veilwright.functions.chance import Chance, gaussian_sd
from veilwright.plans.noisy import (
    differential_privacy,
    even_split,
    percent_split,
    randomized_response,
    response_probability,
)
from veilwright.spec import parse_rules

KINDS = [Chance("random", 3), Chance("hash", 3, ("id",))]


def draws(spark, column, n=20000):
    return np.array([r[0] for r in spark.range(n).select(column).collect()])


def test_budgets():
    assert even_split(2.0, 100, 4) == 50.0
    assert percent_split(2.0, 50, 4) == 0.25
    assert gaussian_sd(2.0, 1e-6) == pytest.approx(math.sqrt(2 * math.log(1.25e6)) / 2)
    assert response_probability(0) == 0.5


@pytest.mark.parametrize("chance", KINDS, ids=["random", "hash"])
def test_distributions(spark, chance):
    uniform = draws(spark, chance.uniform("u"))
    assert 0 < uniform.min() and uniform.max() < 1 and abs(uniform.mean() - 0.5) < 0.01
    laplace = draws(spark, chance.laplace("l", 2.0))
    assert abs(np.abs(laplace).mean() - 2.0) < 0.08 and abs(laplace.var() - 8.0) < 0.8 and abs(np.median(laplace)) < 0.06
    gaussian = draws(spark, chance.gaussian("g", 3.0))
    assert abs(gaussian.mean()) < 0.1 and abs(gaussian.std() - 3.0) < 0.1
    assert abs((np.abs(gaussian) < 3.0).mean() - 0.6827) < 0.015
    other = draws(spark, chance.uniform("v"))
    assert abs(np.corrcoef(uniform, other)[0, 1]) < 0.03


def test_hash_draws_do_not_depend_on_partitions(spark):
    chance = Chance("hash", 3, ("id",))
    one = spark.range(0, 1000, 1, 1).select("id", chance.laplace("x", 1.0).alias("d"))
    many = spark.range(0, 1000, 1, 7).repartition(5).select("id", chance.laplace("x", 1.0).alias("d"))
    assert rows(one) == rows(many)


def test_chance_is_checked():
    with pytest.raises(ValueError, match="key"):
        Chance("hash")
    with pytest.raises(ValueError, match="'random' or 'hash'"):
        Chance("other")


@pytest.mark.parametrize("chance", KINDS, ids=["random", "hash"])
def test_randomized_response_rate_and_evenness(spark, chance):
    df = spark.range(20000).select("id", F.concat(F.lit("v"), F.col("id") % 4).alias("x"))
    out = randomized_response(df, "x", 0.4, chance).collect()
    moved = [(r.id % 4, int(r.x[1])) for r in out if r.x != f"v{r.id % 4}"]
    assert len(out) == 20000 and abs(len(moved) / 20000 - 0.4) < 0.02
    for a in range(4):
        for b in range(4):
            if a != b:
                assert abs(moved.count((a, b)) / 20000 - 0.1 / 3) < 0.006


def test_randomized_response_with_one_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, x string")
    assert rows(randomized_response(df, "x", 1.0, Chance("random", 1))) == rows(df)


def test_layered_unknown_cells(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "id int, d string, n int, c string, m string")
    rules = parse_rules(
        {
            "d": {"method": "dates", "layers": [{"min": "2000-01-01", "max": "2001-01-01"}]},
            "n": {"method": "ordering", "layers": [{"min": 0, "max": 9}]},
            "c": {"method": "category"},
            "m": {"method": "masking"},
        }
    )
    out = differential_privacy(df, ["d", "n", "c", "m"], 1.0, rules)
    assert rows(out) == [(1, "NaT", None, "Unknown", "Masked")]
    compat = differential_privacy(df, ["d", "n", "c", "m"], 1.0, rules, compat=True)
    assert rows(compat) == [(1, "NaT", None, "Unknown", "***")]


@pytest.mark.parametrize("chance", KINDS, ids=["random", "hash"])
def test_layers_come_after_the_noise(spark, chance):
    df = spark.range(2000).select("id", F.lit("2000-06-30").alias("d"))
    rules = parse_rules({"d": {"method": "dates", "layers": [{"min": "2000-06-30", "max": "2000-06-30"}]}})
    out = differential_privacy(df, ["d"], 0.01, rules, budget=10.0, chance=chance)
    texts = [r.d for r in out.collect()]
    labelled = texts.count("2000-06-30 - 2000-06-30")
    # scale 10: the draw stays within [0, 1) with probability (1 - exp(-0.1)) / 2
    assert abs(labelled / 2000 - (1 - math.exp(-0.1)) / 2) < 0.02
    assert all(len(t) in (10, 23) for t in texts) and len(set(texts)) > 20
    # label and text come from one draw: a day inside the layer never shows as itself
    assert "2000-06-30" not in texts


def test_text_numbers_are_left_alone(spark):
    df = spark.createDataFrame([(1, "5")], "id int, n string")
    rules = parse_rules({"n": {"method": "ordering", "layers": [{"min": 0, "max": 9}]}})
    assert rows(differential_privacy(df, ["n"], 1.0, rules)) == [(1, "5")]
    # the method name is matched as written here
    upper = parse_rules({"n": {"method": "Category"}})
    assert rows(differential_privacy(df, ["n"], 1.0, upper)) == [(1, "5")]


def test_small_draws_show_as_stars_once(spark):
    """Star and label must come from the same draw: with a huge threshold all are stars."""
    df = spark.range(200).select("id", (F.col("id") % 50).alias("n"))
    rules = parse_rules({"n": "ordering"})
    for chance in KINDS:
        stars = differential_privacy(
            df, ["n"], 1.0, rules, threshold=1e9, variant="budgeted_gaussian", chance=chance
        )
        assert {r.n for r in stars.collect()} == {"*"}


def test_blanked_rows_leave_the_response_model(spark):
    df = spark.range(4000).select("id", F.lit("abcd").alias("t"))
    out = differential_privacy(
        df, ["t"], 1.0, parse_rules({"t": "masking"}), threshold=0.2, variant="laplace_response", chance=Chance("random", 2)
    )
    assert {r.t for r in out.collect()} == {"ab**"}
    assert abs(out.count() / 4000 - 0.64) < 0.04


def test_variant_errors(spark):
    df = spark.createDataFrame([(1, "a")], "id int, c string")
    with pytest.raises(ValueError, match="unknown variant"):
        differential_privacy(df, ["c"], 1.0, {}, variant="other")
    with pytest.raises(ValueError, match="epsilon"):
        differential_privacy(df, ["c"], 0, {})
    with pytest.raises(ValueError, match="order_col"):
        differential_privacy(df, ["c"], 1.0, parse_rules({"c": {"method": "category"}}), variant="layered_typed")
