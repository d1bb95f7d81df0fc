import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import rows

from veilwright.operators import classes
from veilwright.operators.classes import class_stats
from veilwright.operators.distance import class_distance
from veilwright.operators.diversity import diversity_measures
from veilwright.operators.lineage import cut_lineage
from veilwright.plans import classbased as models
from veilwright.plans import fulldomain
from veilwright.plans.fulldomain import full_domain
from veilwright.plans.report import privacy_report
from veilwright.spec import parse_rules


def wasserstein(u, v):
    """Area between two empirical distribution functions, by definition."""
    points = np.sort(np.concatenate([u, v]))
    fu = np.searchsorted(np.sort(u), points[:-1], side="right") / len(u)
    fv = np.searchsorted(np.sort(v), points[:-1], side="right") / len(v)
    return float(np.sum(np.diff(points) * np.abs(fu - fv)))


def shares(values):
    counts = Counter(v for v in values if v is not None)
    return np.array([n / sum(counts.values()) for n in counts.values()])


def by_class(data):
    groups = defaultdict(list)
    for q, s in data:
        groups[q].append(s)
    return groups


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "c", "d", "e", None])), min_size=1, max_size=60),
    extra=st.lists(st.sampled_from(["a", "b", "z", "y"]), max_size=20),
)
def test_share_distance_by_brute_force(spark, data, extra):
    df = spark.createDataFrame(data, "q int, s string")
    base = spark.createDataFrame(data + [(9, s) for s in extra], "q int, s string")
    world = shares([s for _, s in data] + extra)
    expected = {q: wasserstein(world, shares(v)) for q, v in by_class(data).items() if any(s for s in v)}
    found = {r.q: r for r in class_distance(df, base, ["q"], "s").collect()}
    assert found.keys() == expected.keys()
    for q, distance in expected.items():
        assert found[q].distance == pytest.approx(distance, abs=1e-12)
        assert found[q].class_size == len(by_class(data)[q])
        assert found[q].nulls == by_class(data)[q].count(None)


def test_share_distance_with_many_levels(spark):
    """Global counts 1, 2, ..., 60: many steps in many ranges."""
    data = [(i % 7, f"v{i}") for i in range(60) for _ in range(i + 1)]
    df = spark.createDataFrame(data, "q int, s string")
    world = shares([s for _, s in data])
    for r in class_distance(df, df, ["q"], "s").collect():
        assert r.distance == pytest.approx(wasserstein(world, shares(by_class(data)[r.q])), abs=1e-12)


def test_share_distance_without_known_values(spark):
    """No global steps, or no class with a known value."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "q int, s string")
    unknown = spark.createDataFrame([(1, None), (2, None)], "q int, s string")
    assert class_distance(unknown, df, ["q"], "s").count() == 0
    assert class_distance(df.limit(0), df, ["q"], "s").count() == 0
    assert [r.q for r in class_distance(df, unknown, ["q"], "s").collect()] == [1]


def test_l1_counts_values_missing_from_the_class(spark):
    data = [(1, "a")] * 2 + [(2, "a"), (2, "b")] + [(3, "c")] * 4
    df = spark.createDataFrame(data, "q int, s string")
    found = {r.q: r.distance for r in class_distance(df, df, ["q"], "s", "l1").collect()}
    world = {"a": 3 / 8, "b": 1 / 8, "c": 4 / 8}
    for q, values in by_class(data).items():
        own = {v: values.count(v) / len(values) for v in values}
        assert found[q] == pytest.approx(sum(abs(p - own.get(v, 0)) for v, p in world.items()))
    with pytest.raises(ValueError, match="unknown distance"):
        class_distance(df, df, ["q"], "s", "other")


def people(spark):
    """Ages and places, with classes of size 1 to 5 and a few unknown cells."""
    ages = [25, 25, 25, 25, 31, 31, 31, 44, 44, 58, None, 25]
    places = ["x", "x", "x", "x", "x", "x", "x", "y", "y", "y", "y", None]
    ills = ["a", "b", "a", "a", "c", "c", "c", "a", None, "b", "a", "b"]
    data = list(zip(range(12), ages, places, ills, strict=True))
    return spark.createDataFrame(data, "id int, age int, place string, ill string")


QIS = ["age", "place"]


def test_k_partial_drops_unknown_and_a_share_of_the_small(spark):
    out = rows(models.k_anonymity(people(spark), QIS, 3, threshold=0.5, key=["id"]))
    ids = {r[0] for r in out}
    assert set(range(7)) <= ids and not ids & {10, 11}
    assert len(ids & {7, 8, 9}) == 2  # floor(3 * 0.5) = 1 went
    assert {r[0] for r in rows(models.k_anonymity(people(spark), QIS, 3, threshold=0.0, key=["id"]))} == set(range(10))
    assert {r[0] for r in rows(models.k_anonymity(people(spark), QIS, 3, strict=True))} == set(range(7))


def test_masked_unknown_forms_a_class_except_for_t(spark):
    rules = parse_rules({"age": {"method": "masking", "maskingString": "a*"}, "place": {"method": "masking", "maskingString": "a"}})
    df = people(spark)
    kept = {r[0]: r[1:3] for r in rows(models.k_anonymity(df, QIS, 1, rules, 1.0, ["id"]))}
    assert len(kept) == 12 and kept[10] == ("Masked", "*") and kept[11] == ("2*", "Masked")
    ids = {r[0] for r in rows(models.t_closeness(df, QIS, "ill", 1, 9.0, rules, 1.0, ["id"]))}
    assert ids == set(range(10))


def test_l_partial_uses_what_the_first_phase_left(spark):
    out = rows(models.l_diversity(people(spark), QIS, "ill", 3, 2, threshold=1.0, key=["id"]))
    assert {r[0] for r in out} == {0, 1, 2, 3}  # ages 31 all have one illness
    half = {r[0] for r in rows(models.l_diversity(people(spark), QIS, "ill", 1, 2, threshold=0.5, key=["id"]))}
    assert {0, 1, 2, 3} <= half and len(half & {4, 5, 6, 7, 8, 9}) == 3
    cut = models.l_diversity(people(spark), QIS, "ill", 1, 2, threshold=0.5, key=["id"], checkpoint=True)
    assert {r[0] for r in rows(cut)} == half


def test_km_passes_a_class_without_known_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "b"), (3, "a"), (3, "a"), (3, "b")], "q int, s string")
    assert {r[0] for r in rows(models.km_anonymity(df, ["q"], ["s"], 1, 2.0))} == {1, 2}
    assert {r[0] for r in rows(models.km_anonymity(df, ["q"], ["s"], 1, 1.5))} == {1, 2, 3}
    with pytest.raises(ValueError, match="m must not be 0"):
        models.km_anonymity(df, ["q"], ["s"], 1, 0)


def test_t_exempts_unknown_and_single_rows(spark):
    data = [(1, "a"), (2, None), (2, "a"), (3, "a"), (3, "a"), (4, "a"), (4, "b"), (4, "c")]
    df = spark.createDataFrame(data, "q int, s string")
    assert {r[0] for r in rows(models.t_closeness(df, ["q"], "s", 1, 0.3))} == {1, 2, 4}


def test_strict_models_keep_their_promise(spark):
    data = [(i, i % 5, "ab"[i % 2], "xyz"[i % 3]) for i in range(60)] + [(60 + i, i, "c", "x") for i in range(7)]
    df = spark.createDataFrame(data, "id int, q1 int, q2 string, s string")
    qis = ["q1", "q2"]
    k_rows = models.k_anonymity_strict(df, qis, 4)
    assert k_rows.count() > 0 and class_stats(k_rows, qis, ["s"]).filter("class_size < 4").count() == 0
    l_rows = models.l_diversity_strict(df, qis, "s", 4, 3)
    assert l_rows.count() > 0 and class_stats(l_rows, qis, ["s"]).filter("distinct_with_null < 3").count() == 0
    m_rows = models.km_anonymity_strict(df, qis, "s", 4, 3)
    assert rows(m_rows) == rows(l_rows)
    nothing = models.km_anonymity_strict(df, qis, "s", 4, 99)
    assert nothing.columns == df.columns and nothing.count() == 0


def test_new_null_rule_keeps_rows_unknown_from_before(spark):
    data = [(1, None)] * 3 + [(2, "a")] * 3 + [(3, "b")]
    df = spark.createDataFrame(data, "q int, p string")
    assert Counter(rows(models.k_anonymity_new_nulls(df, ["q", "p"], 3))) == Counter({(1, None): 3, (2, "a"): 3})
    assert rows(models.k_anonymity_strict(df, ["q", "p"], 3)) == [(2, "a")] * 3


def test_groups_and_suppressed_values(spark):
    data = [("a", "s"), ("b", "s"), ("c", "s"), ("c", "t"), ("d", "t"), (None, "t")]
    df = spark.createDataFrame(data, "q string, s string")
    kept = models.l_diversity_suppress(df, ["q"], "s", 2, 2, {"q": {"a": "ab", "b": "ab"}})
    assert rows(kept) == [("ab", "Suppressed"), ("ab", "Suppressed"), ("c", "s"), ("c", "t")]


def test_reports_return_the_table_unchanged(spark):
    data = [(1, "a"), (1, "a"), (2, "a"), (2, "b")]
    df = spark.createDataFrame(data, "q int, s string")
    table, far = models.t_closeness_report(df, ["q"], "s", 0.2)
    assert rows(table) == rows(df)
    assert [r.q for r in far.collect()] == [1]
    table, measures = models.l_diversity_report(df, ["q"], "s", 2)
    assert rows(table) == rows(df)
    assert {r.q: (r.distinct_values, round(r.entropy_l, 6), r.recursive_ok) for r in measures.collect()} == {
        1: (1, 1.0, False), 2: (2, 2.0, False)
    }
    report = {r.q: r for r in privacy_report(df, df, ["q"], "s", k=2, l=2, m=1.5, t=0.1).collect()}
    assert (report[1].below_k, report[1].below_l, report[1].above_share) == (False, True, True)


def test_recursive_diversity_by_sorting(spark):
    counts = {"a": 5, "b": 3, "c": 3, "d": 3, "e": 1}
    df = spark.createDataFrame([(1, v) for v, n in counts.items() for _ in range(n)], "q int, s string")
    ordered = sorted(counts.values(), reverse=True)
    for l in range(1, 7):  # noqa: E741
        row = diversity_measures(df, ["q"], "s", l).first()
        assert row.tail_count == sum(ordered[l - 1 :])
        assert row.recursive_ok == (ordered[0] < sum(ordered[l - 1 :]))


def test_full_domain_finds_the_lowest_level(spark):
    data = [(i, v, "a" if i % 2 else "b") for i, v in enumerate([1, 1, 2, 2, 9, 9, 10, 10])]
    df = spark.createDataFrame(data, "id int, n int, c string")
    assert rows(full_domain(df, ["n"], 2)) == [(i, str(v), c) for i, v, c in data]
    # pairs of equal numbers split by c: n alone cannot stay with c, so c is starred first (one level)
    out = full_domain(df, ["n", "c"], 2)
    assert {r.c for r in out.collect()} == {"*"} and out.count() == 8
    tiny = spark.createDataFrame([(1, None), (2, "a")], "n int, c string")
    assert full_domain(tiny, ["n", "c"], 3).count() == 0


@pytest.mark.parametrize("budget", [0.0, 0.1])
def test_full_domain_by_brute_force(spark, monkeypatch, budget):
    """Pruned by columns and pairs of columns, the search finds the vector that trying all finds."""
    tried = []
    monkeypatch.setattr(fulldomain, "TRIED", 4)
    ask = fulldomain._Counts.qualifying
    monkeypatch.setattr(fulldomain._Counts, "qualifying", lambda own, v: (tried.extend(v if len(own.columns) == 4 else []), ask(own, v))[1])
    data = [(i % 7, i % 4, (i * i) % 5, i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "a int, n int, c int, d int")
    ladders = [lambda v: [str(v), str(v // 2), "*"], lambda v: [str(v), str(v % 2), "*"], lambda v: [str(v), "*"], lambda v: [str(v), str(v > 0), "*"]]

    def small(vector):
        sizes = Counter(tuple(f(v)[at] for f, v, at in zip(ladders, r, vector, strict=True)) for r in data)
        return sum(n for n in sizes.values() if n < 6)

    every = sorted(itertools.product(range(3), range(3), range(2), range(3)), key=lambda v: (sum(v), v))
    best = next(v for v in every if small(v) <= len(data) * budget)
    text = lambda e: F.expr(e).cast("string")
    given = {
        "a": (F.array(text("a"), text("a div 2"), F.lit("*")), 3),
        "n": (F.array(text("n"), text("n % 2"), F.lit("*")), 3),
        "c": (F.array(text("c"), F.lit("*")), 2),
        "d": (F.array(text("d"), F.initcap(text("d > 0")), F.lit("*")), 3),
    }
    out = rows(full_domain(df, ["a", "n", "c", "d"], 6, budget, given))
    general = [tuple(f(v)[at] for f, v, at in zip(ladders, r, best, strict=True)) for r in data]
    sizes = Counter(general)
    assert out == sorted((r for r in general if sizes[r] >= 6), key=str)
    assert len(tried) < every.index(best)


def test_sketches_of_distinct_values(spark):
    """Within 5 %, exact for few values, and the same from one table as from stored parts of it."""
    df = spark.range(60000).select(
        (F.col("id") % 3).alias("q"),
        F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.col("id") % 70).alias("s"),
    )
    exact = {r.q: r for r in class_stats(df, ["q"], ["s"]).collect()}
    whole = classes.sketched_stats(classes.class_sketches(df, ["q"], ["s"]), ["q"])
    halves = [classes.class_sketches(df.filter(f"s % 2 = {i}" if i else "s % 2 = 0 or s is null"), ["q"], ["s"]) for i in (0, 1)]
    merged = classes.sketched_stats(classes.merge_sketches(["q"], *halves), ["q"])
    for found in (whole, merged):
        for r in found.collect():
            assert (r.class_size, r.nulls) == (exact[r.q].class_size, exact[r.q].nulls)
            assert abs(r.distinct_values - exact[r.q].distinct_values) <= 0.05 * exact[r.q].distinct_values
            assert r.distinct_with_null == r.distinct_values + (r.nulls > 0)
    few = people(spark)
    for k, l in ((1, 2), (3, 2)):
        same = [rows(models.l_diversity(few, QIS, "ill", k, l, threshold=0.5, key=["id"], approximate=a)) for a in (False, True)]
        assert same[0] == same[1]


def test_one_hot_class(spark):
    """A third of all rows in one class, and one sensitive value in two thirds of them."""
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("q"),
        F.when(F.col("id") % 9 < 6, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 11)).alias("s"),
    )
    sizes = Counter(r.q for r in df.collect())
    listed = sum(n for n in sizes.values() if n < 5)
    assert models.k_anonymity(df, ["q"], 5, threshold=0.3, key=["id"]).count() == 3000 - int(listed * 0.3)
    poor = class_stats(df, ["q"], ["s"]).filter("distinct_values < 8").agg(F.sum("class_size")).first()[0]
    assert models.l_diversity(df, ["q"], "s", 1, 8, threshold=0.3, key=["id"]).count() == 3000 - int(poor * 0.3)


def test_lineage_is_cut_into_the_named_folder(spark, tmp_path):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") + 1))
    assert df.count() == 5
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + spark.conf.get("spark.checkpoint.dir"))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_awkward_column_names(spark):
    """Dots, and the names the plans use themselves."""
    data = [(i, i % 3, "ab"[i % 2], "xyz"[i % 3 - 1], True) for i in range(24)]
    for names in (["id", "my.age", "n", "values", "flag"], ["id", "value", "share", "rows", "level"], ["id", "a b", "piece", "n", "total"]):
        df = spark.createDataFrame(data, names)
        qis, sensitive = names[1:3], names[3]
        outs = [
            models.k_anonymity(df, qis, 5, threshold=0.5, key=["id"]),
            models.k_anonymity(df, qis, 5, threshold=0.5),
            models.k_anonymity_strict(df, qis, 4),
            models.k_anonymity_new_nulls(df, qis, 4),
            models.l_diversity(df, qis, sensitive, 2, 2, threshold=0.5, key=["id"]),
            models.l_diversity_suppress(df, qis, sensitive, 2, 2),
            models.t_closeness(df, qis, sensitive, 2, 0.1, threshold=0.5, key=["id"]),
            models.t_closeness_l1(df, qis, sensitive, 2, 0.1, threshold=0.5, key=["id"]),
            models.km_anonymity(df, qis, [sensitive], 2, 2.0, threshold=0.5, key=["id"]),
            full_domain(df, qis, 4),
        ]
        for out in outs:
            assert out.columns == names and out.count() <= 24
    report = privacy_report(df, df, qis, sensitive, k=2)
    assert report.count() == 6
    clash = df.withColumnRenamed("piece", "distance")
    with pytest.raises(ValueError, match="rename distance"):
        models.t_closeness(clash, ["distance"], "n", 2, 0.1)
