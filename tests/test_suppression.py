import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import rows

from veilwright.functions.chance import Chance, keyed_hash
from veilwright.operators.classes import class_sizes
from veilwright.operators.suppression import drop_exact, drop_share, null_cells, star_sync
from veilwright.operators.wildcard import local_suppression


def small_classes(df, k, qis=("q",)):
    return class_sizes(df, list(qis)).filter(F.col("class_size") < k)


def order_of(key, salt=42):
    return hashlib.md5(f"{salt}|{len(str(key))}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("fraction", [0.0, 0.29, 0.3, 0.5, 0.999, 1.0])
def test_exact_number_and_hash_order(spark, fraction):
    df = spark.range(100).select("id", (F.col("id") % 50).alias("q"))
    kept = {r.id for r in drop_share(df, small_classes(df, 3), ["q"], fraction, ["id"]).collect()}
    gone = sorted(range(100), key=lambda i: (order_of(i), i))[: int(100 * fraction)]
    assert kept == set(range(100)) - set(gone)


def test_fraction_just_below_a_whole_number(spark):
    assert int(100 * 0.29) == 28  # double arithmetic
    df = spark.range(100).withColumn("q", F.col("id"))
    assert drop_share(df, small_classes(df, 2), ["q"], 0.29, ["id"]).count() == 72


def test_fraction_out_of_range(spark):
    df = spark.range(4).withColumn("q", F.col("id"))
    with pytest.raises(ValueError, match="between 0 and 1"):
        drop_share(df, small_classes(df, 2), ["q"], 1.2, ["id"])


def test_nothing_listed_keeps_all(spark):
    df = spark.range(10).withColumn("q", F.lit(1))
    assert drop_share(df, small_classes(df, 2), ["q"], 0.5, ["id"]).count() == 10
    assert drop_share(df, small_classes(df, 2), ["q"], 0.5).count() == 10


def test_rows_without_a_key_one_hot_copy(spark):
    """A third of the rows are one and the same: exactly the wanted number goes, nothing else changes."""
    data = [("hot", "a")] * 300 + [(f"v{i % 200}", "b") for i in range(600)]
    df = spark.createDataFrame(data, "v string, q string")
    classes = class_sizes(df, ["q"]).filter(F.col("q") == "a")
    for fraction in (0.3, 0.5):
        left = Counter(rows(drop_share(df, classes, ["q"], fraction)))
        assert left[("hot", "a")] == 300 - int(300 * fraction)
        assert sum(left.values()) == 900 - int(300 * fraction)
    everywhere = class_sizes(df, ["q"])
    left, before = Counter(rows(drop_share(df, everywhere, ["q"], 0.4))), Counter(data)
    assert sum(left.values()) == 900 - int(900 * 0.4)
    assert all(left[r] <= before[r] for r in left)
    # at most one value is cut in two
    assert sum(0 < left[r] < before[r] for r in before) <= 1


def test_copies_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("veilwright.operators.suppression.BLOCK_ROWS", 7)
    df = spark.range(100).select(F.lit("x").alias("v"), F.lit(1).alias("q"))
    assert rows(drop_share(df, class_sizes(df, ["q"]), ["q"], 0.35)) == [("x", 1)] * 65


def test_repeated_key_is_an_error_not_a_wrong_count(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "id int, q int")
    with pytest.raises(Exception, match="do not identify rows"):
        drop_share(df, small_classes(df, 2), ["q"], 0.5, ["id"]).collect()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.tuples(st.integers(0, 4), st.sampled_from("ab")), min_size=1, max_size=40),
    fraction=st.floats(0, 1),
)
def test_kept_rows_are_a_part_of_the_input(spark, data, fraction):
    df = spark.createDataFrame(data, "q int, v string")
    sizes = Counter(q for q, _ in data)
    listed = sum(n for n in sizes.values() if n < 5)
    left = Counter(rows(drop_share(df, small_classes(df, 5), ["q"], fraction)))
    assert sum(left.values()) == len(data) - math.floor(float(listed) * fraction)
    assert not left - Counter(data)
    assert all(left[r] == n for r, n in Counter(data).items() if sizes[r[0]] >= 5)


def test_drop_exact_null_flag_is_no_flag(spark):
    df = spark.range(10).withColumn("f", F.when(F.col("id") < 4, True))
    kept = {r.id for r in drop_exact(df, F.col("f"), 0.5, ["id"]).collect()}
    assert len(kept) == 8 and set(range(4, 10)) <= kept


def test_null_cells_random_rate(spark):
    df = spark.range(20000).select("id", F.lit("x").alias("a"))
    blanked = null_cells(df, 0.2, Chance("random", 5))
    counts = blanked.agg(F.count("id").alias("i"), F.count("a").alias("a"), F.count(F.expr("coalesce(cast(id as string), a)"))).first()
    assert all(abs(counts[c] / 20000 - 0.8) < 0.02 for c in ("i", "a"))
    assert abs(counts[2] / 20000 - 0.96) < 0.02  # cells go independently


def test_star_sync(spark):
    df = spark.createDataFrame([("a", 1, "s"), ("*", 2, "s"), (None, 3, "s")], "x string, y int, z string")
    assert rows(star_sync(df, ["x", "y"])) == [("*", "*", "s"), ("*", "*", "s"), ("a", "1", "s")]


def wildcard_support(out):
    def match(a, b):
        return all(x is None or y is None or x == y for x, y in zip(a, b, strict=True))

    return min(sum(match(a, b) for b in out) for a in out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", "b", None]), st.integers(0, 1)), min_size=4, max_size=30),
    k=st.integers(2, 4),
)
def test_local_suppression_is_k_anonymous_under_wildcards(spark, data, k):
    df = spark.createDataFrame(data, "x int, y string, z int")
    out = [tuple(r) for r in local_suppression(df, ["x", "y", "z"], k).collect()]
    assert len(out) == len(data)
    assert wildcard_support(out) >= k
    # only cells of rows in small classes are touched
    sizes = Counter(data)
    assert not Counter({r: n for r, n in sizes.items() if n >= k}) - Counter(out)


def blanked(data, k, importance=None):
    """Rows after blanking, by trying every subset of the columns of every small class."""
    width = len(data[0])
    order = importance or list(range(width))
    masks = sorted((m for m in itertools.product((True, False), repeat=width)), key=lambda m: (sum(m), [m[i] for i in order]), reverse=True)
    shared = {m: Counter(tuple(v for v, kept in zip(r, m, strict=True) if kept) for r in data) for m in masks}
    sizes, out = Counter(data), []
    for r in data:
        mask = masks[0]
        if sizes[r] < k:
            fits = (m for m in masks if any(m) and shared[m][tuple(v for v, kept in zip(r, m, strict=True) if kept)] >= k)
            mask = next(fits, (False,) * width)
        out.append(tuple(v if kept else None for v, kept in zip(r, mask, strict=True)))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, values, k", [(4, 3, 3), (10, 2, 5)])
def test_local_suppression_by_brute_force(spark, width, values, k):
    draw = random.Random(width * 100 + values * 10 + k)
    data = [tuple(draw.choice([*range(values), None]) if i % 3 == 0 else draw.randrange(values) for i in range(width)) for _ in range(40)]
    data += data[:5]
    schema = ", ".join(f"c{i} int" for i in range(width))
    df = spark.createDataFrame(data, schema)
    assert rows(local_suppression(df, df.columns, k)) == blanked(data, k)
    if width < 5:
        back = list(reversed(range(width)))
        assert rows(local_suppression(df, df.columns, k, importance=[f"c{i}" for i in back])) == blanked(data, k, back)


def test_local_suppression_of_many_columns(spark):
    """What a row shares with its most similar other row, over columns that follow from one another."""
    width = 64
    data = [tuple(i % (2 + j % 7) if j % 2 else (i * i + j) % 5 for j in range(width)) for i in range(20)]
    df = spark.createDataFrame(data, [f"c{j}" for j in range(width)])
    best = []
    for i, r in enumerate(data):
        masks = [tuple(a == b for a, b in zip(r, other, strict=True)) for j, other in enumerate(data) if j != i]
        best.append(tuple(v if kept else None for v, kept in zip(r, max(masks, key=lambda m: (sum(m), m)), strict=True)))
    assert rows(local_suppression(df, df.columns, 2)) == sorted(best, key=str)


def test_local_suppression_keeps_important_columns(spark):
    data = [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    df = spark.createDataFrame(data, "x int, y string")
    assert rows(local_suppression(df, ["x", "y"], 2)) == [(1, None), (1, None), (2, None), (2, None)]
    assert rows(local_suppression(df, ["x", "y"], 2, importance=["y", "x"])) == [(None, "a"), (None, "a"), (None, "b"), (None, "b")]
    assert rows(local_suppression(df, ["x", "y"], 3)) == [(None, None)] * 4
    assert rows(local_suppression(df, ["x"], 3)) == [(None, "a"), (None, "a"), (None, "b"), (None, "b")]


def test_many_columns_keep_the_largest_shared_subset(spark):
    # eleven columns: two rows share all but the last, one shares nothing
    table = [tuple([1] * 10 + [2]), tuple([1] * 10 + [3]), tuple(range(20, 31))]
    df = spark.createDataFrame(table, [f"c{i}" for i in range(11)])
    done = rows(local_suppression(df, df.columns, 2))
    assert done == sorted([tuple([1] * 10 + [None])] * 2 + [tuple([None] * 11)], key=str)


def test_keyless_rows_that_differ_by_microseconds(spark):
    df = spark.sql(
        "SELECT 'a' AS q, timestamp_micros(m) AS ts FROM VALUES (1L), (2L), (2L), (2L) AS t(m)"
    )
    kept = drop_share(df, small_classes(df, 5), ["q"], 0.5)
    counts, before = Counter(rows(kept)), Counter(rows(df))
    assert kept.count() == 2
    assert all(counts[r] <= before[r] for r in counts)


def test_keyless_rows_of_every_type(spark):
    df = spark.sql(
        """SELECT 'a' AS q, CAST(id AS STRING) AS s, X'00' AS b, array(id, NULL) AS l, named_struct('t', timestamp_micros(id)) AS r,
        map('k', id) AS m, CAST(NULL AS STRING) AS n, date'2020-01-01' AS d FROM range(40)"""
    )
    assert drop_share(df, small_classes(df, 50), ["q"], 0.25).count() == 30


def test_keys_with_bars_and_nulls_are_told_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("", None), (None, "")], "x string, y string")
    digests = {r[0] for r in df.select(keyed_hash(1, ["x", "y"])).collect()}
    assert len(digests) == 4


def test_seeds_are_far_apart():
    seeds = sorted(Chance("random", 42)._own_seed(f"cell/col_{i:03d}") for i in range(1000))
    assert min(b - a for a, b in zip(seeds, seeds[1:], strict=False)) > 10**6


def test_columns_are_blanked_independently(spark):
    names = [f"col_{i:03d}" for i in range(120)]
    df = spark.range(4000).select(*[F.lit(1).alias(n) for n in names])
    blank = null_cells(df, 0.3, Chance("random", 42)).select(*[F.col(n).isNull().cast("int").alias(n) for n in names])
    import numpy as np

    bits = blank.toPandas().to_numpy()
    agree = (bits.T @ bits + (1 - bits).T @ (1 - bits)) / len(bits)
    off = agree[np.triu_indices(len(names), 1)]
    assert abs(off - 0.58).max() < 0.06
