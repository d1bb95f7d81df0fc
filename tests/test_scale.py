"""Plans, not results: what must hold for tables of any size."""

import re

import pytest
from pyspark.sql import functions as F

from queries.base import CUSTOMER_KEY, CUSTOMER_QIS, CUSTOMER_RULES, FINE_QIS, ORDER_RULES, THRESHOLD, K
from queries.models import LINE_KEY
from tests.conftest import rows
from veilwright.operators import lists, numbering, suppression
from veilwright.operators.categories import typed
from veilwright.operators.classes import attach_class_size, class_sizes, class_stats
from veilwright.operators.distance import class_distance
from veilwright.plans.report import privacy_report
from veilwright.operators.generalize import generalize_auto, generalize_known
from veilwright.operators.suppression import drop_share, suppress_values
from veilwright.operators.wildcard import local_suppression
from veilwright.plans.classbased import k_anonymity, km_anonymity, l_diversity, t_closeness
from veilwright.plans.noisy import randomized_response
from veilwright.functions.chance import Chance

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_lists(monkeypatch):
    """No list of classes counts as small, and none fits a filter."""
    monkeypatch.setattr(lists, "SMALL_BYTES", -1)
    monkeypatch.setattr(lists, "MOST_BITS", 0)


@pytest.fixture
def no_broadcast(spark):
    """Tables too large to broadcast, and partitions called skewed early."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def hot(spark):
    """6,000 rows in several files' worth of partitions, a third of them in one class."""
    hot_row = F.col("id") % 3 == 0
    return spark.range(0, 6000, 1, 8).select(
        "id",
        F.when(hot_row, -1).otherwise(F.col("id") % 700).alias("q"),
        F.when(hot_row, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 40)).alias("s"),
    )


def splits_skew(df):
    df.collect()
    return "skew=true" in plan(df)


CASES = {
    "attach size": lambda df: attach_class_size(df, ["q"]),
    "delete small": lambda df: k_anonymity(df, ["q"], 9, threshold=0.3, key=["id"]),
    "delete all small": lambda df: k_anonymity(df, ["q"], 9, strict=True),
    "overwrite": lambda df: suppress_values(df, class_sizes(df, ["q"]).filter("class_size < 9"), ["q"], "s"),
    "blank cells": lambda df: local_suppression(df, ["q", "s"], 4),
    "number types": lambda df: typed(df, "s", "id"),
    "answers": lambda df: randomized_response(df, "s", 0.2, Chance("hash", 1, ("id",))),
}


@pytest.mark.parametrize("case", CASES)
def test_hot_groups_are_split(spark, no_broadcast, large_lists, hot, case):
    assert splits_skew(CASES[case](hot))


def test_hot_class_in_the_second_phase(spark, no_broadcast, large_lists, hot):
    """The hot class itself violates: it has one sensitive value."""
    out = l_diversity(hot, ["q"], "s", 2, 2, threshold=0.5, key=["id"])
    assert splits_skew(out)
    poor = class_stats(hot, ["q"], ["s"]).filter("distinct_values < 2").agg(F.sum("class_size")).first()[0]
    assert out.count() == 6000 - int(poor * 0.5)


def models(spark):
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    qis = ["c_nationkey", "c_acctbal"]
    yield k_anonymity(df, CUSTOMER_QIS, K, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY)
    yield k_anonymity(df, CUSTOMER_QIS, K, CUSTOMER_RULES, THRESHOLD)
    yield l_diversity(df, qis, "c_mktsegment", 5, 3, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY)
    yield t_closeness(df, qis, "c_mktsegment", 5, 0.1, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY)
    yield class_distance(df, df, qis, "c_mktsegment")
    yield class_distance(df, df, qis, "c_mktsegment", "kl")
    yield local_suppression(df, qis, 5)


def test_no_pairing_and_no_python(spark):
    for df in models(spark):
        text = plan(df)
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
            assert word not in text


def test_the_global_steps_are_a_table(spark):
    """They are merged with the class steps in ranges: no array of them, neither gathered nor as a constant."""
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    text = plan(class_distance(df, df, ["c_nationkey"], "c_mktsegment"))
    for word in ("collect_list", "Subquery", "transform("):
        assert word not in text
    assert "customer.parquet" not in text  # both tables have been counted, once each


def test_the_report_counts_its_rows_once(spark):
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet").withColumn("counted", F.lit(True))
    text = plan(privacy_report(df, df.limit(1000), ["c_nationkey"], "c_mktsegment", k=5))
    scans = [line for line in text.splitlines() if "FileScan" in line and "customer.parquet" in line]
    assert scans and all("c_nationkey" not in line for line in scans)


def test_only_measured_lists_are_broadcast(spark, no_broadcast, monkeypatch):
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    model = lambda: plan(k_anonymity(df, CUSTOMER_QIS, K, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY))
    assert "BroadcastHashJoin" in model()
    monkeypatch.setattr(lists, "SMALL_BYTES", -1)
    assert "BroadcastHashJoin" not in model()


def test_only_the_result_reads_whole_rows(spark, monkeypatch):
    """Lists and cuts read keys and quasi-identifiers; the columns of every scan are looked at."""
    read = []
    cut, write = suppression.hash_cut, lists.stored
    monkeypatch.setattr(suppression, "hash_cut", lambda df, *a, **b: (read.append(plan(df)), cut(df, *a, **b))[1])
    monkeypatch.setattr(lists, "stored", lambda df: (read.append(plan(df)), write(df))[1])
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    text = plan(l_diversity(df, ["c_nationkey"], "c_mktsegment", 99, 6, {}, THRESHOLD, CUSTOMER_KEY))
    scans = [s for r in read for s in re.findall(r"ReadSchema: struct<([^>]*)>", r)]
    assert len(read) > 4 and scans and not any("c_name" in s for s in scans)
    assert sum("c_name" in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)) == 1


def test_unknown_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    text = plan(k_anonymity(df, CUSTOMER_QIS, K, CUSTOMER_RULES, 1.0))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(c_acctbal\)", text)


def test_small_lists_of_classes_leave_rows_unshuffled(spark):
    df = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    small = class_sizes(df, ["o_orderpriority"]).filter("class_size < 300")
    text = plan(drop_share(df, small, ["o_orderpriority"], 0.5, ["o_orderkey"]))
    top = text[: text.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in top and "Exchange" not in top


def shuffled(spark):
    """Bytes that all finished tasks of the session have written to shuffles."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def lines(spark):
    return spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")


WIDE_QIS = ["l_suppkey", "l_shipdate"]


def wide(spark):
    return k_anonymity(lines(spark), WIDE_QIS, 2, {}, THRESHOLD, LINE_KEY)


def test_a_small_list_leaves_whole_rows_where_they_are(spark, no_broadcast):
    """Static and adaptive broadcasting are off; the measured list is broadcast all the same."""
    text = plan(wide(spark))
    assert "BroadcastHashJoin" in text and "Exchange" not in text.replace("BroadcastExchange", "")


def test_a_large_list_moves_little_more_than_its_rows(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(lists, "SMALL_BYTES", -1)
    df = lines(spark).filter("l_linenumber < 3 or l_suppkey < 90")
    small = class_sizes(df, ["l_suppkey", "l_shipdate", "l_linenumber"]).filter("l_suppkey = 7")
    qis = ["l_suppkey", "l_shipdate", "l_linenumber"]
    found = lists.listed(df, small, qis)
    due = df.filter("l_suppkey = 7").count()
    passing = df.filter(found.maybe()).count()
    assert due <= passing <= due + 0.02 * df.count()
    start = shuffled(spark)
    kept = found.without(df, "test")
    assert "SortMergeJoin" in plan(kept)
    kept.write.format("noop").mode("overwrite").save()
    middle = shuffled(spark)
    monkeypatch.setattr(lists, "MOST_BITS", 0)
    plain = lists.listed(df, small, qis).without(df, "test")
    before = shuffled(spark)
    plain.write.format("noop").mode("overwrite").save()
    assert 8 * (middle - start) < shuffled(spark) - before
    assert rows(kept) == rows(plain) == rows(df.filter("l_suppkey <> 7"))


def test_a_filter_makes_labels_once(spark, monkeypatch):
    """Labels of moments are not made again for every place of the filter that a row looks at."""
    monkeypatch.setattr(lists, "SMALL_BYTES", -1)
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    df = generalize_known(df, FINE_QIS, ORDER_RULES)
    found = lists.listed(df, class_sizes(df, FINE_QIS).filter("class_size < 2"), FINE_QIS, mark=F.lit("m"))
    ways = {"only": found.only(df, "x"), "without": found.without(df, "x"), "attach": found.attach(df, "x")[0]}
    for name, way in ways.items():
        tests = [line for line in plan(way).splitlines() if re.search(r"\bFilter \(", line)]
        assert tests and not any("1995-01-01" in line for line in tests), name
    assert ways["attach"].count() == df.count()
    assert rows(ways["only"].unionByName(ways["without"])) == rows(df)


@pytest.mark.parametrize("model", ["l", "t", "km"])
def test_two_phases_read_whole_rows_once(spark, no_broadcast, model):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    qis = ["o_orderpriority", "o_orderdate"]
    out = {
        "l": lambda: l_diversity(df, qis, "o_orderstatus", 5, 2, {}, THRESHOLD, ["o_orderkey"]),
        "t": lambda: t_closeness(df, qis, "o_orderstatus", 5, 0.05, {}, THRESHOLD, ["o_orderkey"]),
        "km": lambda: km_anonymity(df, qis, ["o_orderstatus"], 5, 1.5, {}, THRESHOLD, ["o_orderkey"]),
    }[model]()
    text = plan(out)
    assert text.count("FileScan parquet") == 2 and text.count("Join") == 1 and "SortMergeJoin" not in text
    assert 0 < out.count() < df.count()


@pytest.mark.parametrize("how", ["small", "filter", "plain"])
def test_every_way_of_joining_a_list(spark, monkeypatch, how):
    """NULL keys, columns named like working names, repeated rows, and an empty list."""
    if how != "small":
        monkeypatch.setattr(lists, "SMALL_BYTES", -1)
    if how == "plain":
        monkeypatch.setattr(lists, "MOST_BITS", 0)
    data = [(i % 9 if i % 9 else None, f"v{i % 4}", i, i) for i in range(120)] * 2
    df = spark.createDataFrame(data, "q int, __print string, __hash int, `key_0` int")
    classes = spark.createDataFrame([(3,), (5,), (None,)], "q int")
    found = lists.listed(df, classes, ["q"], mark=F.lit("m"))
    assert rows(found.only(df, "x")) == rows(df.filter("q in (3, 5)"))
    assert rows(found.without(df, "x")) == rows(df.filter("q is null or q not in (3, 5)"))
    assert rows(found.without(df, "x", null_safe=True)) == rows(df.filter("q not in (3, 5)"))
    joined, prefix = found.attach(df, "x", null_safe=True)
    want = df.withColumn("m", F.when(F.coalesce(F.col("q").isin(3, 5), F.lit(True)), F.lit("m")))
    assert prefix not in ("__",) and rows(joined) == rows(want)
    none = lists.listed(df, classes.limit(0), ["q"])
    assert rows(none.without(df, "x")) == rows(df) and none.only(df, "x").count() == 0


def test_a_column_named_like_a_working_one_is_kept(spark):
    df = spark.range(60).select("id", (F.col("id") % 20).alias("q"), F.lit("own").alias("__hash"), F.lit("s").alias("n"))
    for key in (["id"], None):
        out = k_anonymity(df, ["q"], 5, threshold=0.5, key=key)
        assert out.columns == df.columns and {r["__hash"] for r in out.collect()} == {"own"} and out.count() == 30


@pytest.mark.parametrize("most", [1, 40])
def test_the_last_step_is_bounded(spark, monkeypatch, most):
    """Level by level until few hashes are left; the same hash is found whatever the bound."""
    from veilwright.functions.chance import keyed_hash

    hashes = spark.range(3000).select(keyed_hash(1, ["id"]).alias("hash"))
    # a third of the rows share one hash, and many share their first digits
    hashes = hashes.unionByName(spark.range(1500).select(F.lit("7" * 32).alias("hash")))
    hashes = hashes.unionByName(spark.range(900).select(F.concat(F.lit("7777700"), F.lpad("id", 25, "0")).alias("hash")))
    every = sorted(r.hash for r in hashes.collect())
    monkeypatch.setattr(suppression, "MOST_ORDERED", most)
    for fraction in (0.0001, 0.3, 0.5, 0.6, 0.9, 1.0):
        due = int(len(every) * fraction)
        cut = suppression.hash_cut(hashes, fraction, unique=False)
        if due == 0:
            assert cut is None
        else:
            assert cut == (every[due - 1], sum(h <= every[due - 1] for h in every) - due)


def test_bins_of_many_columns_take_as_many_scans_as_one(spark):
    """Counted in tasks: the scans of the limits, of what lies between, and of the rows."""
    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_linenumber"]

    def tasks():
        every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(every.apply(i).totalTasks() for i in range(every.size()))

    taken = []
    for qis in (names[:1], names):
        start = tasks()
        generalize_auto(df, qis, style="ranges").write.format("noop").mode("overwrite").save()
        taken.append(tasks() - start)
    assert taken[0] == taken[1] <= 5


def test_values_tied_in_one_place_are_spread(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ORDERED", 100)
    sizes = []
    write = numbering.stored

    def watched(df):
        out = write(df)
        if "part" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(numbering, "stored", watched)
    df = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id") % 2000).alias("v"), (F.col("id") % 2).alias("turn"))
    got = {r.v: r["turn"] for r in typed(df, "v", "turn").select(F.col("v"), "turn").distinct().collect()}
    first = {f"v{i}": i % 2 for i in range(2000)}
    order = sorted(first, key=lambda v: (first[v], v))
    assert got == {f"type{i}": first[v] for i, v in enumerate(order, 1)}
    assert len(sizes) > 10 and max(sizes) <= 400
