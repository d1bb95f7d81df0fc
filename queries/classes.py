"""Queries for class statistics, distances, filters and suppression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    BALANCE,
    BALANCE_QIS,
    CUSTOMER_QIS,
    CUSTOMER_RULES,
    CUSTOMERS,
    K,
    ORDER_QIS,
    ORDER_RULES,
    ORDERS,
    customers,
    cut_sql,
    marked_sql,
    orders,
    query,
    table,
    without,
)
from veilwright.functions.chance import Chance
from veilwright.operators.classes import (
    attach_class_size,
    class_shares,
    class_sizes,
    class_stats,
    global_shares,
    without_masked,
)
from veilwright.operators.distance import class_distance
from veilwright.operators.diversity import diversity_measures
from veilwright.operators.generalize import generalize
from veilwright.operators.suppression import (
    drop_classes,
    drop_exact,
    drop_null_rows,
    newly_null_removed,
    null_cells,
    star_sync,
    suppress_values,
    without_flagged,
)
from veilwright.operators.wildcard import local_suppression
from veilwright.spec import MASKED

DIGITS = 9


def rounded(df, *names):
    """Rounded, and without the sign of a zero."""
    return df.withColumns({n: F.round(n, DIGITS) + F.lit(0.0) for n in names})


def gen_orders(spark, sf_dir):
    return generalize(orders(spark, sf_dir), ORDER_RULES)


def gen_customers(spark, sf_dir):
    return generalize(customers(spark, sf_dir), CUSTOMER_RULES)


OQ = ", ".join(ORDER_QIS)
CQ = ", ".join(CUSTOMER_QIS)
BQ = ", ".join(BALANCE_QIS)


@query(f"WITH {ORDERS} SELECT {OQ}, count(*) AS class_size FROM g GROUP BY {OQ}")
def class_size(spark, sf_dir):
    return class_sizes(gen_orders(spark, sf_dir), ORDER_QIS)


@query(
    """SELECT l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus, l_linenumber, count(*) AS class_size FROM lineitem
    WHERE l_linestatus <> 'O' GROUP BY ALL"""
)
def class_size_null_qi(spark, sf_dir):
    """A NULL quasi-identifier makes no class."""
    df = without(table(spark, sf_dir, "lineitem"), l_linestatus="O")
    return class_sizes(df, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(f"WITH {CUSTOMERS} SELECT *, count(*) OVER (PARTITION BY {CQ}) AS class_size FROM g")
def class_attach_size(spark, sf_dir):
    return attach_class_size(gen_customers(spark, sf_dir), CUSTOMER_QIS)


@query(f"WITH {CUSTOMERS}, s AS (SELECT *, count(*) OVER (PARTITION BY {CQ}) AS class_size FROM g) SELECT * FROM s WHERE class_size < {K}")
def filter_small_class(spark, sf_dir):
    return attach_class_size(gen_customers(spark, sf_dir), CUSTOMER_QIS).filter(F.col("class_size") < K)


STATS = """count(*) AS class_size, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values,
    count(DISTINCT v) + CAST(count(*) > count(v) AS INT) AS distinct_with_null"""


@query(
    f"""WITH {CUSTOMERS}, s AS (SELECT *, nullif(c_mktsegment, 'FURNITURE') AS v FROM g),
    n AS (SELECT {BQ}, v, count(*) AS n FROM s GROUP BY ALL),
    m AS (SELECT {BQ}, max(n) FILTER (v IS NOT NULL) AS top_count,
          max(n) FILTER (v IS NOT NULL) / CAST(sum(n) FILTER (v IS NOT NULL) AS DOUBLE) AS top_share FROM n GROUP BY {BQ})
    SELECT {BQ}, {STATS}, any_value(top_count) AS top_count, round(any_value(top_share), {DIGITS}) AS top_share
    FROM s JOIN m USING ({BQ}) GROUP BY {BQ}"""
)
def class_statistics(spark, sf_dir):
    df = without(gen_customers(spark, sf_dir), c_mktsegment="FURNITURE")
    return rounded(class_stats(df, BALANCE_QIS, ["c_mktsegment"]), "top_share")


@query(
    f"""WITH {ORDERS}, s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus || o_orderpriority END AS v FROM g),
    n AS (SELECT o_orderdate, o_totalprice, v, count(*) AS n FROM s GROUP BY ALL)
    SELECT o_orderdate, o_totalprice, CAST(sum(n) AS BIGINT) AS class_size, CAST(sum(n) FILTER (v IS NULL) AS BIGINT) AS nulls,
    count(v) AS distinct_values, count(v) + 1 AS distinct_with_null, max(n) FILTER (v IS NOT NULL) AS top_count,
    round(max(n) FILTER (v IS NOT NULL) / CAST(sum(n) FILTER (v IS NOT NULL) AS DOUBLE), {DIGITS}) AS top_share
    FROM n GROUP BY o_orderdate, o_totalprice"""
)
def class_statistics_pair(spark, sf_dir):
    """Two sensitive columns count as one combined value."""
    df = without(gen_orders(spark, sf_dir), o_orderstatus="P")
    return rounded(class_stats(df, ["o_orderdate", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]), "top_share")


@query(
    f"""WITH {ORDERS} SELECT {OQ}, o_orderstatus, count(*) AS n,
    round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY {OQ}) AS DOUBLE), {DIGITS}) AS share
    FROM g WHERE o_orderstatus <> 'P' GROUP BY {OQ}, o_orderstatus"""
)
def class_value_shares(spark, sf_dir):
    df = without(gen_orders(spark, sf_dir), o_orderstatus="P")
    return rounded(class_shares(df, ORDER_QIS, ["o_orderstatus"]), "share")


@query(
    f"""SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), {DIGITS}) AS share
    FROM events GROUP BY event_type"""
)
def global_share(spark, sf_dir):
    return rounded(global_shares(table(spark, sf_dir, "events"), "event_type"), "share")


def share_distance_ctes(rows: str, base: str, qis, value: str, base_value: str | None = None) -> str:
    """CTE ``w``: the distance by definition, from the two empirical step functions of each class."""
    q = ", ".join(qis)
    return f"""
    gs AS (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS x FROM {base}
           WHERE {base_value or value} IS NOT NULL GROUP BY {base_value or value}),
    gx AS (SELECT x, count(*) AS c FROM gs GROUP BY x),
    cs AS (SELECT {q}, count(*) / CAST(sum(count(*)) OVER (PARTITION BY {q}) AS DOUBLE) AS x FROM {rows}
           WHERE {value} IS NOT NULL GROUP BY {q}, {value}),
    pts AS (SELECT {q}, x, c AS u, 0 AS v FROM (SELECT DISTINCT {q} FROM cs), gx
            UNION ALL SELECT {q}, x, 0, 1 FROM cs),
    grp AS (SELECT {q}, x, CAST(sum(u) AS DOUBLE) AS u, CAST(sum(v) AS DOUBLE) AS v FROM pts GROUP BY {q}, x),
    run AS (SELECT {q}, x, lead(x) OVER o AS nx,
            sum(u) OVER o / sum(u) OVER (PARTITION BY {q}) AS fu, sum(v) OVER o / sum(v) OVER (PARTITION BY {q}) AS fv
            FROM grp WINDOW o AS (PARTITION BY {q} ORDER BY x)),
    w AS (SELECT {q}, coalesce(sum((nx - x) * abs(fu - fv)), 0.0) AS distance FROM run GROUP BY {q})"""


@query(
    f"WITH {ORDERS}, {share_distance_ctes('g', 'orders', ORDER_QIS, 'o_orderstatus')} "
    f"SELECT {OQ}, round(distance, {DIGITS}) + 0.0::DOUBLE AS distance FROM w"
)
def class_share_distance(spark, sf_dir):
    df = gen_orders(spark, sf_dir)
    far = class_distance(df, orders(spark, sf_dir), ORDER_QIS, "o_orderstatus")
    return rounded(far.select(*ORDER_QIS, "distance"), "distance")


@query(
    f"WITH {ORDERS}, {share_distance_ctes('g', 'orders', ['o_orderpriority', 'o_orderdate'], 'o_custkey')} "
    f"SELECT o_orderpriority, o_orderdate, round(distance, {DIGITS}) + 0.0::DOUBLE AS distance FROM w"
)
def class_share_distance_many(spark, sf_dir):
    """Many sensitive values: one per customer."""
    df = gen_orders(spark, sf_dir)
    qis = ["o_orderpriority", "o_orderdate"]
    return rounded(class_distance(df, orders(spark, sf_dir), qis, "o_custkey").select(*qis, "distance"), "distance")


def aligned_ctes(rows: str, base: str, qis, value: str) -> str:
    q = ", ".join(qis)
    return f"""
    gv AS (SELECT {value} AS val, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pg FROM {base}
           WHERE {value} IS NOT NULL GROUP BY {value}),
    cv AS (SELECT {q}, {value} AS val, count(*) / CAST(sum(count(*)) OVER (PARTITION BY {q}) AS DOUBLE) AS pc FROM {rows}
           WHERE {value} IS NOT NULL GROUP BY {q}, {value}),
    al AS (SELECT {q}, val, pg, coalesce(pc, 0.0) AS pc FROM (SELECT DISTINCT {q} FROM cv) k CROSS JOIN gv
           LEFT JOIN cv USING ({q}, val))"""


KL = "sum(CASE WHEN pc > 0 THEN pc * ln(pc / pg) ELSE 0.0 END)"
L1 = "sum(abs(pg - pc))"


@query(
    f"WITH {ORDERS}, {aligned_ctes('g', 'g', ORDER_QIS, 'o_orderstatus')} "
    f"SELECT {OQ}, round({KL}, {DIGITS}) + 0.0::DOUBLE AS distance FROM al GROUP BY {OQ}"
)
def class_kl(spark, sf_dir):
    df = gen_orders(spark, sf_dir)
    return rounded(class_distance(df, df, ORDER_QIS, "o_orderstatus", "kl"), "distance")


@query(
    f"WITH {CUSTOMERS}, {aligned_ctes('g', 'g', BALANCE_QIS, 'c_mktsegment')} "
    f"SELECT {BQ}, round({L1}, {DIGITS}) + 0.0::DOUBLE AS distance FROM al GROUP BY {BQ}"
)
def class_l1(spark, sf_dir):
    df = gen_customers(spark, sf_dir)
    return rounded(class_distance(df, df, BALANCE_QIS, "c_mktsegment", "l1"), "distance")


@query(
    f"""WITH {CUSTOMERS}, n AS (SELECT {BQ}, c_mktsegment AS v, count(*) AS n FROM g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY {BQ} ORDER BY n DESC) AS rk,
          n / CAST(sum(n) OVER (PARTITION BY {BQ}) AS DOUBLE) AS p FROM n)
    SELECT {BQ}, count(*) AS distinct_values, round(exp(-sum(p * ln(p))), {DIGITS}) + 0.0::DOUBLE AS entropy_l, max(n) AS top_count,
    CAST(coalesce(sum(n) FILTER (rk >= 3), 0) AS BIGINT) AS tail_count,
    max(n) < 2.0 * coalesce(sum(n) FILTER (rk >= 3), 0) AS recursive_ok FROM r GROUP BY {BQ}"""
)
def l_measures(spark, sf_dir):
    df = gen_customers(spark, sf_dir)
    return rounded(diversity_measures(df, BALANCE_QIS, "c_mktsegment", l=3, c=2.0), "entropy_l")


@query(
    """SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer
    WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')"""
)
def filter_masked(spark, sf_dir):
    df = without(customers(spark, sf_dir), c_mktsegment="BUILDING").select("c_custkey", "c_nationkey", "c_mktsegment")
    mark = F.when(F.col("c_mktsegment") == "FURNITURE", "is Masked").otherwise(F.col("c_mktsegment"))
    return without_masked(df.withColumn("c_mktsegment", mark), ["c_nationkey", "c_mktsegment"])


@query(
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'"""
)
def filter_new_null(spark, sf_dir):
    """Unknown from the start stays, unknown since suppression goes."""
    df = without(customers(spark, sf_dir).select("c_custkey", "c_mktsegment"), c_mktsegment="BUILDING")
    flagged = df.withColumn("was_null", F.col("c_mktsegment").isNull())
    return newly_null_removed(without(flagged, c_mktsegment="FURNITURE"), ["was_null"], ["c_mktsegment"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('FURNITURE', 'MACHINERY')")
def drop_rows_with_null(spark, sf_dir):
    df = customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    return drop_null_rows(without(without(df, c_mktsegment="FURNITURE"), c_mktsegment="MACHINERY"))


@query(
    f"WITH {cut_sql('orders', 'SELECT * FROM orders WHERE o_totalprice > 250000', 'o_orderkey', '42', 0.29, 'kept')} SELECT * FROM kept"
)
def sample_exact(spark, sf_dir):
    return drop_exact(orders(spark, sf_dir), F.col("o_totalprice") > 250000, 0.29, ["o_orderkey"], 42)


def cell_sql(column: str, key: str, name: str, seed: int, p: float) -> str:
    return f"CASE WHEN {uniform_sql(seed, name, key)} >= {p} THEN {column} END"


def uniform_sql(seed: int, name: str, key: str) -> str:
    digest = f"md5('{seed}|{name}|' || {marked_sql(key)})"
    return f"((CAST('0x' || substr({digest}, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query(
    "SELECT "
    + ", ".join(
        f"{cell_sql(c, 'c_custkey', f'cell/{c}', 7, 0.2)} AS {c}"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
    + " FROM customer"
)
def cell_null(spark, sf_dir):
    return null_cells(customers(spark, sf_dir), 0.2, Chance("hash", 7, ("c_custkey",)))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN '*' ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN '*' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey FROM customer"""
)
def star_rows(spark, sf_dir):
    df = without(customers(spark, sf_dir).select("c_custkey", "c_mktsegment", "c_nationkey"), c_mktsegment="FURNITURE")
    star = F.when(F.col("c_mktsegment") == "BUILDING", "*").otherwise(F.col("c_mktsegment"))
    return star_sync(df.withColumn("c_mktsegment", star), ["c_mktsegment", "c_nationkey"])


@query(
    f"""WITH s AS (SELECT *, count(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey, b) AS d
        FROM (SELECT *, {BALANCE} AS b FROM customer))
    SELECT c_custkey, c_nationkey, b AS c_acctbal, CASE WHEN d < 4 THEN 'Suppressed' ELSE c_mktsegment END AS c_mktsegment FROM s"""
)
def suppress_sensitive(spark, sf_dir):
    df = gen_customers(spark, sf_dir).select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    poor = class_stats(df, BALANCE_QIS, ["c_mktsegment"]).filter(F.col("distinct_values") < 4)
    return suppress_values(df, poor, BALANCE_QIS, "c_mktsegment")


def wildcard_ctes(source: str, qis, k: int, out: str = "ls") -> str:
    """CTE ``out``: ``source`` after local suppression, by CUBE over the rows."""
    q = ", ".join(qis)
    n = len(qis)
    # merit of a grouping set: columns kept, then the more important (earlier) ones
    kept = " + ".join(f"(1 - grouping({c}))" for c in qis)
    rank = " + ".join(f"(1 - grouping({c})) * {1 << (n - 1 - i)}" for i, c in enumerate(qis))
    flags = ", ".join(f"grouping({c}) AS gone_{i}" for i, c in enumerate(qis))
    match = " AND ".join(f"(cb.gone_{i} = 1 OR cb.{c} IS NOT DISTINCT FROM v.{c})" for i, c in enumerate(qis))
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM p.{c}" for c in qis)
    cells = ", ".join(f"CASE WHEN coalesce(p.gone_{i}, 0) = 0 THEN s.{c} END AS {c}" for i, c in enumerate(qis))
    return f"""
    cb AS (SELECT {q}, {flags}, ({kept}) * 1000 + ({rank}) AS merit, count(*) AS shared FROM {source} GROUP BY CUBE ({q})),
    v AS (SELECT {q}, count(*) AS size FROM {source} GROUP BY {q} HAVING count(*) < {k}),
    pm AS (SELECT v.*, {', '.join(f'cb.gone_{i}' for i in range(n))},
           row_number() OVER (PARTITION BY {', '.join(f'v.{c}' for c in qis)} ORDER BY cb.merit DESC) AS best
           FROM v JOIN cb ON {match} AND (cb.shared >= {k} OR cb.merit = 0)),
    p AS (SELECT * FROM pm WHERE best = 1),
    {out} AS (SELECT s.* REPLACE ({cells}) FROM {source} s LEFT JOIN p ON {same})"""


@query(f"WITH {CUSTOMERS}, {wildcard_ctes('g', CUSTOMER_QIS, K)} SELECT * FROM ls")
def k_local_suppression(spark, sf_dir):
    return local_suppression(gen_customers(spark, sf_dir), CUSTOMER_QIS, K)


@query(
    f"""WITH h AS (SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS c_nationkey, c_acctbal, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment
        FROM customer), g AS (SELECT * REPLACE ({BALANCE} AS c_acctbal) FROM h), {wildcard_ctes('g', CUSTOMER_QIS, 12)} SELECT * FROM ls"""
)
def k_local_suppression_nulls(spark, sf_dir):
    """Unknown values from the start, and a size that makes some rows lose two columns."""
    df = without(gen_customers(spark, sf_dir), c_mktsegment="FURNITURE")
    df = df.withColumn("c_nationkey", F.nullif(F.col("c_nationkey"), F.lit(3)))
    return local_suppression(df, CUSTOMER_QIS, 12)


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'")
def filter_sensitive_masked(spark, sf_dir):
    """A flagged sensitive value goes, an unknown one stays."""
    df = without(customers(spark, sf_dir).select("c_custkey", "c_mktsegment"), c_mktsegment="BUILDING")
    mark = F.when(F.col("c_mktsegment") == "FURNITURE", MASKED).otherwise(F.col("c_mktsegment"))
    return without_flagged(df.withColumn("c_mktsegment", mark), "c_mktsegment")


@query(
    f"""WITH {CUSTOMERS} SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY {CQ}) >= {K}"""
)
def drop_small_classes(spark, sf_dir):
    """An anti-join on the whole tuple of quasi-identifiers."""
    df = gen_customers(spark, sf_dir)
    return drop_classes(df, class_sizes(df, CUSTOMER_QIS).filter(F.col("class_size") < K), CUSTOMER_QIS)
