"""Queries for the privacy models over classes."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from queries.base import (
    BALANCE_QIS,
    CATALOG,
    CUSTOMER_KEY,
    CUSTOMER_QIS,
    CUSTOMER_RULES,
    CUSTOMERS,
    FINE_QIS,
    K,
    ORDER_KEY,
    ORDER_QIS,
    ORDER_RULES,
    ORDERS,
    THRESHOLD,
    customers,
    cut_sql,
    in_classes_sql,
    marked_sql,
    orders,
    query,
    table,
    without,
)
from queries.classes import (
    BQ,
    CQ,
    DIGITS,
    KL,
    L1,
    OQ,
    aligned_ctes,
    rounded,
    share_distance_ctes,
    wildcard_ctes,
)
from queries.generalisers import width_sql
from veilwright.operators.generalize import generalize
from veilwright.plans import classbased as models
from veilwright.plans.dispatch import anonymize, report_classes
from veilwright.plans.fulldomain import full_domain
from veilwright.plans.report import privacy_report
from veilwright.spec import PrivacyRequest

SMALL = f"count(*) < {K}"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def k_ctes(source: str, qis, key: str, k: int = K, out: str = "ka", salt: str = "42", fraction: float = THRESHOLD, text: str | None = None) -> str:
    return cut_sql(source, in_classes_sql(source, qis, f"count(*) < {k}"), key, salt, fraction, out, text)


@query(f"WITH {CUSTOMERS}, {k_ctes('g', CUSTOMER_QIS, 'c_custkey')} SELECT * FROM ka")
def k_partial(spark, sf_dir):
    return models.k_anonymity(customers(spark, sf_dir), CUSTOMER_QIS, K, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY)


@query(f"WITH {CUSTOMERS} {'SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY ' + CQ + f') >= {K}'}")
def k_partial_all(spark, sf_dir):
    """Threshold 1: true k-anonymity."""
    return models.k_anonymity(customers(spark, sf_dir), CUSTOMER_QIS, K, CUSTOMER_RULES, 1.0, CUSTOMER_KEY)


@query(
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), {k_ctes('o', ['o_custkey', 'o_orderpriority', 'o_orderstatus'], 'o_orderkey', 3)}
    SELECT * FROM ka"""
)
def k_partial_many_classes(spark, sf_dir):
    """Nearly as many classes as rows, and rows with an unknown quasi-identifier."""
    df = without(orders(spark, sf_dir), o_orderstatus="P")
    qis = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return models.k_anonymity(df, qis, 3, {}, THRESHOLD, ORDER_KEY)


@query(
    f"""WITH o AS (SELECT *, {' || '.join(marked_sql(c) for c in LINE_KEY)} AS k FROM lineitem),
    {k_ctes('o', ['l_suppkey', 'l_shipdate'], 'k', 2, text='k')} SELECT * EXCLUDE (k) FROM ka"""
)
def k_partial_wide(spark, sf_dir):
    """The largest table, with classes by supplier and day."""
    return models.k_anonymity(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate"], 2, {}, THRESHOLD, LINE_KEY)


@query(
    f"""WITH r AS (SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem),
    s AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag) AS size,
          md5('42|' || {' || '.join(marked_sql(c) for c in ('l_suppkey', 'l_linenumber', 'l_returnflag'))}) AS h FROM r),
    x AS (SELECT *, row_number() OVER (PARTITION BY size < 95 ORDER BY h) AS rk,
          count(*) FILTER (size < 95) OVER () AS cnt FROM s)
    SELECT l_suppkey, l_linenumber, l_returnflag FROM x
    WHERE NOT (size < 95 AND rk <= floor(CAST(cnt AS DOUBLE) * 0.3::DOUBLE))"""
)
def k_partial_copies(spark, sf_dir):
    """Rows without a key, all of them exact copies of many others."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    return models.k_anonymity(df, ["l_suppkey", "l_linenumber", "l_returnflag"], 95, {}, 0.3)


MOMENT = "make_timestamp(epoch_us(date_trunc('hour', ts)) + event_id % 5)"


@query(
    f"""WITH r AS (SELECT event_type, {MOMENT} AS ts, user_id % 3 AS part FROM events),
    s AS (SELECT *, count(*) OVER (PARTITION BY event_type, part, date_trunc('hour', ts)) AS size,
          md5('42|' || {marked_sql('event_type')} || {marked_sql('epoch_us(ts)')} || {marked_sql('part')}
              || {marked_sql("epoch_us(date_trunc('hour', ts))")}) AS h FROM r),
    x AS (SELECT *, row_number() OVER (PARTITION BY size < 3 ORDER BY h) AS rk, count(*) FILTER (size < 3) OVER () AS cnt FROM s)
    SELECT event_type, ts, part, date_trunc('hour', ts) AS hour FROM x
    WHERE NOT (size < 3 AND rk <= floor(CAST(cnt AS DOUBLE) * 0.3::DOUBLE))"""
)
def k_partial_moments(spark, sf_dir):
    """Rows without a key that differ by microseconds: several to a millisecond, some of them copies."""
    hour = F.date_trunc("hour", "ts")
    moment = F.timestamp_micros(F.unix_micros(hour) + F.col("event_id") % 5)
    df = table(spark, sf_dir, "events").select(
        "event_type", moment.alias("ts"), (F.col("user_id") % 3).alias("part"), hour.alias("hour")
    )
    return models.k_anonymity(df, ["event_type", "part", "hour"], 3, {}, 0.3)


WIDE_QIS = [
    "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "flag_a", "flag_b", "flag_c",
]
WIDE = f"""w AS (SELECT l_orderkey, l_suppkey % 2 AS l_suppkey, l_linenumber // 4 AS l_linenumber, floor(l_quantity / 26) AS l_quantity,
    l_discount >= 0.06 AS l_discount, l_tax >= 0.05 AS l_tax, l_returnflag, l_linestatus, l_orderkey % 2 AS flag_a,
    l_partkey % 2 AS flag_b, (l_orderkey // 2) % 3 AS flag_c FROM lineitem)"""


def wide_lines(spark, sf_dir):
    """Lines with ten quasi-identifiers."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_suppkey % 2 AS l_suppkey", "l_linenumber div 4 AS l_linenumber",
        "CAST(floor(l_quantity / 26) AS DOUBLE) AS l_quantity", "l_discount >= 0.06D AS l_discount", "l_tax >= 0.05D AS l_tax",
        "l_returnflag", "l_linestatus", "l_orderkey % 2 AS flag_a", "l_partkey % 2 AS flag_b", "(l_orderkey div 2) % 3 AS flag_c",
    )


@query(f"WITH {WIDE} SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY {', '.join(WIDE_QIS)}) >= 20")
def k_strict_ten(spark, sf_dir):
    """Ten quasi-identifiers."""
    return models.k_anonymity_strict(wide_lines(spark, sf_dir), WIDE_QIS, 20)


NINE_QIS = WIDE_QIS[:5] + WIDE_QIS[7:10] + ["flag_d"]
NINE = f"{WIDE}, g AS (SELECT l_orderkey, {', '.join(WIDE_QIS[:5] + WIDE_QIS[7:10])}, l_orderkey % 5 AS flag_d FROM w)"


@query(f"WITH {NINE}, {wildcard_ctes('g', NINE_QIS, 20)} SELECT * FROM ls")
def k_local_nine(spark, sf_dir):
    """Cells blanked among nine quasi-identifiers."""
    df = wide_lines(spark, sf_dir).withColumn("flag_d", F.col("l_orderkey") % 5).select("l_orderkey", *NINE_QIS)
    return models.k_anonymity_local(df, NINE_QIS, 20)


MANY = {
    f"n_{name}": expression
    for name, expression in {
        "all": "c_nationkey", "2": "c_nationkey % 2", "3": "c_nationkey % 3", "4": "c_nationkey % 4", "5": "c_nationkey % 5",
        "half": "CAST(floor(c_nationkey / 2) AS BIGINT)", "third": "CAST(floor(c_nationkey / 3) AS BIGINT)",
        "fifth": "CAST(floor(c_nationkey / 5) AS BIGINT)", "eighth": "CAST(floor(c_nationkey / 8) AS BIGINT)", "low": "c_nationkey < 10",
    }.items()
} | {
    f"s_{name}": expression
    for name, expression in {
        "all": "c_mktsegment", "first": "substring(c_mktsegment, 1, 1)", "last": "right(c_mktsegment, 1)",
        "length": "CAST(length(c_mktsegment) AS BIGINT)", "early": "c_mktsegment < 'H'", "known": "nullif(c_mktsegment, 'BUILDING')",
    }.items()
} | {
    f"b_{name}": f"CAST(floor(c_acctbal / {width}) AS BIGINT)" for name, width in (("1", 300), ("2", 600), ("4", 1200), ("8", 2400), ("16", 4800))
} | {"b_debt": "c_acctbal < 0", "b_rich": "c_acctbal > 5000", "k_half": "c_custkey % 2"}
MANY_SAME = " || ".join(f"CASE WHEN a.{c} IS NOT DISTINCT FROM b.{c} THEN '1' ELSE '0' END" for c in MANY)
MANY_KEPT = ", ".join(f"CASE WHEN substr(coalesce(p.mask, repeat('1', {len(MANY)})), {i + 1}, 1) = '1' THEN m.{c} END AS {c}" for i, c in enumerate(MANY))


# every pair of classes: with k = 2 what a class keeps is what it shares with one other class
@query(
    f"""WITH g AS (SELECT c_custkey, {", ".join(f"{e} AS {c}" for c, e in MANY.items())} FROM customer),
    m AS (SELECT *, dense_rank() OVER (ORDER BY {", ".join(MANY)}) AS class FROM g),
    c AS (SELECT class, {", ".join(MANY)}, count(*) AS n FROM m GROUP BY ALL),
    s AS (SELECT a.class, {MANY_SAME} AS mask FROM c a JOIN c b ON a.class <> b.class AND a.n < 2),
    p AS (SELECT class, arg_max(mask, (length(replace(mask, '0', '')), mask)) AS mask FROM s GROUP BY class)
    SELECT c_custkey, {MANY_KEPT} FROM m LEFT JOIN p USING (class)"""
)
def k_local_many(spark, sf_dir):
    """Cells blanked among two dozen quasi-identifiers, many of which follow from others."""
    df = customers(spark, sf_dir).selectExpr("c_custkey", *[f"{e} AS {c}" for c, e in MANY.items()])
    return models.k_anonymity_local(df, list(MANY), 2)


STRICT_K = f"{CUSTOMERS}, {wildcard_ctes('g', CUSTOMER_QIS, K)}"
UNMASKED = " AND ".join(f"{q} IS NOT NULL AND NOT contains(CAST({q} AS VARCHAR), 'Masked')" for q in CUSTOMER_QIS)


@query(
    f"""WITH {STRICT_K}, m AS (SELECT * FROM ls WHERE {UNMASKED})
    SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY {CQ}) >= {K}"""
)
def k_strict(spark, sf_dir):
    return models.k_anonymity_strict(customers(spark, sf_dir), CUSTOMER_QIS, K, CUSTOMER_RULES)


@query(
    f"""WITH h AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment FROM customer),
    g AS (SELECT * REPLACE ({CUSTOMERS.split('c_nationkey, ')[1].split(' AS c_acctbal')[0]} AS c_acctbal) FROM h),
    {wildcard_ctes('g', CUSTOMER_QIS, K)},
    f AS (SELECT ls.* FROM ls JOIN g USING (c_custkey) WHERE NOT (ls.c_nationkey IS NULL AND g.c_nationkey IS NOT NULL)
        AND NOT (ls.c_acctbal IS NULL AND g.c_acctbal IS NOT NULL) AND NOT (ls.c_mktsegment IS NULL AND g.c_mktsegment IS NOT NULL))
    SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY {CQ}) >= {K} OR c_mktsegment IS NULL"""
)
def k_new_null(spark, sf_dir):
    df = without(customers(spark, sf_dir), c_mktsegment="FURNITURE")
    return models.k_anonymity_new_nulls(df, CUSTOMER_QIS, K, CUSTOMER_RULES)


SEGMENTS = {"BUILDING": "property", "FURNITURE": "property"}
MAPPED = """g AS (SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal,
    CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'property' ELSE c_mktsegment END AS c_mktsegment FROM customer)"""
GROUP_QIS = ["c_nationkey", "c_mktsegment"]
MIN_GROUP = 14


@query(f"WITH {MAPPED} SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= {MIN_GROUP}")
def k_group_filter(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return models.k_anonymity_by_groups(df, GROUP_QIS, MIN_GROUP, {"c_mktsegment": SEGMENTS})


@query(
    """WITH lim AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part),
    st AS (SELECT lo, (hi - lo) / 3.0::DOUBLE AS s3, (hi - lo) / 2.0::DOUBLE AS s2, hi FROM lim),
    lv AS (SELECT p_partkey, p_size, p_type, p_brand,
        CAST(CAST(trunc(lo + s3 * i3) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(lo + s3 * i3 + s3 - 1) AS BIGINT) AS VARCHAR) AS l1,
        CAST(CAST(trunc(lo + s2 * i2) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(lo + s2 * i2 + s2 - 1) AS BIGINT) AS VARCHAR) AS l2,
        CAST(lo AS VARCHAR) || '-' || CAST(hi - 1 AS VARCHAR) AS l3
        FROM (SELECT *, CAST(p_size >= lo + s3 AS INT) + CAST(p_size >= lo + s3 * 2 AS INT) AS i3,
              CAST(p_size >= lo + s2 AS INT) AS i2 FROM part, st)),
    nodes AS (SELECT a, b, c, row_number() OVER (ORDER BY a + b + c, a, b, c) AS node
              FROM range(5) x(a), range(2) y(b), range(2) z(c)),
    gx AS (SELECT node, p_partkey, CASE a WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE '*' END AS p_size,
           CASE b WHEN 0 THEN p_type ELSE '*' END AS p_type, CASE c WHEN 0 THEN p_brand ELSE '*' END AS p_brand FROM lv, nodes),
    cl AS (SELECT node, p_size, p_type, p_brand, count(*) AS n FROM gx GROUP BY ALL),
    ok AS (SELECT min(node) AS node FROM (SELECT node FROM cl GROUP BY node
           HAVING coalesce(sum(n) FILTER (n < 30), 0) <= sum(n) * 0.05::DOUBLE))
    SELECT p_partkey, p_size, p_type, p_brand FROM gx JOIN ok USING (node)
    QUALIFY count(*) OVER (PARTITION BY p_size, p_type, p_brand) >= 30"""
)
def k_full_domain(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    return full_domain(df, ["p_size", "p_type", "p_brand"], 30, budget=0.05)


SIX = {"p_type": 2, "p_brand": 2, "part_fifth": 5, "type_start": 2, "size_band": 5, "price_band": 2}
SIX_TABLE = """p AS (SELECT p_partkey, p_type, p_brand, p_partkey % 5 AS part_fifth, substr(p_type, 1, 2) AS type_start,
    CAST(floor(p_size / 10) AS BIGINT) AS size_band, CASE WHEN p_retailprice > 950 THEN 'high' ELSE 'low' END AS price_band FROM part)"""
SIX_LIMITS = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c, depth in SIX.items() if depth > 2)


def six_label_sql(column: str, depth: int) -> str:
    """The label of a column at the level of the same name with an l before it."""
    if depth == 2:
        return f"CASE l_{column} WHEN 0 THEN {column} ELSE '*' END"
    lo, span = f"lo_{column}", f"(hi_{column} - lo_{column})"

    def interval(parts: int) -> str:
        step = f"({span} / {parts}.0::DOUBLE)"
        at = " + ".join(f"CAST({column} >= {lo} + {step} * {i} AS INT)" for i in range(1, parts)) or "0"
        start = f"({lo} + {step} * ({at}))"
        return f"CAST(CAST(trunc({start}) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc({start} + {step} - 1) AS BIGINT) AS VARCHAR)"

    middle = " ".join(f"WHEN {i + 1} THEN {interval(3 - i)}" for i in range(3))
    return f"CASE l_{column} WHEN 0 THEN CAST({column} AS VARCHAR) {middle} ELSE '*' END"


@query(
    f"""WITH {SIX_TABLE}, lim AS (SELECT {SIX_LIMITS} FROM p),
    nodes AS (SELECT *, row_number() OVER (ORDER BY {" + ".join(f"l_{c}" for c in SIX)}, {", ".join(f"l_{c}" for c in SIX)}) AS node
              FROM {", ".join(f"range({d}) r_{c}(l_{c})" for c, d in SIX.items())}),
    cl AS (SELECT {", ".join(SIX)}, count(*) AS n FROM p GROUP BY ALL),
    sz AS (SELECT node, {", ".join(f"{six_label_sql(c, d)} AS g_{c}" for c, d in SIX.items())}, sum(n) AS n FROM cl, lim, nodes GROUP BY ALL),
    ok AS (SELECT min(node) AS node FROM (SELECT node FROM sz GROUP BY node
           HAVING coalesce(sum(n) FILTER (n < 12), 0) <= sum(n) * 0.02::DOUBLE)),
    gx AS (SELECT p_partkey, {", ".join(f"{six_label_sql(c, d)} AS {c}" for c, d in SIX.items())} FROM p, lim, nodes JOIN ok USING (node))
    SELECT * FROM gx QUALIFY count(*) OVER (PARTITION BY {", ".join(SIX)}) >= 12"""
)
def k_full_domain_six(spark, sf_dir):
    """Six columns, two of them with five levels."""
    df = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_type", "p_brand", "p_partkey % 5 AS part_fifth", "substr(p_type, 1, 2) AS type_start",
        "CAST(floor(p_size / 10) AS BIGINT) AS size_band", "CASE WHEN p_retailprice > 950 THEN 'high' ELSE 'low' END AS price_band",
    )
    return full_domain(df, list(SIX), 12, budget=0.02)


def two_phase(source: str, qis, key: str, condition: str, flagged_from: str = "ka", extra: str = "", k: int = K) -> str:
    """k-phase on ``source``, then a second deletion among the classes that meet ``condition``."""
    second = cut_sql(flagged_from, in_classes_sql(flagged_from, qis, condition), key, "42/2", THRESHOLD, "kb")
    return f"{k_ctes(source, qis, key, k)} {extra}, {second} SELECT * FROM kb"


L = 4
POOR = f"count(DISTINCT c_mktsegment) < {L}"


@query(f"WITH {CUSTOMERS}, {two_phase('g', BALANCE_QIS, 'c_custkey', POOR, k=12)}")
def l_partial(spark, sf_dir):
    return models.l_diversity(
        customers(spark, sf_dir), BALANCE_QIS, "c_mktsegment", 12, L, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY
    )


@query(f"WITH {ORDERS}, {two_phase('g', FINE_QIS, 'o_orderkey', 'count(DISTINCT o_orderstatus) < 3')}")
def l_partial_many_classes(spark, sf_dir):
    return models.l_diversity(
        orders(spark, sf_dir), FINE_QIS, "o_orderstatus", K, 3, ORDER_RULES, THRESHOLD, ORDER_KEY
    )


@query(
    f"""WITH h AS (SELECT * REPLACE (nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment) FROM customer),
    g AS (SELECT * REPLACE ({CUSTOMERS.split('c_nationkey, ')[1].split(' AS c_acctbal')[0]} AS c_acctbal) FROM h),
    {wildcard_ctes('g', BALANCE_QIS, 12)},
    m AS (SELECT * FROM ls WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL
          QUALIFY count(*) OVER (PARTITION BY {BQ}) >= 12)
    SELECT m.* FROM m SEMI JOIN (SELECT {BQ} FROM m GROUP BY {BQ}
        HAVING count(DISTINCT c_mktsegment) + CAST(count(*) > count(c_mktsegment) AS INT) >= 5) USING ({BQ})"""
)
def l_strict(spark, sf_dir):
    df = without(customers(spark, sf_dir), c_mktsegment="FURNITURE")
    return models.l_diversity_strict(df, BALANCE_QIS, "c_mktsegment", 12, 5, CUSTOMER_RULES)


@query(
    f"""WITH g AS (SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal,
        CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'property' ELSE c_mktsegment END AS c_mktsegment FROM customer),
    m AS (SELECT *, trunc(c_acctbal / 100) AS cents FROM g QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= {MIN_GROUP}),
    d AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT cents) AS d FROM m GROUP BY ALL)
    SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN d < 16 THEN 'Suppressed' ELSE CAST(CAST(cents AS BIGINT) AS VARCHAR) END AS hundreds
    FROM m JOIN d USING (c_nationkey, c_mktsegment)"""
)
def l_suppress_value(spark, sf_dir):
    df = customers(spark, sf_dir).select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment",
        (F.col("c_acctbal") / 100).cast("bigint").alias("hundreds"),
    )
    return models.l_diversity_suppress(df, GROUP_QIS, "hundreds", MIN_GROUP, 16, {"c_mktsegment": SEGMENTS})


T = 0.125


def far_sql(rows: str, base: str, qis, value: str, t: float, base_value: str | None = None) -> str:
    q = ", ".join(qis)
    return f"""{share_distance_ctes(rows, base, qis, value, base_value)},
    far AS (SELECT {q} FROM w SEMI JOIN (SELECT {q} FROM {rows} GROUP BY {q}
            HAVING count(*) >= 2 AND count(*) = count({value})) USING ({q}) WHERE round(distance, 12) > {t})"""


@query(
    f"""WITH {ORDERS}, {k_ctes('g', ORDER_QIS, 'o_orderkey', 60)}, {far_sql('ka', 'orders', ORDER_QIS, 'o_orderstatus', 0.035)},
    {cut_sql('ka', f'SELECT ka.* FROM ka SEMI JOIN far USING ({OQ})', 'o_orderkey', '42/2', THRESHOLD, 'kb')} SELECT * FROM kb"""
)
def t_partial(spark, sf_dir):
    return models.t_closeness(
        orders(spark, sf_dir), ORDER_QIS, "o_orderstatus", 60, 0.035, ORDER_RULES, THRESHOLD, ORDER_KEY
    )


@query(
    f"""WITH h AS (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders),
    g AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_totalprice, o_orderstatus FROM h),
    {k_ctes('g', ['o_custkey'], 'o_orderkey', 8)},
    {far_sql('ka', 'g', ['o_custkey'], 'o_orderstatus', 0.2)},
    {cut_sql('ka', 'SELECT ka.* FROM ka SEMI JOIN far USING (o_custkey)', 'o_orderkey', '42/2', THRESHOLD, 'kb')} SELECT * FROM kb"""
)
def t_partial_nulls(spark, sf_dir):
    """Many small classes; those with an unknown sensitive value are exempt."""
    df = without(orders(spark, sf_dir), o_orderstatus="P")
    return models.t_closeness(df, ["o_custkey"], "o_orderstatus", 8, 0.2, {}, THRESHOLD, ORDER_KEY)


@query(
    f"""WITH {CUSTOMERS}, {wildcard_ctes('g', BALANCE_QIS, 12)},
    m AS (SELECT * FROM ls WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL),
    {far_sql('m', 'customer', BALANCE_QIS, 'c_mktsegment', 0.1)}
    SELECT m.* FROM m ANTI JOIN far USING ({BQ}) WHERE c_mktsegment IS DISTINCT FROM 'Masked'"""
)
def t_strict(spark, sf_dir):
    return models.t_closeness_strict(customers(spark, sf_dir), BALANCE_QIS, "c_mktsegment", 12, 0.1, CUSTOMER_RULES)


@query(
    f"""WITH {CUSTOMERS}, {aligned_ctes('g', 'g', BALANCE_QIS, 'c_mktsegment')},
    d AS (SELECT {BQ}, {KL} AS distance FROM al GROUP BY {BQ})
    SELECT {BQ}, round(distance, {DIGITS}) + 0.0::DOUBLE AS distance FROM d WHERE round(distance, 12) > {T}"""
)
def t_kl_report(spark, sf_dir):
    _, far = models.t_closeness_report(customers(spark, sf_dir), BALANCE_QIS, "c_mktsegment", T, CUSTOMER_RULES)
    return rounded(far, "distance")


@query(
    f"""WITH {CUSTOMERS}, b AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY {BQ}) >= 12),
    {aligned_ctes('b', 'b', BALANCE_QIS, 'c_mktsegment')},
    far AS (SELECT {BQ} FROM al GROUP BY {BQ} HAVING round({L1}, 12) > 0.45),
    {cut_sql('b', f'SELECT b.* FROM b SEMI JOIN far USING ({BQ})', 'c_custkey', '42', THRESHOLD, 'kb')} SELECT * FROM kb"""
)
def t_l1(spark, sf_dir):
    return models.t_closeness_l1(
        customers(spark, sf_dir), BALANCE_QIS, "c_mktsegment", 12, 0.45, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY
    )


@query(
    f"""WITH {CUSTOMERS}, {k_ctes('g', BALANCE_QIS, 'c_custkey', 12)},
    n AS (SELECT {BQ}, c_mktsegment, count(*) AS n FROM ka GROUP BY ALL),
    far AS (SELECT {BQ} FROM n GROUP BY {BQ} HAVING max(n) / CAST(sum(n) AS DOUBLE) > 1 / 2.5::DOUBLE),
    {cut_sql('ka', f'SELECT ka.* FROM ka SEMI JOIN far USING ({BQ})', 'c_custkey', '42/2', THRESHOLD, 'kb')} SELECT * FROM kb"""
)
def km_partial(spark, sf_dir):
    return models.km_anonymity(
        customers(spark, sf_dir), BALANCE_QIS, ["c_mktsegment"], 12, 2.5, CUSTOMER_RULES, THRESHOLD, CUSTOMER_KEY
    )


@query(
    f"""WITH h AS (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders), {k_ctes('h', ['o_custkey'], 'o_orderkey', 8)},
    n AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM ka WHERE o_orderstatus IS NOT NULL GROUP BY ALL),
    far AS (SELECT o_custkey FROM n GROUP BY ALL HAVING max(n) / CAST(sum(n) AS DOUBLE) > 1 / 3.0::DOUBLE),
    {cut_sql('ka', 'SELECT ka.* FROM ka SEMI JOIN far USING (o_custkey)', 'o_orderkey', '42/2', THRESHOLD, 'kb')} SELECT * FROM kb"""
)
def km_partial_pair(spark, sf_dir):
    """Two sensitive columns with unknown values."""
    df = without(orders(spark, sf_dir), o_orderstatus="P")
    return models.km_anonymity(
        df, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], 8, 3.0, {}, THRESHOLD, ORDER_KEY
    )


@query(
    f"""WITH {CUSTOMERS}, {wildcard_ctes('g', BALANCE_QIS, 12)}, m AS (SELECT * FROM ls WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL)
    SELECT m.* FROM m SEMI JOIN (SELECT {BQ} FROM m GROUP BY {BQ} HAVING count(*) >= 12 AND count(DISTINCT c_mktsegment) >= 5) USING ({BQ})"""
)
def km_strict(spark, sf_dir):
    return models.km_anonymity_strict(customers(spark, sf_dir), BALANCE_QIS, "c_mktsegment", 12, 5, CUSTOMER_RULES)


@query(
    f"""WITH {ORDERS}, {share_distance_ctes('g', 'orders', ORDER_QIS, 'o_orderstatus')}, {aligned_ctes('g', 'orders', ORDER_QIS, 'o_orderstatus')},
    kl AS (SELECT {OQ}, {KL} AS kl FROM al GROUP BY {OQ}),
    n AS (SELECT {OQ}, o_orderstatus, count(*) AS n FROM g GROUP BY ALL),
    s AS (SELECT {OQ}, CAST(sum(n) AS BIGINT) AS class_size, 0::BIGINT AS nulls, count(*) AS distinct_values, max(n) AS top_count,
          count(*) AS distinct_with_null, max(n) / CAST(sum(n) AS DOUBLE) AS top_share FROM n GROUP BY {OQ})
    SELECT {OQ}, class_size, nulls, distinct_values, top_count, distinct_with_null, round(top_share, {DIGITS}) AS top_share,
    round(distance, {DIGITS}) + 0.0::DOUBLE AS share_distance, round(kl, {DIGITS}) + 0.0::DOUBLE AS kl_divergence,
    class_size < 60 AS below_k, distinct_values < 3 AS below_l, top_share > 1 / 2.5::DOUBLE AS above_share,
    class_size >= 2 AND round(distance, 12) > 0.035 AS beyond_t
    FROM s JOIN w USING ({OQ}) JOIN kl USING ({OQ})"""
)
def class_report(spark, sf_dir):
    base = orders(spark, sf_dir)
    report = privacy_report(generalize(base, ORDER_RULES), base, ORDER_QIS, "o_orderstatus", k=60, l=3, m=2.5, t=0.035)
    return rounded(report, "top_share", "share_distance", "kl_divergence")


@query(f"WITH {CUSTOMERS}, {k_ctes('g', CUSTOMER_QIS, 'c_custkey')} SELECT * FROM ka")
def request_dispatch(spark, sf_dir):
    """The flagship again, through a request of text fields."""
    form = {
        "privacy_model": "k-anonymity",
        "k": str(K),
        "quasi_identifiers": ",".join(CUSTOMER_QIS),
        "sensitive_column": "c_name",
        "hierarchy_rules": '{"c_acctbal": {"method": "ordering", "layers": [{"min": -1000, "max": 0}, {"min": 0, "max": 2500},'
        ' {"min": "2500", "max": 5000}, {"min": 5000, "max": "10000"}]}, "c_mktsegment": {"method": "category"}}',
    }
    request = PrivacyRequest.from_form(form)
    return anonymize(customers(spark, sf_dir), replace(request, key=tuple(CUSTOMER_KEY)))


@query(
    f"""WITH c AS (SELECT c_nationkey, c_mktsegment, CAST(trunc(c_acctbal / 1000) AS INT) AS band FROM customer),
    {wildcard_ctes('c', ['c_nationkey', 'c_mktsegment', 'band'], K)} SELECT c_nationkey, c_mktsegment, band FROM ls"""
)
def k_raw_keys(spark, sf_dir):
    """Cells blanked in the table as it came; only the quasi-identifiers are returned."""
    band = (F.col("c_acctbal") / 1000).cast("int").alias("band")
    df = customers(spark, sf_dir).select("c_custkey", "c_nationkey", "c_mktsegment", band)
    return models.k_anonymity_keys(df, ["c_nationkey", "c_mktsegment", "band"], K)


@query(
    f"""WITH w AS ({width_sql('customer', 'c_custkey', 'c_acctbal', 'last')}), n AS ({width_sql('customer', 'c_custkey', 'CAST(c_nationkey AS DOUBLE)', 'last')}),
    g AS (SELECT c_custkey, c_name, n.label AS c_nationkey, w.label AS c_acctbal, '通用类别' AS c_mktsegment
          FROM customer JOIN w USING (c_custkey) JOIN n USING (c_custkey)),
    {wildcard_ctes('g', CUSTOMER_QIS, 190)} SELECT * FROM ls"""
)
def k_local_ranges(spark, sf_dir):
    """The first generation: no rules, equal-width bins, cells blanked."""
    return models.k_anonymity_local(customers(spark, sf_dir), CUSTOMER_QIS, 190, style="ranges")


@query(
    f"""WITH types AS (SELECT c_mktsegment AS v, 'type' || CAST(row_number() OVER (ORDER BY min(c_custkey)) AS VARCHAR) AS label FROM customer GROUP BY 1),
    {CUSTOMERS}, n AS (SELECT g.* REPLACE (label AS c_mktsegment) FROM g JOIN types ON types.v = g.c_mktsegment),
    {wildcard_ctes('n', CUSTOMER_QIS, K)}, m AS (SELECT * FROM ls WHERE {UNMASKED})
    SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY {CQ}) >= {K}"""
)
def k_strict_types(spark, sf_dir):
    """Layered rules whose categories become numbered types."""
    return models.k_anonymity_strict(
        customers(spark, sf_dir), CUSTOMER_QIS, K, CUSTOMER_RULES, order_col="c_custkey", style="types"
    )


@query(
    f"""WITH {CUSTOMERS}, n AS (SELECT {BQ}, c_mktsegment AS v, count(*) AS n FROM g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY {BQ} ORDER BY n DESC) AS rk, n / CAST(sum(n) OVER (PARTITION BY {BQ}) AS DOUBLE) AS p FROM n)
    SELECT {BQ}, count(*) AS distinct_values, round(exp(-sum(p * ln(p))), {DIGITS}) + 0.0::DOUBLE AS entropy_l, max(n) AS top_count,
    CAST(coalesce(sum(n) FILTER (rk >= 2), 0) AS BIGINT) AS tail_count, max(n) < coalesce(sum(n) FILTER (rk >= 2), 0) AS recursive_ok
    FROM r GROUP BY {BQ}"""
)
def l_report(spark, sf_dir):
    _, measures = models.l_diversity_report(customers(spark, sf_dir), BALANCE_QIS, "c_mktsegment", 2, CUSTOMER_RULES)
    return rounded(measures, "entropy_l")


def through_request(spark, df, model: str, rules, **form):
    """A model as a form asks for it."""
    request = PrivacyRequest.from_form({"privacy_model": model, "suppression_threshold": str(THRESHOLD), **form})
    return anonymize(df, replace(request, rules=rules))


@query(CATALOG["l_partial"].sql)
def request_l(spark, sf_dir):
    """The l-diversity of ``l_partial`` by a form, its phases parted by a checkpoint."""
    return through_request(
        spark, customers(spark, sf_dir), "l-diversity", CUSTOMER_RULES, k="12", l=str(L), key="c_custkey",
        quasi_identifiers=",".join(BALANCE_QIS), sensitive_column="c_mktsegment", checkpoint="true",
    )


@query(CATALOG["t_partial"].sql)
def request_t(spark, sf_dir):
    return through_request(
        spark, orders(spark, sf_dir), "t-closeness", ORDER_RULES, k="60", t="0.035", key="o_orderkey",
        quasi_identifiers=",".join(ORDER_QIS), sensitive_column="o_orderstatus", checkpoint="true",
    )


@query(CATALOG["km_partial"].sql)
def request_km(spark, sf_dir):
    return through_request(
        spark, customers(spark, sf_dir), "km-anonymity", CUSTOMER_RULES, k="12", m="2.5", key="c_custkey",
        quasi_identifiers=",".join(BALANCE_QIS), sensitive_column="c_mktsegment",
    )


@query(CATALOG["l_strict"].sql)
def request_l_classes(spark, sf_dir):
    """The strict l-diversity by a form."""
    df = without(customers(spark, sf_dir), c_mktsegment="FURNITURE")
    return through_request(
        spark, df, "l-diversity", CUSTOMER_RULES, treatment="classes", k="12", l="5",
        quasi_identifiers=",".join(BALANCE_QIS), sensitive_column="c_mktsegment",
    )


@query(CATALOG["t_l1"].sql)
def request_t_sized(spark, sf_dir):
    """Sizes first, then a share of the classes far by aligned shares, by a form and with a checkpoint."""
    return through_request(
        spark, customers(spark, sf_dir), "t-closeness", CUSTOMER_RULES, treatment="sized", k="12", t="0.45",
        quasi_identifiers=",".join(BALANCE_QIS), sensitive_column="c_mktsegment", key="c_custkey", checkpoint="true",
    )


@query(CATALOG["k_group_filter"].sql)
def request_groups(spark, sf_dir):
    """Values looked up in a dictionary that the form holds as text."""
    df = customers(spark, sf_dir).withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return through_request(
        spark, df, "k-anonymity", {}, treatment="groups", k=str(MIN_GROUP), quasi_identifiers=",".join(GROUP_QIS),
        mappings=json.dumps({"c_mktsegment": SEGMENTS}),
    )


@query(CATALOG["k_full_domain"].sql)
def request_levels(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    return through_request(
        spark, df, "k-anonymity", {}, treatment="levels", k="30", quasi_identifiers="p_size,p_type,p_brand",
        suppression_threshold="0.05",
    )


@query(CATALOG["t_kl_report"].sql)
def request_t_report(spark, sf_dir):
    """The classes that a report by a form finds too far away."""
    form = {"privacy_model": "t-closeness", "treatment": "report", "t": str(T), "sensitive_column": "c_mktsegment"}
    request = PrivacyRequest.from_form(form | {"quasi_identifiers": ",".join(BALANCE_QIS)})
    return rounded(report_classes(customers(spark, sf_dir), replace(request, rules=CUSTOMER_RULES)), "distance")
