"""Queries for the noise models, in hash mode so that SQL can repeat every draw."""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import functions as F

from queries.base import (
    CATALOG,
    DATE_LAYERS,
    PRICE_LAYERS,
    customers,
    date_layer_sql,
    date_rule,
    layer_sql,
    marked_sql,
    number_rule,
    orders,
    query,
    table,
    without,
)
from queries.classes import uniform_sql
from veilwright.functions.chance import Chance, gaussian_sd
from veilwright.plans.noisy import (
    differential_privacy,
    even_split,
    percent_split,
    randomized_response,
    response_probability,
)
from veilwright.plans.dispatch import anonymize
from veilwright.spec import PrivacyRequest, parse_rules

SEED = 11
ORDER_CHANCE = Chance("hash", SEED, ("o_orderkey",))
CUSTOMER_CHANCE = Chance("hash", SEED, ("c_custkey",))
DIGITS = 6


def laplace_sql(name: str, scale: float, key: str) -> str:
    plus, minus = uniform_sql(SEED, f"{name}/plus", key), uniform_sql(SEED, f"{name}/minus", key)
    return f"((ln({minus}) - ln({plus})) * {scale!r}::DOUBLE)"


def gaussian_sql(name: str, sd: float, key: str) -> str:
    radius, angle = uniform_sql(SEED, f"{name}/radius", key), uniform_sql(SEED, f"{name}/angle", key)
    return f"(sqrt(-2.0::DOUBLE * ln({radius})) * cos({2 * math.pi!r}::DOUBLE * {angle}) * {sd!r}::DOUBLE)"


def noisy_day_sql(column: str, noise: str) -> str:
    day = f"CAST(floor((epoch_us({column}) // 86400000000) + {noise}) AS BIGINT)"
    return f"coalesce(strftime(make_timestamp({day} * 86400000000), '%Y-%m-%d'), 'NaT')"


def blanked(expressions: dict[str, str], p: float, key: str) -> str:
    return ", ".join(
        f"CASE WHEN {uniform_sql(SEED, f'cell/{name}', key)} >= {p} THEN {value} END AS {name}"
        for name, value in expressions.items()
    )


EPSILON = 0.05
LAYERED_QIS = ["o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"]
LAYERED_SCALE = 1 / even_split(EPSILON, 1.0, len(LAYERED_QIS))
LAYERED_RULES = {
    "o_orderdate": date_rule(DATE_LAYERS[:2]),
    "o_totalprice": number_rule(PRICE_LAYERS[:3]),
    "o_orderpriority": {"method": "category"},
    "o_orderstatus": {"method": "masking", "maskingString": "*****"},
}
NOISY = noisy_day_sql("o_orderdate", laplace_sql("o_orderdate", LAYERED_SCALE, "o_orderkey"))
NOISY_LAYERED = date_layer_sql("TRY_CAST(noisy AS TIMESTAMP)", DATE_LAYERS[:2], "noisy")
LAYERED_CELLS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "CASE WHEN o_orderstatus = 'P' THEN 'Masked' ELSE '*****' END",
    "o_totalprice": layer_sql("o_totalprice", PRICE_LAYERS[:3], "CAST(o_totalprice AS VARCHAR)"),
    "o_orderdate": NOISY_LAYERED,
    "o_orderpriority": "CASE WHEN o_orderpriority = '5-LOW' THEN 'Unknown' ELSE o_orderpriority END",
}


@query(f"SELECT {blanked(LAYERED_CELLS, 0.1, 'o_orderkey')} FROM (SELECT *, {NOISY} AS noisy FROM orders)")
def dp_layered(spark, sf_dir):
    """Dates with noise and layers, numbers with layers only, masks, own text, blanked cells."""
    df = without(orders(spark, sf_dir), o_orderpriority="5-LOW", o_orderstatus="P")
    return differential_privacy(
        df, LAYERED_QIS, EPSILON, parse_rules(LAYERED_RULES), budget=1.0, threshold=0.1, chance=ORDER_CHANCE
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '**' ELSE '***' END AS o_orderstatus FROM orders")
def dp_masking_compat(spark, sf_dir):
    """An unknown value masked through its text."""
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    text = F.when(F.col("o_orderstatus") == "P", "abcdefgh").otherwise(F.lit(None).cast("string"))
    df = df.withColumn("o_orderstatus", text)
    rules = parse_rules({"o_orderstatus": {"method": "masking", "maskingString": "aaa**"}})
    out = differential_privacy(df, ["o_orderstatus"], 1.0, rules, compat=True, chance=ORDER_CHANCE)
    # "nan" is no longer than the three letters kept, so it turns into three stars
    return out.withColumn("o_orderstatus", F.regexp_replace("o_orderstatus", "^abc", ""))


@query(
    f"""SELECT c_custkey, 'Masked' AS c_name, c_nationkey, c_mktsegment,
    round(c_acctbal + {laplace_sql('c_acctbal', 1 / 0.5, 'c_custkey')}, {DIGITS}) AS c_acctbal FROM customer"""
)
def dp_laplace(spark, sf_dir):
    """Laplace noise at scale 1 / epsilon on numbers; constant mask."""
    rules = parse_rules({"c_acctbal": "ordering", "c_name": "masking"})
    out = differential_privacy(
        customers(spark, sf_dir), ["c_acctbal", "c_name"], 0.5, rules, variant="laplace", chance=CUSTOMER_CHANCE
    )
    return rounded_to(out, "c_acctbal")


def rounded_to(df, *names):
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


@query(
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
    round(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END
          + {gaussian_sql('o_totalprice', gaussian_sd(2.0, 1e-6), 'o_orderkey')}, {DIGITS}) AS o_totalprice,
    {noisy_day_sql("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END",
                   gaussian_sql('o_orderdate', gaussian_sd(2.0, 1e-6), 'o_orderkey'))} AS o_orderdate FROM orders"""
)
def dp_gaussian(spark, sf_dir):
    """Gaussian noise on dates and numbers; unknown stays unknown."""
    known = F.col("o_orderstatus") != "P"
    df = orders(spark, sf_dir).withColumns(
        {c: F.when(known, F.col(c)) for c in ("o_totalprice", "o_orderdate")}
    )
    rules = parse_rules({"o_totalprice": "ordering", "o_orderdate": "dates"})
    out = differential_privacy(
        df, ["o_totalprice", "o_orderdate"], 2.0, rules, variant="gaussian", chance=ORDER_CHANCE
    )
    return rounded_to(out, "o_totalprice")


REBIN_SD = gaussian_sd(percent_split(3.0, 50.0, 3), 1e-6)


@query(
    f"""WITH lim AS (SELECT floor(min(p_size) / 10) * 10 AS lo, ceil(max(p_size) / 10) * 10 AS hi FROM part),
    n AS (SELECT *, {gaussian_sql('p_size', REBIN_SD, 'p_partkey')} AS noise FROM part, lim),
    v AS (SELECT *, p_size + noise AS x, greatest(ceil((p_size + noise) / 10) * 10, lo + 10) AS top FROM n),
    d AS (SELECT *, CASE WHEN abs(noise) < 0.5 THEN '*' WHEN x < lo OR x > hi THEN NULL
          ELSE CAST(CAST(top - 10 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(top AS BIGINT) AS VARCHAR) END AS b FROM v)
    SELECT p_partkey, CASE WHEN b IS NULL OR b = '*' THEN '*' ELSE 'Masked' END AS p_name,
    CASE WHEN b IS NULL OR b = '*' THEN '*' ELSE p_brand END AS p_brand, p_type, coalesce(b, '*') AS p_size, p_retailprice FROM d"""
)
def dp_budget_rebin(spark, sf_dir):
    """Decades of noisy numbers; small draws and draws out of range star the whole row."""
    rules = parse_rules({"p_size": "ordering", "p_name": "masking"})
    return differential_privacy(
        table(spark, sf_dir, "part"), ["p_size", "p_name", "p_brand"], 3.0, rules, budget=50.0, threshold=0.5,
        variant="budgeted_gaussian", chance=Chance("hash", SEED, ("p_partkey",)),
    )


@query(
    """SELECT o_orderkey, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS o_orderdate, 'Masked' AS o_orderpriority FROM orders"""
)
def dp_budget_quarters(spark, sf_dir):
    rules = parse_rules({"o_orderdate": "dates", "o_orderpriority": "masking"})
    return differential_privacy(
        orders(spark, sf_dir).select("o_orderkey", "o_orderdate", "o_orderpriority"), ["o_orderdate", "o_orderpriority"],
        1.0, rules, variant="budgeted_gaussian", chance=ORDER_CHANCE,
    )


def response_sql(source: str, column: str, key: str, probability: float) -> str:
    hit, pick = uniform_sql(SEED, f"{column}/hit", key), uniform_sql(SEED, f"{column}/pick", key)
    return f"""nv AS (SELECT {column} AS val, row_number() OVER (ORDER BY substr(md5('{SEED}|' || {marked_sql(column)}), 1, 12), {column}) AS num
        FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL)),
    dr AS (SELECT s.*, nv.num, {hit} AS hit, least(floor({pick} * (SELECT count(*) - 1 FROM nv)), (SELECT count(*) - 2 FROM nv)) + 1 AS step
        FROM {source} s LEFT JOIN nv ON s.{column} = nv.val),
    rr AS (SELECT dr.* EXCLUDE (num, hit, step) REPLACE (CASE WHEN dr.{column} IS NOT NULL AND hit < {probability!r}::DOUBLE
        THEN (SELECT val FROM nv n2 WHERE n2.num = CASE WHEN step < dr.num THEN step ELSE step + 1 END) ELSE dr.{column} END AS {column}) FROM dr)"""


@query(
    f"""WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders),
    {response_sql('o', 'o_orderpriority', 'o_orderkey', 0.3)} SELECT * FROM rr"""
)
def dp_randomized_response(spark, sf_dir):
    df = without(orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), o_orderpriority="5-LOW")
    return randomized_response(df, "o_orderpriority", 0.3, ORDER_CHANCE)


@query(
    f"""WITH o AS (SELECT o_orderkey, o_custkey FROM orders),
    {response_sql('o', 'o_custkey', 'o_orderkey', 0.3)} SELECT * FROM rr"""
)
def dp_randomized_response_many(spark, sf_dir):
    """One value per customer: the list of values is a table, not an array."""
    return randomized_response(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", 0.3, ORDER_CHANCE)


RESPONSE_EPSILON = 1.0
RESPONSE_SCALE = 1 / even_split(RESPONSE_EPSILON, 2.0, 4)
RESPONSE_CELLS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "CAST(o_custkey AS VARCHAR)",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": f"round(o_totalprice + {laplace_sql('o_totalprice', RESPONSE_SCALE, 'o_orderkey')}, {DIGITS})",
    "o_orderdate": noisy_day_sql("o_orderdate", laplace_sql("o_orderdate", RESPONSE_SCALE, "o_orderkey")),
    "o_orderpriority": "o_orderpriority",
}
CUT_CUSTOMER = "CASE WHEN length(o_custkey) > 2 THEN left(o_custkey, length(o_custkey) - 2) || '**' ELSE o_custkey END"


@query(
    f"""WITH o AS (SELECT * FROM orders), {response_sql('o', 'o_orderpriority', 'o_orderkey', response_probability(RESPONSE_EPSILON))},
    c AS (SELECT {blanked(RESPONSE_CELLS, 0.05, 'o_orderkey')} FROM rr)
    SELECT * REPLACE ({CUT_CUSTOMER} AS o_custkey) FROM c WHERE COLUMNS(*) IS NOT NULL"""
)
def dp_laplace_response(spark, sf_dir):
    """Noise, randomised response, cut text, blanked cells, and only full rows in the end."""
    rules = parse_rules(
        {"o_totalprice": "ordering", "o_orderdate": "dates", "o_orderpriority": "category", "o_custkey": "masking"}
    )
    out = differential_privacy(
        orders(spark, sf_dir), ["o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey"], RESPONSE_EPSILON, rules,
        budget=2.0, threshold=0.05, variant="laplace_response", chance=ORDER_CHANCE,
    )
    return rounded_to(out, "o_totalprice")


TYPED_CELLS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "s.label",
    "o_totalprice": layer_sql("o_totalprice", PRICE_LAYERS[:3], "CAST(o_totalprice AS VARCHAR)"),
    "o_orderdate": NOISY_LAYERED,
    "o_orderpriority": "p.label",
}


def first_seen_sql(column: str, prefix: str) -> str:
    return f"""(SELECT {column} AS v, '{prefix}' || CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS VARCHAR) AS label
    FROM orders GROUP BY {column})"""


TYPED_SCALE_QIS = ["o_orderdate", "o_totalprice", "o_orderpriority", "o_custkey"]


@query(
    f"""WITH c AS (SELECT {blanked(TYPED_CELLS, 0.05, 'o_orderkey')}
        FROM (SELECT *, {NOISY} AS noisy FROM orders) o
        JOIN {first_seen_sql('o_orderpriority', 'type')} p ON p.v = o_orderpriority
        JOIN {first_seen_sql('o_orderstatus', 'sensitive_type')} s ON s.v = o_orderstatus)
    SELECT * FROM c WHERE COLUMNS(*) IS NOT NULL"""
)
def dp_layered_typed(spark, sf_dir):
    rules = parse_rules({**LAYERED_RULES, "o_orderstatus": {"method": "category"}})
    return differential_privacy(
        orders(spark, sf_dir), TYPED_SCALE_QIS, EPSILON, rules, budget=1.0, threshold=0.05, sensitive=["o_orderstatus"],
        variant="layered_typed", chance=ORDER_CHANCE, order_col="o_orderkey",
    )


@query(
    f"""SELECT count(*) AS rows, {', '.join(f'true AS nulls_{c}' for c in LAYERED_CELLS)}, true AS pairs,
    true AS noise_mean, true AS noise_spread FROM orders"""
)
def dp_random(spark, sf_dir):
    """The engine's own generator: facts about all rows that hold for any independent draws.

    Null shares and the agreement of two columns' nulls lie within six standard deviations of what
    independence gives, mean and spread of the noise within as many of theirs.
    """
    p, df = 0.1, orders(spark, sf_dir)
    out = differential_privacy(
        df, LAYERED_QIS, EPSILON, parse_rules(LAYERED_RULES), budget=1.0, threshold=p, chance=Chance("random", SEED)
    )
    n = F.count(F.lit(1))

    def near(flag, share):
        return F.abs(F.avg(flag.cast("double")) - share) < 6 * F.sqrt(F.lit(share * (1 - share)) / n)

    nulls = {c: F.col(c).isNull() for c in LAYERED_CELLS}
    pairs = [near(nulls[a] == nulls[b], p * p + (1 - p) ** 2) for a, b in combinations(nulls, 2)]
    blanked_facts = out.agg(
        n.alias("rows"), *[near(null, p).alias(f"nulls_{c}") for c, null in nulls.items()], reduce(and_, pairs).alias("pairs")
    )
    # the price layers apart, the noise of the "laplace" variant can be read off a number
    rules = parse_rules({"o_totalprice": "ordering"})
    noisy = differential_privacy(
        df.withColumn("before", F.col("o_totalprice")), ["o_totalprice"], 0.5, rules, variant="laplace",
        chance=Chance("random", SEED),
    )
    noise = F.col("o_totalprice") - F.col("before")
    sd = math.sqrt(2) / 0.5
    noise_facts = noisy.agg(
        (F.abs(F.avg(noise)) < 6 * sd / F.sqrt(n)).alias("noise_mean"),
        # the fourth moment of this noise is six times the squared second
        (F.abs(F.avg(noise * noise) - sd**2) < 6 * sd**2 * math.sqrt(5) / F.sqrt(n)).alias("noise_spread"),
    )
    return blanked_facts.join(F.broadcast(noise_facts), F.lit(True))


@query(
    f"""SELECT event_id, user_id, event_type, props, round(value + {laplace_sql('value', 2.0, 'event_id')}, {DIGITS}) AS value,
    {noisy_day_sql('ts', laplace_sql('ts', 2.0, 'event_id'))} AS ts FROM events"""
)
def dp_laplace_events(spark, sf_dir):
    """Moments within a day count from the start of their day."""
    out = differential_privacy(
        table(spark, sf_dir, "events"), ["ts", "value"], 0.5, parse_rules({"ts": "dates", "value": "ordering"}),
        variant="laplace", chance=Chance("hash", SEED, ("event_id",)),
    )
    return rounded_to(out, "value")


RESPONSE_LAYER_CELLS = {
    "o_orderkey": "o_orderkey",
    "o_orderdate": NOISY_LAYERED,
    "o_totalprice": layer_sql("price", ((0, 600000),), "CAST(price AS VARCHAR)"),
    "o_orderpriority": "label",
}
LAYER_QIS = ["o_orderdate", "o_totalprice", "o_orderpriority", "o_orderkey"]
LAYER_SCALE = 1 / even_split(EPSILON, 1.0, len(LAYER_QIS))


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders),
    {response_sql('o', 'o_orderpriority', 'o_orderkey', response_probability(EPSILON))},
    t AS (SELECT o_orderpriority AS v, 'type' || CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS VARCHAR) AS label FROM rr GROUP BY 1),
    n AS (SELECT o_orderkey, {NOISY} AS noisy, label, o_totalprice + {laplace_sql('o_totalprice', LAYER_SCALE, 'o_orderkey')} AS price
          FROM rr JOIN t ON t.v = o_orderpriority),
    c AS (SELECT {blanked(RESPONSE_LAYER_CELLS, 0.05, 'o_orderkey')} FROM n)
    SELECT * FROM c WHERE COLUMNS(*) IS NOT NULL"""
)
def dp_layered_response(spark, sf_dir):
    """Noise on numbers before their layers; randomised answers, then numbered types."""
    rules = parse_rules({**LAYERED_RULES, "o_totalprice": number_rule(((0, 600000),))})
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return differential_privacy(
        df, LAYER_QIS, EPSILON, rules, budget=1.0, threshold=0.05, variant="layered_response", chance=ORDER_CHANCE,
        order_col="o_orderkey",
    )


@query(CATALOG["dp_layered"].sql)
def request_noise(spark, sf_dir):
    """The noise of ``dp_layered`` by a form, drawn from hashes."""
    df = without(orders(spark, sf_dir), o_orderpriority="5-LOW", o_orderstatus="P")
    form = {
        "privacy_model": "differential_privacy", "e": str(EPSILON), "budget": "1", "suppression_threshold": "0.1",
        "quasi_identifiers": ",".join(LAYERED_QIS), "hierarchy_rules": json.dumps(LAYERED_RULES), "noise": "hash",
        "seed": str(SEED), "key": "o_orderkey",
    }
    return anonymize(df, PrivacyRequest.from_form(form))
