"""Removing rows and blanking cells.

The central operator, ``drop_share``, deletes exactly ``floor(count * fraction)`` of the rows
of some classes.  Ranking those rows would sort them in one task.  Instead every row gets a
hash, and only the hash *at* the cut is looked for: a histogram over the first five hex
digits (at most 2^20 rows whatever the table holds) names the bucket of the cut.  The hashes in that
bucket are counted and written down, and the next digits are looked at there until at most ``MOST_ORDERED``
are left to be put in order.  No later step reads the rows again, and row payloads are never sorted.

What is found is a ``Deletion``: a measured list of classes (see ``lists``) and the hash up to which their rows go.
Several deletions in a row are decided one after the other on the columns they need, and then
take effect together in one join of the whole rows with one list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from veilwright.functions.chance import Chance, content_text, keyed_hash
from veilwright.operators.lineage import stored
from veilwright.operators.lists import Listed, listed
from veilwright.operators.matching import all_of, cols, key_side, same_key
from veilwright.spec import MASKED, STAR, SUPPRESSED, check_fraction
from veilwright.streaming import require_batch

BLOCK_ROWS = 65_536
#: Hex digits that one histogram looks at, and the digits of a hash.
BUCKET_DIGITS, DIGITS = 5, 32
#: Hashes that are put in order in one task.
MOST_ORDERED = 1 << 20
#: Comes after every hash, before every hash.
ALL, NONE = "~", ""


def drop_classes(
    rows: DataFrame, classes: DataFrame, qis: Sequence[str], null_safe: bool = False, join: object = "drop"
) -> DataFrame:
    """Remove every row of the listed classes.

    Rows with a NULL quasi-identifier stay, unless ``null_safe`` takes NULL for a value.
    ``join`` names the join; see ``matching`` for why consecutive ones need different names.
    """
    return listed(rows, classes, qis).without(rows, join, null_safe)


def rows_of(rows: DataFrame, classes: DataFrame, qis: Sequence[str], join: object = "keep") -> DataFrame:
    """Only the rows of the listed classes."""
    return rows.join(key_side(rows, classes, qis, join=join), same_key(qis, join), "left_semi")


def _edge(counts: DataFrame, by: str, wanted: int | None, fraction: float) -> Row | None:
    """The row of ``counts`` in which the last row to go lies: ``upto`` it, its ``n``, what is ``wanted`` of all.

    Ordered in one task: only for counts of bounded number.
    """
    order = Window.orderBy(by)
    running = counts.withColumns(
        {
            "upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "total": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    # floor in double arithmetic: 100 * 0.29 leaves 28, as it does in the float type
    goal = F.floor(F.col("total") * F.lit(float(fraction))) if wanted is None else F.lit(wanted)
    held = running.withColumn("wanted", goal).filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
    found = held.collect()
    return found[0] if found else None


def hash_cut(hashes: DataFrame, fraction: float, unique: bool) -> tuple[str, int] | None:
    """The hash up to which rows go, and how many rows with exactly that hash must stay; None when nothing goes.

    ``hashes`` has one column, ``hash``.  With unique hashes none must stay, and if keys repeat there
    is an error rather than a wrong number of rows deleted.
    """
    place = F.substring("hash", 1, BUCKET_DIGITS)
    one = F.count(F.lit(1)).alias("n")
    edge = _edge(hashes.groupBy(place.alias("bucket")).agg(one), "bucket", None, fraction)
    if edge is None:
        return None
    # copies of one hash are counted before they are ordered
    inside = stored(hashes.filter(place == edge["bucket"]).groupBy("hash").agg(one))
    digits, left, rest = BUCKET_DIGITS, inside.count(), edge["wanted"] - (edge["upto"] - edge["n"])
    while left > MOST_ORDERED and digits < DIGITS:
        place = F.substring("hash", digits + 1, BUCKET_DIGITS)
        counts = inside.groupBy(place.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hashes"))
        edge = _edge(counts, "bucket", rest, fraction)
        inside = inside.filter(place == edge["bucket"])
        digits, left, rest = digits + BUCKET_DIGITS, edge["hashes"], rest - (edge["upto"] - edge["n"])
    at_cut = _edge(inside, "hash", rest, fraction)
    spare = at_cut["upto"] - rest
    if unique and spare:
        raise ValueError("key columns do not identify rows: the cut falls on a repeated key")
    return at_cut["hash"], spare


@dataclass(frozen=True)
class Deletion:
    """Rows of the listed classes go up to a hash; of those with exactly that hash ``spare`` stay."""

    classes: Listed | None
    digest: Column | None
    limit: str
    spare: int
    salt: object


def _digest(rows: DataFrame, key: Sequence[str] | None, salt: object) -> Column:
    if key:
        return keyed_hash(salt, key)
    return F.md5(F.concat_ws("|", F.lit(str(salt)), content_text(rows)))


def share_of_classes(
    rows: DataFrame,
    classes: DataFrame,
    qis: Sequence[str],
    fraction: float,
    key: Sequence[str] | None = None,
    salt: object = 42,
) -> Deletion:
    """Decide on ``floor(count * fraction)`` rows, chosen by hash over all listed classes together.

    ``key`` names columns that identify a row; only those and the quasi-identifiers are read then.
    Without it rows are told apart by their content.
    """
    require_batch(rows, "exact-size suppression")
    fraction = check_fraction(fraction)
    if fraction == 0.0:  # nothing to count
        return Deletion(None, None, NONE, 0, salt)
    found = listed(rows, classes, qis)
    if fraction == 1.0 or not found.rows:
        return Deletion(found, None, ALL, 0, salt)
    digest = _digest(rows, key, salt)
    cut = hash_cut(found.only(rows, salt).select(digest.alias("hash")), fraction, unique=bool(key))
    limit, spare = cut if cut else (NONE, 0)
    return Deletion(found, digest, limit, spare, salt)


def without_deleted(rows: DataFrame, *deletions: Deletion) -> DataFrame:
    """The rows that no deletion takes, after one join with one list of classes and limits.

    Only a single deletion may spare copies: those are rows without a key, which are equal in all columns.
    """
    due = [d for d in deletions if d.limit != NONE]
    if not due:
        return rows
    if len(due) == 1 and due[0].limit == ALL:
        return due[0].classes.without(rows, due[0].salt)
    keys, every = due[0].classes.keys, None
    for at, deletion in enumerate(due):
        limits = [F.lit(deletion.limit if i == at else None).cast("string").alias(f"limit_{i}") for i in range(len(due))]
        part = deletion.classes.table.select(*keys, *limits)
        every = part if every is None else every.unionByName(part)
    limits = [f"limit_{i}" for i in range(len(due))]
    if len(due) > 1:  # a class may be in several lists
        every = every.groupBy(*keys).agg(*[F.max(limit).alias(limit) for limit in limits])
    found = due[0].classes.renewed(every, limits)
    gone = {f"limit_{i}": F.lit("") if d.limit == ALL else d.digest for i, d in enumerate(due)}
    kept = found.without(rows, "|".join(str(d.salt) for d in due), gone=gone)
    return kept.unionByName(_copies(rows, due[0])) if len(due) == 1 and due[0].spare else kept


def _copies(rows: DataFrame, deletion: Deletion) -> DataFrame:
    """The spared copies at the cut: as many rows with the hash of the cut as must stay.

    Rows without a key can only be told apart by content.  Equal rows are counted, not ranked.
    Should different contents share the hash, they take their turns in the order of their text, so
    that together they keep the right number.  The copies are written out again block by block: the
    blocks spread over all tasks even if the copies are a third of the table.
    """
    at_cut = deletion.classes.only(rows.filter(deletion.digest == deletion.limit), deletion.salt)
    own = F.struct(*cols(rows.columns))
    contents = at_cut.groupBy(content_text(rows).alias("content")).agg(F.count(F.lit(1)).alias("n"), F.first(own).alias("row"))
    turn = Window.orderBy("content").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(deletion.spare) - F.coalesce(F.sum("n").over(turn), F.lit(0))
    one = contents.withColumn("left", F.least(room, F.col("n"))).filter(F.col("left") > 0)
    one_long = F.lit(1).cast("bigint")
    spread = one.withColumn("block", F.explode(F.sequence(one_long, F.ceil(F.col("left") / BLOCK_ROWS)))).repartition("block")
    size = F.least(F.lit(BLOCK_ROWS).cast("bigint"), F.col("left") - (F.col("block") - 1) * BLOCK_ROWS)
    copies = spread.withColumn("copy", F.explode(F.sequence(one_long, size)))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in rows.columns])


def drop_share(
    rows: DataFrame,
    classes: DataFrame,
    qis: Sequence[str],
    fraction: float,
    key: Sequence[str] | None = None,
    salt: object = 42,
) -> DataFrame:
    """Delete ``floor(count * fraction)`` rows, chosen by hash over all listed classes together.

    ``key`` names columns that identify a row.  Without it rows are told apart by their content.
    """
    return without_deleted(rows, share_of_classes(rows, classes, qis, fraction, key, salt))


def drop_exact(
    rows: DataFrame, flag: Column, fraction: float, key: Sequence[str], salt: object = 42
) -> DataFrame:
    """Delete ``floor(count * fraction)`` of the rows where ``flag`` holds, chosen by hash."""
    require_batch(rows, "exact-size suppression")
    fraction = check_fraction(fraction)
    if fraction == 0.0:
        return rows
    flagged = F.coalesce(flag, F.lit(False))
    if fraction == 1.0:
        return rows.filter(~flagged)
    digest = keyed_hash(salt, key)
    cut = hash_cut(rows.filter(flagged).select(digest.alias("hash")), fraction, unique=True)
    return rows.filter(~flagged | (digest > cut[0])) if cut else rows


def null_cells(df: DataFrame, probability: float, chance: Chance) -> DataFrame:
    """Blank every cell of every column independently with the given probability."""
    probability = check_fraction(probability)
    if probability == 0.0:
        return df
    return df.select(
        *[F.when(chance.uniform(f"cell/{c}") >= probability, F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Only rows without any NULL."""
    return df.na.drop("any")


def newly_null_removed(df: DataFrame, before: Sequence[str], qis: Sequence[str]) -> DataFrame:
    """Drop rows where a quasi-identifier is NULL although its flag column says it was not."""
    fresh = [F.col(f"`{q}`").isNull() & ~F.col(f"`{flag}`") for q, flag in zip(qis, before, strict=True)]
    return df.filter(all_of([~test for test in fresh])).drop(*before)


def without_flagged(df: DataFrame, sensitive: str) -> DataFrame:
    """Drop rows whose sensitive value is the mask marker; an unknown value stays."""
    return df.filter(~F.col(f"`{sensitive}`").cast("string").eqNullSafe(MASKED))


def suppress_values(df: DataFrame, classes: DataFrame, qis: Sequence[str], sensitive: str) -> DataFrame:
    """Overwrite the sensitive value in the listed classes and keep the rows."""
    joined, prefix = listed(df, classes, qis, hit=F.lit(True)).attach(df, "overwrite")
    value = F.when(F.col(f"{prefix}hit"), F.lit(SUPPRESSED)).otherwise(F.col(f"`{sensitive}`").cast("string"))
    return joined.select(*[value.alias(c) if c == sensitive else F.col(f"`{c}`") for c in df.columns])


def star_sync(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    """Star all quasi-identifiers of a row as soon as one of them is NULL or a star."""
    clear = all_of([F.coalesce(F.col(f"`{q}`").cast("string") != STAR, F.lit(False)) for q in qis])
    return df.select(
        *[
            F.when(clear, F.col(f"`{c}`").cast("string")).otherwise(STAR).alias(c) if c in qis else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
