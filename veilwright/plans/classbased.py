"""Privacy models over equivalence classes.

The *partial* models delete a share of the violating rows; violating rows above that share
stay, so the guarantee holds only at a threshold of 1 (or ``strict=True``).  The *strict*
models blank cells first and then remove every class that still violates.

Rows without a known quasi-identifier belong to no class and leave the partial models.
Statistics of a second phase are taken after the deletions of the first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.operators.categories import map_values
from veilwright.operators.classes import (
    class_sizes,
    class_sketches,
    class_stats,
    sketched_stats,
    with_known_qis,
    without_masked,
)
from veilwright.operators.distance import class_distance
from veilwright.operators.diversity import diversity_measures
from veilwright.operators.generalize import generalize, generalize_auto, generalize_known, generalize_typed
from veilwright.operators.lineage import cut_lineage
from veilwright.operators.suppression import (
    drop_classes,
    drop_share,
    newly_null_removed,
    rows_of,
    share_of_classes,
    suppress_values,
    without_deleted,
    without_flagged,
)
from veilwright.operators.wildcard import local_suppression, only_qis, sentinel_to_null
from veilwright.spec import SAMPLE_SEED, Rule

Rules = Mapping[str, Rule]


def _second_salt(seed: int) -> str:
    """The second deletion must not reuse the order of the first."""
    return f"{seed}/2"


def generalized(
    df: DataFrame, qis: Sequence[str], rules: Rules, order_col: str | None = None, style: str | None = None
) -> DataFrame:
    """Apply layered rules, or flat ones with their defaults when any rule is flat.

    A named ``style`` asks for flat rules and defaults even where there are no rules at all;
    ``"types"`` is for layered rules whose categories become numbered types.
    """
    if style == "types":
        return generalize_typed(df, rules, order_col)
    if style is not None or any(rule.flat for rule in rules.values()):
        return generalize_auto(df, qis, rules, style=style or "equal", order_col=order_col)
    return generalize(df, rules)


def _general_known(
    df: DataFrame, qis: Sequence[str], rules: Rules, style: str | None, order_col: str | None
) -> DataFrame:
    """Generalised rows whose quasi-identifiers are known."""
    if style is None and not any(rule.flat for rule in rules.values()):
        return generalize_known(df, qis, rules)
    return with_known_qis(generalized(df, qis, rules, order_col, style), qis)


# --- partial deletion -------------------------------------------------------------------


def _small(rows: DataFrame, qis: Sequence[str], k: int) -> DataFrame:
    return class_sizes(rows, qis).filter(F.col("class_size") < k)


def k_anonymity(
    df: DataFrame,
    qis: Sequence[str],
    k: int,
    rules: Rules | None = None,
    threshold: float = 1.0,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    strict: bool = False,
    style: str | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Delete ``threshold`` of the rows in classes smaller than ``k``."""
    rows = _general_known(df, qis, rules or {}, style, order_col)
    return drop_share(rows, _small(rows, qis, k), qis, 1.0 if strict else threshold, key, seed)


def _two_phases(
    rows: DataFrame,
    qis: Sequence[str],
    k: int,
    threshold: float,
    key: Sequence[str] | None,
    seed: int,
    checkpoint: bool,
    violating: Callable[[DataFrame], DataFrame],
    fit: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Delete a share of the small classes' rows, then of the rows in the ``violating`` classes of what is left.

    ``fit`` removes rows for good between the phases; it looks at one row at a time.  The first
    deletion is a list of classes and a hash.  The statistics of the second phase read the
    quasi-identifiers, the key and the sensitive columns only, without the rows that the first one takes, and then both
    deletions take effect on the whole rows together.  Rows without a key, of which copies may be spared,
    and rows that are to be written between the phases go through them one after the other.
    """
    first = share_of_classes(rows, _small(rows, qis, k), qis, threshold, key, seed)
    left = fit(without_deleted(rows, first))
    if checkpoint or first.spare:
        left = cut_lineage(left) if checkpoint else left
        return drop_share(left, violating(left), qis, threshold, key, _second_salt(seed))
    second = share_of_classes(left, violating(left), qis, threshold, key, _second_salt(seed))
    if second.spare:
        return without_deleted(left, second)
    return without_deleted(fit(rows), first, second)


def l_diversity(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    l: int,  # noqa: E741
    rules: Rules | None = None,
    threshold: float = 1.0,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    strict: bool = False,
    checkpoint: bool = False,
    style: str | None = None,
    order_col: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """k-anonymity, then delete ``threshold`` of the rows in classes with fewer than ``l`` values.

    ``approximate`` estimates the numbers of values by sketches, in one aggregate whose size does not depend
    on them; a class whose number is within a few percent of ``l`` may then be judged either way.
    """

    def poor(rows: DataFrame) -> DataFrame:
        if approximate:
            stats = sketched_stats(class_sketches(rows, qis, [sensitive]), qis)
        else:
            stats = class_stats(rows, qis, [sensitive])
        return stats.filter(F.col("distinct_values") < l)

    rows = _general_known(df, qis, rules or {}, style, order_col)
    return _two_phases(rows, qis, k, 1.0 if strict else threshold, key, seed, checkpoint, poor)


def km_anonymity(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: Sequence[str],
    k: int,
    m: float,
    rules: Rules | None = None,
    threshold: float = 1.0,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    strict: bool = False,
    checkpoint: bool = False,
    style: str | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """k-anonymity, then the same for classes where one sensitive value exceeds the share 1/m.

    Several sensitive columns count as one combined value; rows with any of them unknown do
    not count, and a class without known values passes.
    """
    if not m:
        raise ValueError("m must not be 0")

    def uneven(rows: DataFrame) -> DataFrame:
        return class_stats(rows, qis, sensitive).filter(F.col("top_share") > F.lit(1 / m))

    rows = _general_known(df, qis, rules or {}, style, order_col)
    return _two_phases(rows, qis, k, 1.0 if strict else threshold, key, seed, checkpoint, uneven)


def distant_classes(
    df: DataFrame, base: DataFrame, qis: Sequence[str], sensitive: str, t: float, distance: str = "shares"
) -> DataFrame:
    """Classes farther than ``t`` from ``base``; those with an unknown value or one row are exempt."""
    far = class_distance(df, base, qis, sensitive, distance).filter(F.col("distance") > t)
    if distance == "shares":  # comes with what the exemption needs
        return far.filter((F.col("nulls") == 0) & (F.col("class_size") >= 2))
    stats = class_stats(df, qis, [sensitive])
    judged = stats.filter((F.col("nulls") == 0) & (F.col("class_size") >= 2))
    return rows_of(far, judged, qis)


def t_closeness(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    t: float,
    rules: Rules | None = None,
    threshold: float = 1.0,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    strict: bool = False,
    distance: str = "shares",
    checkpoint: bool = False,
    style: str | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """k-anonymity, drop masked rows, then delete from classes far from the original table."""

    def far(rows: DataFrame) -> DataFrame:
        return distant_classes(rows, df, qis, sensitive, t, distance)

    rows = _general_known(df, qis, rules or {}, style, order_col)
    share = 1.0 if strict else threshold
    return _two_phases(rows, qis, k, share, key, seed, checkpoint, far, lambda left: without_masked(left, qis))


def t_closeness_l1(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    t: float,
    rules: Rules | None = None,
    threshold: float = 1.0,
    key: Sequence[str] | None = None,
    seed: int = SAMPLE_SEED,
    strict: bool = False,
    checkpoint: bool = False,
) -> DataFrame:
    """Strict class size, then delete ``threshold`` of the classes' rows by L1 distance, all of them if ``strict``.

    The global shares are those of the rows left after the size filter, and no class is exempt.
    """
    rows = _general_known(df, qis, rules or {}, None, None)
    first = share_of_classes(rows, _small(rows, qis, k), qis, 1.0, key, seed)
    left = without_deleted(rows, first)
    left = cut_lineage(left) if checkpoint else left
    far = class_distance(left, left, qis, sensitive, "l1").filter(F.col("distance") > t)
    second = share_of_classes(left, far, qis, 1.0 if strict else threshold, key, seed)
    if checkpoint or second.spare:
        return without_deleted(left, second)
    return without_deleted(rows, first, second)


# --- blanking and removal of whole classes ----------------------------------------------


def k_anonymity_strict(
    df: DataFrame,
    qis: Sequence[str],
    k: int,
    rules: Rules | None = None,
    order_col: str | None = None,
    importance: Sequence[str] | None = None,
    style: str | None = None,
) -> DataFrame:
    """Drop rows with a masked or unknown quasi-identifier, then small classes.

    The model blanks cells of small classes and then drops rows with a blank cell.  Blanking always
    takes at least one cell of every row it touches, so nothing need be blanked, and ``importance``,
    which says what to blank first, changes nothing.
    """
    rows = without_masked(generalized(df, qis, rules or {}, order_col, style), qis)
    return drop_classes(rows, class_sizes(rows, qis).filter(F.col("class_size") < k), qis)


def k_anonymity_local(
    df: DataFrame,
    qis: Sequence[str],
    k: int,
    rules: Rules | None = None,
    order_col: str | None = None,
    style: str | None = None,
) -> DataFrame:
    """Generalise and blank cells, nothing else: k-anonymous with NULL matching anything."""
    return local_suppression(generalized(df, qis, rules or {}, order_col, style), qis, k)


def k_anonymity_keys(df: DataFrame, qis: Sequence[str], k: int) -> DataFrame:
    """Blank cells of the table as it came and return the quasi-identifiers alone."""
    return only_qis(sentinel_to_null(local_suppression(df, qis, k), qis), qis)


def k_anonymity_new_nulls(
    df: DataFrame,
    qis: Sequence[str],
    k: int,
    rules: Rules | None = None,
    order_col: str | None = None,
    importance: Sequence[str] | None = None,
) -> DataFrame:
    """Like the strict model, but only rows that lost a value go; unknown ones from before stay."""
    general = generalized(df, qis, rules or {}, order_col)
    before = [f"__was_null_{i}" for i in range(len(qis))]
    flagged = general.withColumns({b: F.col(f"`{q}`").isNull() for b, q in zip(before, qis, strict=True)})
    rows = newly_null_removed(local_suppression(flagged, qis, k, importance), before, qis)
    return drop_classes(rows, class_sizes(rows, qis).filter(F.col("class_size") < k), qis)


def k_anonymity_by_groups(
    df: DataFrame, qis: Sequence[str], k: int, mappings: Mapping[str, Mapping[object, str] | DataFrame] | None = None
) -> DataFrame:
    """Look values up in declared dictionaries (others stay) and keep classes of ``k`` or more."""
    rows = df
    for name, mapping in (mappings or {}).items():
        if name in qis:
            rows = map_values(rows, name, mapping, keep_unmapped=True)
    rows = with_known_qis(rows, qis)
    return drop_classes(rows, class_sizes(rows, qis).filter(F.col("class_size") < k), qis)


def l_diversity_strict(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    l: int,  # noqa: E741
    rules: Rules | None = None,
    order_col: str | None = None,
    style: str | None = None,
) -> DataFrame:
    """Strict k-anonymity, then drop classes with fewer than ``l`` values, unknown being one."""
    rows = k_anonymity_strict(df, qis, k, rules, order_col, style=style)
    return drop_classes(rows, class_stats(rows, qis, [sensitive]).filter(F.col("distinct_with_null") < l), qis, join="poor")


def l_diversity_suppress(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    l: int,  # noqa: E741
    mappings: Mapping[str, Mapping[object, str] | DataFrame] | None = None,
) -> DataFrame:
    """Keep classes of ``k`` or more; overwrite the sensitive value where a class has too few."""
    rows = k_anonymity_by_groups(df, qis, k, mappings)
    poor = class_stats(rows, qis, [sensitive]).filter(F.col("distinct_values") < l)
    return suppress_values(rows, poor, qis, sensitive)


def l_diversity_report(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    l: int,  # noqa: E741
    rules: Rules | None = None,
    order_col: str | None = None,
    style: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The generalised table as it is, and the diversity measures of its classes."""
    rows = generalized(df, qis, rules or {}, order_col, style)
    return rows, diversity_measures(rows, qis, sensitive, l)


def t_closeness_strict(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    t: float,
    rules: Rules | None = None,
    order_col: str | None = None,
    style: str | None = None,
) -> DataFrame:
    """Drop rows with a masked or unknown value or in small classes, then classes far from the original table.

    Small classes go for the reason given in ``k_anonymity_strict``.  Rows whose sensitive value is the mask marker go
    as well; an unknown sensitive value stays.
    """
    rows = k_anonymity_strict(df, qis, k, rules, order_col, style=style)
    kept = drop_classes(rows, distant_classes(rows, df, qis, sensitive, t), qis, join="far")
    return without_flagged(kept, sensitive)


def t_closeness_report(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    t: float,
    rules: Rules | None = None,
    order_col: str | None = None,
    style: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The generalised table as it is, and the classes whose KL divergence exceeds ``t``."""
    rows = generalized(df, qis, rules or {}, order_col, style)
    return rows, class_distance(rows, rows, qis, sensitive, "kl").filter(F.col("distance") > t)


def km_anonymity_strict(
    df: DataFrame,
    qis: Sequence[str],
    sensitive: str,
    k: int,
    m: int,
    rules: Rules | None = None,
    order_col: str | None = None,
    style: str | None = None,
) -> DataFrame:
    """Keep classes of ``k`` rows or more and ``m`` values or more, unknown being one.

    Rows of small classes would lose a cell first and then go; see ``k_anonymity_strict``.
    """
    rows = with_known_qis(generalized(df, qis, rules or {}, order_col, style), qis)
    stats = class_stats(rows, qis, [sensitive])
    return drop_classes(rows, stats.filter((F.col("class_size") < k) | (F.col("distinct_with_null") < m)), qis)
