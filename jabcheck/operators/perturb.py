"""Fault injection: turn a clean event table into one with known, labelled faults.

Input rows need ``row_key`` (unique, BIGINT), ``patient_id``, ``vax_date``, ``vax_product``
and ``age``; other columns travel along. Faulted base rows are disjoint and their numbers
exact. All randomness comes from the row key and a ``seed``; seed 0 is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.dates import age_on, by_rank
from jabcheck.functions.draws import draw, draw_below
from jabcheck.functions.labels import INTERVAL_BINS
from jabcheck.operators.flags import DAY, by_patient
from jabcheck.operators.sampling import at_least, exact_classes, share
from jabcheck.operators.skew import join_facts
from jabcheck.operators.counts import fold_rows
from jabcheck.operators.staging import Staging
from jabcheck.study import Study

# Share of patients that get an extra dose, and its distance in days.
EXTRA_DOSE_SHARE = 0.3
EXTRA_DOSE_DAYS = (30, 90)

# Fault classes as (name, share of rows, smallest number), in order of drawing.
FAULTS = (
    ("early_date", 0.02, 10),
    ("pre_rollout_date", 0.02, 10),
    ("unapproved_product", 0.02, 10),
    ("before_approval", 0.02, 10),
    ("same_day_same_product", 0.015, 8),
    ("same_day_mixed_product", 0.015, 8),
    ("same_day_complex", 0.01, 5),
)

# Days before approval, repeats of a complex day, rows moved per interval
# bin, and the last day used for the open bin.
BEFORE_APPROVAL_DAYS = (1, 30)
COMPLEX_REPEATS = (2, 3)
MOVED_PER_BIN = 10
OPEN_BIN_LAST_DAY = 240

#: one salt per kind of draw
SALTS = {
    name: salt
    for salt, name in enumerate(
        (
            "expand_patient",
            "expand_row",
            "expand_days",
            "fault_class",
            "fault_date",
            "fault_product",
            "fault_repeats",
            "interval_row",
            "interval_days",
        ),
        start=3,
    )
}

#: salts of two seeds never meet
SEED_STEP = 100

#: bits of a content key; two doublings and a factor of eight still fit in 64
KEY_BITS = 58


def _salt(name: str, seed: int) -> int:
    return SALTS[name] + SEED_STEP * seed


def with_row_key(events: DataFrame) -> DataFrame:
    """Key each row of a table that has no key by its content.

    Equal rows are counted and numbered, so the keys do not depend on files or partitions.
    They are hashes of 58 bits: two rows that share one would share their draws.
    """
    columns = events.columns
    numbered = fold_rows(events, *columns).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "n_records")).alias("_copy"))
    key = F.xxhash64(*columns, "_copy").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    return numbered.select(*columns, key.alias("row_key"))


def _between(key: Column, salt: str, first: int, last: int, seed: int) -> Column:
    return F.lit(first) + draw_below(key, _salt(salt, seed), last - first + 1)


def _any_of(key: Column, salt: str, values: list[str], seed: int) -> Column:
    return by_rank(draw_below(key, _salt(salt, seed), len(values)) + 1, values, "string")


def _unapproved_names(study: Study) -> list[str]:
    return [raw for label, raw in study.products if label not in study.approvals]


def recompute_age(rows: DataFrame, order: list[str], stage: Staging) -> DataFrame:
    """Age on each date, counted from the age at the patient's earliest date.

    ``order`` breaks ties on that date. The reference age is an aggregate per patient that
    combines before the shuffle and is joined back, so a busy patient is never one group.
    Rows without a patient share one reference.
    """
    dated_first = F.when(F.col("vax_date").isNotNull(), F.struct("vax_date", *order))
    earliest = rows.groupBy("patient_id").agg(
        F.min("vax_date").alias("_ref_date"),
        F.min_by("age", dated_first).alias("_ref_age"),
    )
    shifted = F.col("_ref_age") + age_on(F.col("_ref_date"), F.col("vax_date"))
    return (
        join_facts(rows, earliest, ["patient_id"], stage)
        .withColumn("age", F.when(shifted.isNotNull(), F.greatest(F.lit(0), shifted)))
        .select(*rows.columns)
    )


def expand_patients(rows: DataFrame, seed: int = 0) -> DataFrame:
    """A second copy, some weeks later, of one random row of 30% of the patients.

    Keys are renumbered: ``2k`` for the row with key ``k``, ``2k + 1`` for its copy.
    """
    key = F.col("row_key")
    order = F.struct(draw(key, _salt("expand_row", seed)), key)
    one_each = rows.groupBy("patient_id").agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    chosen = exact_classes(
        one_each, "patient_id", _salt("expand_patient", seed), [share(EXTRA_DOSE_SHARE)], "_chosen"
    )
    later = F.date_add("vax_date", _between(key, "expand_days", *EXTRA_DOSE_DAYS, seed))
    extra = (
        chosen.where(F.col("_chosen") == 1)
        .select("_row.*")
        .withColumns({"vax_date": later, "row_key": key * 2 + 1})
    )
    return rows.withColumn("row_key", key * 2).unionByName(extra)


def inject_faults(rows: DataFrame, study: Study, seed: int = 0) -> DataFrame:
    """Faulty dates, faulty products and same-day repeats; adds ``fault`` and ``copy_no``.

    ``fault`` is NULL on untouched rows. ``copy_no`` is 0 on rows that were there before and
    counts up on the repeats of a row.
    """
    classes = exact_classes(
        rows, "row_key", _salt("fault_class", seed), [at_least(rate, least) for _, rate, least in FAULTS], "_class"
    )
    names = [name for name, _, _ in FAULTS]
    number = {name: position for position, name in enumerate(names, start=1)}
    key, is_class = F.col("row_key"), {name: F.col("_class") == n for name, n in number.items()}

    raw_names = [raw for _, raw in study.products]
    product = F.col("vax_product")
    level = F.coalesce(F.array_position(F.lit(raw_names), product), F.lit(0))
    approved_on = by_rank(F.nullif(level.cast("int"), F.lit(0)), study.approval_dates, "date")

    early_days = (study.first_possible - study.early_faults_from).days
    pre_days = (study.start - study.first_possible).days
    before = F.date_sub(approved_on, _between(key, "fault_date", *BEFORE_APPROVAL_DAYS, seed))
    new_date = (
        F.when(
            is_class["early_date"],
            F.date_add(F.lit(study.early_faults_from), _between(key, "fault_date", 0, early_days - 1, seed)),
        )
        .when(
            is_class["pre_rollout_date"],
            F.date_add(F.lit(study.first_possible), _between(key, "fault_date", 0, pre_days - 1, seed)),
        )
        .when(is_class["before_approval"] & approved_on.isNotNull(), before)
        .otherwise(F.col("vax_date"))
    )
    unapproved = _unapproved_names(study)
    new_product = product
    if unapproved:
        new_product = F.when(
            is_class["unapproved_product"], _any_of(key, "fault_product", unapproved, seed)
        ).otherwise(product)

    # another product: draw among the others, stepping over the current one
    others = F.lit(len(raw_names)) - F.when(level > 0, 1).otherwise(0)
    drawn = draw(key, _salt("fault_product", seed)) % others + 1
    other_level = drawn + F.when((level > 0) & (drawn >= level), 1).otherwise(0)
    other = by_rank(other_level.cast("int"), raw_names, "string")

    repeats = _between(key, "fault_repeats", *COMPLEX_REPEATS, seed)
    row = lambda number, name: F.struct(number.cast("int").alias("copy_no"), name.alias("vax_product"))
    base = F.array(row(F.lit(0), new_product))
    copies = (
        F.when(is_class["same_day_same_product"], F.concat(base, F.array(row(F.lit(1), product))))
        .when(is_class["same_day_mixed_product"], F.concat(base, F.array(row(F.lit(1), other))))
        .when(
            is_class["same_day_complex"],
            F.concat(
                base,
                F.transform(F.sequence(F.lit(1), repeats), lambda i: row(i, product)),
                F.array(row(repeats + 1, other)),
            ),
        )
        .otherwise(base)
    )
    carried = [c for c in rows.columns if c not in ("vax_date", "vax_product")]
    return classes.select(
        *carried,
        new_date.alias("vax_date"),
        by_rank(F.nullif(F.col("_class"), F.lit(0)), names, "string").alias("fault"),
        F.inline(copies),
    )


def inject_intervals(rows: DataFrame, stage: Staging, seed: int = 0) -> DataFrame:
    """Move up to ten rows per interval bin to a chosen distance from the previous dose.

    Only rows that are alone on their day, as the previous day's row is, can be moved. At
    most ``bins * MOVED_PER_BIN`` rows are picked, so they are applied by broadcast.
    Expects the output of :func:`inject_faults` and recomputes ages at the end.
    """
    order = W.partitionBy("patient_id").orderBy("vax_date")
    days = by_patient(
        rows.where(F.col("vax_date").isNotNull())
        .groupBy(*DAY)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("row_key").alias("row_key"), F.min("copy_no").alias("copy_no"))
    )
    eligible = (
        days.withColumns({"_prev_date": F.lag("vax_date").over(order), "_prev_n": F.lag("_n").over(order)})
        .where((F.col("_n") == 1) & (F.col("_prev_n") == 1))
        .withColumn("_key", F.col("row_key") * 8 + F.col("copy_no"))
        .withColumn("_draw", draw(F.col("_key"), _salt("interval_row", seed)))
    )
    bins = [(first, last or OPEN_BIN_LAST_DAY) for _, first, last in INTERVAL_BINS]
    most = len(bins) * MOVED_PER_BIN
    # fewer candidates than that are all eligible rows, so their number is enough
    candidates = stage.store(eligible.orderBy("_draw", "_key").limit(most))
    per_bin = candidates.count() // len(bins)
    position = F.row_number().over(W.orderBy("_draw", "_key")) - 1
    picked = candidates.withColumn("_position", position).where(F.col("_position") < per_bin * len(bins))
    distance = F.lit(None).cast("int")
    for number, (first, last) in enumerate(bins):
        in_bin = F.col("_position").between(number * per_bin, (number + 1) * per_bin - 1)
        distance = F.when(in_bin, _between(F.col("_key"), "interval_days", first, last, seed)).otherwise(distance)
    moves = picked.select("row_key", "copy_no", F.date_add("_prev_date", distance).alias("_moved_to"))
    moved = (
        rows.join(F.broadcast(moves), ["row_key", "copy_no"], "left")
        .withColumn("vax_date", F.coalesce("_moved_to", "vax_date"))
        .select(*rows.columns)
    )
    return recompute_age(stage.store(moved), ["row_key", "copy_no"], stage)


def perturb(rows: DataFrame, study: Study, stage: Staging, seed: int = 0) -> DataFrame:
    """The whole chain on a given table: extra doses, faults, intervals.

    Every step reads its input more than once, so each is stored before the next.
    """
    more = stage.store(expand_patients(rows, seed))
    return inject_intervals(stage.store(inject_faults(more, study, seed)), stage, seed)
