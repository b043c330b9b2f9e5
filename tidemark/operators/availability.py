"""Labels by the day on which they became known.

A label is usable at a snapshot if it was released by then, inclusive. Reading one that wasn't fails;
it isn't null. Late labels never change an earlier snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..validate import ValidationError, duplicate_keys, label_violations, require, whole_number


class UnreleasedLabelError(LookupError):
    """The label exists but wasn't released by the snapshot's day."""


def checked_labels(labels: DataFrame) -> DataFrame:
    require(label_violations(labels), "invalid label")
    require(duplicate_keys(labels, ["instrument", "observed_day"]), "duplicate label")
    return labels


def available(labels: DataFrame, as_of: int) -> DataFrame:
    """The labels released by ``as_of``, in the order of release, instrument and observation."""
    whole_number(as_of, 1, "as_of")
    return labels.where(F.col("released_day") <= as_of).orderBy("released_day", "instrument", "observed_day")


def read_label(labels: DataFrame, instrument: str, observed_day: int, as_of: int) -> float:
    """One label's value; KeyError if there is none, UnreleasedLabelError if it isn't out yet."""
    whole_number(as_of, 1, "as_of")
    found = labels.where((F.col("instrument") == instrument) & (F.col("observed_day") == observed_day)).select("released_day", "value").take(1)
    if not found:
        raise KeyError((instrument, observed_day))
    if found[0]["released_day"] > as_of:
        raise UnreleasedLabelError(f"{instrument} of day {observed_day} is released on day {found[0]['released_day']}, after day {as_of}")
    return found[0]["value"]


def guarded(labels: DataFrame, instrument: str, observed_day: int, as_of: int) -> DataFrame:
    """The same as a plan: the read value, or an error when the plan runs."""
    value = F.when(F.col("released_day") <= as_of, F.col("value")).otherwise(F.raise_error(F.lit("label not released")).cast("double"))
    return labels.where((F.col("instrument") == instrument) & (F.col("observed_day") == observed_day)).select("instrument", "observed_day", value.alias("value"))


def counts(labels: DataFrame, as_of: int) -> DataFrame:
    """One row: available and unreleased labels, and the mean of the available."""
    out = F.col("released_day") <= as_of
    return labels.agg(F.count_if(out).alias("available"), F.count_if(~out).alias("unreleased"), F.round(F.avg(F.when(out, F.col("value"))), 8).alias("mean_value"))


def snapshots(labels: DataFrame, first: int, last: int) -> DataFrame:
    """(as_of, available, unreleased, mean_value) for every day from ``first`` to ``last``.

    The labels are reduced to a row for each release day; running sums over these give all snapshots
    in one pass, instead of joining each snapshot with all labels before it.
    """
    per_day = labels.groupBy("released_day").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    days = labels.sparkSession.range(first, last + 1).select(F.col("id").alias("released_day"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    daily = per_day.unionByName(days).groupBy("released_day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    past = Window.orderBy("released_day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    later = Window.orderBy("released_day").rowsBetween(1, Window.unboundedFollowing)
    known = F.sum("n").over(past)
    return daily.select(
        F.col("released_day").alias("as_of"),
        known.alias("available"),
        F.coalesce(F.sum("n").over(later), F.lit(0)).alias("unreleased"),
        F.when(known > 0, F.sum("s").over(past) / known).alias("mean_value"),
    ).where(F.col("as_of").between(first, last))


def ledger(targets: DataFrame, origin: int, horizon: int, delay: int, window: int, first: int = 20) -> DataFrame:
    """For the labels that a forecast at ``origin`` may look at: whether each is out, and its value only if so.

    ``targets`` has (series_id, t, y): the mean of the ``horizon`` observations from t on.
    """
    released = F.col("t") + horizon + delay
    eligible = released <= origin
    return targets.where(F.col("t").between(max(first, origin - window), origin - 1)).select(
        "series_id",
        F.col("t").alias("origin"),
        (F.col("t") + horizon - 1).alias("target_end"),
        released.alias("released_day"),
        eligible.alias("eligible"),
        F.when(eligible, F.col("y")).alias("label"),
        F.when(eligible, "Available for training").otherwise("Not released").alias("status"),
    )


def boundary(ledger: DataFrame, k: int = 3) -> DataFrame:
    """The last k available and the first k withheld labels of each series."""
    from_end = F.when(F.col("eligible"), -F.col("origin")).otherwise(F.col("origin"))
    place = F.row_number().over(Window.partitionBy("series_id", "eligible").orderBy(from_end))
    return ledger.withColumn("place", place).where(F.col("place") <= k)


def eligible_share(ledger: DataFrame) -> DataFrame:
    """By series: available and withheld counts, the share available, and the next label to come out."""
    return ledger.groupBy("series_id").agg(
        F.count_if("eligible").alias("n_eligible"),
        F.count_if(~F.col("eligible")).alias("n_withheld"),
        (F.count_if("eligible") / F.count("*")).alias("share"),
        (F.max(F.when(F.col("eligible"), F.col("origin"))) + 1).alias("next_withheld"),
    )


def available_keys(labels: DataFrame, as_of: int) -> DataFrame:
    """(place, instrument, observed_day) of the available labels, placed from 0 in the order of the snapshot.

    A place is what earlier release days hold, from a table with a row for each day, and the place within
    the day: no sort of all labels in one task.
    """
    whole_number(as_of, 1, "as_of")
    out = labels.where(F.col("released_day") <= as_of)
    days = out.groupBy("released_day").agg(F.count("*").alias("n"))
    before = Window.orderBy("released_day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    first = days.select(F.col("released_day").alias("day"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("released_day").orderBy("instrument", "observed_day")) - 1
    return out.withColumn("within", within).join(first, F.col("released_day") == F.col("day")).select((F.col("first") + F.col("within")).alias("place"), "instrument", "observed_day")


#: A demonstration shows its labels one by one; more of them fail.
MOST_SHOWN = 10_000


def demonstration(labels: DataFrame, as_of: int, instrument: str, observed_day: int) -> dict:
    """What a snapshot of a few labels shows: counts, mean, keys, and why one label can't be read yet."""
    counted = counts(checked_labels(labels), as_of).first()
    if counted["available"] > MOST_SHOWN:
        raise ValidationError(f"more than {MOST_SHOWN} labels to show")
    try:
        read_label(labels, instrument, observed_day, as_of)
        reason = None
    except UnreleasedLabelError as e:
        reason = str(e)
    keys = [[k["instrument"], k["observed_day"]] for k in available_keys(labels, as_of).orderBy("place").collect()]
    return {"as_of": as_of, "available": counted["available"], "unreleased": counted["unreleased"], "mean_value": counted["mean_value"], "keys": keys, "rejected": reason}


def guarded_targets(targets: DataFrame, wanted: DataFrame, horizon: int, delay: int) -> DataFrame:
    """(series_id, origin, as_of, target) for each wanted (series_id, origin, as_of), as a plan.

    The plan fails when it runs if a wanted series or target doesn't exist, or if the target wasn't released by its ``as_of``.
    """
    known = targets.select("series_id", F.col("t").alias("origin"), "y")
    read = (
        F.when(F.col("y").isNull(), F.raise_error(F.lit("no such series or target")).cast("double"))
        .when(F.col("origin") + horizon + delay > F.col("as_of"), F.raise_error(F.format_string("target of %s at %s is released on day %s", "series_id", "origin", F.col("origin") + horizon + delay)).cast("double"))
        .otherwise(F.col("y"))
    )
    return wanted.join(known, ["series_id", "origin"], "left").select("series_id", "origin", "as_of", read.alias("target"))
