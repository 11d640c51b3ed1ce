"""Settling reservations: what each instruction writes to the ledger.

A reservation is settled once; a later actual cost of the same attempt adjusts
it once. The first request that the hard budget doesn't cover, or the first
actual cost above its estimate, exhausts the campaign, and no later request is
granted. As nothing is refused before that moment, everything up to it can be
computed as if all requests were granted; what it refuses, and settlements
that name it, are taken out afterwards. So windows are enough: one over each
reservation and one running sum over each campaign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTLED = ("campaign_id", "position", "reservation_id", "entry", "amount", "problem", "exhausts")


def settled(instructions: DataFrame, limit: Column, estimate: Column) -> DataFrame:
    """One row for each instruction: SETTLED.

    ``instructions`` has campaign_id, position (unique in a campaign),
    instruction (reserve, consume, release), reservation_id, attempt_id and
    actual (null: as reserved). entry is what it writes: reserved, consumed,
    released, adjusted_up, adjusted_down, or null with a problem: ``refused``
    (the budget doesn't cover it, or the campaign is exhausted),
    ``no_reservation``, ``amount_not_positive``, ``reservation_settled``
    (by another instruction), ``repeated`` (it says what is recorded).
    exhausts marks the instructions that end a campaign."""
    kind, position = F.col("instruction"), F.col("position")
    own = Window.partitionBy("campaign_id", "reservation_id")
    least = lambda condition: F.min(F.when(condition, position)).over(own)
    rows = instructions.withColumns({"_estimate": estimate.cast("decimal(28,9)"), "_limit": limit.cast("decimal(28,9)")})
    rows = rows.withColumn("_at", least(kind == "reserve"))
    behind = position > F.col("_at")
    said = F.when(kind == "release", F.col("_estimate")).otherwise(F.coalesce(F.col("actual").cast("decimal(28,9)"), F.col("_estimate")))
    rows = rows.withColumn("_amount", said)
    rows = rows.withColumn("_first", least((kind != "reserve") & behind & (F.col("_amount") > 0)))
    at_first = lambda c: F.max(F.when(position == F.col("_first"), c)).over(own)
    rows = rows.withColumns({"_kind": at_first(kind), "_who": at_first(F.struct(F.col("attempt_id").alias("a"))), "_recorded": at_first(F.col("_amount"))})
    later = position > F.col("_first")
    same = later & (kind == "consume") & (F.col("_kind") == "consume") & F.col("attempt_id").eqNullSafe(F.col("_who.a"))
    given = F.when(F.coalesce(F.col("actual"), F.lit(0)) != 0, F.col("actual").cast("decimal(28,9)"))  # an actual of nothing asks for what is recorded
    rows = rows.withColumns({"_same": F.coalesce(same, F.lit(False)), "_given": given})
    rows = rows.withColumn("_adjusts", least(F.col("_same") & (F.coalesce("_given", "_recorded") != F.col("_recorded"))))
    rows = rows.withColumn("_new", F.max(F.when(position == F.col("_adjusts"), F.col("_given"))).over(own))
    now = F.when(position > F.col("_adjusts"), F.col("_new")).otherwise(F.col("_recorded"))
    adjusts = position == F.col("_adjusts")
    entry = (
        F.when((kind == "reserve") & (position == F.col("_at")), "reserved")
        .when((kind != "reserve") & (position == F.col("_first")), F.when(kind == "consume", "consumed").otherwise("released"))
        .when(adjusts, F.when(F.col("_given") > F.col("_recorded"), "adjusted_up").otherwise("adjusted_down"))
    )
    amount = F.when(kind == "reserve", F.col("_estimate")).when(adjusts, F.abs(F.col("_given") - F.col("_recorded"))).otherwise(F.col("_amount"))
    problem = (
        F.when(kind == "reserve", "repeated")
        .when(~F.coalesce(behind, F.lit(False)), "no_reservation")
        .when(F.col("_first").isNull() | (position < F.col("_first")), "amount_not_positive")
        .when(F.col("_same") & (F.coalesce(F.col("_given"), now) == now), "repeated")
        .otherwise("reservation_settled")
    )
    rows = rows.withColumn("entry", entry).withColumn("amount", F.when(F.col("entry").isNotNull(), amount)).withColumn("problem", F.when(F.col("entry").isNull(), problem))
    change = F.when(F.col("entry") == "reserved", F.col("amount")).when(F.col("entry") == "consumed", F.col("amount") - F.col("_estimate")).when(F.col("entry") == "released", -F.col("_estimate")).when(F.col("entry") == "adjusted_up", F.col("amount")).when(F.col("entry") == "adjusted_down", -F.col("amount")).otherwise(0)
    running = Window.partitionBy("campaign_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_committed", F.sum(change).over(running))
    actual = F.when(F.col("entry") == "consumed", F.col("amount")).when(adjusts, F.col("_given"))
    over = ((F.col("entry") == "reserved") & (F.col("_committed") > F.col("_limit"))) | F.coalesce(actual > F.col("_estimate"), F.lit(False))
    whole = Window.partitionBy("campaign_id")
    rows = rows.withColumn("_over", F.coalesce(over, F.lit(False))).withColumn("_end", F.min(F.when(F.col("_over"), position)).over(whole))
    refused = lambda at, over: (at > F.col("_end")) | ((at == F.col("_end")) & over)
    no_request = F.coalesce(refused(position, F.col("entry") == "reserved"), F.lit(False)) & (F.col("entry") == "reserved")
    ended_by_request = F.max(F.when((position == F.col("_end")) & (F.col("entry") == "reserved"), True)).over(whole)
    never = F.coalesce(refused(F.col("_at"), F.coalesce(F.col("_by_request"), F.lit(False))), F.lit(False)) & (kind != "reserve")
    rows = rows.withColumn("_by_request", ended_by_request).withColumn("_never", never).withColumn("_no", no_request)
    gone = F.col("_no") | F.col("_never")
    return rows.select(
        "campaign_id", "position", "reservation_id", F.when(~gone, F.col("entry")).alias("entry"), F.when(~gone, F.col("amount")).alias("amount"),
        F.when(F.col("_no"), "refused").when(F.col("_never"), "no_reservation").otherwise(F.col("problem")).alias("problem"),
        (F.col("_over") & ~F.col("_never") & ~(F.col("_no") & (position > F.col("_end")))).alias("exhausts"),
    )
