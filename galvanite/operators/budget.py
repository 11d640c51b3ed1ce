"""Budget ledgers: reserved, consumed, released, adjusted_up, adjusted_down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unsettled(reservations: DataFrame, settlements: DataFrame, key: str, settles: str) -> DataFrame:
    """Reservations that no settlement names."""
    return reservations.join(settlements.select(F.col(settles).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def usage(ledger: DataFrame, key: str, limit: Column, *, entry: str = "entry_id", kind: str = "kind", amount: str = "amount", settles: str = "settles") -> DataFrame:
    """reserved, consumed, released, outstanding and remaining of each key.

    consumed counts adjustments; outstanding is what is reserved and neither
    consumed nor released; remaining is never below zero."""
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col(kind).isin(*kinds), F.col(amount))), F.lit(0))
    settled = ledger.where(F.col(kind).isin("consumed", "released")).select(F.col(settles).alias(entry)).where(F.col(entry).isNotNull()).distinct().withColumn("_settled", F.lit(True))
    held = ledger.join(settled, entry, "left")
    sums = held.groupBy(key).agg(
        total("reserved").alias("reserved"),
        (total("consumed", "adjusted_up") - total("adjusted_down")).alias("consumed"),
        total("released").alias("released"),
        F.coalesce(F.sum(F.when((F.col(kind) == "reserved") & F.col("_settled").isNull(), F.col(amount))), F.lit(0)).alias("outstanding"),
    )
    return sums.withColumn("remaining", F.greatest(limit - F.col("consumed") - F.col("outstanding"), F.lit(0)))


def overcommitted(ledger: DataFrame, key: str, limit: Column, *, order: str, kind: str = "kind", amount: str = "amount") -> DataFrame:
    """Reservations that lifted what is committed above the limit at their
    time: a running sum over each key in ``order``."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.when(F.col(kind).isin("reserved", "adjusted_up"), F.col(amount)).when(F.col(kind).isin("released", "adjusted_down"), -F.col(amount)).otherwise(0)
    return ledger.withColumn("committed", F.sum(change).over(running)).where((F.col(kind) == "reserved") & (F.col("committed") > limit))


def mixed_units(ledger: DataFrame, key: str, unit: str = "unit") -> DataFrame:
    return ledger.groupBy(key).agg(F.count_distinct(unit).alias("units")).where("units > 1")


def decisions(entries: DataFrame, key: str, limit: Column, estimate: Column, *, order: str) -> DataFrame:
    """Which requests a hard budget lets start, decided in order.

    ``entries`` has requests (kind request) and what became of earlier ones:
    consumed with its actual amount, released, adjusted_up, adjusted_down. A
    request is granted if what is committed and one ``estimate`` more fit the
    limit; the first that doesn't fit, or a cost above its estimate, exhausts
    the campaign and every later request is refused. As nothing is refused
    before that moment, the running sum up to it takes each request as
    granted, so no state beyond a window is needed."""
    kind, amount = F.col("kind"), F.col("amount")
    change = F.when(kind == "request", estimate).when(kind == "consumed", amount - estimate).when(kind == "released", -estimate).when(kind == "adjusted_up", amount).when(kind == "adjusted_down", -amount).otherwise(0)
    running = Window.partitionBy(key).orderBy(order)
    up_to, before = running.rowsBetween(Window.unboundedPreceding, Window.currentRow), running.rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumn("_committed", F.sum(change).over(up_to))
    over = ((kind == "request") & (F.col("_committed") > limit)) | ((kind == "consumed") & (amount > estimate)) | (kind == "adjusted_up")
    rows = rows.withColumn("_over", F.coalesce(over, F.lit(False)))
    rows = rows.withColumn("_earlier", F.coalesce(F.bool_or("_over").over(before), F.lit(False)))
    decision = F.when(F.col("_earlier"), "refused").when(F.col("_over"), "exhausts").otherwise("granted")
    return rows.where(kind == "request").select(key, order, F.col("_committed").alias("committed"), decision.alias("decision"))


def open_reservation(ledger: DataFrame, job: str, *, entry: str = "entry_id", settles: str = "settles", generation: str = "lease_generation") -> DataFrame:
    """The unsettled reservation of the highest lease generation of each job."""
    held = unsettled(ledger.where("kind = 'reserved'"), ledger.where("kind in ('consumed', 'released')"), entry, settles)
    best = F.max(F.struct(generation, entry, "amount")).alias("r")
    return held.groupBy(job).agg(best).select(job, f"r.{entry}", f"r.{generation}", "r.amount")
