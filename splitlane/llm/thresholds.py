"""Budgets met by a hash threshold, found from nested histograms instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlane.operators.lookup import fits_broadcast, lookup_join
from splitlane.session import settle

HASH_BITS = 60
DIGIT_BITS = 12
WHOLE = 1 << HASH_BITS


def hash60(value: Column) -> Column:
    """The first 60 bits of the md5 of a value's text; null counts as empty text."""
    text = F.coalesce(value.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def budget_cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """grp, cut: in each group the rows with hash < cut come nearest to the budget.

    ``rows`` holds grp, hash (0 to 2**60 - 1) and size; ``budgets`` one row of grp and
    budget per group. Rows of equal hash go together; among equally near cuts the
    smaller one counts. Each level sums sizes by group and the next 12 bits of the hash,
    and looks on only inside the bucket where the budget runs out.
    """
    digits = 1 << DIGIT_BITS
    small = fits_broadcast(budgets)
    state = budgets.select("grp", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for level in range(HASH_BITS // DIGIT_BITS):
        shift = HASH_BITS - DIGIT_BITS * (level + 1)
        inside = rows
        if level:
            inside = lookup_join(
                rows.withColumn("head", F.shiftright("hash", shift + DIGIT_BITS)),
                state.select("grp", F.col("prefix").alias("head")),
                ["grp", "head"],
                "inner",
                small=small,
            )
        sums = inside.groupBy("grp", F.shiftright("hash", shift).bitwiseAND(F.lit(digits - 1)).alias("digit")).agg(
            F.sum("size").alias("size")
        )
        upto = Window.partitionBy("grp").orderBy("digit")
        over = lookup_join(
            sums.withColumn("upto", F.sum("size").over(upto)), state, "grp", "inner", small=small
        ).filter(F.col("upto") > F.col("rest"))
        first = over.groupBy("grp").agg(F.min_by(F.struct("prefix", "rest", "digit", "upto", "size"), "digit").alias("s"))
        last = shift == 0
        include = (F.col("s.rest") - (F.col("s.upto") - F.col("s.size"))) * 2 > F.col("s.size")
        state = settle(
            first.select(
                "grp",
                (F.col("s.prefix") * digits + F.col("s.digit") + (include.cast("long") if last else F.lit(0))).alias("prefix"),
                (F.col("s.rest") - F.col("s.upto") + F.col("s.size")).alias("rest"),
            ),
            "cuts",
        )
    return lookup_join(
        budgets.select("grp"), state.select("grp", F.col("prefix").alias("cut")), "grp", "left", small=small
    ).select("grp", F.coalesce("cut", F.lit(WHOLE)).alias("cut"))
