"""The row-local rules on a stream: they are plain columns, so nothing but the reader and writer changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.functions import rules as R
from spindrift.operators import audit
from spindrift.plans.curate import identity, typed
from spindrift.sources.records import null_tokens


def guarded_stream(raw: DataFrame) -> DataFrame:
    """Raw text records -> typed, range-guarded records with the first reason to leave them out (null: keep).

    Stateless, so it needs no watermark. What needs whole groups (propagation, collisions) belongs to
    the batch plan over the stored stream.
    """
    df = typed(null_tokens(raw))
    ni = audit.holds(identity(df))
    df = R.guard_ranges(df.withColumn("__ni", ni), D.VALID_RANGES)
    reason = audit.first_reason([
        ("not_row_level_nickel_catalyst", ~F.col("__ni")),
        ("missing_or_invalid_target_or_reaction_temperature", R.quoted(D.TARGET).isNull() | F.col("Reaction_Temp_C").isNull()),
        ("more_than_two_core_synthesis_fields_missing", R.null_count([R.quoted(c) for c in D.CORE_SYNTHESIS]) > 2),
    ])
    return df.withColumn("Reason", reason).drop("__ni")
