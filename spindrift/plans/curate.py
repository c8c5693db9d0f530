"""From raw records to the curated table, with an audit of everything left out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.functions import rules as R
from spindrift.functions.text import strip
from spindrift.operators import audit, groups, lookup, ranking
from spindrift.session import cut
from spindrift.sources import records

_IDS = ["raw_row_id", "Source_File", "Canonical_Catalyst_ID", "Catalyst"]
q = R.quoted


@dataclass
class Curated:
    all_clean: DataFrame
    primary: DataFrame
    comparison: DataFrame
    collisions: DataFrame
    exclusions: DataFrame


def identity(df: DataFrame, excused: Sequence[str] = (), broadcast_sources: Sequence[str] = ()) -> Column:
    """Is the record one of a nickel catalyst: nickel among the active metals, and either simply nickel, or named
    in the label, or from an excused source; sources that give one metal list for all their rows need the label."""
    active, label = F.coalesce("Active_Metal", F.lit("")), F.coalesce("Catalyst", F.lit(""))
    named, source = label.rlike(D.NI_TOKEN), F.coalesce("Source_File", F.lit(""))
    simple = strip(active).rlike(D.NI_SIMPLE) | (source.isin(*excused) if excused else F.lit(False))
    needs_label = source.isin(*broadcast_sources) if broadcast_sources else F.lit(False)
    return active.rlike(D.NI_TOKEN) & (simple | named) & (~needs_label | named)


def typed(df: DataFrame, patches: Sequence[tuple[Column, str, Column]] = ()) -> DataFrame:
    """Flags and numbers read by the lenient rules; patches (condition, column, value) fill nulls of a column."""
    out = df.select(*(
        R.parse_bool(q(c), D.TRUE_WORDS, D.FALSE_WORDS).alias(c) if c in D.FLAG_COLUMNS else R.parse_number(q(c)).alias(c) if c in D.VALID_RANGES else q(c)
        for c in df.columns
    ))
    for cond, column, value in patches:
        out = out.withColumn(column, F.when(q(column).isNull() & audit.holds(cond), value).otherwise(q(column)))
    return out


def engineered(df: DataFrame, supports: DataFrame, promoters: DataFrame) -> DataFrame:
    """Normalised text columns, derived measures and dimension properties."""
    promoter = R.token_list(F.col("Promoter_Metal"), D.NOT_A_PROMOTER, D.NO_LABELS)
    new = {
        "Promoter_Metal": promoter,
        "Promoter_Loading_wt%": F.when(promoter.isNull(), 0.0).otherwise(q("Promoter_Loading_wt%")),
        "Support": R.classify_support(F.coalesce("Support_Normalized", "Support"), D.SUPPORT_RULES, D.NO_LABELS),
        "Metal_Loading_Method": R.classify_method(F.col("Metal_Loading_Method"), F.col("Catalyst"), D.METHOD_RULES),
        "Precursor_Family": R.recode(R.default_text(F.col("Precursor_Family")), D.PRECURSOR_NAMES),
        "Support_Prep_Method": R.default_text(F.col("Support_Prep_Method")),
    }
    more = {
        "Catalyst_Label_Ni_Value": R.first_number(F.col("Catalyst"), D.LABEL_LOADING_PATTERNS, *D.LABEL_LOADING_RANGE),
        "GHSV_log": F.log1p("GHSV_mL_g_h"),
        "WHSV_log": F.log1p("WHSV_h_inv"),
        "calc_reduc_temp_diff": F.col("Calcination_Temp_C") - F.col("Reduction_Temp_C"),
        "total_treatment_time_h": R.row_sum([F.col(c) for c in ("Calcination_Time_h", "Reduction_Time_h", "Dry_Time_h")]),
        "has_promoter": promoter.isNotNull().cast("int"),
        "__first": F.get(F.split(promoter, ","), F.lit(0)),
    }
    out = df.select(*(new[c].alias(c) if c in new else q(c) for c in df.columns if c not in more), *(v.alias(c) for c, v in more.items()))
    out = lookup.lookup(out, "__first", promoters.toDF("symbol", "prom_electronegativity", "prom_ionic_radius", "prom_atomic_mass", "prom_first_ionization"), "symbol",
                        {c: None for c in ("prom_electronegativity", "prom_ionic_radius", "prom_atomic_mass", "prom_first_ionization")})
    out = out.withColumn("prom_missing", F.col("prom_electronegativity").isNull().cast("int")).drop("__first")
    return lookup.lookup(out, "Support", supports.toDF("name", "support_type", "support_acid_base", "support_reducible"), "name", {"support_type": "unknown", "support_acid_base": 0, "support_reducible": 0})


def curate(raw: DataFrame, supports: DataFrame | None = None, promoters: DataFrame | None = None, patches: Sequence = (), excused: Sequence[str] = (), broadcast_sources: Sequence[str] = ()) -> Curated:
    """raw: raw_row_id and the raw columns as text. Every raw row ends up exactly once: in exclusions, as a
    comparison, or in a primary row (Replicate_Count of them). An empty table gives five empty ones."""
    spark = raw.sparkSession
    audit.require_columns(raw, ["raw_row_id", *D.TEXT_COLUMNS, *D.FLAG_COLUMNS, *D.VALID_RANGES])
    df = typed(records.null_tokens(raw), patches)
    ni, other = audit.route(df, identity(df, excused, broadcast_sources))
    ni = groups.propagate_unique(ni, "Reaction_Temp_C", "Source_File", "Canonical_Catalyst_ID")
    ni = R.guard_ranges(ni, D.VALID_RANGES)
    ni = engineered(ni, supports if supports is not None else records.supports(spark), promoters if promoters is not None else records.promoters(spark))
    ni = ni.withColumn("__reason", audit.first_reason([
        ("missing_or_invalid_target_or_reaction_temperature", q(D.TARGET).isNull() | F.col("Reaction_Temp_C").isNull()),
        ("more_than_two_core_synthesis_fields_missing", R.null_count([q(c) for c in D.CORE_SYNTHESIS]) > 2),
    ]))
    ni = ni.withColumn("is_literature_comparison", F.coalesce("is_literature_comparison", F.lit(False)))
    ni = ni.withColumn("Catalyst_Key", F.lower(strip(F.coalesce("Catalyst", "Canonical_Catalyst_ID", F.lit("Unknown")))))
    ni = cut(ni)  # five results are read from it
    clean = ni.filter("__reason is null").drop("__reason")
    comparison, primary = audit.route(clean, F.col("is_literature_comparison"))
    kept, clash = groups.resolve_collisions(primary, D.COLLISION_KEY, D.TARGET, "raw_row_id", D.COLLISION_LIMIT)
    kept = ranking.global_index(kept, ["raw_row_id"], "row_id")
    log = audit.exclusion_log([
        (other, "not_row_level_nickel_catalyst"), (ni.filter("__reason is not null"), F.col("__reason")), (clash, "unresolved_condition_collision"),
    ], _IDS)
    return Curated(clean.drop("Catalyst_Key"), kept.select("row_id", *(q(c) for c in kept.columns if c != "row_id")), comparison.drop("Catalyst_Key"), clash, log)


def manifest(raw: DataFrame, c: Curated) -> DataFrame:
    """One row of counts and fingerprints that tie the stages together."""
    out = None
    for name, df in (("raw", raw), ("all_clean", c.all_clean), ("comparison", c.comparison), ("primary", c.primary), ("collisions", c.collisions), ("exclusions", c.exclusions)):
        one = records.table_hash(df).select(F.col("n_rows").alias(f"{name}_rows"), F.col("fingerprint").alias(f"{name}_fingerprint"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out
