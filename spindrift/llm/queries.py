"""The queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import canon, formatdups, linksplit, mixing, overlap, tokens, truncation
from spindrift.tables import load

_COPIES = ("raw_row_id", "Source_File", "Catalyst", "Promoter_Metal", ("extra_01",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdups.format_copies(load(spark, d, "dataset_all"), *_COPIES)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """One representative of each group of copies with the number of its copies."""
    df = load(spark, d, "dataset_all")
    return formatdups.copy_counts(formatdups.format_copies(df, *_COPIES), df, "raw_row_id")


_TYPED = ["Support", "Metal_Loading_Method", "Precursor_Family"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_to_canonical(load(spark, d, "dataset_all"), "raw_row_id", _TYPED, load(spark, d, "canonical_values"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each field that name no entry."""
    return canon.unmatched_report(p3_found(spark, d))


def _with_split(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary").select("row_id", "Source_File", "Catalyst", "Reaction_Temp_C")
    return n.join(load(spark, d, "split_manifest").select("row_id", "Set"), "row_id")


def _overlaps(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return overlap.cross_split_classes(df, "row_id", "Source_File", "Catalyst", "Reaction_Temp_C", "Set")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = overlap.cross_split_pairs(*_overlaps(_with_split(spark, d)))
    return p.select(F.least("id_train", "id_eval").alias("row_id_a"), F.greatest("id_train", "id_eval").alias("row_id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation records and pairs of each split and source."""
    df = _with_split(spark, d)
    return overlap.overlap_report(_overlaps(df)[0], df, "Source_File", "Set")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each source file with the representative and the size of its group of linked files."""
    return linksplit.linked_groups(load(spark, d, "ni_model_primary"), "Source_File", "Canonical_Catalyst_ID")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linksplit.linked_pairs(p5_groups(spark, d))


def _split_targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    """The handful of named splits; the table is read with a bound."""
    rows = load(spark, d, "split_targets").orderBy(F.desc("target_share"), "split_name").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 splits")
    return [(r.split_name, r.target_share) for r in rows]


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    """Each record's split at the shares of split_targets, linked records together."""
    return linksplit.grouped_split(load(spark, d, "ni_model_primary"), "row_id", "Source_File", "Canonical_Catalyst_ID", _split_targets(spark, d))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by p5_split against the targets."""
    return linksplit.split_report(p5_split(spark, d), _split_targets(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_ids(load(spark, d, "documents"), "doc_id", "text")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture with the number of their uses."""
    return mixing.mix(load(spark, d, "documents"), "doc_id", "text", "source", load(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares the mixture reaches against the targets."""
    return mixing.mix(load(spark, d, "documents"), "doc_id", "text", "source", load(spark, d, "mix_targets"))[1]


def _endings(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(load(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _endings(spark, d).filter("truncated").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_rates(_endings(spark, d))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which significantly many texts of a source end."""
    df = load(spark, d, "documents").filter("trim(text) <> ''")
    h = truncation.length_hazards(df.select(F.col("source").alias("src"), F.length("text").alias("chars"), F.octet_length("text").alias("octets")))
    return h.filter("significant").select(F.col("src").alias("source"), "unit", "len", "n", "at_risk", F.round("hazard", 6).alias("hazard"), F.round("expected", 6).alias("expected"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        "p2_found", "p2_counts", "p3_found", "p3_report", "p4_found", "p4_report", "p5_found", "p5_groups", "p5_split", "p5_shares", "p6_ids", "p7_mixture", "p7_shares",
        "p8_found", "p8_rates", "p8_limits",
    ]
    return {n: globals()[n] for n in names}
