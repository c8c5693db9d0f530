"""Driver queries of the core: one for each operator family, over whole tables.

oracle.py holds the equivalent DuckDB SQL under the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.functions import rules as R
from spindrift.functions.text import is_placeholder, strip
from spindrift.operators import audit, groups, lookup, neighbours, ranking, splitting, stats
from spindrift.operators.encode import FeatureEncoder
from spindrift.operators.packed import explode_packed
from spindrift.tables import load

Q = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Q] = {}
q = R.quoted


def query(f: Q) -> Q:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Q]:
    from spindrift import flows  # the flow queries register themselves

    return dict(_ALL) | flows.queries()


def r6(c: Column | str) -> Column:
    """Doubles are compared after rounding; minus zero is zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(load(spark, d, "dataset_all"), "raw_row_id", "Promoter_Metal", "promoter")


# --- projections ---------------------------------------------------------------------------------


@query
def range_flag(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", R.out_of_range(F.col("l_quantity"), 5.0, 45.0).alias("quantity_flag"), R.out_of_range(F.col("l_discount"), 0.0, 0.08).alias("discount_flag"))


@query
def range_null(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", R.within_or_null(F.col("value"), 10.0, 400.0).alias("value"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """dataset_all with its 15 measures read as numbers."""
    df = load(spark, d, "dataset_all")
    return df.select(*(R.parse_number(q(c)).alias(c) if c in D.VALID_RANGES else q(c) for c in df.columns))


@query
def lenient_cast(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select("raw_row_id", *(r6(q(c)).alias(c) for c in D.VALID_RANGES))


@query
def guarded_measures(spark: SparkSession, d: str) -> DataFrame:
    df = R.guard_ranges(parsed(spark, d).select("raw_row_id", *(q(c) for c in D.VALID_RANGES)), D.VALID_RANGES)
    return df.select(*(r6(q(c)).alias(c) if c in D.VALID_RANGES else q(c) for c in df.columns))


@query
def bool_parse(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "dataset_all")
    flags = {c: R.parse_bool(q(c), D.TRUE_WORDS, D.FALSE_WORDS) for c in D.FLAG_COLUMNS}
    return df.select("raw_row_id", *(f.alias(c) for c, f in flags.items()), F.coalesce(flags["is_literature_comparison"], F.lit(False)).alias("comparison"))


@query
def regex_extract_num(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dataset_all").select(
        "raw_row_id", R.first_number(F.col("Catalyst"), D.LABEL_LOADING_PATTERNS, *D.LABEL_LOADING_RANGE).alias("label_value"), R.trailing_number(F.col("Catalyst")).alias("trailing_value")
    )


@query
def first_match_class(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "dataset_all")
    return df.select(
        "raw_row_id", R.classify_support(F.coalesce("Support_Normalized", "Support"), D.SUPPORT_RULES, D.NO_LABELS).alias("support_class"),
        R.classify_method(F.col("Metal_Loading_Method"), F.col("Catalyst"), D.METHOD_RULES).alias("method_class"),
    )


@query
def token_list_norm(spark: SparkSession, d: str) -> DataFrame:
    t = R.token_list(F.col("Promoter_Metal"), D.NOT_A_PROMOTER, D.NO_LABELS)
    return load(spark, d, "dataset_all").select("raw_row_id", t.alias("promoters"), F.get(F.split(t, ","), F.lit(0)).alias("first_promoter"), t.isNotNull().cast("int").alias("has_promoter"))


@query
def recode_default(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "dataset_all")
    return df.select("raw_row_id", R.recode(R.default_text(F.col("Precursor_Family")), D.PRECURSOR_NAMES).alias("precursor"), R.default_text(F.col("Support_Prep_Method")).alias("prep"))


@query
def log1p_diff_rowsum(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary")
    times = [F.col(c) for c in ("Calcination_Time_h", "Reduction_Time_h", "Dry_Time_h")]
    return n.select(
        "row_id", r6(F.log1p("GHSV_mL_g_h")).alias("ghsv_log"), r6(F.log1p("WHSV_h_inv")).alias("whsv_log"),
        r6(F.col("Calcination_Temp_C") - F.col("Reduction_Temp_C")).alias("temp_diff"), r6(R.row_sum(times)).alias("treatment_h"),
    )


@query
def row_null_count(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary")
    core = [q(c) for c in D.CORE_SYNTHESIS]
    return n.select("row_id", R.null_count(core).alias("n_missing"), (R.null_count(core) > 2).alias("excessive"), F.col("Promoter_Metal").isNotNull().cast("int").alias("has_promoter"))


@query
def key_normalise(spark: SparkSession, d: str) -> DataFrame:
    key = F.lower(strip(F.coalesce("Catalyst", "Canonical_Catalyst_ID", F.lit("Unknown"))))
    return load(spark, d, "dataset_all").select("raw_row_id", key.alias("catalyst_key"), F.concat_ws(" | ", "Support", "Metal_Loading_Method").alias("family"))


@query
def score_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Clip, half-even rounding, closeness to bounds and penalties on the primary table."""
    n = load(spark, d, "ni_model_primary")
    raw = F.col("MeOH_Conversion_%") * 1.3 - 10.0
    outside = (raw < 0) | (raw > 100)
    within = F.coalesce(F.col("Reaction_Temp_C") <= 500.0, F.lit(False))
    near = F.coalesce(R.near_bound(q("Ni_Loading_wt%"), F.lit(0.01), F.lit(80.0)), F.lit(False)) | F.coalesce(R.near_bound(F.col("Calcination_Temp_C"), F.lit(100.0), F.lit(900.0)), F.lit(False))
    return n.select(
        "row_id", r6(R.clip(raw, 0.0, 100.0)).alias("clipped"), F.rint(F.col("Reaction_Temp_C") / 10).cast("bigint").alias("index"),
        near.alias("near_bound"), r6(R.penalised(raw, within, outside)).alias("score"),
    )


@query
def pretty_labels(spark: SparkSession, d: str) -> DataFrame:
    """Readable labels of every feature name, encoded categories of the primary table included."""
    n = load(spark, d, "ni_model_primary")
    cats = n.select(F.explode(F.array(*(F.concat(F.lit(f"cat__{c}_"), q(c)) for c in ("support_type", "Metal_Loading_Method")))).alias("f")).filter("f is not null").distinct()
    names = spark.createDataFrame([(f"num__{c}",) for c in D.NUMERIC_FEATURES] + [(f"bin__{c}",) for c in D.BINARY_FEATURES], "f string")
    return names.unionByName(cats).select(F.col("f").alias("feature"), R.relabel(F.col("f"), D.LABEL_PREFIXES + D.LABEL_NAMES).alias("label"))


@query
def json_field(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.try_element_at(m, F.lit("k")).cast("bigint").alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u"))).alias("doc"))


# --- filters -------------------------------------------------------------------------------------


def ni_flags(df: DataFrame) -> DataFrame:
    active, label = F.coalesce("Active_Metal", F.lit("")), F.coalesce("Catalyst", F.lit(""))
    return df.withColumns({"active_ni": active.rlike(D.NI_TOKEN), "label_ni": label.rlike(D.NI_TOKEN), "simple_ni": strip(active).rlike(D.NI_SIMPLE)})


@query
def token_boundary_filter(spark: SparkSession, d: str) -> DataFrame:
    return ni_flags(load(spark, d, "dataset_all")).filter("active_ni or label_ni").select("raw_row_id", "active_ni", "label_ni", "simple_ni")


@query
def compound_identity(spark: SparkSession, d: str) -> DataFrame:
    """Row identity: active metal is nickel, and simply so or by the label; broadcast sources need the label."""
    df = ni_flags(load(spark, d, "dataset_all"))
    broadcast_source = F.coalesce(F.col("Source_File").startswith("REVW"), F.lit(False))
    keep = F.col("active_ni") & (F.col("simple_ni") | F.col("label_ni")) & (~broadcast_source | F.col("label_ni"))
    return df.select("raw_row_id", keep.alias("is_ni_row"))


@query
def route_two_way(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    a, b = audit.route(o, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")))
    return a.select("o_orderkey", F.lit("urgent").alias("branch")).unionByName(b.select("o_orderkey", F.lit("rest").alias("branch")))


@query
def exclusion_log(spark: SparkSession, d: str) -> DataFrame:
    """First failing reason of each raw record: target or temperature unreadable, then too little known."""
    df = R.guard_ranges(parsed(spark, d), D.VALID_RANGES)
    reason = audit.first_reason([
        ("missing_or_invalid_target_or_reaction_temperature", q(D.TARGET).isNull() | F.col("Reaction_Temp_C").isNull()),
        ("more_than_two_core_synthesis_fields_missing", R.null_count([q(c) for c in D.CORE_SYNTHESIS]) > 2),
    ])
    return audit.exclusion_log([(df.withColumn("__r", reason).filter("__r is not null"), F.col("__r"))], ["raw_row_id", "Source_File", "Canonical_Catalyst_ID", "Catalyst"])


@query
def guard_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts behind a fail-fast guard and a report, in one pass."""
    df = load(spark, d, "dataset_all")
    flag = R.parse_bool(q("is_literature_comparison"), D.TRUE_WORDS, D.FALSE_WORDS)
    n = lambda c: F.sum(c.cast("bigint"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Source_File").alias("n_sources"), n(flag.isNull()).alias("n_shifted"),
        n(is_placeholder(F.col("Promoter_Metal"))).alias("n_unpromoted"), F.lit(len(df.columns) - 1).cast("bigint").alias("n_columns"),
    )


# --- joins ---------------------------------------------------------------------------------------


@query
def dim_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary").select("row_id", "Support", F.get(F.split("Promoter_Metal", ","), F.lit(0)).alias("p"))
    n = lookup.lookup(n, "Support", load(spark, d, "support_dim"), "name", {"support_type": "unknown", "acid_base": 0, "reducible": 0})
    n = lookup.lookup(n, "p", load(spark, d, "promoter_dim"), "symbol", {"electronegativity": None, "ionic_radius": None})
    return n.select("row_id", "support_type", "acid_base", "reducible", "electronegativity", "ionic_radius", F.col("electronegativity").isNull().cast("int").alias("prom_missing"))


@query
def left_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    n, m = load(spark, d, "ni_model_primary").select("row_id", "Catalyst"), load(spark, d, "split_manifest").select("row_id", "Set")
    return lookup.join_one_to_one(n, m, "row_id")


@query
def key_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Raw records on one side only of curated and excluded ones."""
    return lookup.key_coverage(load(spark, d, "ni_model_primary"), load(spark, d, "exclusion_log"), "raw_row_id")


@query
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    a, p = load(spark, d, "dataset_all").select("raw_row_id"), load(spark, d, "ni_model_primary").select("raw_row_id")
    kept = a.join(p, "raw_row_id", "left_semi").withColumn("kept", F.lit(True))
    return kept.unionByName(a.join(p, "raw_row_id", "left_anti").withColumn("kept", F.lit(False)))


@query
def cross_params(spark: SparkSession, d: str) -> DataFrame:
    """Cross product of two short parameter lists (at most 25 x 5 rows)."""
    t = spark.createDataFrame([(t,) for t in D.SEARCH_TEMPERATURES], "temperature double")
    return load(spark, d, "region").select("r_regionkey").crossJoin(F.broadcast(t))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "embedding")


def _knn(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    e = _embeddings(spark, d)
    return neighbours.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", k)


@query
def knn_mean_distance(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of every row whose id is divisible by 20 to its five nearest among all rows."""
    return neighbours.mean_distance(_knn(spark, d)).select("query_id", F.round("mean_distance", 5).alias("mean_distance"))


@query
def domain_threshold(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.domain_threshold(neighbours.mean_distance(_knn(spark, d))).select(F.round("threshold", 5).alias("threshold"))


@query
def domain_membership(spark: SparkSession, d: str) -> DataFrame:
    m = neighbours.mean_distance(_knn(spark, d))
    t = neighbours.domain_threshold(m)
    return m.crossJoin(F.broadcast(t)).select("query_id", (F.col("mean_distance") <= F.col("threshold")).alias("within"))  # one row


# --- aggregates ----------------------------------------------------------------------------------


@query
def unique_propagation(spark: SparkSession, d: str) -> DataFrame:
    df = parsed(spark, d).select("raw_row_id", "Source_File", "Canonical_Catalyst_ID", "Reaction_Temp_C")
    return groups.propagate_unique(df, "Reaction_Temp_C", "Source_File", "Canonical_Catalyst_ID").select("raw_row_id", r6("Reaction_Temp_C").alias("temperature"))


_COLLISION = ["l_partkey", "l_suppkey"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(*_COLLISION, "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"))


@query
def collision_resolve(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = groups.resolve_collisions(_lines(spark, d), _COLLISION, "l_quantity", "line_id")
    return kept.select("line_id", "l_partkey", "l_suppkey", r6("l_quantity").alias("l_quantity"), "Replicate_Count", r6("Replicate_Target_Range").alias("Replicate_Target_Range"), "Original_Row_IDs")


@query
def collision_audit(spark: SparkSession, d: str) -> DataFrame:
    _, bad = groups.resolve_collisions(_lines(spark, d), _COLLISION, "l_quantity", "line_id")
    return bad.select("line_id", r6("Collision_Target_Range").alias("Collision_Target_Range"))


@query
def primary_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Collision groups of the primary table by the full 19-column key."""
    n = load(spark, d, "ni_model_primary")
    g = groups.collision_groups(n, D.COLLISION_KEY, D.TARGET, "row_id", D.COLLISION_LIMIT)
    return g.select(F.col("__first").alias("first_id"), F.col("__n").alias("n"), r6("__range").alias("target_range"), r6("__median").alias("median"), F.col("__clash").alias("clash"))


@query
def group_median_quantile(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    qs = F.percentile("p_retailprice", F.array(F.lit(0.01), F.lit(0.95), F.lit(0.99)))
    return p.groupBy("p_brand").agg(r6(F.median("p_retailprice")).alias("median_price"), *(r6(qs[i]).alias(n) for i, n in enumerate(("q01", "q95", "q99"))), F.count_distinct("p_type").alias("n_types"))


@query
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    s = stats.summary(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return s.select("Metric", *(F.round(c, 4).alias(c) for c in ("Mean", "SD", "Median", "Min", "Max")))


@query
def mode_lowest_tie(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").groupBy("p_brand").agg(stats.mode_or(F.col("p_size"), -1).alias("mode_size"), r6(stats.median_or(F.when(F.col("p_size") > 49, F.col("p_retailprice")), 0.0)).alias("median_or_zero"))


@query
def summary_rate(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(
        r6(F.max("l_extendedprice")).alias("best"), r6(F.median("l_extendedprice")).alias("median"), F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("l_discount") > 0.05).cast("int"))).alias("rate")
    )


@query
def family_frequency(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary")
    f = stats.families(n, ["Support", "Promoter_Metal", "Metal_Loading_Method"], "Promoter_Metal")
    return f.groupBy("Support", "Track").agg(
        F.sum("Dataset_Count").alias("n"), F.array_join(F.array_sort(F.collect_set("Metal_Loading_Method")), ", ").alias("methods"), F.max("Dataset_Count").alias("largest")
    )


@query
def adaptive_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = stats.adaptive_bounds(load(spark, d, "ni_model_primary"), {c: D.VALID_RANGES[c] for c in D.SEARCH_COLUMNS})
    return b.select("Parameter", *(r6(c).alias(c) for c in ("Lower", "Upper", "Physical_Lower", "Physical_Upper")))


@query
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500.0).alias("predicted"))
    m = stats.regression_metrics(li, "l_extendedprice", "predicted", ["l_returnflag"])
    return m.select("l_returnflag", "n", r6("R2").alias("R2"), F.round("MAE", 3).alias("MAE"), F.round("RMSE", 3).alias("RMSE"))


@query
def residuals(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("l_quantity") * 1500.0 - F.col("l_extendedprice")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(e, 4).alias("residual"), F.round(F.abs(e), 4).alias("abs_residual"))


@query
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dataset_all").groupBy("Support_Normalized").agg(F.count(F.lit(1)).alias("n"))


# --- windows, sorts, top-k ------------------------------------------------------------------------


@query
def rank_min(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", F.round("c_acctbal", -1).alias("balance"))
    return ranking.competition_rank(c, "balance", "c_custkey", "rank").select("c_custkey", "balance", "rank")


@query
def rownum_topk_group(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranking.top_k(o, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 10, "rank")


@query
def global_top_n(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query
def nlargest_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    none = ranking.largest_by_count(n, "n", ["p_brand", "p_type"], 10**9).withColumn("case", F.lit("fallback"))
    return none.unionByName(ranking.largest_by_count(n, "n", ["p_brand", "p_type"], 10).withColumn("case", F.lit("enough")))


@query
def window_select(spark: SparkSession, d: str) -> DataFrame:
    """Model selection rule on candidates made from customer groups."""
    c = load(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("Candidate")).agg(
        F.round(F.avg("c_acctbal") / 5000, 6).alias("CV_R2_Mean"), F.round(F.stddev_samp("c_acctbal") / 30000, 6).alias("CV_R2_SD"),
        F.round(F.abs(F.max("c_acctbal") + F.min("c_acctbal") - 2 * F.avg("c_acctbal")) / 30000, 6).alias("CV_Gap_Mean"), F.length(F.first("c_mktsegment")).alias("Complexity_Rank"),
    )
    return stats.select_model(c, 0.2)


@query
def running_best(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return ranking.running_max(e, "user_id", ["ts", "event_id"], "value", "best_so_far").select("event_id", "best_so_far")


@query
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = load(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query
def long_form_topn(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in long form, the ten components of largest mean size, and their values."""
    long = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("component", "value"))
    top = long.groupBy("component").agg(F.avg(F.abs(F.col("value").cast("double"))).alias("m")).orderBy(F.desc(F.round("m", 6)), "component").limit(10)
    return long.join(F.broadcast(top.select("component")), "component").select("vec_id", "component", F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def wide_columns(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings")
    width = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    return df.select("vec_id", *(F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"v{i}") for i in range(width)))


# --- sampling and splitting -----------------------------------------------------------------------


def _strata(spark: SparkSession, d: str) -> DataFrame:
    return splitting.strata(load(spark, d, "ni_model_primary").select("row_id", "Source_File"), "Source_File", 4)


@query
def strata_rare(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d).select("row_id", "Source_Stratum")


@query
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    n = _strata(spark, d).groupBy("Source_Stratum").agg(F.count(F.lit(1)).alias("n"))
    return splitting.largest_remainder(n, "Source_Stratum", "n", 0.2).select("Source_Stratum", "n", "quota")


@query
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.stratified_split(_strata(spark, d), "row_id", "Source_Stratum").select("row_id", "Source_Stratum", "Set")


@query
def repeated_splits(spark: SparkSession, d: str) -> DataFrame:
    """Test counts of each stratum and seed."""
    s = splitting.repeated_splits(_strata(spark, d), "row_id", "Source_Stratum", [42, 43, 44])
    return s.groupBy("Split_Seed", "Source_Stratum").agg(F.sum((F.col("Set") == "Test").cast("bigint")).alias("n_test"), F.sum(F.when(F.col("Set") == "Test", F.col("row_id"))).alias("test_ids"))


@query
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return splitting.folds(load(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "fold")


@query
def learning_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled prefixes of the rows at growing shares."""
    o = load(spark, d, "orders").select("o_orderkey")
    n = o.count()
    at = ranking.global_index(o.withColumn("h", splitting.draw(42, "o_orderkey")), ["h", "o_orderkey"], "at")
    shares = [0.2, 0.35, 0.5, 0.7, 0.85, 1.0]
    first = F.array(*(F.when(F.col("at") < s, F.lit(p)) for p, s in zip(shares, splitting.subset_sizes(n, shares))))
    return at.select("o_orderkey", F.array_min(F.filter(first, lambda x: x.isNotNull())).alias("smallest_share"))


# --- encoding ------------------------------------------------------------------------------------


@query
def median_impute_scale(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary")
    enc = FeatureEncoder(["Ni_Loading_wt%", "Calcination_Temp_C", "GHSV_log", "prom_ionic_radius"]).fit(n)
    return n.select("row_id", *(r6(c).alias(f"z{i}") for i, c in enumerate(enc.columns())))


@query
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary")
    enc = FeatureEncoder(["Reaction_Temp_C", "S_C_Ratio", "TOS_h"], scale="robust").fit(n)
    return n.select("row_id", *(r6(c).alias(f"z{i}") for i, c in enumerate(enc.columns())))


@query
def onehot_minfreq(spark: SparkSession, d: str) -> DataFrame:
    """Long form of the encoded categories: one row for each one."""
    n = load(spark, d, "ni_model_primary")
    enc = FeatureEncoder([], ["support_type", "Precursor_Family"], [], min_frequency=20).fit(n)
    return enc.transform_long(n, "row_id")


@query
def binary_mode_impute(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "ni_model_primary").withColumn("b", F.when(F.col("row_id") % 7 != 0, F.col("has_promoter")))
    enc = FeatureEncoder([], [], ["b", "support_reducible"]).fit(n)
    return n.select("row_id", *(c.alias(f"b{i}") for i, c in enumerate(enc.columns())))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Range guard, strata, collision resolution and top-k on one table."""
    li = R.guard_ranges(_lines(spark, d), {"l_quantity": (1.0, 48.0)}).filter("l_quantity is not null")
    li = splitting.strata(li.withColumn("s", F.col("l_suppkey").cast("string")), "s", 4, "rare", "stratum").drop("s")
    kept, _ = groups.resolve_collisions(li, _COLLISION, "l_quantity", "line_id")
    return ranking.top_k(kept, "stratum", [F.desc("l_quantity"), F.col("line_id")], 10, "rank").select("stratum", "line_id", "l_quantity", "Replicate_Count", "rank")


@query
def flagship_slice(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)
