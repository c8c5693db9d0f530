"""DuckDB SQL of the core queries, under the same names and with the same columns."""

from __future__ import annotations

from collections.abc import Sequence

from spindrift import domain as D

_WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}\x{200b}\x{feff}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def words(xs: Sequence[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def col(c: str) -> str:
    return '"' + c + '"'


def number(c: str) -> str:
    return rf"CASE WHEN regexp_matches({strip(c)}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({strip(c)} AS DOUBLE) END"


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0::DOUBLE"


def guard(e: str, r: tuple[float, float]) -> str:
    return f"CASE WHEN {e} BETWEEN {r[0]} AND {r[1]} THEN {e} END"


def classifier(text: str, rules, default: str) -> str:
    def alt(a) -> str:
        return " AND ".join(f"contains({text}, '{p}')" for p in ((a,) if isinstance(a, str) else a))

    whens = " ".join(f"WHEN {' OR '.join(f'({alt(a)})' for a in alts)} THEN '{label}'" for label, alts in rules)
    return f"CASE {whens} ELSE {default} END"


def not_given(c: str) -> str:
    return f"({c} IS NULL OR lower({strip(c)}) IN ('', 'na', 'n/a', 'none', 'nan', 'null'))"


def parse_bool(c: str) -> str:
    w = f"lower({strip(f'coalesce({c}, {chr(39)}{chr(39)})')})"
    return f"CASE WHEN {w} IN {words(D.TRUE_WORDS)} THEN TRUE WHEN {w} IN {words(D.FALSE_WORDS)} THEN FALSE END"


def default_text(c: str) -> str:
    return f"coalesce(nullif({strip(c)}, ''), 'Unknown')"


_PARSED = "SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, Catalyst, " + ", ".join(f"{number(col(c))} AS {col(c)}" for c in D.VALID_RANGES) + " FROM dataset_all"
_GUARDED = "SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, Catalyst, " + ", ".join(f"{guard(col(c), r)} AS {col(c)}" for c, r in D.VALID_RANGES.items()) + f" FROM ({_PARSED})"
_SUPPORT_CN = [x[0] for x in D.SUPPORT_RULES].index("CN")
_NO = words(D.NO_LABELS)


def _support(c: str) -> str:
    digits = f"translate({c}, '₂₃₄', '234')"
    s = f"regexp_replace(lower({digits}), '{_WS}+', '', 'g')"
    rest = classifier(s, D.SUPPORT_RULES[_SUPPORT_CN + 1 :], f"CASE WHEN {s} IN {_NO} THEN 'Unknown' ELSE 'Other' END")
    cn = f"CASE WHEN upper({strip(digits)}) = 'CN' THEN 'CN' ELSE {rest} END"
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' ELSE {classifier(s, D.SUPPORT_RULES[: _SUPPORT_CN + 1], cn)} END"


def _method() -> str:
    s = "lower(concat_ws(' ', nullif(Metal_Loading_Method, ''), nullif(Catalyst, '')))"
    return classifier(s, D.METHOD_RULES, f"CASE WHEN length({strip(s)}) = 0 THEN 'Unknown' ELSE 'Other' END")


_TOKENS = (
    f"SELECT raw_row_id, CASE WHEN lower({strip('Promoter_Metal')}) NOT IN {_NO} THEN nullif(array_to_string(list_filter(list_transform("
    f"regexp_split_to_array(Promoter_Metal, '[,/;]'), lambda x: {strip('x')}), lambda x: length(x) > 0 AND lower(x) NOT IN {words(D.NOT_A_PROMOTER)}), ','), '') END AS promoters FROM dataset_all"
)
_P1, _P2 = (p.replace("(?i)", "") for p in D.LABEL_LOADING_PATTERNS)
_NI = D.NI_TOKEN.replace("(?i)", "")
_NI_FLAGS = (
    f"SELECT raw_row_id, Source_File, regexp_matches(coalesce(Active_Metal, ''), '{_NI}', 'i') AS active_ni, regexp_matches(coalesce(Catalyst, ''), '{_NI}', 'i') AS label_ni, "
    f"regexp_matches({strip(chr(99) + 'oalesce(Active_Metal, ' + chr(39) * 2 + ')')}, '^Ni([-/ ].*)?$', 'i') AS simple_ni FROM dataset_all"
)
_LINES = "SELECT l_partkey, l_suppkey, l_quantity, l_orderkey * 10 + l_linenumber AS line_id FROM lineitem"
_GROUPS = f"SELECT l_partkey, l_suppkey, min(line_id) AS first_id, count(*) AS n, max(l_quantity) - min(l_quantity) AS rng, median(l_quantity) AS med, string_agg(line_id::VARCHAR, ';' ORDER BY line_id) AS ids FROM ({_LINES}) GROUP BY ALL"
_KNN = (
    "SELECT query_id, avg(dist) AS mean_distance FROM (SELECT a.vec_id AS query_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn "
    "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rn <= 5 GROUP BY query_id"
)
_STRATA = "SELECT row_id, Source_File, CASE WHEN count(*) OVER (PARTITION BY Source_File) >= 4 THEN Source_File ELSE 'rare_sources' END AS Source_Stratum FROM ni_model_primary"
_QUOTA = (
    f"WITH s AS ({_STRATA}), c AS (SELECT Source_Stratum, count(*) AS n FROM s GROUP BY 1), t AS (SELECT sum(n) AS total, ceil(round(sum(n) * 0.2 * 1000000) / 1000000) AS places FROM c), "
    "e AS (SELECT c.*, places, floor(n * places / total) AS whole, round(n * places / total - floor(n * places / total), 9) AS rest FROM c, t), "
    "k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, Source_Stratum) - 1 AS pos, sum(whole) OVER () AS given FROM e), "
    "quota AS (SELECT Source_Stratum, n, (whole + CASE WHEN pos < places - given THEN 1 ELSE 0 END)::BIGINT AS quota FROM k)"
)


def _split(seed: int) -> str:
    return f"SELECT row_id, s.Source_Stratum, CASE WHEN row_number() OVER (PARTITION BY s.Source_Stratum ORDER BY md5('{seed}|' || row_id), row_id) <= quota THEN 'Test' ELSE 'Train' END AS \"Set\" FROM s JOIN quota USING (Source_Stratum)"


def _bounds(c: str) -> str:
    pl, ph = D.VALID_RANGES[c]
    x = f"SELECT min({col(c)}) lo, max({col(c)}) hi, quantile_cont({col(c)}, 0.01) a, quantile_cont({col(c)}, 0.99) b FROM ni_model_primary"
    y = f"SELECT CASE WHEN lo IS NULL THEN {pl} WHEN lo = hi THEN greatest({pl}, lo * 0.9) ELSE greatest({pl}, a) END AS l, CASE WHEN lo IS NULL THEN {ph} WHEN lo = hi THEN least({ph}, lo * 1.1 + 1e-6) ELSE least({ph}, b) END AS u FROM ({x})"
    return f"SELECT '{c}' AS \"Parameter\", {r6('l::DOUBLE')} AS \"Lower\", {r6(f'(CASE WHEN u <= l THEN least({ph}, l + greatest(1.0, abs(l) * 0.1)) ELSE u END)::DOUBLE')} AS \"Upper\", {pl}::DOUBLE AS \"Physical_Lower\", {ph}::DOUBLE AS \"Physical_Upper\" FROM ({y})"


def _scaled(c: str, robust: bool) -> str:
    v = f"coalesce({col(c)}::DOUBLE, (SELECT median({col(c)}) FROM ni_model_primary))"
    center, spread = ("median(v)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)") if robust else ("avg(v)", "stddev_pop(v)")
    f = f"(SELECT {center} AS c, CASE WHEN {spread} > 1e-12 THEN {spread} ELSE 1.0 END AS s FROM (SELECT {v} AS v FROM ni_model_primary))"
    return r6(f"({v} - (SELECT c FROM {f})) / (SELECT s FROM {f})")


def _labels() -> str:
    e = "f"
    for old, new in D.LABEL_PREFIXES + D.LABEL_NAMES:
        e = f"replace({e}, '{old}', '{new}')"
    fixed = ", ".join([f"('num__{c}')" for c in D.NUMERIC_FEATURES] + [f"('bin__{c}')" for c in D.BINARY_FEATURES])
    cats = " UNION ".join(f"SELECT 'cat__{c}_' || {c} AS f FROM ni_model_primary WHERE {c} IS NOT NULL" for c in ("support_type", "Metal_Loading_Method"))
    return f"SELECT f AS feature, {e} AS label FROM (SELECT f FROM (VALUES {fixed}) v(f) UNION ALL SELECT * FROM ({cats}))"


_CONV = '("MeOH_Conversion_%" * 1.3 - 10.0)::DOUBLE'


def _near(c: str, lo: float, hi: float) -> str:
    return f"coalesce(({c} - {lo}) / {hi - lo} <= 0.02 OR ({hi} - {c}) / {hi - lo} <= 0.02, FALSE)"


def packed_values(c: str) -> str:
    """List of the values of a packed cell: a decimal comma and the sign of a charge are set aside as chr(1) and
    chr(2), values are runs of quoted spans, bracketed spans and characters that are no delimiter."""
    q = "''"
    s = f"regexp_replace({strip(c)}, '^[\\s,;]*\\[([^\\[\\]]*)\\][\\s,;]*$', '\\1')"
    s = f"regexp_replace({s}, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    s = f"regexp_replace({s}, '([A-Za-z][0-9]{{1,2}})\\+([^A-Za-z0-9]|$)', '\\1' || chr(2) || '\\2', 'g')"
    s = f"regexp_replace({s}, '(^|[^A-Za-z0-9-])and([^A-Za-z0-9-]|$)', '\\1;\\2', 'gi')"
    s = f"regexp_replace({s}, '(^|[^A-Za-z0-9])([nN])/([aA])([^A-Za-z0-9]|$)', '\\1\\2' || chr(3) || '\\3\\4', 'g')"
    one = f"(\"[^\"]*\"|{q}[^{q}]*{q}|\\([^()]*\\)|[^;；|、，/&\\t\\n\\r,+\"{q}(])+"
    back = "replace(replace(replace(x, chr(1), ','), chr(2), '+'), chr(3), '/')"
    bare = f"regexp_replace({strip(back)}, '^(\"([^\"]*)\"|{q}([^{q}]*){q})$', '\\2\\3')"
    return f"list_transform(regexp_extract_all({s}, '{one}'), lambda x: {strip(bare)})"


_PACKED = (
    f"SELECT raw_row_id, list_filter({packed_values('Promoter_Metal')}, lambda v: lower(v) NOT IN ('', 'na', 'n/a', 'none', 'nan', 'null')) AS v FROM dataset_all WHERE NOT {not_given('Promoter_Metal')}"
)


def _curated() -> str:
    """CTEs of the curation flow: excl1, reasons, primary_rows, groups."""
    na = words(D.NA_TOKENS)
    clean = lambda c: f"CASE WHEN {col(c)} NOT IN {na} THEN {col(c)} END"
    text = [*D.TEXT_COLUMNS, *D.FLAG_COLUMNS, *D.VALID_RANGES]
    simple = strip("coalesce(Active_Metal, '')")
    others = [c for c in D.VALID_RANGES if c != "Reaction_Temp_C"]
    supports = ", ".join(f"('{a}', '{b}', {x}, {y})" for a, b, x, y in D.SUPPORTS)
    promoters = ", ".join(f"('{a}', {', '.join(f'{v}::DOUBLE' for v in rest)})" for a, *rest in D.PROMOTERS)
    tokens = (
        f"CASE WHEN lower({strip('Promoter_Metal')}) NOT IN {_NO} THEN nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(Promoter_Metal, '[,/;]'), "
        f"lambda x: {strip('x')}), lambda x: length(x) > 0 AND lower(x) NOT IN {words(D.NOT_A_PROMOTER)}), ','), '') END"
    )
    label = f"TRY_CAST(CASE WHEN regexp_matches(Catalyst, '{_P1}', 'i') THEN regexp_extract(Catalyst, '{_P1}', 1, 'i') WHEN regexp_matches(Catalyst, '{_P2}', 'i') THEN regexp_extract(Catalyst, '{_P2}', 1, 'i') END AS DOUBLE)"
    precursor = f"CASE lower(pre) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in D.PRECURSOR_NAMES.items())} ELSE lower(pre) END"
    guarded = ", ".join(f"{guard(col(c), r)} AS {col(c)}" for c, r in D.VALID_RANGES.items() if c != "Promoter_Loading_wt%")
    flags = ", ".join(f"CASE WHEN {col(c)} NOT BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS {col(c + '_range_flag')}" for c, (lo, hi) in D.VALID_RANGES.items())
    return (
        "WITH raw0 AS (SELECT raw_row_id, " + ", ".join(f"{clean(c)} AS {col(c)}" for c in text) + " FROM dataset_all), "
        f"flagged AS (SELECT *, regexp_matches(coalesce(Active_Metal, ''), '{_NI}', 'i') AND (regexp_matches({simple}, '^Ni([-/ ].*)?$', 'i') OR regexp_matches(coalesce(Catalyst, ''), '{_NI}', 'i')) AS is_ni FROM raw0), "
        f"typed AS (SELECT * REPLACE ({', '.join(f'{number(col(c))} AS {col(c)}' for c in D.VALID_RANGES)}, coalesce({parse_bool('is_literature_comparison')}, FALSE) AS is_literature_comparison) FROM flagged WHERE is_ni), "
        "fine AS (SELECT * REPLACE (coalesce(Reaction_Temp_C, CASE WHEN min(Reaction_Temp_C) OVER w = max(Reaction_Temp_C) OVER w THEN min(Reaction_Temp_C) OVER w END) AS Reaction_Temp_C) FROM typed WINDOW w AS (PARTITION BY Source_File, Canonical_Catalyst_ID)), "
        "filled AS (SELECT * REPLACE (coalesce(Reaction_Temp_C, CASE WHEN min(Reaction_Temp_C) OVER w = max(Reaction_Temp_C) OVER w THEN min(Reaction_Temp_C) OVER w END) AS Reaction_Temp_C) FROM fine WINDOW w AS (PARTITION BY Source_File)), "
        f"prom AS (SELECT * REPLACE ({tokens} AS Promoter_Metal), coalesce(Support_Normalized, Support) AS sup, {default_text('Precursor_Family')} AS pre, {flags} FROM filled), "
        f"eng AS (SELECT * REPLACE ({guarded}, CASE WHEN Promoter_Metal IS NULL THEN 0.0 ELSE {guard(col('Promoter_Loading_wt%'), D.VALID_RANGES['Promoter_Loading_wt%'])} END AS \"Promoter_Loading_wt%\", "
        f"{_support('sup')} AS Support, {_method()} AS Metal_Loading_Method, {precursor} AS Precursor_Family, {default_text('Support_Prep_Method')} AS Support_Prep_Method), {label} AS lab, "
        f"lower({strip('coalesce(Catalyst, Canonical_Catalyst_ID, ' + chr(39) + 'Unknown' + chr(39) + ')')}) AS Catalyst_Key FROM prom), "
        'reasons AS (SELECT *, CASE WHEN "MeOH_Conversion_%" IS NULL OR Reaction_Temp_C IS NULL THEN \'missing_or_invalid_target_or_reaction_temperature\' WHEN ' + " + ".join(f"({col(c)} IS NULL)::INT" for c in D.CORE_SYNTHESIS) + " > 2 THEN 'more_than_two_core_synthesis_fields_missing' END AS reason FROM eng), "
        "prim AS (SELECT * FROM reasons WHERE reason IS NULL AND NOT is_literature_comparison), "
        "grp AS (SELECT " + ", ".join(f"{col(c)} AS k{i}" for i, c in enumerate(D.COLLISION_KEY)) + ', min(raw_row_id) AS first_id, count(*) AS n, max("MeOH_Conversion_%") - min("MeOH_Conversion_%") AS rng, median("MeOH_Conversion_%") AS med, string_agg(raw_row_id::VARCHAR, \';\' ORDER BY raw_row_id) AS ids, count(*) > 1 AND max("MeOH_Conversion_%") - min("MeOH_Conversion_%") > 5 AS clash FROM prim GROUP BY ' + ", ".join(f"k{i}" for i in range(len(D.COLLISION_KEY))) + "), "
        f"sdim AS (SELECT * FROM (VALUES {supports}) v(name, support_type, acid, red)), pdim AS (SELECT * FROM (VALUES {promoters}) v(symbol, e, r, m, f)), "
        "excl AS (SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, Catalyst, 'not_row_level_nickel_catalyst' AS \"Reason\" FROM flagged WHERE NOT is_ni UNION ALL SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, Catalyst, reason FROM reasons WHERE reason IS NOT NULL "
        "UNION ALL SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, Catalyst, 'unresolved_condition_collision' FROM prim JOIN grp ON clash AND " + " AND ".join(f"{col(c)} IS NOT DISTINCT FROM k{i}" for i, c in enumerate(D.COLLISION_KEY)) + ") "
    )


def _curated_features() -> str:
    num = {c: col(c) for c in D.NUMERIC_FEATURES if c != "support_acid_base"} | {
        "GHSV_log": "ln(1 + GHSV_mL_g_h)", "WHSV_log": "ln(1 + WHSV_h_inv)", "calc_reduc_temp_diff": "Calcination_Temp_C - Reduction_Temp_C",
        "total_treatment_time_h": "CASE WHEN coalesce(Calcination_Time_h, Reduction_Time_h, Dry_Time_h) IS NOT NULL THEN coalesce(Calcination_Time_h, 0) + coalesce(Reduction_Time_h, 0) + coalesce(Dry_Time_h, 0) END",
        "prom_electronegativity": "e", "prom_ionic_radius": "r", "prom_atomic_mass": "m", "prom_first_ionization": "f", D.TARGET: "med",
        "Catalyst_Label_Ni_Value": "CASE WHEN lab > 0 AND lab <= 80 THEN lab END", "Replicate_Target_Range": "CASE WHEN n > 1 THEN rng ELSE 0.0 END",
    }
    return (
        _curated() + "SELECT row_number() OVER (ORDER BY raw_row_id) - 1 AS row_id, raw_row_id, Support, Promoter_Metal, Metal_Loading_Method, Precursor_Family, Support_Prep_Method, coalesce(s.support_type, 'unknown') AS support_type, "
        "(Promoter_Metal IS NOT NULL)::INT AS has_promoter, (e IS NULL)::INT AS prom_missing, coalesce(red, 0) AS support_reducible, coalesce(acid, 0) AS support_acid_base, Catalyst_Key, n::INT AS Replicate_Count, CASE WHEN n > 1 THEN ids END AS Original_Row_IDs, "
        + ", ".join(f"{r6(f'({v})::DOUBLE')} AS {col(c)}" for c, v in num.items())
        + " FROM grp JOIN prim ON first_id = raw_row_id AND NOT clash LEFT JOIN sdim s ON Support = s.name LEFT JOIN pdim ON string_split(Promoter_Metal, ',')[1] = symbol"
    )


def _curated_table(primary: bool) -> str:
    """All columns of the primary or the comparison table."""
    whole = ["raw_row_id", *(f"t.{c}" for c in D.TEXT_COLUMNS), *(f"{parse_bool(c)} AS {c}" for c in D.FLAG_COLUMNS if c != "is_literature_comparison"), "is_literature_comparison", *(col(c + "_range_flag") for c in D.VALID_RANGES)]
    derived = {
        "Catalyst_Label_Ni_Value": "CASE WHEN lab > 0 AND lab <= 80 THEN lab END", "GHSV_log": "ln(1 + GHSV_mL_g_h)", "WHSV_log": "ln(1 + WHSV_h_inv)", "calc_reduc_temp_diff": "Calcination_Temp_C - Reduction_Temp_C",
        "total_treatment_time_h": "CASE WHEN coalesce(Calcination_Time_h, Reduction_Time_h, Dry_Time_h) IS NOT NULL THEN coalesce(Calcination_Time_h, 0) + coalesce(Reduction_Time_h, 0) + coalesce(Dry_Time_h, 0) END",
        "prom_electronegativity": "e", "prom_ionic_radius": "r", "prom_atomic_mass": "m", "prom_first_ionization": "f",
    }
    num = {c: "med" if primary and c == D.TARGET else col(c) for c in D.VALID_RANGES} | derived | ({"Replicate_Target_Range": "CASE WHEN n > 1 THEN rng ELSE 0.0 END"} if primary else {})
    more = ["(t.Promoter_Metal IS NOT NULL)::INT AS has_promoter", "(e IS NULL)::INT AS prom_missing", "coalesce(s.support_type, 'unknown') AS support_type", "coalesce(acid, 0) AS support_acid_base", "coalesce(red, 0) AS support_reducible"]
    if primary:
        more += ["row_number() OVER (ORDER BY raw_row_id) - 1 AS row_id", "Catalyst_Key", "n::INT AS Replicate_Count", "CASE WHEN n > 1 THEN ids END AS Original_Row_IDs"]
    extras = [f"extra_{i:02d}" for i in range(1, 29)]
    raw = "(SELECT raw_row_id, " + ", ".join(f"CASE WHEN {c} NOT IN {words(D.NA_TOKENS)} THEN {c} END AS {c}" for c in extras) + " FROM dataset_all) x"
    rows = "grp JOIN prim t ON first_id = raw_row_id AND NOT clash" if primary else "(SELECT * FROM reasons WHERE reason IS NULL AND is_literature_comparison) t"
    return (
        _curated() + "SELECT " + ", ".join([*whole, *extras, *(f"{r6(f'({v})::DOUBLE')} AS {col(c)}" for c, v in num.items()), *more])
        + f" FROM {rows} JOIN {raw} USING (raw_row_id) LEFT JOIN sdim s ON t.Support = s.name LEFT JOIN pdim ON string_split(t.Promoter_Metal, ',')[1] = symbol"
    )


def oracle_sql() -> dict[str, str]:
    fam = "SELECT coalesce(Support, 'Unknown') AS Support, coalesce(Promoter_Metal, 'Unknown') AS p, coalesce(Metal_Loading_Method, 'Unknown') AS m, count(*) AS n FROM ni_model_primary GROUP BY ALL"
    onehot = " UNION ALL ".join(
        f"SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY v) >= 20 THEN 'cat__{c}_' || v ELSE 'cat__{c}_infrequent' END AS feature FROM (SELECT row_id, coalesce({c}, 'Unknown') AS v FROM ni_model_primary)"
        for c in ("support_type", "Precursor_Family")
    )
    mode_b = "(SELECT b FROM (SELECT CASE WHEN row_id % 7 <> 0 THEN has_promoter END AS b FROM ni_model_primary) WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1)"
    mode_r = "(SELECT support_reducible FROM ni_model_primary WHERE support_reducible IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    guarded_lines = f"SELECT l_partkey, l_suppkey, line_id, {guard('l_quantity', (1.0, 48.0))} AS l_quantity FROM ({_LINES})"
    return {
        "p1_found": f"SELECT raw_row_id, unnest(generate_series(1, len(v)))::INT AS pos, unnest(v) AS promoter FROM ({_PACKED}) WHERE len(v) >= 2",
        "range_flag": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 1 ELSE 0 END::INT AS quantity_flag, CASE WHEN l_discount NOT BETWEEN 0 AND 0.08::DOUBLE THEN 1 ELSE 0 END::INT AS discount_flag FROM lineitem",
        "range_null": f"SELECT event_id, {guard('value', (10.0, 400.0))} AS value FROM events",
        "lenient_cast": "SELECT raw_row_id, " + ", ".join(f"{r6(col(c))} AS {col(c)}" for c in D.VALID_RANGES) + f" FROM ({_PARSED})",
        "guarded_measures": "SELECT raw_row_id, " + ", ".join(f"{r6(guard(col(c), r))} AS {col(c)}, CASE WHEN {col(c)} NOT BETWEEN {r[0]} AND {r[1]} THEN 1 ELSE 0 END::INT AS {col(c + '_range_flag')}" for c, r in D.VALID_RANGES.items()) + f" FROM ({_PARSED})",
        "bool_parse": "SELECT raw_row_id, " + ", ".join(f"{parse_bool(c)} AS {c}" for c in D.FLAG_COLUMNS) + f", coalesce({parse_bool('is_literature_comparison')}, FALSE) AS comparison FROM dataset_all",
        "regex_extract_num": f"SELECT raw_row_id, CASE WHEN x > 0 AND x <= 80 THEN x END AS label_value, t AS trailing_value FROM (SELECT raw_row_id, TRY_CAST(CASE WHEN regexp_matches(Catalyst, '{_P1}', 'i') THEN regexp_extract(Catalyst, '{_P1}', 1, 'i') WHEN regexp_matches(Catalyst, '{_P2}', 'i') THEN regexp_extract(Catalyst, '{_P2}', 1, 'i') END AS DOUBLE) AS x, TRY_CAST(nullif(regexp_extract(Catalyst, '\\((\\d+(?:\\.\\d+)?)\\)\\s*$', 1), '') AS DOUBLE) AS t FROM dataset_all)",
        "first_match_class": f"SELECT raw_row_id, {_support('c')} AS support_class, {_method()} AS method_class FROM (SELECT *, coalesce(Support_Normalized, Support) AS c FROM dataset_all)",
        "token_list_norm": f"SELECT raw_row_id, promoters, string_split(promoters, ',')[1] AS first_promoter, (promoters IS NOT NULL)::INT AS has_promoter FROM ({_TOKENS})",
        "recode_default": f"SELECT raw_row_id, CASE lower(p) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in D.PRECURSOR_NAMES.items())} ELSE lower(p) END AS precursor, prep FROM (SELECT raw_row_id, {default_text('Precursor_Family')} AS p, {default_text('Support_Prep_Method')} AS prep FROM dataset_all)",
        "log1p_diff_rowsum": f"SELECT row_id, {r6('ln(1 + GHSV_mL_g_h)')} AS ghsv_log, {r6('ln(1 + WHSV_h_inv)')} AS whsv_log, {r6('Calcination_Temp_C - Reduction_Temp_C')} AS temp_diff, {r6('CASE WHEN coalesce(Calcination_Time_h, Reduction_Time_h, Dry_Time_h) IS NOT NULL THEN coalesce(Calcination_Time_h, 0) + coalesce(Reduction_Time_h, 0) + coalesce(Dry_Time_h, 0) END')} AS treatment_h FROM ni_model_primary",
        "row_null_count": "SELECT row_id, m::INT AS n_missing, m > 2 AS excessive, (Promoter_Metal IS NOT NULL)::INT AS has_promoter FROM (SELECT *, " + " + ".join(f"({col(c)} IS NULL)::INT" for c in D.CORE_SYNTHESIS) + " AS m FROM ni_model_primary)",
        "key_normalise": f"SELECT raw_row_id, lower({strip('coalesce(Catalyst, Canonical_Catalyst_ID, ' + chr(39) + 'Unknown' + chr(39) + ')')}) AS catalyst_key, concat_ws(' | ', Support, Metal_Loading_Method) AS family FROM dataset_all",
        "score_penalty": f"SELECT row_id, {r6(f'least(greatest({_CONV}, 0.0), 100.0)')} AS clipped, round_even(Reaction_Temp_C / 10, 0)::BIGINT AS index, {_near(col('Ni_Loading_wt%'), 0.01, 80.0)} OR {_near('Calcination_Temp_C', 100.0, 900.0)} AS near_bound, {r6(f'{_CONV} - CASE WHEN coalesce(Reaction_Temp_C <= 500, FALSE) THEN 0 ELSE 100 END - CASE WHEN {_CONV} < 0 OR {_CONV} > 100 THEN 200 ELSE 0 END')} AS score FROM ni_model_primary",
        "pretty_labels": _labels(),
        "json_field": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"t\":\"' || event_type || '\",\"u\":' || user_id || '}' AS doc FROM events",
        "token_boundary_filter": f"SELECT raw_row_id, active_ni, label_ni, simple_ni FROM ({_NI_FLAGS}) WHERE active_ni OR label_ni",
        "compound_identity": f"SELECT raw_row_id, active_ni AND (simple_ni OR label_ni) AND (NOT starts_with(coalesce(Source_File, ''), 'REVW') OR label_ni) AS is_ni_row FROM ({_NI_FLAGS})",
        "route_two_way": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') THEN 'urgent' ELSE 'rest' END AS branch FROM orders",
        "exclusion_log": f"SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, Catalyst, \"Reason\" FROM (SELECT *, CASE WHEN \"MeOH_Conversion_%\" IS NULL OR Reaction_Temp_C IS NULL THEN 'missing_or_invalid_target_or_reaction_temperature' WHEN " + " + ".join(f"({col(c)} IS NULL)::INT" for c in D.CORE_SYNTHESIS) + f" > 2 THEN 'more_than_two_core_synthesis_fields_missing' END AS \"Reason\" FROM ({_GUARDED})) WHERE \"Reason\" IS NOT NULL",
        "guard_counts": f"SELECT count(*) AS n_rows, count(DISTINCT Source_File) AS n_sources, sum(({parse_bool('is_literature_comparison')} IS NULL)::INT)::BIGINT AS n_shifted, sum({not_given('Promoter_Metal')}::INT)::BIGINT AS n_unpromoted, (SELECT count(*) - 1 FROM (DESCRIBE dataset_all))::BIGINT AS n_columns FROM dataset_all",
        "dim_lookup_default": "SELECT row_id, coalesce(s.support_type, 'unknown') AS support_type, coalesce(s.acid_base, 0) AS acid_base, coalesce(s.reducible, 0) AS reducible, electronegativity, ionic_radius, (electronegativity IS NULL)::INT AS prom_missing FROM ni_model_primary n LEFT JOIN support_dim s ON n.Support = s.name LEFT JOIN promoter_dim p ON string_split(n.Promoter_Metal, ',')[1] = p.symbol",
        "left_one_to_one": 'SELECT n.row_id, n.Catalyst, m."Set" FROM ni_model_primary n LEFT JOIN split_manifest m USING (row_id)',
        "key_coverage": "SELECT DISTINCT raw_row_id, 'left' AS side FROM ni_model_primary WHERE raw_row_id NOT IN (SELECT raw_row_id FROM exclusion_log) UNION ALL SELECT DISTINCT raw_row_id, 'right' FROM exclusion_log WHERE raw_row_id NOT IN (SELECT raw_row_id FROM ni_model_primary)",
        "semi_anti": "SELECT raw_row_id, raw_row_id IN (SELECT raw_row_id FROM ni_model_primary) AS kept FROM dataset_all",
        "cross_params": "SELECT r_regionkey, t::DOUBLE AS temperature FROM region CROSS JOIN (VALUES (300.0), (350.0), (400.0), (450.0), (500.0)) v(t)",
        "knn_mean_distance": f"SELECT query_id, round(mean_distance, 5) AS mean_distance FROM ({_KNN})",
        "domain_threshold": f"SELECT round(quantile_cont(mean_distance, 0.95), 5) AS threshold FROM ({_KNN})",
        "domain_membership": f"WITH k AS ({_KNN}) SELECT query_id, mean_distance <= (SELECT quantile_cont(mean_distance, 0.95) FROM k) AS within FROM k",
        "unique_propagation": f"WITH p AS ({_PARSED}), a AS (SELECT raw_row_id, Source_File, Canonical_Catalyst_ID, coalesce(Reaction_Temp_C, CASE WHEN min(Reaction_Temp_C) OVER w = max(Reaction_Temp_C) OVER w THEN min(Reaction_Temp_C) OVER w END) AS t FROM p WINDOW w AS (PARTITION BY Source_File, Canonical_Catalyst_ID)) SELECT raw_row_id, {r6('coalesce(t, CASE WHEN min(t) OVER w = max(t) OVER w THEN min(t) OVER w END)')} AS temperature FROM a WINDOW w AS (PARTITION BY Source_File)",
        "collision_resolve": f"SELECT first_id AS line_id, l_partkey, l_suppkey, {r6('med')} AS l_quantity, n::INT AS Replicate_Count, {r6('rng')} AS Replicate_Target_Range, CASE WHEN n > 1 THEN ids END AS Original_Row_IDs FROM ({_GROUPS}) WHERE n = 1 OR rng <= 5",
        "collision_audit": f"SELECT line_id, {r6('rng')} AS Collision_Target_Range FROM ({_LINES}) JOIN ({_GROUPS}) USING (l_partkey, l_suppkey) WHERE n > 1 AND rng > 5",
        "primary_collisions": "SELECT min(row_id) AS first_id, count(*)::INT AS n, " + r6('max("MeOH_Conversion_%") - min("MeOH_Conversion_%")') + " AS target_range, " + r6('median("MeOH_Conversion_%")') + ' AS median, count(*) > 1 AND max("MeOH_Conversion_%") - min("MeOH_Conversion_%") > 5 AS clash FROM ni_model_primary GROUP BY ' + ", ".join(col(c) for c in D.COLLISION_KEY),
        "group_median_quantile": f"SELECT p_brand, {r6('median(p_retailprice)')} AS median_price, {r6('quantile_cont(p_retailprice, 0.01)')} AS q01, {r6('quantile_cont(p_retailprice, 0.95)')} AS q95, {r6('quantile_cont(p_retailprice, 0.99)')} AS q99, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand",
        "seed_summary": " UNION ALL ".join(f"SELECT '{c}' AS \"Metric\", round(avg({c}), 4) AS \"Mean\", round(stddev_samp({c}), 4) AS \"SD\", round(median({c}), 4) AS \"Median\", round(min({c}), 4) AS \"Min\", round(max({c}), 4) AS \"Max\" FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
        "mode_lowest_tie": f"WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand, p_size FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1) SELECT p.p_brand, any_value(m.p_size) AS mode_size, {r6('coalesce(median(CASE WHEN p.p_size > 49 THEN p_retailprice END), 0)')} AS median_or_zero FROM part p JOIN m USING (p_brand) GROUP BY p.p_brand",
        "summary_rate": f"SELECT l_returnflag, {r6('max(l_extendedprice)')} AS best, {r6('median(l_extendedprice)')} AS median, count(*) AS n, {r6('avg(CASE WHEN l_discount > 0.05::DOUBLE THEN 1.0 ELSE 0.0 END)')} AS rate FROM lineitem GROUP BY 1",
        "family_frequency": f"SELECT Support, CASE WHEN lower(p) = 'unknown' THEN 'unpromoted' ELSE 'promoted' END AS \"Track\", sum(n)::BIGINT AS n, string_agg(DISTINCT m, ', ' ORDER BY m) AS methods, max(n) AS largest FROM ({fam}) GROUP BY 1, 2",
        "adaptive_bounds": " UNION ALL ".join(_bounds(c) for c in D.SEARCH_COLUMNS),
        "regression_metrics": f"SELECT l_returnflag, count(*) AS n, {r6('1 - sum(e * e) / (var_pop(y) * count(*))')} AS R2, round(avg(abs(e)), 3) AS MAE, round(sqrt(sum(e * e) / count(*)), 3) AS RMSE FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1500.0::DOUBLE AS e FROM lineitem) GROUP BY 1",
        "residuals": "SELECT l_orderkey, l_linenumber, round(e, 4) AS residual, round(abs(e), 4) AS abs_residual FROM (SELECT *, l_quantity * 1500.0::DOUBLE - l_extendedprice AS e FROM lineitem)",
        "value_counts": "SELECT Support_Normalized, count(*) AS n FROM dataset_all GROUP BY 1",
        "rank_min": "SELECT c_custkey, round(c_acctbal, -1) + 0.0::DOUBLE AS balance, rank() OVER (ORDER BY round(c_acctbal, -1) DESC) AS rank FROM customer",
        "rownum_topk_group": "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 10",
        "global_top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
        "nlargest_fallback": "WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) (SELECT *, 'fallback' AS \"case\" FROM n ORDER BY n DESC, p_brand, p_type LIMIT 5) UNION ALL (SELECT *, 'enough' FROM (SELECT * FROM n WHERE n >= 10 UNION ALL (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n WHERE n >= 10) ORDER BY n DESC, p_brand, p_type LIMIT 5)))",
        "window_select": "WITH c AS (SELECT c_mktsegment AS \"Candidate\", round(avg(c_acctbal) / 5000, 6) AS CV_R2_Mean, round(stddev_samp(c_acctbal) / 30000, 6) AS CV_R2_SD, round(abs(max(c_acctbal) + min(c_acctbal) - 2 * avg(c_acctbal)) / 30000, 6) AS CV_Gap_Mean, length(c_mktsegment)::INT AS Complexity_Rank FROM customer GROUP BY c_mktsegment) SELECT * FROM c WHERE CV_R2_Mean >= (SELECT max(CV_R2_Mean) FROM c) - 0.2 ORDER BY CV_Gap_Mean, CV_R2_SD, Complexity_Rank, CV_R2_Mean DESC, \"Candidate\" LIMIT 1",
        "running_best": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM events",
        "union_by_name": "SELECT c_custkey AS key, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier",
        "long_form_topn": "WITH l AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings), t AS (SELECT component FROM l GROUP BY 1 ORDER BY round(avg(abs(value::DOUBLE)), 6) DESC, component LIMIT 10) SELECT vec_id, component::INT AS component, round(value::DOUBLE, 5) AS value FROM l JOIN t USING (component)",
        "wide_columns": "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 5) AS v{i}" for i in range(64)) + " FROM embeddings",
        "strata_rare": f"SELECT row_id, Source_Stratum FROM ({_STRATA})",
        "largest_remainder": f"{_QUOTA} SELECT Source_Stratum, n, quota FROM quota",
        "stratified_split": f"{_QUOTA} {_split(42)}",
        "repeated_splits": f"{_QUOTA} " + " UNION ALL ".join(f"SELECT {s}::INT AS Split_Seed, Source_Stratum, sum((\"Set\" = 'Test')::INT)::BIGINT AS n_test, sum(CASE WHEN \"Set\" = 'Test' THEN row_id END)::BIGINT AS test_ids FROM ({_split(s)}) GROUP BY ALL" for s in (42, 43, 44)),
        "kfold_assign": "SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders",
        "learning_subsets": "SELECT o_orderkey, (CASE " + " ".join(f"WHEN pos < floor(n * {p} + 1e-9) THEN {p}" for p in (0.2, 0.35, 0.5, 0.7, 0.85, 1.0)) + " END)::DOUBLE AS smallest_share FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)",
        "median_impute_scale": "SELECT row_id, " + ", ".join(f"{_scaled(c, False)} AS z{i}" for i, c in enumerate(["Ni_Loading_wt%", "Calcination_Temp_C", "GHSV_log", "prom_ionic_radius"])) + " FROM ni_model_primary",
        "robust_scale": "SELECT row_id, " + ", ".join(f"{_scaled(c, True)} AS z{i}" for i, c in enumerate(["Reaction_Temp_C", "S_C_Ratio", "TOS_h"])) + " FROM ni_model_primary",
        "onehot_minfreq": onehot,
        "binary_mode_impute": f"SELECT row_id, coalesce(CASE WHEN row_id % 7 <> 0 THEN has_promoter END, {mode_b})::DOUBLE AS b0, coalesce(support_reducible, {mode_r})::DOUBLE AS b1 FROM ni_model_primary",
        "curate_exclusions": _curated() + "SELECT * FROM excl",
        "curate_accounting": _curated() + "SELECT \"Reason\" AS outcome, count(*) AS n FROM excl GROUP BY 1 UNION ALL SELECT 'comparison', count(*) FROM reasons WHERE reason IS NULL AND is_literature_comparison UNION ALL SELECT 'primary', coalesce(sum(n), 0)::BIGINT FROM grp WHERE NOT clash",
        "curate_features": _curated_features(),
        "curate_primary": _curated_table(True),
        "curate_comparison": _curated_table(False),
        "curate_counts": _curated() + "SELECT 'raw' AS stage, count(*) AS n FROM dataset_all UNION ALL SELECT 'all_clean', count(*) FROM reasons WHERE reason IS NULL UNION ALL SELECT 'comparison', count(*) FROM reasons WHERE reason IS NULL AND is_literature_comparison "
        "UNION ALL SELECT 'primary', count(*) FROM grp WHERE NOT clash UNION ALL SELECT 'collisions', coalesce(sum(n), 0)::BIGINT FROM grp WHERE clash UNION ALL SELECT 'exclusions', count(*) FROM excl",
        "csv_roundtrip": "SELECT raw_row_id, " + ", ".join(f"CASE WHEN {col(c)} NOT IN {words(D.NA_TOKENS)} THEN {col(c)} END AS {col(c)}" for c in (*D.TEXT_COLUMNS, *D.FLAG_COLUMNS, *D.VALID_RANGES)) + " FROM dataset_all",
        "json_roundtrip": "SELECT count(*) AS n_rows, count(DISTINCT Source_File) AS n_sources, max(Reaction_Temp_C) AS hottest, max(Promoter_Metal) AS last_promoter FROM ni_model_primary",
        "report_roundtrip": "SELECT '# Splits' AS line UNION ALL SELECT '' UNION ALL SELECT '- ' || \"Set\" || ': ' || count(*) FROM split_manifest GROUP BY \"Set\"",
        "vector_roundtrip": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS component, round(unnest(embedding)::DOUBLE, 5) + 0.0 AS value FROM embeddings",
        "gated_promotion": "SELECT r_regionkey, r_name, 'nation' AS refused FROM region",
        "eligible_families": f"WITH c AS (SELECT Support, p AS \"Promoter_Key\", m AS Metal_Loading_Method, n AS \"Dataset_Count\", Support || ' | ' || p || ' | ' || m AS \"Family\", CASE WHEN lower(p) = 'unknown' THEN 'unpromoted' ELSE 'promoted' END AS \"Track\" FROM ({fam})), r AS (SELECT *, max(\"Dataset_Count\") OVER (PARTITION BY \"Track\") AS top, row_number() OVER (PARTITION BY \"Track\" ORDER BY \"Dataset_Count\" DESC, \"Family\") AS rn FROM c) SELECT Support, \"Promoter_Key\", Metal_Loading_Method, \"Dataset_Count\", \"Family\", \"Track\" FROM r WHERE \"Dataset_Count\" >= 10 OR (top < 10 AND rn <= 5)",
        "operating_assumptions": "SELECT " + ", ".join(f"coalesce(median({c}), {v})::DOUBLE AS {c}" for c, v in (("S_C_Ratio", 2.0), ("TOS_h", 10.0), ("Pressure_bar", 1.0), ("GHSV_log", 0.0), ("WHSV_log", 0.0))) + ", " + ", ".join(f"coalesce((SELECT {c} FROM ni_model_primary WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'Unknown') AS {c}" for c in ("Precursor_Family", "Support_Prep_Method")) + " FROM ni_model_primary",
        "flagship_slice": f"WITH g AS ({guarded_lines}), v AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY l_suppkey) >= 4 THEN l_suppkey::VARCHAR ELSE 'rare' END AS stratum FROM g WHERE l_quantity IS NOT NULL), k AS (SELECT l_partkey, l_suppkey, min(line_id) AS line_id, any_value(stratum) AS stratum, median(l_quantity) AS l_quantity, count(*)::INT AS Replicate_Count FROM v GROUP BY l_partkey, l_suppkey HAVING count(*) = 1 OR max(l_quantity) - min(l_quantity) <= 5) SELECT stratum, line_id, l_quantity, Replicate_Count, row_number() OVER (PARTITION BY stratum ORDER BY l_quantity DESC, line_id)::INT AS rank FROM k QUALIFY rank <= 10",
    }
