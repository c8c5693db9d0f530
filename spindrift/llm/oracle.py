"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from spindrift.llm import canon
from spindrift.oracle import col, packed_values


def bare(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def bare_decimal(c: str) -> str:
    s = rf"regexp_replace(lower({c}), '[\s\p{{Z}}\x{{200b}}\x{{feff}}]+', '', 'g')"
    for _ in range(2):  # 1.2.3: matches cannot overlap
        s = rf"regexp_replace({s}, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g')"
    return rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}\x{{e000}}]+', '', 'g')"


_IGNORED = ("raw_row_id", "extra_01", "Source_File", "Catalyst", "Promoter_Metal")
_KEPT = [c for c in (
    "Canonical_Catalyst_ID", "Active_Metal", "Support", "Support_Normalized", "Metal_Loading_Method", "Precursor_Family", "Support_Prep_Method",
    "is_approximate_value", "is_range_like_value", "is_literature_comparison", "Ni_Loading_wt%", "Promoter_Loading_wt%", "Calcination_Temp_C", "Calcination_Time_h",
    "Reduction_Temp_C", "Reduction_Time_h", "Dry_Temp_C", "Dry_Time_h", "Reaction_Temp_C", "MeOH_Conversion_%", "S_C_Ratio", "TOS_h", "Pressure_bar", "GHSV_mL_g_h", "WHSV_h_inv",
    *(f"extra_{i:02d}" for i in range(2, 29)),
) if c not in _IGNORED]
_LIST_KEY = f"array_to_string(list_sort(list_filter(list_transform({packed_values('Promoter_Metal')}, lambda v: {bare('v')}), lambda v: v <> '')), '')"
_GROUPS = (
    f"SELECT raw_row_id, min(raw_row_id) OVER (PARTITION BY s, c, p, {', '.join(col(c) for c in _KEPT)}) AS keep_id FROM "
    f"(SELECT *, {bare('Source_File')} AS s, {bare_decimal('Catalyst')} AS c, CASE WHEN Promoter_Metal IS NOT NULL THEN {_LIST_KEY} END AS p FROM dataset_all)"
)
_WORDS = "regexp_extract_all(lower(Catalyst), '[a-z]+')"
_ROWS = f"SELECT n.row_id, {bare('n.Source_File')} AS s, {bare_decimal('n.Catalyst')} AS c, {_WORDS.replace('Catalyst', 'n.Catalyst')} AS w, n.Reaction_Temp_C AS t, m.\"Set\" AS split FROM ni_model_primary n JOIN split_manifest m USING (row_id)"
#: One word of six or more letters differs by one edit, everything else is equal.
_NEAR = (
    "damerau_levenshtein(a.c, b.c) = 1 AND regexp_replace(a.c, '[a-z]+', 'x', 'g') = regexp_replace(b.c, '[a-z]+', 'x', 'g') AND len(a.w) = len(b.w) AND "
    "len(list_filter(generate_series(1, len(a.w)), lambda i: a.w[i] <> b.w[i])) = 1 AND len(list_filter(generate_series(1, len(a.w)), lambda i: a.w[i] <> b.w[i] AND "
    "greatest(length(a.w[i]), length(b.w[i])) >= 6)) = 1"
)
_PAIRS = f"WITH r AS ({_ROWS}) SELECT a.row_id AS x, b.row_id AS y, b.split, b.s FROM r a JOIN r b ON a.s = b.s AND a.split = 'Train' AND b.split <> 'Train' AND abs(a.t - b.t) <= 2 + 1e-9 AND (a.c = b.c OR ({_NEAR}))"
_LINKS = (
    f"WITH RECURSIVE n AS (SELECT DISTINCT {bare('Source_File')} AS s, CASE WHEN regexp_matches(Canonical_Catalyst_ID, '[0-9]') THEN {bare('Canonical_Catalyst_ID')} END AS i FROM ni_model_primary), "
    "l AS (SELECT DISTINCT a.s AS a, b.s AS b FROM n a JOIN n b ON a.i = b.i AND a.s <> b.s AND a.s <> '' AND b.s <> ''), "
    "reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a) "
)

_GROUP_OF = (
    _LINKS + ", g AS (SELECT s AS source, least(s, min(b)) AS representative, count(b) FILTER (b <> s) + 1 AS n_sources "
    "FROM (SELECT DISTINCT s FROM n WHERE s <> '') LEFT JOIN reach ON a = s GROUP BY s) SELECT source, coalesce(representative, source) AS representative, n_sources FROM g"
)
#: Greedy largest first, one group at a time: groups of rows linked by source or id, then the split furthest below its target.
_SHARES = f"""
WITH RECURSIVE k AS (SELECT row_id, CASE WHEN {bare('Source_File')} <> '' THEN {bare('Source_File')} END AS s, CASE WHEN regexp_matches(Canonical_Catalyst_ID, '[0-9]') THEN {bare('Canonical_Catalyst_ID')} END AS i FROM ni_model_primary),
e AS (SELECT DISTINCT 's' || s AS a, 'i' || i AS b FROM k WHERE s IS NOT NULL AND i IS NOT NULL), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
root AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
size AS (SELECT coalesce(root, node) AS root, count(*) AS n FROM (SELECT coalesce('s' || s, 'i' || i, 'r' || row_id) AS node FROM k) LEFT JOIN root USING (node) GROUP BY 1),
ordered AS (SELECT n, row_number() OVER (ORDER BY n DESC, root) AS pos FROM size),
t AS (SELECT split_name, target_share, row_number() OVER (ORDER BY target_share DESC, split_name) AS j, target_share / sum(target_share) OVER () * (SELECT count(*) FROM k) AS want FROM split_targets),
step AS (SELECT 0::BIGINT AS pos, (SELECT list(want ORDER BY j) FROM t) AS lack UNION ALL
  SELECT o.pos, list_transform(lack, lambda x, j: CASE WHEN j = list_position(lack, list_max(lack)) THEN x - o.n ELSE x END) FROM step s JOIN ordered o ON o.pos = s.pos + 1),
final AS (SELECT lack FROM step ORDER BY pos DESC LIMIT 1)
SELECT split_name AS split, target_share, round(want - lack[j])::BIGINT AS n_records, round(CASE WHEN (SELECT count(*) FROM k) > 0 THEN round(want - lack[j]) / (SELECT count(*) FROM k) ELSE 0 END, 6) AS actual_share FROM t, final
"""
#: Hazards of lengths against those of the 30 neighbours on each side, every length counted whether texts end there or not.
_LIMITS = """
WITH d AS (SELECT source AS src, length(text) AS c, strlen(text) AS o FROM documents WHERE trim(text, ' ') <> ''),
u AS (SELECT src, 'chars' AS unit, c AS len FROM d UNION ALL SELECT src, 'bytes', o FROM d UNION ALL SELECT src, 'band', ceil(c / 16)::INT FROM d),
n AS (SELECT src, unit, len, count(*) AS n FROM u GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (w RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk, sum(n) OVER (w RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS inside,
  sum(n * len) OVER (w RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS mass, coalesce(sum(n) OVER (w RANGE BETWEEN 31 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS longer, greatest(len - 30, 1) AS lo
  FROM n WINDOW w AS (PARTITION BY src, unit ORDER BY len)),
h AS (SELECT *, n / at_risk AS hazard, (inside - n + 0.5::DOUBLE) / greatest(mass - inside * (lo - 1) + longer * (len + 30 - lo + 1) - at_risk, 1) AS expected FROM r),
p AS (SELECT *, CASE WHEN n > expected * at_risk THEN -(n * ln(n / (expected * at_risk)) - n + expected * at_risk) ELSE 0.0::DOUBLE END AS log_p FROM h),
b AS (SELECT *, log_p <= ln(0.01::DOUBLE) + ln(rank() OVER (PARTITION BY src, unit ORDER BY log_p) / (count(*) OVER (PARTITION BY src, unit))) AS ok FROM p),
c AS (SELECT *, max(log_p) FILTER (ok) OVER (PARTITION BY src, unit) AS edge FROM b)
SELECT src AS source, unit, len::INT AS len, n, at_risk::BIGINT AS at_risk, round(hazard, 6) AS hazard, round(expected, 6) AS expected FROM c WHERE log_p <= edge AND n >= 4
"""

_FROM, _TO = ("".join(x[i] for x in canon.LOOKALIKE.values()) for i in (0, 1))
_FOLDED = f"translate(lower(regexp_replace(cell, '<[^<>]*>', '', 'g')), '{_FROM}', '{_TO}')"
_L = r"^\p{L}+$"
#: Every token of every distinct cell against every word of the list, by edit distance, and every form scored: no pruning.
_MAPPED = rf"""
WITH c AS (SELECT DISTINCT field_name, trim(name, ' ') AS name, canon_id FROM (SELECT *, unnest([canonical] || string_split(coalesce(alt_names, ''), ';')) AS name FROM canonical_values) WHERE trim(name, ' ') <> ''),
named AS (SELECT *, regexp_extract_all(fold, '[\p{{L}}\p{{N}}]+') AS ws FROM (SELECT *, {_FOLDED.replace('cell', 'name')} AS fold FROM c)),
nn AS (SELECT field_name, count(DISTINCT name) AS n FROM named WHERE len(ws) > 0 GROUP BY 1),
w0 AS (SELECT field_name, canon_id, name, ws, unnest(list_distinct(ws)) AS v FROM named),
kk AS (SELECT field_name, v, count(*) AS k FROM w0 GROUP BY ALL),
w AS (SELECT w0.*, ln(1 + n / k) AS wt, ln(1 + n) AS unseen FROM w0 JOIN kk USING (field_name, v) JOIN nn USING (field_name)),
nm AS (SELECT field_name, canon_id, name, sqrt(sum(wt * wt)) AS norm, count(*) AS size, bool_and(length(v) >= 2 AND regexp_matches(v, '\p{{L}}')) AS plain, any_value(ws) AS ws, any_value(unseen) AS unseen FROM w GROUP BY ALL),
forms AS (SELECT field_name, canon_id, 'b' || name AS form, v, wt, norm, unseen, FALSE AS alone, TRUE AS word, 0 AS own FROM w JOIN nm USING (field_name, canon_id, name, unseen) WHERE plain AND size > 1
  UNION ALL SELECT field_name, canon_id, 'w' || name, array_to_string(ws, ''), norm, norm, unseen, TRUE, len(ws) = 1, len(ws) FROM nm),
vocab AS (SELECT field_name, v, bool_and(alone) AS alone, bool_or(word) AS word FROM forms GROUP BY ALL),
cells0 AS (SELECT raw_row_id, unnest([{{'f': 'Support', 'c': Support}}, {{'f': 'Metal_Loading_Method', 'c': Metal_Loading_Method}}, {{'f': 'Precursor_Family', 'c': Precursor_Family}}]) AS x FROM dataset_all),
cells AS (SELECT raw_row_id, x.f AS field_name, x.c AS cell FROM cells0 WHERE x.c IS NOT NULL AND lower(regexp_replace(x.c, '^[\s\p{{Z}}\x{{200b}}\x{{feff}}]+|[\s\p{{Z}}\x{{200b}}\x{{feff}}]+$', '', 'g')) NOT IN ('', 'na', 'n/a', 'none', 'nan', 'null')),
todo AS (SELECT * FROM cells ANTI JOIN canonical_values k ON k.field_name = cells.field_name AND k.canonical = cells.cell),
d AS (SELECT field_name, cell, regexp_extract_all(fold, '[\p{{L}}\p{{N}}]+') AS ws, regexp_extract_all(fold, '(\p{{L}}{{3,}})\.', 1) AS sw FROM (SELECT DISTINCT field_name, cell, {_FOLDED} AS fold FROM todo)),
t AS (SELECT DISTINCT field_name, cell, t, list_contains(sw, t) AS short FROM (SELECT field_name, cell, sw, unnest(flatten(list_transform(range(1, len(ws) + 1), lambda i: list_transform(range(i, least(i + 8, len(ws) + 1)), lambda j: array_to_string(ws[i:j], ''))))) AS t FROM d)),
hit AS (SELECT field_name, cell, v, max(sim) AS sim FROM (SELECT t.field_name, cell, v, CASE WHEN t = v THEN 1.0::DOUBLE WHEN translate(t, '01i|', 'olll') = translate(v, '01i|', 'olll') THEN 0.98
  WHEN length(v) >= CASE WHEN alone THEN 5 ELSE 4 END AND regexp_matches(t, '{_L}') AND regexp_matches(v, '{_L}') AND abs(length(t) - length(v)) <= 1 AND damerau_levenshtein(t, v) <= 1 THEN 1 - 1 / length(v)
  WHEN short AND word AND length(v) >= 5 AND length(t) < length(v) AND regexp_matches(v, '{_L}') AND starts_with(v, t) THEN 0.85 END AS sim FROM t JOIN vocab ON t.field_name = vocab.field_name) WHERE sim IS NOT NULL GROUP BY ALL),
sc AS (SELECT f.field_name, d.cell, canon_id, sum(wt * wt * coalesce(sim, 0)) AS dot, sum(wt * wt) FILTER (sim IS NOT NULL) AS held, count(sim) AS n, any_value(norm) AS norm, any_value(alone) AS alone, any_value(own) AS own, any_value(unseen) AS unseen, len(list_distinct(any_value(d.ws))) AS nw
  FROM d JOIN forms f ON f.field_name = d.field_name LEFT JOIN hit ON hit.field_name = d.field_name AND hit.cell = d.cell AND hit.v = f.v GROUP BY f.field_name, d.cell, canon_id, form),
ok AS (SELECT field_name, cell, canon_id, round(dot / (norm * sqrt(held + greatest(nw - CASE WHEN alone THEN own ELSE n END, 0) * unseen * unseen)), 9) AS score FROM sc WHERE dot / (norm * norm) >= 0.8 - 1e-9),
best AS (SELECT field_name, cell, canon_id FROM ok QUALIFY row_number() OVER (PARTITION BY field_name, cell ORDER BY score DESC, canon_id) = 1)
SELECT raw_row_id, todo.field_name, coalesce(canon_id, 0)::BIGINT AS canon_id FROM todo LEFT JOIN best ON best.field_name = todo.field_name AND best.cell = todo.cell
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _MAPPED,
        "p3_report": f"SELECT field_name, count(*) AS n_cells, count(*) FILTER (canon_id = 0) AS n_unmatched, round(avg((canon_id = 0)::INT::DOUBLE), 6) AS share_unmatched FROM ({_MAPPED}) GROUP BY 1",
        "p5_groups": _GROUP_OF,
        "p5_shares": _SHARES,
        "p8_limits": _LIMITS,
        "p2_found": f"SELECT keep_id, raw_row_id AS copy_id FROM ({_GROUPS}) WHERE raw_row_id <> keep_id",
        "p2_counts": f"SELECT keep_id AS raw_row_id, count(*) AS n_copies FROM ({_GROUPS}) GROUP BY 1",
        "p4_found": f"SELECT least(x, y) AS row_id_a, greatest(x, y) AS row_id_b FROM ({_PAIRS})",
        "p4_report": f"WITH p AS ({_PAIRS}), h AS (SELECT split, s, count(DISTINCT y) AS n_overlapping, count(*) AS n_pairs FROM p GROUP BY ALL), t AS (SELECT split, s, count(*) AS n_records FROM ({_ROWS}) WHERE split <> 'Train' GROUP BY ALL) "
        "SELECT t.split, t.s AS source, n_records, coalesce(n_overlapping, 0) AS n_overlapping, coalesce(n_pairs, 0) AS n_pairs FROM t LEFT JOIN h ON t.split = h.split AND t.s IS NOT DISTINCT FROM h.s",
        "p5_found": _LINKS + "SELECT DISTINCT a AS source_a, b AS source_b FROM reach WHERE a < b",
    }
