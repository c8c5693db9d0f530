"""Fixed values of the experimental-record domain: columns, ranges, word lists, rules.

Everything here is data that results depend on; the operators take it as parameters.
"""

from __future__ import annotations

# Inclusive valid range of each numeric column.
VALID_RANGES: dict[str, tuple[float, float]] = {
    "Ni_Loading_wt%": (0.01, 80.0),
    "Promoter_Loading_wt%": (0.0, 80.0),
    "Calcination_Temp_C": (100.0, 900.0),
    "Calcination_Time_h": (0.1, 48.0),
    "Reduction_Temp_C": (100.0, 900.0),
    "Reduction_Time_h": (0.1, 48.0),
    "Dry_Temp_C": (20.0, 200.0),
    "Dry_Time_h": (0.1, 48.0),
    "Reaction_Temp_C": (150.0, 700.0),
    "MeOH_Conversion_%": (0.0, 100.0),
    "S_C_Ratio": (0.5, 10.0),
    "TOS_h": (0.0, 500.0),
    "Pressure_bar": (0.5, 50.0),
    "GHSV_mL_g_h": (1.0, 200000.0),
    "WHSV_h_inv": (0.01, 500.0),
}
TARGET = "MeOH_Conversion_%"
EXPECTED_COLUMNS = 56
TEXT_COLUMNS = [
    "Source_File", "Canonical_Catalyst_ID", "Catalyst", "Active_Metal", "Promoter_Metal", "Support",
    "Support_Normalized", "Metal_Loading_Method", "Precursor_Family", "Support_Prep_Method",
]
FLAG_COLUMNS = ["is_approximate_value", "is_range_like_value", "is_literature_comparison"]

# Texts a CSV reader takes for null (case-sensitive), and words that mean "not given".
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NO_LABELS = ["", "nan", "none", "unknown", "n/s", "n/a", "na", "not specified"]
# List items that are no promoter.
NOT_A_PROMOTER = [*NO_LABELS, "o", "n", "c", "h", "s", "f", "p", "cl", "br", "i", "al", "ni"]
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n", "", "nan", "none"]

# Ordered rules (label, alternatives); an alternative holds if all its parts occur in
# the text in lower case. For supports the text has no white space, for methods it has.
SUPPORT_RULES = [
    ("TiO2-CeO2", ["tio2-ceo2", "tio2ceo2", "ceo2-tio2"]),
    ("Carbon", ["activatedcarbon"]),
    ("CNTs", ["cnt", "carbonnanotube"]),
    ("Carbon", ["carbon", "activated"]),
    ("Al2O4", ["al2o4"]),
    ("Al2O3", ["al2o3", "alumina"]),
    ("CeO2", ["ceo2"]),
    ("ZrO2", ["zro2"]),
    ("TiO2", ["tio2", "ti-o"]),
    ("ZnO", ["zno"]),
    ("MgAl", ["mgal", "mg-al", "mg/al"]),
    ("MgO", ["mgo"]),
    ("Mo2C", ["mo2c", "alpha-moc", "moc"]),
    ("CN", ["g-c3n4", "c3n4", "carbonnitride"]),
    ("h-BN", ["h-bn", "boronnitride"]),
    ("SnO2", ["sno2"]),
    ("Perovskite", ["perovskite", "lacemno", "lamno"]),
    ("Spinel", ["spinel"]),
    ("LDH", ["ldh", "hydrotalcite"]),
    ("NaF", ["naf", "sodiumfluoride"]),
    ("Cement-Clay", ["cement", "clay"]),
]
METHOD_RULES = [
    ("Co-precipitation", ["co-precip", "coprecip", "copre"]),
    ("Sol-gel", ["sol-gel", "sol gel"]),
    ("Impregnation", ["incipient", "wetness", "impreg", "impre"]),
    ("Hydrothermal", ["hydrothermal", "hydro"]),
    ("Ball milling", [("ball", "mill")]),
    ("Polyol", ["polyol"]),
]
PRECURSOR_NAMES = {"nitrate": "Nitrate", "chloride": "Chloride", "acetate": "Acetate", "organometallic": "Organometallic", "other": "Other", "unknown": "Unknown"}
# Patterns of a nickel loading inside a catalyst label, and the accepted range.
LABEL_LOADING_PATTERNS = [r"(?i)(\d+(?:\.\d+)?)\s*wt\s*%[^\n]*ni", r"(?i)ni\s*(\d+(?:\.\d+)?)"]
LABEL_LOADING_RANGE = (0.0, 80.0)
NI_TOKEN = r"(?i)(?:^|[^A-Za-z])Ni(?:[^A-Za-z]|$)"
NI_SIMPLE = r"(?i)^Ni(?:[-/ ].*)?\z"

# Model features and conditions.
NUMERIC_FEATURES = [
    "Reaction_Temp_C", "Ni_Loading_wt%", "Promoter_Loading_wt%", "Calcination_Temp_C", "Reduction_Temp_C", "Dry_Temp_C",
    "Calcination_Time_h", "Reduction_Time_h", "Dry_Time_h", "S_C_Ratio", "TOS_h", "Pressure_bar", "GHSV_log", "WHSV_log",
    "calc_reduc_temp_diff", "total_treatment_time_h", "prom_electronegativity", "prom_ionic_radius", "prom_atomic_mass",
    "prom_first_ionization", "support_acid_base",
]
CATEGORICAL_FEATURES = ["Support", "Promoter_Metal", "Metal_Loading_Method", "Precursor_Family", "Support_Prep_Method", "support_type"]
BINARY_FEATURES = ["has_promoter", "prom_missing", "support_reducible"]
CORE_SYNTHESIS = ["Ni_Loading_wt%", "Calcination_Temp_C", "Reduction_Temp_C", "Calcination_Time_h"]
COLLISION_KEY = [
    "Source_File", "Catalyst_Key", "Support", "Promoter_Metal", "Ni_Loading_wt%", "Promoter_Loading_wt%", "Reaction_Temp_C",
    "S_C_Ratio", "TOS_h", "Pressure_bar", "GHSV_mL_g_h", "WHSV_h_inv", "Calcination_Temp_C", "Reduction_Temp_C",
    "Calcination_Time_h", "Reduction_Time_h", "Dry_Temp_C", "Dry_Time_h", "Metal_Loading_Method",
]
COLLISION_LIMIT = 5.0
SEARCH_COLUMNS = ["Ni_Loading_wt%", "Promoter_Loading_wt%", "Calcination_Temp_C", "Reduction_Temp_C", "Dry_Temp_C", "Calcination_Time_h", "Reduction_Time_h", "Dry_Time_h"]
DOMAIN_COLUMNS = ["Reaction_Temp_C", *SEARCH_COLUMNS, "S_C_Ratio", "TOS_h", "Pressure_bar", "GHSV_log", "WHSV_log"]
SEARCH_TEMPERATURES = [300.0, 350.0, 400.0, 450.0, 500.0]

# Complexity order of the model families, and their locked parameters.
COMPLEXITY = {"SVR": 1, "Random Forest": 2, "Gradient Boosting": 3, "XGBoost": 4, "AdaBoost": 5, "Bagging": 6, "Extra Trees": 7}
LOCKED_PARAMS = {
    "Gradient Boosting": {"learning_rate": 0.06, "max_depth": 3, "max_features": 0.7, "min_samples_leaf": 15, "min_samples_split": 30, "n_estimators": 500, "subsample": 0.75},
    "XGBoost": {"colsample_bytree": 0.65, "gamma": 2.0, "learning_rate": 0.06, "max_depth": 3, "min_child_weight": 30, "n_estimators": 700, "reg_alpha": 0.5, "reg_lambda": 150.0, "subsample": 0.75},
    "Extra Trees": {"bootstrap": False, "max_depth": 7, "max_features": 0.5, "min_samples_leaf": 5, "min_samples_split": 10, "n_estimators": 1000},
    "Random Forest": {"bootstrap": True, "max_depth": 7, "max_features": 0.35, "min_samples_leaf": 5, "min_samples_split": 20, "n_estimators": 800},
}
SEARCH_SPACES = {
    "SVR": {"C": [0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0], "epsilon": [0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0], "gamma": ["scale", "auto", 0.003, 0.01, 0.03, 0.1, 0.3]},
    "AdaBoost": {"max_depth": [2, 3, 4, 5], "min_samples_leaf": [3, 5, 10, 15], "n_estimators": [100, 200, 400, 700], "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2], "loss": ["linear", "square", "exponential"]},
    "Bagging": {"max_depth": [4, 6, 8, None], "min_samples_leaf": [2, 5, 10, 15], "n_estimators": [100, 200, 400, 700], "max_samples": [0.55, 0.7, 0.85, 1.0], "max_features": [0.45, 0.6, 0.8, 1.0], "bootstrap": [True]},
}
# Readable labels, replaced in this order.
LABEL_PREFIXES = [
    ("num__", ""), ("cat__", ""), ("bin__", ""), ("missingindicator_", "Missing: "),
    ("Support_Prep_Method_", "Support prep: "), ("Metal_Loading_Method_", "Loading method: "), ("Precursor_Family_", "Precursor: "),
    ("Promoter_Metal_", "Promoter: "), ("support_type_", "Support type: "), ("Support_", "Support: "),
]
LABEL_NAMES = [
    ("MeOH_Conversion_%", "MeOH conversion (%)"), ("Reaction_Temp_C", "Reaction temperature (°C)"), ("Ni_Loading_wt%", "Ni loading (wt%)"),
    ("Promoter_Loading_wt%", "Promoter loading (wt%)"), ("Calcination_Temp_C", "Calcination temperature (°C)"), ("Reduction_Temp_C", "Reduction temperature (°C)"),
    ("Dry_Temp_C", "Drying temperature (°C)"), ("Calcination_Time_h", "Calcination time (h)"), ("Reduction_Time_h", "Reduction time (h)"), ("Dry_Time_h", "Drying time (h)"),
    ("S_C_Ratio", "S/C ratio"), ("TOS_h", "TOS (h)"), ("Pressure_bar", "Pressure (bar)"), ("GHSV_log", "GHSV (log)"), ("WHSV_log", "WHSV (log)"),
    ("calc_reduc_temp_diff", "Calcination–reduction ΔT (°C)"), ("total_treatment_time_h", "Total treatment time (h)"), ("has_promoter", "Has promoter"),
    ("support_reducible", "Reducible support"), ("support_acid_base", "Support acid–base class"), ("Metal_Loading_Method", "Loading method"), ("Precursor_Family", "Precursor family"),
    ("Support_Prep_Method", "Support preparation method"), ("support_type", "Support type"), ("prom_atomic_mass", "Promoter atomic mass"), ("prom_first_ionization", "Promoter first ionization"),
    ("prom_electronegativity", "Promoter electronegativity"), ("prom_ionic_radius", "Promoter ionic radius"),
]

# Promoter symbol -> electronegativity, ionic radius, atomic mass, first ionization.
PROMOTERS = [
    ("Ce", 1.12, 1.01, 140.12, 5.539), ("Co", 1.88, 0.745, 58.93, 7.881), ("Cu", 1.90, 0.73, 63.55, 7.726), ("In", 1.78, 0.80, 114.82, 5.786),
    ("La", 1.10, 1.032, 138.91, 5.577), ("Mg", 1.31, 0.72, 24.31, 7.646), ("Mo", 2.16, 0.59, 95.95, 7.092), ("Pd", 2.20, 0.86, 106.42, 8.337),
    ("Pt", 2.28, 0.80, 195.08, 9.000), ("Sn", 1.96, 0.69, 118.71, 7.344), ("Zn", 1.65, 0.74, 65.38, 9.394),
]
# Support -> type, acid-base class, reducible.
SUPPORTS = [
    ("Al2O3", "oxide", 2, 0), ("Al2O4", "oxide", 2, 0), ("CN", "nitride", 0, 0), ("h-BN", "nitride", 0, 0), ("CNTs", "carbon", 0, 0), ("Carbon", "carbon", 0, 0),
    ("CeO2", "oxide", 3, 1), ("Cement-Clay", "composite", 0, 0), ("LDH", "ldh", 3, 0), ("MgAl", "ldh", 3, 0), ("MgO", "oxide", 3, 0), ("Mo2C", "carbide", 0, 1),
    ("NaF", "salt", 0, 0), ("SnO2", "oxide", 2, 1), ("TiO2", "oxide", 2, 1), ("TiO2-CeO2", "composite", 2, 1), ("ZnO", "oxide", 2, 1), ("ZrO2", "oxide", 2, 1),
    ("Perovskite", "oxide", 2, 1), ("Spinel", "oxide", 2, 1), ("Other", "unknown", 0, 0), ("Unknown", "unknown", 0, 0),
]
