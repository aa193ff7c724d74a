"""Settings, vocabularies and built-in content.

Everything a user may want to change is a plain dataclass or mapping that the
operators take as an argument; the values here are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: thresholds and weights the results depend on. -------------


@dataclass(frozen=True)
class StatSettings:
    z_medium: float = 2.0
    z_high: float = 3.0
    iqr_inner: float = 1.5
    iqr_outer: float = 3.0
    min_observations: int = 8
    min_group_observations: int = 5
    std_epsilon: float = 1e-9
    relative_medium: float = 0.5
    relative_high: float = 1.0


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    subsample: int = 256
    # "auto" labels a record anomalous above a raw score of .5; a share in
    # (0, .5] labels that share of the training population instead.
    contamination: str | float = "auto"
    seed: int = 42
    min_training_records: int = 32
    min_features: int = 2
    score_medium: float = 60.0
    score_high: float = 80.0


@dataclass(frozen=True)
class FusionSettings:
    weights: dict[str, float] = field(
        default_factory=lambda: {"rules": 0.40, "statistics": 0.35, "ml": 0.25}
    )
    remainder: float = 0.20
    escalation_sources: int = 2
    risk_medium: float = 25.0
    risk_high: float = 50.0
    risk_critical: float = 75.0
    agreement_spread: float = 40.0
    methodology_version: str = "fusion-v1-prototype"
    hard_codes: tuple[str, ...] = (
        "AGE_MIN",
        "AGE_MAX",
        "WORKING_HOURS_MIN",
        "WORKING_HOURS_MAX",
        "INCOME_NON_NEGATIVE",
        "HOUSEHOLD_SIZE_MIN",
        "EMPLOYED_HAS_HOURS",
        "UNEMPLOYED_ZERO_HOURS",
        "RESPONDENT_ID_REQUIRED",
        "ENUMERATOR_REQUIRED",
        "CLUSTER_REQUIRED",
        "DISTRICT_REQUIRED",
    )


SOURCES = ("rules", "statistics", "ml")
SEVERITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
RULE_SCORES = {"NONE": 0.0, "LOW": 25.0, "MEDIUM": 50.0, "HIGH": 80.0, "CRITICAL": 100.0}
STAT_SCORES = {"NONE": 0.0, "LOW": 30.0, "MEDIUM": 60.0, "HIGH": 90.0, "CRITICAL": 100.0}
CONFIDENCE_BASE = {0: 10.0, 1: 45.0, 2: 70.0, 3: 88.0}
CONFIDENCE_SHIFT = {"strong": 8.0, "moderate": 4.0, "mixed": -22.0}
HISTORY_BONUS = 4.0
ESCALATION_REASON = "Two independent evidence sources produced HIGH severity."
CONTEXT_BYTES = 16384

# --- Fixed values: column vocabularies, first match wins. ---------------------

ROLE_CANDIDATES = {
    "record_id": ("respondent_id", "record_id", "person_id", "hh_id"),
    "enumerator_id": ("enumerator_id", "enumerator"),
    "cluster_id": ("cluster_id", "cluster", "fsu"),
    "district_id": ("district_code", "district_id", "district"),
}

CONCEPT_CANDIDATES = {
    "household": ("household_id", "hh_id"),
    "marital": ("marital_status", "marital", "marriage_status"),
    "education": ("education", "education_level", "edu"),
    "role": ("household_role", "relation_to_head", "relationship"),
    "period": ("survey_round", "visit", "ref_period", "collected_at", "period"),
    "employment": ("employment_status", "emp_status", "activity_status"),
    "income": ("income",),
    "hours": ("working_hours", "hours"),
    "age": ("age",),
    "sex": ("sex", "gender"),
    "total_income": ("total_income", "income_total"),
}
INCOME_PARTS = ("wage_income", "self_employment_income", "other_income")
SIGNATURE_CONCEPTS = ("age", "sex", "education", "employment", "hours", "income")

SCHEMA_VERSION = "v1"
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "nan", "-", ".")
# Tokens a CSV scan treats as missing before anything else (case-sensitive).
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: the built-in rules. ----------------------------------------
# code, field, operator, value, condition, severity, message

RULE_TABLE = (
    ("AGE_MIN", "age", "greater_than_or_equal", 0, None, "HIGH",
     "Age must be at least 0."),
    ("AGE_MAX", "age", "less_than_or_equal", 100, None, "HIGH",
     "Age must be at most 100."),
    ("WORKING_HOURS_MIN", "working_hours", "greater_than_or_equal", 0, None, "HIGH",
     "Working hours must be at least 0."),
    ("WORKING_HOURS_MAX", "working_hours", "less_than_or_equal", 168, None, "CRITICAL",
     "Working hours must be at most 168 (hours in a week)."),
    ("INCOME_NON_NEGATIVE", "income", "greater_than_or_equal", 0, None, "HIGH",
     "Income must be at least 0."),
    ("HOUSEHOLD_SIZE_MIN", "household_size", "greater_than_or_equal", 1, None, "HIGH",
     "Household size must be at least 1 when the field is present."),
    ("RESPONDENT_ID_REQUIRED", "respondent_id", "is_not_blank", None, None, "CRITICAL",
     "Respondent identifier must exist."),
    ("ENUMERATOR_REQUIRED", "enumerator_id", "is_not_blank", None, None, "HIGH",
     "Enumerator identifier must exist."),
    ("CLUSTER_REQUIRED", "cluster_id", "is_not_blank", None, None, "HIGH",
     "Cluster identifier must exist."),
    ("DISTRICT_REQUIRED", "district_code", "is_not_blank", None, None, "HIGH",
     "District code must exist."),
    ("EMPLOYED_HAS_HOURS", "working_hours", "greater_than", 0,
     ("employment_status", "equals", "employed"), "MEDIUM",
     "If employment_status is employed, working_hours must be greater than 0."),
    ("UNEMPLOYED_ZERO_HOURS", "working_hours", "equals", 0,
     ("employment_status", "equals", "unemployed"), "MEDIUM",
     "If employment_status is unemployed, working_hours should be 0."),
    ("CLUSTER_IN_REFERENCE", "cluster_id", "in_reference", "clusters", None, "MEDIUM",
     "cluster_id must be in the sample cluster list."),
    ("DISTRICT_IN_REFERENCE", "district_code", "in_reference", "districts", None, "MEDIUM",
     "district_code must be in the sample district list."),
    ("ENUMERATOR_IN_REFERENCE", "enumerator_id", "in_reference", "enumerators", None, "MEDIUM",
     "enumerator_id must be in the sample enumerator list."),
)

REFERENCE_SETS = {
    "clusters": ["C01", "C02"],
    "districts": ["1101", "1102"],
    "enumerators": ["E12", "E15"],
}

# --- Fixed values: detectors, their family, severity and thresholds. ----------


@dataclass(frozen=True)
class DetectorConfig:
    detector_id: str
    name: str
    category: str
    severity: str = "MEDIUM"
    thresholds: dict[str, float] = field(default_factory=dict)
    enabled: bool = True


DETECTORS = {
    d.detector_id: d
    for d in (
        DetectorConfig("REL_AGE_MARITAL", "Age / marital status", "RELATIONSHIP",
                       thresholds={"min_marriage_age": 18}),
        DetectorConfig("REL_AGE_EDUCATION", "Age / education", "RELATIONSHIP",
                       thresholds={"postgraduate_min_age": 20}),
        DetectorConfig("REL_EMPLOYMENT_HOURS", "Employment / working hours", "RELATIONSHIP",
                       thresholds={"not_working_hours_threshold": 10}),
        DetectorConfig("REL_AGE_HOUSEHOLD_ROLE", "Age / household role", "RELATIONSHIP",
                       thresholds={"min_head_age": 16}),
        DetectorConfig("REL_INCOME_EMPLOYMENT", "Income / employment", "RELATIONSHIP",
                       thresholds={"unemployed_high_income": 80000}),
        DetectorConfig("REL_HOURS_EMPLOYMENT", "Working hours / employment", "RELATIONSHIP",
                       thresholds={"positive_hours": 0}),
        DetectorConfig("REL_HOUSEHOLD_CONSISTENCY", "Household consistency", "RELATIONSHIP"),
        DetectorConfig("REL_ARITHMETIC", "Arithmetic consistency", "RELATIONSHIP", "LOW",
                       {"tolerance": 1.0}),
        DetectorConfig("ENUMERATOR_DEVIATION", "Enumerator employment deviation", "ENUMERATOR",
                       thresholds={"pp_threshold": 0.25, "min_records": 8}),
        DetectorConfig("ENUMERATOR_MISSINGNESS", "Enumerator missingness deviation", "ENUMERATOR",
                       thresholds={"pp_threshold": 0.08, "min_records": 8}),
        DetectorConfig("ENUMERATOR_ENTROPY", "Enumerator response diversity", "ENUMERATOR",
                       thresholds={"entropy_ratio": 0.45, "min_records": 8}),
        DetectorConfig("PATTERN_ENUMERATOR_SIMILARITY", "Enumerator repeated responses", "PATTERN",
                       thresholds={"share_threshold": 0.6, "min_records": 8}),
        DetectorConfig("TEMPORAL_CHANGE", "Period-over-period change", "TEMPORAL",
                       thresholds={"pp_threshold": 0.08, "min_period_n": 8}),
        DetectorConfig("GEOGRAPHIC_CLUSTER", "Cluster geographic deviation", "GEOGRAPHIC",
                       thresholds={"pp_threshold": 0.25, "min_records": 6}),
        DetectorConfig("GEOGRAPHIC_DISTRICT", "District geographic deviation", "GEOGRAPHIC",
                       thresholds={"pp_threshold": 0.2, "min_records": 8}),
        DetectorConfig("CLUSTER_PATTERN", "Cluster response similarity", "PATTERN",
                       thresholds={"share_threshold": 0.7, "min_records": 8}),
        DetectorConfig("DISTRIBUTION_SHIFT", "Historical distribution shift", "HISTORICAL",
                       thresholds={"tvd_threshold": 0.35}),
        DetectorConfig("STAT_MAD", "Robust MAD outlier", "STATISTICAL"),
    )
}


def detector_enabled(configs: dict[str, DetectorConfig], detector_id: str) -> bool:
    """A detector nobody configured counts as enabled."""
    found = configs.get(detector_id)
    return found is None or found.enabled


def detector_threshold(
    configs: dict[str, DetectorConfig], detector_id: str, name: str, default: float
) -> float:
    found = configs.get(detector_id)
    return float((found.thresholds if found else {}).get(name, default))


# --- Fixed values: texts shown with a detection. ------------------------------

EXPLANATIONS = {
    "REL_AGE_MARITAL": "Age and marital-status combination is unusual and requires review.",
    "REL_AGE_EDUCATION": "Age and education combination is unusual and requires review.",
    "REL_EMPLOYMENT_HOURS": "Employment status indicates not working, but working hours exceed "
                            "the review threshold.",
    "REL_AGE_HOUSEHOLD_ROLE": "Very young respondent listed as household head — unusual pattern, "
                              "not automatically invalid.",
    "REL_INCOME_EMPLOYMENT": "Unemployed status with unusually high income requires review. "
                             "Income can have legitimate sources.",
    "REL_HOURS_EMPLOYMENT": "Working hours are positive while employment status is inconsistent "
                            "with work.",
    "HOUSEHOLD_HEADS": "Multiple household heads were recorded for the same household.",
    "HOUSEHOLD_AGES": "Household age span is unusually wide and should be reviewed.",
    "REL_ARITHMETIC": "Reported total does not match the sum of component fields within "
                      "tolerance.",
    "ENUMERATOR_DEVIATION": "Enumerator employment distribution differs substantially from the "
                            "comparison baseline.",
    "ENUMERATOR_HISTORY": "Enumerator employment rate changed sharply versus historical behaviour "
                          "for the same enumerator.",
    "ENUMERATOR_MISSINGNESS": "Enumerator missingness is unusually high or extremely low relative "
                              "to the batch.",
    "ENUMERATOR_ENTROPY": "Enumerator categorical responses are unusually concentrated compared "
                          "with the overall distribution.",
    "PATTERN_ENUMERATOR_SIMILARITY": "Many records handled by this enumerator share nearly "
                                     "identical canonical response signatures.",
    "TEMPORAL_CHANGE": "Period-over-period unemployment rate changed substantially versus the "
                       "previous comparable period.",
    "TEMPORAL_BASELINE": "Unemployment rate deviates from the rolling historical baseline for "
                         "this survey.",
    "TEMPORAL_CUSUM": "CUSUM/EWMA change-point signal on unemployment rate — investigation "
                      "candidate, not proof of error.",
    "GEOGRAPHIC_DISTRICT": "District employment rate differs substantially from the "
                           "national/batch baseline.",
    "GEOGRAPHIC_CLUSTER": "Cluster employment distribution differs substantially from its parent "
                          "geography.",
    "CLUSTER_PATTERN": "A high concentration of similar responses was detected within this "
                       "cluster.",
    "DISTRIBUTION_SHIFT": "Categorical distribution differs substantially from the prior batch "
                          "profile.",
}

# --- Fixed values: case states and the state each action leads to. ------------

CASE_STATUSES = (
    "OPEN", "IN_REVIEW", "REQUIRES_REENUMERATION", "ESCALATED",
    "RESOLVED_VALID", "RESOLVED_INVALID",
)
CASE_RESOLVED = ("RESOLVED_VALID", "RESOLVED_INVALID")
CASE_ACTIONS = {
    "REVIEW": "IN_REVIEW",
    "VERIFY_SOURCE": "IN_REVIEW",
    "REQUEST_REENUMERATION": "REQUIRES_REENUMERATION",
    "ESCALATE": "ESCALATED",
    "MARK_VALID": "RESOLVED_VALID",
    "MARK_INVALID": "RESOLVED_INVALID",
}
CASE_PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# --- Fixed values: form labels, tried in this order. ---------------------------

FORM_LABELS = (
    ("record_id", ("record id", "record no", "record number", "id")),
    ("name", ("name", "respondent name")),
    ("age", ("age",)),
    ("gender", ("gender", "sex")),
    ("district", ("district", "district name")),
    ("income", ("income", "monthly income", "household income")),
    ("occupation", ("occupation", "profession")),
    ("education", ("education", "education level", "qualification")),
    ("marital_status", ("marital status",)),
    ("remarks", ("remarks", "remark", "notes")),
)
KNOWN_GENDERS = ("male", "female", "other", "transgender")
KNOWN_MARITAL = ("married", "unmarried", "single", "divorced", "widowed", "separated")
SCORE_HIGH = 0.90
SCORE_MEDIUM = 0.70
