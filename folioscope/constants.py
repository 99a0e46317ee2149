"""Versions, field names and thresholds that outputs must carry (fixed values)."""

NORM_VERSION = "2026-10-30a"
SCORER_VERSION = "3.0"
SCORECARD_SCHEMA_VERSION = "2.1"
REPORT_SCHEMA_VERSION = "2.1"
POSTPROC_VERSION = "3"
NO_POSTPROC = "0"
ALIGNER = "folioscope-bitparallel-1"
ILLEGIBLE = "�"
STRATUM_THRESHOLD = 80
STRATA = ("content", "sparse_blank")
ERROR_PREFIX = "__ERR__"
TRUNCATED_PREFIX = "__ERR__FinishReason"
COUNT_KEYS = ("cer_body_dip", "cer_body_read", "cer_full_dip", "cer_full_read")
SUPPORT_PAIRS = (("recall_matched", "recall_reference"), ("over_extraction_extra", "over_extraction_output"), ("furniture_global_token_recall_matched", "furniture_global_token_recall_reference"))
LANGUAGE_CODES = {"eng": "en", "deu": "de", "fra": "fr", "lat": "la", "rus": "ru"}
#: Names of languages by ISO 639-3 code, for reviewers.
LANGUAGE_NAMES = {
    "eng": "English", "deu": "German", "fra": "French", "lat": "Latin", "rus": "Russian",
    "ita": "Italian", "spa": "Spanish", "nld": "Dutch", "por": "Portuguese", "ron": "Romanian",
    "zsm": "Malay (Standard)", "msa": "Malay", "ltz": "Luxembourgish", "sme": "Northern Sami",
    "gsw": "Swiss German", "war": "Waray", "dag": "Dagbani", "frp": "Franco-Provencal",
    "bar": "Bavarian", "sco": "Scots", "wes": "Cameroon Pidgin", "mlt": "Maltese", "tur": "Turkish",
    "cat": "Catalan", "oci": "Occitan", "afr": "Afrikaans", "nno": "Norwegian Nynorsk",
    "dan": "Danish", "swe": "Swedish", "fin": "Finnish", "pol": "Polish", "ces": "Czech",
    "hun": "Hungarian", "vol": "Volapuk", "epo": "Esperanto", "ina": "Interlingua",
}
BOOTSTRAP_REPLICATES = 1000
BOOTSTRAP_ALPHA = 0.05
BENCHMARK_FIELDS = ("dataset_id", "requested_revision", "resolved_revision", "dataset_fingerprint", "expected_page_count", "full_page_set_fingerprint", "sample_stratum_threshold", "expected_stratum_counts")
SAMPLER_FIELDS = ("sampler_version", "sampler_source_repo", "sampler_source_revision", "sampler_seed", "sampler_requested_n")
SCORE_FIELDS = ("norm_version", "aligner", "lanes", "grapheme_mode", "word_boundary", "illegible_marker")
