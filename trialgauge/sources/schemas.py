"""Explicit schemas of the clinical datasets (ids are text, every column nullable)."""

from __future__ import annotations

ISSUES = "study string, subject string, total_open_issue_count_per_subject bigint, _source_study string"

SAFETY = (
    "discrepancy_id string, study_id string, country string, site string, patient_id string, form_name string, "
    "discrepancy_created_timestamp_in_dashboard timestamp, review_status string, action_status string, "
    "_source_study string, case_status string"
)

MEDDRA = (
    "meddra_coding_report string, study string, dictionary string, dictionary_version_number double, subject string, "
    "form_oid string, logline bigint, field_oid string, coding_status string, require_coding string, _source_study string"
)

WHODD = MEDDRA.replace("meddra_coding_report", "whodrug_coding_report")

MISSING_PAGES = (
    "study_name string, sitegroupname_countryname_ string, sitenumber string, subjectname string, "
    "overall_subject_status string, visit_level_subject_status string, foldername string, visit_date timestamp, "
    "form_type__summary_or_visit_ string, formname string, no___days_page_missing double, _source_study string, "
    "form_1_subject_status string"
)

VISIT_PROJECTION = (
    "country string, site string, subject string, visit string, projected_date timestamp, __days_outstanding double, "
    "_source_study string, actual_date timestamp, __days_outstanding__today___projected_date_ string"
)

STUDY_METRICS = (
    "study string, total_issues bigint, avg_issues double, max_issues bigint, meddra_records double, esae_records double"
)

DATASETS: dict[str, str] = {
    "edrr_processed": ISSUES,
    "esae_processed": SAFETY,
    "esae_dashboard_processed": SAFETY,
    "meddra_processed": MEDDRA,
    "whodd_processed": WHODD,
    "missing_pages_processed": MISSING_PAGES,
    "visit_projection_processed": VISIT_PROJECTION,
    "study_metrics": STUDY_METRICS,
}
