"""Registered queries against their SQL. TRIALGAUGE_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, connect

SF_DIR = os.environ.get("TRIALGAUGE_SF_DIR", "/root/testdata/sf0.001")

REPRESENTATIVE = """
s01_dataset_scan s03_file_discovery s07_table_name s09_table_write c05_drop_near_empty c10_preprocess_chain
c11_quality_report c13_id_normalisation j01_first_site_lookup j02_full_outer_on_study j06_nearest_target e01_value_counts
e03_histogram e06_study_metrics f05_days_pages_missing f10_site_features f11_patient_features f12_study_features
f13_population_statistics f13_large_input_path q05_interpolated_percentile q16_top_issues q17_recommendations
q20_sites_hybrid q20_studies_hybrid q21_result_row r01_rank_sites_large_input_path r02_rank_within_study r10_portfolio_summary
b04_cohort_statistics b04_cohort_statistics_large_input_path b08_strengths_weaknesses b11_recommendations a12_explanation
a04_local_outlier_factor a14_control_chart a15_ks_drift_large_input_path a18_summary k02_dbscan k08_co_association
k16_silhouette g01_first_node_wins g02_first_edge_wins g18_safety_reviews_by_site g21_count_by_nearest_target
g25_beam_expansion t02_minhash t08_entity_retrieval t11_text_vector t13_vector_top_k_many_queries n07_studies_without_issues
n21_coded_percentage n25_coding_records_of_study p01_site_summary p08_site_fact_sheet a02_isolation_forest
a03_legacy_forest_bands a15_ks_drift k04_merge_tree_cuts k04_merge_heights k21_projection g25_questions_at_once j10_similar_values
t06_edit_join
""".split()

SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("TRIALGAUGE_ALL") else REPRESENTATIVE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, SF_DIR), con, SQL[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship_names_sites_and_reasons(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 100 for r in rows)
