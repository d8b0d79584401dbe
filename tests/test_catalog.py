"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from gatelens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = """robust_z_events weighted_quantile_price boxplot_orders signal_histogram confusion_quality soft_weights top_anomalies leaves_props instr_no_comma knn_euclid calib_tristate trace_pairs unit_vectors output_density
delta_direction sim_conflict contradiction cosine_residuals bundle_axes instr_first_word gap_jump tail_start_policy confidence scoring_maps lenient_labels leaf_gate_rows leaf_row_metrics detail_override leaf_histograms
edge_input_cases policy_quantile_two_sided tri_thresholds_lower calibrate_distance calibrate_tristate calibrated_rows lambda_stability guard_maps canonical_text weighted_z rule_statistics score_fallbacks bundle_scores
verdict_keys self_contradiction json_schema_gate schema_inference report_diagnostics audit_gates""".split()


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "customer supplier orders lineitem events documents embeddings labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr([value(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([value(r[i]) for i in at]) for r in rel.fetchall())


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
