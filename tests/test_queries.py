"""Registered queries next to their SQL in DuckDB: one of each family, all of them with ``TALKGRID_ALL=1``."""

import os

import pytest

from oracle import compare, database
from talkgrid.plans import load_queries

SAMPLE = ("agg_01_call_scores", "agg_12_class_medians", "agg_24_pair_similarity_hist", "dq_04_bad_sample_ids", "evt_09_behaviour_features", "evt_13_conversation_features",
          "fus_06_recombine", "fus_12_fusion_metrics", "int_03_normalize_turns", "int_05_speaking_states", "int_12_turn_stats", "int_14_energy_vad", "int_18_hysteresis_vad",
          "jon_06_nearest_neighbour", "lat_05_decided_at", "lat_07_latency_benchmark", "log_01_latency_series", "log_07_summary", "met_12_evaluation_matrix", "met_16_spearman",
          "mod_03_linear_score", "prj_14_input_guards", "set_08_augmentation_plan", "src_06_wav_frames", "src_06_wav_rejects", "src_13_detection_sink", "src_16_experiment_log", "int_21_chunk_regions", "str_02_rolling_latency", "str_03_gaps", "txt_08_repetition_loops", "txt_04_richness", "udf_01_layer_plugins")
QUERIES, SQL = load_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TALKGRID_ALL") else SAMPLE)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(con, QUERIES[name](spark, sf_dir), SQL[name]) == ""


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
