"""They must stay as they are for results to be comparable."""

# --- fixed values: decision and segmentation settings -------------------------------------
DECISION_THRESHOLD = 0.5
MERGE_GAP_MS = 150
ONSET_TOLERANCE_MS = 64
MIN_OVERLAP_MS = 96
IMMEDIATE_YIELD_MS = 500
IMMEDIATE_RETAKE_MS = 500
LONG_GAP_MS = 2000
SHORT_AGENT_TURN_MS = 3000
CV_MIN_MEAN_MS = 100
MIN_VARIABILITY_EVENTS = 3

# --- fixed values: behaviour feature names ------------------------------------------------
GLOBAL = ["duration_s", "caller_speech_s", "agent_speech_s", "silence_s", "overlap_s",
          "caller_proportion", "leading_silence_s", "trailing_silence_s", "caller_turn_count",
          "agent_turn_count"]
TEMPORAL = ["caller_turn_mean", "caller_turn_median", "caller_turn_std", "caller_turn_iqr",
            "agent_turn_mean", "agent_turn_median", "caller_pause_median",
            "response_latency_count", "response_latency_mean", "response_latency_median"]
REACTION = ["interruption_count", "interruption_rate", "interruption_stop_latency_mean",
            "interruption_stop_latency_median", "interruption_yield_fraction",
            "interruption_immediate_yield_fraction", "recovery_latency_count",
            "recovery_latency_mean", "recovery_gap_mean", "immediate_retake_fraction",
            "barge_in_count", "barge_in_rate", "barge_overlap_mean", "barge_continues_fraction",
            "extended_gap_count", "extended_gap_caller_fraction"]
CONSISTENCY = ["response_latency_std", "response_latency_iqr", "response_latency_cv",
               "interruption_stop_latency_std", "interruption_stop_latency_iqr", "interruption_stop_latency_cv",
               "recovery_latency_std", "recovery_latency_iqr", "recovery_latency_cv",
               "barge_overlap_std", "barge_overlap_iqr", "barge_overlap_cv",
               "reaction_entropy", "short_context_response_std", "long_context_response_std"]

# --- fixed values: transcript word lists --------------------------------------------------
DISFLUENCIES = ["este", "eh", "em", "mmm", "mm", "ah", "ehm", "pues", "bueno", "o sea", "osea", "digo", "ay",
                "ándale", "andale"]
REGIONALISMS = ["mande", "ándale", "andale", "órale", "orale", "ahorita", "fíjese", "fijese", "checar", "sale",
                "chido", "híjole", "hijole", "nomás", "nomas", "ni modo", "güey", "wey", "mero", "chance", "padre",
                "oiga", "oye"]
SCRIPT_TICS = ["guion", "guión"]
DISFLUENCY_PHRASES = ["o sea"]
REGIONAL_PHRASES = ["ni modo"]

# --- fixed values: augmentation plan (split, family, copies) and line parameter ranges ----
AUGMENTATION_PLAN = [("train", "seen", 2), ("train", "unseen", 0), ("val", "seen", 1), ("val", "unseen", 1)]
CODEC_FAMILIES = {
    "seen": ["g711_ulaw", "g711_alaw", "g726_32k", "g726_24k", "g726_16k"],
    "unseen": ["gsm_fr", "amrnb_12k2", "amrnb_7k4", "amrnb_4k75", "ilbc", "speex", "opus_nb", "g722"],
}
ONE_HOP_SHARE = 0.65
LINE_UNIFORM = {
    "high_pass_hz": (180.0, 380.0), "low_pass_hz": (3000.0, 3800.0), "tilt_db_oct": (-2.5, 1.5),
    "agc_target_db": (-26.0, -16.0), "input_gain_db": (-10.0, 4.0), "loss_burst": (1.0, 4.0),
    "clock_drift_ppm": (-300.0, 300.0), "comfort_noise_db": (-62.0, -45.0), "noise_snr_db": (18.0, 42.0),
    "hum_db": (-50.0, -34.0),
}
LINE_CHOICE = {
    "loss_rate": [0.0, 0.0, 0.005, 0.01, 0.02, 0.04], "concealment": ["plc", "plc", "zero"],
    "noise_colour": ["white", "pink"], "hum_hz": [0.0, 0.0, 0.0, 50.0, 60.0],
}
LINE_CHANCE = {"agc": 0.75, "comfort_noise": 0.5}
LINE_SCALED = ["tilt_db_oct", "input_gain_db", "loss_rate", "clock_drift_ppm"]

# --- fixed values: trivial cues by group --------------------------------------------------
SHORTCUT_COLUMNS = {
    "duration_only": ["duration_s"],
    "duration+silence": ["duration_s", "first_caller_start_s", "trailing_silence_s"],
    "metadata": ["duration_s", "caller_speech_s", "caller_speech_fraction", "n_caller_turns", "n_agent_turns",
                 "agent_speech_s", "first_caller_start_s", "trailing_silence_s", "n_chunks"],
    "loudness": ["caller_rms_db", "caller_speech_rms_db", "caller_peak", "caller_clipping_fraction",
                 "caller_noise_floor_db", "caller_snr_db", "agent_rms_db"],
    "bandwidth": ["caller_rolloff95_hz", "caller_centroid_hz", "caller_hf_ratio_db"],
    "behavioural": ["median_response_latency_s", "std_response_latency_s", "overlap_s", "mean_caller_turn_s",
                    "max_caller_turn_s", "n_caller_turns"],
}

# --- fixed values: the feature sets that models are compared on ----------------------------
BEHAVIOUR_SETS: dict[str, list[str]] = {
    "dummy": [
        "duration_s"],
    "shortcut": [
        "duration_s", "caller_speech_s", "agent_speech_s", "silence_s", "overlap_s", "caller_proportion", "leading_silence_s",
        "trailing_silence_s", "caller_turn_count", "agent_turn_count"],
    "temporal": [
        "caller_turn_mean", "caller_turn_median", "caller_turn_std", "caller_turn_iqr", "agent_turn_mean", "agent_turn_median",
        "caller_pause_median", "response_latency_count", "response_latency_mean", "response_latency_median"],
    "reaction": [
        "caller_turn_mean", "caller_turn_median", "caller_turn_std", "caller_turn_iqr", "agent_turn_mean", "agent_turn_median",
        "caller_pause_median", "response_latency_count", "response_latency_mean", "response_latency_median", "interruption_count",
        "interruption_rate", "interruption_stop_latency_mean", "interruption_stop_latency_median", "interruption_yield_fraction",
        "interruption_immediate_yield_fraction", "recovery_latency_count", "recovery_latency_mean", "recovery_gap_mean",
        "immediate_retake_fraction", "barge_in_count", "barge_in_rate", "barge_overlap_mean", "barge_continues_fraction",
        "extended_gap_count", "extended_gap_caller_fraction"],
    "consistency": [
        "caller_turn_mean", "caller_turn_median", "caller_turn_std", "caller_turn_iqr", "agent_turn_mean", "agent_turn_median",
        "caller_pause_median", "response_latency_count", "response_latency_mean", "response_latency_median", "interruption_count",
        "interruption_rate", "interruption_stop_latency_mean", "interruption_stop_latency_median", "interruption_yield_fraction",
        "interruption_immediate_yield_fraction", "recovery_latency_count", "recovery_latency_mean", "recovery_gap_mean",
        "immediate_retake_fraction", "barge_in_count", "barge_in_rate", "barge_overlap_mean", "barge_continues_fraction",
        "extended_gap_count", "extended_gap_caller_fraction", "response_latency_std", "response_latency_iqr",
        "response_latency_cv", "interruption_stop_latency_std", "interruption_stop_latency_iqr", "interruption_stop_latency_cv",
        "recovery_latency_std", "recovery_latency_iqr", "recovery_latency_cv", "barge_overlap_std", "barge_overlap_iqr",
        "barge_overlap_cv", "reaction_entropy", "short_context_response_std", "long_context_response_std"],
    "reaction_only": [
        "interruption_count", "interruption_rate", "interruption_stop_latency_mean", "interruption_stop_latency_median",
        "interruption_yield_fraction", "interruption_immediate_yield_fraction", "recovery_latency_count", "recovery_latency_mean",
        "recovery_gap_mean", "immediate_retake_fraction", "barge_in_count", "barge_in_rate", "barge_overlap_mean",
        "barge_continues_fraction", "extended_gap_count", "extended_gap_caller_fraction", "response_latency_std",
        "response_latency_iqr", "response_latency_cv", "interruption_stop_latency_std", "interruption_stop_latency_iqr",
        "interruption_stop_latency_cv", "recovery_latency_std", "recovery_latency_iqr", "recovery_latency_cv",
        "barge_overlap_std", "barge_overlap_iqr", "barge_overlap_cv", "reaction_entropy", "short_context_response_std",
        "long_context_response_std"],
    "no_counts": [
        "caller_turn_mean", "caller_turn_median", "caller_turn_std", "caller_turn_iqr", "agent_turn_mean", "agent_turn_median",
        "caller_pause_median", "response_latency_mean", "response_latency_median", "interruption_rate",
        "interruption_stop_latency_mean", "interruption_stop_latency_median", "interruption_yield_fraction",
        "interruption_immediate_yield_fraction", "recovery_latency_mean", "recovery_gap_mean", "immediate_retake_fraction",
        "barge_in_rate", "barge_overlap_mean", "barge_continues_fraction", "extended_gap_caller_fraction", "response_latency_std",
        "response_latency_iqr", "response_latency_cv", "interruption_stop_latency_std", "interruption_stop_latency_iqr",
        "interruption_stop_latency_cv", "recovery_latency_std", "recovery_latency_iqr", "recovery_latency_cv",
        "barge_overlap_std", "barge_overlap_iqr", "barge_overlap_cv", "reaction_entropy", "short_context_response_std",
        "long_context_response_std"],
    "no_agent": [
        "caller_turn_mean", "caller_turn_median", "caller_turn_std", "caller_turn_iqr", "caller_pause_median",
        "response_latency_count", "response_latency_mean", "response_latency_median", "interruption_count", "interruption_rate",
        "interruption_stop_latency_mean", "interruption_stop_latency_median", "interruption_yield_fraction",
        "interruption_immediate_yield_fraction", "recovery_latency_count", "recovery_latency_mean", "recovery_gap_mean",
        "immediate_retake_fraction", "barge_in_count", "barge_in_rate", "barge_overlap_mean", "barge_continues_fraction",
        "extended_gap_count", "extended_gap_caller_fraction", "response_latency_std", "response_latency_iqr",
        "response_latency_cv", "interruption_stop_latency_std", "interruption_stop_latency_iqr", "interruption_stop_latency_cv",
        "recovery_latency_std", "recovery_latency_iqr", "recovery_latency_cv", "barge_overlap_std", "barge_overlap_iqr",
        "barge_overlap_cv", "reaction_entropy", "short_context_response_std", "long_context_response_std"],
    "with_global": [
        "duration_s", "caller_speech_s", "agent_speech_s", "silence_s", "overlap_s", "caller_proportion", "leading_silence_s",
        "trailing_silence_s", "caller_turn_count", "agent_turn_count", "caller_turn_mean", "caller_turn_median",
        "caller_turn_std", "caller_turn_iqr", "agent_turn_mean", "agent_turn_median", "caller_pause_median",
        "response_latency_count", "response_latency_mean", "response_latency_median", "interruption_count", "interruption_rate",
        "interruption_stop_latency_mean", "interruption_stop_latency_median", "interruption_yield_fraction",
        "interruption_immediate_yield_fraction", "recovery_latency_count", "recovery_latency_mean", "recovery_gap_mean",
        "immediate_retake_fraction", "barge_in_count", "barge_in_rate", "barge_overlap_mean", "barge_continues_fraction",
        "extended_gap_count", "extended_gap_caller_fraction", "response_latency_std", "response_latency_iqr",
        "response_latency_cv", "interruption_stop_latency_std", "interruption_stop_latency_iqr", "interruption_stop_latency_cv",
        "recovery_latency_std", "recovery_latency_iqr", "recovery_latency_cv", "barge_overlap_std", "barge_overlap_iqr",
        "barge_overlap_cv", "reaction_entropy", "short_context_response_std", "long_context_response_std"],
}

# --- fixed values: the trivial cues taken together ------------------------------------------
ALL_TRIVIAL = [
    "agent_rms_db", "agent_speech_s", "caller_centroid_hz", "caller_clipping_fraction", "caller_hf_ratio_db",
    "caller_noise_floor_db", "caller_peak", "caller_rms_db", "caller_rolloff95_hz", "caller_snr_db", "caller_speech_fraction",
    "caller_speech_rms_db", "caller_speech_s", "duration_s", "first_caller_start_s", "max_caller_turn_s", "mean_caller_turn_s",
    "median_response_latency_s", "n_agent_turns", "n_caller_turns", "n_chunks", "overlap_s", "std_response_latency_s",
    "trailing_silence_s"]
