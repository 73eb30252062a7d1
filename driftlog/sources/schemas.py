"""Schemas of the logged tables."""

from __future__ import annotations

SPLIT_REGISTRY = "dataset string, dataset_revision string, source_row_index bigint, prompt_id string, original_split string, research_split string, question_hash string, gold_answer_hash string, split_assignment_hash string"

BEHAVIOR_TRAJECTORY = (
    "trajectory_id string, dataset string, dataset_revision string, training_seed bigint, behavior_step int, split string, prompt_id string, source_row_index bigint, sample_index int, "
    "prompt_token_ids array<bigint>, completion_token_ids array<bigint>, behavior_token_logprobs array<double>, behavior_sequence_logprob double, completion_length int, terminated_with_eos boolean, "
    "was_truncated boolean, parsed_answer string, correctness_reward double, parser_status string, temperature double, top_p double, top_k int, repetition_penalty double, max_completion_length int, "
    "generation_seed bigint, generation_call_id string, model_revision string, tokenizer_revision string, chat_template_hash string, prompt_template_hash string, behavior_adapter_sha256 string, "
    "generation_config_sha256 string, behavior_logprob_source string, completion_text string"
)

PAIR_REGISTRY = "pair_id string, training_seed bigint, dataset string, split string, behavior_step int, target_step int, purpose string, protocol_version string"

TARGET_RESCORE = (
    "rescore_id string, trajectory_id string, dataset string, dataset_revision string, protocol_version string, training_seed bigint, split string, behavior_step int, target_step int, purpose string, "
    "prompt_id string, sample_index int, behavior_adapter_sha256 string, target_adapter_sha256 string, behavior_sequence_logprob double, target_sequence_logprob double, log_weight double, "
    "mean_log_ratio_per_token double, completion_length int, correctness_reward double, terminated_with_eos boolean, was_truncated boolean, identity_abs_sequence_logprob_diff double, "
    "identity_max_abs_token_logprob_diff double, identity_mean_abs_token_logprob_diff double, identity_pass boolean, scoring_precision string, logprob_definition string, source_behavior_content_sha256 string"
)

ONLINE_PROMPT_SUMMARY = "dataset string, dataset_revision string, split string, prompt_id string, training_seed bigint, target_step bigint, success_count bigint, n_samples bigint, prompt_accuracy double"
