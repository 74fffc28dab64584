"""Row layouts of the engine's tables, as Spark DDL."""

CHUNKS = "chunk_idx bigint, id string, file_path string, start_line int, end_line int, start_byte bigint, end_byte bigint, symbol string, content string, token_est int, content_hash string, is_test boolean, stitched_context string"
MODEL_SCORES = "chunk_idx bigint, score double, lp_yes double, lp_no double, ambiguous boolean, failed boolean"
RESULTS = "rank int, candidate_id string, file_path string, raw_score double, decision_score double, calibrated_score double, delta double, citation struct<file:string,start_line:int,end_line:int,symbol:string>, ground_truth_status string, snippet string, cached boolean, below_threshold boolean, ambiguous boolean, is_test boolean, redundancy_penalized boolean, symbol_boosted boolean, matched_symbols array<string>, domain_hits int, structural_domain_hits int, symptom_hits int, symbol_role string, metadata map<string,string>"
MANIFEST = "file_path string, chunks_count bigint, max_score double, status string, symbols array<string>, is_test boolean"
SCORE_CACHE = "cache_key string, model_id string, prompt_version string, normalized_query string, chunk_hash string, chunk_byte_range string, query_intent string, prior_version string, length_exponent double, score double, logprob_yes double, logprob_no double, created_at double"
TASK_CHUNKS = "task_id string, intent string, rank int, y_true double, p_raw double, p_len double, p_intent double, p_cal double"
USAGE = "time string, caller string, query string, mode string, latencyMs double, isCodeQuestion boolean, queried boolean, outcome string, top array<string>"
LOGPROBS = "array<struct<token:string,id:bigint,logprob:double>>"
INTENTS = ("IMPLEMENTATION", "SPECIFICATION", "BUG_DIAGNOSIS", "REFACTOR")
STATUSES = ("VERIFIED", "SYMBOL_NOT_FOUND", "INVALID_LINE_RANGE", "FILE_NOT_FOUND", "PARSE_ERROR", "AMBIGUOUS_COMPLETION", "UNVERIFIED_RAW_TEXT")
