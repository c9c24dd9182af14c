"""Schemas of the native records and of the canonical tables, as DDL."""

# ---- native records ---------------------------------------------------------------
ANNOTATION = "struct<duration:double,timestamps:array<array<double>>,sentences:array<string>>"
STATUTE = "struct<article_id:string,law_name:string,crime_category:string,chapter:string,content:string>"
JUDGMENT = ("struct<case_id:string,court:string,verdict_date:string,crime_category:string,related_articles:array<string>,"
            "facts:string,legal_reasoning:string,verdict:string,content:string,source_file:string>")
ESSAY = "struct<source:string,title:string,content:string>"
CASE = ("struct<video_id:string,ground_truth:string,predicted:string,correct:boolean,confidence:double,rcons:double,rlegal:double,"
        "rlegal_gt:double,rcost:double,duration:double,escalation_score:double,total_turns:bigint,n_uca_sentences:bigint,"
        "conflict_type:string,event_category:string,is_convergent:boolean,is_anomaly_gt:boolean,is_anomaly_pred:boolean,"
        "anomaly_correct:boolean,anomaly_gated:boolean,gt_is_crime:boolean,gt_is_non_crime:boolean,pred_is_crime:boolean,"
        "pred_is_non_crime:boolean,is_non_crime_anomaly:boolean>")
JUDGE_RESULT = ("struct<judge_model:string,q_scores:map<string,double>,q_norm:map<string,double>,q_max:map<string,double>,"
                "overall:double,feedback:string>")
HUMAN = "sample_idx bigint, video_id string, model string, q_key string, score double"
CUES = ("struct<applicable_articles:array<string>,visual_mappings:array<struct<visual_cue:string,legal_element:string,"
        "evidence_type:string,notes:string>>>")

# ---- canonical tables ---------------------------------------------------------------
SEGMENTS = "video_id string, seg_idx bigint, start_s double, end_s double, description string, start_frame int, end_frame int"
SNIPPETS = "video_id string, idx bigint, start_frame int, end_frame int, score double, illumination double, occlusion double"
AGENT_REPORTS = ("case_id string, agent string, role string, pos int, category string, confidence double, frame_refs array<int>, "
                 "escalation_start_frame int, escalation_score double, video_fps double, mil_category string, mil_confidence double, "
                 "vlm_used boolean, rag_match_ratio double, n_pre int, n_post int, has_causal_chain boolean, env_contribution double, rlegal double")
CORPUS = "doc_id string, layer string, case_id string, article_id string, category string, content string"
POSTINGS = "doc_id string, term string, tf bigint"
JUDGE_SCORES = "item_id string, model string, judge string, q_key string, raw double, max double"
HUMAN_SCORES = "item_id string, model string, rater string, q_key string, raw double"
