"""Schemas of the tables, as Spark DDL. Nothing is inferred on read."""

SITE = "struct<label:string,base_url:string,platform:string>"
CATEGORY_COUNT = "struct<category:string,n:bigint>"
LISTING = (
    "external_id string, url string, title string, price_amount double, price_currency string, "
    "seller string, location string, description string"
)
CARD = "external_id string, url string, title string, price_amount double, price_currency string, platform string"
PAGE = "page_id bigint, url string, html string"
PLATFORM = "platform_id bigint, name string, base_url string, antibot_rating int, default_mode string, active boolean"
MODEL_VERSION = (
    "model_version_id bigint, agent string, model_name string, prompt_version string, prompt_hash string, "
    "topology string, params map<string,string>, created_at timestamp, is_active boolean"
)
RUN_PARAMS = (
    "struct<seeds:array<string>,terms:bigint,target_categories:array<string>,sites:array<string>,depth:string,"
    "mode:string,mode_b:string,generated_terms:array<string>>"
)
RUN_STATS = (
    "struct<terms:bigint,collected:bigint,scored:bigint,alertes:bigint,mode_b:boolean,extractor_stale:boolean,"
    "repair_ok:boolean,candidate_id:bigint,duree_s:double,etapes:struct<"
    "expand:struct<categories:array<string>,termes:bigint>,"
    "exploration:struct<sites:map<string,bigint>,profondeur:string>,"
    "collecte:struct<annonces:bigint>,"
    f"scoring:struct<scorees:bigint,alertes:bigint,par_categorie:array<{CATEGORY_COUNT}>>>>"
)
RUN_SNAPSHOT = f"struct<platform:string,base_url:string,depth:string,sites:array<{SITE}>>"
RUN = (
    "run_id bigint, mode string, trigger string, status string, "
    f"params {RUN_PARAMS}, stats {RUN_STATS}, config_snapshot {RUN_SNAPSHOT}, "
    "error string, started_at timestamp, finished_at timestamp"
)
STRUCTURED = "struct<location:string,source:string,source_platform_tag:string>"
OBSERVATION = (
    "platform string, external_id string, run_id bigint, url string, title string, description string, "
    f"price_amount double, price_currency string, seller_label string, structured {STRUCTURED}, "
    "content_hash string, observed_at timestamp, seq bigint"
)
SCORE = (
    "score_id bigint, listing_id bigint, run_id bigint, model_version_id bigint, category string, "
    "suspicion_score decimal(4,3), category_breakdown map<string,double>, rationale string, "
    "rag_refs array<string>, scored_at timestamp"
)
FEEDBACK = (
    "feedback_id bigint, listing_id bigint, score_id bigint, investigator_ref string, decision string, "
    "category_corrected string, comment string, decided_at timestamp"
)
INGESTED = "feedback_id bigint, ingested_at timestamp"
AUDIT = (
    "seq bigint, run_id bigint, listing_id bigint, actor string, action string, detail string, "
    "created_at string, prev_hash string, entry_hash string"
)
EXTRACTOR_VERSION = (
    "version_id bigint, platform string, selectors map<string,string>, status string, source string, "
    "repair_history string, validation string, created_at timestamp, decided_at timestamp, decided_by string"
)
RULE = "title string, category string, source string, url string, text string"
EVAL_AD = (
    "id bigint, platform string, title string, description string, price bigint, currency string, "
    "seller string, location string"
)
EVAL_LABEL = "struct<suspect:boolean,categorie:string,difficulte:string,piege:boolean,leurre_categorie:string>"
EVAL_RESULT_COLUMNS = (
    "llm_score double, llm_category string, kw_flag boolean, kw_category string, rag_used boolean, "
    "rag_refs array<string>"
)
EVAL_RESULT = f"struct<{EVAL_RESULT_COLUMNS}>"
THOUGHT = "struct<eval:string,memory:string,next_goal:string>"
SESSION = (
    "chain string, started_at timestamp, result string, start_url string, allowed_domains array<string>, "
    "max_steps int, model string, prompt_version string, prompt_hash string, "
    f"trace struct<urls:array<string>,actions:array<string>,thoughts:array<{THOUGHT}>>"
)
OPERATIONAL_TABLES = {
    "runs": RUN,
    "observations": OBSERVATION,
    "scores": SCORE,
    "feedback": FEEDBACK,
    "ingested": INGESTED,
    "audit_log": AUDIT,
}
CONFIGURATION_TABLES = {
    "platforms": PLATFORM,
    "model_versions": MODEL_VERSION,
    "extractor_versions": EXTRACTOR_VERSION,
}
