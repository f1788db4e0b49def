"""Fixed table layouts. Nothing is inferred from the data."""


def _s(ddl: str) -> str:
    """A layout as a DDL string, which readers take directly."""
    return " ".join(ddl.split())


JOBS = _s("""id string, source_id string, company string, title string, location string, country_code string,
  job_scope string, job_type string, grad_class int, summary string, jd_url string, canonical_jd_url string,
  apply_url string, salary_text string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp,
  status string, content_hash string, created_at timestamp, experience string, education string, deadline string,
  enrich_fail_count int, enrich_checked_at timestamp, confirmed_closed_at timestamp, sponsorship_signal string,
  search_doc array<string>""")
JOB_EVENTS = _s("""event_key string, job_id string, source_id string, event_type string, occurred_at timestamp,
  observed_at timestamp, payload string""")
SOURCES = _s("""id string, company string, source_url string, adapter_name string, crawl_method string,
  regions array<string>, segment string, industry string, enabled boolean, created_at timestamp""")
CRAWL_RUNS = _s("""id string, source_id string, status string, jobs_found int, jobs_created int, jobs_updated int,
  reported_total int, coverage_complete boolean, started_at timestamp, finished_at timestamp, error_message string""")
DISCOVERY_RUNS = _s("""id string, user_id string, query string, city string, company string, job_type string, mode string,
  status string, candidates_found int, jobs_created int, diagnostics string, error_message string,
  created_at timestamp, started_at timestamp, finished_at timestamp""")
PREFERENCES = _s("""user_id string, job_scope string, target_regions array<string>, target_roles array<string>,
  target_locations array<string>, target_keywords array<string>, target_companies array<string>,
  exclude_keywords array<string>, target_industries array<string>, experience_stage string, daily_limit int,
  radar_intensity string, radar_intensity_source string, radar_intensity_updated_at timestamp""")
CANDIDATES = _s("""user_id string, target_roles array<string>, target_locations array<string>, skills array<string>,
  industries array<string>, education array<string>, education_summary string, experience_stage string,
  seniority string, has_en_resume boolean, en_target_roles array<string>, en_target_keywords array<string>,
  en_skills array<string>""")
JOB_ACTIONS = _s("""user_id string, job_id string, action string, reason_code string, snapshot string,
  created_at timestamp, updated_at timestamp""")
EVENTS = _s("id string, user_id string, event string, payload string, created_at timestamp")
OPS_RUNS = _s("module string, run_date date, metrics string, status string, created_at timestamp")
RAW_JOBS = _s("""source_id string, title string, jd_url string, location string, job_type string, summary string,
  apply_url string, salary_text string, posted_at string, experience string, education string, deadline string,
  company string, arrived_seq bigint, _corrupt_record string""")
WATCH_REQUESTS = _s("""user_id string, company string, normalized string, status string,
  matched_source_ids array<string>, created_at timestamp, updated_at timestamp""")
COMPANY_PROFILES = _s("""id string, company string, aliases array<string>, headcount_band string, founded_year int,
  t2_enriched_at timestamp, t3_enriched_at timestamp""")
CYCLES = _s("""id string, company_id string, grad_class int, season string, batch string, event string,
  time_expr_type string, value_text string, month_start int, month_end int, date_start date, date_end date,
  publisher string, url string, verify_status string, valid_until date""")
SNAPSHOTS = _s("source_id string, company string, campus_count int, surge boolean, captured_at timestamp")

TABLES = {
    "jobs": JOBS, "job_events": JOB_EVENTS, "sources": SOURCES, "crawl_runs": CRAWL_RUNS,
    "discovery_runs": DISCOVERY_RUNS, "user_preferences": PREFERENCES, "candidate_profiles": CANDIDATES,
    "job_actions": JOB_ACTIONS, "events": EVENTS, "ops_runs": OPS_RUNS, "raw_jobs": RAW_JOBS,
    "company_watch_requests": WATCH_REQUESTS, "company_profiles": COMPANY_PROFILES,
    "recruitment_cycle_observations": CYCLES, "campus_board_snapshots": SNAPSHOTS,
}
