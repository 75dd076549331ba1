"""Values that results depend on, and the tunables that they do not."""

# ---------------------------------------------------------------------------
# Changing any of these changes results.
# ---------------------------------------------------------------------------

# Minimum score of a posting worth reporting.
SCORE_THRESHOLD = 70
# Postings handed to the external scorer per call.
SCORE_BATCH_SIZE = 10
# Postings kept per feed source, and per board of a multi-board source.
MAX_POSTINGS_PER_SOURCE = 50
# Search hits read per query.
MAX_HITS_PER_QUERY = 10
# Pages fetched per run; also the cap of hosts without a configured cap.
PAGE_BUDGET = 20
# Consecutive failures after which a host is served from snippets only.
FAILURES_BEFORE_DEMOTION = 3
# Rows of the top-postings report and of the run-history view.
TOP_POSTINGS = 5
RUN_HISTORY_ROWS = 20
# Retry-After handling in seconds.
RETRY_AFTER_DEFAULT = 20
RETRY_AFTER_MAX = 60
# Calls of the scorer: time limit in seconds, calls per batch, seconds between them, and the
# status codes after which a call is tried again.
CALL_TIME_LIMIT = 300
CALL_ATTEMPTS = 3
CALL_BACKOFF = 30
RETRY_CODES = (429, 502, 503, 504)
# A posting older than this is stale.
FRESH_DAYS = 30
# Score bands of the dashboard.
BAND_HIGH = 80
BAND_MID = 60

DEFAULT_LOCATION = "Remote"
SJS_DEFAULT_LOCATION = "New Zealand"
SJS_POSTING_URL = "https://www.sjs.co.nz/job-seeker/jobs/"
SJS_SUMMARY_SEPARATOR = " — "
ESTIMATED_SUFFIX = " (est.)"
PAY_UNITS = {"hourly": "/hr", "annually": "/yr", "monthly": "/mo"}
WHOLE_DOLLAR_PAY = ["annually", "monthly"]

# Words of the run digest.
DIGEST_RAW = "Raw jobs scraped: "
DIGEST_NEW = "New jobs: "
DIGEST_SCORED = "Jobs scoring >= "
DIGEST_NONE = "No new jobs scored this run."

UNSCRAPABLE_HOSTS = ["linkedin.com", "reddit.com"]
MARK_STATUSES = ["applied", "skipped", "none"]
VERDICTS = ["apply", "review", "skip"]

# Default source configuration; a user overrides whole top-level keys.
DEFAULT_SOURCES = {
    "job_boards": [
        "linkedin.com/jobs",
        "indeed.com",
        "wellfound.com",
        "glassdoor.com",
        "jobstreet.com",
        "onlinejobs.ph",
        "seek.co.nz",
    ],
    "reddit_groups": [
        {"name": "Job boards", "subreddits": ["jobbit", "remotejobs", "WorkOnline"]},
        {"name": "Freelance/gig", "subreddits": ["freelance", "Upwork"]},
        {
            "name": "Community",
            "subreddits": ["forhire", "digitalnomad", "remotework"],
            "extra_terms": "hiring",
        },
    ],
    "scrape_caps": {
        "linkedin.com": 0,
        "reddit.com": 0,
        "glassdoor.com": 6,
        "wellfound.com": 5,
        "indeed.com": 5,
        "jobstreet.com": 4,
        "onlinejobs.ph": 4,
        "seek.co.nz": 4,
    },
    "api_sources": [
        "remotive.com",
        "remoteok.com",
        "arbeitnow.com",
        "sjs.co.nz",
        "greenhouse",
        "lever",
        "adzuna",
    ],
    # Boards per source with many boards; None takes every landed board.
    "ats_boards": None,
    # Limits of a run; None is no limit. ``small_run_limits`` has those of a small deployment.
    "max_postings_per_source": None,
    "max_hits_per_query": None,
    "page_budget": None,
}

# ---------------------------------------------------------------------------
# Tunables: results are the same for any value.
# ---------------------------------------------------------------------------

# Subsets a hot group is split into before its top-k rows are merged.
SPREAD = 64
# Numeric ids per chunk when a neighbour along a global order is looked up.
ID_CHUNK = 1_000_000


def source_config(overrides=None):
    """Default sources with whole top-level keys replaced by ``overrides``."""
    return {**DEFAULT_SOURCES, **(overrides or {})}


def small_run_limits():
    """Limits of a deployment that fetches and scores a few hundred postings a run."""
    return {
        "max_postings_per_source": MAX_POSTINGS_PER_SOURCE,
        "max_hits_per_query": MAX_HITS_PER_QUERY,
        "page_budget": PAGE_BUDGET,
    }
