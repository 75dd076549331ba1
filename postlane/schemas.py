"""Schemas of the relations that jobs read and write."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(name, T.StringType()) for name in names]


POSTING_COLUMNS = [
    "title",
    "company",
    "location",
    "url",
    "description",
    "posted_date",
    "source",
    "salary",
]
POSTING = T.StructType(_strings(*POSTING_COLUMNS))

# One landed payload per fetch; `fetch_no` orders the fetches of a source and board.
LANDED_FEED = T.StructType(
    _strings("source", "board")
    + [T.StructField("fetch_no", T.LongType())]
    + _strings("payload")
)

# Numbers are read as text and cast later: a quoted number would be NULL otherwise.
SCORED = T.StructType(
    _strings("title", "company", "url", "location", "salary", "score", "verdict")
    + [
        T.StructField("match_reasons", T.ArrayType(T.StringType())),
        T.StructField("red_flags", T.ArrayType(T.StringType())),
    ]
    + _strings("suggested_angle", "source")
)

SEARCH_PLAN = T.StructType(
    [
        T.StructField(name, T.ArrayType(T.StringType()))
        for name in ("target_roles", "key_skills", "search_queries")
    ]
)

STATE = T.StructType(
    _strings("dedup_key", "url", "title", "company", "source", "location", "salary")
    + [T.StructField("score", T.DoubleType())]
    + _strings("verdict", "data", "first_seen", "last_seen")
    + [
        T.StructField(name, T.LongType())
        for name in (
            "runs_seen",
            "first_seen_run",
            "last_seen_run",
            "last_scored_run",
            "first_phase",
            "first_batch",
            "first_seq",
        )
    ]
)
