"""Layer schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_MONEY = T.DecimalType(10, 2)

# Unified posting record shared by every feed.
JOBS_RAW = T.StructType(
    [
        T.StructField("job_id", _TEXT),
        T.StructField("url", _TEXT),
        T.StructField("title", _TEXT),
        T.StructField("company", _TEXT),
        T.StructField("location", _TEXT),
        T.StructField("description", _TEXT),
        T.StructField("snippet", _TEXT),
        T.StructField("salary_min", _MONEY),
        T.StructField("salary_max", _MONEY),
        T.StructField("salary_text", _TEXT),
        T.StructField("job_type", _TEXT),
        T.StructField("posted_date", _TEXT),
        T.StructField("work_model", _TEXT),
        T.StructField("department", _TEXT),
        T.StructField("company_size", _TEXT),
        T.StructField("qualifications", _TEXT),
        T.StructField("h1b_sponsored", _TEXT),
        T.StructField("is_new_grad", _TEXT),
        T.StructField("category", _TEXT),
        T.StructField("scraped_at", T.TimestampNTZType()),
        T.StructField("source", _TEXT),
    ]
)

# Longest text per column that a store with fixed widths takes; keys are never shortened.
MAX_LENGTHS = {
    "title": 500, "company": 500, "location": 500, "description": 15_000_000,
    "snippet": 5000, "salary_text": 500, "job_type": 200, "posted_date": 50, "work_model": 100,
    "department": 200, "company_size": 100, "qualifications": 15_000_000, "category": 200, "source": 200,
}

REQUIRED_JOB_COLUMNS = ["job_id", "title", "company", "location", "salary_min", "salary_max", "h1b_sponsor"]
