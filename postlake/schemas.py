"""Table schemas and the source dimension."""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postlake import rules

ENTRY = """source_key string, title string, description_html string, link string, guid string,
       source_item_id string, pub_date string, categories array<string>, institution string,
       country string, city string, deadline string, duration string, employment_type string,
       apply_url string, source_language string, source_type string, closed boolean"""

JOB = """id string, title string, institution string, country string, city string,
       research_area string, language string, source_language string, original_title string,
       original_description string, description string, apply_url string, source_url string,
       deadline date, posted_at date, employment_type string, duration string,
       tags array<string>, is_active boolean, is_demo boolean, created_at timestamp,
       updated_at timestamp, origin_type string, source_key string, source_name string,
       source_item_id string, content_hash string, first_seen_at timestamp,
       last_seen_at timestamp, last_verified_at timestamp, collection_state string,
       source_type string, canonical_url string, expiry_reason string"""

OBSERVATION = """id string, job_id string, source_key string, source_name string, source_type string,
       source_item_id string, source_url string, apply_url string, source_language string,
       observed_title string, content_hash string, first_seen_at timestamp,
       last_seen_at timestamp, last_verified_at timestamp, is_primary boolean,
       observation_state string, created_at timestamp, updated_at timestamp"""

SOURCE_RUN = """collection_run_id string, message_id string, source_key string, status string,
       mode_used string, items_received long, items_accepted long, items_rejected long,
       jobs_inserted long, jobs_updated long, jobs_unchanged long, jobs_expired long,
       error_code string"""

REQUEST = """id string, query_hash string, keyword string, country string, research_area string,
       language string, deadline string, status string, collection_run_id string,
       requested_at timestamp, started_at timestamp, finished_at timestamp,
       cache_expires_at timestamp, expected_sources int, completed_sources long,
       sources_succeeded long, matching_jobs long, jobs_inserted long, error_code string"""

SOURCE = """source_key string, name string, type string, priority long,
       collection_interval string, institution_owned boolean, default_institution string,
       default_country string, default_city string, hosts array<string>, listing_url string,
       listing_path string, detail_patterns array<string>, paging_parameters array<string>,
       item_pattern string, closed_signals array<string>, max_details int,
       default_language string, default_language_code string, enabled boolean,
       position int"""


def sources_table(spark: SparkSession, sources=rules.SOURCES) -> DataFrame:
    """The source dimension: one row per registered source, small by construction.

    It goes in as an Arrow table, so plans know how small it is. Rows of an RDD have no known size, and a
    join by a key that is fixed for all pages then becomes a product that reads every page once per task.
    """
    rows = [asdict(source) | {"position": position} for position, source in enumerate(sources, 1)]
    return spark.createDataFrame(pa.Table.from_pylist(rows), SOURCE)
