"""Declared schemas and fixed vocabularies."""

from __future__ import annotations

# The job states that end a job.
TERMINAL_JOB_STATUSES = ("COMPLETED", "FAILED", "CANCELLED")

PAGE_SNAPSHOT = "url string, html string, status_code int, content_type string, error string"
ROBOTS = "host string, status int, body string"
LINK_JOB = "job_id string, source_url string, target_urls array<string>, depth int"
BROKEN_LINKS = (
    "job_id string, source_url string, broken_url string, anchor_text string, status_code int, "
    "error_type string, error_message string, depth int, discovered_at timestamp")
