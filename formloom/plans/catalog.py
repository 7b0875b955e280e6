"""Imports every query module; importing this registers all queries."""

from formloom.plans import q_clips, q_evidence, q_forms, q_judgment, q_merging, q_passages, q_places, q_records, q_review, q_segments, q_text, q_thai  # noqa: F401
