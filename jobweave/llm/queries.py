"""Registers the queries of this subpackage and the pipeline."""

from __future__ import annotations

import importlib

import corpus_pipeline
from jobweave.plans.registry import query

FAMILIES = ["q_dedup", "q_classify", "q_native", "q_format", "q_spans"]

for family in FAMILIES:
    importlib.import_module(f"jobweave.llm.{family}")

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
