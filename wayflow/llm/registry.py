"""Queries and SQL of all training-data operators."""

from __future__ import annotations

from . import compaction, exact_dedup, fill_middle, image_copies, language_id, late_days, mixing, ngram_join, packing, quality_crf, repair_shards, secrets, url_rules

MODULES = (exact_dedup, language_id, secrets, quality_crf, repair_shards, packing, mixing, ngram_join, compaction, image_copies, url_rules, late_days, fill_middle)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
