"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from factorweave.llm import conversation_repair, decontamination, fill_in_middle, html_extraction, media, packing, pii, preferences, records, sharding, simhash, substring_dedup, toxicity

_MODULES = (substring_dedup, media, toxicity, pii, decontamination, preferences, packing, simhash, records, sharding, html_extraction, conversation_repair, fill_in_middle)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
