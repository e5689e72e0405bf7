"""The corpus operators' queries and their SQL, gathered from the modules."""

from __future__ import annotations

from linkspark.llm import chunks, decontaminate, jaccard, katz, language, mixing, pii, quality, suffix, warc

MODULES = [quality, pii, decontaminate, suffix, katz, mixing, chunks, warc, jaccard, language]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
