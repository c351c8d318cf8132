"""All queries of the library, and their SQL."""

from __future__ import annotations

from cuewright.plans import queries_captions, queries_eval, queries_jobs, queries_safety, queries_words

_MODULES = (queries_words, queries_safety, queries_captions, queries_eval, queries_jobs)
QUERIES = {k: f for m in _MODULES for k, f in m.Q.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
