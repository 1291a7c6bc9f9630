"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import archive, bpe, langid, lm, mixing, neardup, outliers, sharding, topk, toxicity

_MODULES = (toxicity, neardup, sharding, langid, archive, bpe, mixing, lm, topk, outliers)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
