"""Queries of this subpackage and the SQL they must agree with."""

from . import (
    queries_bpe,
    queries_language,
    queries_minhash,
    queries_mixing,
    queries_neighbours,
    queries_pii,
    queries_quality,
    queries_runs,
    queries_search,
    queries_tokens,
    queries_toxicity,
    queries_trie,
    queries_urls,
)

_PARTS = (queries_mixing, queries_toxicity, queries_quality, queries_language, queries_tokens, queries_urls, queries_bpe, queries_neighbours, queries_search, queries_minhash,
          queries_runs, queries_trie, queries_pii)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
