"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """(queries, SQL, decorator that registers a query under its name)."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


# pieces of SQL that say what the column functions of `functions.text` say
def normal(c: str) -> str:
    """normalize_text"""
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def spaces(c: str) -> str:
    """normalize_spaces"""
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def entity_key(c: str) -> str:
    """entity_key"""
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '_', 'g'), '_')"


def alpha(c: str) -> str:
    """alpha_tokens"""
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: regexp_matches(w, '[A-Za-z]')))"
