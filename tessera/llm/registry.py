"""The queries of this subpackage and their SQL, by name."""

from . import decontaminate, html, licenses, mixing, quality, ranking, shards, simhash, suffixes, tokens

MODULES = (simhash, quality, mixing, licenses, shards, tokens, decontaminate, html, ranking, suffixes)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
