"""All queries of the engine and their SQL, by name."""

from quarry.plans import answers, assembly, assets, batch, corpus, indexes, listing, quality, search, streams

_ALL = (search, listing, assets, quality, batch, answers, indexes, assembly, streams, corpus)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _ALL for name, sql in module.ORACLE_SQL.items()}
