"""The registered queries, each next to the SQL that says the same."""

from corpusloom.catalog import adapted, corpus, files, landings, repositories, scores, streams, tokens, vocabularies

_MODULES = (corpus, vocabularies, tokens, scores, repositories, streams, files, adapted, landings)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
