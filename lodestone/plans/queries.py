"""All queries of the main library, by name."""

from lodestone.plans import document_queries, index_queries, knowledge_queries, layout_queries, ledger_queries, relational_queries, retrieval_queries, service_queries, sheet_queries, vehicle_queries

PAIRS = {**retrieval_queries.PAIRS, **knowledge_queries.PAIRS, **sheet_queries.PAIRS, **relational_queries.PAIRS, **document_queries.PAIRS, **ledger_queries.PAIRS, **index_queries.PAIRS, **vehicle_queries.PAIRS, **service_queries.PAIRS, **layout_queries.PAIRS}
QUERIES = {name: query for name, (query, _) in PAIRS.items()}
SQL = {name: sql for name, (_, sql) in PAIRS.items() if sql}
