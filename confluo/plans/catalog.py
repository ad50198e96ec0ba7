"""Registry of the queries over the reference's own operators."""

from . import contract_docs, documents, envelopes, layouts, manifests, merges, nested_trees, nests, placements, projects, reviews, rules, sections, splices, suites, template_trees, texts, upkeep

MODULES = (contract_docs, documents, envelopes, layouts, manifests, merges, nested_trees, nests, placements, projects, reviews, rules, sections, splices, suites, template_trees, texts, upkeep)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
