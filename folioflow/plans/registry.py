"""All registered queries of the engine, by family."""

from folioflow.plans import checks, documents, graphs, indexes, records, reports, retrieval, selections, sources

_FAMILIES = (retrieval, documents, reports, selections, records, graphs, checks, sources, indexes)
QUERIES: dict = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _FAMILIES for k, v in m.ORACLE.items()}
