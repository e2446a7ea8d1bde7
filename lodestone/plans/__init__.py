"""The registered queries and their SQL."""


def load():
    """(queries, SQL) by name."""
    from lodestone.plans import registry, report_queries, scalar_queries, search_queries, source_queries, store_queries, stream_queries, window_queries, write_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLE_SQL
