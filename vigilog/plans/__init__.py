"""Named queries over the shared tables, each next to the SQL that checks it."""


def load_queries():
    """All registered queries and their SQL."""
    from vigilog.plans import analysis, explain_queries, fact_queries, feature_queries, knowledge_queries, label_queries, model_queries, normalize_queries, report_queries, source_queries, supervised_queries  # noqa: F401
    from vigilog.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
