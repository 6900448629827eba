"""Every operator as a query over the given tables, next to the SQL that says
what its result must be."""


def all_checks():
    """``(queries, oracles)`` of all check modules."""
    from checks import evaluation, preparation, quality  # noqa: F401
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
