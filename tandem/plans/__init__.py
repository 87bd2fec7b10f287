"""Study views and the registered queries."""


def load() -> None:
    """Imports all query modules, which register themselves."""
    from tandem.plans import aggregates, effects, exprs, joins, ranking, sampling  # noqa: F401
