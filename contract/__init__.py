"""Registered queries and their DuckDB counterparts on the driver's tables."""


def load_all() -> None:
    """Import the modules that register queries."""
    from contract import analysis, foundations, serving  # noqa: F401
