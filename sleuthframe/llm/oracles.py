"""SQL for the queries of this package that SQL can express."""

ORACLES: dict[str, str] = {}
