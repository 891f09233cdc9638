"""Errors of the query language."""


class CypherError(ValueError):
    """A query that can't be read or planned. ``column`` counts from 1; None if no place is to blame."""

    def __init__(self, message: str, column: int | None = None, suggestion: str | None = None):
        super().__init__(message if column is None else f"{message} at column {column}")
        self.column, self.suggestion = column, suggestion
