"""Errors that the engine reports as the message of a failed result."""


class SqlError(Exception):
    """A statement cannot be run; the text says why."""


class ParseError(SqlError):
    """The text is not a statement. Carries line and column."""

    def __init__(self, what: str, line: int, column: int) -> None:
        super().__init__(f"Parse error: Line {line}, Col {column}: {what}")


class PermissionDenied(SqlError):
    """The session's user may not do this."""
