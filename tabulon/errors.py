"""Errors raised for requests that can never succeed."""


class InvalidRequest(ValueError):
    """The request names a column, operation or value the operator does not accept."""


class EmptyInput(ValueError):
    """The operator needs rows and the input has too few."""
