"""Errors of this library."""


class EvenkeelError(Exception):
    """Base of all errors raised here."""


class MetadataError(EvenkeelError):
    """Columns or keys that a check needs are not there."""


class QueryExecutionError(EvenkeelError):
    """A source could not run a query."""


class TypeConversionError(EvenkeelError):
    """A column has no canonical text."""
