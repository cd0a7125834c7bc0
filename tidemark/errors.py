"""Errors of tables and transactions."""

from __future__ import annotations


class TableError(Exception):
    """Any error of this library; names the table where it is known."""

    def __init__(self, message: str, table: str | None = None) -> None:
        super().__init__(f'table "{table}": {message}' if table else message)
        self.table = table


class DuplicateTable(TableError):
    pass


class TableNotRegistered(TableError):
    pass


class InvalidName(TableError):
    pass


class PrimaryNotUnique(TableError):
    pass


class DuplicateIndex(TableError):
    pass


class ReservedPrefix(TableError):
    pass


class ReservedColumn(TableError):
    """A schema uses a name that the engine keeps for itself."""


class UnknownIndex(TableError):
    pass


class TransactionClosed(TableError):
    pass


class NotLockedForWriting(TableError):
    pass


class RevisionNotEqual(TableError):
    pass


class ObjectNotFound(TableError):
    pass
