"""Errors that the library raises."""


class SnapqueryError(Exception):
    """Base of all errors of the library."""


class SchemaError(SnapqueryError, ValueError):
    """A record declaration or an incoming schema breaks a rule."""


class ColumnNotFound(SnapqueryError, ValueError):
    """A column that the snapshot doesn't have; names are case-sensitive."""


class UnsupportedOperation(SnapqueryError, NotImplementedError):
    """Something that can't be pushed to columns, in a query that is strict."""


class EmptySequenceError(SnapqueryError, ValueError):
    """No elements where at least one is needed."""


class MultipleElementsError(SnapqueryError, ValueError):
    """More elements than the one that is asked for."""


class ClosedSnapshotError(SnapqueryError, RuntimeError):
    """The snapshot has been closed."""
