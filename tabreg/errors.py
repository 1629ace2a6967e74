"""Typed errors raised where the data cannot be prepared as asked."""

from __future__ import annotations


class TabregError(Exception):
    """Base class."""


class SourceNotFound(TabregError):
    """A source path does not exist."""


class MissingColumns(TabregError):
    """Columns named for a strict drop are absent."""

    def __init__(self, columns):
        self.columns = list(columns)
        super().__init__(f"columns not found: {', '.join(self.columns)}")


class MissingLabel(TabregError):
    """The label column is absent."""


class AllNullColumn(TabregError):
    """A feature column has no value to fit a fill statistic from."""

    def __init__(self, column):
        self.column = column
        super().__init__(f"column {column!r} holds only nulls; no fill value can be fitted")


class TooManyCategories(TabregError):
    """A text column has more distinct values than the one-hot guard allows."""


class DummyNameClash(TabregError):
    """Two one-hot columns (or a dummy and a kept column) would share one name."""


class UnknownModel(TabregError):
    """A model name that the registry does not know."""


class UnsupportedColumn(TabregError):
    """Feature columns whose type is neither a number, text nor boolean."""

    def __init__(self, columns):
        self.columns = dict(columns)
        super().__init__("no encoding for feature columns: " + ", ".join(f"{c} ({t})" for c, t in self.columns.items())
                         + "; drop or cast them")


class DuplicateKeys(TabregError):
    """An exact count cannot be cut because several rows share the key at the cut."""


class RaggedRows(TabregError):
    """CSV rows with more or fewer fields than the header (strict mode)."""
