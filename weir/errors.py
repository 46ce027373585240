"""Errors that are raised before a pipeline runs, or when its data break a rule."""

from __future__ import annotations


class WeirError(Exception):
    """Base of all errors of this library."""


class ConfigError(WeirError):
    """The YAML or a schema file breaks a rule."""


class AlignmentError(ConfigError):
    """Partitions and buckets differ."""


class KeyMismatchError(ConfigError):
    """An input's key is not the output's key."""


class SqlError(WeirError):
    """The statement is not one that a pipeline can run."""


class BindError(WeirError):
    """Names or types of the statement don't fit the inputs or the output."""


class DataError(WeirError):
    """Rows break a rule of an operator (keys of a dimension, row kinds, payloads)."""


class TableError(WeirError):
    """A keyed table or its snapshots can't be used as asked."""


class ConflictError(TableError):
    """Another writer published the snapshot first."""
