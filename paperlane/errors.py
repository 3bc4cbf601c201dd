"""What can be wrong with a plan; what is wrong with data becomes a row that names one of these."""

from __future__ import annotations


class CaptureError(Exception):
    """Base of all errors of this package."""


class TransientError(CaptureError):
    """Trying again may help."""


class PermanentError(CaptureError):
    """Trying again can't help."""


class SourceUnreadable(PermanentError):
    """A source can't be read, or not by this reader."""


class SchemaMismatch(SourceUnreadable):
    """A required column is missing."""


class AmbiguousHeader(SchemaMismatch):
    """A header fits two columns, or a column two headers."""


class Configuration(PermanentError):
    """Options, schemas, profiles or paths that can't be used."""
