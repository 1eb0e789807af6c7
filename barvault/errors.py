"""Named errors raised by the strict (single request) wrappers.

Batch operators never raise these; they return a ``status`` column instead.
"""


class SeriesNotFound(Exception):
    """The requested candle series is not registered."""


class SeriesExists(Exception):
    """The candle series already covers what was about to be stored."""


class DataNotPresent(Exception):
    """No row answers the request."""


class DataUncertain(Exception):
    """The request matches more than one thing, or nothing that can be told apart."""


class ConcurrentWrite(Exception):
    """A write was overtaken by other writers again and again."""
