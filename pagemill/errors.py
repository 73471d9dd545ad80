"""What may go wrong for a reason that a user can do something about."""


class PagemillError(Exception):
    """Any of these."""


class AnalysisError(PagemillError):
    """The source cannot be read as lines."""


class NoTextError(AnalysisError):
    """The source has no text."""


class PackageError(PagemillError):
    """Returned files cannot be read or matched."""


class BlockedError(PagemillError):
    """The issues found stand against an output."""


class StoreError(PagemillError):
    """The store is not as this code needs it."""
