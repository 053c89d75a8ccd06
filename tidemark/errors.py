"""Errors that stop a driver-side step; errors of single rows are columns instead."""


class TidemarkError(Exception):
    """Base of all."""


class SourceError(TidemarkError):
    """A source cannot be read at all."""


class ExportError(TidemarkError):
    """There is nothing to write, or it cannot be written."""


class CheckpointError(TidemarkError):
    """A saved checkpoint is malformed."""


class ProviderError(TidemarkError):
    """A provider gave up after its retries."""


class IllegalTransition(TidemarkError):
    """An event is not legal in the current state."""
