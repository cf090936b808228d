"""Errors of sources and scans."""


class SheafError(Exception):
    pass


class NotInFormat(SheafError):
    """The bytes are not in the opener's format; another may try."""


class UnknownFormat(SheafError):
    """No opener takes the file."""


class InvalidScanType(SheafError):
    """A typed read of a cell of another type."""
