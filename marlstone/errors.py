"""Errors by class; `exit_code` is what the command line returns for each."""


class MarlstoneError(Exception):
    exit_code = 1


class SchemaError(MarlstoneError):
    """A column is unknown, of the wrong shape, or cannot be compared with a literal."""

    exit_code = 3


class FormatError(MarlstoneError):
    """A file is not what it should be."""

    exit_code = 4


class NotColumnarError(FormatError):
    """A file is not a Parquet file at all."""


class MalformedError(FormatError):
    """A file ends early or contradicts itself."""


class UnsupportedError(FormatError):
    """A file uses a feature that is not supported."""


class UnknownCodeError(FormatError):
    """A file uses a code that is not in the format."""


class TableFormatError(FormatError):
    """A table's metadata is not what it should be."""


class CatalogFormatError(FormatError):
    """A catalog's documents are not what they should be."""


class ContainerFormatError(FormatError):
    """A container of rows is not what it should be."""


class FilterError(MarlstoneError):
    """A filter text cannot be understood."""

    exit_code = 5


class WriteError(MarlstoneError):
    """Rows cannot be written as asked."""


class CapabilityError(MarlstoneError):
    """A dataset does not offer what was required of it."""
