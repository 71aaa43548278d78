"""Errors of the vector engine."""


class EngineError(Exception):
    """Any error of the engine."""


class InvalidArgument(EngineError):
    """A parameter is out of its range or unknown."""


class InvalidSchema(EngineError):
    """A source lacks what an index needs."""


class NotFound(EngineError):
    """A table, index or artifact that isn't there."""


class AlreadyExists(EngineError):
    """A name that is taken."""


class Conflict(EngineError):
    """Somebody else published first."""


class Corrupt(EngineError):
    """Stored metadata or data breaks its format."""


class Backend(EngineError):
    """Spark or storage failed."""


class Busy(EngineError):
    """The queue of queries or the build slot is full."""
