"""What the engine raises."""


class EngineError(Exception):
    """Base of all errors."""


class NotFound(EngineError):
    pass


class Conflict(EngineError):
    pass


class Invalid(EngineError):
    pass


class EmbeddingDimension(Invalid):
    pass


class Upstream(EngineError):
    """A model provider failed."""
