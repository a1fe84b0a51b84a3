"""Errors that the front-end raises before a DataFrame exists."""


class EngineError(ValueError):
    """Base of the errors below."""


class ParseError(EngineError):
    """Text that the grammar doesn't take."""


class UnknownRelation(EngineError):
    """A relation that the catalog doesn't have."""


class UnknownAttribute(EngineError):
    """A name that no input has, or that several have."""


class TypeMismatch(EngineError):
    """Operands whose types don't go together."""
