"""What a statement can fail with; ``Engine.execute`` turns these into a failed ``Result``."""


class EngineError(Exception):
    """Any failure of a statement that is the statement's own fault."""


class SyntaxFault(EngineError):
    """The text is not a statement of the dialect."""


class NameFault(EngineError):
    """A name is unknown, ambiguous or taken."""


class TypeFault(EngineError):
    """A value or column has the wrong type."""


class ConflictFault(EngineError):
    """Another writer came first."""


class ConstraintFault(EngineError):
    """A write would break a constraint."""
