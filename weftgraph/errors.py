"""What can go wrong, by kind."""


class GraphError(Exception):
    """Any error of this library."""


class NotFound(GraphError, KeyError):
    """An unknown schema, alias, field, node or edge."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class Invalid(GraphError, ValueError):
    """A request that contradicts the model or the query."""


class TypeMismatch(Invalid, TypeError):
    """A value of the wrong type."""


class AlreadyExists(Invalid):
    """A name that is taken."""


class Unsupported(GraphError, NotImplementedError):
    """Understood, but not offered."""


class ParseError(Invalid):
    """A statement that can't be read."""
