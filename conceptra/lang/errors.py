"""What can be wrong with a model."""


class ModelError(Exception):
    """Base of all errors about a model."""


class ParseError(ModelError):
    """The text is not in the language."""


class NotFound(ModelError):
    """A name stands for nothing."""


class Ambiguous(ModelError):
    """A bare name belongs to several parents."""


class WrongArity(ModelError):
    """A function, window function or macro has a wrong number of arguments."""


class WrongType(ModelError):
    """An argument is of a wrong kind."""


class CannotInfer(ModelError):
    """An attribute without a value has none to be found."""


class NamesDiffer(ModelError):
    """The parents of a set concept have different attributes."""


class Recursive(ModelError):
    """A definition depends on itself."""


class GenericError(ModelError):
    """Generic parameters do not fit."""


class WrongConcept(ModelError):
    """A concept of another kind is needed."""


class Unsupported(ModelError):
    """It parses, but has no meaning as a query."""
