"""Exceptions of the engine."""


class QuernError(Exception):
    """Base class."""


class ParseError(QuernError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"line {line}, column {column}: {message}")
        self.line, self.column = line, column


class CompileError(QuernError):
    """A program that can't be compiled: unsafe, ill-typed or ill-formed."""


class StratificationError(CompileError):
    """A cycle through negation or aggregation."""


class TypeMismatch(CompileError):
    """Operands or columns of different types."""


class ModuleError(CompileError):
    """A module that is missing, private or ambiguous."""


class ConstraintViolation(QuernError):
    """A constraint has rows."""

    def __init__(self, name: str, source: str):
        super().__init__(f"constraint violated: {source}")
        self.name = name


class RecursionLimit(QuernError):
    """A fixpoint or an expansion took more rounds than allowed."""


class UnsupportedEpistemicConstruct(CompileError):
    """A modal construct without a supported meaning."""


class ProbabilityError(QuernError):
    """Bad probabilities, impossible evidence, or an exact answer beyond the limits."""
