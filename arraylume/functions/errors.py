"""Errors raised while a plan is built or run."""


class ArrayError(Exception):
    """Base of all errors of this package."""


class ExpressionNotSupportedError(ArrayError):
    """An element expression uses something that arrays don't offer.

    node: what was used; fragment: where; allowed: what can be used instead."""

    def __init__(self, node: str, fragment: str, allowed: str) -> None:
        super().__init__(f"{node} is not supported in {fragment!r}; use {allowed}")
        self.node, self.fragment, self.allowed = node, fragment, allowed


class BackendNotSupportedError(ArrayError):
    """The operation can't run on the backend asked for."""

    def __init__(self, backend: str, operation: str, supported: str) -> None:
        super().__init__(f"{operation} does not run on {backend}; use {supported}")
        self.backend, self.operation, self.supported = backend, operation, supported


class BackendUnavailableError(ArrayError):
    """The backend asked for isn't there; explicit choices never fall back."""


class MemoryBudgetExceededError(ArrayError):
    """The work doesn't fit the memory budget and may not be cut into chunks."""

    def __init__(self, required: int, budget: int) -> None:
        super().__init__(f"{required} bytes are needed; the budget is {budget}")
        self.required, self.budget = required, budget


class CompilationError(ArrayError):
    """A plan could not be analysed."""


class BufferMismatchError(ArrayError):
    """Two datasets of different sessions were combined."""
