"""What goes wrong, and whether trying again can help."""

from __future__ import annotations


class AtlasError(Exception):
    """Anything this package raises on purpose. `context` goes to logs, so it holds no secrets and no personal data."""

    retryable = False

    def __init__(self, message: str, *, context: dict | None = None, retry_after_s: float | None = None):
        super().__init__(message)
        self.message, self.context, self.retry_after_s = message, dict(context or {}), retry_after_s

    def __str__(self) -> str:
        return " ".join([self.message, *(f"{k}={v!r}" for k, v in sorted(self.context.items()))])

    def payload(self) -> dict:
        """As an HTTP body."""
        return {"error": type(self).__name__, "message": self.message, "context": self.context, "retryable": self.retryable}


class ConfigError(AtlasError):
    """Settings or a pack can't be used."""


class SuiteError(AtlasError):
    """A scenario file can't be used."""


class IngestError(AtlasError, ValueError):
    """The input can't be used."""


class UpstreamError(AtlasError):
    """The remote service answered with an error, or not at all."""

    def __init__(self, message: str, *, status: int | None = None, **more):
        super().__init__(message, **more)
        self.status = status
        self.context["status"] = status


class AuthError(UpstreamError):
    """The credentials are refused."""


class BadRequestError(UpstreamError):
    """The request is wrong, or the answer has an unknown shape."""


class RateLimitError(UpstreamError):
    retryable = True


class ServerError(UpstreamError):
    retryable = True


class CallTimeoutError(UpstreamError):
    retryable = True


class TruncatedError(UpstreamError):
    """All tokens were spent before the answer began. A larger limit may help once."""


class GuardrailError(AtlasError):
    """A limit of our own."""


class BudgetExceededError(GuardrailError):
    """The run's money is spent."""


class CircuitOpenError(GuardrailError):
    retryable = True


class StructuredOutputError(AtlasError):
    """An answer that doesn't fit its schema."""

    retryable = True

    def __init__(self, message: str, *, raw: str = "", **more):
        super().__init__(message, **more)
        self.raw = raw[:2000]
