"""Errors that callers can act on."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all expected errors."""


class ConfigError(EngineError):
    """A setting or the catalog file is not valid."""


class NotFound(EngineError):
    """A repository, branch, file or index does not exist."""


class NotPermitted(EngineError):
    """A source refused access."""


class Unreadable(EngineError):
    """A file is too large to be read, or binary."""


class RateLimited(EngineError):
    """A source asks to come back later; reset_at is its time, if it told one."""

    def __init__(self, message: str, reset_at: float | None = None):
        super().__init__(message)
        self.reset_at = reset_at


class ModelMismatch(EngineError):
    """The index was built with another embedding model."""


class EmbeddingsUnavailable(EngineError):
    """The embedding provider gives no vectors."""


#: What a status stands for, once it is no rate limit.
BY_STATUS: dict[int, tuple[type[EngineError], str]] = {
    401: (NotPermitted, "the token is missing, expired or revoked: {where}"),
    403: (NotPermitted, "the token may not read {where}"),
    404: (NotFound, "not found, or not visible to the token: {where}"),
    409: (NotFound, "the repository is empty: {where}"),
}


def tells_of_rate_limit(status: int | None, message: str, headers: dict[str, str]) -> bool:
    """429 always; 403 if a counter is used up or the text says so."""
    used_up = headers.get("x-ratelimit-remaining") == "0" or "rate limit" in message.lower()
    return status == 429 or (status == 403 and used_up)


def from_status(status: int | None, message: str = "", headers: dict[str, str] | None = None, where: str = "") -> EngineError:
    """The error that stands for an HTTP answer of a source."""
    headers = headers or {}
    if tells_of_rate_limit(status, message, headers):
        reset = headers.get("x-ratelimit-reset", "")
        return RateLimited(f"rate limit reached at {where}", float(reset) if reset else None)
    kind, text = BY_STATUS.get(status or 0, (EngineError, "{where}: {message}"))
    return kind(text.format(where=where, message=message or "unknown error"))


def is_rate_limit(error: BaseException) -> bool:
    """Whether an error is a RateLimited, also one raised inside a task, which Spark hands on as text."""
    return isinstance(error, RateLimited) or "quillspark.errors.RateLimited" in str(error)


def short(error: BaseException) -> str:
    """One line that tells a person what happened."""
    if isinstance(error, EngineError):
        return str(error)
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    inside = [x for x in lines if "Error" in x.split(":")[0] or x.startswith("quillspark.errors.")]
    return (inside[-1:] or lines[:1] or [type(error).__name__])[0]
