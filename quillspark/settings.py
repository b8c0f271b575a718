"""Settings from the environment; blank values count as unset."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from .errors import ConfigError
from .operators import cache
from .sources.http_embeddings import http_provider


def read(name: str, default: str, env: Mapping[str, str] | None = None) -> str:
    return (os.environ if env is None else env).get(name, "").strip() or default


def require(name: str, env: Mapping[str, str] | None = None) -> str:
    """A value that must be there. The message names the variable, never a value."""
    value = read(name, "", env)
    if not value:
        raise ConfigError(f"the environment variable {name} is not set")
    return value


@dataclass
class Settings:
    catalog: str
    files: str
    store: str
    embeddings_url: str = ""
    model: str = "words-v1"
    max_age_hours: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "Settings":
        get = lambda name, default="": read(f"QUILLSPARK_{name}", default, env)
        needed = (require(f"QUILLSPARK_{name}", env) for name in ("CATALOG", "FILES", "STORE"))
        return cls(*needed, get("EMBEDDINGS_URL"), get("MODEL", "words-v1"), get("MAX_AGE_HOURS"))

    def providers(self) -> tuple[Callable, Callable]:
        """(for texts, for questions): the server's if an address is set, else words."""
        if not self.embeddings_url:
            return cache.word_provider, cache.word_provider
        return http_provider(self.embeddings_url, self.model), http_provider(self.embeddings_url, self.model, "search_query")
