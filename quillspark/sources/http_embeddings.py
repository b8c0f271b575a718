"""An embedding provider over HTTP: POST of {model, input: [texts]} that answers {embeddings: [...]}.

It is a plain function of a list of texts, so cache.embed calls it inside tasks, batch by batch, for the
texts that the cache lacks. Servers that only know the older endpoint, {model, prompt} -> {embedding}, are
asked text by text; which one a server has is found out by the first call.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np

from ..errors import EmbeddingsUnavailable

TIMEOUT = 120.0
#: Models that are trained with the name of the task in front of a text.
PREFIXED = re.compile("nomic", re.I)


def _post(where: str, model: str, body: dict, timeout: float) -> dict | None:
    """The answer's JSON object; None if the server has no such endpoint."""
    try:
        asked = urllib.request.Request(where, json.dumps(body).encode(), {"content-type": "application/json"})
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            told = json.loads(got.read())
    except urllib.error.HTTPError as e:
        said = e.read(300).decode(errors="replace")
        if e.code == 404 and "model" in said.lower():
            raise EmbeddingsUnavailable(f"{where} does not have the model {model}; pull it there first") from e
        if e.code == 404:
            return None
        raise EmbeddingsUnavailable(f"{where} answered {e.code} for the model {model}: {said}") from e
    except TimeoutError as e:
        raise EmbeddingsUnavailable(f"{where} did not answer within {timeout:g} s") from e
    except urllib.error.URLError as e:
        raise EmbeddingsUnavailable(f"{where} can't be reached: {e.reason}") from e
    except ValueError as e:
        raise EmbeddingsUnavailable(f"{where} answered with something that is no JSON") from e
    return told if isinstance(told, dict) else {}


def http_provider(url: str, model: str, task: str = "search_document", timeout: float = TIMEOUT) -> Callable[[list[str]], np.ndarray]:
    """texts -> vectors. task: search_document for what is indexed, search_query for questions."""
    base = url.rstrip("/")
    front = f"{task}: " if PREFIXED.search(model) else ""
    older = False

    def provide(texts: list[str]) -> np.ndarray:
        nonlocal older
        if not texts:
            return np.zeros((0, 0), np.float32)
        asked = [front + (t or "") for t in texts]
        told = None if older else _post(f"{base}/api/embed", model, {"model": model, "input": asked}, timeout)
        if told is not None:
            vectors = told.get("embeddings")
        else:
            older = True
            each = [_post(f"{base}/api/embeddings", model, {"model": model, "prompt": t}, timeout) for t in asked]
            if None in each:
                raise EmbeddingsUnavailable(f"{base} has no endpoint for embeddings")
            vectors = [x["embedding"] for x in each if x.get("embedding")]
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise EmbeddingsUnavailable(f"{base} gave {len(vectors) if isinstance(vectors, list) else 'no'} vectors for {len(texts)} texts")
        return np.asarray(vectors, np.float32)

    return provide
