"""Request handlers for an HTTP front end: validation, status codes and payloads.

They are plain functions from a request body to (status, body); any web framework can
mount them.  This package itself opens no port.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from rankloom import __version__
from rankloom.plans.engine import Engine
from rankloom.runtime import scratch_scope

Response = tuple[int, dict[str, Any]]
EngineSource = Callable[[], Engine]

SEARCH_K = (10, 100)  # default, maximum
ASK_K = (5, 50)


def _checked(body: dict[str, Any], k_limits: tuple[int, int]) -> tuple[str, int]:
    query, k = body.get("query"), body.get("k", k_limits[0])
    if not isinstance(query, str) or not query:
        raise ValueError("query must be a non-empty string")
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= k_limits[1]:
        raise ValueError(f"k must be an integer in 1..{k_limits[1]}")
    return query, k


def _guarded(run: Callable[[], dict[str, Any]]) -> Response:
    try:
        return 200, run()
    except ValueError as error:
        return 422, {"detail": str(error)}
    except FileNotFoundError:
        return 503, {"detail": "The corpus is not loaded; build the dataset first."}


def root() -> Response:
    return 200, {"name": "rankloom", "version": __version__, "docs": "/docs"}


def health(engine: EngineSource) -> Response:
    try:
        loaded = engine().loaded
    except FileNotFoundError:
        loaded = False
    return 200, {"status": "ok", "corpus_loaded": loaded}


def search(body: dict[str, Any], engine: EngineSource) -> Response:
    def run() -> dict[str, Any]:
        query, k = _checked(body, SEARCH_K)
        start = time.perf_counter()
        loaded = engine()
        with scratch_scope(loaded.spark):
            hits = loaded.search(query, k).orderBy("rank").collect()  # at most k rows
        names = ("chunk_id", "doc_id", "text", "score", "retriever")
        return {"results": [{name: hit[name] for name in names} for hit in hits],
                "latency_ms": (time.perf_counter() - start) * 1000.0}

    return _guarded(run)


def ask(body: dict[str, Any], engine: EngineSource) -> Response:
    def run() -> dict[str, Any]:
        query, k = _checked(body, ASK_K)
        loaded = engine()
        with scratch_scope(loaded.spark):
            answer = loaded.ask(query, k, bool(body.get("faithfulness", False))).first()
        fields = answer.asDict(recursive=True)
        fields.pop("qid")
        return fields

    return _guarded(run)
