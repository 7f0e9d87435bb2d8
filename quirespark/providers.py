"""Models and services that are handed in: layout detection, found tables, formulas, rendering.

A provider is a function. One whose model takes long to load is an object with ``key`` and ``load()``:
the function that ``load`` returns is made once for each worker process and kept.

* layout and tables: ``(content, page_no, width, height)`` to ``(label, confidence, x0, y0, x1, y1)`` or ``(x0, y0, x1, y1)`` rows
* render: ``(content, page_no, (x0, y0, x1, y1))`` to the bytes of a PNG, or None; with a parameter ``scale`` it is told the pixels for a point
* formula: the same to LaTeX, or None
"""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

_made: dict[str, Callable] = {}

# The variables by which model libraries find their files, and the folders below the cache for each.
CACHES = {"HF_HOME": "huggingface", "HUGGINGFACE_HUB_CACHE": "huggingface/hub", "HF_HUB_CACHE": "huggingface/hub", "TORCH_HOME": "torch", "XDG_CACHE_HOME": "", "TIKTOKEN_CACHE_DIR": "tiktoken"}


@dataclass(frozen=True)
class Providers:
    layout: Any = None
    tables: Any = None
    render: Any = None
    formula: Any = None
    #: The folder in which models are looked for; workers set it before they load one.
    cache: str | None = None


def cache_settings(base: str) -> dict[str, str]:
    """What :data:`CACHES` becomes for a folder; ``spark.executorEnv`` takes it as well."""
    return {name: os.path.join(base, folder).rstrip("/") for name, folder in CACHES.items()}


def ready(provider: Any, cache: str | None = None) -> Callable | None:
    if provider is None or not hasattr(provider, "load"):
        return provider
    if provider.key not in _made:
        if cache:
            for name, path in cache_settings(cache).items():
                os.makedirs(path, exist_ok=True)
                os.environ[name] = path
        _made[provider.key] = provider.load()
    return _made[provider.key]


def scaled(provider: Callable, scale: float) -> dict[str, float]:
    """The scale as an argument, for providers that have a parameter of that name."""
    try:
        return {"scale": scale} if "scale" in inspect.signature(provider).parameters else {}
    except (TypeError, ValueError):
        return {}
