"""Converters by name, in order of priority: the first that accepts a file takes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Converter:
    """``accepts(ext, mime)`` is a column; ``run(docs, options)`` returns a ``Conversion``, whose documents need ``doc_id`` and ``markdown`` only.

    ``docs`` has ``content``, unless ``opens`` says that ``run`` opens the files of a listing itself, by ``options["opener"]``.
    """

    name: str
    accepts: Callable[[Column, Column], Column]
    run: Callable
    #: Lower comes first; of equals the one that was registered last.
    priority: float = 0.0
    opens: bool = False
    #: The endings of names that are read where only Spark can open files; none: all files are.
    endings: tuple[str, ...] = ()


CONVERTERS: dict[str, Converter] = {}


def register(converter: Converter) -> None:
    """Puts a converter in its place; one of the same name is replaced."""
    others = [c for c in CONVERTERS.values() if c.name != converter.name]
    ordered = sorted([converter, *others], key=lambda c: c.priority)
    CONVERTERS.clear()
    CONVERTERS.update({c.name: c for c in ordered})


def routed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``converter``; files that nothing takes are left out."""
    out = F
    for c in CONVERTERS.values():
        out = out.when(c.accepts(F.col("ext"), F.col("mime")), c.name)
    return docs.withColumn("converter", out).where("converter is not null")
