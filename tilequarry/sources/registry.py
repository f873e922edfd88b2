"""Names to sources, and the contract that a source keeps."""

from __future__ import annotations

import logging
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


class Source(Protocol):
    """What a source offers: whether it takes a configuration, and its catalog as a frame."""

    def handles(self, config: dict[str, Any]) -> bool: ...

    def catalog(self, spark: SparkSession, config: dict[str, Any]) -> DataFrame: ...


class Registry:
    """Names to classes; a second registration wins with a warning, an unknown name lists the known ones."""

    def __init__(self, kind: str):
        self.kind = kind
        self._known: dict[str, Any] = {}

    def register(self, name: str):
        def add(item):
            if name in self._known:
                log.warning("%s %r is registered again", self.kind, name)
            self._known[name] = item
            return item

        return add

    def resolve(self, name: str) -> Any:
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def all(self) -> dict[str, Any]:
        return dict(self._known)


sources = Registry("source")


class StageError(Exception):
    """A failure of a stage; the cause stays attached."""


class FetchError(StageError):
    pass


class PrepareError(StageError):
    pass


class PackError(StageError):
    pass
