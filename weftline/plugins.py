"""Extension: extractors, validators and reporters of one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Plugin:
    """Base class; every hook may be left as it is.

    Extractors take documents and give references (path, type, value, line,
    raw, start); validators take the references of a type and add valid,
    skipped, severity, message, suggestion; reporters take a run.
    """

    def __init__(self, name: str):
        self.name = name

    def initialize(self, config: dict) -> None: ...

    def extractors(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return {}

    def validators(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return {}

    def reporters(self) -> dict[str, Callable]:
        return {}

    def before(self, documents: DataFrame) -> None: ...

    def after(self, results: DataFrame) -> None: ...
