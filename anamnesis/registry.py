"""Named queries; a name can be used once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    oracle: str | None


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}

    def register(self, name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def decorate(fn: QueryFn) -> QueryFn:
            if name in self._queries:
                raise ValueError(f"query {name!r} is already registered")
            self._queries[name] = Query(name, fn, oracle)
            return fn

        return decorate

    def __iter__(self):
        return iter(self._queries.values())

    def __getitem__(self, name: str) -> Query:
        return self._queries[name]

    def __len__(self) -> int:
        return len(self._queries)


REGISTRY = Registry()
register_operator = REGISTRY.register
