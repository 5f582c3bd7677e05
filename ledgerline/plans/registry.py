"""Named queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return register


def with_parts(*ctes: str, body: str, recursive: bool = False) -> str:
    """One statement from shared common table expressions and a body."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()
