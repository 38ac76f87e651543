"""The decorator by which plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable


def registering(queries: dict, oracle: dict) -> Callable:
    """A decorator `query(sql)` that adds a function to `queries` by its name, and its SQL, if any, to `oracle`."""

    def query(sql: str = ""):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query
