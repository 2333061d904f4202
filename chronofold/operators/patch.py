"""Patches of nested read-model columns: a chain of edits compiled to one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Patch:
    """Edits of a struct column; ``column()`` is the patched struct. Paths are dotted."""

    def __init__(self, root: str | Column):
        self.now = F.col(root) if isinstance(root, str) else root

    def at(self, path: str) -> Column:
        out = self.now
        for part in path.split("."):
            out = out[part]
        return out

    def _put(self, path: str, value: Column) -> Patch:
        return Patch(self.now.withField(path, value))

    def set(self, path: str, value) -> Patch:
        return self._put(path, value if isinstance(value, Column) else F.lit(value))

    def duplicate(self, path: str, *targets: str) -> Patch:
        out, value = self, self.at(path)
        for t in targets:
            out = out._put(t, value)
        return out

    def increment(self, path: str, by=1) -> Patch:
        return self._put(path, F.coalesce(self.at(path), F.lit(0)) + by)

    def append(self, path: str, value) -> Patch:
        return self._put(path, F.array_append(self.at(path), _lit(value)))

    def append_key(self, path: str, key, value) -> Patch:
        """Puts a key of a map; an existing key is overwritten."""
        return self._put(path, F.map_zip_with(self.at(path), F.create_map(_lit(key), _lit(value)), lambda k, old, new: F.coalesce(new, old)))

    def append_if_missing(self, path: str, value, predicate: Callable[[Column], Column] | None = None) -> Patch:
        old = self.at(path)
        there = F.exists(old, predicate) if predicate else F.array_contains(old, _lit(value))
        return self._put(path, F.when(there, old).otherwise(F.array_append(old, _lit(value))))

    def append_key_if_missing(self, path: str, key, value) -> Patch:
        return self._put(path, F.map_zip_with(self.at(path), F.create_map(_lit(key), _lit(value)), lambda k, old, new: F.coalesce(old, new)))

    def insert(self, path: str, value, index: int | None = None) -> Patch:
        """At an index from 0; without one, or past the end, at the end."""
        old = self.at(path)
        if index is None:
            return self.append(path, value)
        return self._put(path, F.when(F.size(old) <= index, F.array_append(old, _lit(value))).otherwise(F.array_insert(old, index + 1, _lit(value))))

    def insert_if_missing(self, path: str, value, index: int, predicate: Callable[[Column], Column] | None = None) -> Patch:
        old = self.at(path)
        there = F.exists(old, predicate) if predicate else F.coalesce(F.get(old, F.lit(index)) == _lit(value), F.lit(False))
        return self._put(path, F.when(there, old).otherwise(self.insert(path, value, index).at(path)))

    def remove(self, path: str, value, every: bool = True) -> Patch:
        old, v = self.at(path), _lit(value)
        if every:
            return self._put(path, F.array_remove(old, v))
        spot = F.array_position(old, v).cast("int")
        without = F.concat(F.slice(old, F.lit(1), spot - 1), F.slice(old, spot + 1, F.size(old)))
        return self._put(path, F.when(spot > 0, without).otherwise(old))

    def remove_key(self, path: str, key) -> Patch:
        return self._put(path, F.map_filter(self.at(path), lambda k, v: k != _lit(key)))

    def remove_where(self, path: str, predicate: Callable[[Column], Column]) -> Patch:
        return self._put(path, F.filter(self.at(path), lambda x: ~F.coalesce(predicate(x), F.lit(False))))

    def rename(self, path: str, name: str) -> Patch:
        parent = path.rpartition(".")[0]
        return Patch(self._put(f"{parent}.{name}" if parent else name, self.at(path)).now.dropFields(path))

    def delete(self, *paths: str) -> Patch:
        return Patch(self.now.dropFields(*paths))

    def column(self) -> Column:
        return self.now


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
