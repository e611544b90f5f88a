"""Typing information of columns and tables, apart from any data."""

from __future__ import annotations

import copy
import json

from ..errors import ColumnNotPresentError, DuplicateTagsWarning, StandardTagsChangedWarning
from ..functions import logical_types as L
from .registry import TypeSystem, type_system, warn

INDEX, TIME_INDEX = "index", "time_index"


def tag_set(tags) -> set[str]:
    if tags is None:
        return set()
    tags = {tags} if isinstance(tags, str) else tags
    if not isinstance(tags, (set, list, tuple, frozenset)) or not all(isinstance(t, str) for t in tags):
        raise TypeError("semantic tags must be a string or a set or list of strings")
    return set(tags)


class ColumnSchema:
    """A column's logical type, semantic tags, description, origin and metadata."""

    def __init__(self, logical_type=None, semantic_tags=None, use_standard_tags: bool = False, description: str | None = None, origin: str | None = None, metadata: dict | None = None):
        if description is not None and not isinstance(description, str):
            raise TypeError("a description must be a string")
        if origin is not None and not isinstance(origin, str):
            raise TypeError("an origin must be a string")
        if metadata is not None and not isinstance(metadata, dict):
            raise TypeError("metadata must be a dict")
        if use_standard_tags and logical_type is None:
            raise ValueError("standard tags need a logical type")
        self.logical_type = type_system.instance(logical_type) if logical_type is not None else None
        self.use_standard_tags, self.description, self.origin, self.metadata = use_standard_tags, description, origin, dict(metadata or {})
        self.semantic_tags = tag_set(semantic_tags) | (self.standard_tags if use_standard_tags else set())

    @property
    def standard_tags(self) -> set[str]:
        return set(self.logical_type.standard_tags) if self.logical_type else set()

    @property
    def custom_tags(self) -> set[str]:
        return self.semantic_tags - self.standard_tags - {INDEX, TIME_INDEX}

    def _is(self, *types) -> bool:
        return isinstance(self.logical_type, types)

    @property
    def is_numeric(self) -> bool:
        return "numeric" in self.standard_tags

    @property
    def is_categorical(self) -> bool:
        return "category" in self.standard_tags

    @property
    def is_datetime(self) -> bool:
        return self._is(L.Datetime)

    @property
    def is_boolean(self) -> bool:
        return self._is(L.BooleanNullable)

    @property
    def is_natural_language(self) -> bool:
        return self._is(L.NaturalLanguage)

    @property
    def is_ordinal(self) -> bool:
        return self._is(L.Ordinal)

    def __eq__(self, other) -> bool:
        fields = ("logical_type", "semantic_tags", "use_standard_tags", "description", "origin", "metadata")
        return isinstance(other, ColumnSchema) and all(getattr(self, f) == getattr(other, f) for f in fields)

    def __repr__(self) -> str:
        return f"<ColumnSchema (Logical Type = {self.logical_type}) (Semantic Tags = {sorted(self.semantic_tags)})>"

    def copy(self) -> ColumnSchema:
        return copy.deepcopy(self)

    def with_tags(self, change: str, tags, name: str = "") -> ColumnSchema:
        """A copy with tags added, removed or set; "reset" leaves the standard ones alone."""
        out, tags = self.copy(), tag_set(tags)
        if tags & {INDEX, TIME_INDEX} and change in ("add", "set"):
            raise ValueError(f"the tag '{sorted(tags & {INDEX, TIME_INDEX})[0]}' is set by set_{sorted(tags & {INDEX, TIME_INDEX})[0]} alone")
        held = self.semantic_tags & {INDEX, TIME_INDEX}
        standard = self.standard_tags if self.use_standard_tags and INDEX not in held else set()
        if change == "add":
            if both := tags & self.semantic_tags:
                warn(f"semantic tag(s) '{', '.join(sorted(both))}' already on column '{name}'", DuplicateTagsWarning)
            out.semantic_tags |= tags
        elif change == "remove":
            if missing := tags - self.semantic_tags:
                raise LookupError(f"semantic tag(s) '{', '.join(sorted(missing))}' not on column '{name}'")
            if tags & standard:
                warn(f"standard tag(s) '{', '.join(sorted(tags & standard))}' removed from column '{name}'", StandardTagsChangedWarning)
            out.semantic_tags -= tags
        elif change == "set":
            out.semantic_tags = tags | standard | held
        else:
            out.semantic_tags = set(standard)
        return out

    def to_dict(self) -> dict:
        kind = self.logical_type
        params = {k: v for k, v in kind.parameters.items()} if kind else {}
        return {"use_standard_tags": self.use_standard_tags, "logical_type": {"parameters": params, "type": type(kind).__name__ if kind else None}, "semantic_tags": sorted(self.semantic_tags), "description": self.description, "origin": self.origin, "metadata": self.metadata}

    @staticmethod
    def from_dict(d: dict, system: TypeSystem | None = None) -> ColumnSchema:
        name = d["logical_type"]["type"]
        kind = None
        if name is not None:
            cls = (system or type_system).str_to_logical_type(name)
            kind = cls(**{k: v for k, v in d["logical_type"]["parameters"].items() if v is not None})
        out = ColumnSchema(kind, None, False, d.get("description"), d.get("origin"), d.get("metadata"))
        out.use_standard_tags, out.semantic_tags = d["use_standard_tags"], set(d["semantic_tags"])
        return out


class TableSchema:
    """A table's columns in order, its name and metadata. Index and time index are the columns with these tags."""

    def __init__(self, columns: dict[str, ColumnSchema], name: str | None = None, metadata: dict | None = None):
        if name is not None and not isinstance(name, str):
            raise TypeError("a table's name must be a string")
        self.columns, self.name, self.metadata = dict(columns), name, dict(metadata or {})

    def _tagged(self, tag: str) -> str | None:
        return next((n for n, c in self.columns.items() if tag in c.semantic_tags), None)

    @property
    def index(self) -> str | None:
        return self._tagged(INDEX)

    @property
    def time_index(self) -> str | None:
        return self._tagged(TIME_INDEX)

    @property
    def logical_types(self) -> dict:
        return {n: c.logical_type for n, c in self.columns.items()}

    @property
    def semantic_tags(self) -> dict:
        return {n: c.semantic_tags for n, c in self.columns.items()}

    @property
    def use_standard_tags(self) -> dict:
        return {n: c.use_standard_tags for n, c in self.columns.items()}

    def __eq__(self, other) -> bool:
        return isinstance(other, TableSchema) and self.columns == other.columns and list(self.columns) == list(other.columns) and self.name == other.name and self.metadata == other.metadata

    def copy(self) -> TableSchema:
        return copy.deepcopy(self)

    def check(self, names) -> None:
        if missing := [n for n in names if n not in self.columns]:
            raise ColumnNotPresentError(missing)

    def subset(self, names) -> TableSchema:
        self.check(names)
        return TableSchema({n: self.columns[n].copy() for n in names}, self.name, copy.deepcopy(self.metadata))

    def renamed(self, mapping: dict[str, str]) -> TableSchema:
        """All at once, so that names can be swapped."""
        if not isinstance(mapping, dict):
            raise TypeError("columns to rename must be a dict")
        self.check(mapping)
        if len(set(mapping.values())) < len(mapping):
            raise ValueError("new column names must be unique")
        if taken := [b for b in mapping.values() if b in self.columns and b not in mapping]:
            raise ValueError(f"the column '{taken[0]}' is already there; rename it too")
        out = self.copy()
        out.columns = {mapping.get(n, n): c for n, c in out.columns.items()}
        return out

    def with_index(self, name: str | None) -> TableSchema:
        """The index loses its standard tags; a column that no longer is one has them again."""
        if name is not None:
            self.check([name])
            if name == self.time_index:
                raise ValueError(f"'{name}' is the time index and cannot be the index too")
        out = self.copy()
        for n, c in out.columns.items():
            if INDEX in c.semantic_tags and n != name:
                c.semantic_tags.discard(INDEX)
                c.semantic_tags |= c.standard_tags if c.use_standard_tags else set()
        if name is not None:
            c = out.columns[name]
            c.semantic_tags = (c.semantic_tags - c.standard_tags) | {INDEX}
        return out

    def with_time_index(self, name: str | None) -> TableSchema:
        if name is not None:
            self.check([name])
            c = self.columns[name]
            if name == self.index:
                raise ValueError(f"'{name}' is the index and cannot be the time index too")
            if not (c.is_datetime or c.is_numeric):
                raise TypeError("a time index must be Datetime or numeric")
        out = self.copy()
        for n, c in out.columns.items():
            (c.semantic_tags.add if n == name else c.semantic_tags.discard)(TIME_INDEX)
        return out

    def selected(self, selectors, names_too: bool = False, system: TypeSystem | None = None) -> list[str]:
        """Columns that any selector fits: a logical type's class or name (of exactly that class), a semantic tag or, with
        names_too, a column's name."""
        system = system or type_system
        selectors = selectors if isinstance(selectors, (list, tuple, set)) else [selectors]
        classes, tags, names = set(), set(), set()
        for s in selectors:
            if isinstance(s, L.LogicalType):
                raise TypeError(f"selectors must be classes of logical types, not instances: {s}")
            if isinstance(s, type):
                if not issubclass(s, L.LogicalType) or s not in system.types:
                    raise TypeError(f"{s.__name__} is not a registered logical type")
                classes.add(s)
            elif isinstance(s, str):
                if (found := system.str_to_logical_type(s, raise_error=False)) is not None:
                    classes.add(found)
                elif names_too and s in self.columns:
                    names.add(s)
                else:
                    tags.add(s)
            else:
                raise TypeError(f"not a selector: {s!r}")
        return [n for n, c in self.columns.items() if type(c.logical_type) in classes or c.semantic_tags & tags or n in names]

    def to_json(self) -> str:
        """The typing information as JSON; metadata that JSON cannot hold raises TypeError."""
        return json.dumps(self.to_dict())

    def to_dict(self) -> dict:
        columns = [{"name": n, "ordinal": i, **c.to_dict()} for i, (n, c) in enumerate(self.columns.items())]
        return {"schema_version": VERSION, "name": self.name, "index": self.index, "time_index": self.time_index, "column_typing_info": columns, "table_metadata": self.metadata}

    @staticmethod
    def from_dict(d: dict, system: TypeSystem | None = None) -> TableSchema:
        columns = sorted(d["column_typing_info"], key=lambda c: c["ordinal"])
        return TableSchema({c["name"]: ColumnSchema.from_dict(c, system) for c in columns}, d["name"], d["table_metadata"])


#: Version of the typing information's form.
VERSION = "1.0.0"
