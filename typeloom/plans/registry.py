"""The registry of logical types: which are known, how they are related, and which can be inferred."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import logical_types as L

# The order decides between types that match at one depth.
INFERRED = [
    "BooleanNullable", "Boolean", "Categorical", "Datetime", "Double", "Integer", "IntegerNullable", "NaturalLanguage",
    "Timedelta", "EmailAddress", "PhoneNumber", "PostalCode", "URL", "IPAddress",
]
RELATIONSHIPS = [
    ("BooleanNullable", "Boolean"), ("Categorical", "CountryCode"), ("Categorical", "CurrencyCode"), ("Categorical", "Ordinal"),
    ("Categorical", "PostalCode"), ("Categorical", "SubRegionCode"), ("Double", "AgeFractional"), ("IntegerNullable", "AgeNullable"),
    ("IntegerNullable", "Integer"), ("Integer", "Age"), ("Unknown", "EmailAddress"), ("Unknown", "IPAddress"),
    ("Unknown", "PhoneNumber"), ("Unknown", "PostalCode"), ("Unknown", "Timedelta"), ("Unknown", "URL"),
]


@dataclass(frozen=True)
class OfValues:
    """An inference rule that looks at values: test(series) gets the values of a column in the sample, as a pandas Series with its
    nulls, and says whether the type fits. It runs in tasks, so it must be importable there or be sent with its closure."""

    test: Callable


class TypeSystem:
    """Types in registration order, parent-child relations, an inference rule for some, and the default type.

    An inference rule is the name of a built-in rule, a function (Column, spark type) -> boolean aggregate Column or None, or
    OfValues. Aggregates see the whole sample in one pass; OfValues is for what they can't say.
    """

    def __init__(self):
        self.reset_defaults()

    def reset_defaults(self) -> None:
        by_name = {c.__name__: c for c in L.all_types()}
        order = sorted(by_name, key=lambda n: (n == "Unknown", n))
        self.types: list[type[L.LogicalType]] = [by_name[n] for n in order]
        self.rules: dict[type[L.LogicalType], object] = {by_name[n]: n for n in INFERRED}
        self.relationships = [(by_name[a], by_name[b]) for a, b in RELATIONSHIPS]
        self.default_type = by_name["Unknown"]

    @property
    def registered_types(self) -> list[type[L.LogicalType]]:
        return list(self.types)

    @property
    def root_types(self) -> list[type[L.LogicalType]]:
        return [t for t in self.types if self.parent(t) is None]

    def parent(self, kind) -> type[L.LogicalType] | None:
        return next((a for a, b in self.relationships if b is kind), None)

    def children(self, kind) -> list[type[L.LogicalType]]:
        return [b for a, b in self.relationships if a is kind]

    def depth(self, kind) -> int:
        above = self.parent(kind)
        return 0 if above is None else 1 + self.depth(above)

    def add_type(self, kind, inference_function=None, parent=None, treatment: str | None = None) -> None:
        """Registers a type. Where its name is taken: treatment "replace" puts it in place of the other, "ignore" does nothing,
        None raises."""
        self._check(kind)
        parent = self.str_to_logical_type(parent) if isinstance(parent, str) else parent
        old = next((t for t in self.types if t.__name__ == kind.__name__), None)
        if old is not None:
            if treatment == "ignore":
                return
            if treatment != "replace":
                raise ValueError(f"a type named {kind.__name__} is registered; pass treatment='replace' or 'ignore'")
            self.relationships = [(kind if a is old else a, kind if b is old else b) for a, b in self.relationships]
            self.types[self.types.index(old)] = kind
            self.rules.pop(old, None)
            if self.default_type is old:
                self.default_type = kind
        else:
            self.types.append(kind)
        if inference_function is not None:
            self.rules[kind] = inference_function
        if parent is not None:
            self.update_relationship(kind, parent)

    def remove_type(self, kind, treatment: str | None = None) -> None:
        """Unregisters a type; its children go to its parent. With treatment "ignore" a type that is not registered is no error."""
        if treatment not in (None, "ignore"):
            raise ValueError("treatment must be 'ignore' or None")
        named = self.str_to_logical_type(kind, raise_error=treatment is None) if isinstance(kind, str) else kind
        if treatment == "ignore" and named not in self.types:
            return
        kind = named
        self._known(kind)
        if kind is self.default_type:
            raise ValueError("the default type cannot be removed")
        above = self.parent(kind)
        kept = [(a, b) for a, b in self.relationships if kind not in (a, b)]
        self.relationships = kept + [(above, b) for b in self.children(kind) if above is not None and (above, b) not in kept]
        self.types.remove(kind)
        self.rules.pop(kind, None)

    def update_inference_function(self, kind, inference_function) -> None:
        kind = self.str_to_logical_type(kind) if isinstance(kind, str) else kind
        self._known(kind)
        self.rules[kind] = inference_function

    def update_relationship(self, kind, parent) -> None:
        kind = self.str_to_logical_type(kind) if isinstance(kind, str) else kind
        parent = self.str_to_logical_type(parent) if isinstance(parent, str) else parent
        self._known(kind)
        if parent is not None:
            self._known(parent)
        self.relationships = [(a, b) for a, b in self.relationships if b is not kind]
        if parent is not None:
            self.relationships.append((parent, kind))

    def _check(self, kind) -> None:
        if not (isinstance(kind, type) and issubclass(kind, L.LogicalType)):
            raise TypeError("a logical type must be a subclass of LogicalType")

    def _known(self, kind) -> None:
        self._check(kind)
        if kind not in self.types:
            raise ValueError(f"{kind.__name__} is not registered")

    def str_to_logical_type(self, name: str, params: dict | None = None, raise_error: bool = True):
        """The type that a name means, as class or type string in any case; with params an instance."""
        low = name.lower()
        for t in self.types:
            if low in (t.__name__.lower(), t.type_string()):
                return t(**params) if params else t
        if raise_error:
            raise ValueError(f"there is no logical type named {name}")
        return None

    def instance(self, kind) -> L.LogicalType:
        """An instance for a name, class or instance."""
        if isinstance(kind, str):
            kind = self.str_to_logical_type(kind)
        if isinstance(kind, type):
            self._known(kind)
            if issubclass(kind, L.Ordinal):
                raise TypeError("an Ordinal needs an instance with its order of values")
            return kind()
        if not isinstance(kind, L.LogicalType):
            raise TypeError(f"not a logical type: {kind!r}")
        self._known(type(kind))
        if isinstance(kind, L.Ordinal) and kind.order is None:
            raise TypeError("an Ordinal needs its order of values")
        return kind


type_system = TypeSystem()


def warn(message: str, kind: type[Warning]) -> None:
    warnings.warn(message, kind, stacklevel=3)
