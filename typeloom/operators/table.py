"""Typed tables: a DataFrame with typing information. Tables are immutable; every change gives a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnBothIgnoredAndSetError, ColumnNotPresentError, IndexTagRemovedWarning, ParametersIgnoredWarning, TypeConversionError, TypeValidationError, TypingInfoMismatchWarning
from ..functions import datetimes
from ..functions import logical_types as L
from ..plans import inference
from ..plans.registry import type_system, warn
from ..plans.schema import INDEX, TIME_INDEX, ColumnSchema, TableSchema
from .fingerprints import differing, fingerprint
from .places import ordered


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def _coerced(df: DataFrame, kinds: dict[str, L.LogicalType], lenient: bool) -> tuple[DataFrame, dict[str, L.LogicalType]]:
    """df with columns coerced in one projection. Datetime strings without a format get the inferred one, which their type then holds."""
    kinds = dict(kinds)
    for name, kind in kinds.items():
        if isinstance(kind, L.Datetime) and isinstance(df.schema[name].dataType, T.StringType) and kind.datetime_format is None:
            if (found := datetimes.infer_format(df, name)) is not None:
                kinds[name] = L.Datetime(found, "UTC" if "%z" in found else kind.timezone)
    try:
        exprs = [kinds[f.name].coerce(col(f.name), f.dataType, lenient).alias(f.name) if f.name in kinds else col(f.name) for f in df.schema]
        return df.select(*exprs), kinds
    except TypeError:
        raise
    except Exception as e:
        raise TypeConversionError(str(e)) from e


class TypedColumn:
    """One column of a typed table: its schema, and operations that give new tables."""

    def __init__(self, table: TypedTable, name: str):
        self.table, self.name = table, name

    @property
    def schema(self) -> ColumnSchema:
        return self.table.schema.columns[self.name].copy()

    @property
    def df(self) -> DataFrame:
        return self.table.df.select(col(self.name))

    @property
    def logical_type(self):
        return self.schema.logical_type

    @property
    def semantic_tags(self) -> set[str]:
        return self.schema.semantic_tags

    @property
    def description(self):
        return self.schema.description

    @property
    def origin(self):
        return self.schema.origin

    @property
    def metadata(self):
        return self.schema.metadata

    @property
    def use_standard_tags(self) -> bool:
        return self.schema.use_standard_tags

    @property
    def nullable(self) -> bool:
        return self.logical_type.nullable

    def set_logical_type(self, logical_type) -> TypedTable:
        return self.table.set_types({self.name: logical_type})

    def add_semantic_tags(self, tags) -> TypedTable:
        return self.table.add_semantic_tags({self.name: tags})

    def remove_semantic_tags(self, tags) -> TypedTable:
        return self.table.remove_semantic_tags({self.name: tags})

    def set_semantic_tags(self, tags) -> TypedTable:
        return self.table.set_types(semantic_tags={self.name: tags})

    def reset_semantic_tags(self) -> TypedTable:
        return self.table.reset_semantic_tags([self.name])

    def validate_logical_type(self, return_invalid_values: bool = False):
        return self.table[[self.name]].validate_logical_types(return_invalid_values)

    def iloc(self, places):
        """The value at a place, or the column at the places of a slice or list, in the order of the table's indexes."""
        found = self.table.iloc(places, [self.name])
        return found[0] if isinstance(found, Row) else found[self.name]

    def loc(self, keys) -> TypedColumn:
        """The column where the index has these values, or where a condition holds."""
        return self.table.loc(keys, [self.name])[self.name]

    def transform(self, change) -> TypedColumn | DataFrame:
        """change(df) of the column alone, typed as before if it still fits; else the bare DataFrame, with a warning."""
        out = self.table[[self.name]].transform(change)
        return out[self.name] if isinstance(out, TypedTable) else out

    def box_plot_dict(self, **kw) -> dict:
        from .outliers import box_plot

        return box_plot(self.table, self.name, **kw)

    def medcouple_dict(self, **kw) -> dict:
        from .outliers import medcouple_bounds

        return medcouple_bounds(self.table, self.name, **kw)

    def get_outliers(self, method: str = "best", **kw) -> dict:
        from .outliers import outliers

        return outliers(self.table, self.name, method, **kw)

    def __eq__(self, other) -> bool:
        return isinstance(other, TypedColumn) and self.name == other.name and self.schema == other.schema

    def __repr__(self) -> str:
        return f"<Column: {self.name} (Logical Type = {self.logical_type}) (Semantic Tags = {sorted(self.semantic_tags)})>"


class TypedTable:
    """A DataFrame and the schema that fits it."""

    def __init__(self, df: DataFrame, schema: TableSchema):
        if list(df.columns) != list(schema.columns):
            raise ValueError("the schema's columns are not the DataFrame's")
        self.df, self.schema = df, schema

    # -- making ------------------------------------------------------------------------------------------------------

    @staticmethod
    def init(df: DataFrame, name=None, index=None, time_index=None, logical_types=None, semantic_tags=None, use_standard_tags=True, column_descriptions=None, column_origins=None, column_metadata=None, table_metadata=None, schema: TableSchema | None = None, already_sorted=False, null_invalid_values=False, validate=True, ignore_columns=None) -> TypedTable:
        """Types a DataFrame: explicit logical types go before those of a partial schema, and these before inference. An explicit
        None asks for inference. Columns are coerced to their types in one projection."""
        logical_types, ignored = dict(logical_types or {}), list(ignore_columns or [])
        per = {"logical_types": logical_types, "semantic_tags": semantic_tags, "column_descriptions": column_descriptions, "column_origins": column_origins if isinstance(column_origins, dict) else None, "column_metadata": column_metadata}
        for given in per.values():
            if missing := [c for c in given or {} if c not in df.columns]:
                raise ColumnNotPresentError(missing)
        if missing := [c for c in [index, time_index, *ignored] if c is not None and c not in df.columns]:
            raise ColumnNotPresentError(missing)
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("the DataFrame has repeated column names")
        if both := [c for c in ignored if c in logical_types]:
            raise ColumnBothIgnoredAndSetError(both[0])
        df = df.select(*(L.clean(col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name) for f in df.schema))
        old = schema.columns if schema else {}
        kinds = {}
        for c in df.columns:
            if c in logical_types:
                kinds[c] = type_system.instance(logical_types[c]) if logical_types[c] is not None else None
            elif c in old:
                kinds[c] = old[c].logical_type
            else:
                kinds[c] = None
        kinds |= {c: L.Unknown() for c in ignored if kinds[c] is None}
        kinds |= inference.infer(df, [c for c, k in kinds.items() if k is None])
        df, kinds = _coerced(df, {c: k for c, k in kinds.items() if c not in ignored}, null_invalid_values) if set(kinds) - set(ignored) else (df, kinds)
        kinds |= {c: L.Unknown() for c in ignored}

        def pick(given, c, default):
            return given.get(c, default) if isinstance(given, dict) else default if given is None else given

        columns = {}
        for c in df.columns:
            was = old.get(c)
            standard = pick(use_standard_tags, c, True)
            tags = (semantic_tags or {}).get(c, was.custom_tags if was else None)
            columns[c] = ColumnSchema(kinds[c], None, standard, (column_descriptions or {}).get(c, was.description if was else None), pick(column_origins, c, was.origin if was else None), (column_metadata or {}).get(c, was.metadata if was else None)).with_tags("add", tags, c)
        made = TableSchema(columns, name if name is not None else schema.name if schema else None, table_metadata if table_metadata is not None else schema.metadata if schema else None)
        table = TypedTable(df, made)
        index = index or (schema.index if schema and schema.index in df.columns else None)
        time_index = time_index or (schema.time_index if schema and schema.time_index in df.columns else None)
        if index is not None:
            table = table.set_index(index, validate=validate)
        if time_index is not None:
            table = table.set_time_index(time_index)
            if not already_sorted:
                table = table.sorted()
        if validate:
            table.validate_logical_types()
        return table

    @staticmethod
    def init_with_full_schema(df: DataFrame, schema: TableSchema, validate: bool = True, **ignored) -> TypedTable:
        """Attaches a schema as it is; no inference."""
        if ignored:
            warn(f"parameters ignored beside a full schema: {', '.join(sorted(ignored))}", ParametersIgnoredWarning)
        if validate and (message := invalid_schema_message(df, schema)):
            raise ValueError(f"the schema does not fit the data: {message}")
        return TypedTable(df, schema.copy())

    def _with(self, df: DataFrame | None = None, schema: TableSchema | None = None) -> TypedTable:
        return TypedTable(self.df if df is None else df, self.schema if schema is None else schema)

    # -- reading -----------------------------------------------------------------------------------------------------

    @property
    def name(self):
        return self.schema.name

    @property
    def metadata(self) -> dict:
        return self.schema.metadata

    @property
    def columns(self) -> list[str]:
        return list(self.schema.columns)

    @property
    def index(self):
        return self.schema.index

    @property
    def time_index(self):
        return self.schema.time_index

    @property
    def logical_types(self) -> dict:
        return self.schema.logical_types

    @property
    def semantic_tags(self) -> dict:
        return self.schema.semantic_tags

    @property
    def use_standard_tags(self) -> dict:
        return self.schema.use_standard_tags

    @property
    def physical_types(self) -> dict:
        return {f.name: f.dataType.simpleString() for f in self.df.schema}

    @property
    def types(self) -> DataFrame:
        """column, physical_type, logical_type, semantic_tags."""
        rows = [(n, self.physical_types[n], str(c.logical_type), sorted(c.semantic_tags)) for n, c in self.schema.columns.items()]
        return self.df.sparkSession.createDataFrame(rows, "column string, physical_type string, logical_type string, semantic_tags array<string>")

    def equals(self, other, deep: bool = False) -> bool:
        """Schemas alike; with deep the same rows too, whatever their order: as fingerprints tell, for which no rows are shuffled."""
        if not isinstance(other, TypedTable) or self.schema != other.schema:
            return False
        return not deep or self.physical_types == other.physical_types and fingerprint(self.df) == fingerprint(other.df)

    def differing(self, other: TypedTable) -> DataFrame:
        """Rows of either table that the other lacks, each as often as it lacks it, with `_side`, left for this table's or right. Only
        rows of buckets whose fingerprints differ are compared."""
        if self.physical_types != other.physical_types:
            raise ValueError("tables with different columns have no rows to compare")
        return differing(self.df, other.df)

    def __eq__(self, other) -> bool:
        return self.equals(other)

    def __len__(self) -> int:
        return self.df.count()

    def __contains__(self, name) -> bool:
        return name in self.schema.columns

    # -- columns -----------------------------------------------------------------------------------------------------

    def __getitem__(self, key):
        if isinstance(key, list):
            return self.subset(key)
        self.schema.check([key])
        return TypedColumn(self, key)

    def subset(self, names: list[str]) -> TypedTable:
        self.schema.check(names)
        return TypedTable(self.df.select(*map(col, names)), self.schema.subset(names))

    def with_column(self, name: str, value: Column, schema: ColumnSchema | None = None) -> TypedTable:
        """Adds or replaces a column by an expression; untyped values are inferred. The index cannot be replaced."""
        if name in (self.index, self.time_index):
            raise KeyError(f"cannot replace the {'index' if name == self.index else 'time index'} '{name}'")
        if not isinstance(value, Column):
            raise TypeError("a new column must be a Column expression")
        df = self.df.withColumn(name, value)
        if schema is None:
            kind = inference.infer(df, [name])[name]
            df, kinds = _coerced(df, {name: kind}, False)
            schema = ColumnSchema(kinds[name], None, True)
        elif schema.semantic_tags & {INDEX, TIME_INDEX}:
            warn(f"the index tag of '{name}' has been removed", IndexTagRemovedWarning)
            schema = schema.copy()
            schema.semantic_tags -= {INDEX, TIME_INDEX}
            schema.semantic_tags |= schema.standard_tags if schema.use_standard_tags else set()
        if schema.logical_type is not None and not schema.logical_type.fits(df.schema[name].dataType):
            raise TypeValidationError(f"'{name}' is {df.schema[name].dataType.simpleString()}, which is not {schema.logical_type}")
        out = self.schema.copy()
        out.columns[name] = schema
        return TypedTable(df, out)

    def select(self, include=None, exclude=None, return_schema: bool = False):
        """Columns by logical type or semantic tag, in the table's order."""
        if (include is None) == (exclude is None):
            raise ValueError("pass one of include and exclude")
        found = self.schema.selected(include if include is not None else exclude)
        names = found if include is not None else [c for c in self.columns if c not in found]
        return self.schema.subset(names) if return_schema else self.subset(names)

    def drop(self, columns) -> TypedTable:
        columns = [columns] if isinstance(columns, str) else list(columns)
        self.schema.check(columns)
        return self.subset([c for c in self.columns if c not in columns])

    def pop(self, name: str) -> tuple[TypedColumn, TypedTable]:
        return self[name], self.drop(name)

    def rename(self, mapping: dict[str, str]) -> TypedTable:
        schema = self.schema.renamed(mapping)
        return TypedTable(self.df.select(*(col(c).alias(mapping.get(c, c)) for c in self.columns)), schema)

    def transform(self, change) -> TypedTable | DataFrame:
        """change(df), typed as before if it still fits the schema; else the bare DataFrame, with a warning."""
        df = change(self.df)
        if not isinstance(df, DataFrame):
            return df
        if message := invalid_schema_message(df, self.schema, data=False):
            warn(f"typing information is lost: {message}", TypingInfoMismatchWarning)
            return df
        return TypedTable(df, self.schema.copy())

    def filter(self, condition) -> TypedTable:
        return self._with(self.df.filter(condition))

    def loc(self, keys, columns=None) -> TypedTable:
        """Rows by the index's values, or by a condition."""
        table = self if columns is None else self.subset(columns)
        if isinstance(keys, Column):
            return TypedTable(self.df.filter(keys).select(*map(col, table.columns)), table.schema)
        if self.index is None:
            raise ValueError("rows can be found by their keys only with an index")
        keys = keys if isinstance(keys, (list, tuple, set)) else [keys]
        return TypedTable(self.df.filter(col(self.index).isin(*keys)).select(*map(col, table.columns)), table.schema)

    def iloc(self, places, columns=None) -> TypedTable | Row:
        """Rows by place in the order of time index and index, from 0, or from -1 backwards. A single place gives a Row; a slice,
        with any step but 0, or a list of places gives a table, whose rows keep the order of the index."""
        order = [c for c in (self.time_index, self.index) if c is not None]
        if not order:
            raise ValueError("rows have places only with an index or time index")
        names = self.columns if columns is None else [self.columns[i] if isinstance(i, int) else i for i in columns]
        in_order = ordered(self.df.select(*map(col, dict.fromkeys([*order, *names]))), order)
        n = in_order.total
        if isinstance(places, slice):
            wanted = range(n)[places]
            low, high = (min(wanted[0], wanted[-1]), max(wanted[0], wanted[-1])) if len(wanted) else (0, -1)
            rows = in_order.between(low, high, "_place").where((F.col("_place") - low) % abs(wanted.step) == 0)
        else:
            listed = [places] if isinstance(places, int) else list(places)
            if beyond := [p for p in listed if not -n <= p < n]:
                raise IndexError(f"there is no row at {beyond[0]}")
            rows = in_order.at([p % n for p in listed], "_place")
        found = rows.select(*map(col, names))
        return found.first() if isinstance(places, int) else TypedTable(found, self.schema.subset(names))

    # -- types and tags ----------------------------------------------------------------------------------------------

    def set_types(self, logical_types=None, semantic_tags=None, retain_index_tags: bool = True, null_invalid_values: bool = False) -> TypedTable:
        """Changes types, whose columns are coerced in one projection, and tags. A column with a new type keeps no tags but its
        standard and, with retain_index_tags, its index tags."""
        logical_types, semantic_tags = dict(logical_types or {}), dict(semantic_tags or {})
        self.schema.check([*logical_types, *semantic_tags])
        kinds = {c: type_system.instance(k) for c, k in logical_types.items() if k is not None}
        kinds |= inference.infer(self.df, [c for c, k in logical_types.items() if k is None])
        df, kinds = _coerced(self.df, kinds, null_invalid_values) if kinds else (self.df, kinds)
        schema = self.schema.copy()
        for c, kind in kinds.items():
            was = schema.columns[c]
            new = ColumnSchema(kind, None, was.use_standard_tags, was.description, was.origin, was.metadata)
            if retain_index_tags:
                held = was.semantic_tags & {INDEX, TIME_INDEX}
                new.semantic_tags = (new.semantic_tags - (new.standard_tags if INDEX in held else set())) | held
            schema.columns[c] = new
        for c, tags in semantic_tags.items():
            was = schema.columns[c]
            if not retain_index_tags:
                was.semantic_tags -= {INDEX, TIME_INDEX}
            schema.columns[c] = was.with_tags("set", tags, c)
        return TypedTable(df, schema)

    def _tags(self, change: str, given: dict) -> TypedTable:
        self.schema.check(given)
        schema = self.schema.copy()
        for c, tags in given.items():
            schema.columns[c] = schema.columns[c].with_tags(change, tags, c)
        return self._with(schema=schema)

    def add_semantic_tags(self, tags: dict) -> TypedTable:
        return self._tags("add", tags)

    def remove_semantic_tags(self, tags: dict) -> TypedTable:
        return self._tags("remove", tags)

    def reset_semantic_tags(self, columns=None, retain_index_tags: bool = False) -> TypedTable:
        columns = self.columns if columns is None else [columns] if isinstance(columns, str) else list(columns)
        out = self._tags("reset", dict.fromkeys(columns))
        if retain_index_tags:
            for c in columns:
                held = self.schema.columns[c].semantic_tags & {INDEX, TIME_INDEX}
                own = out.schema.columns[c]
                own.semantic_tags = (own.semantic_tags - (own.standard_tags if INDEX in held else set())) | held
        return out

    def set_index(self, name: str | None, validate: bool = True) -> TypedTable:
        """The index must be unique and without nulls, which one aggregation checks."""
        schema = self.schema.with_index(name)
        if name is not None and validate and (message := _index_message(self.df, name)):
            raise IndexError(message)
        return self._with(schema=schema)

    def set_time_index(self, name: str | None) -> TypedTable:
        return self._with(schema=self.schema.with_time_index(name))

    def sorted(self) -> TypedTable:
        """Rows in the order of time index and index, nulls last."""
        order = [c for c in (self.time_index, self.index) if c is not None]
        return self._with(self.df.orderBy(*(col(c).asc_nulls_last() for c in order))) if order else self

    # -- checks ------------------------------------------------------------------------------------------------------

    def invalid_values(self) -> DataFrame:
        """Rows that hold an invalid value, with the index if there is one, and each column's value where it is invalid."""
        bad = {c: s.logical_type.invalid(col(c)) for c, s in self.schema.columns.items() if s.logical_type is not None}
        bad = {c: b for c, b in bad.items() if b is not None}
        keys = [self.index] if self.index and self.index not in bad else []
        if not bad:
            return self.df.select(*map(col, keys)).where(F.lit(False))
        some = F.lit(False)
        for b in bad.values():
            some = some | b
        return self.df.where(some).select(*map(col, keys), *(F.when(b, col(c)).alias(c) for c, b in bad.items()))

    def validate_logical_types(self, return_invalid_values: bool = False) -> DataFrame | None:
        """All columns in one pass. Raises for the first column, in order, with invalid values, or returns these."""
        for c, s in self.schema.columns.items():
            if s.logical_type is not None and not s.logical_type.fits(self.df.schema[c].dataType):
                raise TypeValidationError(f"'{c}' is {self.df.schema[c].dataType.simpleString()}, which is not {s.logical_type}")
        if return_invalid_values:
            return self.invalid_values()
        bad = {c: s.logical_type.invalid(col(c)) for c, s in self.schema.columns.items() if s.logical_type is not None}
        bad = {c: b for c, b in bad.items() if b is not None}
        if bad:
            row = self.df.agg(*(F.count_if(b).alias(f"b{i}") for i, b in enumerate(bad.values()))).first()
            for i, c in enumerate(bad):
                if row[f"b{i}"]:
                    raise TypeValidationError(f"column '{c}' has {row[f'b{i}']} value(s) that are not {self.logical_types[c]}")
        return None

    def typing_info(self) -> dict:
        out = self.schema.to_dict()
        for c in out["column_typing_info"]:
            c["physical_type"] = {"type": self.physical_types[c["name"]]}
        return out

    # -- profiles ----------------------------------------------------------------------------------------------------

    def describe(self, include=None, **kw) -> DataFrame:
        from .describe import describe

        return describe(self, include, **kw)

    def describe_dict(self, include=None, **kw) -> dict:
        from .describe import describe_dict

        return describe_dict(self, include, **kw)

    def value_counts(self, ascending: bool = False, top_n: int = 10, dropna: bool = False) -> dict:
        from .counts import value_counts

        return value_counts(self, ascending, top_n, dropna)

    def dependence(self, measures="all", **kw) -> DataFrame:
        from .dependence import dependence

        return dependence(self, measures, **kw)

    def dependence_dict(self, measures="all", **kw) -> list[dict]:
        return [r.asDict() for r in self.dependence(measures, **kw).collect()]

    def mutual_information(self, **kw) -> DataFrame:
        return self.dependence("mutual_info", **kw)

    def mutual_information_dict(self, **kw) -> list[dict]:
        return self.dependence_dict("mutual_info", **kw)

    def pearson_correlation(self, **kw) -> DataFrame:
        return self.dependence("pearson", **kw)

    def pearson_correlation_dict(self, **kw) -> list[dict]:
        return self.dependence_dict("pearson", **kw)

    def spearman_correlation(self, **kw) -> DataFrame:
        return self.dependence("spearman", **kw)

    def spearman_correlation_dict(self, **kw) -> list[dict]:
        return self.dependence_dict("spearman", **kw)

    def infer_temporal_frequencies(self, temporal_columns=None, debug: bool = False) -> dict:
        from .frequency import infer_temporal_frequencies

        return infer_temporal_frequencies(self, temporal_columns, debug)

    def to_disk(self, path: str, **kw) -> None:
        from ..sources.files import to_disk

        to_disk(self, path, **kw)


def _index_message(df: DataFrame, name: str) -> str | None:
    row = df.groupBy(col(name).alias("k")).count().agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max(F.col("k").isNull().cast("int")).alias("null")).first()
    if row.null:
        return f"the index '{name}' has null values"
    if (row.most or 0) > 1:
        return f"the index '{name}' is not unique"
    return None


def invalid_schema_message(df: DataFrame, schema: TableSchema, data: bool = True) -> str | None:
    """Why a schema does not fit a DataFrame; None if it does. data: whether the index's values are checked too."""
    have, want = set(df.columns), set(schema.columns)
    if have - want:
        return f"columns of the data that are not in the schema: {sorted(have - want)}"
    if want - have:
        return f"columns of the schema that are not in the data: {sorted(want - have)}"
    if list(df.columns) != list(schema.columns):
        return "the columns are in another order"
    for n, c in schema.columns.items():
        if c.logical_type is not None and not c.logical_type.fits(df.schema[n].dataType):
            return f"'{n}' is {df.schema[n].dataType.simpleString()}, which is not {c.logical_type}"
    return _index_message(df, schema.index) if data and schema.index is not None else None


def is_schema_valid(df: DataFrame, schema: TableSchema) -> bool:
    return invalid_schema_message(df, schema) is None


def init_series(df: DataFrame, name: str, logical_type=None, semantic_tags=None, use_standard_tags: bool = True, description=None, origin=None, metadata=None) -> TypedColumn:
    """A column as a typed table of its own, coerced to its type."""
    table = TypedTable.init(df.select(col(name)), logical_types={name: logical_type} if logical_type is not None else None, semantic_tags={name: semantic_tags} if semantic_tags else None, use_standard_tags=use_standard_tags, column_descriptions={name: description} if description else None, column_origins={name: origin} if origin else None, column_metadata={name: metadata} if metadata else None)
    return table[name]


def typed_series(df: DataFrame, name: str, logical_type, **kw) -> TypedColumn:
    """A column as it is, typed without being coerced: a type that its values are not stored as is an error."""
    kind = type_system.instance(logical_type)
    held = df.schema[name].dataType
    if not kind.fits(held):
        raise TypeValidationError(f"'{name}' is {held.simpleString()}, which is not {kind}; init_series converts it")
    columns = {name: ColumnSchema(kind, kw.pop("semantic_tags", None), kw.pop("use_standard_tags", True), kw.pop("description", None), kw.pop("origin", None), kw.pop("metadata", None))}
    return TypedTable(df.select(col(name)), TableSchema(columns, None, None))[name]


def _side_by_side(dfs: list[DataFrame], key: str) -> DataFrame:
    """Rows with one key as one row. Every table's rows are shuffled once, however many tables there are; each holds a key once,
    and a key that it repeats is an error when rows are read."""
    rest = [[c for c in df.columns if c != key] for df in dfs]
    kinds = [T.StructType([f for f in df.schema if f.name != key]) for df in dfs]

    def tagged(i: int) -> DataFrame:
        own = [F.struct(*map(col, rest[j])) if i == j and rest[j] else F.lit(None).cast(k) if k.fields else F.lit(None).cast("int") for j, k in enumerate(kinds)]
        return dfs[i].select(col(key).alias("key"), F.lit(i).alias("tag"), *(v.alias(f"s{j}") for j, v in enumerate(own)))

    every = reduce(DataFrame.unionAll, map(tagged, range(len(dfs))))
    grouped = every.groupBy("key").agg(*(F.first(f"s{j}", ignorenulls=True).alias(f"s{j}") for j in range(len(dfs))), *(F.count_if(F.col("tag") == j).alias(f"n{j}") for j in range(len(dfs))))
    once = reduce(lambda a, b: a & b, (F.col(f"n{j}") <= 1 for j in range(len(dfs))))
    checked = F.when(once, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("a table repeats the key "), F.col("key").cast("string"))))
    return grouped.select(checked.alias(key), *(F.col(f"s{j}")[c].alias(c) for j in range(len(dfs)) for c in rest[j]))


def concat_columns(objects: list[TypedTable | TypedColumn], validate: bool = True) -> TypedTable:
    """Tables side by side: rows with one value of the index become one row, with nulls for tables that lack it. A whole-number or boolean column that gets nulls becomes its nullable type."""
    if not objects:
        raise ValueError("there is nothing to join")
    tables = [o.table.subset([o.name, o.table.index]) if isinstance(o, TypedColumn) and o.table.index not in (None, o.name) else o.table[[o.name]] if isinstance(o, TypedColumn) else o for o in objects]
    keys = [t.index for t in tables]
    if any(k is None for k in keys):
        raise ValueError("tables without an index have no order of rows to join by")
    if len(set(keys)) > 1:
        raise ValueError("the tables have different indexes")
    key, seen, metadata = keys[0], {keys[0]}, {}
    times = [t.time_index for t in tables if t.time_index]
    if len(set(times)) > 1:
        raise ValueError("the tables have different time indexes")
    for t in tables:
        if both := seen & set(t.columns) - {key}:
            raise ValueError(f"the column '{sorted(both)[0]}' is in more than one table")
        seen |= set(t.columns)
        if both := set(metadata) & set(t.metadata):
            raise ValueError(f"the metadata key '{sorted(both)[0]}' is in more than one table")
        metadata |= t.metadata
    columns = {c: s for t in tables for c, s in t.schema.copy().columns.items()}
    df = _side_by_side([t.df for t in tables], key).select(*map(col, columns)) if len(tables) > 1 else tables[0].df
    looser = {L.Integer: L.IntegerNullable, L.Age: L.AgeNullable, L.Boolean: L.BooleanNullable}
    strict = [c for c, s in columns.items() if c != key and type(s.logical_type) in looser]
    if strict and len(tables) > 1:
        row = df.agg(*(F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(strict))).first()
        for i, c in enumerate(strict):
            if row[f"n{i}"]:
                was = columns[c]
                columns[c] = ColumnSchema(looser[type(was.logical_type)](), was.custom_tags or None, was.use_standard_tags, was.description, was.origin, was.metadata)
    names = [t.name for t in tables if t.name]
    schema = TableSchema(columns, "_".join(names) if names else None, metadata)
    if validate and (message := invalid_schema_message(df, schema)):
        raise ValueError(message)
    return TypedTable(df, schema)
