"""Reading payload paths as typed columns.

A path is looked up as a literal key first (``"http.route"`` may be a key) and
by nested traversal otherwise. Flat columns of the event table stand in for the
payload fields they were promoted from, so that operators which only touch
those never read the JSON.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import FLAT_STRINGS

NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SHREDDED = "__fields"


def number_from_text(text: Column) -> Column:
    """Decimal text as DOUBLE; NULL for anything else (no hex, suffixes or blanks)."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def json_path(keys: Iterable[str]) -> str:
    return "$" + "".join(f"['{key}']" for key in keys)


def check_path(path: str) -> str:
    path = path.strip()
    if not path or re.search(r"['\"\\\[\]*]", path):
        raise ValueError(f"no payload path: {path!r}")
    return path


class Fields:
    """Payload paths of one events DataFrame as columns.

    ``nested_only`` switches literal dotted keys off (the alert dialect);
    ``flat=False`` ignores the promoted columns. ``derived_signal`` reads the
    ``signal`` column (given or derived) instead of the payload's own signal, as
    grouping and substring filters do.
    """

    def __init__(
        self,
        df: DataFrame | None = None,
        *,
        payload: str = "data",
        flat: bool = True,
        nested_only: bool = False,
        derived_signal: bool = False,
    ):
        columns = set(df.columns) if df is not None else set()
        self.payload = F.col(payload)
        self.flat_strings = {name for name in FLAT_STRINGS if name in columns} if flat else set()
        if derived_signal and "signal" in columns:
            self.flat_strings.add("signal")
        self.flat_number = flat and "duration_ms" in columns
        self.nested_only = nested_only
        self.shredded: set[str] = set()
        if SHREDDED in columns:
            self.shredded = set(df.schema[SHREDDED].dataType.fieldNames())

    def _literal(self, key: str) -> Column:
        if key in self.shredded:
            return F.col(f"{SHREDDED}.`{key}`")
        return F.get_json_object(self.payload, json_path([key]))

    def _nested(self, keys: list[str]) -> Column:
        if keys[0] in self.shredded:
            return F.get_json_object(F.col(f"{SHREDDED}.`{keys[0]}`"), json_path(keys[1:]))
        return F.get_json_object(self.payload, json_path(keys))

    def _has_key(self, key: str) -> Column:
        # The substring test is cheap and settles almost every row.
        return F.contains(self.payload, F.lit(f'"{key}"')) & F.coalesce(
            F.array_contains(F.json_object_keys(self.payload), key), F.lit(False)
        )

    def raw(self, path: str) -> Column:
        """JSON text of the value; NULL when it is missing or null."""
        path = check_path(path)
        if "." not in path:
            return self._literal(path)
        nested = self._nested(path.split("."))
        if self.nested_only:
            return nested
        return F.coalesce(
            self._literal(path), F.when(nested.isNotNull() & ~self._has_key(path), nested)
        )

    def variant(self, path: str) -> Column:
        """The value as VARIANT; a JSON null is a variant null, a missing path NULL."""
        path = check_path(path)
        document = F.try_parse_json(self.payload)
        get = lambda keys: F.try_variant_get(document, json_path(keys), "variant")
        if "." not in path or self.nested_only:
            return get(path.split("."))
        return F.coalesce(get([path]), get(path.split(".")))

    def is_container(self, path: str) -> Column:
        """True for objects and arrays. The type is only looked up for text that
        starts like one, which a plain string rarely does."""
        kind = F.schema_of_variant(self.variant(path))
        return F.when(
            F.substring(self.raw(path), 1, 1).isin("{", "["),
            kind.startswith("OBJECT") | kind.startswith("ARRAY"),
        ).otherwise(F.lit(False))

    def present(self, path: str) -> Column:
        """The path holds something other than null."""
        found = self.raw(path).isNotNull()
        if path in self.flat_strings:
            return (F.col(path) != "") | found
        return found

    def string(self, path: str, default: str = "") -> Column:
        """Strings as they are, numbers as printed, booleans as true/false; the
        default for null, objects, arrays, missing and empty values."""
        if path in self.flat_strings:
            text = F.coalesce(F.col(path), F.lit(""))
        else:
            raw = self.raw(path)
            text = F.when(raw.isNull() | self.is_container(path), F.lit("")).otherwise(raw)
        if default:
            return F.when(text == "", F.lit(default)).otherwise(text)
        return text

    def number(self, path: str) -> Column:
        """A JSON number or numeric string as DOUBLE, else NULL."""
        if path == "duration_ms" and self.flat_number:
            return F.col("duration_ms")
        return number_from_text(self.raw(path))


def shred(df: DataFrame, paths: Iterable[str], payload: str = "data") -> DataFrame:
    """Parse the payload once for many paths.

    Adds one struct column with the top-level keys the paths need (both the
    literal key and the head of a nested path); ``Fields`` picks it up.
    """
    keys = set()
    for path in paths:
        path = check_path(path)
        keys.add(path)
        keys.add(path.split(".")[0])
    if df is not None and payload == "data":
        keys -= {name for name in FLAT_STRINGS if name in df.columns}
    if len(keys) < 2:
        return df
    schema = ", ".join(f"`{key}` string" for key in sorted(keys))
    return df.withColumn(SHREDDED, F.from_json(F.col(payload), schema))
