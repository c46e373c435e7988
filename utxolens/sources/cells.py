"""Cell tables read through a JSON catalog.

A key-value store's table, exported, is a table of cells: row ``key``,
``family``, ``qualifier``, ``value`` (bytes) and, where versions are kept,
``version``. A catalog says which cell is which column:

    {"table": {"namespace": "default", "name": "block"}, "rowkey": "key",
     "columns": {"rowkey": {"cf": "rowkey", "col": "key", "type": "string"},
                 "size": {"cf": "b", "col": "s", "type": "int"}}}

``read_cells`` turns cells into the catalog's columns with one grouped
aggregate on the key: cells of other columns are left out before it, numbers
are decoded before it (so it stays a hash aggregate over them), of several
versions the latest counts, and a key without some cell has NULL there. Bounds
on the key reach the scan of the cells, as do the families and qualifiers.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_FAMILY = "rowkey"     # fixed value: the family that stands for the row key

# Catalogs of the block and transaction index tables.
BLOCK_CATALOG = """{
    "table": {"namespace": "default", "name": "block"},
    "rowkey": "key",
    "columns": {
        "rowkey": {"cf": "rowkey", "col": "key", "type": "string"},
        "transactionCounter": {"cf": "b", "col": "t", "type": "long"},
        "transactionDate": {"cf": "b", "col": "d", "type": "int"},
        "file": {"cf": "b", "col": "f", "type": "string"},
        "size": {"cf": "b", "col": "s", "type": "int"}}}"""
TRANSACTION_CATALOG = """{
    "table": {"namespace": "default", "name": "transaction"},
    "rowkey": "key",
    "columns": {
        "rowkey": {"cf": "rowkey", "col": "key", "type": "string"},
        "inputNo": {"cf": "t", "col": "is", "type": "int"},
        "outputNo": {"cf": "t", "col": "os", "type": "int"}}}"""

# big-endian whole numbers: bytes and Spark type
_WHOLE = {"byte": (1, "tinyint"), "tinyint": (1, "tinyint"), "short": (2, "smallint"),
          "smallint": (2, "smallint"), "int": (4, "int"), "long": (8, "bigint"), "bigint": (8, "bigint")}
_REAL = {"float": (4, ">f4"), "double": (8, ">f8")}
_PLAIN = {"string", "binary", "boolean"}


class Field(NamedTuple):
    name: str
    family: str
    qualifier: str
    kind: str

    @property
    def is_key(self) -> bool:
        return self.family == KEY_FAMILY


class Catalog(NamedTuple):
    table: str
    fields: list[Field]

    @classmethod
    def parse(cls, text: str) -> Catalog:
        """A catalog from its JSON text; names what is missing or unknown."""
        spec = json.loads(text)
        fields = []
        for name, c in spec.get("columns", {}).items():
            missing = [k for k in ("cf", "col", "type") if k not in c]
            if missing:
                raise ValueError(f"catalog column {name}: no {', '.join(missing)}")
            kind = c["type"].lower()
            if kind not in _WHOLE and kind not in _REAL and kind not in _PLAIN:
                raise ValueError(f"catalog column {name}: unknown type {c['type']!r}")
            fields.append(Field(name, c["cf"], c["col"], kind))
        if not any(f.is_key for f in fields):
            raise ValueError("catalog: no column is the row key")
        cells = [(f.family, f.qualifier) for f in fields if not f.is_key]
        if len(set(cells)) < len(cells):
            raise ValueError("catalog: two columns name the same cell")
        table = spec.get("table", {})
        return cls(":".join(x for x in (table.get("namespace"), table.get("name")) if x), fields)


def _real(kind: str):
    width, code = _REAL[kind]

    @F.arrow_udf(T.DoubleType() if kind == "double" else T.FloatType())
    def read(values: pa.Array) -> pa.Array:
        out = [np.frombuffer(v, code)[0] if v is not None and len(v) == width else None
               for v in values.to_pylist()]
        return pa.array(out, pa.float64() if kind == "double" else pa.float32())

    return read


def decode(value: Column, kind: str) -> Column:
    """A cell's bytes as a value of the catalog's type; bytes of another length
    than the type's are NULL, as no number can be told from them."""
    if kind == "binary":
        return value
    if kind == "string":
        return value.cast("string")
    if kind == "boolean":
        return F.when(F.octet_length(value) == 1, F.hex(value) != "00")
    if kind in _REAL:
        return _real(kind)(value)
    width, name = _WHOLE[kind]
    # unsigned first; the upper half are the negative numbers
    fits = F.when(F.octet_length(value) == width, value)
    whole = F.conv(F.hex(fits), 16, 10).cast("decimal(20,0)")
    half, all_ = (F.lit(str(2 ** (8 * width - k))).cast("decimal(20,0)") for k in (1, 0))
    return F.when(whole >= half, whole - all_).otherwise(whole).cast(name)


def read_cells(cells: DataFrame, catalog: Catalog | str, start: bytes | None = None,
               stop: bytes | None = None) -> DataFrame:
    """The catalog's columns, one row per key in [start, stop). ``cells`` has
    ``key, family, qualifier, value`` (key and value binary, the others text)
    and may have ``version``. A key stands if any cell of the table does."""
    if isinstance(catalog, str):
        catalog = Catalog.parse(catalog)
    if start is not None:
        cells = cells.where(F.col("key") >= F.lit(start))
    if stop is not None:
        cells = cells.where(F.col("key") < F.lit(stop))
    own = [f for f in catalog.fields if not f.is_key]
    versions = "version" in cells.columns
    aggs = []
    for i, f in enumerate(own):
        here = (F.col("family") == f.family) & (F.col("qualifier") == f.qualifier)
        value = F.when(here, decode(F.col("value"), f.kind))
        if versions:
            aggs.append(F.max_by(value, F.when(here, F.col("version"))).alias(f"_{i}"))
        else:
            aggs.append(F.max(value).alias(f"_{i}"))
    families = sorted({f.family for f in own})
    if own and families:
        # a key all of whose cells are of other columns still is a row
        cells = cells.withColumn("value", F.when(F.col("family").isin(families), F.col("value")))
    by_key = cells.groupBy("key").agg(*aggs) if aggs else cells.select("key").distinct()
    places = {f.name: f"_{i}" for i, f in enumerate(own)}
    return by_key.select(*[decode(F.col("key"), f.kind).alias(f.name) if f.is_key
                           else F.col(places[f.name]).alias(f.name) for f in catalog.fields])


def to_cells(df: DataFrame, catalog: Catalog | str) -> DataFrame:
    """The cells of a table's rows, as an export has them: NULLs have none."""
    if isinstance(catalog, str):
        catalog = Catalog.parse(catalog)
    key = next(f for f in catalog.fields if f.is_key)
    made = []
    for f in catalog.fields:
        if f.is_key:
            continue
        c = F.col(f"`{f.name}`")
        if f.kind in _WHOLE:
            digits = 2 * _WHOLE[f.kind][0]
            raw = F.unhex(F.substring(F.lpad(F.hex(c.cast("bigint")), 16, "0"), 17 - digits, digits))
        elif f.kind in ("string", "binary"):
            raw = c.cast("binary")
        else:
            raise ValueError(f"cells of type {f.kind} are read only")
        made.append(F.struct(F.lit(f.family).alias("family"), F.lit(f.qualifier).alias("qualifier"),
                             raw.alias("value")))
    cells = df.select(F.col(f"`{key.name}`").cast("binary").alias("key"), F.explode(F.array(*made)).alias("c"))
    return cells.select("key", "c.family", "c.qualifier", "c.value").where("value is not null")
