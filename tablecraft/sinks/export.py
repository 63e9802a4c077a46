"""Exports and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with every value quoted; NULL is an empty value."""
    df.write.mode("overwrite").options(header=True, quoteAll=True, nullValue="", emptyValue="", escape='"').csv(path)


def normalise_nested(df: DataFrame, name: str, key: list[str]) -> dict[str, DataFrame]:
    """Nested records as flat tables.

    A struct field becomes ``outer__inner``. A list becomes a child table
    ``<parent>__<field>`` with the parent's key and the position in the list; a list of
    plain values has one column ``value``. A key column whose name the child has as a field
    of its own becomes ``_parent_<key>`` there.
    """
    flat, lists = _flatten(df.schema, [])
    tables = {name: df.select(*[c for c in flat])}
    for path, element in lists:
        column = "__".join(path)
        own = _field_names(element)
        carried = [_free_name(k, own) for k in key]
        position = _free_name(f"{column}_pos", own)
        items = df.select(F.struct(*[F.col(f"`{k}`").alias(c) for k, c in zip(key, carried)]).alias("_keys"),
                          F.posexplode(F.col(".".join(f"`{p}`" for p in path))).alias("_pos", "_item"))
        fields = "_item.*" if isinstance(element, T.StructType) else F.col("_item").alias("value")
        child = items.select("_keys.*", F.col("_pos").alias(position), fields)
        tables |= normalise_nested(child, f"{name}__{column}", [*carried, position])
    return tables


def _field_names(element: T.DataType) -> set[str]:
    """Names a list's element has in its child table, in lower case as Spark compares them."""
    if not isinstance(element, T.StructType):
        return {"value"}
    inner = {f"{f.name}__{n}".lower() for f in element if isinstance(f.dataType, T.StructType) for n in _field_names(f.dataType)}
    return inner | {f.name.lower() for f in element}


def _free_name(key: str, taken: set[str]) -> str:
    while key.lower() in taken:
        key = f"_parent_{key}"
    return key


def _flatten(schema: T.StructType, prefix: list[str]):
    flat, lists = [], []
    for f in schema:
        path = [*prefix, f.name]
        if isinstance(f.dataType, T.StructType):
            inner_flat, inner_lists = _flatten(f.dataType, path)
            flat += inner_flat
            lists += inner_lists
        elif isinstance(f.dataType, T.ArrayType):
            lists.append((path, f.dataType.elementType))
        else:
            flat.append(F.col(".".join(f"`{p}`" for p in path)).alias("__".join(path)))
    return flat, lists
