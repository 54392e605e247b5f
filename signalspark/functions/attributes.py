"""Predicates on attributes of any depth, by type, over their JSON as a VARIANT.

A path is a series of keys and of places in lists: ``("m", "a", 0)``. A number compares as a number, a text as a text, a boolean
as a boolean; a value of another type, a missing one, and JSON that can't be read match nothing, and never are an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Path = tuple[str | int, ...]

#: What :func:`where` compares by.
COMPARISONS = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def json_path(path: Path) -> str:
    """The path as Spark writes it. A key may hold dots, spaces and one kind of quotes."""
    out = "$"
    for step in path:
        if isinstance(step, int):
            out += f"[{step}]"
        elif "'" not in step:
            out += f"['{step}']"
        elif '"' not in step:
            out += f'["{step}"]'
        else:
            raise ValueError(f"a key with both kinds of quotes has no path: {step}")
    return out


def attribute(attributes: Column, path: Path) -> Column:
    """The value at a path as a VARIANT; null where there is none."""
    return F.try_variant_get(F.try_parse_json(attributes), json_path(path), "variant")


def has(attributes: Column, path: Path) -> Column:
    """Whether there is a value at a path, be it a JSON null."""
    return attribute(attributes, path).isNotNull()


def _number(value: Column) -> Column:
    return F.when(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*NUMBERS), F.try_variant_get(value, "$", "double"))


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _boolean(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def _once(attributes: Column, path: Path, read: Callable[[Column], Column]) -> Column:
    """``read`` of the value at a path. The value is named once: a filter is moved below what makes the attributes, which are then
    made again for each time that it names them."""
    return F.get(F.transform(F.array(attribute(attributes, path)), read), F.lit(0))


def number_at(attributes: Column, path: Path) -> Column:
    """The number at a path as a double; null for anything else, texts of digits among it."""
    return _once(attributes, path, _number)


def text_at(attributes: Column, path: Path) -> Column:
    """The text at a path; null for anything else."""
    return _once(attributes, path, _text)


def boolean_at(attributes: Column, path: Path) -> Column:
    return _once(attributes, path, _boolean)


def where(attributes: Column, path: Path, value: str | float | bool, comparison: str = "=") -> Column:
    """Whether the value at a path is of the type of ``value`` and compares so with it."""
    if comparison not in COMPARISONS:
        raise ValueError(f"no such comparison: {comparison}")
    at = boolean_at if isinstance(value, bool) else text_at if isinstance(value, str) else number_at
    return F.coalesce(COMPARISONS[comparison](at(attributes, path), F.lit(value if isinstance(value, (str, bool)) else float(value))), F.lit(False))
