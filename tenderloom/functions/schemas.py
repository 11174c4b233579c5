"""Nested schemas compiled to one column: the paths of a value that break a rule.

A schema says of each field what it is, its bounds, what it may be instead (null, or left out) and what its elements are. The compiler walks
it once and yields an expression of array<string>: ``budget_min_usd``, ``roles[2].count``. It never yields null, and whatever a comparison
with null leaves open counts as broken. Values are typed columns, or VARIANT (parsed JSON), of which the JSON type is checked too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """kind: text, whole, number, flag, time, list or record. low and high bound a number's value, a text's length in
    characters, a list's size."""

    kind: str
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()
    like: str | None = None
    of: Field | None = None
    fields: tuple[tuple[str, Field], ...] = ()
    null: bool = False
    left_out: bool = False

    def or_null(self) -> Field:
        return replace(self, null=True)

    def optional(self) -> Field:
        return replace(self, left_out=True)


def text(low: float | None = None, high: float | None = None, like: str | None = None) -> Field:
    return Field("text", low, high, like=like)


def one_of(*names: str) -> Field:
    return Field("text", among=names)


def whole(low: float | None = None, high: float | None = None) -> Field:
    return Field("whole", low, high)


def number(low: float | None = None, high: float | None = None) -> Field:
    return Field("number", low, high)


def list_of(of: Field, low: float | None = None, high: float | None = None) -> Field:
    return Field("list", low, high, of=of)


def record(**fields: Field) -> Field:
    return Field("record", fields=tuple(fields.items()))


flag, time = Field("flag"), Field("time")


@dataclass(frozen=True)
class Typed:
    """A column of the type that the schema expects; its null stands for both null and left out."""

    column: Column

    def absent(self, f: Field) -> list[tuple[Column, bool]]:
        return [(self.column.isNull(), f.null or f.left_out)]

    def fits(self, f: Field) -> Column:
        return F.lit(True)

    def field(self, name: str) -> Typed:
        return Typed(self.column[name])

    def value(self, f: Field) -> Column:
        return self.column


@dataclass(frozen=True)
class Parsed:
    """A VARIANT: null and left out differ, and a value of another JSON type breaks its rule."""

    column: Column

    def absent(self, f: Field) -> list[tuple[Column, bool]]:
        return [(self.column.isNull(), f.left_out), (F.is_variant_null(self.column), f.null)]

    def fits(self, f: Field) -> Column:
        kinds = {"text": "STRING", "flag": "BOOLEAN", "list": "ARRAY.*", "record": "OBJECT.*", "whole": "BIGINT|DECIMAL.*|DOUBLE", "number": "BIGINT|DECIMAL.*|DOUBLE", "time": "STRING"}
        return F.schema_of_variant(self.column).rlike(f"^(?:{kinds[f.kind]})$")

    def field(self, name: str) -> Parsed:
        return Parsed(F.try_variant_get(self.column, f"$.{name}", "variant"))

    def value(self, f: Field) -> Column:
        kinds = {"text": "string", "flag": "boolean", "list": "array<variant>", "whole": "double", "number": "double", "time": "timestamp"}
        return F.try_variant_get(self.column, "$", kinds[f.kind])


def _none() -> Column:
    return F.array().cast("array<string>")


def _within(measure: Column, f: Field) -> Column:
    ok = measure.isNotNull()
    if f.low is not None:
        ok = ok & (measure >= f.low)
    if f.high is not None:
        ok = ok & (measure <= f.high)
    return ok


def broken(view: Typed | Parsed, f: Field, path: Column) -> Column:
    """The paths below ``path`` that break the schema, in its order; an empty array if none does."""
    here = F.array(path)
    if f.kind == "record":
        inside = F.concat(*[broken(view.field(n), sub, F.concat(path, F.lit(f".{n}"))) for n, sub in f.fields])
    else:
        value = view.value(f)
        if f.kind == "list":
            size = F.when(_within(F.size(value), f), _none()).otherwise(here)
            of = f.of or Field("text")
            inside = F.concat(size, F.flatten(F.transform(value, lambda x, i: broken(type(view)(x), of, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        else:
            ok = {"text": lambda: _within(F.length(value), f), "whole": lambda: _within(value, f) & (value == F.floor(value)), "number": lambda: _within(value, f)}.get(f.kind, lambda: value.isNotNull())()
            if f.among:
                ok = ok & value.isin(*f.among)
            if f.like:
                ok = ok & value.rlike(f.like)
            inside = F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(here)
    out = None
    for gone, allowed in view.absent(f):
        out = (F.when if out is None else out.when)(gone, _none() if allowed else here)
    return out.when(~F.coalesce(view.fits(f), F.lit(False)), here).otherwise(inside)


def problems(view: Callable[[str], Typed | Parsed], schema: Field, more: dict[str, Column] | None = None) -> Column:
    """Paths of a row's columns (or of a document's top fields) that break ``schema``, then those of ``more``: conditions across
    fields, by path, that must hold wherever they are not null."""
    each = [broken(view(n), f, F.lit(n)) for n, f in schema.fields]
    across = [F.when(F.coalesce(ok, F.lit(True)), _none()).otherwise(F.array(F.lit(path))) for path, ok in (more or {}).items()]
    return F.array_distinct(F.concat(*each, *across))


def once(value: Column) -> Column:
    """A generator of the one value: what refers to it later does not compute it again, as it would once the optimizer has
    written its expression into every place (and filters) that names it."""
    return F.explode(F.array(value))


def split(rows: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): rejects carry the broken paths in ``failed``."""
    marked = rows.select("*", once(failed).alias("failed"))
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)
