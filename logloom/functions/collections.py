"""Arrays, maps and enumeration. Closures are Python functions of columns, as Spark's own higher-order functions take."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fallible import Fallible, fallible
from .strings import Pattern, _java

Closure = Callable[..., Column]


def length(c: Column) -> Column:
    """Elements of an array or entries of a map. For strings: octet_length."""
    return F.when(c.isNotNull(), F.size(c))


def push(c: Column, item: Column) -> Column:
    return F.array_append(c, item)


def append(c: Column, items: Column) -> Column:
    return F.concat(c, items)


def pop(c: Column) -> Column:
    """Without the last element."""
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def chunks(c: Column, size: int) -> Column:
    if size <= 0:
        raise ValueError("chunk size must be above 0")
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.size(c), F.lit(size)), lambda i: F.slice(c, i, F.lit(size)))).when(c.isNotNull(), F.slice(F.array(c), 2, 1))


def zip_(a: Column, b: Column) -> Column:
    """Pairs [x, y] up to the shorter of two arrays of one type."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y))


def keys(c: Column) -> Column:
    return F.map_keys(c)


def values(c: Column) -> Column:
    return F.map_values(c)


def merge(to: Column, from_: Column) -> Column:
    """The right map wins; keys that both have keep their place."""
    kept = F.transform_values(to, lambda k, v: F.when(F.map_contains_key(from_, k), F.element_at(from_, k)).otherwise(v))
    return F.map_concat(kept, F.map_filter(from_, lambda k, v: ~F.map_contains_key(to, k)))


def compact(c: Column, kind: T.DataType, string: bool = False) -> Column:
    """An array or map without its nulls, and without empty strings if told."""
    bare = (lambda v: v.isNotNull() & (v != "")) if string else (lambda v: v.isNotNull())
    return F.filter(c, bare) if isinstance(kind, T.ArrayType) else F.map_filter(c, lambda k, v: bare(v))


def flatten(c: Column, kind: T.DataType, separator: str = ".") -> Column:
    """Arrays of arrays as one array; structs as one struct of dotted names."""
    if isinstance(kind, T.ArrayType):
        while isinstance(kind.elementType, T.ArrayType):
            c, kind = F.flatten(c), kind.elementType
        return c

    def leaves(col: Column, of: T.StructType, lead: str) -> list[Column]:
        out = []
        for f in of.fields:
            inner, name = col[f.name], lead + f.name
            out += leaves(inner, f.dataType, name + separator) if isinstance(f.dataType, T.StructType) else [inner.alias(name)]
        return out

    return F.struct(*leaves(c, kind, ""))


def unflatten(c: Column, kind: T.StructType, separator: str = ".") -> Column:
    """A struct of dotted names as nested structs; a scalar in the way of an object gives way."""

    def nest(fields: list[tuple[list[str], Column]]) -> list[Column]:
        groups: dict[str, list[tuple[list[str], Column]]] = {}
        for path, col in fields:
            groups.setdefault(path[0], []).append((path[1:], col))
        out = []
        for name, inner in groups.items():
            deeper = [(p, x) for p, x in inner if p]
            out.append(F.struct(*nest(deeper)).alias(name) if deeper else inner[-1][1].alias(name))
        return out

    return F.struct(*nest([(f.name.split(separator), c.getField(f.name)) for f in kind.fields]))


def unique(c: Column) -> Column:
    return F.array_distinct(c)


def includes(c: Column, item: Column) -> Column:
    return F.exists(c, lambda x: x.eqNullSafe(item))


def for_each(c: Column, start: Column, step: Closure) -> Column:
    """What a loop accumulates: step(state, element) over an array, from start."""
    return F.aggregate(c, start, step)


def map_values(c: Column, use: Closure, kind: T.DataType) -> Column:
    return F.transform(c, use) if isinstance(kind, T.ArrayType) else F.transform_values(c, lambda _, v: use(v))


def map_keys(c: Column, use: Closure) -> Column:
    """Keys renamed; of keys that meet, the last wins in the first's place."""
    pairs = F.transform(F.map_entries(c), lambda e: F.struct(use(e["key"]).alias("key"), e["value"].alias("value")))
    return _last_wins(pairs)


def _last_wins(pairs: Column) -> Column:
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"].alias("value"))))


def filter_(c: Column, keep: Closure, kind: T.DataType) -> Column:
    """keep(index, value) of an array, keep(key, value) of a map."""
    return F.filter(c, lambda v, i: keep(i, v)) if isinstance(kind, T.ArrayType) else F.map_filter(c, keep)


def match_array(c: Column, pattern: Pattern, all_: bool = False) -> Column:
    hit = lambda x: F.coalesce(x.rlike(_java(pattern)), F.lit(False))
    return F.forall(c, hit) if all_ else F.exists(c, hit)


def tally(c: Column) -> Column:
    """How often each string of an array occurs, by first occurrence."""
    return F.map_from_entries(F.transform(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), lambda k: F.struct(k, F.size(F.filter(c, lambda x: x == k)))))


def tally_value(c: Column, value: Column) -> Column:
    return F.size(F.filter(c, lambda x: x.eqNullSafe(value)))


def to_entries(c: Column) -> Column:
    return F.map_entries(c)


def from_entries(c: Column) -> Fallible:
    """[{key, value}] as a map; the last of equal keys wins, a null key is an error."""
    return fallible(F.forall(c, lambda e: e["key"].isNotNull()), _last_wins(c), "from_entries: keys must be strings")


def object_from_array(values_: Column, keys_: Column) -> Column:
    """Values and keys, place by place, as a map; what one array has more than the other is left out. Empty arrays give an empty map."""
    n = F.least(F.size(values_), F.size(keys_))
    entries = F.transform(F.arrays_zip(keys_.alias("key"), values_.alias("value")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return _last_wins(F.slice(entries, 1, n))


def unnest(event: Column, field: str) -> Column:
    """An array of copies of a struct, each with one element of its array field in the field's place. For rows of their own, see operators.unnest_rows."""
    return F.transform(event[field], lambda x: event.withField(field, x))


# Query matching: the few forms of a search term, as column expressions.
TERM = re.compile(r'(?P<not>-)?(?:(?P<field>@?[\w.]+):)?(?:\[(?P<low>\S+) TO (?P<high>\S+)\]|(?P<op>>=|<=|>|<)(?P<bound>[^\s()]+)|"(?P<quoted>[^"]*)"|(?P<word>[^\s()]+))')


def match_datadog_query(fields: dict[str, Column], query: str) -> Column:
    """Whether an event matches a search: AND, OR, NOT or -, parentheses, field:value with * and ?, comparisons, [low TO high], field:*.

    fields are the event's columns by dotted name; a bare term looks in `message`. A field that isn't there matches nothing.
    """

    def like(c: Column, text: str) -> Column:
        if text == "*":
            return c.isNotNull()
        body = "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in text)
        return c.cast("string").rlike(f"(?s)^{body}$")

    def term(m: re.Match) -> Column:
        name = (m["field"] or "message").removeprefix("@")
        c = fields.get(name)
        if c is None:
            found = F.lit(False)
        elif m["low"] is not None:
            number = c.try_cast("double")
            found = number.between(*[0.0 if b == "*" else float(b) for b in (m["low"], m["high"])])
        elif m["op"]:
            number, bound = c.try_cast("double"), F.lit(float(m["bound"]))
            found = {">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound}[m["op"]]
        else:
            text = m["quoted"] if m["quoted"] is not None else m["word"]
            found = like(c, text) if m["field"] else F.contains(c, F.lit(text)) if not re.search(r"[*?]", text) else like(c, f"*{text}*")
        found = F.coalesce(found, F.lit(False))
        return ~found if m["not"] else found

    rest = query.strip()

    def take(word: str) -> bool:
        nonlocal rest
        hit = re.match(rf"(?i){word}\s*" if not word[0].isalpha() else rf"(?i){word}(?=[\s(])\s*", rest)
        rest = rest[hit.end() :] if hit else rest
        return bool(hit)

    def one() -> Column:
        nonlocal rest
        if take("NOT"):
            return ~one()
        if take(r"\("):
            inner = any_()
            take(r"\)")
            return inner
        m = TERM.match(rest)
        if not m:
            raise ValueError(f"bad query at {rest!r}")
        rest = rest[m.end() :].lstrip()
        return term(m)

    def all_() -> Column:
        out = one()
        while rest and not rest.startswith(")") and not re.match(r"(?i)OR\b", rest):
            take("AND")
            out = out & one()
        return out

    def any_() -> Column:
        out = all_()
        while take("OR"):
            out = out | all_()
        return out

    return any_() if rest else F.lit(True)
