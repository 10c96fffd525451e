"""Column functions over method signatures, statement texts and labels.

A signature is `<package.Class: ReturnType name(ArgTypes)>`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose meaning is part of the data model.
CLASS = r"^<([^:]+):"
METHOD = r"^<[^:]+:[^)]+\b(\w+)\("
METHOD_WITH_INIT = r"([^ ]+)\("
SUB_SIGNATURE = r"([^ ]+\(.*\))"
NUMBER = r"^-?\d+(\.\d+)?[LlFfDd]?$"
FIELD_READ = r"^([\w$]+) = ([\w$]+)\.(<[^>]+>)$"
FIELD_WRITE = r"^([\w$]+)\.(<[^>]+>) = ([\w$]+)$"
PARAMETER = r"^\w[\w$#]* := @parameter(\d+):"
EL_HEAD = r"^[#$]\{\s*([a-zA-Z_]\w*)(?:\.([a-zA-Z_]\w*))?"
CONSTANT_WORDS = ("null", "true", "false")


def class_of(sig: Column) -> Column:
    return F.regexp_extract(sig, CLASS, 1)


def method_of(sig: Column) -> Column:
    """Empty for constructors, whose name ends in a bracket."""
    return F.regexp_extract(sig, METHOD, 1)


def method_with_init(sig: Column) -> Column:
    return F.regexp_extract(sig, METHOD_WITH_INIT, 1)


def sub_signature(sig: Column) -> Column:
    found = F.regexp_extract(sig, SUB_SIGNATURE, 1)
    return F.when(found == "", sig).otherwise(found)


def short_class(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def short_call(call: Column) -> Column:
    """Class.method of a qualified call."""
    return F.substring_index(call, ".", -2)


def short_method(sig: Column) -> Column:
    """Class.method of a signature; what isn't one stays."""
    name = method_with_init(sig)
    return F.when(class_of(sig) != "", F.concat(short_class(class_of(sig)), F.lit("."), name)).otherwise(sig)


def line_count(start: Column, end: Column) -> Column:
    """At least 0; null without lines."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), end - start + 1))


def line_or_unknown(line: Column) -> Column:
    return F.coalesce(line, F.lit(-1))


def statement_kind(text: Column, call: Column) -> Column:
    """IDENTITY, RETURN, ASSIGN_INVOKE, INVOKE or ASSIGN; a bare return is an ASSIGN."""
    return (
        F.when(text.contains(" := "), "IDENTITY")
        .when(text.startswith("return "), "RETURN")
        .when(call.isNotNull() & text.contains(" = "), "ASSIGN_INVOKE")
        .when(call.isNotNull(), "INVOKE")
        .otherwise("ASSIGN")
    )


def node_kind(calls: Column, branches: Column, assigns: Column) -> Column:
    return (
        F.when(F.size(branches) > 0, "branch")
        .when(F.size(calls) > 0, "call")
        .when(F.size(assigns) > 0, "assign")
        .otherwise("plain")
    )


def node_label(line: Column, calls: Column, assigns: Column) -> Column:
    short = F.array_sort(F.transform(calls, short_call))
    return F.concat(
        F.array(F.concat(F.lit("L"), line.cast("string"))), short,
        F.when(F.size(calls) == 0, assigns).otherwise(F.array().cast("array<string>")),
    )


def argument(text: Column, index: Column) -> Column:
    """The index-th argument of the last call in a statement; empty if there is none. Commas in strings split too."""
    inner = F.regexp_extract(text, r"\(([^(]*)\)[^)]*$", 1)
    return F.coalesce(F.trim(F.try_element_at(F.split(inner, ","), index.cast("int") + 1)), F.lit(""))


def is_constant(arg: Column) -> Column:
    return (arg == "") | arg.isin(*CONSTANT_WORDS) | arg.startswith('"') | arg.rlike(NUMBER)


def defines(text: Column, local: Column) -> Column:
    return text.startswith(F.concat(local, F.lit(" = "))) | text.startswith(F.concat(local, F.lit(" := ")))


def defined_local(text: Column) -> Column:
    """The left side of the first assignment or identity; null if there is none."""
    found = F.regexp_extract(text, r"^(.*?) :?= ", 1)
    return F.nullif(found, F.lit(""))


def written_value(text: Column) -> Column:
    """The right side of the last assignment; null if there is none."""
    return F.when(text.contains(" = "), F.substring_index(text, " = ", -1))


def returned_local(text: Column) -> Column:
    return F.when(text.startswith("return "), F.trim(F.substring(text, 8, 1 << 20)))


def parameter_index(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PARAMETER, 1), F.lit("")).cast("int")


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def dot_escaped(text: Column) -> Column:
    return F.replace(
        F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"),
    )


def el_bean(expr: Column) -> Column:
    return F.regexp_extract(expr, EL_HEAD, 1)


def el_member(expr: Column) -> Column:
    return F.regexp_extract(expr, EL_HEAD, 2)


def jsp_key(path: Column) -> Column:
    return F.concat(F.lit("jsp:/"), path)


def el_key(path: Column, expr: Column) -> Column:
    return F.concat(F.lit("el:/"), path, F.lit("#"), expr)


def layer(name: Column, patterns: dict[str, str], otherwise: str = "") -> Column:
    """The first pattern that matches, in the dict's order."""
    out = F.lit(otherwise)
    for label, pattern in reversed(patterns.items()):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def source_symbol(sig: Column) -> Column:
    """package/Class#method"""
    return F.concat(F.replace(class_of(sig), F.lit("."), F.lit("/")), F.lit("#"), method_with_init(sig))


def may_recurse(name: Column, allow: list[str] = (), stop: list[str] = ()) -> Column:
    """(no allow-list or a prefix of it) and no stop prefix: stop wins."""
    starts = lambda prefixes: reduce(lambda a, b: a | b, (name.startswith(p) for p in prefixes), F.lit(False))
    return (starts(allow) if allow else F.lit(True)) & ~starts(stop)


def in_scope(name: Column, pattern: str) -> Column:
    """A class without a name is out of scope."""
    return (name != "") & name.rlike(pattern)


def covers(start: Column, end: Column, line: Column) -> Column:
    """line 0: not given, so anything covers it."""
    return (line == 0) | ((start <= line) & (line <= end))


class Stop:
    """Composable stop conditions over a signature."""

    def __init__(self, test):
        self.test = test

    def __call__(self, sig: Column) -> Column:
        return self.test(sig)

    def __or__(self, other: Stop) -> Stop:
        return Stop(lambda sig: self.test(sig) | other.test(sig))

    @classmethod
    def exact(cls, symbol: str) -> Stop:
        return cls(lambda sig: sig == symbol)

    @classmethod
    def of_class(cls, name: str) -> Stop:
        return cls(lambda sig: sig.startswith(f"<{name}:"))

    @classmethod
    def prefix(cls, prefix: str) -> Stop:
        return cls(lambda sig: sig.startswith(prefix))

    @classmethod
    def never(cls) -> Stop:
        return cls(lambda sig: F.lit(False))


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(1) != 0
