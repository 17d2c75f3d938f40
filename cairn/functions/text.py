"""Scalar functions on paths, sizes, ages and globs."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def join_path(parent: Column, name: Column) -> Column:
    """Empty parents add nothing."""
    return F.when(F.coalesce(F.length(parent), F.lit(0)) == 0, name).otherwise(F.concat_ws("/", parent, name))


def trim_base(path: Column, base: str) -> Column:
    """path less the base folder before it."""
    base = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


UNITS = ("B", "kB", "MB", "GB", "TB", "PB", "EB")


def human_bytes(n: Column) -> Column:
    """Bytes in units of 1000, with one digit below ten."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1:], 1):
        scaled = n / F.lit(1000.0**k)
        shown = F.when(scaled < 10, F.format_number(F.floor(scaled * 10 + 0.5) / 10, 1)).otherwise(F.floor(scaled + 0.5).cast("string"))
        out = F.when(n >= 1000**k, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


# Units of an age.
AGE_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
AGE = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def age(text: str) -> timedelta:
    """An age such as 1h30m or 0; a sign may stand before it."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return timedelta(0)
    if not body or AGE.sub("", body):
        raise ValueError(f"not an age: {text!r}")
    return sign * timedelta(seconds=sum(float(n) * AGE_SECONDS[u] for n, u in AGE.findall(body)))


def glob_regex(glob: str) -> str:
    """The pattern of a glob: ** crosses folders, * and ? don't, {a,b} chooses, [...] is a class, \\ takes the next as it is."""
    out, at, depth = "^", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:[^/]*/)*", at + 3
            continue
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[":
            end = glob.find("]", at + 2)
            if end < 0:
                raise ValueError(f"class without end: {glob!r}")
            body = glob[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end
        elif c == "\\":
            if at + 1 == len(glob):
                raise ValueError(f"nothing after \\: {glob!r}")
            at += 1
            out += re.escape(glob[at])
        else:
            out += re.escape(c)
        at += 1
    if depth:
        raise ValueError(f"choice without end: {glob!r}")
    return out + "$"


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Kept if an include glob fits; else dropped if an exclude glob fits; else kept. Malformed globs fit nothing."""

    def any_of(globs: list[str]) -> Column:
        fits = F.lit(False)
        for g in globs:
            try:
                fits = fits | path.rlike(glob_regex(g))
            except ValueError:
                continue
        return fits

    return F.when(any_of(include), True).when(any_of(exclude), False).otherwise(True)
