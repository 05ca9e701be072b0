"""Paths: globs, extensions, safety checks and normal forms, as Column expressions or plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_GLOBS = 32
# Device names that no output path may have as a segment's stem.
RESERVED = ["con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10))]


def check_globs(globs: list[str]) -> list[str]:
    """Patterns must be relative, non-empty and stay below their root; at most MAX_GLOBS of them."""
    if len(globs) > MAX_GLOBS:
        raise ValueError(f"at most {MAX_GLOBS} patterns")
    for g in globs:
        bare = g.replace("\\", "/")
        if not g or "\0" in g or bare.startswith("/") or re.match(r"[A-Za-z]:", bare) or ".." in bare.split("/"):
            raise ValueError(f"not a relative pattern: {g!r}")
    return globs


def glob_regex(glob: str) -> str:
    """A regular expression (for whole strings, in Java, RE2 and Python alike): ``*`` and ``?`` stay within a segment, ``**/``
    matches any number of segments, ``{a,b}`` alternatives, ``[..]`` a set."""
    g, out, i, braces = glob.replace("\\", "/"), "", 0, 0
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i) and (i == 0 or g[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if g.startswith("**", i) and (i == 0 or g[i - 1] == "/") and i + 2 == len(g):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            while g.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := g.find("]", i + 2)) > 0:
            body = g[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{" and "}" in g[i:]:
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c) if c in r".^$+(){}[]|\\" else c
        i += 1
    return f"^{out}$"


def globs_regex(globs: list[str], case_sensitive: bool = False) -> str:
    found = "|".join(f"(?:{glob_regex(g)})" for g in check_globs(globs))
    return found if case_sensitive else found.lower()


def matches(path: Column, globs: list[str], case_sensitive: bool = False) -> Column:
    """Whether any pattern matches; nothing matches an empty list."""
    if not globs:
        return F.lit(False)
    return (path if case_sensitive else F.lower(path)).rlike(globs_regex(globs, case_sensitive))


def normalised(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def raw_path(path: Column) -> Column:
    """The path as stored, if normalising changes it."""
    return F.when(normalised(path) != path, path)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last segment, else ''."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def last_dot_extension(path: Column) -> Column:
    """Lower-case text after the last dot of the whole path (the type lookup's rule), else ''."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f".{ext.lstrip('.')}"))


def output_path(path: Column, output_extension: Column) -> Column:
    """Adds the extension where the last segment has no dot."""
    ok = output_extension.rlike(r"^[A-Za-z0-9][A-Za-z0-9_+-]{0,15}$")
    return F.when(ok & ~F.contains(base_name(path), F.lit(".")), F.concat(path, F.lit("."), output_extension)).otherwise(path)


def unsafe(path: Column) -> Column:
    """Whether a path may not be written below an output folder."""
    p = normalised(path)
    part = lambda s: (s == "") | (s == ".") | (s == "..") | F.contains(s, F.lit(":")) | s.rlike("[. ]$") | F.lower(F.regexp_extract(s, r"^([^.]*)", 1)).isin(RESERVED)
    return p.isNull() | (p == "") | F.contains(p, F.lit("\0")) | p.startswith("/") | F.exists(F.split(p, "/"), part)


def depth(relative: Column) -> Column:
    return F.size(F.split(relative, "/")) - 1


def cursor_of(path: str) -> str:
    """A keyset cursor: the last path, base64url without padding."""
    import base64

    return base64.urlsafe_b64encode(path.encode()).decode().rstrip("=")


def path_of(cursor: str) -> str:
    import base64

    try:
        path = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not path or cursor_of(path) != cursor:
        raise ValueError("not a cursor in its canonical form")
    return path
