"""Paths, languages and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of each extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescriptreact", "js": "javascript", "jsx": "javascriptreact", "py": "python", "java": "java", "go": "go", "cpp": "cpp", "c": "c", "h": "cpp", "hpp": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "rs": "rust", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "vue": "vue",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("plaintext"))


def basename(path: Column) -> Column:
    """After the last slash; the whole path if that is empty."""
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), path)


def dirname(path: Column) -> Column:
    """Before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for whole paths with forward slashes: ** spans directories, *
    and ? don't, {a,b} is either."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def closed_folders(globs: tuple[str, ...] | list[str]) -> str | None:
    """A regular expression for the relative paths, with a slash at the end, of folders of which every
    file is excluded: those below which a glob that ends in /** takes all. None if there are none."""
    whole = [glob_regex(g.removesuffix("**"))[:-1] for g in globs if g.endswith("/**")]
    return "|".join(f"{w}" for w in whole) or None


def excluded(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    """Whether the relative path matches one of the globs."""
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
