"""String scalars: whitespace, keys, file names, formula guard."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode string library sees it: the Unicode property plus the
# four ASCII separators that the Java property leaves out.
SPACE = r"[\s\x1c-\x1f]"

# Characters a file name may not hold, and reserved device names.
BAD_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [
    f"{port}{i}" for port in ("COM", "LPT") for i in range(1, 10)
]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def normalise(c: Column) -> Column:
    """Collapse whitespace runs to one blank and strip."""
    return strip(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    s = F.lower(s)
    return F.when(s == "", F.lit("field")).otherwise(s)


def slug_text(name: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", name).strip("_").lower() or "field"


def suffixed(names: list[str]) -> list[str]:
    """Second and later uses of a name become ``name_2``, ``name_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def unclashing(names: list[str], taken: tuple[str, ...] = ()) -> list[str]:
    """Names that differ by more than case: a later one gets the suffix ``_2``, ``_3``, ..."""
    seen = {t.lower() for t in taken}
    out = []
    for name in names:
        new, n = name, 1
        while new.lower() in seen:
            n += 1
            new = f"{name}_{n}"
        seen.add(new.lower())
        out.append(new)
    return out


def sanitise_name(c: Column, fallback: str = "output") -> Column:
    s = F.regexp_replace(F.regexp_replace(c, BAD_NAME_CHARS, "_"), "^[ .]+|[ .]+$", "")
    bad = (s == "") | F.upper(s).isin(RESERVED_NAMES)
    return F.when(bad, F.lit(fallback)).otherwise(F.substring(s, 1, 200))


def formula_guard(c: Column) -> Column:
    """Prefix a quote to cells a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
