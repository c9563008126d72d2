"""Expressions over catalogue cells. Each takes and returns columns, is null for null, and runs JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..resources import values as V

#: Cells that readers turn to null.
BLANK = ["", "-", "--", "n/a", "na", "none", "null", "unknown"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once per row however often `then` uses it. What stands inside runs outside
    generated code, which keeps long rule tables within the JVM's limit for methods."""
    return F.get(F.transform(F.array(value), then), 0)


def _sql(x: object) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)


def _row(values: tuple) -> str:
    return "named_struct(" + ", ".join(f"'v{k}', {_sql(x)}" for k, x in enumerate(values)) + ")"


def pick(pairs: list[tuple], key: Column) -> Column:
    """The value of the key that is equal, else null; a struct v0, v1, ... where a key has several values. The literal
    map is folded into the plan once; for tables of bounded size."""
    items = ", ".join(f"{_sql(p[0])}, {_sql(p[1]) if len(p) == 2 else _row(p[1:])}" for p in pairs)
    return F.element_at(F.expr(f"map({items})"), key)


def first_where(rows: list[tuple], test) -> Column:
    """The first row (a struct v0, v1, ...) of a literal table for which test(row) holds, else null."""
    return F.get(F.filter(F.expr("array(" + ", ".join(map(_row, rows)) + ")"), test), 0)


def clean_cell(c: Column | str) -> Column:
    """No-break and repeated space to one space, trimmed; cells without a value to null."""
    x = F.trim(F.regexp_replace(F.regexp_replace(col(c), " ", " "), r"(?U)\s+", " "))
    return F.when(~F.lower(x).isin(BLANK), x)


def form(c: Column | str) -> Column:
    """The comparison form of a name: lower case, runs of anything but letters and digits to a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", " "))


def strip_distributor_code(c: Column | str) -> Column:
    """Without a trailing code in parentheses; the cell itself if nothing else is in it."""
    x = F.trim(F.regexp_replace(F.trim(col(c)), r"\s*\([A-Z0-9_-]+\)\s*$", ""))
    return F.coalesce(F.nullif(x, F.lit("")), col(c))


def is_missing(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


def is_placeholder(c: Column | str) -> Column:
    """Whether a cell says in words that there is no value."""
    x = F.trim(col(c))
    return F.coalesce(F.lower(x).isin(V.PLACEHOLDERS) | x.rlike("^--.*--$"), F.lit(False))


def part_key(c: Column | str) -> Column:
    """A part number without case and separators."""
    return F.lower(F.regexp_replace(col(c), "[^A-Za-z0-9]", ""))


def part_variants(c: Column | str) -> Column:
    """The ways a page may write a part number: lower case, and with spaces dropped or dashed or dashes dropped."""
    x = F.lower(F.trim(col(c)))
    return F.filter(F.array_distinct(F.array(x, F.replace(x, F.lit(" "), F.lit("")), F.replace(x, F.lit(" "), F.lit("-")), F.replace(x, F.lit("-"), F.lit("")))), lambda v: v != "")


def detect_role(name: Column | str) -> Column:
    """The role of a column by its name: the first rule that holds, else other."""
    k = F.lower(F.trim(col(name)))
    out = F.lit("other")
    for role, whole, parts, ends in reversed(V.ROLE_RULES):
        if role == "identifier":
            role, hit = "part_number", k.rlike(V.IDENTIFIER_PATTERN)
        else:
            hit = k.isin(whole) if whole else F.lit(False)
            for p in parts:
                hit = hit | F.contains(k, F.lit(p))
            for e in ends:
                hit = hit | F.endswith(k, F.lit(e))
        out = F.when(hit, F.lit(role)).otherwise(out)
    return out


def role_of(name: str) -> str:
    """The same rule for one name on the driver, once per column of a batch."""
    import re

    k = name.lower().strip()
    for role, whole, parts, ends in V.ROLE_RULES:
        if role == "identifier":
            if re.match(V.IDENTIFIER_PATTERN, k):
                return "part_number"
        elif k in whole or any(p in k for p in parts) or any(k.endswith(e) for e in ends):
            return role
    return "other"


def canonical_header(name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def summarise_agent(ua: Column | str) -> Column:
    """A browser and platform, a crawler's name, or unknown browser."""
    x = F.trim(F.coalesce(col(ua), F.lit("")))
    label = lambda table, default: F.coalesce(*(F.when(F.contains(x, F.lit(t)), F.lit(n)) for t, n in table), F.lit(default))
    name = F.trim(F.element_at(F.split(F.element_at(F.split(x, "/"), 1), r"\("), 1))
    bot = F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("crawler")), F.lit(" (bot)"))
    browser, platform = label(V.BROWSERS, "unknown browser"), label(V.PLATFORMS, "")
    plain = F.when(platform != "", F.concat(browser, F.lit(" on "), platform)).otherwise(browser)
    return F.when(x == "", "unknown browser").when(x.rlike(f"(?i){V.BOT_PATTERN}"), bot).otherwise(plain)
