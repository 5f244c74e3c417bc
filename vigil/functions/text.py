"""Column helpers for the T-SQL idioms the checks use.  All built-in expressions:
they stay inside whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Java regex treats specially outside a character class.
_REGEX_META = r"[.\\+*?()\[\]{}|^$]"


def like_to_regex(pattern: Column | str) -> Column:
    """Rewrite a T-SQL LIKE pattern into an anchored, case-insensitive Java regex.

    ``%`` -> ``.*``, ``_`` -> ``.``, a bracket class ``[...]`` stays a class (its ``[``
    and ``\\`` escaped, a leading ``^`` still negates), every other character is
    quoted.  Meant for the small side of a join (exclusion lists): it runs once per
    pattern, the big side only evaluates the compiled regex.
    """
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    tokens = F.regexp_extract_all(p, F.lit(r"(\[[^\]]*\]|.)"), 1)

    def token(t: Column) -> Column:
        body = F.substring(t, 2, F.length(t) - 2)
        # "[^]" negates nothing: any one character; "[" "\\" "&" are literal inside a class
        klass = F.when(body == "^", F.lit(".")).otherwise(
            F.concat(F.lit("["), F.regexp_replace(body, r"([\[\\&])", r"\\$1"), F.lit("]")))
        return (F.when(t == "%", F.lit(".*"))
                .when(t == "_", F.lit("."))
                .when((F.length(t) > 2) & t.startswith("["), klass)
                .when(t.rlike(_REGEX_META), F.concat(F.lit("\\"), t))
                .otherwise(t))

    return F.concat(F.lit("(?isu)^(?:"), F.array_join(F.transform(tokens, token), ""), F.lit(")$"))


def has_like_wildcard(pattern: Column | str) -> Column:
    """True when a LIKE pattern holds ``%``, ``_`` or a bracket class; a pattern
    without them matches exactly one name (ignoring case)."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    return p.rlike(r"[%_\[]")


def date120(c: Column | str) -> Column:
    """``convert(varchar, d, 120)``: ``yyyy-MM-dd HH:mm:ss``, fraction cut off."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def boundary_days(start: Column | str, end: Column) -> Column:
    """``datediff(day, start, end)``: midnights crossed, not full 24-hour spans."""
    return F.datediff(F.to_date(end), F.to_date(start))


def boundary_seconds(start: Column | str, end: Column) -> Column:
    """``datediff(second, start, end)``: second boundaries crossed."""
    return (F.unix_seconds(F.to_timestamp(F.date_trunc("second", end)))
            - F.unix_seconds(F.to_timestamp(F.date_trunc("second", start))))


# Fixed value: characters not allowed in an OS file name, each replaced by "_".
OS_UNSAFE_CHARS = ".\\/:*?<>|"


def safe_os_name(c: Column | str) -> Column:
    """Replace ``. \\ / : * ? < > |`` by ``_`` (one ``translate``, no chain of replaces)."""
    return F.translate(c if isinstance(c, Column) else F.col(c), OS_UNSAFE_CHARS, "_" * len(OS_UNSAFE_CHARS))


def csv_items(c: Column | str) -> Column:
    """Comma list -> array of trimmed items; empty items kept, NULL -> NULL (no rows once exploded)."""
    col = c if isinstance(c, Column) else F.col(c)
    return F.transform(F.split(col, ","), lambda x: F.trim(x))


def ci_equal(a: Column, b: Column) -> Column:
    """T-SQL ``=`` under a case-insensitive collation."""
    return F.lower(a) == F.lower(b)


def format_message(template: str, *values: Column) -> Column:
    """``formatmessage``: like ``fill``, but a NULL value prints as ``(null)``."""
    return fill(template, *[F.coalesce(v.cast("string"), F.lit("(null)")) for v in values])


def fill(template: str, *values: Column) -> Column:
    """``template`` with each ``%s`` replaced by a value (cast to string); a NULL
    value makes the result NULL, like string ``+`` in the reference's SQL."""
    pieces = template.split("%s")
    if len(pieces) != len(values) + 1:
        raise ValueError(template)
    if not values:
        return F.lit(template)
    cols = []
    for i, piece in enumerate(pieces):
        if piece:
            cols.append(F.lit(piece))
        if i < len(values):
            cols.append(values[i].cast("string"))
    return F.concat(*cols)
