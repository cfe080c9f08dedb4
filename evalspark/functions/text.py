"""Text expressions: keys, numbers, matches, write verbs, templates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points whose full case folding differs from lower-casing in letters a-z.
FOLD_ONE = {"ŉ": "n", "ſ": "s", "ǰ": "j", "ẖ": "h", "ẗ": "t", "ẘ": "w", "ẙ": "y", "ẚ": "a"}
FOLD_MORE = {"ß": "ss", "ẞ": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Verbs that write.
WRITE_VERBS = ("INSERT", "UPDATE", "DELETE", "MERGE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "EXEC", "EXECUTE")

# Comments and string literals of a query, and the places of a template that are filled.
COMMENTS = r"--[^\n]*|/\*.*?\*/"
STRINGS = r"""N?'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\""""
HOLE = r"\{\{\s*([a-zA-Z0-9_.-]+)\s*\}\}"

#: Decimal digits of all scripts, and the digit 0-9 that each stands for.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(x: Column | str) -> Column:
    return F.when(strip(x) != "", col(x))


def casefold_letters(x: Column | str) -> Column:
    """Lower case, with full folding wherever that changes letters a-z."""
    out = F.translate(col(x), "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    for a, b in FOLD_MORE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(out)


def normalize_key(x: Column | str) -> Column:
    """The folded value's letters a-z and digits alone; null is the word none."""
    return F.coalesce(F.regexp_replace(casefold_letters(x), "[^0-9a-z]+", ""), F.lit("none"))


def numeric(x: Column | str) -> Column:
    """The number a cell's text holds: commas go, a trailing % is not divided by 100; null if none or not finite."""
    text = strip(F.regexp_replace(F.regexp_replace(strip(x), ",", ""), "%+$", ""))
    text = F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, _DIGITS, _VALUES)).otherwise(text)
    value = F.regexp_replace(text, "_", "").try_cast("double")
    return F.when(text.rlike(_NUMBER) & (F.abs(value) < float("inf")), value)


def close(observed: Column, expected: Column, tolerance: Column) -> Column:
    return F.abs(observed - expected) <= F.greatest(tolerance, F.lit(1e-6))


def exact_match(observed: Column | str, expected: Column | str, case_sensitive: bool = True) -> Column:
    if case_sensitive:
        return col(observed) == col(expected)
    return casefold_letters(observed) == casefold_letters(expected)


def matches_regex(x: Column | str, pattern: str, full_match: bool = False, flags: int = 0) -> Column:
    """Unicode-aware search, or a match of the whole text; flags are those of Python's re, of which I, M, S and X are known."""
    known = {re.IGNORECASE: "iu", re.MULTILINE: "m", re.DOTALL: "s", re.VERBOSE: "x"}
    if int(flags) & ~sum(map(int, known)):
        raise ValueError(f"flags not supported: {flags!r}")
    inline = "(?U" + "".join(letter for flag, letter in known.items() if flags & flag) + ")"
    # The end of the whole text stands outside: a verbose pattern may end in a comment.
    return col(x).rlike(f"\\A{inline}(?:{pattern}\n)\\z" if full_match and flags & re.VERBOSE else f"\\A{inline}(?:{pattern})\\z" if full_match else f"{inline}{pattern}")


def contains_write_verb(query: Column | str) -> Column:
    """A write verb outside comments, which go first, and string literals."""
    bare = F.regexp_replace(col(query), f"(?s){COMMENTS}", " ")
    bare = F.regexp_replace(bare, STRINGS, " ")
    return F.coalesce(bare.rlike(r"(?iU)\b(" + "|".join(WRITE_VERBS) + r")\b"), F.lit(False))


def render(template: Column | str, values: Column | str) -> Column:
    """Fills {{ name }} from a map in one pass: what is put in is not looked at again.

    A template with names that the map lacks, or whose value is null, raises an error with all of them, sorted.
    """
    names = F.regexp_extract_all(col(template), F.lit(HOLE), 1)
    between = F.split(col(template), HOLE, -1)
    filled = F.zip_with(between, names, lambda text, name: F.concat(text, F.when(name.isNull(), "").otherwise(F.try_element_at(col(values), name))))
    missing = missing_names(template, values)
    refusal = F.raise_error(F.concat(F.lit("missing prompt substitutions: "), F.array_join(missing, ", "))).cast("string")
    return F.when(F.size(missing) > 0, refusal).otherwise(F.array_join(filled, ""))


def missing_names(template: Column | str, values: Column | str) -> Column:
    """Sorted names of the template that the map lacks or holds null for."""
    names = F.array_distinct(F.regexp_extract_all(col(template), F.lit(HOLE), 1))
    return F.array_sort(F.filter(names, lambda n: F.try_element_at(col(values), n).isNull()))


# Texts that look like credentials.
SECRETS = {
    "sk_key": r"\bsk-(?!ant-)(?:proj-|svcacct-|admin-)?[A-Za-z0-9_-]{20,}",
    "sk_ant_key": r"\bsk-ant-[A-Za-z0-9_-]{20,}",
    "access_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "git_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "hub_token": r"\bhf_[A-Za-z0-9]{30,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "credential": r"""(?i)(?:api[_-]?key|secret|token|password|passwd)\w*[\"']?\s*[:=]\s*[\"'][^\"'\s]{16,}[\"']""",
}


def secret_kinds(x: Column | str) -> Column:
    """Names of the kinds of credentials that the text holds; of a null text none."""
    found = F.array(*[F.when(col(x).rlike(p), F.lit(name)) for name, p in SECRETS.items()])
    return F.filter(found, lambda n: n.isNotNull())
