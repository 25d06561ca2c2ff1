"""Column-level cleaning rules.

Every function returns a ``Column`` built only from ``pyspark.sql.functions``
so the whole cleaning layer stays inside whole-stage codegen.  Nothing raises
on dirty input under ANSI mode: parsing uses the ``try_*`` family.

Convention kept from the rule book: cleaners never overwrite, the table-level
wrappers in ``basketry.operators.cleaning`` append ``<col>_cleaned``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions import vocab as V


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _norm(c: Column) -> Column:
    """Upper-cased, trimmed text used for sentinel and synonym matching."""
    return F.upper(F.trim(c))


def is_blank(c: str | Column) -> Column:
    """Null, or empty after trimming (string columns only)."""
    c = _c(c)
    return c.isNull() | (F.trim(c) == "")


def clean_name(c: str | Column = "name", title_case: bool = False) -> Column:
    """Null for blank/sentinel names; collapse whitespace; strip honorific.

    The rule book promises Title Case but never applied it; pass
    ``title_case=True`` to get ``initcap`` on top.
    """
    c = _c(c)
    tidy = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), V.NAME_TITLE_PATTERN, "")
    if title_case:
        tidy = F.initcap(tidy)
    return F.when(is_blank(c) | _norm(c).isin(V.NAME_SENTINELS), F.lit(None).cast("string")).otherwise(tidy)


def clean_email(c: str | Column = "email") -> Column:
    """lower/trim valid emails, null otherwise.

    The pattern is tested on the *untrimmed* value, so a padded address is
    rejected - this is the documented rule and is kept.
    """
    c = _c(c)
    bad = is_blank(c) | _norm(c).isin(V.EMAIL_SENTINELS) | ~c.rlike(V.EMAIL_PATTERN)
    return F.when(bad, F.lit(None).cast("string")).otherwise(F.lower(F.trim(c)))


# Cheap shape tests run before each parse attempt.  Each is a superset of the
# text its layout can parse, so results are unchanged; they only spare the
# parser attempts that would fail (a failed attempt costs a JVM exception).
_SHAPES = {
    "yyyy-MM-dd": r"^\s*[+-]?\d+-\d+-\d+\s*$",
    "MM/dd/yyyy": r"^\s*\d+/\d+/[+-]?\d+\s*$",
    "dd-MM-yyyy": r"^\s*\d+-\d+-[+-]?\d+\s*$",
    "yyyyMMdd": r"^\s*[+-]?\d+\s*$",
    "MMMM dd, yyyy": r"^\s*[A-Za-z]+\s+\d+,\s*[+-]?\d+\s*$",
    "yyyy/MM/dd": r"^\s*[+-]?\d+/\d+/\d+\s*$",
}


def parse_date(c: str | Column, formats: list[str] | None = None) -> Column:
    """First format that parses wins; unparseable text becomes null."""
    c = _c(c)
    tries = []
    for f in formats or V.DATE_FORMATS:
        attempt = F.try_to_date(c, f)
        tries.append(F.when(c.rlike(_SHAPES[f]), attempt) if f in _SHAPES else attempt)
    return F.coalesce(*tries)


def clean_status(c: str | Column = "status") -> Column:
    """C4: map status synonyms to the canonical set; blank -> 'unknown'."""
    c = _c(c)
    n = _norm(c)
    expr = F.when(is_blank(c), F.lit("unknown"))
    for canonical, spellings in V.STATUS_GROUPS:
        expr = expr.when(n.isin(spellings), F.lit(canonical))
    return expr.otherwise(F.lower(F.trim(c)))


def clean_segment(c: str | Column = "segment") -> Column:
    """Premium / Regular / Bronze / Unknown, else the trimmed value."""
    c = _c(c)
    n = _norm(c)
    expr = F.when(is_blank(c) | n.isin(V.SEGMENT_SENTINELS), F.lit("Unknown"))
    for canonical, spellings in V.SEGMENT_GROUPS:
        expr = expr.when(n.isin(spellings), F.lit(canonical))
    return expr.otherwise(F.trim(c))


def parse_boolean(c: str | Column) -> Column:
    """Boolean from the accepted spellings, null for anything else."""
    n = _norm(_c(c).cast("string"))
    return (F.when(n.isin(V.TRUE_TOKENS), F.lit(True))
            .when(n.isin(V.FALSE_TOKENS), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


def in_range(c: str | Column, lo=None, hi=None) -> Column:
    """Keep the value when inside the inclusive range, else null."""
    c = _c(c)
    cond = None
    if lo is not None:
        cond = c >= F.lit(lo)
    if hi is not None:
        cond = (c <= F.lit(hi)) if cond is None else (cond & (c <= F.lit(hi)))
    if cond is None:
        return c
    return F.when(cond, c)


def clean_phone(c: str | Column = "phone") -> Column:
    """North-American number as ``+1-AAA-EEE-LLLL``.

    Fixes two defects of the literal rule: an 11-digit number that starts
    with the country code 1 has it stripped first, and anything that does not
    leave exactly 10 digits becomes null instead of a malformed string.
    """
    c = _c(c)
    digits = F.regexp_replace(c, r"[^0-9]", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    bad = is_blank(c) | _norm(c).isin(V.PHONE_SENTINELS) | c.rlike(V.PHONE_FAKE_PATTERN)
    formatted = F.concat_ws("-", F.lit("+1"), F.substring(national, 1, 3),
                            F.substring(national, 4, 3), F.substring(national, 7, 4))
    return F.when(bad | (F.length(national) != 10), F.lit(None).cast("string")).otherwise(formatted)


def completeness_score(columns: list[str], dtypes: dict[str, str]) -> Column:
    """Share (0-100, 2 decimals) of required fields that are present.

    Blank text counts as missing; the blank test is applied only to string
    columns (comparing an int or date with '' raises under ANSI).
    """
    present = [
        F.when(is_blank(col) if dtypes.get(col) == "string" else F.col(col).isNull(), 0).otherwise(1)
        for col in columns
    ]
    total = reduce(lambda a, b: a + b, present)
    # integer arithmetic then one exact decimal rounding: identical in any engine
    return F.round(total.cast("decimal(10,0)") * F.lit(100) / F.lit(len(columns)), 2).cast("double")


def category_from_text(c: str | Column = "category") -> Column:
    """C14 helper: category bucket by substring, sentinels -> 'Other'."""
    c = _c(c)
    n = _norm(c)
    inner = None
    for needle, label in V.CATEGORY_RULES:
        inner = (F.when(n.contains(needle), F.lit(label)) if inner is None
                 else inner.when(n.contains(needle), F.lit(label)))
    inner = inner.otherwise(F.trim(c))
    return F.when(is_blank(c) | n.isin(V.PRODUCT_SENTINELS), F.lit(V.OTHER_CATEGORY)).otherwise(inner)


def product_name(c: str | Column = "product_name") -> Column:
    c = _c(c)
    return F.when(is_blank(c) | _norm(c).isin(V.PRODUCT_SENTINELS), F.lit(V.UNKNOWN_PRODUCT)).otherwise(F.trim(c))
