"""Column expressions for text: whitespace, missing tokens, casing and contact fields.

All are built-in JVM expressions; patterns and sets mean Unicode whitespace throughout.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# fixed value: the Unicode whitespace characters
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # the same as a class
_SPACE_RUN = f"[{_SPACE}]+"
_TIDY = r"\A[!-~]++(?: [!-~]++)*+\z"  # ASCII words, one space between them: settles most cells quickly
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_WORD_START = rf"(?<=[^{_CASED}])(?=[{_CASED}])"
_MARK = "\ue000 "

EMAIL = r"\A[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]+\z"
PHONE = r"\A[0-9]{10,15}\z"


def trim(c: Column) -> Column:
    """Strip whitespace of every kind (``F.trim`` strips only U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def _is_token(t: Column, tokens: tuple[str, ...]) -> Column:
    """Whether a trimmed cell is one of the tokens; long cells are ruled out by length alone."""
    return (F.length(t) <= max(map(len, tokens))) & (F.find_in_set(F.lower(t), F.lit(",".join(tokens))) > 0)


def missing_tokens(c: Column, tokens=vocab.MISSING_TOKENS) -> Column:
    """Trim; cells that spell out "no value" become NULL."""
    t = trim(c)
    return F.when(~_is_token(t, tokens), t)


def basic_missing_tokens(c: Column, tokens=vocab.BASIC_MISSING_TOKENS) -> Column:
    """Cells that spell out "no value" become NULL; other cells keep their whitespace."""
    return F.when(~_is_token(trim(c), tokens), c)


def collapse_inner(t: Column) -> Column:
    """``collapse`` for a cell that is already trimmed; tidy cells stay untouched."""
    return F.when(~t.rlike(_TIDY), F.regexp_replace(t, _SPACE_RUN, " ")).otherwise(t)


def collapse(c: Column) -> Column:
    """One space for every whitespace run, none at the ends."""
    return F.when(~c.rlike(_TIDY), F.regexp_replace(trim(c), _SPACE_RUN, " ")).otherwise(c)


def title_case(c: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case.

    ``initcap`` starts words at spaces only, so a marked space goes in front of each letter
    that follows a non-letter and comes out again afterwards."""
    marked = F.regexp_replace(F.lower(c), _WORD_START, _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def email(c: Column) -> Column:
    return F.lower(trim(c))


def phone(c: Column) -> Column:
    """Digits only, without a ``+91``/``0091`` prefix or a spreadsheet ``.0`` tail."""
    digits = F.regexp_replace(trim(c), r"\A(?:\+910091|\+91|0091)|\.0\z|[^0-9]", "")
    return F.nullif(digits, F.lit(""))


def phone_ten(c: Column) -> Column:
    """Ten digits, after dropping a leading ``91`` from twelve; anything else is NULL."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    digits = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(F.length(digits) == 10, digits)


def strip_decimal_zero(c: Column) -> Column:
    return F.regexp_replace(trim(c), r"\.0\z", "")


def is_valid_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def is_valid_phone(c: Column) -> Column:
    return c.rlike(PHONE)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL where the key is absent. The table travels as one
    constant, folded to a map literal when the query is planned."""
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02")), c)


def changed(old: Column, new: Column) -> Column:
    """True where both cells hold a value and the values differ."""
    return F.coalesce(old != new, F.lit(False))


def changed_null_safe(old: Column, new: Column) -> Column:
    """As ``changed``, and also true where a value became NULL or the reverse."""
    return ~old.eqNullSafe(new)


def digest_long(c: Column, limit: int = 64) -> Column:
    """The value itself, or its SHA-256 when longer than ``limit`` characters. Each form bears a
    tag, so a short value never equals the digest of a long one.

    Used where only equality matters (counting distinct values or repeated rows), so that
    long texts do not travel through the shuffle."""
    return F.when(F.length(c) > limit, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(F.concat(F.lit("="), c))
