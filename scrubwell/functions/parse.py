"""Column expressions that read numbers, percentages, truth values and dates from text.

Every rule yields NULL for a cell it cannot read; none raises under ANSI mode.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import trim

_NUMBER = r"(?i)\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\z|\A[+-]?inf(?:inity)?\z"
_SIGNS = f"[{vocab.CURRENCY_SIGNS}]"
_STRIPPED = f"[{vocab.CURRENCY_SIGNS},%]"
_MAY_BE_SIGNED = rf"(?i)\A[{vocab.CURRENCY_SIGNS},%0-9+.\-infty e]++\z"


def plain_number(t: Column) -> Column:
    """Decimal text to double. The pattern shuts out ``1d``, ``0x10``, ``nan`` and other
    spellings that only some casts accept, and saves failing casts their exception."""
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def number_word(t: Column) -> Column:
    """``zero`` to ``ten`` by position in the word list."""
    place = F.find_in_set(F.lower(t), F.lit(",".join(vocab.NUMBER_WORDS)))
    return F.when((F.length(t) <= 5) & (place > 0), (place - 1).cast("double"))


def number_in(t: Column) -> Column:
    """``number`` for a cell that is already trimmed. Most cells are settled by one pattern."""
    return (F.when(t.rlike(_NUMBER), t.try_cast("double"))
            .when(t.rlike(_MAY_BE_SIGNED), plain_number(trim(F.regexp_replace(t, _STRIPPED, ""))))
            .otherwise(number_word(t)))


def number(c: Column) -> Column:
    """Number in a cell, ignoring currency signs, thousands commas and ``%``."""
    return number_in(trim(c))


def has_percent(c: Column) -> Column:
    return c.contains("%")


def has_currency(c: Column) -> Column:
    return c.rlike(_SIGNS)


def cell_percent(c: Column) -> Column:
    """Number in a cell; divided by 100 where the cell itself carries ``%``."""
    return number(c) / F.when(has_percent(c), 100.0).otherwise(1.0)


def boolean(c: Column) -> Column:
    return boolean_in(trim(c))


def boolean_in(t: Column) -> Column:
    """``boolean`` for a cell that is already trimmed."""
    return F.when(_is_word(t, vocab.TRUE_WORDS), True).when(_is_word(t, vocab.FALSE_WORDS), False)


def is_boolean_word(t: Column) -> Column:
    return _is_word(t, vocab.TRUE_WORDS + vocab.FALSE_WORDS)


def _is_word(t: Column, words: tuple[str, ...]) -> Column:
    return (F.length(t) <= 5) & (F.find_in_set(F.lower(t), F.lit(",".join(words))) > 0)


# --- dates ------------------------------------------------------------------------------
# A cell is put into one shape class by pattern, rewritten to ISO order by that class's rule and
# cast once, so no cell is tried against a ladder of formats.
_CLOCK = (r"(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?[aApP][mM])?"
          r"(?: ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?)?")
_MONTH = (r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
          r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_YEAR_FIRST = rf"\A[0-9]{{4}}([-/.])[0-9]{{1,2}}(?:\1[0-9]{{1,2}}{_CLOCK})?\z"
_MONTH_FIRST = rf"\A(?:0?[1-9]|1[0-2])([-/.])[0-9]{{1,2}}\1(?:[0-9]{{4}}|[0-9]{{2}}){_CLOCK}\z"
_DAY_FIRST = rf"\A(?:1[3-9]|2[0-9]|3[01])([-/.])[0-9]{{1,2}}\1(?:[0-9]{{4}}|[0-9]{{2}}){_CLOCK}\z"
_NAMED_MONTH = (rf"\A(?:[0-9]{{1,2}}[- ]+{_MONTH}\.?,?[- ]+[0-9]{{4}}"
                rf"|{_MONTH}\.? +[0-9]{{1,2}},? +[0-9]{{4}}"
                rf"|{_MONTH}\.?,?[- ]+[0-9]{{4}}){_CLOCK}\z")
_COMPACT = r"\A(?:[0-9]{4}|[0-9]{8})\z"

DATE_SHAPE = (r"(?i)[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"
              r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b")
# necessary start of every shape, so that most other cells cost one pattern
_DATE_START = (r"\A(?:[0-9]{4}(?:[0-9]{4})?\z|[0-9]{1,4}(?:[-/][0-9]{1,2}(?:\z|[-/T ])|\.[0-9]{1,2}\.)"
               r"|[0-9]{1,2}[- ]+[A-Za-z]{3}|[A-Za-z]{3,9}[-., ]+[0-9])")
_SPECIAL = r"[A-SU-Za-z]|:[^-+]*[-+]"  # a month name, an AM/PM mark or an offset


def _full_year(iso: Column) -> Column:
    """A two-digit year below 69 is 20xx, any other 19xx."""
    return F.regexp_replace(F.regexp_replace(iso, r"\A([0-5][0-9]|6[0-8])-", "20$1-"), r"\A([0-9]{2})-", "19$1-")


def _named(t: Column) -> Column:
    """Named-month cell to ``d-MMM-yyyy`` plus clock, read with one format."""
    x = F.regexp_replace(t, r"\A([A-Za-z]{3})[a-z]*\.? +([0-9]{1,2}),? +([0-9]{4})", "$2-$1-$3")
    x = F.regexp_replace(x, r"\A([A-Za-z]{3})[a-z]*\.?,?[- ]+([0-9]{4})", "1-$1-$2")
    x = F.regexp_replace(x, r"\A([0-9]{1,2})[- ]+([A-Za-z]{3})[a-z]*\.?,?[- ]+([0-9]{4})", "$1-$2-$3")
    return F.try_to_timestamp(x, F.lit("d-MMM-yyyy[ H:mm[:ss]]")).cast("timestamp_ntz")


def date_in(t: Column) -> Column:
    """``date`` for a cell that is already trimmed."""
    parts = r"\A([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})(?![0-9])"
    iso = (F.when(t.rlike(_YEAR_FIRST), F.regexp_replace(t, r"\A([0-9]{4})[/.]([0-9]{1,2})[/.]", "$1-$2-"))
           .when(t.rlike(_MONTH_FIRST), _full_year(F.regexp_replace(t, parts, "$3-$1-$2")))
           .when(t.rlike(_DAY_FIRST), _full_year(F.regexp_replace(t, parts, "$3-$2-$1")))
           .when(t.rlike(_COMPACT), F.regexp_replace(t, r"\A([0-9]{4})([0-9]{2})([0-9]{2})\z", "$1-$2-$3")))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    # micros since the epoch are free of the session's time zone and its clock changes
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(iso.try_cast("timestamp")), epoch)
    half_day = F.try_to_timestamp(F.upper(F.regexp_replace(iso, r"(?i) ?([ap]m)\z", " $1")),
                                  F.lit("yyyy-M-d h:mm[:ss] a")).cast("timestamp_ntz")
    special = (F.when(t.rlike(_NAMED_MONTH), _named(t))
               .when(t.rlike(r"(?i)[ap]m\z"), half_day)
               .when(t.rlike(r"(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})\z"), utc))
    return (F.when(~t.rlike(_DATE_START), None)
            .when(t.rlike(_SPECIAL), special)
            .otherwise(iso.try_cast("timestamp_ntz")))


def date(c: Column) -> Column:
    """Date or date-time in a cell as ``timestamp_ntz``: ISO and year-first forms, month-first
    numeric forms (day-first when the first number cannot be a month), named months, and the
    compact ``yyyyMMdd``/``yyyy``. Offsets are turned into UTC."""
    return date_in(trim(c))


def has_date_shape(c: Column) -> Column:
    return c.rlike(DATE_SHAPE)
