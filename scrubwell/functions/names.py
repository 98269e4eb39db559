"""Column names: standard spelling, uniqueness, and the role a name suggests.

These rules look at the schema only, so they run on the driver while the plan is built.
"""
from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vocab


def standard_name(name: str) -> str:
    """Word characters joined by single underscores; ``Unnamed_Column`` if none remain."""
    words = re.findall(r"[^\W_]+", str(name))
    return "_".join(words) or "Unnamed_Column"


def unique_names(names: Iterable[str]) -> list[str]:
    """Append ``_1``, ``_2`` … to repeats. Spark resolves names without regard to case,
    so uniqueness is also case-insensitive, and a suffix never collides with another name."""
    names = list(names)
    reserved = {n.lower() for n in names}
    used: set[str] = set()
    repeats: dict[str, int] = {}
    out = []
    for name in names:
        candidate = name
        while candidate.lower() in used or (candidate != name and candidate.lower() in reserved):
            repeats[name] = repeats.get(name, 0) + 1
            candidate = f"{name}_{repeats[name]}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


def standardize_names(df: DataFrame) -> DataFrame:
    """Rename every column to its standard, unique spelling."""
    return df.toDF(*unique_names(map(standard_name, df.columns)))


def column_key(name: str) -> str:
    """Lower-case ASCII key used to compare column names."""
    return "_".join(re.findall(r"[a-z0-9]+", str(name).lower()))


def _is_word(key: str, hints: Iterable[str]) -> bool:
    return not {key, *key.split("_")}.isdisjoint(hints)


def _ends_in(key: str, hints: Iterable[str]) -> bool:
    return f"_{key}".endswith(tuple(f"_{hint}" for hint in hints))


def is_id(name: str) -> bool:
    key = column_key(name)
    return key in vocab.ID_KEYS or key.endswith(vocab.ID_SUFFIXES)


def is_email(name: str) -> bool:
    return _is_word(column_key(name), vocab.EMAIL_HINTS)


def is_phone(name: str) -> bool:
    return _is_word(column_key(name), vocab.PHONE_HINTS)


def is_percent(name: str) -> bool:
    return _ends_in(column_key(name), vocab.PERCENT_HINTS)


def is_currency(name: str) -> bool:
    return _ends_in(column_key(name), vocab.CURRENCY_HINTS)


def is_date_hint(name: str) -> bool:
    return _ends_in(column_key(name), vocab.DATE_HINTS)


def is_name(name: str) -> bool:
    return _ends_in(column_key(name), vocab.NAME_HINTS)


def is_contact_or_id(name: str) -> bool:
    return is_id(name) or is_email(name) or is_phone(name)


def is_label_hint(name: str) -> bool:
    key = column_key(name)
    return key in vocab.LABEL_HINTS or any(part in key for part in vocab.LABEL_HINT_PARTS)


def is_gender(name: str) -> bool:
    return _ends_in(column_key(name), vocab.GENDER_KEYS)


def is_boolean_label(name: str) -> bool:
    key = column_key(name)
    return key in vocab.BOOLEAN_LABEL_KEYS or key.startswith(vocab.BOOLEAN_LABEL_PREFIXES)


def name_role(name: str) -> str | None:
    """The kind that the name alone decides, in order of precedence; None if it decides none."""
    for role, test in (("email", is_email), ("phone", is_phone), ("id", is_id),
                       ("percentage", is_percent), ("currency", is_currency)):
        if test(name):
            return role
    return None


def score_contact(name: str) -> str | None:
    """``email``/``phone`` when the quality score checks the cells of this column."""
    key = column_key(name)
    if any(part in key for part in vocab.SCORE_EMAIL_PARTS):
        return "email"
    if any(part in key for part in vocab.SCORE_PHONE_PARTS):
        return "phone"
    return None


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def identifier_columns(df: DataFrame, substring: bool = False) -> list[str]:
    """Columns whose name marks an identifier: a whole word by default, anywhere in the
    name with ``substring=True``."""
    parts = vocab.IDENTIFIER_PARTS
    if substring:
        return [c for c in df.columns if any(part in c.lower() for part in parts)]
    return [c for c in df.columns if _is_word(column_key(c), parts)]


def measure_columns(df: DataFrame, substring: bool = False) -> list[str]:
    """Numeric columns that are not identifiers."""
    skip = set(identifier_columns(df, substring))
    return [c for c in numeric_columns(df) if c not in skip]
