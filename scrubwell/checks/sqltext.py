"""Building blocks of the SQL oracle, written for the SQL engine's own functions."""
from __future__ import annotations

from ..functions import vocab
from . import fixtures as fx

_W = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
MC, MC_DUP, MO, ML = (f"({fx.oracle(s)})" for s in (fx.MC, fx.MC_DUP, fx.MO, fx.ML))


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def values(rows) -> str:
    cell = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v).upper()
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{_W}+', ''), '{_W}+\z', '')"


def tokens(x: str, words=vocab.MISSING_TOKENS) -> str:
    return f"CASE WHEN lower({trim(x)}) IN {in_list(words)} THEN NULL ELSE {trim(x)} END"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}+', ' ', 'g'), ' ')"


def title(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\p{{L}}+|\P{{L}}+)'), "
            "lambda w: upper(w[1]) || w[2:]), '')")


def number(x: str) -> str:
    t = f"lower({trim(x)})"
    bare = trim(f"regexp_replace({t}, '[{vocab.CURRENCY_SIGNS},%]', '', 'g')")
    words = " ".join(f"WHEN {quote(w)} THEN CAST({n} AS DOUBLE)" for w, n in vocab.NUMBER_WORDS.items())
    return (rf"CASE WHEN regexp_matches({bare}, '\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z') "
            rf"THEN TRY_CAST({bare} AS DOUBLE) ELSE CASE {t} {words} END END")


def date(x: str) -> str:
    return f"try_strptime({trim(x)}, ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%d %B %Y'])"


def phone(x: str) -> str:
    steps = trim(x)
    for pattern in (r"\.0\z", r"\A\+91", r"\A0091"):
        steps = f"regexp_replace({steps}, '{pattern}', '')"
    return f"nullif(regexp_replace({steps}, '[^0-9]', '', 'g'), '')"


def phone_ten(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (f"CASE WHEN length({d}) = 10 THEN {d} WHEN length({d}) = 12 AND starts_with({d}, '91') "
            f"THEN substring({d}, 3) END")


EMAIL = r"\A[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]+\z"
PHONE = r"\A[0-9]{10,15}\z"


def is_email(x: str) -> str:
    return f"regexp_matches({x}, '{EMAIL}')"


def is_phone(x: str) -> str:
    return f"regexp_matches({x}, '{PHONE}')"


def half_up(x: str, digits: int) -> str:
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"floor(({x}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale}"


def case_map(x: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {other} END"


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


# --- label dictionary -----------------------------------------------------------------------
def format_key(x: str) -> str:
    t = f"lower({trim(x)})"
    tail = rf"regexp_extract({t}, '[\pL\pN_]([+#\-]+)\z', 1)"
    body = rf"regexp_replace({t}, '([\pL\pN_])[+#\-]+\z', '\1')"
    return (rf"trim(regexp_replace(regexp_replace({body}, '[\s_\-/]+', ' ', 'g'), '[^\pL\pN_ ]+', '', 'g'), ' ')"
            f" || {tail}")


def dictionary(source: str, traits) -> str:
    """CTEs ending in ``dict``. ``traits``: (column, hinted, gender, bool_like, semantic key)."""
    hist = union(f"SELECT '{c}' AS \"column\", {hinted} AS hinted, {gender} AS gender, {bools} AS bool_like, "
                 f"{quote(key)} AS key, {collapse(c)} AS value, count(*) AS cnt FROM {source} "
                 f"WHERE {c} IS NOT NULL GROUP BY ALL" for c, hinted, gender, bools, key in traits)
    semantic = values([(k, raw, label) for k, t in vocab.SEMANTIC_LABELS.items() for raw, label in t.items()])
    plural = ("CASE WHEN fk LIKE '%ies' AND length(fk) > 4 THEN left(fk, length(fk) - 3) || 'y' "
              "WHEN fk LIKE '%ses' AND length(fk) > 5 THEN left(fk, length(fk) - 2) "
              "WHEN fk LIKE '%s' AND fk NOT LIKE '%ss' AND length(fk) > 3 THEN left(fk, length(fk) - 1) ELSE fk END")
    best = lambda key, order: (
        f"CASE WHEN coalesce({key}, '') <> '' AND count(*) OVER (PARTITION BY \"column\", {key}) > 1 THEN "
        f"first_value(value) OVER (PARTITION BY \"column\", {key} ORDER BY {order}) END")
    return rf"""
hist AS ({hist}),
sized AS (SELECT *, count(*) OVER (PARTITION BY "column") AS distinct_values FROM hist),
fk AS (SELECT *, {format_key("value")} AS fk FROM sized
       WHERE distinct_values <= CASE WHEN hinted THEN 200 ELSE 50 END),
ck AS (SELECT *, {case_map("raw_ck", vocab.COMPACT_ALIASES, "raw_ck")} AS ck, {plural} AS pk
       FROM (SELECT *, CASE WHEN regexp_matches(fk, '[a-z0-9]')
             THEN regexp_replace(fk, '[^a-z0-9+#\-]+', '', 'g') END AS raw_ck FROM fk)),
rules AS (SELECT ck.*,
  {best("fk", "cnt DESC, value")} AS k3,
  {best("ck", "cnt DESC, length(value) DESC, value")} AS k4,
  CASE WHEN gender THEN {case_map("fk", vocab.GENDER)} END AS k5,
  CASE WHEN hinted THEN {case_map("ck", vocab.GENERIC_ALIASES)} END AS k5b,
  sem.label AS k6,
  CASE WHEN bool_like THEN CASE WHEN fk IN {in_list(vocab.TRUE_WORDS)} THEN 'True'
                                WHEN fk IN {in_list(vocab.FALSE_WORDS)} THEN 'False' END END AS k7,
  {best("pk", "cnt DESC, length(value) DESC, value")} AS k8
  FROM ck LEFT JOIN {semantic} sem(key, raw, label) ON sem.key = ck.key AND sem.raw = ck.fk),
resolved AS (SELECT *, CASE WHEN gender THEN coalesce(k5, k4, k3, value)
                       ELSE coalesce(k8, k7, k6, k5b, k4, k3, value) END AS label FROM rules),
dict AS (SELECT *, CASE WHEN hinted AND NOT gender AND key NOT IN {in_list(vocab.SEMANTIC_LABELS)}
                         AND lower(label) = label AND length(label) > 1 THEN {title("label")}
                    ELSE label END AS canonical FROM resolved)"""


# column, hinted, gender, bool_like, column key
ML_TRAITS = [
    ("channel", True, False, False, "channel"), ("division", True, False, False, "division"),
    ("product_type", True, False, False, "product_type"), ("skill", False, False, False, "skill"),
    ("is_member", False, False, True, "is_member"), ("customer_gender", False, True, False, "customer_gender"),
    ("employment_type", True, False, False, "employment_type"), ("education", True, False, False, "education"),
    ("ship_state", False, False, False, "ship_state"), ("part_note", False, False, False, "part_note"),
]
MO_TRAITS = [
    ("city", True, False, False, "city"), ("state", True, False, False, "state"),
    ("order_status", True, False, False, "order_status"), ("payment_method", False, False, False, "payment_method"),
    ("sales_channel", False, False, False, "sales_channel"), ("category", True, False, False, "category"),
]
