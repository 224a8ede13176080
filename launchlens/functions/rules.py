"""Classification rules over single columns: products, enums, regions, deposits, identity numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from launchlens.functions.semantics import as_col

# Product-name tokens that mark a range extender.
RANGE_EXTENDER_TOKENS = ("52", "66")

# Spellings of the two genders.
GENDER_SPELLINGS = {
    "male": ("男", "male", "m", "1"),
    "female": ("女", "female", "f", "0"),
}

# Region keywords, first match wins.
REGION_TYPE_RULES = (
    ("virtual", ("虚拟", "Virtual", "线上", "网络", "电商", "数字")),
    ("fac", ("FAC", "fac", "工厂", "Factory", "直营")),
)

# Deposit amount by group substring, first match wins.
DEPOSIT_RULES = (("LS9", 5000.0), ("CM2", 2000.0))

# Weights and check characters of the 18-character identity number.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK_CHARS = ("1", "0", "X", "9", "8", "7", "6", "5", "4", "3", "2")


def product_category(
    col: str | Column,
    tokens: Sequence[str] = RANGE_EXTENDER_TOKENS,
    hit: str = "range_extender",
    miss: str = "battery",
    unknown: str = "unknown",
) -> Column:
    """A product whose name contains a token is a hit, any other name a miss."""
    c = F.trim(as_col(col))
    contains = F.lit(False)
    for t in tokens:
        contains = contains | c.contains(t)
    return F.when(as_col(col).isNull() | (c == ""), unknown).when(contains, hit).otherwise(miss)


def normalize_enum(
    col: str | Column, spellings: Mapping[str, Sequence[str]] = GENDER_SPELLINGS, unknown: str = "unknown"
) -> Column:
    c = F.lower(F.trim(as_col(col).cast("string")))
    out = None
    for label, words in spellings.items():
        hit = c.isin([w.lower() for w in words])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(unknown)


def region_norm(col: str | Column, unknown: str = "unknown") -> Column:
    c = F.trim(as_col(col))
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), unknown).otherwise(c)


def region_type(
    col: str | Column,
    rules: Sequence[tuple[str, Sequence[str]]] = REGION_TYPE_RULES,
    default: str = "traditional",
    unknown: str = "unknown",
) -> Column:
    """Ordered keyword rules; no match is the default type."""
    c = F.trim(as_col(col))
    out = F.when(c.isNull() | (c == unknown), unknown)
    for label, words in rules:
        for w in words:
            out = out.when(c.contains(w), label)
    return out.otherwise(default)


def map_contains(col: str | Column, rules: Sequence[tuple[str, float]] = DEPOSIT_RULES) -> Column:
    """Value of the first rule whose token the upper-cased column contains, else null."""
    c = F.upper(as_col(col))
    out = None
    for token, value in rules:
        out = F.when(c.contains(token), F.lit(value)) if out is None else out.when(c.contains(token), F.lit(value))
    return out.otherwise(F.lit(None).cast("double"))


def id_valid(col: str | Column) -> Column:
    """18 characters: 17 digits and the weighted mod-11 check character. Null or malformed is False."""
    c = F.upper(F.trim(as_col(col).cast("string")))
    well_formed = F.coalesce(c.rlike(r"^[0-9]{17}[0-9X]$"), F.lit(False))

    def weighted(n: Column) -> Column:
        place = lambda k: F.call_function("div", n, F.lit(10**k)) % 10
        return sum((place(16 - i) * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))

    # the one-element array binds the number once for all seventeen terms
    number = F.substring(c, 1, 17).try_cast("bigint")
    total = F.element_at(F.transform(F.array(number), weighted), 1)
    expected = F.element_at(F.array(*[F.lit(x) for x in ID_CHECK_CHARS]), (F.pmod(total, F.lit(11)) + 1).cast("int"))
    return F.when(well_formed, F.substring(c, 18, 1) == expected).otherwise(F.lit(False))
