"""Course codes as Column expressions: normal form, department, level, term numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import as_col


def normalize_code(code: Column | str, alias_msci: bool = True) -> Column:
    """Upper case without white space, a leading MSCI read as MSE; null becomes ''."""
    c = F.regexp_replace(F.upper(F.coalesce(as_col(code), F.lit(""))), r"[\s ]+", "")
    return F.regexp_replace(c, "^MSCI", "MSE") if alias_msci else c


def dept_prefix(code: Column | str) -> Column:
    """Leading ASCII letters in upper case, '' if there are none."""
    return F.upper(F.regexp_extract(as_col(code), "^([A-Za-z]+)", 1))


def dept_before_digit(code: Column | str) -> Column:
    """Everything before the first digit; the whole string if it has none."""
    return F.regexp_extract(as_col(code), "^([^0-9]*)", 1)


def dept_letters(code: Column | str) -> Column:
    """All letters of the code joined, a letter at the end included."""
    return F.regexp_replace(as_col(code), r"[^\p{L}]", "")


def is_100_level(code: Column | str) -> Column:
    """Whether the first run of digits is a number from 100 to 199."""
    number = F.regexp_extract(as_col(code), r"(\d+)", 1).try_cast("bigint")
    return F.coalesce(number.between(100, 199), F.lit(False))


def is_code_query(query: Column | str) -> Column:
    """Whether the query, in normal form, is a course code."""
    return normalize_code(query).rlike("^[A-Z]{2,}[0-9]{3}[A-Z]*$")


def digit_key(query: Column | str) -> Column:
    """The longest run of three or more digits, the first of equals; null if there is none."""
    runs = F.regexp_extract_all(as_col(query), F.lit(r"(\d{3,})"), F.lit(1))
    best = F.aggregate(runs, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    return F.when(F.size(runs) > 0, best)


def term_id(year: Column | str, month: Column | str) -> Column:
    """(year - 1900) * 10 plus 1, 5 or 9 for the term that holds the month."""
    first = (F.floor((as_col(month) - 1) / 4) * 4 + 1).cast("int")
    return ((as_col(year) - 1900) * 10 + first).cast("int")


def term_name(term: Column | str) -> Column:
    """Winter, Spring or Fall and the year of a term number; null for any other last digit."""
    t = as_col(term)
    season = F.when(t % 10 == 1, "Winter").when(t % 10 == 5, "Spring").when(t % 10 == 9, "Fall")
    return F.concat(season, F.lit(" "), (F.floor(t / 10) + 1900).cast("string"))


#: The order of the study levels.
LEVELS = ("1A", "1B", "2A", "2B", "3A", "3B", "4A", "4B")


def level_ordinal(level: Column | str) -> Column:
    """1 for 1A to 8 for 4B, null for anything else."""
    order = F.array(*[F.lit(x) for x in LEVELS])
    at = F.array_position(order, F.upper(F.trim(as_col(level))))
    return F.when(at > 0, at).cast("int")


def level_passes(level: Column | str, required: Column | str, comparison: Column | str) -> Column:
    """Whether a level meets a requirement; an unknown level on either side passes."""
    have, need = level_ordinal(level), level_ordinal(required)
    met = F.when(as_col(comparison) == "at_least", have >= need).otherwise(have == need)
    return F.coalesce(met, F.lit(True))
