"""Text, score and structure functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quadrille.functions import as_col
from quadrille.functions.words import IRREGULAR, KEYWORD_STOP, TITLE_STOP

WORD = r"[\p{L}\p{N}_]+"


def words_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column | str) -> Column:
    """All words in lower case, repeated ones kept; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(text), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def content_words(text: Column | str) -> Column:
    """Distinct words that are no stop words."""
    return F.array_except(F.array_distinct(tokenize(text)), words_array(TITLE_STOP))


def keywords(text: Column | str, least: int = 3) -> Column:
    """Words of at least so many letters outside the keyword stop list, repeated ones kept."""
    stop = words_array(KEYWORD_STOP)
    return F.filter(tokenize(text), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def eval_tokens(text: Column | str) -> Column:
    """Distinct lower-case code-like or plain words of two letters or more that are no stop words."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(rf"([A-Za-z]{{2,}}\d{{0,3}}[A-Za-z]?|{WORD})"), F.lit(1))
    stop = words_array(TITLE_STOP)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def query_phrases(text: Column | str) -> Column:
    """Maximal runs of words that are no stop words, each joined by blanks."""
    stop = words_array(TITLE_STOP)
    marked = F.array_join(F.transform(tokenize(text), lambda w: F.when(F.array_contains(stop, w), F.lit("|")).otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def multifield(*parts: Column | str) -> Column:
    """Non-blank parts joined by '. '."""
    return F.concat_ws(". ", *[F.when(F.trim(as_col(p)) != "", F.trim(as_col(p))) for p in parts])


def model_query(model: Column | str, text: Column | str) -> Column:
    """The query as the model family wants it."""
    m = F.lower(as_col(model))
    return F.when(m.contains("e5"), F.concat(F.lit("query: "), as_col(text))).when(
        m.contains("bge"), F.concat(F.lit("Represent this sentence for searching relevant passages: "), as_col(text))
    ).otherwise(as_col(text))


def model_passage(model: Column | str, text: Column | str) -> Column:
    return F.when(F.lower(as_col(model)).contains("e5"), F.concat(F.lit("passage: "), as_col(text))).otherwise(as_col(text))


def finite(x: Column | str) -> Column:
    """The number, or 0 for null, NaN and infinities."""
    c = as_col(x).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(as_col(v), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def minmax(x: Column | str, over: Window) -> Column:
    """Scaled to 0..1 over a window; all ones where the range is below 1e-12."""
    c = as_col(x)
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((c - low) / (high - low))


def clipped_z(x: Column | str, over: Window, clip: float = 3.0) -> Column:
    """Population z-score over a window, 0 for a constant, clipped."""
    c = as_col(x).cast("double")
    mean, dev = F.avg(c).over(over), F.stddev_pop(c).over(over)
    return F.when(dev < 1e-6, F.lit(0.0)).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), (c - mean) / (dev + 1e-6))))


def softmax(x: Column | str, over: Window, temperature: float = 1.0) -> Column:
    """Softmax over a window with a temperature, at least 1e-10 before it is scaled again."""
    c = as_col(x).cast("double")
    e = F.exp((c - F.max(c).over(over)) / temperature)
    p = F.greatest(e / F.sum(e).over(over), F.lit(1e-10))
    return p


def clean_html(html: Column | str) -> Column:
    """Text of HTML: scripts, styles and tags dropped, white space made single blanks."""
    c = F.regexp_replace(as_col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def slug(text: Column | str, most: int = 180) -> Column:
    """Runs of other characters than ASCII letters, digits, dot and dash become one underscore."""
    c = F.regexp_replace(F.trim(F.coalesce(as_col(text), F.lit(""))), r"[^A-Za-z0-9.\-]+", "_")
    return F.substring(F.regexp_replace(c, "^_+|_+$", ""), 1, most)


def excerpt(text: Column | str, most: int = 220) -> Column:
    return F.translate(F.substring(as_col(text), 1, most), "\n", " ")


def program_name(text: Column | str) -> Column:
    """The name behind the last 'Program:', up to a comma or line end, camel case split."""
    after = F.when(as_col(text).contains("Program:"), F.substring_index(as_col(text), "Program:", -1))
    name = F.trim(F.regexp_extract(after, r"^([^,\n]*)", 1))
    return F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")


def is_transfer_credit(line: Column | str) -> Column:
    return F.regexp_count(as_col(line), F.lit(r"\d\.\d{2}")) == 1


def level_requirement(text: Column | str) -> Column:
    """struct(level, comparison) of the first level phrase; null if there is none."""
    pattern = r"(?i)\b(?:level|lev)\.?\s+(at\s+least\s+)?([1-4][AB])(\s+or\s+higher)?"
    level = F.upper(F.regexp_extract(as_col(text), pattern, 2))
    more = (F.regexp_extract(as_col(text), pattern, 1) != "") | (F.regexp_extract(as_col(text), pattern, 3) != "")
    return F.when(level != "", F.struct(level.alias("level"), F.when(more, "at_least").otherwise("exact").alias("comparison")))


def program_names(text: Column | str) -> Column:
    """Names separated by commas or 'or', the marks H- and JH- stripped in that order."""
    parts = F.split(as_col(text), r",|\s+or\s+")
    cleaned = F.transform(parts, lambda p: F.trim(F.replace(F.replace(F.trim(p), F.lit("H-"), F.lit("")), F.lit("JH-"), F.lit(""))))
    return F.array_distinct(F.filter(cleaned, lambda p: p != ""))


def json_block(reply: Column | str) -> Column:
    """The JSON part of a model's reply: a fenced block, else from the first brace to the last, else the whole; null if invalid."""
    c = as_col(reply)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)
    pick = F.when(F.trim(fenced) != "", F.trim(fenced)).when(braces != "", braces).otherwise(F.trim(c))
    return F.when(F.try_parse_json(pick).isNotNull(), pick)


def first_score(*scores: Column | str) -> Column:
    """The first score that is not null, 0 if none is."""
    return F.coalesce(*[as_col(s).cast("double") for s in scores], F.lit(0.0))


def match_percent(score: Column | str) -> Column:
    """min(99, round half up of 100 * score)."""
    return F.least(F.lit(99), F.floor(as_col(score) * 100 + 0.5)).cast("int")


def match_label(score: Column | str) -> Column:
    p = match_percent(score)
    return F.when(p >= 80, "excellent").when(p >= 60, "good").when(p >= 40, "fair").otherwise("low")


def first_n_more(names: Column | str, n: int = 2) -> Column:
    """The first names joined, and '+k more' if there are more."""
    c = as_col(names)
    head = F.array_join(F.slice(c, 1, n), ", ")
    return F.when(F.size(c) > n, F.concat(head, F.lit(" +"), (F.size(c) - n).cast("string"), F.lit(" more"))).otherwise(head)


def is_regular(title: Column | str, description: Column | str, code: Column | str) -> Column:
    """Whether no part of a course marks a seminar, work term or co-op."""
    pattern = "|".join(IRREGULAR)
    parts = [~F.lower(F.coalesce(as_col(c), F.lit(""))).rlike(pattern) for c in (title, description, code)]
    return parts[0] & parts[1] & parts[2]
