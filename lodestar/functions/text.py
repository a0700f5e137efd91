"""Text functions as Spark columns: tokenizers, amounts, windows, templates."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Retrieval tokens: runs of lower-case ASCII letters and digits, or of two and more Hangul syllables.
RETRIEVAL_TOKEN = "[a-z0-9]+|[가-힣]{2,}"
#: Answer tokens: runs of ASCII letters, digits and Hangul, single syllables too.
ANSWER_TOKEN = "[0-9a-zA-Z가-힣]+"
NUMBER = r"[0-9][0-9,]*[0-9]|[0-9]"
#: Characters that end a sentence.
SENTENCE_BREAKS = "\n.。!?;:·▪◦□■○●◇◆-–—|"
#: How far from a match a sentence may reach.
SENTENCE_REACH = 45


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b\u00a0\u3000"))


def tokens(text: Column) -> Column:
    """Retrieval tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RETRIEVAL_TOKEN), F.lit(0))


def answer_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ANSWER_TOKEN.replace("A-Z", "")), F.lit(0))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def clean(text: Column) -> Column:
    """CR to LF, runs of blanks to one space, lines trimmed, empty lines dropped."""
    spaced = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), "[ \\t\u00a0]+", " ")
    return F.array_join(F.filter(F.transform(F.split(spaced, "\n"), lambda x: strip(x)), lambda x: x != ""), "\n")


def file_stem(name: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def parse_filename(name: Column) -> Column:
    """struct(agency, project) of ``agency_project.ext``; without an underscore all is the project."""
    stem = F.translate(file_stem(name), "（）", "()")
    agency, project = F.regexp_extract(stem, "^([^_]+)_(.+)$", 1), F.regexp_extract(stem, "^([^_]+)_(.+)$", 2)
    fits = stem.rlike("^[^_]+_.+$")
    return F.struct(
        F.when(fits, strip(agency)).otherwise(F.lit("")).alias("agency"),
        F.when(fits, strip(F.regexp_replace(project, r"\s+", " "))).otherwise(stem).alias("project"),
    )


def parse_won(text: Column) -> Column:
    """The first amount before 원 as a long, or null."""
    return F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*)\s*원", 1), ",", "").try_cast("long")


def format_won(n: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit("원"))


def korean_units(n: Column) -> Column:
    """억, 만 and the rest, without parts that are zero."""
    eok, man, rest = F.floor(n / 100_000_000).cast("long"), F.floor(F.pmod(n, F.lit(100_000_000)) / 10_000).cast("long"), F.pmod(n, F.lit(10_000))
    parts = F.array(
        F.when(eok > 0, F.concat(F.format_number(eok, 0), F.lit("억"))), F.when(man > 0, F.concat(F.format_number(man, 0), F.lit("만"))), F.when(rest > 0, F.format_number(rest, 0)),
    )
    return F.concat(F.array_join(parts, " "), F.lit(" 원"))


def number_set(text: Column) -> Column:
    """Distinct numbers without commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","))))


_AMOUNT = r"(?:(\d[\d,]*)\s*억)?\s*(?:(\d[\d,]*)\s*만)?\s*(\d[\d,]*)?\s*원"


@F.pandas_udf(StringType())
def normalize_amounts(text: pd.Series) -> pd.Series:
    """Amounts in 억 and 만 units as digits; others stay. A replacement that is computed from its match needs Python."""
    import re

    pattern = re.compile(_AMOUNT)
    number = lambda s: int(s.replace(",", "")) if s else 0

    def digits(m):
        eok, man, won = m.groups()
        return f"{number(eok) * 10**8 + number(man) * 10**4 + number(won):,}원" if eok or man else m[0]

    return text.map(lambda s: None if s is None else pattern.sub(digits, s))


def window_around(text: Column, start: Column, end: Column, pad: int = 40) -> Column:
    """Text from ``pad`` before ``start`` to ``pad`` after ``end`` (0-based, end exclusive), on one line."""
    low = F.greatest(F.lit(0), start - pad)
    return strip(F.translate(F.substring(text, low + 1, end + pad - low), "\n", " "))


def sentence_around(text: Column, start: Column, end: Column, pad: int = SENTENCE_REACH) -> Column:
    """The span up to the nearest sentence breaks, at most ``pad`` characters away."""
    breaks = "".join("\\" + c if c in "\\]^-.|?" else c for c in SENTENCE_BREAKS)
    low = F.greatest(F.lit(0), start - pad)
    # replacing keeps its compiled pattern from row to row, splitting doesn't
    left = F.regexp_replace(F.substring(text, low + 1, start - low), f"(?s)^.*[{breaks}]", "")
    right = F.regexp_replace(F.substring(text, end + 1, F.lit(pad)), f"(?s)[{breaks}].*", "")
    return strip(F.concat(left, F.substring(text, start + 1, end - start), right))


def first_match(text: Column, patterns: Iterable[str], pad: int = 40) -> Column:
    """struct(value, evidence) of the first pattern that matches, or null."""
    found = []
    for p in patterns:
        at = F.regexp_instr(text, F.lit(p)) - 1
        value = F.regexp_extract(text, p, 0)
        found.append(F.when(at >= 0, F.struct(strip(value).alias("value"), window_around(text, at, at + F.length(value), pad).alias("evidence"))))
    return F.coalesce(*found)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def fill(template: Column, a: Column) -> Column:
    return F.replace(template, F.lit("{a}"), a)


def iri(eid: Column, space: str = "urn:entity:") -> Column:
    """Percent-encoded identifier; spaces as %20."""
    return F.concat(F.lit(space), F.replace(F.url_encode(eid), F.lit("+"), F.lit("%20")))


def from_iri(value: Column, space: str = "urn:entity:") -> Column:
    return F.url_decode(F.substring(value, F.lit(len(space) + 1), F.length(value)))


def prefixed(text: Column, prefix: str) -> Column:
    """The prefix that an asymmetric encoder asks for."""
    return F.concat(F.lit(prefix), text)


def positions(text: Column, needle: Column) -> Column:
    """0-based starts of the non-overlapping occurrences of a literal, first to last.

    Each step looks for the next one behind the last, so the work is the length
    of the text, whatever the needle holds. There can be no more steps than
    needles fit into the text.
    """
    none = F.array().cast("array<int>")
    most = (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)

    def step(acc: Column, _: Column) -> Column:
        at = F.position(needle, text, acc.behind)
        return F.struct(F.array_append(acc.found, at - 1).alias("found"), (at + F.length(needle)).alias("behind"))

    start = F.struct(none.alias("found"), F.lit(1).alias("behind"))
    every = F.aggregate(F.sequence(F.lit(1), most.cast("int")), start, step, lambda acc: acc.found)
    return F.when((F.length(needle) > 0) & text.contains(needle), every).otherwise(none)


def grams(text: Column, longest: int = 3) -> Column:
    """The distinct pieces of 1 to ``longest`` characters."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(text, i, F.lit(k)) for k in range(1, longest + 1)]))))
