"""Words that show that something is regular or standing, in Chinese and English, and dates written in texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import HAN, SPACELESS, _within, quote_fold, quote_place, units_of

# The patterns of regularity. Chinese ones are looked for in the NFKC form, English ones in that form with
# case folded and single spaces.
CHINESE = re.compile(
    r"每[天日周月年晚早个]|每次|每逢|天天|一周[^。，；,;]{0,6}次|[两二三四五六七八九十几]+次|固定|雷打不动|照例|照常|"
    r"(?<![非正日异反照无经])常|经常|总是|总会|一直|习惯|一般|平时|平常|通常|向来|多年|长期|坚持|从不|从来|今后|默认|一律|"
    r"(?:从今|从此|今)以后|以后(?=[^。，；,;]{0,4}?(?:都|就|一律|统一|每|一直|总|全|别|不要|不再|尽量))|"
    r"(?:最近|近|这|过去)(?:[一二两三四五六七八九十几半]|\d+)个?多?(?:天|周|星期|礼拜|月|年)(?:来|以来)?[^。，；,;]{0,3}?都|"
    r"[一二三四五六日](?:[、和]?[一二三四五六日])+(?:早|晚|上|下|都)"
)
COUNT = r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|several|a\s+few|few|(?:a\s+)?couple\s+of|many)"
UNIT = (
    r"(?:days?|mornings?|afternoons?|evenings?|nights?|weeks?|weekends?|weekdays?|workdays?|months?|years?|times?|"
    r"summers?|winters?|springs?|autumns?|falls?|holidays?|mondays?|tuesdays?|wednesdays?|thursdays?|fridays?|saturdays?|sundays?)"
)
ENGLISH = re.compile(
    r"\b(?:every|each)\s+(?:other\s+|single\s+|" + COUNT + r"\s+)?" + UNIT + r"\b|\beveryday\b|"
    r"\b(?:daily|nightly|weekly|fortnightly|biweekly|monthly|quarterly|yearly|annually)\b|"
    r"\b(?:once|twice|thrice|" + COUNT + r"\s+(?:times|days|nights|mornings|evenings|hours?|minutes?|km|"
    r"kilometers?|kilometres?|miles?|laps?|cups?|sessions?))\s+(?:a|an|per|each|every)\s+"
    r"(?:day|night|week|weekend|month|year)\b|\bper\s+(?:day|night|week|month|year)\b|"
    r"\btwice\b|\b(?:two|three|four|five|six|seven|eight|nine|ten|several|many|countless|\d+)\s+times\b"
    r"(?!\s+(?:as|more|less|better|worse|faster|slower|bigger|larger|higher|lower|longer|smaller|cheaper|over))|"
    r"\b(?:mondays|tuesdays|wednesdays|thursdays|fridays|saturdays|sundays)\b|\bon\s+(?:weekends|weekdays|workdays)\b|"
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\s+(?:mornings|afternoons|evenings|nights)\b|"
    r"\bmost\s+(?:days|mornings|afternoons|evenings|nights|weekends|weeks|weekdays|workdays)\b|\bmost\s+of\s+the\s+time\b|"
    r"\b(?:usually|normally|typically|generally|always|often|frequently|regularly|routinely|habitually|customarily|"
    r"constantly|consistently|invariably|religiously|never)\b(?<!every\sso\soften)|"
    r"\bwhenever\b(?!\s+(?:possible|needed|necessary))|\btend(?:s|ed)?\s+to\b|\bas\s+(?:a\s+rule|usual|always|ever)\b|"
    r"\bwithout\s+(?:fail|exception)\b|\bno\s+matter\s+what\b|\ball\s+the\s+time\b|\bon\s+a\s+regular\s+basis\b|"
    r"\bmakes?\s+a\s+point\s+of\b|\bset\s+in\s+stone\b|"
    r"\b(?:habit|habits|habitual|routine|routines|ritual|rituals)\b|"
    r"\b(?:is|am|are|was|were|be|been|get|gets|got|gotten|become|becomes|became)\s+used\s+to\b|"
    r"\b(?:stick|sticks|stuck|sticking)\s+(?:to|with)\b|\b(?:keeps?|kept|keeping)\s+(?:it\s+)?up\b|\binsists?\s+on\b|"
    r"\bfor\s+(?:(?:many|several|a\s+few|over|more\s+than|nearly|almost|about|some|\d+|\w+)\s+){0,3}"
    r"(?:years|decades)\b|\bfor\s+(?:almost|nearly|over|more\s+than)\s+a\s+year\b|\bfor\s+a\s+long\s+time\b|"
    r"\byears\s+of\b|\blong[-\s]?(?:term|standing|time)\b|\ball\s+along\b|\bever\s+since\b|"
    r"\bsince\s+(?:childhood|college|university|high\s+school|school|he\s+was|she\s+was|they\s+were|i\s+was)\b|"
    r"\bfrom\s+now\s+on\b|\bgoing\s+forward\b|\bhenceforth\b|\bin\s+(?:the\s+)?future\b|\bfrom\s+then\s+on\b|"
    r"\bby\s+default\b|\bfixed\s+(?:time|times|schedule|day|days|hour|hours|routine)\b"
)
# Common English words, one of which marks a quote in Latin letters as English.
ENGLISH_WORDS = frozenset(
    "the a an and or but not no of to in on at for with from by about after before than then when while if so as up out off "
    "he she his her him they their them it its i my me you your we our that this these those what who which all every each more "
    "is was were are be been has had have do does did will would can could should must may might very just only still also again".split()
)
DATE = r"(20\d\d)[-/.年](\d{1,2})[-/.月](\d{1,2})"


def mostly_han(folded: str) -> bool:
    """Chinese: no other script without spaces, and Han characters for half the length at least."""
    han = sum(_within(c, HAN) for c in folded)
    return not any(_within(c, SPACELESS) for c in folded) and 0 < han and 2 * han >= units_of(folded)


def is_english(body: str) -> bool:
    """English: nine in ten letters, Han aside, are ASCII, no other script without spaces, and one common word."""
    form = unicodedata.normalize("NFKC", body).casefold()
    letters = [c for c in form if c.isalpha() and not _within(c, HAN)]
    latin = bool(letters) and not any(_within(c, SPACELESS) for c in form) and 10 * sum(c.isascii() for c in letters) >= 9 * len(letters)
    return latin and not ENGLISH_WORDS.isdisjoint(re.findall("[a-z]+", form))


def is_regular(quote: str, marked: str | None = None, least: float = 1.0) -> bool:
    """True if a quote shows regularity: by its language's list, or, unless it is Chinese, by the words ``marked`` in it."""
    form, folded = unicodedata.normalize("NFKC", quote), quote_fold(quote)
    if mostly_han(folded):
        return CHINESE.search(form) is not None
    if is_english(quote) and ENGLISH.search(" ".join(form.casefold().split())):
        return True
    words = quote_fold(marked or "")
    return units_of(words) >= least and words in folded


def shows_regularity(quotes: list[str], marked: str | None, folded: list[str]) -> bool:
    """True if one of the quotes that stand in the folded texts shows regularity."""
    return any(quote_place(q, folded) is not None and is_regular(q, marked) for q in quotes)


@F.pandas_udf(T.BooleanType())
def regular(quote: pd.Series, marked: pd.Series) -> pd.Series:
    return pd.Series([is_regular(q or "", m) for q, m in zip(quote, marked, strict=True)], dtype="bool")


def dates_in(body: Column) -> Column:
    """The distinct dates written in a text, as YYYY-MM-DD, sorted."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(DATE), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, DATE, i)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat_ws("-", part(x, 1), F.lpad(part(x, 2), 2, "0"), F.lpad(part(x, 3), 2, "0")))))


def dates_of(body: str) -> set[str]:
    return {f"{y}-{int(m):02d}-{int(d):02d}" for y, m, d in re.findall(DATE, body or "")}


#: The languages that results may be written in.
LANGUAGES = ("Chinese", "English", "German", "Japanese", "Korean", "Russian", "Spanish")


def output_language(name: Column) -> Column:
    """The known language that a name means, whatever its case; null for null; any other name is an error."""
    wanted = F.lower(F.trim(name))
    known = F.lit(None).cast("string")
    for language in LANGUAGES:
        known = F.when(wanted == language.lower(), F.lit(language)).otherwise(known)
    return F.when(name.isNotNull(), F.coalesce(known, F.raise_error(F.lit(f"output language: pass one of {', '.join(LANGUAGES)}")).cast("string")))


def language_rule(name: Column, chosen: str, fallback: str) -> Column:
    """The rule for a prompt: ``chosen`` with {{language}} filled in, or ``fallback`` where no language is named."""
    before, _, after = chosen.partition("{{language}}")
    return F.coalesce(F.concat(F.lit(before), output_language(name), F.lit(after)), F.lit(fallback))
