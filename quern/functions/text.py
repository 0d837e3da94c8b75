"""Text functions, Column to Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The control tokens of serialized records.
CONTROL_TOKENS = [
    "<|system|>", "<|user|>", "<|assistant|>", "<|thought|>", "<|answer|>", "<|code|>", "<|endcode|>", "<|end|>",
    "<|tool_call|>", "<|endtool_call|>", "<|tool_result|>", "<|endtool_result|>",
]
CONTROL_PATTERN = r"<\|(?:system|user|assistant|thought|answer|code|endcode|end|tool_call|endtool_call|tool_result|endtool_result)\|>"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def norm_eol(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_ctrl(c: Column) -> Column:
    """Without control characters; tab and line feed stay."""
    return F.regexp_replace(c, CONTROL_CHARS, "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def norm_code(c: Column) -> Column:
    """Code keeps its layout: only line ends are unified and control characters go."""
    return strip_ctrl(norm_eol(c))


def norm_prose(c: Column) -> Column:
    return collapse_spaces(strip_ctrl(norm_eol(c)))


def norm_markdown(c: Column) -> Column:
    """Prose between fences is normalised, fenced parts are kept as they are."""
    parts = F.split(c, "```")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, " +", " ")).otherwise(x)), "```")


def normalize(kind: Column, c: Column) -> Column:
    """Normalisation by content: prose, code, markdown, or anything else, which is kept."""
    return F.when(kind == "prose", norm_prose(c)).when(kind == "code", norm_code(c)).when(kind == "markdown", norm_markdown(c)).otherwise(c)


def control_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CONTROL_PATTERN))


def norm_key(c: Column) -> Column:
    """The form under which texts that differ in case, punctuation and spacing are equal."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(T.StringType())
def norm_unicode(s: pd.Series) -> pd.Series:
    """NFC; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)


def extract_answer(c: Column) -> Column:
    """The last number of a text; null if there is none."""
    return F.try_element_at(numbers(c), F.lit(-1)).cast("double")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def shingles(word_array: Column, n: int) -> Column:
    """md5 of each run of n words; the array must be a column of its own projection."""
    size = F.size(word_array)
    return F.when(size < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.md5(F.array_join(F.slice(word_array, i, n), " ")))
    )


def share_of(c: Column, pattern: str) -> Column:
    """The share of characters that match a one-character pattern."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(pattern)) / F.length(c)).otherwise(0.0)


#: Patterns of secrets, personal data and hostile code.
SECRETS = {"hex_token": r"""token = "[0-9a-f]{40}\"""", "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "access_key": "AKIA[0-9A-Z]{16}"}
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "card": r"\b\d{16}\b", "phone": r"\b\d{3}-\d{4}\b"}
HOSTILE = ["rm -rf /", "eval(base64", "curl .* \\| sh", "powershell -enc"]


def spans(c: Column, patterns: dict[str, str]) -> Column:
    """(type, span) of every match of every pattern."""

    def of(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), lambda x: F.struct(F.lit(name).alias("type"), x.alias("span")))

    return F.flatten(F.array(*[of(n, p) for n, p in patterns.items()]))


def luhn(c: Column) -> Column:
    """Whether the digits of a 16-digit string pass the Luhn check."""
    digit = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.when(i % 2 == 1, F.substring(c, i, F.lit(1)).cast("int") * 2).otherwise(F.substring(c, i, F.lit(1)).cast("int")))
    return F.aggregate(F.transform(digit, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def redact(c: Column, patterns: dict[str, str]) -> Column:
    for name, p in patterns.items():
        c = F.regexp_replace(c, p, f"[{name}]")
    return c


def html_struct(c: Column) -> Column:
    """(title, text, links) of a page by patterns; scripts, styles and comments go before tags, entities are decoded last."""
    bare = F.regexp_replace(c, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    decoded = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "&copy;|&middot;", " "), "&amp;", "&")
    return F.struct(
        F.replace(F.regexp_extract(c, "(?s)<title>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&")).alias("title"),
        F.trim(F.regexp_replace(decoded, r"\s+", " ")).alias("text"),
        F.regexp_extract_all(bare, F.lit('href="([^"]*)"'), 1).alias("links"),
    )


def compress(text: Column, terms: list[str], n: int) -> Column:
    """The n sentences with most of the terms, in their order of rank and place."""
    sentences = F.transform(F.split(text, r"(?<=\.)\s+"), lambda x, i: F.struct((-sum((F.when(F.contains(F.lower(x), F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))).alias("score"), i.alias("place"), x.alias("text")))
    return F.array_join(F.transform(F.slice(F.sort_array(sentences), 1, n), lambda s: s["text"]), " ")
