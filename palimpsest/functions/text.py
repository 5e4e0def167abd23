"""Text functions as Columns: normalisers, tokenisers, chunk starts, markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers must normalise as they do in the benchmark.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "，。！？、；：（）【】《》·…—～－–"
ARTICLES = ("a", "an", "the", "and")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
NO_INFORMATION = ("", "unknown", "unspecified", "not specified", "not provided", "n/a")
META_MARKERS = ("request for concise", "single-sentence state", "asked for summary", "question only", "not an observation", "formatting request")
OPTION_PATTERNS = (r"\b([A-F])\b", "选([A-F])", r"答案[是为：:]*\s*([A-F])", "([A-F])选项")

_ASCII_CLASS = r"[!-/:-@\[-`{-~]"
_CJK_CLASS = f"[{CJK_PUNCTUATION}]"


def normalize_text(c: Column) -> Column:
    """No punctuation, no white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _ASCII_CLASS, ""), _CJK_CLASS, ""), r"\s+", ""))


def normalize_answer(c: Column) -> Column:
    """No commas, lower case, no punctuation, no articles, single spaces; in this order."""
    c = F.lower(F.regexp_replace(c, ",", ""))
    c = F.regexp_replace(c, _ASCII_CLASS, "")
    c = F.regexp_replace(c, rf"\b({'|'.join(ARTICLES)})\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def number_words(c: Column) -> Column:
    """Number words to digits, whole words, any case."""
    return reduce(lambda x, nw: F.regexp_replace(x, rf"(?i)\b{nw[1]}\b", str(nw[0])), enumerate(NUMBER_WORDS), c)


def option_letters(c: Column) -> Column:
    """The option letters that an answer names, sorted; patterns run on the upper-cased text."""
    up = F.upper(c)
    found = F.flatten(F.array(*[F.regexp_extract_all(up, F.lit(p), F.lit(1)) for p in OPTION_PATTERNS]))
    return F.array_sort(F.array_distinct(found))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))


def cjk_share(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(F.regexp_replace(c, r"[一-鿿]", ""))) / n)


def language(c: Column, least: float = 0.1) -> Column:
    return F.when(cjk_share(c) > least, "zh").otherwise("en")


def tokenize(c: Column) -> Column:
    """Words; characters where the text is Chinese."""
    return F.when(language(c) == "zh", F.filter(F.split(F.lower(c), ""), lambda x: F.trim(x) != "")).otherwise(words(c))


def without_stop_words(tokens: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop))


def estimated_tokens(c: Column, chars: float = 3.0) -> Column:
    return F.floor(F.char_length(c) / chars).cast("long")


def slot(c: Column) -> Column:
    """a-z, 0-9 and single underscores."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, _ASCII_CLASS, " ")), r"\s+", " "))


def clean_tokens(c: Column) -> Column:
    return F.filter(F.split(clean(c), " "), lambda w: F.char_length(w) > 1)


def no_information(c: Column, values: Sequence[str] = NO_INFORMATION) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).isin(*values)


def has_marker(c: Column, markers: Sequence[str] = META_MARKERS) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(m.lower()) for m in markers])


def resolve_subject(c: Column, scope: Column, aliases: dict[str, str], participants: Sequence[str]) -> Column:
    """An alias, else a participant, else the scope's own subject for first-person words, else the slot."""
    low = F.lower(F.trim(c))
    out = F.when(low.isin("i", "me", "my", "user", "self"), scope)
    for a, b in aliases.items():
        out = out.when(low == a.lower(), F.lit(b))
    for p in participants:
        out = out.when(low == p.lower(), F.lit(p))
    return out.otherwise(slot(c))


def semantic_text(parts: Sequence[Column], limit: int = 4000) -> Column:
    return F.substring(F.concat_ws(" | ", *[F.when(p != "", p) for p in parts]), 1, limit)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256), 1, 16))


def without_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def last_fenced_json(c: Column) -> Column:
    """The content of the last ```json fence, or null."""
    return F.get(F.reverse(F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))), 0)


def retrieval_query(c: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, else the text."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in patterns], c)


def turn_reference(c: Column) -> Column:
    """A turn id out of wrappers such as [D1:3], turn D1:3 or (D1:3)."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^(?:turn\s+)?[\[(]?\s*(?:turn\s+)?([A-Za-z]\d+:\d+)\s*[\])]?$", 1), F.lit(""))


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """0, size - overlap, ...; the last chunk is the first that reaches n."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)) * step
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def protect_urls(c: Column) -> tuple[Column, Column]:
    """(text with numbered placeholders' common mark, the URLs in order)."""
    pattern = r"https?://[^\s\"'<>]+"
    return F.regexp_replace(c, pattern, "__URL__"), F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def restore_urls(c: Column, urls: Column) -> Column:
    """Puts the URLs back, in order."""
    parts = F.split(c, "__URL__")
    tail = F.zip_with(urls, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda u, p: F.concat(u, p))
    return F.concat(F.get(parts, 0), F.array_join(tail, ""))
