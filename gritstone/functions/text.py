"""Column functions on text: headings, white space, tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions import models

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORD_TOKEN = r"[\p{L}\p{N}]+"
SENTENCE = r"(?s).+?(?:[.!?]\s+|\z)"
FRAGMENT_TOKEN = r"(?:\A\s*)?(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])\s*"

#: Headings and the standard section each of them opens.
ALIASES = {
    "ABSTRACT": "ABSTRACT",
    "ABSTRACT OF THE DISCLOSURE": "ABSTRACT",
    "BACKGROUND": "BACKGROUND OF THE INVENTION",
    "BACKGROUND OF THE INVENTION": "BACKGROUND OF THE INVENTION",
    "SUMMARY": "SUMMARY",
    "SUMMARY OF THE INVENTION": "SUMMARY",
    "BRIEF SUMMARY": "SUMMARY",
    "DETAILED DESCRIPTION": "DETAILED DESCRIPTION",
    "DETAILED DESCRIPTION OF THE INVENTION": "DETAILED DESCRIPTION",
    "DETAILED DESCRIPTION OF PREFERRED EMBODIMENTS": "DETAILED DESCRIPTION",
    "CLAIMS": "CLAIMS",
    "WHAT IS CLAIMED IS": "CLAIMS",
}


def token_count(text: Column) -> Column:
    """Words and single marks; the default stand-in for a model's tokenizer."""
    return F.regexp_count(text, F.lit(TOKEN))


def tokens_of(text: Column, cfg: Config) -> Column:
    """Tokens of a text by the counter that ``cfg`` names; ``regex`` is token_count, others run in Arrow batches."""
    if cfg.token_counter == "regex":
        return token_count(text)
    factory = models.TOKEN_COUNTERS[cfg.token_counter]

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = models.loaded(factory)
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), dtype="int32")

    return count(text)


def _costs(counter: Callable, texts: list[str]) -> list[int]:
    """Tokens that each text takes in a chunk at most: by itself, or after another text and a space, whichever is more."""
    return [max(a, b) for a, b in zip(counter(texts), counter([" " + t for t in texts]), strict=True)]


def cut_text(text: str, most: int, counter: Callable) -> list[str]:
    """Pieces of ``text`` that cost at most ``most`` tokens by ``counter`` without the white space around them, if a
    single character does; together they are the text.

    Cuts are made where the counter says that tokens start (``counter.starts``), of a counter that does not say it between
    characters; the last place between words counts first, if it is not in the first half. Each piece is counted.
    """
    fits = lambda t: _costs(counter, [t.strip()])[0] <= most
    starts = counter.starts(text) if hasattr(counter, "starts") else range(1, len(text))
    words = {m.end() for m in re.finditer(r"\s+", text)}
    cuts = sorted({x for x in starts if 0 < x < len(text)} | words | {len(text)})
    out, at = [], 0
    while at < len(text):
        first = bisect_right(cuts, at)
        # the longest piece that fits: grown from ``most`` cuts, for a cut may stand for less than a token, and then halved
        low, high = first, min(len(cuts), first + most)
        while high < len(cuts) and fits(text[at : cuts[high - 1]]):
            low, high = high - 1, min(len(cuts), high + most)
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(text[at : cuts[middle]]) else (low, middle)
        if low + 1 < len(cuts) and high == len(cuts) and fits(text[at : cuts[-1]]):
            low = len(cuts) - 1
        end = cuts[low]
        if end < len(text) and end not in words:
            between = next((c for c in reversed(cuts[first : low + 1]) if c in words and 2 * (c - at) > end - at), end)
            end = between if fits(text[at:between]) else end
        if not fits(text[at:end]) and end - at > 1:  # one token's place that is too much: by halves, to single characters
            end = at + max(1, (end - at) // 2)
            while end - at > 1 and not fits(text[at:end]):
                end = at + (end - at) // 2
        out.append(text[at:end])
        at = end
    return out


def _by_list(f: Callable[[list], list], lists: pd.Series) -> pd.Series:
    """``f`` over the items of all lists at once, dealt back to the lists; null lists are empty."""
    parts = [[] if x is None else list(x) for x in lists.tolist()]
    out = iter(f([t for part in parts for t in part]))
    return pd.Series([[next(out) for _ in part] for part in parts], dtype=object)


def _in_lists(texts: Column, cfg: Config, type_: str, f: Callable[[Callable, list], list]) -> Column:
    factory = models.TOKEN_COUNTERS[cfg.token_counter]

    @F.pandas_udf(f"array<{type_}>")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = models.loaded(factory)
        for lists in batches:
            yield _by_list(lambda items: f(model, items), lists)

    # so declared, it is kept in a step of its own and not copied into each expression that uses its result
    return mapped.asNondeterministic()(texts)


def all_tokens(texts: Column, cfg: Config) -> Column:
    """``tokens_of`` each text of an array."""
    if cfg.token_counter == "regex":
        return F.transform(texts, token_count)
    return _in_lists(texts, cfg, "int", lambda model, items: model(items))


def all_costs(texts: Column, cfg: Config) -> Column:
    """Tokens that each text of an array takes in a chunk at most, see ``_costs``."""
    if cfg.token_counter == "regex":
        return F.transform(texts, token_count)
    return _in_lists(texts, cfg, "int", _costs)


def all_cut(texts: Column, cfg: Config) -> Column:
    """``cut_text`` of each text of an array by the counter that ``cfg`` names; null for null."""
    most = cfg.max_chunk_tokens
    return _in_lists(texts, cfg, "array<string>", lambda model, items: [None if t is None else cut_text(t, most, model) for t in items])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def running_sums(values: Column, block: int = 512) -> Column:
    """For each whole number of an array the sum of those before it.

    Sums run within blocks, and again over the blocks' sums, so that a long array isn't copied once for each item.
    """
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))

    def sums(items: Column) -> Column:
        return F.aggregate(items, empty, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))

    def in_blocks(v: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(v), F.lit(block)), lambda i: i < F.size(v))
        return F.transform(at, lambda i: sums(F.slice(v, i + 1, F.lit(block))))

    def joined(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: b["sum"]))["before"]
        return F.flatten(F.zip_with(blocks, ends, lambda b, e: F.transform(b["before"], lambda v: v + e)))

    return let(let(values, in_blocks), joined)


def _single_spaced(text: Column) -> Column:
    """Whether single spaces are the only white space, as in nearly all chunks; told without a regular expression."""
    return ~reduce(Column.__or__, [text.contains(c) for c in ["  ", *"\t\n\x0b\f\r"]])


def word_count(text: Column) -> Column:
    """Runs of other than white space. Names ``text`` more than once, so give it a column."""
    parts = F.size(F.split(F.trim(text), " ", -1))
    return F.when(_single_spaced(text), F.when(F.trim(text) == "", 0).otherwise(parts)).otherwise(F.regexp_count(text, F.lit(r"\S+")))


def word_tokens(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(0)))


def collapse_whitespace(text: Column) -> Column:
    """Single spaces for white space, none around the text. Names ``text`` more than once, so give it a column."""
    return F.trim(F.when(_single_spaced(text), text).otherwise(F.regexp_replace(text, r"\s+", " ")))


def alpha_ratio(text: Column) -> Column:
    """Letters among all characters; 0 for empty text."""
    return share_of(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), text)


def share_of(letters: Column, text: Column) -> Column:
    return F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def heading_name(line: Column) -> Column:
    """Standard section of a heading, or the heading itself without its colon, in capitals."""
    name = F.upper(F.trim(F.regexp_replace(F.trim(line), r":\s*$", "")))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), name)


def is_alias(line: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.trim(line), r":\s*$", ""))).isin(*ALIASES)


def is_caps(line: Column, cfg: Config) -> Column:
    caps = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return caps if cfg.allow_terminal_punct else caps & ~F.trim(line).rlike(r"[.!?;]$")


def is_heading(line: Column, cfg: Config) -> Column:
    """A short line with a letter, not numbered, that is in capitals, ends in a colon or is a known heading."""
    t = F.trim(line)
    short = F.length(t).between(cfg.heading_min_chars, cfg.heading_max_chars)
    shaped = is_caps(line, cfg) | line.rlike(r":\s*$") | is_alias(line)
    return short & t.rlike(r"\p{L}") & ~t.rlike(r"^[0-9]") & shaped


def sentences(text: Column) -> Column:
    """Sentences with the white space after them; together they are the text."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def fragments(text: Column, tokens: int) -> Column:
    """Pieces of at most ``tokens`` tokens; together they are the text."""
    def cut(parts: Column) -> Column:
        last = F.greatest(F.ceil(F.size(parts) / tokens).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, i * tokens + 1, F.lit(tokens)), ""))

    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(FRAGMENT_TOKEN), F.lit(0)).alias("parts")))  # for one evaluation
    return F.flatten(F.transform(once, lambda x: cut(x["parts"])))


def strip_end(text: Column) -> Column:
    """``text`` without what ``\\s+$`` finds. Names ``text`` more than once, so give it a column or a lambda's variable.

    Where no line break outside of ASCII ends the text, before which ``$`` would match too, that is its trailing white space.
    """
    odd = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(odd, F.regexp_replace(text, r"\s+$", "")).otherwise(F.rtrim(text, F.lit(" \t\n\x0b\f\r")))
