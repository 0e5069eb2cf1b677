"""Text expressions. Everything here is a Column expression, so it stays in the JVM."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenspark import fixed_values as fixed


@cache
def folding_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """How each non-ASCII character folds to ``a-z`` or a blank under NFKD.

    Returns the two strings of a ``translate`` for characters that fold to one
    symbol, and pairs for the few that fold to several letters. Characters in
    neither have no ASCII part and simply vanish.
    """
    source, target, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        ascii_part = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if not ascii_part:
            continue
        folded = re.sub("[^a-z]+", " ", ascii_part)
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            several.append((char, folded))
    return "".join(source), "".join(target), tuple(several)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _spelled_out(text: Column) -> Column:
    """Replace the characters that fold to several letters, in texts that hold one."""
    _, _, several = folding_tables()
    without = F.translate(text, "".join(c for c, _ in several), "")
    # One JSON constant: Spark folds it, and 144 struct literals are slow to build.
    spelled = json.dumps([{"c": c, "r": r} for c, r in several])
    pairs = F.from_json(F.lit(spelled), "array<struct<c:string,r:string>>")
    replaced = F.aggregate(pairs, text, lambda done, p: F.replace(done, p["c"], p["r"]))
    return F.when(F.char_length(without) == F.char_length(text), text).otherwise(replaced)


def _fold_non_ascii(lowered: Column) -> Column:
    source, target, _ = folding_tables()

    def drop_rest(text: Column) -> Column:
        rest = F.regexp_replace(_spelled_out(text), "[^\\x00-\\x7F]+", "")
        return F.when(_is_ascii(text), text).otherwise(rest)

    return let(F.translate(lowered, source, target), drop_rest)


def normalize_text(text: Column) -> Column:
    """Lower case, fold accents, keep only ``a-z`` words separated by one blank."""
    lowered = F.lower(text)
    folded = F.when(_is_ascii(lowered), lowered).otherwise(_fold_non_ascii(lowered))
    return F.trim(F.regexp_replace(folded, "[^a-z]+", " "))


def _normalized_word(word: str) -> str:
    folded = unicodedata.normalize("NFKD", word.lower().strip())
    return " ".join(re.sub("[^a-z]+", " ", folded.encode("ascii", "ignore").decode()).split())


@cache
def stop_words(source: str = "built-in") -> tuple[str, ...]:
    """Normalised Portuguese stop words: the built-in list, or the one Spark ML ships."""
    if source == "built-in":
        words = fixed.STOP_WORDS_PT
    elif source == "spark-ml":
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords("portuguese")
    else:
        raise ValueError(f"unknown stop-word source: {source}")
    return tuple(sorted({_normalized_word(w) for w in words} - {""}))


def is_word(token: Column, stop: Sequence[str] | None = None) -> Column:
    return (token != "") & ~token.isin(*(stop_words() if stop is None else stop))


def tokens(text: Column, stop: Sequence[str] | None = None) -> Column:
    """Normalised words in text order, stop words left out, repeats kept."""
    words = F.split(normalize_text(F.coalesce(text, F.lit(""))), " ")
    return F.filter(words, lambda t: is_word(t, stop))


def token_set(text: Column, stop: Sequence[str] | None = None) -> Column:
    drop = F.split(F.lit(" " + " ".join(stop_words() if stop is None else stop)), " ")
    words = F.split(normalize_text(F.coalesce(text, F.lit(""))), " ")
    return F.array_except(words, drop)


def plain_words(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores, for the bag of words."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit("[\\p{L}\\p{N}_]{2,}"), 0)


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """Blank-joined word runs of every length from ``low`` to ``high``."""
    if low == high == 1:
        return words

    def runs(all_words: Column, n: int) -> Column:
        starts = F.when(
            F.size(all_words) >= n, F.sequence(F.lit(0), F.size(all_words) - n)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(all_words, i + k) for k in range(n)]))

    return let(words, lambda w: F.flatten(F.array(*[runs(w, n) for n in range(low, high + 1)])))


def term_counts(words: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's words, by sorting and run lengths.

    Counting inside the row needs no shuffle: a document never leaves its task.
    """
    none = F.array().cast("array<struct<term:string,tf:int>>")

    def runs(a: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(a) - 1),
            lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda p, j: F.struct(
                    F.get(a, p).alias("term"),
                    (F.coalesce(F.get(s, j + 1), F.size(a)) - p).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(words), lambda a: F.when(F.size(a) == 0, none).otherwise(runs(a)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two token sets; 0 when either is empty."""

    def share(both: Column) -> Column:
        a, b = both["a"], both["b"]
        shared = F.size(F.array_intersect(a, b))
        empty = (F.size(a) == 0) | (F.size(b) == 0)
        return F.when(empty, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))

    return let(F.struct(left.alias("a"), right.alias("b")), share)


def skill_overlap(required: Column, offered: Column) -> Column:
    return jaccard(token_set(required), token_set(offered))


def join_texts(parts: Sequence[Column], sep: str = " ") -> Column:
    """Join text columns, a missing one counting as the empty text."""
    if not parts:
        return F.lit("")
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def truncated(text: Column, limit: int) -> Column:
    """First ``limit`` characters and an ellipsis, only where the text is longer."""
    whole = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(whole, 1, limit), F.lit("..."))
    return F.when(F.char_length(whole) > limit, cut).otherwise(whole)


# Every Unicode blank and the ASCII separators.
_BLANK = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A{_BLANK}|{_BLANK}\\z", "")


def json_block(text: Column) -> Column:
    """The widest ``{...}`` part of a reply; the stripped reply if it has none."""
    reply = stripped(text)
    block = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    return F.when(block != "", block).otherwise(reply)
