"""Column functions over log text."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from vigilog.rules import events


# Every character that separates words, in a form that Java and RE2 read alike.
BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text, F.lit(f"[^{BLANK}]+"))


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy in bits per character; 0 for an empty text or none."""
    return pd.Series(entropies(text.fillna("").tolist()))


def entropies(texts: list[str], most: int = 1 << 20) -> np.ndarray:
    """Entropy of each text: the characters of many texts at once are sorted with the
    text's number before the character, and the lengths of equal runs are the counts."""
    out = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = 0
    while begin < len(texts):
        ends = np.cumsum(sizes[begin:])
        end = begin + max(1, int(np.searchsorted(ends, most, side="right")))
        own = sizes[begin:end]
        points = np.frombuffer("".join(texts[begin:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points):
            keys = np.sort((np.repeat(np.arange(len(own)), own) << 21) | points)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            owner = keys[starts] >> 21
            share = np.diff(np.append(starts, len(keys))) / own[owner]
            out[begin:end] = np.abs(np.bincount(owner, share * np.log2(share), len(own)))
        begin = end
    return out


def mentions(text: Column, flag: str) -> Column:
    """Does the text hold one of the words or the pattern of a flag, whatever the case?

    Words are found by substring search; a word that contains another one is not
    searched for. Only the two patterns need a regular expression.
    """
    lowered = F.lower(text)
    words = events.TEXT_FLAGS[flag]
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    found = [lowered.contains(w) for w in needed]
    if flag in events.TEXT_PATTERNS:
        found.append(lowered.rlike(events.TEXT_PATTERNS[flag]))
    return reduce(lambda a, b: a | b, found)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def time_text(text: Column) -> Column:
    """The first time stamp in a line; the patterns are tried in order."""
    return F.coalesce(*[first_match(text, pattern) for pattern in events.TIME_PATTERNS])


def ipv4(text: Column) -> Column:
    return F.regexp_substr(text, F.lit(events.IPV4_PATTERN))


def severity_word(text: Column) -> Column:
    return F.upper(first_match(text, "(?i)" + events.SEVERITY_PATTERN))


def user_token(text: Column) -> Column:
    return first_match(text, "(?i)" + events.USER_PATTERN)


def action_word(text: Column) -> Column:
    """The first action word that the line contains, capitalised."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(w), F.lit(w.capitalize())) for w in events.ACTION_WORDS])


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, f"[{BLANK}]+", " ")), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "\\", -1)
