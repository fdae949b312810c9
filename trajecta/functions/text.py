"""Text and scalar helpers as column functions."""

from __future__ import annotations

import unicodedata
from string import ascii_letters, ascii_lowercase, digits

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that connect sentences.
CONNECTIVES = (
    "but", "however", "then", "meanwhile", "later", "suddenly", "afterwards", "finally", "eventually", "moreover", "instead", "nevertheless", "next",
    "soon", "now", "once", "still", "yet", "though", "although", "because", "so", "thus", "therefore", "anyway", "besides", "afterward",
)
#: Bracket, quote and empty tokens of treebanks and what they stand for.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LCB-": "{", "-RCB-": "}", "-LSB-": "[", "-RSB-": "]", "``": "'", "''": "'", "`": "'", '"': "'", "-NONE-": ""}
#: What each cleaning rule deletes, and whether it lower-cases.
CLEANING = {"letters": ("[^A-Za-z']", False), "alnum": ("[^A-Za-z0-9']", True), "lower": ("[^a-z]", True)}
#: The characters that each cleaning rule keeps.
KEPT = {"letters": ascii_letters + "'", "alnum": ascii_letters + digits + "'", "lower": ascii_lowercase}
#: Quotes and dashes folded to one ASCII form, the pair of straight quotes first.
FOLDED = {"''": "'", "‘": "'", "’": "'", "“": "'", "”": "'", "`": "'", "—": "-", "–": "-"}


def squash_ws(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"\s+", "")


def clean_word(c: Column, rule: str = "letters") -> Column:
    """What the rule deletes is what is left of a word without the characters kept; no pattern is run for each word."""
    c = F.lower(c) if CLEANING[rule][1] else c
    return F.call_function("translate", c, F.translate(c, KEPT[rule], ""), F.lit(""))


def clean_words(c: Column, rule: str = "letters") -> Column:
    """``clean_word`` of all words of a text with single spaces, which stay."""
    pattern, lower = CLEANING[rule]
    return F.regexp_replace(F.lower(c) if lower else c, pattern[:-1] + " ]+", "")


def has_trailing_punct(c: Column) -> Column:
    """1.0 if the last character is neither an ASCII letter nor a digit."""
    last = F.substring(c, -1, 1)
    return (~(last.between("0", "9") | last.between("A", "Z") | last.between("a", "z")) & (last != "")).cast("double")


def in_set(c: Column, words) -> Column:
    return c.isin(list(words)).cast("double")


def map_tokens(c: Column, table: dict[str, str] = BRACKETS) -> Column:
    """Tokens of the table rewritten, others unchanged."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold_chars(c: Column) -> Column:
    """NFKC, quotes folded to ``'`` and dashes to ``-``, no white space."""
    out = _nfkc(c)
    for a, b in FOLDED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return squash_ws(out)


def id_part(c: Column, i: int) -> Column:
    """The i-th (from 1; negative from the end) dotted part of an id."""
    return F.try_element_at(F.split(c, r"\."), F.lit(i))


def label_fractions(c: Column, none: str) -> Column:
    """struct(n, share other than ``none``) of a list written like ``['a', "b's"]``, in either kind of quotes."""
    labels = _labels(c)
    other = F.size(F.filter(labels, lambda x: x != none))
    return F.struct(F.size(labels).alias("n"), F.try_divide(other, F.size(labels)).alias("share"))


def label_share(c: Column, label: str) -> Column:
    """Share of one label in such a list; null for an empty list."""
    labels = _labels(c)
    return F.try_divide(F.size(F.filter(labels, lambda x: x == label)), F.size(labels))


def _labels(c: Column) -> Column:
    quoted = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    return F.transform(quoted, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def coerce01(c: Column) -> Column:
    """Text as a number in 0..1; anything else is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def bounded_log(c: Column, lo: float, hi: float) -> Column:
    """Natural log of values in lo..hi; null outside."""
    return F.when(c.between(lo, hi), F.ln(c))


def neg_log_prob(p: Column, unit: str = "bits", floor: float = 1e-12) -> Column:
    p = F.greatest(p, F.lit(floor))
    return -F.log2(p) if unit == "bits" else -F.ln(p)


def interaction(x: Column, m: Column) -> Column:
    """The product of a predictor and a moderator."""
    return x * m


def dummies(c: Column, levels: list) -> list[Column]:
    """0/1 columns of all levels but the first; many levels are better absorbed as fixed effects."""
    return [(c == x).cast("double").alias(f"is_{x}") for x in levels[1:]]
