"""Column expressions about text. All but NFKC stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it; Java's own class leaves some out.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"([\p{L}\p{N}_]+)"
NOT_WORD = r"[^\p{L}\p{N}_]"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """Apostrophes and quotes made plain, runs of white space made one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(c, "’‘ʼ«»“”", "'''\"\"\"\""), WS + "+", " "))


def normalize_text(c: Column) -> Column:
    return squeeze(nfkc(c))


def near_dup_key(c: Column) -> Column:
    """Letters and numbers in lower case; null, which matches nothing, if there are none."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def non_letter_fraction(c: Column) -> Column:
    """Share of non-letters among characters that are not white space; 1 if there are none."""
    solid = F.length(F.regexp_replace(c, WS, ""))
    other = F.length(F.regexp_replace(c, r"[\p{L}\s\x1c-\x1f\x85\p{Z}]", ""))
    return F.when(solid == 0, F.lit(1.0)).otherwise(other / F.nullif(solid, F.lit(0)))


def length_ratio_ok(a: Column, b: Column, most: float = 3.0) -> Column:
    """Lengths in characters within a factor of ``most``, bounds included; never with an empty side."""
    la, lb = F.length(a), F.length(b)
    return (la > 0) & (lb > 0) & (la / F.nullif(lb, F.lit(0))).between(1.0 / most, most)


def space_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.btrim(F.regexp_replace(c, WS + "+", " ")), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(space_words(c)).cast("long")


def label_by(n: Column, bounds: list[int], labels: list[str], upper_inclusive: bool = True) -> Column:
    """The label of the first bound that ``n`` does not exceed; of none, the last label."""
    out = None
    for bound, label in zip(bounds, labels, strict=False):
        test = n <= bound if upper_inclusive else n < bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(labels[-1]) if len(labels) > len(bounds) else out


WORD_BUCKETS = ["1-3", "4-10", ">10"]
LENGTH_BUCKETS = ["<=10", "11-20", "21-40", "41-80", ">80"]
TOKEN_BINS = ["<=10", "11-20", "21-40", "41-80", "81-160", "161-256", ">256"]


def word_bucket(n: Column) -> Column:
    return label_by(n, [3, 10], WORD_BUCKETS)


def length_bucket(n: Column) -> Column:
    return label_by(n, [10, 20, 40, 80], LENGTH_BUCKETS)


def token_bin(n: Column) -> Column:
    return label_by(n, [10, 20, 40, 80, 160, 256], TOKEN_BINS)


def char_bucket(n: Column) -> Column:
    """Half-open buckets from 400 to 900 characters; null outside."""
    return F.when((n >= 400) & (n < 600), "400-600").when((n >= 600) & (n < 800), "600-800").when((n >= 800) & (n < 900), "800-900")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def long_words(c: Column, least: int = 4) -> Column:
    return F.filter(words(c), lambda w: F.length(w) >= least)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens in order."""
    none = F.array().cast("array<array<string>>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n))).otherwise(none))


def length_ratio(hyp: Column, ref: Column) -> Column:
    """Words of the hypothesis to words of the reference; with an empty reference 1 or 10."""
    h, r = F.size(words(hyp)), F.size(words(ref))
    return F.when(r > 0, h / F.nullif(r, F.lit(0))).when(h == 0, 1.0).otherwise(10.0)


def repetition_rate(hyp: Column, n: int = 3) -> Column:
    """Share of word n-grams that repeat an earlier one. N-grams are joined to strings, which Spark can hash; arrays it compares one by one."""
    none = F.array().cast("array<string>")
    joined = let(words(hyp), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none))
    return let(joined, lambda g: F.when(F.size(g) > 0, (F.size(g) - F.size(F.array_distinct(g))) / F.nullif(F.size(g), F.lit(0))).otherwise(0.0))


def is_truncated(hyp: Column, ref: Column) -> Column:
    return (F.size(words(ref)) > 0) & (F.size(words(hyp)) < 0.5 * F.size(words(ref)))


def proper_nouns(source: Column) -> Column:
    """Capitalised words, the first one aside."""
    w = space_words(source)
    return F.filter(F.when(F.size(w) > 1, F.slice(w, F.lit(2), F.size(w) - 1)).otherwise(F.array().cast("array<string>")), lambda x: x.rlike(r"^[A-ZÀ-Ý][\p{L}\p{N}_'-]*$"))


def proper_noun_copy_accuracy(source: Column, hyp: Column) -> Column:
    """Share of proper nouns that stand in the hypothesis, in either case; null without any."""
    both = F.struct(proper_nouns(source).alias("nouns"), F.lower(hyp).alias("text"))
    return let(both, lambda b: F.size(F.filter(b["nouns"], lambda n: F.contains(b["text"], F.lower(n)))) / F.nullif(F.size(b["nouns"]), F.lit(0)))


def punct_density(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r'[.,;:!?"…]')) / F.nullif(F.length(c), F.lit(0))).otherwise(0.0)


def strip_quotes(c: Column) -> Column:
    """Plain text without quotes or blanks at its end."""
    return F.rtrim(squeeze(c), F.lit(" \"'"))


def word_core(surface: Column) -> Column:
    """A piece without word marks and non-word edges, in lower case."""
    bare = F.translate(surface, "▁", "")
    return F.lower(F.regexp_replace(bare, f"^{NOT_WORD}+|{NOT_WORD}+$", ""))


def is_function_word(core: Column, listed: list[str]) -> Column:
    """All parts between apostrophes are listed, and there is one."""
    parts = F.filter(F.split(core, "'"), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(listed))


def ratio_of_words(src: Column, ref: Column) -> Column:
    a, b = F.size(words(src)), F.size(words(ref))
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(99.0)


def word_copies(hyp: Column, source: Column, ref: Column, least: int = 4) -> Column:
    """Words of the hypothesis, repeats included, that the source has and the reference lacks."""
    low = lambda c: F.transform(words(c), F.lower)
    both = F.struct(low(source).alias("src"), low(ref).alias("ref"), words(hyp).alias("hyp"))
    return let(both, lambda b: F.filter(b["hyp"], lambda w: (F.length(w) >= least) & F.array_contains(b["src"], F.lower(w)) & ~F.array_contains(b["ref"], F.lower(w))))


def split_sentences(c: Column) -> Column:
    """Parts after an end mark and white space, the mark kept; the whole text if there are under two."""
    parts = F.filter(F.split(c, rf"(?<=[.!?;:…]){WS}+"), lambda p: F.btrim(F.regexp_replace(p, WS, " ")) != "")
    return F.when(F.size(parts) < 2, F.array(c)).otherwise(parts)


def failure_type(truncated: Column, repetition: Column, copied: Column) -> Column:
    return F.when(truncated, "truncated").when(repetition > 0.2, "repetition").when(copied > 0, "untranslated_copy").otherwise("low_chrf_other")


def side_label(a: Column, b: Column) -> Column:
    return F.when(a & b, "both").when(a, "src").when(b, "tgt")


def unsafe_path(c: Column) -> Column:
    """Why a relative path must not be used, or null."""
    return (
        F.when(c.contains("\\"), "backslash").when(F.contains(c, F.lit("\0")), "nul").when(c.contains(":"), "colon").when(c.startswith("/"), "absolute").when(c.rlike(r"(^|/)\.{0,2}(/|$)"), "dot part")
    )


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
