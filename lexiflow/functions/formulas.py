"""Number formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f_score(overlap: Column, hyp_total: Column, ref_total: Column, beta: float = 2.0) -> Column:
    p, r = overlap / F.greatest(hyp_total, F.lit(1)), overlap / F.greatest(ref_total, F.lit(1))
    b = beta * beta
    return F.when(p + r == 0, 0.0).otherwise((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def length_penalty(n: Column, alpha: float) -> Column:
    return F.pow((n + 5) / F.lit(6.0), F.lit(alpha))


def decode_limit(n: Column, a: float = 1.5, b: int = 10) -> Column:
    return (F.floor(n * a) + b).cast("long")


def wsd_scale(step: Column, warmup: int, planned: int, cooldown: float) -> Column:
    """Linear warm-up, a flat stretch, and a linear way down to zero over the last ``cooldown`` of the plan."""
    begin = planned - int(round(planned * cooldown))
    return (
        F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).when(step < begin, 1.0).when(step >= planned, 0.0).otherwise((F.lit(planned) - step) / F.lit(float(max(1, planned - begin))))
    )


def p_text(p: Column, n: int) -> Column:
    return F.when(p == 0, F.concat(F.lit("< "), F.format_number(F.lit(1.0 / n), 4))).otherwise(F.format_number(p, 4))


def ranges_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def compared(ratio: Column, overlap: Column, higher_is_better: bool) -> Column:
    better = ratio > 1 if higher_is_better else ratio < 1
    return F.when(overlap, "indistinguishable").when(better, "faster").otherwise("slower")


def span_hours(first: Column, last: Column) -> Column:
    """Hours from one timestamp to another; it must not be the earlier one."""
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return F.when(micros < 0, F.raise_error(F.lit("a span ends before it begins")).cast("double")).otherwise(micros / F.lit(3.6e9))


def hash_number(seed: str, *parts: Column) -> Column:
    """A number from 0 to 2^60 - 1 by MD5 of the seed and the parts, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_seed(seed: int, key: Column, j: int | Column) -> Column:
    """63 bits of SHA-256 of ``seed|j|key``: its first eight bytes, the least significant first, without the top bit."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), (F.lit(j) if isinstance(j, int) else j).cast("string"), key.cast("string")), 256)
    turned = F.concat(*(F.substring(digest, at, 2) for at in range(15, 0, -2)))
    return F.conv(turned, 16, -10).cast("long").bitwiseAND((1 << 63) - 1)


def hash_rank(seed: str, *parts: Column) -> Column:
    """A string to order by: a seeded shuffle that every engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)))
