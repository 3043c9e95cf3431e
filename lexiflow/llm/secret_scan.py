"""Secret scan with DataFrame functions only.

Three patterns give the base spans. On top of them, candidate strings are judged by the Shannon
entropy of a window that slides over their characters: per character class (hex digits, or letters
and digits mixed) there is a threshold in bits. The counts of the window's characters are carried
along, packed by twelve into 64-bit numbers; a step changes the count of the character that enters
and of the one that leaves, so it costs the same whatever the window's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:passw|secret|token|api_?key)"""
#: A run is taken whole, so asking for the length in the pattern is the same as dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits of a packed count, counts in a 64-bit number; matches of a chunk.
BITS, PER_LONG, CHUNK = 5, 12, 128
HEX_BITS, MIXED_BITS = 3.0, 3.6
MIN_ASSIGN = 12

#: Marks of strings that only look like secrets.
ALLOW = r"(?i)example|sample|placeholder|dummy|changeme|redacted|xxxx|0123456789|1234567890|abcdefgh"
ALLOW_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

_SPANS = "array<struct<start:int,end:int,text:string,value:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match in order with its place in code points: what stands between matches is counted up.

    Matches are gone through in chunks, so that appending to the result does not copy all of it each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    chunks = F.transform(F.array(rows), lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r), F.lit(1)), F.lit(CHUNK)), lambda k: F.slice(r, k, CHUNK)))[0]

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["g"])
        end = begin + F.length(row["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), row["m"].alias("text"), row["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), _none().alias("out"))
        return F.aggregate(part, begin, step, lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPANS}>)").alias("out"))
    return F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["out"]))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of ``window`` consecutive characters of a string over ``ALPHABET`` (of all, if shorter).

    A character outside of the alphabet counts as one more character of it, the same for all of them.
    """
    if not 2 <= window < 1 << BITS:
        raise ValueError(f"a window has 2 to {(1 << BITS) - 1} characters")
    weight = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    rows = F.arrays_zip(codes.alias("put"), F.slice(leaving, 1, F.size(codes)).alias("out"))
    packs = range(len(ALPHABET) // PER_LONG + 1)

    def count(acc: Column, code: Column) -> Column:
        """The count of a character in the packed numbers."""
        which = F.when(code < PER_LONG, acc["c0"])
        for k in list(packs)[1:]:
            which = which.when(code < (k + 1) * PER_LONG, acc[f"c{k}"])
        return F.call_function("shiftright", which, code % PER_LONG * BITS).bitwiseAND((1 << BITS) - 1).cast("int")

    def unit(code: Column, k: int) -> Column:
        """What one character more adds to the packed number ``k``."""
        return F.when((code >= k * PER_LONG) & (code < (k + 1) * PER_LONG), F.call_function("shiftleft", F.lit(1).cast("long"), code % PER_LONG * BITS)).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, row: Column) -> Column:
        put, out = row["put"], row["out"]
        more, less = count(acc, put), count(acc, out)
        change = (
            F.when(put == out, 0.0)
            .when(out < 0, F.get(weight, more + 1) - F.get(weight, more))
            .otherwise(F.get(weight, more + 1) - F.get(weight, more) + F.get(weight, less - 1) - F.get(weight, less))
        )
        total = acc["sum"] + change
        size = F.least(acc["i"] + 1, F.lit(window)).cast("double")
        full = acc["i"] + 1 >= acc["need"]
        bits = F.when(full, F.log2(size) - total / size).otherwise(0.0)
        packed = [(acc[f"c{k}"] + unit(put, k) - F.when(out < 0, F.lit(0).cast("long")).otherwise(unit(out, k))).alias(f"c{k}") for k in packs]
        return F.struct(*packed, (acc["i"] + 1).alias("i"), acc["need"].alias("need"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    n = F.length(text)
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in packs], F.lit(0).alias("i"), F.least(F.lit(window), n).alias("need"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.when(n > 0, F.aggregate(rows, zero, step, lambda acc: acc["best"])).otherwise(F.lit(0.0))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS) -> DataFrame:
    """One row per input row: ``id_col``, found (array of kind, start, end, text, bits), base (those of the three patterns).

    Starts and ends are code points, the end exclusive; spans are in order of start, then kind as
    in ``KINDS``. An entropy span is a whole candidate whose best window reaches its class's
    threshold, unless a base span covers it or the allow-list names it. A candidate of letters or
    of digits alone has no class. A null or empty text has no spans; an empty table gives no rows;
    repeated rows stay; other columns are not looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    text = F.col("t")
    equals = text.contains(":") | text.contains("=")
    raw = source.select(
        "id",
        F.when(equals & text.rlike(ASSIGN_HINT), _spans(text, ASSIGN, 1)).otherwise(_none()).alias("a"),
        F.when(text.contains("AKIA"), _spans(text, ACCESS)).otherwise(_none()).alias("k"),
        F.when(text.rlike(HEX), _spans(text, HEX)).otherwise(_none()).alias("h"),
        F.when(text.rlike(r"[0-9]") & text.rlike(CANDIDATE), _spans(text, CANDIDATE)).otherwise(_none()).alias("c"),
    )

    def kind(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), s["end"].alias("end"), s["text"].alias("text"), F.lit(None).cast("double").alias("bits")))

    base = F.array_sort(F.concat(kind(F.filter("a", lambda s: F.length(s["value"]) >= MIN_ASSIGN), 0), kind(F.col("k"), 1), kind(F.col("h"), 2)))
    assigned = F.transform(F.filter("a", lambda s: F.length(s["value"]) >= MIN_ASSIGN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    based = raw.select("id", base.alias("base"), assigned.alias("assigned"), "c")

    def is_hex(s: Column) -> Column:
        return s["text"].rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")

    def candidate(s: Column) -> Column:
        shape = s["text"].rlike(r"[0-9]") & s["text"].rlike(r"[A-Za-z]")
        allowed = s["text"].rlike(ALLOW) | s["text"].rlike(ALLOW_UUID)
        # A candidate is a whole run, so hex and access spans cover it exactly if its own text says so.
        plain = s["text"].rlike(r"^(?:[0-9a-f]+|AKIA[A-Z0-9]{14,})$")
        return shape & ~allowed & ~plain & ~F.exists("assigned", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))

    def scored(s: Column) -> Column:
        rank = F.when(is_hex(s), 3).otherwise(4)
        return F.struct(s["start"].alias("start"), rank.alias("rank"), F.when(rank == 3, KINDS[3]).otherwise(KINDS[4]).alias("kind"), s["end"].alias("end"), s["text"].alias("text"), window_entropy(s["text"], window).alias("bits"))

    extra = F.filter(F.transform(F.filter("c", candidate), scored), lambda s: s["bits"] >= F.when(s["rank"] == 3, hex_bits).otherwise(mixed_bits))
    out = based.select("id", "base", extra.alias("extra"))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["bits"].alias("bits")))
    return out.select(F.col("id").alias(id_col), slim(F.array_sort(F.concat("base", "extra"))).alias("found"), slim(F.col("base")).alias("base"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of :func:`secret_scan`: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = secret_scan(docs, id_col, text_col)
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_entropy")
    )
