"""Line de-duplication by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that contain it exceeds a
ratio. Pages are counted per host and line, never gathered: a hot host is a large count, not a
large group. What comes back is a short list per host (a line on more than a share ``r`` of the
pages can be one of at most ``lines per page / r``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.store import free_names, materialize, stored_bytes

#: A line on more than this share of its host's pages goes.
RATIO = 0.05
#: Boilerplate stands on so many pages at least, whatever the host's size: in a host of few pages a share alone says little.
MIN_COPIES = 3
#: The table of boilerplate lines is broadcast up to this many stored bytes, and joined by host beyond.
BROADCAST_BYTES = 8 << 20
#: Beyond a broadcast, the rows of a host are dealt over so many parts.
SALTS = 32


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_copies: int = MIN_COPIES) -> DataFrame:
    """host, key (SHA-256 of the line), n_pages, share for every line on ``min_copies`` pages of the host or more whose share of its pages exceeds ``ratio``.

    A null host is a host of its own. Blank lines are never boilerplate. A page that repeats a
    line counts once. Lines are counted by SHA-256, so whole lines are not shuffled.
    """
    host, text = _host(host_col).alias("host"), F.col(text_col).cast("string")
    pages = docs.groupBy(host).agg(F.count("*").alias("total"))
    one = docs.filter(text.isNotNull()).select(host, F.explode(F.array_distinct(lines(text))).alias("line"))
    keyed = one.filter(~is_blank(F.col("line"))).select("host", F.unhex(F.sha2("line", 256)).alias("key"))
    counts = keyed.groupBy("host", "key").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_copies)
    share = F.col("n_pages") / F.col("total")
    return counts.join(pages, "host").filter(share > ratio).select("host", "key", "n_pages", share.alias("share"))


def _first_byte(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int")


def _marked(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_copies: int, broadcast_bytes: int) -> tuple[DataFrame, Column, Column, list[str]]:
    """``docs`` with its host's keys, the number of lines, the kept lines (null where nothing is to do), and the names of columns added."""
    host_name, keys_name, kept_name, salt_name, part_name = free_names(docs.columns, "host_of_keys", "boilerplate_keys", "kept_lines", "salt", "part")
    found = boilerplate(docs, host_col, text_col, ratio, min_copies).groupBy("host").agg(F.collect_list("key").alias("keys"))
    found = materialize(found, "boilerplate")
    # 256 lists by first byte, so a line is compared with few keys.
    lists = F.transform(F.array("keys"), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.filter(all_, lambda k: _first_byte(k) == b)))[0]
    small = stored_bytes(found) <= broadcast_bytes
    found = found.select(F.col("host").alias(host_name), lists.alias(keys_name))
    if small:
        joined = docs.join(F.broadcast(found), _host(host_col) == F.col(host_name), "left")
    else:
        side = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(part_name))
        salted = docs.withColumn(salt_name, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = salted.join(side, (_host(host_col) == F.col(host_name)) & (F.col(salt_name) == F.col(part_name)), "left").drop(salt_name, part_name)
    text = F.col(text_col).cast("string")
    known = lambda key: F.array_contains(F.element_at(F.col(keys_name), _first_byte(key) + 1), key)
    hashed = F.transform(lines(text), lambda x: F.struct(x.alias("line"), F.when(~is_blank(x), F.unhex(F.sha2(x, 256))).alias("key")))
    kept = F.transform(F.filter(hashed, lambda s: s["key"].isNull() | ~known(s["key"])), lambda s: s["line"])
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines(text))).cast("long")
    has = F.col(keys_name).isNotNull() & text.isNotNull()
    return joined.withColumn(kept_name, F.when(has, kept)), n_lines, F.col(kept_name), [host_name, keys_name, kept_name]


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_copies: int = MIN_COPIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The input with its boilerplate lines taken out of ``text_col``, and n_lines, n_removed added.

    All other columns, and rows, stay as they are; a null text stays null with no lines. A text of
    boilerplate only becomes empty. Columns of the input named n_lines or n_removed are replaced;
    :func:`without_boilerplate` adds none.
    """
    marked, n_lines, kept, added = _marked(docs, host_col, text_col, ratio, min_copies, broadcast_bytes)
    out = marked.withColumns({"n_lines": n_lines, "n_removed": F.when(kept.isNull(), 0).otherwise(n_lines - F.size(kept)).cast("long")})
    return out.withColumn(text_col, F.coalesce(F.array_join(kept, "\n"), F.col(text_col).cast("string"))).drop(*added)


def without_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_copies: int = MIN_COPIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """:func:`line_dedup` with the columns of the input alone."""
    marked, _, kept, _ = _marked(docs, host_col, text_col, ratio, min_copies, broadcast_bytes)
    return marked.withColumn(text_col, F.coalesce(F.array_join(kept, "\n"), F.col(text_col).cast("string"))).select(*docs.columns)
