"""Near-duplicate classes by DartMinHash.

A text is a weighted set: its runs of five words, each as heavy as it is frequent. Darts fall on the
plane over every element, at heights that are a Poisson process of the element's hash, the same
in every text. The plane is cut into regions that double in width, so a heavy element costs the
logarithm of its weight, and a dart counts if it falls inside the weight. Each dart belongs to one of
``k`` coordinates, and the lowest dart of a coordinate is its hash: two texts agree on a coordinate
with a chance of their weighted Jaccard similarity. Only the few darts below a height that the text's
total weight sets are looked at, so a signature costs little more than reading the text. A text with
repeated runs is signed a second time with all weights one, so that texts alike as plain sets meet too.

Texts with the same words are one node, named by a 128-bit digest of these words. Nodes that share a
band of a signature meet in a bucket. No bucket is turned into all its pairs: its hub is compared with
the others, which are then one class or not; only where nodes of different classes are left do those
meet again, and in a large bucket only those that share one of the rare runs that alike texts must share.
Comparisons use hashes of words of another family than the signatures.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.features import Flat
from lexiflow.llm.store import free_names, materialize, slices

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 5: a pair at 0.8 is missed once in ten thousand.
BANDS, ROWS = 24, 5
#: Nodes of a bucket that meet as many others within one task; a bucket with more that its hub does not explain is cut by rare runs.
BLOCK = 1000
#: Nodes whose rows or labels are looked up by a broadcast of their keys (8 to 32 bytes each); a join beyond.
BROADCAST_NODES = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(flat: Flat, width: int = SHINGLE, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 64-bit hash and count of every distinct run of words, in that order. A shorter text is one run."""
    word = _mix(flat.word_hashes(fold=True, family=family)[0])
    n = len(word)
    parts = []
    if n >= width:
        run = word[: n - width + 1].copy()
        for k in range(1, width):
            run = run * _ODD + word[k : n - width + 1 + k]
        inside = flat.doc[: n - width + 1] == flat.doc[width - 1 :]
        parts.append((flat.doc[: n - width + 1][inside], _mix(run[inside])))
    first = np.cumsum(flat.n_words) - flat.n_words
    for d in np.flatnonzero((flat.n_words > 0) & (flat.n_words < width)):
        run = np.zeros(1, np.uint64)
        for w in word[first[d] : first[d] + flat.n_words[d]]:
            run = run * _ODD + w
        parts.append((np.array([d]), _mix(run)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, run = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[new], run[new], np.diff(np.append(new, len(run)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) identities of the lowest dart of each coordinate; rows without elements are zero.

    ``weight`` may be any positive numbers. Regions of an element are [0, 1), [1, 2), [2, 4), [4, 8)
    and so on, up to its weight; darts of a region come at a rate of its width. Where a coordinate
    stays empty, that text's height is doubled and its darts are thrown again.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weight, minlength=n)
    height = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-9)
    regions = 1 + np.maximum(0, np.ceil(np.log2(np.maximum(weight, 1e-300)))).astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), regions)
    region = np.arange(len(owner)) - np.repeat(np.cumsum(regions) - regions, regions)
    left = np.where(region > 0, np.exp2(region - 1.0), 0.0)
    width = np.maximum(left, 1.0)
    seed = _mix(element[owner] ^ _mix(region.astype(np.uint64) * _ODD + np.uint64(1)))
    of, room = doc[owner], weight[owner] - left
    open_docs = total > 0
    while open_docs.any():
        now = np.flatnonzero(open_docs[of])
        at, r, step = of[now], np.zeros(len(now)), 0
        low = np.full(n * k, np.inf)
        thrown = []
        while len(now):
            step += 1
            h = _mix(seed[now] + np.uint64(step * int(_ODD) % (1 << 64)))
            r = r - np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width[now]
            below = r <= height[at]
            now, at, r, h = now[below], at[below], r[below], h[below]
            dart = _mix(h ^ np.uint64(0xD1B54A32D192ED03))
            hit = (_mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width[now] <= room[now]
            slot = at[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64)
            np.minimum.at(low, slot, r[hit])
            thrown.append((slot, r[hit], dart[hit]))
        ids = np.zeros(n * k, np.uint64)
        for slot, r_, dart in thrown:
            best = low[slot] == r_
            ids[slot[best]] = dart[best]
        filled = np.isfinite(low).reshape(n, k).all(axis=1) & open_docs
        out[filled] = ids.reshape(n, k)[filled]
        open_docs &= ~filled
        height *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands): a 64-bit hash of each band and its number."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, (len(signature), 1))
    for j in range(rows):
        key = _mix(key ^ parts[:, :, j]) + _ODD
    return key


def _elements(flat: Flat) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct runs, and further occurrences of runs (as runs of their own) of each text, as sorted hashes."""
    doc, element, count = shingles(flat, family=1)
    edges = np.searchsorted(doc, np.arange(flat.n + 1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        e, extra = element[a:b], count[a:b] - 1
        more = np.zeros(0, np.uint64)
        if extra.any():
            owner = np.repeat(e, extra)
            unit = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra)
            more = np.unique(_mix(owner + (unit.astype(np.uint64) + np.uint64(1)) * _ODD))
        out.append((e, more))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard similarities of two texts as sets and as multisets of runs of words."""
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    single = both / max(1, len(a[0]) + len(b[0]) - both)
    if not len(a[1]) and not len(b[1]):
        return single
    more = both + len(np.intersect1d(a[1], b[1], assume_unique=True))
    return max(single, more / max(1, len(a[0]) + len(b[0]) + len(a[1]) + len(b[1]) - more))


def _flat(batch: pa.RecordBatch) -> Flat:
    return Flat([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])


def _nodes(flat: Flat) -> list[bytes | None]:
    """A digest of the folded words of each text; none for a text without words."""
    return [hashlib.blake2b(t, digest_size=16).digest() if n else None for t, n in zip(flat.folded_texts(), flat.n_words, strict=True)]


def signature_bands(flat: Flat, bands: int, rows: int) -> list[np.ndarray]:
    """Band keys of each text: of its weighted signature and, where a run is repeated, of its plain one. A text without words has none."""
    doc, element, count = shingles(flat)
    k = bands * rows
    weighted = band_keys(dart_signatures(doc, element, count.astype(np.float64), flat.n, k), bands, rows).view(np.int64)
    again = np.zeros(flat.n, bool)
    again[doc[count > 1]] = True
    slot = np.cumsum(again) - 1
    mine = again[doc]
    plain = band_keys(dart_signatures(slot[doc[mine]], element[mine], np.ones(int(mine.sum())), int(again.sum()), k), bands, rows).view(np.int64)
    none = np.zeros(0, np.int64)
    return [none if not n else np.unique(np.concatenate((w, plain[s]))) if a else w for n, w, a, s in zip(flat.n_words, weighted, again, slot, strict=True)]


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19, 500):
            flat = _flat(batch)
            found = signature_bands(flat, bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array(_nodes(flat), pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "rid", "node", "bands"])

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19, 500):
        flat = _flat(batch)
        found = _elements(flat)
        yield pa.RecordBatch.from_arrays([pa.array(_nodes(flat), pa.binary()), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["node", "once", "more"])


def _content(once: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(once, np.uint64), np.frombuffer(more, np.uint64)


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "once"):
            c = {n: batch.column(n).to_pylist() for n in ("once", "more", "hub_once", "hub_more")}
            keep = [similarity(_content(a, b), _content(x, y)) >= threshold for a, b, x, y in zip(*c.values(), strict=True)]
            yield batch.select(["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(threshold: float):
    """Links between the active nodes of a block and the nodes of another block of their bucket, where their classes differ.

    The sizes of all intersections with one node come from an inverted index: one count over the
    nodes that hold its elements.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label, active = (table.column(c).to_pylist() for c in ("node", "label", "active"))
        once, more = ([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()] for c in ("once", "more"))
        others = [k for k, a in enumerate(active) if not a]
        names = {x: k for k, x in enumerate(dict.fromkeys(label))}
        of = np.array([names[label[k]] for k in others], np.int64)

        def index(parts: list[np.ndarray]):
            sizes = np.array([len(parts[k]) for k in others], np.int64)
            flat = np.concatenate([parts[k] for k in others]) if others else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            return flat[order], np.repeat(np.arange(len(others)), sizes)[order], sizes

        def shared(found, mine: np.ndarray) -> np.ndarray:
            values, owner, _ = found
            a, b = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            return np.bincount(owner[at], minlength=len(others))

        first, second = index(once), index(more)
        links = []
        for k, a in enumerate(active):
            if not a or not others:
                continue
            both = shared(first, once[k])
            alike = both / np.maximum(1, first[2] + len(once[k]) - both)
            extra = both + (shared(second, more[k]) if len(more[k]) else 0)
            alike = np.maximum(alike, extra / np.maximum(1, first[2] + second[2] + len(once[k]) + len(more[k]) - extra))
            # One link to each class is enough.
            hit = np.flatnonzero((alike >= threshold) & (of != names[label[k]]))
            links += [(node[k], node[others[h]]) for h in hit[np.unique(of[hit], return_index=True)[1]]]
        return pa.table({"hub": pa.array([x for x, _ in links], pa.binary()), "node": pa.array([y for _, y in links], pa.binary())})

    return run


def components(links: DataFrame, a: str = "hub", b: str = "node") -> DataFrame:
    """node, label: the least node of each node's component, for every node that has a link.

    Each round a node takes the least label around it (itself included), then that label's label,
    so a component of radius ``r`` takes about ``log r`` rounds. Rounds are written to the shared
    folder. Labels are broadcast while there are few, and joined beyond.
    """
    x, y = F.col(a).alias("x"), F.col(b).alias("y")
    back = (F.col(b).alias("x"), F.col(a).alias("y"))
    itself = F.explode(F.array(a, b)).alias("x")
    edges = materialize(links.select(x, y).unionByName(links.select(*back)).unionByName(links.select(itself).withColumn("y", F.col("x"))).distinct(), "edges")
    labels = materialize(edges.groupBy("x").agg(F.min("y").alias("label")).withColumnRenamed("x", "node"), "labels")
    few = labels.count() <= BROADCAST_NODES
    side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    while True:
        seen = edges.join(side(labels.select(F.col("node").alias("y"), F.col("label").alias("near"))), "y")
        around = seen.groupBy("x").agg(F.min("near").alias("mid"), F.max(F.when(F.col("x") == F.col("y"), F.col("near"))).alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = materialize(around.join(side(jump), "mid", "left").select(F.col("x").alias("node"), "old", F.least("mid", "far").alias("label")), "labels")
        moved = not new.filter("old <> label").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _long_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of each node, as plain sets (kind 0) and with repetitions (kind 1), and the size of that set."""
    for batch in slices(batches, "once", 1 << 18, 200):
        once, more = (batch.column(c).to_pylist() for c in ("once", "more"))
        pairs = [_content(a, b) for a, b in zip(once, more, strict=True)]
        sets = [x for a, b in pairs for x in (a, np.concatenate((a, b)))]
        sizes = np.array([len(x) for x in sets], np.int64)
        take = pa.array(np.repeat(np.repeat(np.arange(batch.num_rows), 2), sizes))
        kind = np.repeat(np.tile([0, 1], batch.num_rows), sizes).astype(np.int32)
        runs = np.concatenate(sets).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("bucket", "node", "label", "active")), pa.array(kind), pa.array(runs), pa.array(np.repeat(sizes, sizes))], ["bucket", "node", "label", "active", "kind", "run", "n"])


def _by_rare_runs(large: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """The rows of large buckets in smaller ones: bucket, node, label, active.

    Two sets alike by ``threshold`` t share one of the n - ceil(t n) + 1 runs of each that come
    first in any one order. The order is by frequency in the bucket, so texts meet by what is rare in it.
    """
    rows = large.join(contents, "node").select("bucket", "node", "label", "active", "once", "more")
    runs = materialize(rows.mapInArrow(_long_prefixes, "bucket long, node binary, label binary, active boolean, kind int, run long, n long"), "runs")
    often = runs.groupBy("bucket", "kind", "run").agg(F.count("*").alias("often")).filter("often > 1")
    # A run of one node alone brings nobody together, but takes its place in the order.
    place = F.row_number().over(Window.partitionBy("bucket", "kind", "node").orderBy(F.coalesce("often", F.lit(1)), "run"))
    ranked = runs.join(often, ["bucket", "kind", "run"], "left").withColumn("place", place)
    first = ranked.filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("often").isNotNull())
    return first.select(F.xxhash64("bucket", "kind", "run").alias("bucket"), "node", "label", "active")


def near_links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Verified links that join every two nodes that share a bucket and are alike into one component: hub, node.

    ``docs`` has rid and text; ``nodes`` has node, bands and the rid of one of its rows. First the
    hub of every bucket, its node with the most company in all its buckets, is compared with the
    others. What is then not of the hub's class is active, and meets the bucket's nodes of other
    classes, in parts of at most ``block`` against ``block`` nodes. With up to ``block`` active nodes
    that costs rows in proportion to the bucket. With more, only nodes meet that share one of their
    rare runs, which all alike pairs do, so none is lost.
    """
    spark = docs.sparkSession
    pairs = nodes.select(F.explode("bands").alias("bucket"), "node")
    sizes = pairs.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(pairs.join(sizes, "bucket"), "buckets")
    company = materialize(shared.groupBy("node").agg(F.sum("size").alias("company")), "company")
    few_nodes = company.count()
    if not few_nodes:
        return spark.createDataFrame([], "hub binary, node binary")
    few = few_nodes <= BROADCAST_NODES
    wanted = nodes.select("node", "rid").join(company.select("node"), "node").select("rid")
    picked = docs.join(F.broadcast(wanted) if few else wanted, "rid", "left_semi").select("text")
    contents = picked.mapInArrow(_contents, "node binary, once binary, more binary").filter("node IS NOT NULL")
    contents = materialize(contents.groupBy("node").agg(F.first("once").alias("once"), F.first("more").alias("more")), "contents")
    hubs = shared.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    buckets = materialize(shared.join(hubs, "bucket"), "hubs")
    spokes = buckets.filter("hub <> node").select("hub", "node").distinct()
    hub = contents.select(F.col("node").alias("hub"), F.col("once").alias("hub_once"), F.col("more").alias("hub_more"))
    links = materialize(spokes.join(hub, "hub").join(contents, "node").mapInArrow(_compare(threshold), "hub binary, node binary"), "links")
    labels = components(links)
    named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_hub = named.filter("hub = node").select("bucket", F.col("label").alias("hub_label"))
    # The hub has met all others, so a bucket of two is done.
    rest = named.filter("size > 2").join(of_hub, "bucket").withColumn("active", F.col("label") != F.col("hub_label"))
    digest = [F.sum(F.xxhash64(*c).cast("decimal(38,0)")).alias(f"set{j}") for j, c in enumerate((("node", "active"), ("active", "node")))]
    left = rest.groupBy("bucket").agg(F.count_if("active").alias("n_active"), F.count("*").alias("size"), *digest).filter("n_active > 0")
    # Buckets with the same nodes (by two sums of 64-bit hashes) are searched once.
    once = left.groupBy("set0", "set1", "size", "n_active").agg(F.min("bucket").alias("bucket"))
    rest = materialize(rest.join(once.select("bucket", "n_active"), "bucket").select("bucket", "node", "label", "active", "n_active"), "rest")
    if rest.isEmpty():
        return links
    large = rest.filter(F.col("n_active") > block)
    rest = rest.filter(F.col("n_active") <= block).drop("n_active")
    if not large.isEmpty():
        rest = materialize(rest.unionByName(_by_rare_runs(large, contents, threshold)), "rare")
    counts = rest.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("active").alias("n_active"), F.count_distinct("label").alias("n_labels"))
    rest = materialize(rest.join(counts.filter("n_active > 0 AND n_labels > 1"), "bucket"), "meetings")
    part = lambda n: F.ceil(F.col(n) / F.lit(float(block))).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), part(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), part(n) - 1))
    rows = rest.filter("active").select("bucket", place("n_active").alias("i"), every("size").alias("j"), "node", "label", "active")
    rows = rows.unionByName(rest.select("bucket", every("n_active").alias("i"), place("size").alias("j"), "node", "label", F.lit(False).alias("active")))
    more = rows.join(contents, "node").groupBy("bucket", "i", "j").applyInArrow(_meet(threshold), "hub binary, node binary")
    return links.unionByName(materialize(more, "links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, block: int) -> DataFrame:
    """A row per input row: id, rid, class_id, class_size, kept."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("rid"), text.alias("text"))
    signed = materialize(source.mapInArrow(_sign(bands, rows), "id long, rid long, node binary, bands array<long>"), "signatures")
    signed = signed.withColumn("row", F.monotonically_increasing_id())  # fixed: the rows of stored files
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.min("rid").alias("rid"))
    labels = components(near_links(source.select("rid", "text"), nodes, threshold, block))
    flat = signed.select("id", "rid", "row", F.coalesce("node", F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary")).alias("node"))
    classed = materialize(flat.join(labels, "node", "left").select("id", "rid", "row", F.coalesce("label", "node").alias("label")), "classes")
    # Stored, so that both sides of the join are plain exchanges and Spark can split a large class's.
    top = materialize(classed.groupBy("label").agg(F.min(F.struct("id", "row")).alias("top"), F.count("*").alias("class_size")), "tops")
    return classed.join(top, "label").select("id", "rid", F.col("top.id").alias("class_id"), "class_size", (F.col("row") == F.col("top.row")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id_col``, rid, class_id, class_size, kept.

    Two texts are linked when they share a band and their similarity is ``threshold`` or more; a
    class is a connected component, named by its least id, and of its rows one with that id stays.
    Words are compared without punctuation and with A-Z in lower case; a word of punctuation alone
    is compared as it is. A text without words (null, empty) is a class of its own, each of them. A
    null id sorts below all others. rid is a hash of id and text. Repeated rows are in one class; an
    empty table gives no rows; other columns are not looked at.
    """
    return _classes(docs, id_col, text_col, threshold, bands, rows, block).withColumnRenamed("id", id_col)


def near_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which :func:`near_dedup` keeps one for each class."""
    classed = _classes(docs, id_col, text_col, threshold, bands, rows, block)
    id_name, rid_name = free_names(docs.columns, "kept_id", "kept_rid")
    kept = materialize(classed.groupBy(F.col("id").alias(id_name), F.col("rid").alias(rid_name)).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("kept").select(id_name, rid_name, "n"), "kept")
    repeats = not kept.filter("n > 1").isEmpty()
    kept = kept.select(id_name, rid_name)
    key = F.col(id_col).cast("long")
    if not repeats:
        return docs.join(kept, key.eqNullSafe(F.col(id_name)) & (F.xxhash64(key, F.col(text_col).cast("string")) == F.col(rid_name)), "left_semi")
    (mark,) = free_names([*docs.columns, id_name, rid_name], "row_hash")
    marked = docs.withColumn(mark, F.xxhash64(key, F.col(text_col).cast("string")))
    return marked.join(kept, key.eqNullSafe(F.col(id_name)) & (F.col(mark) == F.col(rid_name)), "left_semi").dropDuplicates([id_col, mark]).drop(mark)
