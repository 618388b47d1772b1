"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared exactly.  They are dealt into cells by population
counts, and cells into tiles of bounded size; a pair of tiles whose population
counts differ beyond the radius is skipped, any other is compared with numpy
exclusive-or and bit counts.  A pair of tiles yields a spanning forest of its
links, never all its pairs.

``near_duplicates`` links 64-bit fingerprints within 2 bits: cells are the
counts of the four 16-bit fields, each of which differs by no more than the
radius.  ``deduplicate`` wants all texts of a given Jaccard similarity: it
compares 256-bit fingerprints of shingle sets at a radius that such pairs keep
within, only between sets of matching sizes, and confirms links by the sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.llm.common import unused
from pitchline.operators.graph import connected_components
from pitchline.session import bounded_batches, cut, discard, setting

FIELDS, FIELD_BITS = 4, 16
SEED = 42
TILE = 16384
#: Shingles of a tile of sets that are compared exactly.
TILE_SHINGLES = 1 << 17
WIDE_WORDS, WIDE_RADIUS = 4, 72
_CHUNK = 1 << 16
_CELLS = 1 << 19
_COLUMNS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def simhash(data: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer.

    A bit is set if it is set in over half of the shingles' XXH64 values,
    repeats included; a text with fewer words than ``shingle`` is one shingle,
    a text with none has fingerprint 0.
    """
    w = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    parts: Iterator[bytes] = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    total, n = np.zeros(64, np.int64), 0
    while len(h := np.fromiter(map(digest, itertools.islice(parts, _CHUNK)), np.uint64)):
        n += len(h)
        total += _majority(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a UTF-8 text's shingles of lower-cased words (A-Z).

    A text with fewer words is one shingle, a text without any the empty one.
    """
    w = data.lower().split()
    each = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), w), np.uint64, len(w))
    width = min(shingle, len(w))
    h = np.full(max(1, len(w) - width + 1), width, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _M1 ^ each[k : k + len(h)]
    h = (h ^ (h >> np.uint64(32))) * _M2
    return np.unique(h ^ (h >> np.uint64(31)))


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """``words`` 64-bit fingerprints of a set, the first from its hashes, each other from a further mix of them."""
    out, h = [], hashes
    for _ in range(words):
        out.append(np.packbits(2 * sum(_majority(h[i : i + _CHUNK]) for i in range(0, len(h), _CHUNK)) > len(h), bitorder="little").view(np.int64)[0])
        h = (h ^ (h >> np.uint64(30))) * _M2
        h = (h ^ (h >> np.uint64(27))) * _M1
    return np.array(out, np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: one row for each row of ``docs``; a null text counts as empty."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([simhash(x, shingle) for x in t], dtype="int64")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("fp"))


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches through the edges u-v."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[u], label[v])
        if (m == label[u]).all() and (m == label[v]).all():
            return label
        np.minimum.at(label, label[u], m)
        np.minimum.at(label, label[v], m)
        label = label[label]


def _links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j), j counted on from ``len(a)``, of a forest that connects what pairs of rows within the radius connect.

    Counts are bytes: all 256 bits of a wide fingerprint apart would count as none, and is confirmed as no link.

    ``a`` and ``b`` have a column for each 64-bit word of a fingerprint.
    """
    us, vs, step = [], [], max(1, _CELLS // max(1, len(b)))
    n, held = len(a) + len(b), 0
    b = np.ascontiguousarray(b.T)
    for i in range(0, len(a), step):
        part = a[i : i + step]
        apart = np.bitwise_count(part[:, 0, None] ^ b[0])
        for w in range(1, len(b)):
            apart += np.bitwise_count(part[:, w, None] ^ b[w])
        x, y = np.nonzero(apart <= radius)
        if len(x):
            us.append(x + i)
            vs.append(y + len(a))
            held += len(x)
        if held > 4 * n:  # many pairs: keep only what they connect
            label = _forest(n, np.concatenate(us), np.concatenate(vs))
            at = np.nonzero(label != np.arange(n))[0]
            us, vs, held = [at], [label[at]], len(at)
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _compare_tiles(tiles: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``(a, b)``: links of ``pairs`` (ta, tb, radius) of ``tiles`` (tile, keys, fps).

    Pairs name tiles by number and are dealt evenly after the tiles have joined
    them, so that a tile with many partners is not one task's.
    """
    left = tiles.select(F.col("tile").alias("ta"), F.col("keys").alias("ka"), F.col("fps").alias("fa"))
    right = tiles.select(F.col("tile").alias("tb"), F.col("keys").alias("kb"), F.col("fps").alias("fb"))
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(left, "ta").join(right, "tb").repartition(tasks, "ta", "tb").select("ka", "fa", "kb", "fb", "radius")

    def run(batches):
        for batch in batches:
            ends = []
            for ka, fa, kb, fb, radius in batch.itertuples(index=False):
                a, b = (np.asarray(f, np.int64).view(np.uint64).reshape(-1, words) for f in (fa, fb))
                u, v = _links(a, b, radius)
                every = np.concatenate([np.asarray(ka, np.int64), np.asarray(kb, np.int64)])
                ends.append(np.stack([every[u], every[v]]))
            a, b = np.concatenate(ends or [np.empty((2, 0), np.int64)], 1)
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    with setting(tiles.sparkSession, _BATCH, "64"):
        return cut(both.mapInPandas(run, "a long, b long"))


def link_components(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``(fp, component_id)`` for each distinct fingerprint of ``(doc_id, fp)``.

    ``component_id`` is the smallest ``doc_id`` reachable through fingerprints
    that differ in ``radius`` bits or fewer; null only if no row of the
    component has an id.
    """
    mask = (1 << FIELD_BITS) - 1
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", FIELD_BITS * i).bitwiseAND(F.lit(mask).cast("long"))) * (32**i) for i in range(1, FIELDS)), F.bit_count(F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("cell", cell.cast("int")))
    # at most 17^4 cells, however large the input: safe to broadcast
    parts = F.broadcast(nodes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts")))
    number = (F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("fp"), "parts")).alias("tile")
    tiles = nodes.join(parts, "cell").groupBy("cell", number).agg(F.collect_list("fp").alias("keys"))
    tiles = cut(tiles.select("cell", "tile", "keys", F.col("keys").alias("fps")))
    half = [o for o in itertools.product(range(-radius, radius + 1), repeat=FIELDS) if sum(map(abs, o)) <= radius and next((x for x in reversed(o) if x), 1) > 0]
    steps = F.array(*(F.lit(sum(x * 32**i for i, x in enumerate(o))) for o in half))
    left = tiles.select(F.col("tile").alias("ta"), F.col("cell").alias("at"))
    right = tiles.select(F.col("tile").alias("tb"), "cell", F.explode(steps).alias("step")).select("tb", "step", (F.col("cell") + F.col("step")).alias("at"))
    pairs = left.join(right, "at").where("step <> 0 or ta <= tb").select("ta", "tb", F.lit(radius).alias("radius"))
    links = _compare_tiles(tiles, pairs, 1)
    roots = connected_components(links)
    placed = nodes.select("fp", "rep").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = cut(placed.join(names, "root").select("fp", "component_id"))
    for x in (nodes, tiles, links, roots):
        discard(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)``, one row for each input row.

    Null and empty texts have fingerprint zero and link like any other; exact
    copies share a fingerprint and meet the comparison once; rows with a null
    id join a component without naming it; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    labels = link_components(fps, radius)
    return fps.join(labels, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text: Column) -> Column:
    """64 bits that stand for a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _alike(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a x b with a Jaccard similarity of ``percent`` or more."""
    size = np.array([len(x) for x in [*a, *b]])
    owner = np.repeat(np.arange(len(size)), size)
    _, column, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]  # only shared shingles count
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(a), len(b)), np.int64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + _COLUMNS])
        has = np.zeros((len(size), min(_COLUMNS, int(column[-1]) + 1 - c)), np.float32)
        has[owner[lo:hi], column[lo:hi] - c] = 1
        shared += (has[: len(a)] @ has[len(a) :].T).astype(np.int64)
    return np.nonzero((100 + percent) * shared >= percent * (size[: len(a), None] + size[None, len(a) :]))


def _candidates(texts: DataFrame, shingle: int, percent: int, radius: int, tile: int) -> DataFrame:
    """``(t, id, n, component)`` of the texts of ``(t, id, data)`` that have another's wide fingerprint within reach:
    n shingles each, and the smallest id with that text."""
    spark = texts.sparkSession

    @F.pandas_udf("array<long>")
    def measure(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in data:
            sets = [shingle_set(x, shingle) for x in batch]
            yield pd.Series([[len(s), *map(int, wide_fingerprint(s))] for s in sets])

    bounded_batches(spark)
    fp = [f"f{i}" for i in range(WIDE_WORDS)]
    nodes = texts.select("t", "id", measure("data").alias("m")).select("t", "id", *(F.get("m", F.lit(i)).alias(c) for i, c in enumerate(["n", *fp])))
    nodes = nodes.groupBy("t").agg(F.min("id").alias("id"), *(F.max(c).alias(c) for c in ["n", *fp]))  # equal for equal texts
    # sets of the wanted similarity differ in size by no more than one band
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100))).cast("int")
    ones = sum((F.bit_count(c) for c in fp[1:]), F.bit_count(fp[0]))
    nodes = cut(nodes.withColumn("band", band).withColumn("ones", F.floor(ones / F.lit(16)).cast("int")))
    # a few hundred cells, however large the input: safe to broadcast
    cells = cut(nodes.groupBy("band", "ones").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"), F.max("n").alias("most")))
    number = ((F.col("band") * 64 + F.col("ones")).cast("long") * (1 << 32) + F.pmod(F.xxhash64("t"), "parts")).alias("tile")
    tiles = nodes.join(F.broadcast(cells), ["band", "ones"]).groupBy("band", "ones", "most", number).agg(F.collect_list(F.struct("t", F.array(*fp).alias("fp"))).alias("x"))
    tiles = cut(tiles.select("band", "ones", "most", "tile", F.col("x.t").alias("keys"), F.flatten("x.fp").alias("fps")))
    left = tiles.select(F.col("tile").alias("ta"), F.explode(F.array("band", F.col("band") + 1)).alias("at"), F.col("band").alias("low"), F.col("ones").alias("oa"), F.col("most").alias("ma"))
    right = tiles.select(F.col("tile").alias("tb"), F.col("band").alias("at"), F.col("ones").alias("ob"), F.col("most").alias("mb"))
    near = (F.abs(F.col("oa") - F.col("ob")) * 16 - 15 <= radius) & ((F.col("low") < F.col("at")) | (F.col("ta") <= F.col("tb")))
    # sets too small to differ in one shingle and still be so similar must be equal
    reach = F.when(F.greatest("ma", "mb") * (100 - percent) < 100, 0).otherwise(radius)
    links = _compare_tiles(tiles, left.join(right, "at").where(near).select("ta", "tb", reach.alias("radius")), WIDE_WORDS)
    roots = connected_components(links)
    out = cut(roots.withColumnRenamed("node", "t").join(nodes.select("t", "id", "n"), "t"))
    for x in (nodes, cells, tiles, links, roots):
        discard(x)
    return out


def link_texts(texts: DataFrame, shingle: int = 5, percent: int = 80, radius: int = WIDE_RADIUS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``(node, component)`` of the linked texts of ``(t, id, data)``, ``t`` a key for each text, whose rows may repeat.

    Texts are linked if their sets of ``shingle`` words have a Jaccard
    similarity of ``percent`` or more.  Candidates are the components of wide
    fingerprints within ``radius``; the members of each are compared exactly,
    tile by tile, so a candidate that is not similar links nothing.  At 0.8, two
    sets differ in 39 of 256 bits on average, 48 at worst for very small sets,
    with a deviation of 6; unrelated ones in 128 with a deviation of 8.  Texts
    without a link have no row.
    """
    spark = texts.sparkSession
    members = _candidates(texts, shingle, percent, radius, tile)
    bounded_batches(spark)

    @F.pandas_udf("array<long>")
    def sets(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in data:
            yield pd.Series([shingle_set(x, shingle).view(np.int64) for x in batch])

    parts = members.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(tile_shingles)).cast("int").alias("parts"))
    dealt = members.join(parts, "component").select("component", "t", F.col("id").alias("first"), "parts", F.pmod(F.xxhash64("t"), "parts").cast("int").alias("tile"))
    one = texts.join(dealt, "t").where(F.col("id").eqNullSafe(F.col("first")))  # copies go before sets are made
    known = one.select("component", "parts", "tile", "t", sets("data").alias("s")).dropDuplicates(["t"])
    tiles = known.groupBy("component", "parts", "tile").agg(F.collect_list(F.struct("t", "s")).alias("m"))
    tiles = cut(tiles.select("component", "parts", "tile", F.col("m.t").alias("t"), F.transform("m", lambda x: F.size(x["s"])).alias("n"), F.flatten("m.s").alias("s")))
    none = F.array().cast("array<long>")
    alone = tiles.where("parts = 1").select("t", "n", "s", none.alias("t_"), F.array().cast("array<int>").alias("n_"), none.alias("s_"))
    large = tiles.where("parts > 1")
    other = large.select("component", *(F.col(c).alias(f"{c}_") for c in ("tile", "t", "n", "s")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = large.join(other, "component").where("tile <= tile_").repartition(tasks, "component", "tile", "tile_").select("t", "n", "s", "t_", "n_", "s_")

    def compare(batches):
        for batch in batches:
            for t, n, s, t2, n2, s2 in batch.itertuples(index=False):
                a, b = (np.split(np.asarray(x, np.int64), np.cumsum(np.asarray(m, np.int64))[:-1]) if len(m) else None for x, m in ((s, n), (s2, n2)))
                keys = np.concatenate([np.asarray(t, np.int64), np.asarray(t if b is None else t2, np.int64)])
                u, v = _alike(a, b or a, percent)
                every, node = np.unique(keys, return_inverse=True)
                label = _forest(len(every), node[: len(a)][u], node[len(a) :][v])
                at = np.nonzero(label != np.arange(len(every)))[0]
                yield pd.DataFrame({"a": every[at], "b": every[label[at]]})

    with setting(spark, _BATCH, "64"):
        links = cut(alone.unionByName(pairs).mapInPandas(compare, "a long, b long"))
    out = connected_components(links)
    for x in (members, tiles, links):
        discard(x)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, **kw) -> DataFrame:
    """One row of ``docs`` for each near-duplicate component, with or without an id.

    Texts are linked if their sets of ``shingle`` words have a Jaccard
    similarity of ``percent`` or more (``link_texts``); null and blank texts are
    alike.  The row with the smallest id stays, rows without one last; rows
    that share it, the one whose text hashes lowest.  Columns are those of ``docs``.
    """
    key, row, nth = unused(docs, "_text", "_row", "_nth")
    rows = docs.withColumn(key, text_key(F.col(text_col))).withColumn(row, F.xxhash64(F.col(id_col), F.col(key)))
    texts = docs.select(text_key(F.col(text_col)).alias("t"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    roots = link_texts(texts, shingle, percent, **kw)
    named = rows.select(F.col(id_col).alias("id"), F.col(key).alias("t"), F.col(row).alias("r")).join(roots.withColumnRenamed("node", "t"), "t", "left")
    first = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "t", "r")).alias("f")
    kept = named.groupBy(F.coalesce("component", "t").alias("root")).agg(first).select("f.*")
    kept = cut(kept.select(*(F.col(c).alias(f"_kept_{c}_{key}") for c in ("id", "t", "r"))))
    discard(roots)
    k_id, k_t, k_r = (F.col(c) for c in kept.columns)
    # rows that share id and text: one stays, the same one in every run
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    tie = Window.partitionBy(row, id_col, key).orderBy(F.xxhash64(*plain))
    rows = rows.withColumn(nth, F.row_number().over(tie)).where(F.col(nth) == 1)
    return rows.join(kept, (F.col(row) == k_r) & (F.col(key) == k_t) & F.col(id_col).eqNullSafe(k_id), "left_semi").drop(key, row, nth)
