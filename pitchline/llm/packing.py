"""Best-fit packing of documents into fixed sequences under conflicts.

Documents are cut into pieces of at most ``capacity`` words.  Within a block
of pieces, open bins are ordered by what is left of them; each bin carries the
bitmap of the sources and of the duplicate clusters it holds.  A piece goes
into the tightest bin that has room and shares neither: the search moves from
one residual to its successor until a bin is compatible, and opens a new bin
when none is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import SPACE, n_words
from pitchline.session import cut

CAPACITY, BLOCK = 1024, 16_384
#: A bin filled to this share or more is not packed anew.
GOOD = 0.95
_ROW = "doc_id long, lost boolean, source string, cluster long, piece long, start long, size long, block long, bin_id long, slot int, filled long"


def place(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, slot) for each of ``items`` = (size, source bit, cluster bit), in the order given.

    Bins with equal residual and source bitmap are kept together, so that a
    search passes a whole group of incompatible bins at once.
    """
    levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
    occupied = 0  # bit r: some open bin has residual r
    clusters: list[int] = []
    count: list[int] = []
    out = []
    run, cursor = None, (0, 0)
    for size, source, cluster in items:
        at = size
        if (size, source, cluster) == run:  # bins passed for an equal item stay incompatible
            at = max(at, cursor[0])
        chosen = None
        while chosen is None:
            rest = occupied >> at
            if not rest:
                break
            at += (rest & -rest).bit_length() - 1
            for bitmap, bins in levels[at].items():
                if bitmap & source:
                    continue
                k = next((k for k in range(len(bins) - 1, -1, -1) if not clusters[bins[k]] & cluster), None) if cluster else len(bins) - 1
                if k is not None:
                    chosen = (at, bitmap, k)
                    break
            else:
                at += 1
        run, cursor = (size, source, cluster), (at, 0)
        if chosen is None:
            b, left, bitmap = len(clusters), capacity, 0
            clusters.append(0)
            count.append(0)
        else:
            left, bitmap, k = chosen
            bins = levels[left][bitmap]
            b = bins[k]
            bins[k] = bins[-1]
            bins.pop()
            if not bins:
                del levels[left][bitmap]
                if not levels[left]:
                    occupied &= ~(1 << left)
        out.append((b, count[b]))
        count[b] += 1
        clusters[b] |= cluster
        levels[left - size].setdefault(bitmap | source, []).append(b)
        occupied |= 1 << (left - size)
    return out


def _pack_block(capacity: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "cluster", "source", "lost", "doc_id", "piece"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        source = {s: 1 << i for i, s in enumerate(pd.unique(rows["source"]))}
        repeated = rows["cluster"].value_counts()
        cluster = {c: 1 << i for i, c in enumerate(repeated.index[repeated > 1].sort_values())}
        placed = place([(int(n), source[s], cluster.get(c, 0)) for n, s, c in zip(rows["size"], rows["source"], rows["cluster"])], capacity)
        bins = np.array([b for b, _ in placed])
        filled = np.bincount(bins, rows["size"])[bins].astype("int64")
        return rows.assign(bin_id=bins + (level << 56) + (int(rows["block"][0]) << 28), slot=[s for _, s in placed], filled=filled)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK, cluster_col: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, n_words, bin_id, slot)``, one row for each piece of each row.

    A row of n words has max(1, ceil(n / capacity)) pieces; words are numbered
    from 0.  No bin exceeds ``capacity``, holds two pieces of a source, or two
    of a cluster: of ``cluster_col`` (null: none) where one is named, of equal
    texts (white space and ASCII case aside) otherwise.  Null
    texts are empty pieces; a null source is a source of its own; repeated
    rows are packed each for itself.  Blocks are dealt by a hash of the row,
    so that a hot source or cluster is spread over all of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.xxhash64(F.regexp_replace(F.lower(text), SPACE, " "))
    if cluster_col is not None:  # rows of no cluster are alone in theirs
        digest = F.when(F.col(cluster_col).isNull(), F.xxhash64(F.col(id_col), text)).otherwise(F.xxhash64(cluster_col))
    own = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("lost"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("source"), digest.alias("cluster"), n_words(text).alias("n"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(capacity))).cast("long")
    rows = rows.select("doc_id", "lost", "source", "cluster", "n", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    rows = rows.withColumn("start", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")))
    rows = cut(rows.select("doc_id", "lost", "source", "cluster", "piece", "start", "size"))
    left, level, done = rows.count(), 0, []
    while True:
        blocks = max(1, -(-left // block))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "cluster", F.lit(level)), F.lit(blocks)))
        packed = cut(dealt.groupBy("block").applyInPandas(_pack_block(capacity, level), _ROW))
        again = packed.where(F.col("filled") < GOOD * capacity)
        before, left = left, again.count() if blocks > 1 else 0
        if not left or 2 * left > before:
            done.append(packed)
            break
        done.append(packed.where(F.col("filled") >= GOOD * capacity))
        rows, level = again.select(*rows.columns), level + 1
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.when(~F.col("lost"), F.col("doc_id")).alias("doc_id"), "piece", "start", F.col("size").alias("n_words"), "bin_id", "slot")
