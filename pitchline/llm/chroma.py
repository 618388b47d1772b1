"""Chroma audio fingerprints and their alignment.

A recording is cut into overlapping frames, each frame's spectrum is folded
into twelve pitch classes, and sixteen area filters, evaluated on the integral
image of those frames, are quantised to two bits each: one 32-bit integer for
each step.  Recordings are aligned by a histogram of the offsets at which they
share two consecutive integers (a shingle), and judged by the bit errors along
the run that matches best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.session import bounded_batches, cut, discard, setting

RATE, FRAME, HOP, WIDTH = 8000, 256, 64, 8
LOW_HZ, HIGH_HZ = 100.0, 3600.0
#: Integers of a row of queries and of a row of recordings that meet in one step.
BLOCK_INTS, CHUNK_INTS = 1 << 18, 1 << 18
_HITS = 1 << 20
#: Up to so many queries a shingle proposes pairs one by one, beyond it whole blocks of queries.
COMMON = 64
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class Filter:
    """Log ratio of two areas of ``width`` frames and pitch classes [low, low + height)."""

    kind: str
    low: int
    height: int
    width: int
    bounds: tuple[float, float, float]


#: Pitch halves, time halves, checkerboards and bands over four pitch ranges.
FILTERS = tuple(Filter(kind, low, 6 if kind != "bands" else 12 - low, width, (-0.35, 0.0, 0.35)) for kind, width in (("pitch", 4), ("time", 8), ("check", 8), ("bands", 6)) for low in (0, 2, 4, 6))
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def decode(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate from an 8- or 16-bit PCM WAV; empty if it is none."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.empty(0), RATE
    at, rate, bits, channels = 12, RATE, 8, 1
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if tag == b"fmt " and len(body) >= 16:
            channels, rate, bits = int.from_bytes(body[2:4], "little") or 1, int.from_bytes(body[4:8], "little") or RATE, int.from_bytes(body[14:16], "little")
        elif tag == b"data":
            if bits == 16:
                x = np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768.0
            else:
                x = (np.frombuffer(body, np.uint8) - 128.0) / 128.0
            return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate
        at += 8 + size + size % 2
    return np.empty(0), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame scaled to length 1."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.empty((0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    fold = np.zeros((use.sum(), 12))
    fold[np.arange(use.sum()), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP][:n]
    out, window = np.empty((n, 12)), np.hanning(FRAME).astype(np.float32)
    for i in range(0, n, 4096):  # bounded scratch for long recordings
        z = np.fft.rfft(frames[i : i + 4096] * window, axis=1)[:, use]
        out[i : i + 4096] = (z.real**2 + z.imag**2) @ fold.astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each step of WIDTH frames."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    s = np.zeros((len(image) + 1, 13))
    s[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(a: int, b: int, lo: int, hi: int) -> np.ndarray:
        return s[t + b, hi] - s[t + a, hi] - s[t + b, lo] + s[t + a, lo]

    out = np.zeros(n, np.uint32)
    for f in FILTERS:
        w, lo, hi = f.width, f.low, f.low + f.height
        mid, half, third = (lo + hi) // 2, w // 2, max(1, f.height // 3)
        if f.kind == "pitch":
            a, b = area(0, w, lo, mid), area(0, w, mid, hi)
        elif f.kind == "time":
            a, b = area(0, half, lo, hi), area(half, w, lo, hi)
        elif f.kind == "check":
            a, b = area(0, half, lo, mid) + area(half, w, mid, hi), area(0, half, mid, hi) + area(half, w, lo, mid)
        else:
            b = area(0, w, lo + third, lo + 2 * third)
            a = (area(0, w, lo, hi) - b) / 2
        value = np.log((1e-6 + a) / (1e-6 + b))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(f.bounds, value)]
    return out


def prints(audio: Column) -> Column:
    """struct<n_frames, print>: little-endian 32-bit integers, none for a null, broken or too short recording."""

    @F.pandas_udf("n_frames long, print binary")
    def made(recordings: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in recordings:
            images = [chroma(*decode(a)) for a in batch]
            yield pd.DataFrame({"n_frames": [len(i) for i in images], "print": [fingerprint(i).astype("<u4").tobytes() for i in images]})

    return made(audio)


def shingles(ints: np.ndarray) -> np.ndarray:
    """Each two consecutive integers as one key."""
    return (ints[:-1].astype(np.uint64) << np.uint64(32)) | ints[1:]


def offset_votes(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many shingles agree at each offset of d against q, the first offset being ``1 - len(q)``.

    Rare keys are counted hit by hit, in bounded steps; a key with very many
    hits, such as silence, by the correlation of its places, so that time
    stays near linear and memory linear whatever two recordings share.
    """
    (qk, dk), n = (shingles(q), shingles(d)), len(q) + len(d)
    votes = np.zeros(n - 1, np.int64)
    qa = np.argsort(qk, kind="stable")
    lo, hi = (np.searchsorted(qk[qa], dk, side) for side in ("left", "right"))
    hits = hi - lo
    keys, inverse, times = np.unique(dk, return_inverse=True, return_counts=True)
    each = np.zeros(len(keys), np.int64)
    each[inverse] = hits
    for k in keys[each * times > 64 * n]:
        a, b = np.fft.rfft((qk == k)[::-1], 2 * n), np.fft.rfft(dk == k, 2 * n)
        same = np.rint(np.fft.irfft(a * b, 2 * n)).astype(np.int64)[: len(qk) + len(dk) - 1]
        votes[1 : 1 + len(same)] += same
        hits[dk == k] = 0
    at = np.nonzero(hits)[0]
    total = np.cumsum(hits[at])
    for part in np.split(at, np.unique(np.searchsorted(total, np.arange(_HITS, total[-1] if len(total) else 0, _HITS)))):
        m = hits[part]
        place = np.repeat(lo[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
        votes += np.bincount(np.repeat(part, m) - qa[place] + len(q) - 1, minlength=n - 1)
    return votes


def best_run(q: np.ndarray, d: np.ndarray, min_votes: int, max_errors: float) -> tuple | None:
    """(offset, votes, start in d, length, bit error rate) of the run that matches best.

    An offset counts if it has ``min_votes`` shingles in common, or all of the
    shorter print where that has fewer.  Along an offset each integer scores
    the bits allowed less the bits wrong; the run is the stretch with the
    largest sum, so less than ``max_errors`` of its bits are wrong.  The run
    with the largest sum over all offsets wins, then the offset nearest to 0.
    None if no offset counts; a print of one integer has no shingle.
    """
    if min(len(q), len(d)) < 2:
        return None
    votes = offset_votes(q, d)
    offset = np.nonzero(votes >= min(min_votes, len(q) - 1, len(d) - 1))[0] - (len(q) - 1)
    overlap = np.minimum(len(q), len(d) - offset) - np.maximum(0, -offset)
    best, out = 0.0, None
    for i in np.lexsort((np.abs(offset), -overlap)):
        if overlap[i] * 32 * max_errors <= best:  # no longer run can be left
            break
        o = int(offset[i])
        a, b = q[max(0, -o) :], d[max(0, o) :]
        wrong = np.bitwise_count(a[: overlap[i]] ^ b[: overlap[i]]).astype(np.int64)
        total = np.concatenate([[0.0], np.cumsum(32 * max_errors - wrong)])
        gain = total - np.minimum.accumulate(total)
        end = int(gain.argmax())
        start = int(total[: end + 1].argmin())
        if gain[end] > best + 1e-9:
            best, out = gain[end], (o, int(votes[o + len(q) - 1]), start + max(0, o), end - start, float(wrong[start:end].sum() / (32 * (end - start))))
    return out


def _packed(limit: int, group: str | None = None):
    """Rows (c, print) gathered into rows of about ``limit`` integers, those of one ``group`` at a time."""

    def row(g, ids, data):
        out = {"ids": [ids], "lens": [[len(x) // 4 for x in data]], "ints": [b"".join(data)]}
        return pd.DataFrame(out if group is None else {group: [g], **out})

    def run(batches):
        held: dict = {}
        for b in batches:
            for g, k, p in zip(b[group] if group else [0] * len(b), b["c"], b["print"]):
                ids, data, size = held.pop(g, ([], [], 0))
                ids.append(k)
                data.append(p)
                size += len(p) // 4
                if size >= limit:
                    yield row(g, ids, data)
                else:
                    held[g] = (ids, data, size)
        for g, (ids, data, _) in held.items():
            yield row(g, ids, data)

    return run


def align(query: tuple, chunk: tuple, min_votes: int, max_errors: float) -> list[tuple]:
    """(query, recording, offset, votes, start, length, bit error rate) of each aligned pair.

    ``query`` and ``chunk`` are (ids, lens, ints).  Pairs that share a shingle
    are found in bounded steps, and each is judged by itself.
    """
    sides = []
    for ids, lens, ints in (query, chunk):
        x, lens = np.frombuffer(ints, "<u4"), np.asarray(lens, np.int64)
        parts = np.split(x, np.cumsum(lens)[:-1])
        keys = [np.unique(shingles(p)) for p in parts]
        sides.append((ids, parts, np.concatenate(keys), np.repeat(np.arange(len(parts)), [len(k) for k in keys])))
    (qi, qx, qk, qo), (di, dx, dk, do) = sides
    order = np.argsort(qk, kind="stable")
    qk, qo = qk[order], qo[order]
    lo, hits = np.searchsorted(qk, dk, "left"), np.searchsorted(qk, dk, "right")
    hits = hits - lo
    total, out, at = np.concatenate([[0], np.cumsum(hits)]), [], 0
    while at < len(do):
        # whole recordings, so that a pair is found once
        end = np.searchsorted(total, total[at] + _HITS, "right") - 1
        end = len(do) if end == len(do) else max(np.searchsorted(do, do[end], "left"), np.searchsorted(do, do[at], "right"))
        m = hits[at:end]
        place = np.repeat(lo[at:end] - np.cumsum(m) + m, m) + np.arange(m.sum())
        found = np.unique(np.repeat(do[at:end], m) * len(qx) + qo[place])
        for d, q in zip(found // len(qx), found % len(qx)):
            if qi[q] != di[d] and (run := best_run(qx[q], dx[d], min_votes, max_errors)):
                out.append((int(qi[q]), int(di[d]), *run))
        at = end
    return out


def search(classes: DataFrame, queries: DataFrame, min_votes: int = 3, max_errors: float = 0.2) -> DataFrame:
    """``(query, c, offset, votes, start, length, bit_error_rate)``: all alignments of
    ``queries`` with ``classes``, both ``(c, print)`` with distinct numbers c.

    Queries are gathered into blocks of bounded size.  A shuffle on shingles
    finds the pairs that share enough of them to have the votes at one offset;
    a recording is sent to the blocks of its pairs' queries.  A shingle of very
    many queries sends it to all their blocks instead: a row for each recording
    and block, never for each pair.
    """
    spark = classes.sparkSession
    packed = "ids array<long>, lens array<int>, ints binary"

    @F.pandas_udf("keys array<long>, times array<int>")
    def keys(data: pd.Series) -> pd.DataFrame:
        found = [np.unique(shingles(np.frombuffer(p, "<u4")), return_counts=True) for p in data]
        return pd.DataFrame({"keys": [k.view(np.int64) for k, _ in found], "times": [n.astype(np.int32) for _, n in found]})

    def postings(prints: DataFrame, c: str, n: str, size: str) -> DataFrame:
        rows = prints.select("c", (F.length("print") / 4).cast("int").alias(size), keys("print").alias("_k"))
        return rows.select(F.col("c").alias(c), size, F.explode(F.arrays_zip("_k.keys", "_k.times")).alias("_e")).select(c, size, F.col("_e.keys").alias("key"), F.col("_e.times").alias(n))

    with setting(spark, _BATCH, "1024"):
        deal = max(1, -(-(queries.agg(F.sum(F.length("print"))).first()[0] or 0) // (4 * BLOCK_INTS)))
        blocks = cut(queries.repartition(deal, "c").mapInPandas(_packed(BLOCK_INTS), packed).withColumn("block", F.monotonically_increasing_id()))
        where = blocks.select("block", F.explode("ids").alias("query"))
        asked = cut(postings(queries, "query", "nq", "lq"))
        per = asked.groupBy("key").agg(F.count("*").alias("df"))
        # shuffled at every size: sent whole, the queries' keys would fit a task in small runs only
        shared = cut(postings(classes, "c", "nd", "ld").join(per.hint("merge"), "key"))
        rare = shared.where(F.col("df") <= COMMON).join(asked, "key").where("c <> query")
        rare = rare.groupBy("c", "query", "ld", "lq").agg(F.sum(F.col("nd") * F.col("nq")).alias("hits")).where(F.col("hits") >= F.least(F.lit(min_votes), F.col("ld") - 1, F.col("lq") - 1))
        often = asked.join(per.where(F.col("df") > COMMON), "key").join(where, "query").select("key", "block").distinct()
        often = shared.where(F.col("df") > COMMON).join(often, "key").select("c", "block")
        meets = cut(rare.join(where, "query").select("c", "block").unionByName(often).distinct())
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        near = meets.join(classes, "c").repartition(tasks, "block", F.pmod("c", F.lit(64)))
        chunks = cut(near.select("block", "c", "print").mapInPandas(_packed(CHUNK_INTS, "block"), f"block long, {packed}"))
    right = blocks.select("block", F.col("ids").alias("qids"), F.col("lens").alias("qlens"), F.col("ints").alias("qints"))

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                rows = align((r.qids, r.qlens, r.qints), (r.ids, r.lens, r.ints), min_votes, max_errors)
                yield pd.DataFrame(rows, columns=["query", "c", "offset", "votes", "start", "length", "bit_error_rate"])

    with setting(spark, _BATCH, "4"):
        both = chunks.join(right, "block").repartition(tasks, "block", F.col("ids")[0])
        out = cut(both.select("ids", "lens", "ints", "qids", "qlens", "qints").mapInPandas(run, "query long, c long, offset long, votes long, start long, length long, bit_error_rate double"))
    for x in (blocks, asked, shared, meets, chunks):
        discard(x)
    return out


def find_recordings(recordings: DataFrame, id_col: str, audio_col: str, is_query: Column, min_votes: int = 3, max_errors: float = 0.2) -> DataFrame:
    """One row for each recording: its class, and what the query recordings say of it.

    Recordings with equal prints form a class named by its smallest id, those
    too short for a print (704 bytes of 8-bit sound) one with equal bytes; a
    null recording is alone, and one of a single integer (below 768 bytes)
    aligns with its equals only.  Classes are aligned once and membership carries
    the result to every copy.  Returns ``doc_id, n_frames, n_ints, print_hash,
    class_id, n_queries`` (query recordings aligned with it, itself excluded)
    and the best alignment of another class: ``best_query, offset, votes,
    start, length, bit_error_rate``, null without one.
    ``is_query`` is a condition on ``doc_id``; an empty table gives no rows.
    """
    bounded_batches(recordings.sparkSession)
    audio = F.col(audio_col).cast("binary")
    made = recordings.select(F.col(id_col).cast("long").alias("doc_id"), audio.alias("_a"), prints(audio).alias("_p"))
    made = made.select("doc_id", "_a", "_p.n_frames", "_p.print", (F.length("_p.print") / 4).cast("long").alias("n_ints"))
    print_hash = F.when(F.col("n_ints") > 0, F.sha2("print", 256))
    own = F.coalesce(print_hash, F.concat(F.lit("bytes "), F.sha2("_a", 256)))
    made = cut(made.select("doc_id", "n_frames", "n_ints", print_hash.alias("print_hash"), own.alias("_own"), F.when(F.col("n_ints") > 0, F.col("print")).alias("print")))
    classes = made.where("_own is not null").groupBy("_own").agg(F.min("doc_id").alias("class_id"), F.first("print", True).alias("print"), F.sum(F.coalesce(is_query, F.lit(False)).cast("long")).alias("asks"))
    classes = cut(classes.withColumn("c", F.xxhash64("_own")))
    found = search(classes.where("print is not null").select("c", "print"), classes.where("asks > 0 and print is not null").select("c", "print"), min_votes, max_errors)
    asks = classes.where("asks > 0").select(F.col("c").alias("query"), F.col("class_id").alias("best_query"), "asks")
    best = F.min_by(F.struct("best_query", "offset", "votes", "start", "length", "bit_error_rate"), F.struct(-F.col("length") * (F.lit(max_errors) - F.col("bit_error_rate")), "best_query"))
    links = found.join(asks, "query").groupBy("c").agg(F.sum("asks").alias("from_others"), best.alias("b"))
    named = classes.select("_own", "class_id", "asks", "c").join(links, "c", "left")
    rows = made.drop("print").join(named, "_own", "left")
    own = F.coalesce(F.col("asks"), F.lit(0)) - F.when(F.col("_own").isNotNull() & is_query, 1).otherwise(0)
    return rows.select("doc_id", "n_frames", "n_ints", "print_hash", F.coalesce("class_id", "doc_id").alias("class_id"), (own + F.coalesce("from_others", F.lit(0))).alias("n_queries"), "b.*")
