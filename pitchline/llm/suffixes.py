"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Suffixes are sorted to that depth, bucket by bucket; no task holds more than a
bucket or a block of documents.

1. *Cover samples.*  Positions whose residue lies in a difference cover modulo
   V are sampled with the ``length - V + 1`` bytes behind them.  Two equal
   strings of ``length`` bytes have a sampled position in common, so suffixes
   whose samples are all unique are out.  Hashes find most unique samples.
2. *Sample ranks.*  The samples left are sorted by their bytes, bucket by
   bucket; a rank stands for the sample's string.  Where all occurrences of a
   rank have the same V - 1 bytes on both sides (the inside of a repeat), every
   suffix with that sample in reach is a long tie: the first occurrence of the
   rank decides all V of them at once.
3. *Suffix buckets.*  The other suffixes are sorted.  Those that start l bytes
   before a sample are compared by these l bytes, then by the sample's rank,
   then by what is left of their length; all but the first of equal ones are
   repeats.  A rank with very many different surroundings sends its suffixes
   one by one instead, so that they spread over all buckets.
4. *Covering.*  Each block marks the bytes that repeats cover.

Blocks send an entry for each distinct string and surroundings once, so that a
string in every document costs one entry a block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.session import cut, discard, setting, shuffle_files_end_with_query

V = 73
#: A perfect difference set: every residue modulo V is a difference of two members.
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)
BLOCK_BYTES, BLOCK_ROWS, PARTITION_BYTES = 2 << 20, 1 << 16, 32 << 20
#: Entries a bucket is planned for: hashed samples, samples, suffixes.
BUCKETS = (1 << 20, 1 << 19, 1 << 16)
#: Surroundings of one rank from which on its suffixes are sent one by one.
HOT = 1 << 17
#: Spark's own limit is 100,000 buckets a table.
MAX_PARTITIONS = 1 << 16

_BLOCK = "k long, h long, seq int, ids array<long>, hs array<long>, lens array<long>, data binary"
_SENT = "k long, h long, seq int, bucket long, entries binary"
_BACK = "k long, h long, seq int, bucket long, answers binary, most int"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0x165667B19E3779F9)
_NULL = -(1 << 63)
_KEY = 5  # bytes of a sample's hash beside the bits that choose its bucket
_PLACE = [("doc", "<i8"), ("h", "<i8"), ("pos", "<i4")]
_RANKED = np.dtype([("rank", "<u4"), ("code", "u1")])
#: What a sample's rank says of it: alone or first, a long tie with an earlier one, one of several surroundings, one of very many.
FIRST, LATER, SORTED, SINGLY = range(4)


def _mix(words: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of 64-bit words."""
    a, b = (np.uint64(m[seed]) for m in _MULTIPLIERS)
    h = np.full(len(words), words.shape[1], np.uint64)
    for column in words.T:
        h ^= column
        h *= a
        h ^= h >> np.uint64(32)
    h *= b
    return h ^ (h >> np.uint64(29))


def _words(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as 64-bit words that order and differ as the bytes do."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    return padded.view(">u8").astype(np.uint64)


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by ``columns``, first column first, ties as they come, and the run number of each row."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for c in columns:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(fresh)
    return order, run


def _first_of(run: np.ndarray) -> np.ndarray:
    """Index of the first row of each run."""
    return np.unique(run, return_index=True)[1]


class _Block:
    """The concatenated bytes of a block's documents."""

    def __init__(self, row, length: int, mix: Callable[..., np.ndarray] = _mix):
        self.mix, self.k, self.h, self.seq = mix, row.k, row.h, row.seq
        self.length, self.need = length, length - V + 1
        self.ids, self.hs, self.lens = (np.asarray(x, np.int64) for x in (row.ids, row.hs, row.lens))
        self.size = len(row.data)
        self.starts = np.cumsum(self.lens) - self.lens
        self.ends = self.starts + self.lens
        self.bytes = np.frombuffer(b"\0" * (V - 1) + row.data + b"\0" * (length + 8), np.uint8)

    def strings(self, at: np.ndarray, before: int, width: int) -> np.ndarray:
        """The ``width`` bytes from ``before`` bytes ahead of each place, as rows."""
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, width)
        return view[at + (V - 1 - before)]

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions whose string fits a document that is long enough, and the strings' hashes."""
        long = self.lens >= self.length
        offset = np.sort(np.concatenate([np.arange(c, self.lens[long].max(initial=0), V) for c in COVER]))
        at = [s + offset[:m] for s, m in zip(self.starts[long], np.searchsorted(offset, self.lens[long] - self.need, "right"))]
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        base = np.ascontiguousarray(self.bytes[V - 1 :])
        words = np.ndarray(len(base) - 7, "<u8", base, 0, (1,))
        tails = [*range(0, self.need - 7, 8), *([self.need - 8] if self.need % 8 else [])]
        return at, self.mix(np.stack([words[at + o] for o in tails], 1) if len(at) else np.empty((0, len(tails)), np.uint64))

    def surroundings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``length + V - 1`` bytes around samples, zero outside their documents, and the document's bytes
        on either side (V - 1 at most)."""
        doc = self.documents(at)
        room = np.minimum(np.stack([at - self.starts[doc], self.ends[doc] - at - self.need], 1), V - 1)
        around = self.strings(at, V - 1, self.length + V - 1)
        clipped = np.nonzero((room < V - 1).any(1))[0]
        column = np.arange(self.length + V - 1)
        left, right = room[clipped, :1], room[clipped, 1:]
        around[clipped] *= (column >= V - 1 - left) & (column < V - 1 + self.need + right)
        return around, room.astype(np.uint8)

    def places(self, at: np.ndarray, entries: np.ndarray) -> np.ndarray:
        doc = self.documents(at)
        entries["doc"], entries["h"], entries["pos"] = self.ids[doc], self.hs[doc], at
        return entries

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Whether each position starts a whole string that has one of the samples ``at`` in reach."""
        doc = self.documents(at)
        change = np.zeros(self.size + self.length + 1, np.int32)
        lo, hi = np.maximum(at - V + 1, self.starts[doc]), np.minimum(at, self.ends[doc] - self.length) + 1
        np.add.at(change, lo, 1)
        np.add.at(change, np.maximum(hi, lo), -1)
        return np.cumsum(change[: self.size]) > 0

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Bytes under the strings that start where ``starts`` is set."""
        change = np.zeros(self.size + self.length + 1, np.int32)
        change[: self.size] += starts
        change[self.length :][: self.size] -= starts
        return np.cumsum(change[: self.size]) > 0


def _send(block: _Block, bucket: np.ndarray, entries: np.ndarray) -> pd.DataFrame:
    """Rows for the buckets in use; ``bucket`` ascends."""
    edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
    return pd.DataFrame({"k": block.k, "h": block.h, "seq": block.seq, "bucket": bucket[edges[:-1]].astype(np.int64), "entries": [entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]})


def _answers(block: _Block, back, bucket: np.ndarray, dtype) -> np.ndarray:
    """What came back for the entries that ``_send`` sent for ``bucket``; zero where nothing did."""
    out = np.zeros(len(bucket), dtype)
    own = [b for b in back if b["seq"] == block.seq] if back is not None else []
    if own:
        lo = np.searchsorted(bucket, [b["bucket"] for b in own])
        for a, b in zip(lo, own):
            got = np.frombuffer(b["answers"], dtype)
            out[a : a + len(got)] = got
    return out


def _judge(dtype, verdict: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """A bucket's rows joined, judged and answered; answers of zeros only are not sent.  ``most`` is the largest code in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        entries = [np.frombuffer(b, dtype) for b in rows["entries"]]
        sizes = [len(e) for e in entries]
        answers = verdict(np.concatenate(entries), np.repeat(rows["seq"].to_numpy(), sizes))
        most = int(answers["code"].max()) if answers.dtype == _RANKED else 0
        answers = [a.tobytes() for a in np.split(answers, np.cumsum(sizes)[:-1])]
        out = rows[["k", "h", "seq", "bucket"]].assign(answers=answers, most=most)
        return out[[any(a) for a in answers]]

    return run


def _often(entries: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Hashed samples that stand in more than one block."""
    wide = np.zeros((len(entries), 8), np.uint8)
    wide[:, :_KEY] = entries["key"]
    _, inverse, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    return (count[inverse] > 1).astype(np.uint8)


def _by_place(entries: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return np.lexsort((entries["pos"], seq, entries["h"], entries["doc"]))


def _ranked(hot: int):
    def verdict(entries: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Dense ranks of one bucket's samples by their bytes, and what each says."""
        at = _by_place(entries, seq)
        e = entries[at]
        _, rank = _runs(list(_words(e["string"]).T))
        first = _first_of(rank)
        many = np.bincount(rank, e["contexts"])
        other = (e["context"] != e["context"][first][rank]).any(1) | (e["contexts"] > 1)
        differ = np.bincount(rank, other) > 0
        out = np.zeros(len(e), _RANKED)
        out["rank"] = rank
        code = np.full(len(e), LATER)
        code[first] = FIRST
        out["code"] = np.where(differ[rank], np.where(many[rank] > hot, SINGLY, SORTED), code)
        back = np.empty_like(out)
        back[at] = out
        return back

    return verdict


def _prefix_runs(first: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``first`` and bytes, and the bytes each row shares with the one before it, -1 if ``first`` differs."""
    order, _ = _runs([first, *_words(strings).T])
    same = np.logical_and.accumulate(strings[order[1:]] == strings[order[:-1]], axis=1).sum(1)
    return order, np.concatenate([[-1], np.where(first[order[1:]] == first[order[:-1]], same, -1)])


def _sorted_suffixes(entries: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """For each sample of a bucket and each l: whether the suffix l bytes before it repeats an earlier one.

    Suffixes with l bytes before samples of equal rank are tied once those l
    bytes are; what is left of the depth is the V - 1 - l bytes behind the sample.
    """
    at = _by_place(entries, seq)
    e = entries[at]
    n = len(e)
    before, common_before = _prefix_runs(e["rank"], np.ascontiguousarray(e["left"][:, ::-1]))
    behind, common_behind = _prefix_runs(e["rank"], e["right"])
    late = np.zeros((n, V), bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(V):  # noqa: E741
        left[before] = np.cumsum(common_before < l)
        right[behind] = np.cumsum(common_behind < V - 1 - l)
        whole = np.nonzero((e["room"][:, 0] >= l) & (e["room"][:, 1] >= V - 1 - l))[0]
        first = np.unique(left[whole] * (n + 1) + right[whole], return_index=True)[1]
        late[whole, l] = True
        late[whole[first], l] = False
    bits = np.packbits(late, axis=1)
    back = np.empty(n, [("bits", "u1", bits.shape[1])])
    back["bits"][at] = bits
    return back


def _sorted_singly(entries: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Whole suffixes of a bucket: all but the first of equal ones."""
    at = _by_place(entries, seq)
    _, run = _runs(list(_words(entries["string"][at]).T))
    late = np.ones(len(at), np.uint8)
    late[at[_first_of(run)]] = 0
    return late


class _Samples:
    """A block's repeated samples by string and surroundings."""

    def __init__(self, block: _Block, at: np.ndarray, bits: int):
        self.block, self.at = block, at
        self.around, self.room = block.surroundings(at)
        self.bits = bits
        string = self.around[:, V - 1 :][:, : block.need]
        words = _words(string)
        self.string = string
        bucket = _bucket(block.mix(words), bits)
        _, self.run = _runs([bucket, *words.T])  # by bucket, then by bytes
        self.first = _first_of(self.run)
        self.bucket = bucket[self.first]
        padded = _words(np.concatenate([self.around, self.room], 1))
        self.context = np.stack([block.mix(padded, 0), block.mix(padded, 1)], 1)
        _, self.kind = _runs([self.run, self.context[:, 0], self.context[:, 1]])
        self.kind_first = _first_of(self.kind)  # first occurrence of each surroundings

    def entries(self) -> np.ndarray:
        out = np.zeros(len(self.first), [("string", "u1", self.block.need), ("context", "<u8", 2), ("contexts", "<u4"), *_PLACE])
        out["string"], out["context"] = self.string[self.first], self.context[self.first]
        out["contexts"] = np.bincount(self.run[self.kind_first], minlength=len(self.first))
        return self.block.places(self.at[self.first], out)

    def judged(self, back) -> None:
        """Take the ranks that came back: ``code`` and ``rank`` for each sample, and ``late``, those that a tie decides."""
        got = _answers(self.block, back, self.bucket, _RANKED)[self.run]
        again = np.ones(len(self.at), bool)
        again[self.kind_first] = False
        self.code, self.late = got["code"], again | (got["code"] == LATER)
        self.rank = (self.bucket[self.run].astype(np.uint64) << np.uint64(32)) | got["rank"]

    def suffix_entries(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which samples, bucket, entry) of those whose suffixes are sorted."""
        which = np.nonzero((self.code == SORTED) & ~self.late)[0]
        bucket = _bucket(self.block.mix(self.rank[which, None]), bits)
        order = np.argsort(bucket, kind="stable")
        which, bucket = which[order], bucket[order]
        out = np.zeros(len(which), _suffix_dtype())
        out["rank"], out["left"], out["right"], out["room"] = self.rank[which], self.around[which, : V - 1], self.around[which, -(V - 1) :], self.room[which]
        return which, bucket, self.block.places(self.at[which], out)

    def single_entries(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, run of equal ones, bucket, entry of each run) of suffixes sent one by one."""
        at = np.nonzero(self.block.reach(self.at[self.code == SINGLY]) & ~self.block.reach(self.at[self.late]))[0]
        words = _words(self.block.strings(at, 0, self.block.length))
        bucket = _bucket(self.block.mix(words), bits)
        _, run = _runs([bucket, *words.T])
        first = _first_of(run)
        out = np.zeros(len(first), _single_dtype(self.block.length))
        out["string"] = self.block.strings(at[first], 0, self.block.length)
        return at, run, bucket[first], self.block.places(at[first], out)


def _suffix_dtype():
    return np.dtype([("rank", "<u8"), ("left", "u1", V - 1), ("right", "u1", V - 1), ("room", "u1", 2), *_PLACE])


def _single_dtype(length: int):
    return np.dtype([("string", "u1", length), *_PLACE])


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _bits(entries: float, size: int) -> int:
    return max(0, math.ceil(math.log2(max(1.0, entries / size))))


def _build(block_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, held, size = 0, [], 0
        for batch in batches:
            for k, h, t in zip(batch["k"], batch["h"], batch["data"]):
                if held and (size + len(t) > block_bytes or len(held) == BLOCK_ROWS):
                    yield _row(seq, held)
                    seq, held, size = seq + 1, [], 0
                held.append((k, h, t))
                size += len(t)
        if held:
            yield _row(seq, held)

    return run


def _row(seq: int, held: list) -> pd.DataFrame:
    ids, hs, texts = zip(*held)
    return pd.DataFrame({"k": ids[:1], "h": hs[:1], "seq": [seq], "ids": [ids], "hs": [hs], "lens": [[len(t) for t in texts]], "data": [b"".join(texts)]})


def kept_text(kept: Column) -> Column:
    """Kept bytes as text; what is left of a code point that a cut went through goes too."""

    @F.pandas_udf("string")
    def whole(data: pd.Series) -> pd.Series:
        return data.map(lambda b: b.decode("utf-8", "ignore"))

    return whole(kept)


def digest(removed: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of what ``deduplicate`` returns."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, block_bytes: int = BLOCK_BYTES, hot: int = HOT, mix: Callable[..., np.ndarray] = _mix) -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)``, one row for each row of ``docs``.

    ``kept`` is the bytes that stay and ``spans`` the ``[start, end)`` byte
    ranges removed, in order; ``kept_text`` makes text of the bytes.  Texts
    are UTF-8 bytes; null and empty ones have none.  Documents are
    ordered by id, null (and the smallest long) first; rows that share an id by
    a hash of their text, and equal rows as they come.
    Matches never cross documents.  ``length`` must be V + 7 or more.  A
    document is held whole by one task, at about 40 bytes a byte.

    Strings are compared by their bytes, but for the surroundings of samples
    with equal bytes, which are compared by two 64-bit hashes (``mix`` with
    seeds 0 and 1).
    """
    if length < V + 7:
        raise ValueError(f"length must be at least {V + 7}")
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64(data).alias("h"), data.alias("data"))
    total = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    n = min(MAX_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_BYTES)))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    # a block is keyed by its first document, which hashes to the partition it was built in:
    # every task writes one bucket, and later joins by key do not move the texts again
    dealt = rows.repartition(n, "k", "h").sortWithinPartitions("k", "h")
    with shuffle_files_end_with_query(spark), setting(spark, _BATCH, "512"):
        dealt.mapInPandas(_build(block_bytes), _BLOCK).write.bucketBy(n, "k", "h").option("compression", "zstd").saveAsTable(name)
    hash_bits = _bits(total * len(COVER) / V, BUCKETS[0])
    rank_bits = _bits(total * len(COVER) / V / 4, BUCKETS[1])

    def each(of: Callable[[_Block, object], Iterator[pd.DataFrame]]):
        def run(batches):
            for batch in batches:
                for row in batch.itertuples():
                    yield from of(_Block(row, length, mix), row)

        return run

    def hashed(block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, keys = block.samples()
        distinct, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        return at, distinct, inverse, count > 1, _bucket(distinct, hash_bits)

    def sample(block: _Block, row) -> Iterator[pd.DataFrame]:
        _, keys, _, _, bucket = hashed(block)
        if len(keys):
            out = np.empty(len(keys), [("key", "u1", _KEY)])
            out["key"] = (keys << np.uint64(hash_bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_KEY]
            yield _send(block, bucket, out)

    def samples(block: _Block, row) -> _Samples:
        at, _, inverse, twice, bucket = hashed(block)
        often = twice | (_answers(block, row.samples, bucket, np.uint8) > 0)
        out = _Samples(block, at[often[inverse]], rank_bits)
        if hasattr(row, "ranks"):
            out.judged(row.ranks)
        return out

    def rank(block: _Block, row) -> Iterator[pd.DataFrame]:
        s = samples(block, row)
        if len(s.at):
            yield _send(block, s.bucket, s.entries())

    def suffixes(bits: int):
        def run(block: _Block, row) -> Iterator[pd.DataFrame]:
            s = samples(block, row)
            _, bucket, entries = s.suffix_entries(bits)
            if len(entries):
                yield _send(block, bucket, entries)

        return run

    def singly(bits: int):
        def run(block: _Block, row) -> Iterator[pd.DataFrame]:
            s = samples(block, row)
            if (s.code == SINGLY).any():
                _, _, bucket, entries = s.single_entries(bits)
                if len(entries):
                    yield _send(block, bucket, entries)

        return run

    def finish(bits: int, single_bits: int, hot_ranks: bool):
        def run(block: _Block, row) -> Iterator[pd.DataFrame]:
            s = samples(block, row)
            again = np.zeros(block.size, bool)
            if len(s.at):
                again |= block.reach(s.at[s.late])
                which, bucket, _ = s.suffix_entries(bits)
                got = _answers(block, row.suffixes, bucket, [("bits", "u1", -(-V // 8))])["bits"]
                sample_no, before = np.nonzero(np.unpackbits(got, axis=1, count=V))
                again[s.at[which[sample_no]] - before] = True
                if hot_ranks and (s.code == SINGLY).any():
                    at, run_of, bucket, _ = s.single_entries(single_bits)
                    late = np.ones(len(at), bool)
                    late[_first_of(run_of)] = _answers(block, row.singles, bucket, np.uint8) > 0
                    again[at[late]] = True
            gone, out = block.covered(again), []
            data = block.bytes[V - 1 :]
            for k, a, b in zip(block.ids, block.starts, block.ends):
                g = gone[a:b]
                edges = np.nonzero(np.diff(g.astype(np.int8), prepend=0, append=0))[0]
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])]
                out.append((None if k == _NULL else int(k), int(b - a), data[a:b][~g].tobytes(), spans))
            out = pd.DataFrame(out, columns=["doc_id", "n_bytes", "kept", "spans"], dtype=object)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), n_bytes=out["n_bytes"].astype("int64"))

        return run

    made = []

    def judged(blocks: DataFrame, send, dtype, verdict, column: str) -> tuple[DataFrame, DataFrame]:
        """The answers of one round, and ``blocks`` with their own in ``column``."""
        answers = cut(blocks.mapInPandas(each(send), _SENT).groupBy("bucket").applyInPandas(_judge(dtype, verdict), _BACK))
        made.append(answers)
        own = cut(answers.groupBy("k", "h").agg(F.collect_list(F.struct("seq", "bucket", "answers")).alias(column)))
        made.append(own)
        return answers, blocks.join(own, ["k", "h"], "left")

    try:
        with setting(spark, _BATCH, "4"):
            blocks = spark.table(name)
            _, blocks = judged(blocks, sample, [("key", "u1", _KEY)], _often, "samples")
            need = length - V + 1
            ranks, blocks = judged(blocks, rank, [("string", "u1", need), ("context", "<u8", 2), ("contexts", "<u4"), *_PLACE], _ranked(hot), "ranks")
            size, most = ranks.agg(F.sum(F.length("answers")), F.max("most")).first()
            entries, hot_ranks = (size or 0) / _RANKED.itemsize, most == SINGLY
            bits, single_bits = _bits(entries, BUCKETS[2]), _bits(8 * entries, BUCKETS[2])
            _, blocks = judged(blocks, suffixes(bits), _suffix_dtype(), _sorted_suffixes, "suffixes")
            if hot_ranks:
                _, blocks = judged(blocks, singly(single_bits), _single_dtype(length), _sorted_singly, "singles")
            return cut(blocks.mapInPandas(each(finish(bits, single_bits, hot_ranks)), _OUT))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for x in made:
            discard(x)
