"""Periodic runs of words by recompression.

A batch of texts becomes one sequence of word numbers with an end mark of its
own behind each text.  Recompression alternates two rounds: blocks of a
repeated symbol become one symbol, and pairs become one symbol where the first
is drawn left and the second right.  Both look at neighbours only, so equal
stretches are compressed alike up to their borders, and a common extension is
found by climbing the levels of the grammar while symbols agree and descending
once where they part: a few array steps a level for all queries at once.

A run of period q and length 2q or more holds two neighbours of the grid of
multiples of q, whose words agree; the extensions of such a pair to both sides
are the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import unused
from pitchline.session import bounded_batches

#: A run has this many words at least; candidates are made so many at a time.
LEAST, CHUNK = 12, 1 << 20
_ROUNDS = 128


@dataclass
class _Level:
    """``symbols`` of a level; ``first`` child of each in the level below and ``parent`` in the one above.

    ``blocks`` tells how the level above was made."""

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    blocks: bool = False


def _left(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Which symbols are drawn left in a round: a bit of a mixed number (fixed odd multipliers of the mix)."""
    x = symbols.astype(np.uint64) + np.uint64(turn * 0x9E3779B9 + 1)
    x = (x ^ x >> np.uint64(15)) * np.uint64(0x2C1B3C6D)
    x = (x ^ x >> np.uint64(12)) * np.uint64(0x297A2D39)
    return (x >> np.uint64(17) & np.uint64(1)).astype(bool)


def _named(a: np.ndarray, b: np.ndarray, following: int) -> tuple[np.ndarray, int]:
    """A number, from ``following`` on, for each distinct pair."""
    _, name = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
    return name + following, following + int(name.max()) + 1


def grammar(symbols: np.ndarray, marks: int) -> list[_Level]:
    """The levels above ``symbols``, of which the last ``marks`` numbers, each used once, are end marks and stay as they are.

    Ends when a round of pairs finds none and each text is one symbol, or
    after a fixed number of rounds; what is left is compared symbol by symbol.
    """
    top = int(symbols.max()) + 1 if len(symbols) else 0
    first_mark = top - marks
    levels, idle = [_Level(symbols)], 0
    marked = (symbols >= first_mark) & (symbols < top)
    for turn in range(_ROUNDS):
        now = levels[-1]
        s = now.symbols
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if turn % 2 == 0 else None
        if starts is None:
            left = _left(s, turn)
            pair = np.zeros(len(s), bool)
            pair[:-1] = left[:-1] & ~left[1:] & ~marked[:-1] & ~marked[1:]
            begins = np.ones(len(s), bool)
            begins[1:] = ~pair[:-1]
            starts = np.flatnonzero(begins)
        if len(starts) == len(s):
            idle += 1
            if idle > 16 or len(s) <= 2 * marks:
                break
            if turn % 2 == 0:
                continue
        up = s[starts].copy()
        if len(starts) < len(s):
            idle = 0
            length = np.diff(starts, append=len(s))
            long = length > 1
            other = length[long] if turn % 2 == 0 else s[starts[long] + 1]
            up[long], top = _named(up[long], other, top)
        elif turn % 2:
            continue
        now.blocks = turn % 2 == 0
        now.parent = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(s)))
        levels.append(_Level(up, starts))
        marked = marked[starts]
    return levels


def turned(levels: list[_Level]) -> list[_Level]:
    """The grammar of the sequence read from its end; its parts are those of ``levels``."""
    out = []
    for k, x in enumerate(levels):
        first = None if x.first is None else len(levels[k - 1].symbols) - np.append(x.first[1:], len(levels[k - 1].symbols))[::-1]
        parent = None if x.parent is None else len(levels[k + 1].symbols) - 1 - x.parent[::-1]
        out.append(_Level(x.symbols[::-1], first, parent, x.blocks))
    return out


def common_extensions(levels: list[_Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from ``i`` and from ``j`` on agree; i < j, and an end mark behind each text ends the later one."""
    which, a, b = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
    parted: list[tuple] = []
    for k, x in enumerate(levels):
        same = x.symbols[a] == x.symbols[b]
        parted.append((which[~same], a[~same], b[~same]))
        which, a, b = which[same], a[same], b[same]
        if not len(which) or x.parent is None:
            while len(which):  # at the top, symbol by symbol
                a, b = a + 1, b + 1
                same = x.symbols[a] == x.symbols[b]
                parted.append((which[~same], a[~same], b[~same]))
                which, a, b = which[same], a[same], b[same]
            break
        first = levels[k + 1].first
        up_a, up_b = x.parent[a], x.parent[b]
        inside = (first[up_a] != a) | (first[up_b] != b)
        if x.blocks:  # what is left of the two blocks of one symbol: if equal both are at an end, else they part behind the shorter
            ends = np.append(first, len(x.symbols))
            rest_a, rest_b = ends[up_a + 1] - a, ends[up_b + 1] - b
            part = inside & (rest_a != rest_b)
            least = np.minimum(rest_a, rest_b)[part]
            parted[-1] = tuple(np.concatenate((u, v)) for u, v in zip(parted[-1], (which[part], a[part] + least, b[part] + least)))
            which, up_a, up_b, inside = which[~part], up_a[~part], up_b[~part], inside[~part]
        # within a pair one symbol more is behind, and both go on where a symbol of the level above begins
        a, b = up_a + inside, up_b + inside
    depth = min(len(parted), len(levels)) - 1
    out = np.zeros(len(i), np.int64)
    # what parted above the last level's first look belongs to the top level
    held = [parted[k] for k in range(depth)] + [tuple(np.concatenate(x) for x in zip(*parted[depth:]))]
    which, a, b = held[depth]
    for k in range(depth, 0, -1):
        x, below = levels[k], levels[k - 1]
        a0, b0 = x.first[a], x.first[b]
        same = below.symbols[a0] == below.symbols[b0]
        if below.blocks:
            ends = np.append(x.first, len(below.symbols))
            step = np.minimum(ends[a + 1] - a0, ends[b + 1] - b0) * same
        else:
            step = same.astype(np.int64)
        which, a, b = (np.concatenate(y) for y in zip((which, a0 + step, b0 + step), held[k - 1]))
    out[which] = a - i[which]
    return out


def _grid(sizes: np.ndarray, offsets: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of all neighbours on the grids of all texts whose words agree, a bounded number at a time."""
    most = sizes // 2
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    steps = (sizes[text] - 1) // period
    upto = np.cumsum(steps)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        n = steps[at:to]
        row = np.repeat(np.arange(at, to), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        q = period[row]
        x = offsets[text[row]] + k * q
        hit = symbols[x] == symbols[x + q]
        yield text[row][hit], x[hit], q[hit]
        at = to


def find(symbols: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of texts that stand one after the other, by text, start and period.

    ``symbols`` are their words' numbers; ``sizes`` how many each has.
    """
    sizes = np.asarray(sizes, np.int64)
    offsets = np.cumsum(sizes) - sizes + np.arange(len(sizes)) + 1
    total = int(sizes.sum()) + len(sizes) + 1
    words = int(symbols.max()) + 1 if len(symbols) else 0
    # a mark before the first text and one behind each
    laid = np.empty(total, np.int64)
    is_mark = np.zeros(total, bool)
    is_mark[0] = True
    is_mark[offsets + sizes] = True
    laid[is_mark] = words + np.arange(len(sizes) + 1)
    laid[~is_mark] = symbols
    levels = grammar(laid, len(sizes) + 1)
    back = turned(levels)
    found = []
    for text, x, q in _grid(sizes, offsets, laid):
        ahead = common_extensions(levels, x, x + q)
        # the words before both, from right to left; the later place comes first when read from the end
        behind = common_extensions(back, total - x - q, total - x)
        length = behind + ahead + q
        good = length >= np.maximum(least, 2 * q)
        found.append(np.unique(np.stack((text[good], (x - behind)[good], length[good], q[good])), axis=1))
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    # multiples of a run's period span the same words: the smallest is its period
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    text, start, length, period = rows[:, first]
    start = start - offsets[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def collapsed(sizes: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    sizes = np.asarray(sizes, np.int64)
    offsets = np.cumsum(sizes) - sizes
    depth = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(depth, offsets[text] + start + period, 1)
    np.add.at(depth, offsets[text] + start + length, -1)
    return np.cumsum(depth)[:-1] == 0


def _split(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, their numbers, and how many each text has; bytes split at ASCII white space."""
    per = [(t or b"").split() for t in texts]
    words = [w for p in per for w in p]
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return words, numbers, np.fromiter(map(len, per), np.int64, len(per))


def _scan(batches: Iterator[pa.RecordBatch], n: str, runs: str, kept: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b[kept].to_pylist()
        words, numbers, sizes = _split(texts)
        rows = find(numbers, sizes)
        stays = collapsed(sizes, *rows)
        ends = np.cumsum(sizes)
        told = [b" ".join([words[k] for k in np.flatnonzero(stays[e - m : e]) + e - m]) for e, m in zip(ends, sizes)]
        upto = np.searchsorted(rows[0], np.arange(len(texts) + 1))
        fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in rows[1:]], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), fields)
        others = [c for c in b.schema.names if c != kept]
        out = [*(b[c] for c in others), pa.array(sizes, pa.int64()), listed, pa.array(told, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, [*others, n, runs, kept])


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` and with ``n_words``, ``runs`` (array of start, length, period by start,
    then period) and ``collapsed``, the words that stay, joined by a space, as UTF-8 bytes.

    Words are separated by ASCII white space and numbered from 0; null, empty
    and blank texts have none.  A run is a stretch of ``LEAST`` words or more
    and twice its smallest period or more that no neighbour extends.  Rows are
    read one batch after the other, repeated rows each for itself; a text is
    never cut, and its grammar takes about 300 bytes a word.  Columns called
    like the new ones are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in new]
    n, runs, kept = unused(docs, "_n", "_runs", "_kept")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("binary").alias(kept))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != kept)
    schema = (kinds + ", " if kinds else "") + f"`{n}` long, `{runs}` array<struct<start:long,length:long,period:long>>, `{kept}` binary"
    return rows.mapInArrow(lambda batches: _scan(batches, n, runs, kept), schema).withColumnsRenamed({n: "n_words", runs: "runs", kept: "collapsed"})
