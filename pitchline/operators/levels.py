"""Ordered passes over coupled entities, many rows at a time.

A row waits for the row before it of each of its entities and for nothing
else.  The rows of a batch are put into levels: no two rows of a level share
an entity, and all that a row waits for lies in lower levels.  A level is a few
array operations, so a pass costs a fraction of a loop over its rows and gives
what that loop gives.  How many rows a level has depends on how many entities
of the scarcest kind there are.  States lie in arrays by number and numbers in
a table of 64-bit keys, some 60 bytes an entity, not in dictionaries of objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are put into levels at once; so many places of a state are the sessions'.
PIECE = 1 << 14
#: What stands for a null whole number.
NONE = -(2**63)


class Numbers:
    """Keys to numbers: an open-addressing table for whole numbers, a dictionary for texts."""

    def __init__(self):
        self.bits, self.held, self.texts = 10, 0, {}
        self.keys, self.number = np.zeros(1 << 10, np.int64), np.full(1 << 10, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        out, at, todo = np.full(len(keys), -1, np.int32), self._place(keys), np.arange(len(keys))
        while len(todo):
            n = self.number[at[todo]]
            hit = (n >= 0) & (self.keys[at[todo]] == keys[todo])
            out[todo[hit]] = n[hit]
            todo = todo[(n >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.number[at[todo]] < 0]
            self.number[at[free]] = numbers[free]  # of several for one place the last stays
            won = free[self.number[at[free]] == numbers[free]]
            self.keys[at[won]] = keys[won]
            todo = todo[self.number[at[todo]] != numbers[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def of(self, keys: np.ndarray, next_number: int) -> tuple[np.ndarray, int]:
        """The numbers of ``keys``, new keys numbered from ``next_number``, and how many are new."""
        if keys.dtype == object:
            before = len(self.texts)
            out = np.array([self.texts.setdefault(k, next_number + len(self.texts) - before) for k in keys.tolist()], np.int32)
            return out, len(self.texts) - before
        each, which = np.unique(keys, return_inverse=True)
        out = self._found(each)
        new = np.flatnonzero(out < 0)
        if len(new):
            if (self.held + len(new)) * 2 > len(self.keys):
                used = self.number >= 0
                keys_before, numbers_before = self.keys[used], self.number[used]
                while (self.held + len(new)) * 2 > (1 << self.bits):
                    self.bits += 1
                self.keys, self.number = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
                self._put(keys_before, numbers_before)
            out[new] = next_number + np.arange(len(new))
            self._put(each[new], out[new])
            self.held += len(new)
        return out[which], len(new)


def levelled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with entity ``ids`` (kinds x rows): the order by levels, where levels begin and end, the row
    before of each entity (-1: none) and how many rows of it there are before."""
    kinds, n = ids.shape
    flat, places = ids.T.ravel(), np.arange(kinds * n)
    o = np.argsort(flat, kind="stable")
    same = np.zeros(kinds * n, bool)
    same[1:] = flat[o[1:]] == flat[o[:-1]]
    last, behind = np.full(kinds * n, -1, np.int64), np.empty(kinds * n, np.int64)
    last[o[1:][same[1:]]] = o[:-1][same[1:]] // kinds
    behind[o] = places - np.maximum.accumulate(np.where(same, 0, places))
    last, behind = last.reshape(n, kinds).T, behind.reshape(n, kinds).T
    level = [0] * (n + 1)  # the last place stands for no row
    for i, before in enumerate(zip(*last.tolist())):
        level[i] = max([level[j] for j in before]) + 1
    level = np.array(level[:n])
    order = np.argsort(level, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(level)[1:])]), last, behind


class _State:
    """The states of a league's entities: values, rows behind and, where asked, the day last seen."""

    def __init__(self, fresh: np.ndarray, kinds: int, sessions: bool, shared: bool):
        self.fresh, self.next = fresh, PIECE if sessions else 0
        self.values = np.broadcast_to(fresh, (2 * PIECE, *fresh.shape)).copy()
        self.rows, self.seen = np.zeros(2 * PIECE, np.int64), np.full(2 * PIECE, np.nan)
        self.numbers = [Numbers()] * kinds if shared else [Numbers() for _ in range(kinds)]
        self.match, self.session = object(), {}

    def entities(self, kind: int, keys: np.ndarray) -> np.ndarray:
        out, new = self.numbers[kind].of(keys, self.next)
        self.next += new
        if self.next > len(self.rows):
            more = max(self.next, len(self.rows) * 3 // 2) - len(self.rows)
            self.values = np.concatenate([self.values, np.broadcast_to(self.fresh, (more, *self.fresh.shape))])
            self.rows, self.seen = np.concatenate([self.rows, np.zeros(more, np.int64)]), np.concatenate([self.seen, np.full(more, np.nan)])
        return out

    def sessions(self, match: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Places of the sessions: each run of one match, by ``part``; one that goes on has its state."""
        turn = np.ones(len(match), bool)
        turn[1:] = match[1:] != match[:-1]
        turn[0] = match[0] != self.match
        if turn[0]:
            self.session = {}
        self.match = match[-1]
        run = np.cumsum(turn)
        pairs, which = np.unique(run.astype(np.int64) << 32 | part.astype(np.int64), return_inverse=True)
        self.values[: len(pairs)], self.rows[: len(pairs)], self.seen[: len(pairs)] = self.fresh, 0, np.nan
        for place in np.flatnonzero(pairs >> 32 == 0):
            if (held := self.session.get(int(pairs[place]))) is not None:
                self.values[place], self.rows[place], self.seen[place] = held
        first = np.searchsorted(pairs, int(run[-1]) << 32)
        self.open = [(int(pairs[i]) & 0xFFFFFFFF, i) for i in range(first, len(pairs))]
        if run[-1] > 0:
            self.session = {}
        return which

    def keep_sessions(self) -> None:
        """The sessions of the last match go on in what follows."""
        for part, place in self.open:
            self.session[part] = self.values[place].copy(), int(self.rows[place]), float(self.seen[place])


def plain(df: DataFrame, c: str) -> Column:
    """``c`` as a whole number or a text that is never null and is equal where ``c`` is."""
    if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def level_scan(df: DataFrame, league: str, order: list[str], keys: list[str], values: list[str | Column], play: Callable, schema: str, fresh: np.ndarray, match: str | None = None, session_by: int | None = None, day: str | None = None, kept: tuple[str, ...] = (), shared: bool = False) -> DataFrame:
    """One ordered pass for each ``league``: the task holds the states of the entities ``keys``, not the rows.

    With ``match`` a session, which starts anew where the match changes, is one
    entity more, for each key number ``session_by`` if given.  Equal keys of
    different columns are one entity if ``shared``.
    ``play(state, ids, bounds, behind, away, values)`` gets a piece in the order
    of its levels: the array of states, the places of the entities (kinds x
    rows), the bounds of the levels, the rows behind each, the days since it
    was last seen (nan: not known) if ``day`` is given, and the columns
    ``values``.  It moves the states and returns an array for each column of
    ``schema`` behind the columns ``kept``, which go out as they came; without
    ``kept`` what it returns is given out as it is.  Null keys, leagues and
    matches are ones of their own.
    """
    n, shown, timed, sessions = len(keys), len(values), day is not None, match is not None
    cols = [plain(df, league).alias("_league"), *(plain(df, c).alias(f"_k{i}") for i, c in enumerate(keys)), *((F.col(c) if isinstance(c, str) else c).cast("double").alias(f"_v{i}") for i, c in enumerate(values))]
    cols += [plain(df, match).alias("_match")] if match else []
    cols += [F.unix_date(F.to_date(day)).cast("double").alias("_day")] if day else []
    cols += [F.col(c).alias(f"_out{i}") for i, c in enumerate(kept)]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            column = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if not c.startswith("_out")}
            lg = column["_league"]
            cuts = {0, b.num_rows, *range(0, b.num_rows, PIECE // 2), *(np.flatnonzero(lg[1:] != lg[:-1]) + 1).tolist()}
            cuts = sorted(cuts)
            for lo, hi in zip(cuts, cuts[1:]):
                x = {c: v[lo:hi] for c, v in column.items()}
                if state is None or x["_league"][0] != at:
                    at, state = x["_league"][0], _State(fresh, n, sessions, shared)
                ids = [state.entities(i, x[f"_k{i}"]) for i in range(n)]
                if sessions:
                    ids.append(state.sessions(x["_match"], np.zeros(hi - lo, np.int32) if session_by is None else ids[session_by]))
                ids = np.array(ids)
                by, bounds, last, behind = levelled(ids)
                behind += state.rows[ids]
                away = None
                if timed:
                    away = x["_day"] - np.where(last >= 0, x["_day"][last], state.seen[ids])
                out = play(state.values, ids[:, by], bounds.tolist(), behind[:, by], away if away is None else away[:, by], [x[f"_v{i}"][by] for i in range(shown)])
                # row by row: of repeated places the last stays
                state.rows[ids.T.ravel()] = behind.T.ravel() + 1
                if timed:
                    state.seen[ids.T.ravel()] = np.repeat(x["_day"], len(ids))
                if sessions:
                    state.keep_sessions()
                if not kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)
                    continue
                back = np.empty_like(by)
                back[by] = np.arange(hi - lo)
                through = [b.column(f"_out{i}").slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*through, *(pa.array(c[back]) for c in out)], names)

    rows = df.select(*cols, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    # by number: else the planner might put leagues, which are long work on few bytes, into one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "_league").sortWithinPartitions("_league", *(f"_o{i}" for i in range(len(order))))
    return rows.drop(*(f"_o{i}" for i in range(len(order)))).mapInArrow(run, schema)
