"""Keyword scores of many queries at once, entry by entry: what is shuffled follows the postings and the results, not queries times postings.

Queries with the same terms are one set of terms. An entry's postings are gathered in its own row or by one shuffle, each block of entries meets all sets within a task, and a task
keeps the best k entries of each set.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Distinct sets of terms that go to tasks at most; batches with more are joined with the postings and shuffled.
MOST_SETS = 100_000
#: Entries of a block; cells of a matrix, and places, worked on at once; rows that a task holds before it cuts them, and after.
ENTRIES, CELLS, PLACES, HELD = 1024, 4_000_000, 2_000_000, 1_000_000


def round9(x: np.ndarray) -> np.ndarray:
    """10^9 times numbers rounded half up to nine places, as Spark rounds them."""
    y = x * 1e9 + 0.5
    out = np.floor(y).astype(np.int64)
    near = np.flatnonzero(np.abs(y - np.rint(y)) < 1e-4)
    if len(near):
        odd, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([int((Decimal(repr(float(v))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP)) for v in odd], np.int64)[at]
    return out


def named_sets(queries: DataFrame, split: Callable[[Column], Column]) -> DataFrame:
    """(query_id, terms, _set) of queries with a term: sorted distinct terms, and the smallest query_id that has the same."""
    asked = queries.select("query_id", F.array_sort(F.array_distinct(split(F.col("query")))).alias("terms")).where(F.size("terms") > 0).distinct()
    return asked.withColumn("_set", F.min("query_id").over(Window.partitionBy("terms")))


def few_sets(named: DataFrame) -> TermSets | None:
    """The distinct sets of named queries, if they are at most MOST_SETS."""
    found = named.select("_set", "terms").distinct().limit(MOST_SETS + 1).toArrow()
    return TermSets(found) if found.num_rows <= MOST_SETS else None


def of_queries(ranked: DataFrame, named: DataFrame, groups: list[str]) -> DataFrame:
    """(query_id, groups, entry_id, score, rank): each query takes the rows of its set."""
    return ranked.join(named.select("query_id", "_set"), "_set").select("query_id", *groups, "entry_id", "score", "rank")


class TermSets:
    """Sets of terms as numbers. `terms`: all terms of the sets; `sets`: for each number of terms, (places of the sets, their terms' codes)."""

    def __init__(self, found: pa.Table):
        self.ids = found["_set"].combine_chunks()
        lists = found["terms"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.terms = coded.dictionary.cast(pa.string())
        codes, sizes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        self.sets = {int(m): (at := np.flatnonzero(sizes == m), codes[first[at][:, None] + np.arange(m)]) for m in np.unique(sizes)}

    def several(self) -> TermSets | None:
        """The sets of more than one term, with the same numbers."""
        out = copy.copy(self)
        out.sets = {m: x for m, x in self.sets.items() if m > 1}
        return out if out.sets else None

    def used(self) -> np.ndarray:
        """Codes of the terms in these sets."""
        return np.unique(np.concatenate([codes.reshape(-1) for _, codes in self.sets.values()]))

    def pairs(self, block: Block, below: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set, entry, score) arrays of the block's entries that hold all terms of a set; pairs for which below(set, entry, most) holds may be left out, where no score is above most."""
        here, code = np.unique(block.code, return_inverse=True)
        local = np.full(len(self.terms), -1)
        local[here] = np.arange(len(here))
        at = np.full((len(here), block.n), -1, np.int32)
        at[code, block.row] = np.arange(len(code))
        for m, (number, codes) in self.sets.items():
            own = local[codes]
            there = np.flatnonzero((own >= 0).all(axis=1))
            step = max(1, CELLS // max(block.n, 1))
            for part in (there[lo : lo + step] for lo in range(0, len(there), step)):
                have = at[own[part, 0]] >= 0
                for j in range(1, m):
                    have &= at[own[part, j]] >= 0
                s, e = np.nonzero(have)
                posting = at[own[part[s]], e[:, None]]
                tf = block.tf[posting]
                if m == 1:
                    yield number[part[s]], e, tf[:, 0] * 0.1
                    continue
                # covers end at different places, the first after all terms but one; of two terms, an occurrence starts and ends one each
                most = tf.sum(axis=1) - (m - 1)
                most = np.minimum(most, 2 * tf.min(axis=1)) if m == 2 else most
                keep = np.flatnonzero(~below(number[part[s]], e, most * 0.1))
                ends = np.cumsum(tf[keep].sum(axis=1))
                cuts = np.searchsorted(ends, np.arange(PLACES, ends[-1] if len(ends) else 0, PLACES))
                for some in np.split(keep, np.unique(cuts)):
                    if len(some):
                        yield number[part[s[some]]], e[some], block.covers(posting[some])


class Block:
    """Postings of n entries: entry and term (code) of each, its number of places, and all places one after another."""

    def __init__(self, n: int, row: np.ndarray, code: np.ndarray, tf: np.ndarray, places: np.ndarray):
        self.n, self.row, self.code, self.tf, self.places = n, row, code, tf, places
        self.first = np.cumsum(tf) - tf

    def covers(self, posting: np.ndarray) -> np.ndarray:
        """The cover density of each row of postings (see retrieval.cover_density)."""
        n, m = posting.shape
        flat = posting.reshape(-1)
        sizes = self.tf[flat]
        ends = np.cumsum(sizes)
        place = self.places[np.arange(ends[-1]) + np.repeat(self.first[flat] - (ends - sizes), sizes)].astype(np.int64)
        which = np.repeat(np.arange(n * m), sizes)
        pair = which // m
        order = np.argsort((pair << 32) + place, kind="stable")
        place, term = place[order], (which % m)[order]
        each = np.bincount(pair, minlength=n)
        begin = (np.cumsum(each) - each)[pair]  # pairs keep their sizes and order
        turn = np.arange(len(place))
        start = turn
        for j in range(m):
            start = np.minimum(start, np.maximum.accumulate(np.where(term == j, turn, -1)))
        done = start >= begin
        new = done.copy()
        new[1:] &= ~(done[:-1] & (pair[1:] == pair[:-1]) & (start[1:] == start[:-1]))
        end, start = turn[new], start[new]
        return np.bincount(pair[new], 0.1 / (1 + (place[end] - place[start]) - (end - start)), minlength=n)


class Best:
    """The best k entries of each set and group so far, equal rounded scores by id."""

    def __init__(self, k: int, ids: pa.Array, id_kind: pa.DataType, group_kinds: list[pa.DataType], names: list[str]):
        self.k, self.ids, self.id_kind, self.group_kinds, self.names = k, ids, id_kind, group_kinds, names
        self.groups: dict[tuple, int] = {}
        self.parts, self.rows = [], 0
        self.full, self.least = np.empty(0, np.int64), np.empty(0, np.int64)

    def codes(self, groups: list[pa.Array], n: int) -> np.ndarray:
        """Numbers of entries' groups."""
        if not groups:
            self.groups.setdefault((), 0)
            return np.zeros(n, np.int64)
        return np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(*(g.to_pylist() for g in groups), strict=True)], np.int64)

    def below(self, number: np.ndarray, group: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Where a score of most or less is not among the best."""
        if not len(self.full):
            return np.zeros(len(number), bool)
        key = (number << 32) + group
        at = np.minimum(np.searchsorted(self.full, key), len(self.full) - 1)
        return (self.full[at] == key) & (most * 1e9 + 1 < self.least[at])

    def least_of(self, numbers: np.ndarray, group: int) -> np.ndarray:
        """A score below which no row of these sets and a group is among the best."""
        if not len(self.full):
            return np.full(len(numbers), -np.inf)
        key = (numbers << 32) + group
        at = np.minimum(np.searchsorted(self.full, key), len(self.full) - 1)
        return np.where(self.full[at] == key, (self.least[at] - 1) / 1e9, -np.inf)

    def add(self, number: np.ndarray, group: np.ndarray, entry: pa.Array, score: np.ndarray) -> None:
        self.parts.append(pa.table({"key": (number << 32) + group, "less": -round9(score), "entry": entry, "score": score}))
        self.rows += len(number)

    def cut(self) -> None:
        if self.parts:
            t = pa.concat_tables(self.parts).combine_chunks()
            t = t.take(pc.sort_indices(t, [("key", "ascending"), ("less", "ascending"), ("entry", "ascending")]))
            key = t["key"].to_numpy()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            last = np.flatnonzero(place == self.k - 1)
            self.full, self.least = key[last], -t["less"].to_numpy()[last]
            t = t.take(pa.array(np.flatnonzero(place < self.k)))
            self.parts, self.rows = [t], t.num_rows

    def given(self) -> Iterator[pa.RecordBatch]:
        """All rows, which are held no longer."""
        self.cut()
        for t in self.parts:
            for b in t.to_batches(10_000):
                key = b.column(0).to_numpy()
                names = [pa.array([g[i] for g in self.groups], kind) for i, kind in enumerate(self.group_kinds)]
                at = pa.array(key & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(key >> 32)), *(x.take(at) for x in names), b.column(2).cast(self.id_kind), b.column(3)], self.names)
        self.parts, self.rows = [], 0

    def take(self, sets: TermSets, block: Block, groups: list[pa.Array], entries: pa.Array) -> Iterator[pa.RecordBatch]:
        """Add a block's pairs; rows come out only where they would be too many to hold."""
        group = self.codes(groups, block.n)
        for number, e, score in sets.pairs(block, lambda number, e, most: self.below(number, group[e], most)):
            self.add(number, group[e], entries.take(pa.array(e)), score)
            if self.rows > 2 * HELD:
                self.cut()
                if self.rows > HELD:
                    yield from self.given()
        if self.rows > HELD:
            self.cut()


def _result(rows: DataFrame, sets: TermSets, k: int, groups: list[str]) -> tuple[Callable[[], Best], str]:
    kinds = {f.name: f.dataType for f in rows.schema}
    id_kind, ids, arrow = to_arrow_type(kinds["entry_id"]), sets.ids, [to_arrow_type(kinds[g]) for g in groups]
    set_kind = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.large_string(): "string"}.get(ids.type)
    if set_kind is None:
        raise TypeError(f"query_id must be a whole number or text, not {ids.type}")
    schema = f"_set {set_kind}, {''.join(f'`{g}` {kinds[g].simpleString()}, ' for g in groups)}entry_id {kinds['entry_id'].simpleString()}, score double"
    return lambda: Best(k, ids, id_kind, arrow, ["_set", *groups, "entry_id", "score"]), schema


def best_of_texts(entries: DataFrame, sets: TermSets, k: int, text_col: str, groups: list[str], split: Callable[[Column], Column]) -> DataFrame:
    """(_set, groups, entry_id, score): each task's best k entries of each set, from texts split within their own rows."""
    best, schema = _result(entries, sets, k, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = best()
        for batch in batches:
            for part in (batch.slice(lo, ENTRIES) for lo in range(0, batch.num_rows, ENTRIES)):
                words = part.column(len(groups) + 1)
                sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = words.flatten().dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.string()), value_set=sets.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                code = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row, place, code = (x[code >= 0] for x in (row, place, code))
                key = row * max(len(sets.terms), 1) + code
                order = np.argsort(key, kind="stable")  # places of a term stay in order
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                at = order[first]
                block = Block(len(sizes), row[at], code[at], np.diff(np.append(first, len(order))), place[order])
                yield from held.take(sets, block, [part.column(i + 1) for i in range(len(groups))], part.column(0))
        yield from held.given()

    return entries.select("entry_id", *groups, split(F.col(text_col)).alias("_tokens")).mapInArrow(run, schema)


def best_of_postings(postings: DataFrame, sets: TermSets, k: int, groups: list[str]) -> DataFrame:
    """The same from postings (entry_id, groups, code, positions) of the sets' terms, where code is a term's place in sets.terms: they are shuffled once, by entry."""
    best, schema = _result(postings, sets, k, groups)
    heads = ["entry_id", *groups]

    def block_of(t: pa.Table, first: np.ndarray) -> tuple[Block, list]:
        lists = t["positions"].combine_chunks()
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
        tf = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pa.array(first)
        return Block(len(first), row, t["code"].to_numpy().astype(np.int64), tf, lists.flatten().to_numpy(zero_copy_only=False)), [t[c].combine_chunks().take(at) for c in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = best(), [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of the entries that are whole; the last one waits for more rows."""
            nonlocal waiting, rows
            t = pa.Table.from_batches(waiting).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in heads:
                code = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            whole = first if last else first[:-1]
            end = t.num_rows if last else int(first[-1])
            for lo in range(0, len(whole), ENTRIES):
                some = whole[lo : lo + ENTRIES]
                to = int(whole[lo + ENTRIES]) if lo + ENTRIES < len(whole) else end
                block, found = block_of(t.slice(some[0], to - int(some[0])), some - some[0])
                yield from held.take(sets, block, found[1:], found[0])
            waiting = t.slice(end).to_batches()
            rows = t.num_rows - end

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows > 20 * ENTRIES:
                yield from blocks(False)
        if waiting:
            yield from blocks(True)
        yield from held.given()

    return postings.select(*heads, "code", "positions").repartition("entry_id").sortWithinPartitions(*heads).mapInArrow(run, schema)
