"""Frequency of every term: vertical layout of compressed record-id bitmaps with occurrence counters beside them.

A term's bitmap is held in containers, one for each block of 65,536 record ids that it touches: a sorted list of 16-bit
places, a list of runs, or 8,192 bytes of bits, whichever is shortest. Each task first builds the containers of its own
rows, so a term that holds a third of all rows is small before anything is moved; containers of one term and block are
then united, and the number of records is read from their cardinalities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import materialize, whole_rows_once

#: Record ids of a block, by bits.
BLOCK_BITS = 16
#: Blocks that a task holds open, of 64 KB each, while all terms are united.
OPEN_BLOCKS = 1_024
#: Rows whose containers a task builds at a time.
TASK_ROWS = 1_000_000

# Kinds of containers.
PLACES, RUNS, BITS = 0, 1, 2

_POSTINGS = "term string, block long, kind int, bitmap binary, records int, occurrences long, rows long"


def encode(places: np.ndarray) -> tuple[int, bytes]:
    """The shortest container of sorted distinct 16-bit places."""
    n = len(places)
    if n > 3:
        starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        if 2 * len(starts) < min(n, 4096):
            runs = np.stack([places[starts], np.diff(np.append(starts, n)) - 1], axis=1)
            return RUNS, runs.astype("<u2").tobytes()
        if n > 4096:
            bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
            bits[places] = True
            return BITS, np.packbits(bits, bitorder="little").tobytes()
    return PLACES, places.astype("<u2").tobytes()


def decode(kind: int, bitmap: bytes) -> np.ndarray:
    """The sorted places of a container."""
    if kind == BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little"))
    values = np.frombuffer(bitmap, dtype="<u2").astype(np.int64)
    if kind == PLACES:
        return values
    starts, more = values[0::2], values[1::2] + 1
    return np.repeat(starts, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)


def _containers(owner: np.ndarray, places: np.ndarray, groups: int) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """Kind, container and cardinality of each of `groups` groups; owner is the group of each place, both sorted."""
    kinds, size = np.zeros(groups, dtype=np.int32), np.bincount(owner, minlength=groups).astype(np.int32)
    ends = np.cumsum(size)
    raw = places.astype("<u2").tobytes()
    made: list[bytes | None] = [raw[2 * (e - n) : 2 * e] if n else None for e, n in zip(ends.tolist(), size.tolist())]
    for g in np.flatnonzero(size > 3).tolist():
        kinds[g], made[g] = encode(places[ends[g] - size[g] : ends[g]])
    return kinds, made, size


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= TASK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _batch(terms: pa.Array, blocks: np.ndarray, no_block: np.ndarray, kinds: np.ndarray, made: list, size: np.ndarray, uses: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    block = pa.array(blocks, pa.int64(), mask=no_block)
    columns = [terms, block, pa.array(kinds, pa.int32()), pa.array(made, pa.binary()), pa.array(size, pa.int32()), pa.array(uses, pa.int64()), pa.array(rows, pa.int64())]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["term", "block", "kind", "bitmap", "records", "occurrences", "rows"])


def _own_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a task's rows (term, rec, n)."""
    for t in _portions(batches):
        words = t["term"].combine_chunks()
        words = words.dictionary_encode() if not isinstance(words, pa.DictionaryArray) else words
        code = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rec = t["rec"].combine_chunks()
        none = rec.is_null().to_numpy(zero_copy_only=False)
        rec = rec.fill_null(0).to_numpy(zero_copy_only=False)
        n = t["n"].combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((rec, none, code))
        code, rec, none, n = code[order], rec[order], none[order], n[order]
        block = np.where(none, 0, rec >> BLOCK_BITS)
        fresh = np.flatnonzero((np.diff(code, prepend=code[0] - 1) != 0) | (np.diff(block, prepend=block[0] - 1) != 0) | np.diff(none.astype(np.int8), prepend=-1).astype(bool))
        group = np.zeros(len(code), dtype=np.int64)
        group[fresh[1:]] = 1
        group = np.cumsum(group)
        first = np.append(True, (np.diff(group) != 0) | (np.diff(rec) != 0)) & ~none
        kinds, made, size = _containers(group[first], rec[first] & 0xFFFF, len(fresh))
        where = pa.array(code[fresh], mask=code[fresh] < 0)
        terms = words.dictionary.take(where) if len(words.dictionary) else pa.nulls(len(fresh), pa.string())
        yield _batch(terms.cast(pa.string()), block[fresh], none[fresh], kinds, made, size, np.add.reduceat(n, fresh), np.diff(np.append(fresh, len(code))))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by term and block with those of one term and block united. Of the group that a batch ends with only
    the united container is kept for the next."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        fresh = _starts(t)
        done = int(fresh[-1])
        if done:
            yield _merge(t.slice(0, done), fresh[:-1])
        rest = pa.Table.from_batches([_merge(t.slice(done), np.zeros(1, dtype=np.int64))])
    if rest is not None:
        yield from rest.to_batches()


def _starts(t: pa.Table) -> np.ndarray:
    """Rows at which another term or block begins."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for name in ("term", "block"):
        c = t[name].combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _merge(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    t = t.combine_chunks()
    count = np.diff(np.append(starts, t.num_rows))
    kind, size = (t[c].to_numpy().copy() for c in ("kind", "records"))
    made = t["bitmap"].to_pylist()
    for g in np.flatnonzero(count > 1).tolist():
        at = starts[g]
        bits = np.zeros(1 << BLOCK_BITS, dtype=bool) if count[g] > 8 else None
        parts = []
        for k in range(at, at + count[g]):
            if made[k] is not None:
                p = decode(kind[k], made[k])
                if bits is None:
                    parts.append(p)
                else:
                    bits[p] = True
        places = np.flatnonzero(bits) if bits is not None else np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
        size[at] = len(places)
        kind[at], made[at] = encode(places) if len(places) else (PLACES, None)
    blocks = t["block"].combine_chunks().take(pa.array(starts))
    sums = [np.add.reduceat(t[c].to_numpy(), starts) for c in ("occurrences", "rows")]
    return _batch(t["term"].take(pa.array(starts)), blocks.fill_null(0).to_numpy(zero_copy_only=False), blocks.is_null().to_numpy(zero_copy_only=False), kind[starts], [made[s] for s in starts.tolist()], size[starts], *sums)


def term_postings(df: DataFrame, term: str, record: str, count: str | None = None) -> DataFrame:
    """(term, block, kind, bitmap, records, occurrences, rows): one row per term and block of 65,536 record ids.

    record is an integral id; rows of null records set no bit (block and bitmap null) but their occurrences count. Null
    terms form postings of their own (term null), so the union over all terms still covers every record. count null:
    each row occurs once. An empty input gives no rows; further columns of df are ignored.
    """
    n = F.coalesce(F.col(count), F.lit(0)) if count else F.lit(1)
    rows = df.select(F.col(term).cast("string").alias("term"), F.col(record).cast("long").alias("rec"), n.cast("long").alias("n"))
    own = rows.mapInArrow(_own_postings, _POSTINGS)
    return own.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_united, _POSTINGS)


def _all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One container per block of what a task's postings hold; with postings sorted by block no block has two."""
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        for block, kind, bitmap in zip(*(b.column(k).to_pylist() for k in ("block", "kind", "bitmap"))):
            if bitmap is None:
                continue
            if block not in seen:
                if len(seen) >= OPEN_BLOCKS:
                    yield from _emit(seen)
                    seen = {}
                seen[block] = np.zeros(1 << BLOCK_BITS, dtype=bool)
            seen[block][decode(kind, bitmap)] = True
    yield from _emit(seen)


def _emit(seen: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    made = [encode(np.flatnonzero(bits)) for bits in seen.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([k for k, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary()), pa.array([int(x.sum()) for x in seen.values()], pa.int32())], ["block", "kind", "bitmap", "records"])


def record_total(postings: DataFrame) -> int:
    """Number of distinct records over all terms: the union of all bitmaps, counted."""
    shape = "block long, kind int, bitmap binary, records int"
    per_task = postings.select("block", "kind", "bitmap").mapInArrow(_all_terms, shape)
    return per_task.repartition("block").sortWithinPartitions("block").mapInArrow(_all_terms, shape).agg(F.sum("records")).first()[0] or 0


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, occurrences, rows, records): records is the cardinality of the term's bitmap. Null terms are left out."""
    return postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("rows").alias("rows"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, term: str, record: str, count: str | None = None, rare_below: int = 3, common_share: float = 0.1, once: bool = True) -> DataFrame:
    """(term, occurrences, rows, records, mark) for every term of df.

    mark is 'rare' below rare_below records, else 'common' from common_share of all records on, else null. Rows that
    repeat as a whole count once (once=True) before anything is counted.
    """
    base = whole_rows_once(df) if once else df
    postings = materialize(term_postings(base, term, record, count), "postings")
    total = record_total(postings)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") / F.lit(max(total, 1)) >= common_share, "common")  # a quotient of an exact share equals it
    return term_frequencies(postings).withColumn("mark", mark)
