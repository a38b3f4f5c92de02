"""Exact removal of repeated 50-byte strings with difference-cover suffix sorting over shards.

A byte of a document goes if it lies in a string of LENGTH bytes that also starts in a document with a
smaller id. Strings are compared as byte windows within documents; nothing is sampled or capped.

1. Ruling out. Each window has a key: the least hash of its GRAM-byte grams. Equal windows have equal keys,
   and neighbouring windows mostly share theirs, so a document is a chain of phrases: runs of windows with
   one key. A key that only one document has rules its windows out: they recur in no other. Hashes decide
   nothing else.
2. Sorting. The phrases of all other keys are dealt out into shards by their key, so that equal windows meet.
   A group of texts sends each of its different phrases once, with its least document. In a shard their
   suffixes are sorted with the difference cover {1, 2} mod 3: sampled triples are sorted and named, names
   are sorted recursively until they reach over LENGTH bytes, the remaining suffixes are merged in, and
   adjacent suffixes are compared on their first LENGTH bytes. Runs of equal prefixes are the equal windows;
   each learns the least document of its run. A key with over HOT phrases is not kept together: its windows
   are dealt out one by one, by their own hash.
3. Covering. Groups learn the least documents of their phrases' windows; a window goes if its least document
   is smaller than its own. What goes is united per document and the bytes taken out.

What is shuffled: some 5 bytes for each of n/16 phrases, the different phrases of step 2 by group, and the
texts twice, compressed. A passage in a third of all documents is one phrase a group of texts, whatever
their number; its shard holds one entry a group.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; documents with equal ids do
not repeat each other; rows with a null id neither lose bytes nor make others lose any; equal rows get
equal results; an empty table gives no rows. Removal may cut inside a UTF-8 character; `deduplicated`
drops the characters that are left incomplete, the digests use the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs
from .common import checkpointed, mapped, release, shuffle_width

LENGTH = 50
GRAM = 20
LONGEST, STRETCH = 256, 1 << 20
HOT = 16_000
SHARD = 1_000_000
CHUNK_BYTES = 64_000_000
GROUP_BYTES, LEAST_GROUP_BYTES = 16_000_000, 2_000_000

_B = np.uint64(0x9E3779B97F4A7C15)
_K_MASK = np.uint64((1 << 48) - 1)


# ---------------------------------------------------------------- suffix sorting in one shard


def _ordered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of keys of so many bits; places ride along with the keys where both fit into 63 bits."""
    at = max(len(keys) - 1, 1).bit_length()
    if bits + at > 63:
        order = np.argsort(keys)
        return order, keys[order]
    both = np.sort(keys << at | np.arange(len(keys)))
    return both & ((1 << at) - 1), both >> at


def _named(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, names from 1 in the order of the keys)."""
    order, in_order = _ordered(keys, bits)
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.append(True, in_order[1:] != in_order[:-1]))
    return order, names


def suffix_order(s: np.ndarray, reach: int, covers: int = 1) -> np.ndarray:
    """Starts of the suffixes of s (integers above 0) in an order by their first `reach` units at least.

    covers: units that one element of s stands for; recursion ends when triples reach far enough.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.zeros(n + 5, np.int64)
    padded[:n] = s
    bits = int(s.max()).bit_length()
    # A start past the end, of the class 1 mod 3, ends the first half where no other would.
    at = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    pair, pair_bits = padded[:-1] << bits | padded[1:], 2 * bits
    triples = pair[at]
    if 3 * bits > 63:  # a name for the first two, so that all three fit
        _, triples = _named(triples, pair_bits)
        pair_bits = len(at).bit_length()
    order, names = _named(triples << bits | padded[at + 2], pair_bits + bits)
    if names[order[-1]] < len(at) and 3 * covers < reach:
        order = suffix_order(names, reach, 3 * covers)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[at] = names
    sampled = at[order]
    sampled = sampled[sampled < n]
    zero, wide = np.arange(0, n, 3), (len(at) + 1).bit_length()
    order, key0 = _ordered(padded[zero] << wide | rank[zero + 1], bits + wide)
    zero, first = zero[order], sampled % 3 == 1
    ones, twos = sampled[first], sampled[~first]
    before = np.searchsorted(padded[ones] << wide | rank[ones + 1], key0)
    if 2 * bits + wide > 63:
        pairs, pair = np.unique(pair, return_inverse=True)
        if len(pairs).bit_length() + wide > 63:
            raise ValueError(f"a string of {n} units is too long")
    before += np.searchsorted(pair[twos] << wide | rank[twos + 2], pair[zero] << wide | rank[zero + 2])
    out = np.full(n, -1, np.int64)
    out[np.maximum.accumulate(before) + np.arange(len(zero))] = zero
    out[out < 0] = sampled
    return out


def least_documents(pieces: list[bytes], docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the windows of each piece in turn, the least document of all pieces that hold the window."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + bytes(8), np.uint8)
    s = text[:-8].astype(np.int64) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    s[starts[1:] - 1] = 1  # between pieces: below any byte
    windows = sizes - length + 1
    into = np.full(len(s), -1)  # from the start of a window to its number
    owner = np.repeat(np.arange(len(pieces)), windows)
    first = np.cumsum(windows) - windows
    into[np.arange(len(owner)) + (starts - first)[owner]] = np.arange(len(owner))
    order = suffix_order(s, length)
    number = into[order]
    order, number = order[number >= 0], number[number >= 0]
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    same = np.ones(len(order) - 1, bool)
    for step in [*range(0, length - 8, 8), length - 8]:
        w = np.ascontiguousarray(words[order + step]).view(np.uint64)[:, 0]
        same &= w[1:] == w[:-1]
    run = np.flatnonzero(np.append(True, ~same))
    least = np.empty(len(owner), np.int64)
    least[number] = np.repeat(np.minimum.reduceat(docs[owner[number]], run), np.diff(np.append(run, len(order))))
    return least


# ---------------------------------------------------------------- phrases of a text


def gram_hashes(text: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of all k-byte grams, by doubling."""
    h, size, mult = text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(12345), 1, _B
    out, done = None, 0
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                if out is None:
                    out, done = h, size
                else:
                    n = len(text) - done - size + 1
                    out, done = out[:n] * mult + h[done : done + n], done + size
            k >>= 1
            if k:
                n = len(h) - size
                h, size, mult = h[:n] * mult + h[size : size + n], 2 * size, mult * mult
    return blobs.mix64(out)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w neighbours."""
    size = 1
    while 2 * size <= w:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def phrases(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of the phrases of a text of LENGTH bytes at least, STRETCH windows at a time."""
    if len(raw) < STRETCH + LENGTH:
        return _phrases(raw)
    parts = [(k, _phrases(raw[k : k + STRETCH + LENGTH - 1])) for k in range(0, len(raw) - LENGTH + 1, STRETCH)]
    return np.concatenate([p[0] for _, p in parts]), np.concatenate([p[1] + k for k, p in parts]), np.concatenate([p[2] for _, p in parts])


def _phrases(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = _least(gram_hashes(np.frombuffer(raw, np.uint8)), LENGTH - GRAM + 1)
    start = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    count = np.diff(np.append(start, len(m)))
    if count.max() > LONGEST:  # long runs of one key are cut; their parts are phrases of that key
        parts = -(-count // LONGEST)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + inside * LONGEST, np.minimum(np.repeat(count, parts) - inside * LONGEST, LONGEST)
    return m[start] & _K_MASK, start, count


# ---------------------------------------------------------------- the distributed plan


def _group_of(doc: np.ndarray, mark: np.ndarray, groups: int) -> np.ndarray:
    return (blobs.mix64(doc.astype(np.uint64) ^ (mark.astype(np.uint64) << np.uint64(32))) % np.uint64(groups)).astype(np.int64)


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys: what is sorted by key is sorted by bucket."""
    return ((key >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    if len(order):
        for part in np.split(order, np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1):
            yield int(keys[part[0]]), part


def _steps(x: np.ndarray, width: int) -> np.ndarray:
    """Integers as differences, plane by plane; they may go down too."""
    return blobs.planes(np.diff(x.astype(np.int64), prepend=0), width)


def _sums(b: np.ndarray, width: int) -> np.ndarray:
    return (np.cumsum(blobs.from_planes(b, width), dtype=np.uint64) & np.uint64((1 << 8 * width) - 1)).view(np.int64)


def _starts(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a new value begins in one of the columns."""
    new = np.zeros(max(len(x) - 1, 0), bool)
    for c in (x, *more):
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new)) if len(x) else np.zeros(0, np.int64)


def _keys_of_texts(groups: int, buckets: int):
    """Texts -> the keys of their phrases by group, for the keys' buckets (kind 0)."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, size = np.concatenate([h[0] for h in held]), [len(h[0]) for h in held]
        doc = np.array([h[1] for h in held], np.int64)
        group = np.repeat(_group_of(doc, np.array([h[2] for h in held], np.uint32), groups), size)
        doc = np.repeat(doc, size)
        order = np.lexsort((group, key))
        key, group, doc = key[order], group[order], doc[order]
        first = _starts(key, group)
        n = np.diff(np.append(first, len(key)))
        several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
        key, group = key[first], group[first]
        bucket = _bucket_of(key, buckets)
        cuts = _starts(bucket)
        made = []
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            made.append((int(bucket[a]), 0, blobs.pack(_steps(key[a:b], 6), blobs.planes(group[a:b], 4), blobs.planes(np.minimum(n[a:b], 65_535), 2), several[a:b].astype(np.uint8))))
        yield blobs.rows(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if doc.is_valid and len(raw) >= LENGTH:
                    held.append((phrases(raw)[0], doc.as_py(), crc32(raw)))
                    size += len(raw)
                    if size >= CHUNK_BYTES:
                        yield from flush(held)
                        held, size = [], 0
        yield from flush(held)

    return run


def _judge_keys(most: int):
    """All keys of a bucket -> those of several documents, for the groups that have them (kind 1)."""

    def fn(_: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        asked = [blobs.unpack(blob, *[np.uint8] * 4) for blob in held.pop(0)]
        key = np.concatenate([_sums(a[0], 6) for a in asked])
        group = np.concatenate([blobs.from_planes(a[1], 4).astype(np.int32) for a in asked])
        n = np.concatenate([blobs.from_planes(a[2], 2).astype(np.int32) for a in asked])
        several = np.concatenate([a[3] for a in asked])
        del asked
        order = np.argsort(key)
        key, group, n, several = key[order], group[order], n[order], several[order]
        first = _starts(key)
        entries = np.diff(np.append(first, len(key)))
        wanted = np.repeat((entries > 1) | (np.maximum.reduceat(several, first) > 0), entries)
        hot = np.repeat(np.add.reduceat(n.astype(np.int64), first) > most, entries)
        key, group, hot = key[wanted], group[wanted], hot[wanted]
        order = np.lexsort((key, group))
        order = order[_starts(key[order], group[order])]  # one group's texts may come from several tasks
        key, group, hot = key[order], group[order], hot[order]
        for g, part in _by(group):
            yield blobs.rows([(g, 1, blobs.pack(_steps(key[part], 6), hot[part].astype(np.uint8)))])

    return fn


def _marks(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = [(t.as_py() or "").encode() for t in batch.column("text")]
    ids = batch.column("doc_id").cast(pa.int64())
    return raw, np.array([i if i is not None else -1 for i in ids.to_pylist()], np.int64), np.array([crc32(r) for r in raw], np.uint32)


def _documents(batches: list[pa.RecordBatch]) -> list[tuple[int, bytes]]:
    """The different (id, text) of a group with LENGTH bytes or more, in order: the numbers that stand for them."""
    found = set()
    for batch in batches:
        for i, t in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist(), strict=True):
            if i is not None and t and len(raw := t.encode()) >= LENGTH:
                found.add((i, raw))
    return sorted(found)


def _ask(buckets: int):
    """Texts of a group and the keys to look at -> its different phrases for their shards (kind 2); where they stand in its documents (kind 4, for the group itself)."""

    def fn(g: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if 0 not in held or 1 not in held:
            return
        told = [blobs.unpack(blob, np.uint8, np.uint8) for blob in held.pop(1)]
        key, hot = np.concatenate([_sums(k, 6) for k, _ in told]), np.concatenate([h for _, h in told])
        order = np.argsort(key)
        key, hot = key[order].view(np.uint64), hot[order]
        docs = _documents([blobs.unpack_rows(blob) for blob in held.pop(0)])
        entry: dict[bytes, int] = {}
        keys, doc, pos, which = [], [], [], []
        for j, (_, raw) in enumerate(docs):
            own, start, count = phrases(raw)
            at = np.searchsorted(key, own).clip(max=len(key) - 1)
            look = np.flatnonzero(key[at] == own)
            if not len(look):
                continue
            own, start, count, apart = own[look], start[look], count[look], hot[at[look]] > 0
            if apart.any():  # one window a phrase, keyed by its own hash
                times = np.where(apart, count, 1)
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own, start, count, apart = (np.repeat(x, times) for x in (own, start, count, apart))
                start, count = np.where(apart, start + inside, start), np.where(apart, 1, count)
                own[apart] = np.array([xxhash.xxh64_intdigest(raw[k : k + LENGTH]) for k in start[apart].tolist()], np.uint64) & _K_MASK
            for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True):
                which.append(entry.setdefault(raw[a:b], len(entry)))
            keys.append(own)
            pos.append(start)
            doc.append(np.full(len(start), j))
        if not which:
            return
        which, pos, doc, keys = np.array(which), np.concatenate(pos), np.concatenate(doc), np.concatenate(keys)
        yield blobs.rows([(g, 4, blobs.pack(_steps(doc, 4), _steps(pos, 4), _steps(which, 4)))])
        first = _starts(np.maximum.accumulate(which))  # phrases are numbered as they come
        last = np.zeros(len(first), np.int64)
        last[which] = doc
        ids = np.array([i for i, _ in docs], np.int64)
        least, key = ids[doc[first]], keys[first]
        several, pieces = ids[last] != least, list(entry)
        for b, part in _by(_bucket_of(key, buckets)):
            own = [pieces[k] for k in part.tolist()]
            size = np.array([len(p) for p in own])
            columns = _steps(part, 4), blobs.planes(key[part], 6), _steps(least[part], 8), several[part].astype(np.uint8), blobs.planes(size, 2)
            yield blobs.rows([(b, 2, blobs.pack(np.array([g], np.int64), *columns, np.frombuffer(b"".join(own), np.uint8), level=3))])

    return fn


def _sort_shards(g: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Phrases of a bucket of keys -> the least documents of their windows, in runs, for the groups that asked (kind 3).

    What a group keeps for itself (kind 4) passes through.
    """
    for blob in held.pop(4, []):
        yield blobs.rows([(g, 4, blob)])
    pieces: list[bytes] = []
    columns: list[tuple] = []
    for blob in held.pop(2, []):
        asker, number, key, least, several, size, raw = blobs.unpack(blob, np.int64, *[np.uint8] * 6)
        ends = np.cumsum(blobs.from_planes(size, 2).astype(np.int64))
        raw = raw.tobytes()
        pieces += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        columns.append((np.full(len(ends), asker[0]), _sums(number, 4), blobs.from_planes(key, 6), _sums(least, 8), several))
    if not pieces:
        return
    group, number, key, least, several = (np.concatenate([c[k] for c in columns]) for k in range(5))
    order = np.argsort(key, kind="stable")
    upto = np.cumsum([len(pieces[k]) for k in order])
    keys = _starts(key[order])
    # Shards: whole keys, SHARD bytes or a little more of them.
    part = np.append(0, upto)[keys] // SHARD
    cuts = keys[_starts(part)]
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        own, seen = order[a:b], {}
        which = np.array([seen.setdefault(pieces[k], len(seen)) for k in own.tolist()])
        docs = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(docs, which, least[own])
        windows = np.array([len(p) for p in seen]) - LENGTH + 1
        found = least_documents(list(seen), docs)
        holder = np.repeat(np.arange(len(seen)), windows)
        run = _starts(found, holder)
        count, run_of = np.diff(np.append(run, len(found))), holder[run]
        offset = run - (np.cumsum(windows) - windows)[run_of]
        first = np.searchsorted(run_of, np.arange(len(seen) + 1))
        times = np.diff(first)[which]
        at = np.repeat(own, times)
        r = np.arange(len(at)) + np.repeat(first[which] - np.cumsum(times) + times, times)
        tell = (found[run[r]] < least[at]) | (several[at] > 0)
        at, r = at[tell], r[tell]
        out.append((group[at], number[at], offset[r], count[r], found[run[r]]))
    group, number, offset, count, found = (np.concatenate([o[k] for o in out]) for k in range(5))
    for to, at in _by(group):
        at = at[np.lexsort((offset[at], number[at]))]
        yield blobs.rows([(to, 3, blobs.pack(_steps(number[at], 4), blobs.planes(offset[at], 2), blobs.planes(count[at], 2), _steps(found[at], 8)))])


def _covered(start: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    order = np.argsort(start, kind="stable")
    a = start[order]
    b = np.maximum.accumulate(a + count[order] + LENGTH - 1)
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    ends = b[np.append(first[1:], len(a)) - 1]
    return list(zip(a[first].tolist(), ends.tolist(), strict=True))


def _repeats(held: dict[int, list[bytes]], docs: list[tuple[int, bytes]]) -> dict[tuple[int, bytes], list[tuple[int, int]]]:
    """The byte runs to remove of a group's documents, from where its phrases stand and the least documents of their windows."""
    if 3 not in held:
        return {}
    doc, pos, which = (_sums(x, 4) for x in blobs.unpack(held[4][0], *[np.uint8] * 3))
    told = [blobs.unpack(blob, *[np.uint8] * 4) for blob in held[3]]
    number, found = np.concatenate([_sums(t[0], 4) for t in told]), np.concatenate([_sums(t[3], 8) for t in told])
    offset, count = (np.concatenate([blobs.from_planes(t[k], 2).astype(np.int64) for t in told]) for k in (1, 2))
    order = np.argsort(number, kind="stable")
    number, found, offset, count = number[order], found[order], offset[order], count[order]
    low = np.searchsorted(number, which)
    times = np.searchsorted(number, which, "right") - low
    at = np.repeat(np.arange(len(which)), times)
    r = np.arange(len(at)) + np.repeat(low - np.cumsum(times) + times, times)
    goes = found[r] < np.array([i for i, _ in docs], np.int64)[doc[at]]
    at, r = at[goes], r[goes]
    start, count, doc = pos[at] + offset[r], count[r], doc[at]
    if not len(doc):
        return {}
    cuts = _starts(doc)
    return {docs[doc[a]]: _covered(start[a:b], count[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True)}


def _finish(make):
    """Texts and what is known of their phrases -> make(batch, raw texts, runs of each)."""

    def fn(_: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        batches = [blobs.unpack_rows(blob) for blob in held.pop(0, [])]
        gone = _repeats(held, _documents(batches)) if batches and 3 in held else {}
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            yield make(batch, raw, [gone.get((i, t), []) for i, t in zip(ids, raw, strict=True)])

    return fn


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _solve(docs: DataFrame, make, schema, hot: int = HOT) -> DataFrame:
    spark = docs.sparkSession
    width = shuffle_width(spark)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups = max(min(2 * width, -(-total // LEAST_GROUP_BYTES)), -(-total // GROUP_BYTES), 1)
    parts = -(-groups // 2)
    thin = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    keys = mapped(thin, _keys_of_texts(groups, parts), blobs.DDL)
    wanted = checkpointed(blobs.by_key(keys, parts, _judge_keys(hot), blobs.DDL))
    release(spark)  # the shuffle behind the checkpoint need not wait for the end
    key_of = lambda batch: _group_of(*_marks(batch)[1:], groups)
    asked = blobs.by_key(blobs.packed_rows(thin, key_of).union(wanted), groups, _ask(parts), blobs.DDL)
    told = blobs.by_key(asked, groups, _sort_shards, blobs.DDL)
    return blobs.by_key(blobs.packed_rows(docs, key_of).union(told), groups, _finish(make), schema)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def make(batch: pa.RecordBatch, raw: list[bytes], runs: list) -> pa.RecordBatch:
        sha = [hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(raw, runs, strict=True)]
        removed = [sum(b - a for a, b in r) for r in runs]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    thin = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return _solve(thin, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text (n_chars follows, where there is one); rows and columns stay."""

    def make(batch: pa.RecordBatch, raw: list[bytes], runs: list) -> pa.RecordBatch:
        texts = [kept_bytes(t, r).decode("utf-8", "ignore") if r else None for t, r in zip(raw, runs, strict=True)]
        cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        old = cols["text"].to_pylist()
        cols["text"] = pa.array([o if new is None else new for o, new in zip(old, texts, strict=True)], pa.string())
        if "n_chars" in cols:
            was = cols["n_chars"].to_pylist()
            cols["n_chars"] = pa.array([w if new is None else len(new) for w, new in zip(was, texts, strict=True)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return _solve(docs, make, schema)
