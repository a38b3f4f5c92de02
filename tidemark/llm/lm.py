"""LM scoring: a hierarchical Pitman-Yor bigram model whose seating is sampled by Gibbs.

One restaurant for each context (the word before, or the start of a text); all share one parent, the root
restaurant of words, whose own base is uniform over the vocabulary and one unknown word. Customers of a
context restaurant are the training tokens after that context; each of its tables sends one customer to
the root. Sampling starts with one table a dish and goes in turn: the root is seated given the contexts'
tables, then the contexts given the root's predictive probabilities, and so on. Of the ROUNDS rounds the
last SAMPLES are kept, each with the root seated for it. A token's probability is the mean over samples of
    (c_uw - d t_uw + (h + d T_u) P0(w)) / (h + C_u),   P0(w) = (c_w - d0 t_w + (h + d0 T0) / (V + 1)) / (h + C0)
and a text's score the sum of its log10. Discounts come from counts of counts, n1 / (n1 + 2 n2): d of the
pairs, d0 of the root's customers in the round before (0.5 in the first); the strength h is 1.

Seating one restaurant: all customers of a dish leave and are seated again, one by one (from the 64th on in
batches of a sixteenth of those seated), given the tables of all other dishes as of the round before, so
dishes and contexts are seated in parallel. Totals over all buckets, such as the tables of the root and of
contexts that are dealt out over buckets, are exact as of the round before.

Plan: texts go to groups by a hash. A group sends its distinct words and pairs with their training counts to
buckets, by word and by context. Words are told apart by 64-bit hashes, in pairs by 48 bits of them; nothing
compares their letters, so at some 10^7 words a pair of them may count as one. Buckets sum over all groups.
Pairs seen once have one table for good, so only the others (with the base of their words) are carried from
round to round, in a table in the shared folder that replaces the one before. Pairs of a context are
together, but for contexts with over 1 / HEAVY of all tokens (fewer than HEAVY), whose pairs are dealt out by
the pair. In the end buckets answer the groups in the order of their requests, and groups score their texts.

Defined cases: null text is empty and has the end token alone; a null id counts as not held out; without
training tokens every count is 0 and a token's probability is 1 / (V + 1) = 1; repeated rows are learned
as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import Shelf, checkpointed, mapped, release, shuffle_width
from .suffixes import _by, _group_of, _marks, _steps, _sums

ROUNDS, SAMPLES = 5, 3
STRENGTH = 1.0
HEAVY = 512
GROUP_BYTES, LEAST_GROUP_BYTES = 16_000_000, 2_000_000
END, START = 1, 2

#: Kinds of blobs: who sends what to whom.
TEXTS, PAIRS, WORDS = 0, 1, 2  # to groups; from groups to buckets
COUNTS, TABLES, WORD_COUNTS, ROOTS = 3, 4, 5, 6  # answers to groups
FIXED, SEATS, ASKERS = 7, 8, 9  # what a bucket of pairs keeps: for good, for a round, for its answers
VOCABULARY, ONCE, DISHES, SENT = 10, 11, 12, 13  # what a bucket of words has: its words, customers of pairs seen once, dishes of the others, their tables
ROOT_SEATS, BASES, KEPT = 14, 15, 16  # the root's tables; what contexts need of them; samples
TALLY, WORD_ASKERS = 17, 18  # numbers to be summed over all buckets; what a bucket of words keeps for its answers


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, sorted; all tokens as places among them, END behind each text; tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # none before a leading space
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    ends = upto[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))]
    coded = flat.filter(real).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    words, place = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
    place, sizes = place.astype(np.int32), np.diff(ends) + 1
    tok = np.full(int(sizes.sum()), place[-1], np.int32)
    own = np.ones(len(tok), bool)
    own[np.cumsum(sizes) - 1] = False
    tok[own] = place[coded.indices.to_numpy()]
    return words, tok, sizes


def _planes(x: np.ndarray) -> np.ndarray:
    """Sorted integers as differences, byte by byte: what compresses well."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).ravel()


def _unplanes(b: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(b.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _bytewise(x: np.ndarray) -> np.ndarray:
    """Small integers byte by byte: the high bytes are all zero and cost nothing compressed."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def _integers(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.reshape(4, -1).T).view(np.uint32).ravel()


def _word_bucket(short: np.ndarray, buckets: int) -> np.ndarray:
    return (blobs.mix64(short) % np.uint64(buckets)).astype(np.int64)


class Group:
    """The tokens of one group of texts: distinct words and pairs, in an order that only depends on the texts."""

    def __init__(self, texts: pa.Array, train: np.ndarray, buckets: int, heavy: np.ndarray):
        self.words, word, self.sizes = _tokens(texts)
        n = len(self.words)
        key = np.empty(len(word), np.int64)
        key[1:] = word[:-1]
        key[np.cumsum(self.sizes) - self.sizes] = n  # the start of a text
        self.word_at = word
        key *= n + 1
        key += word
        pair, at = np.unique(key, return_inverse=True)
        self.pair_at = at.astype(np.int32)
        del key, at
        self.left, self.right = (pair // (n + 1)).astype(np.int32), (pair % (n + 1)).astype(np.int32)
        del pair
        learned = np.repeat(train, self.sizes)
        self.count = np.bincount(self.pair_at[learned], minlength=len(self.left)).astype(np.int32)
        self.word_count = np.bincount(word[learned], minlength=n)
        self.short = np.append(self.words >> np.uint64(16), np.uint64(START))
        u, w = self.short[self.left], self.short[self.right]
        spread = np.isin(u, heavy)
        route = np.where(spread, blobs.mix64(u ^ blobs.mix64(w)), blobs.mix64(u))
        self.pair_bucket = (route % np.uint64(buckets)).astype(np.int32)
        self.word_bucket = _word_bucket(self.short[:-1], buckets)


def _texts(packed: list[bytes]) -> tuple[pa.Array, list, np.ndarray]:
    """Texts, ids and whether each is learned from, in an order that is not chance."""
    rows = pa.Table.from_batches([blobs.unpack_rows(b) for b in sorted(packed, key=lambda b: (len(b), b))])
    ids = rows.column("doc_id").to_pylist()
    return pc.fill_null(rows.column("text"), "").combine_chunks(), ids, np.array([not held_out(i) for i in ids], bool)


def seat(c: np.ndarray, base: np.ndarray, rest: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers: all are seated anew, given `rest` tables of other dishes in the restaurant."""
    order = np.argsort(-c, kind="stable")
    c, base, rest = c[order], base[order], rest[order]
    t = np.ones(len(c))
    i = 1
    while len(c) and (n := int(np.searchsorted(-c, -i, "left"))):  # dishes with more than i customers
        step = 1 if i < 64 else i // 16
        fresh = (strength + discount * (rest[:n] + t[:n])) * base[:n]
        p = fresh / (fresh + np.maximum(i - discount * t[:n], 1e-9))
        if step == 1:
            t[:n] += rng.random(n) < p
        else:
            t[:n] += rng.binomial(np.minimum(step, c[:n] - i).astype(np.int64), np.minimum(p, 1.0))
        i += step
    out = np.empty(len(c))
    out[order] = t
    return out


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 and n2 else 0.5


def predictive(customers, tables, base, all_customers, all_tables, discount: float):
    """Probability of a dish with so many customers and tables, in a restaurant with so many of each in all."""
    return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * all_tables) * base) / (STRENGTH + all_customers)


def _in_parts(made: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(made), 64):
        yield blobs.rows(made[k : k + 64])


def _ask(buckets: int, heavy: np.ndarray):
    """Texts of a group -> its words and pairs with their training counts, for their buckets."""

    def fn(g: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        texts, _, train = _texts(held[TEXTS])
        own, me = Group(texts, train, buckets, heavy), np.array([g], np.int64)
        yield from _in_parts([(b, WORDS, blobs.pack(me, _planes(own.words[at]), _bytewise(own.word_count[at]))) for b, at in _by(own.word_bucket)])
        out = []
        for b, at in _by(own.pair_bucket):
            u = own.short[own.left[at]]
            first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            runs = np.diff(np.append(first, len(u)))
            used, place = np.unique(own.right[at], return_inverse=True)
            # START sorts behind all words of the group: its hash is small, so differences wrap around, which is harmless.
            out.append((b, PAIRS, blobs.pack(me, _planes(u[first]), _bytewise(runs), _planes(own.short[used]), _bytewise(place), _bytewise(own.count[at]))))
            if len(out) == 64:
                yield blobs.rows(out)
                out = []
        if out:
            yield blobs.rows(out)

    return fn


def _tally(places: list[int] | np.ndarray, numbers: list[int] | np.ndarray) -> bytes:
    return blobs.pack(np.asarray(places, np.int64), np.asarray(numbers, np.int64))


def _start(buckets: int, heavy: np.ndarray):
    """What groups ask of a bucket -> counts for them, and what the bucket keeps; one table a dish.

    Tally: training tokens, known words, pairs seen once and twice, then for heavy contexts the tables of pairs
    seen once, then those of the others.
    """

    def words(b: int, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        asked = []
        for blob in packed:
            me, w, c = blobs.unpack(blob, np.int64, np.uint8, np.uint8)
            asked.append((int(me[0]), _unplanes(w), _integers(c)))
        if not asked:
            return
        word, back = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        c = np.bincount(back, np.concatenate([a[2] for a in asked]), len(word)).astype(np.int64)
        at, made = 0, [(b, VOCABULARY, blobs.pack(_planes(word))), (b, TALLY, _tally([0, 1], [c.sum(), (c > 0).sum()]))]
        for g, own, _ in asked:
            here = back[at : at + len(own)]
            at += len(own)
            made.append((g, WORD_COUNTS, blobs.pack(np.array([b], np.int64), _bytewise(c[here]))))
            made.append((b, WORD_ASKERS, blobs.pack(np.array([g], np.int64), _steps(here, 4))))
        yield from _in_parts(made)

    def pairs(b: int, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        asked = []
        for blob in packed:
            me, u, runs, w, place, c = blobs.unpack(blob, np.int64, *[np.uint8] * 5)
            asked.append((int(me[0]), _unplanes(u), _integers(runs), _unplanes(w)[_integers(place)], _integers(c)))
        if not asked:
            return
        u, w = np.concatenate([np.repeat(a[1], a[2]) for a in asked]), np.concatenate([a[3] for a in asked])
        order = np.lexsort((w, u))
        new_u = np.append(True, u[order][1:] != u[order][:-1])
        first = np.flatnonzero(new_u | np.append(True, w[order][1:] != w[order][:-1]))
        back = np.empty(len(u), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        c = np.add.reduceat(np.concatenate([a[4] for a in asked]).astype(np.int64)[order], first)
        restaurant = (np.cumsum(new_u) - 1)[first]
        u, w = u[order][first], w[order][first]
        del order, new_u, first
        n_u = int(restaurant[-1]) + 1
        own_u = u[np.append(True, restaurant[1:] != restaurant[:-1])]
        alone, many = np.bincount(restaurant[c == 1], minlength=n_u), np.flatnonzero(c > 1)
        more = np.bincount(restaurant[many], minlength=n_u)
        stay = np.flatnonzero(more)  # restaurants that are seated each round
        number, hot = np.cumsum(more > 0) - 1, np.searchsorted(heavy, own_u).clip(max=len(heavy) - 1)
        is_hot = heavy[hot] == own_u
        dish, dish_of = np.unique(w[many], return_inverse=True)
        made = [(b, FIXED, blobs.pack(_bytewise(alone[stay]), _bytewise(np.where(is_hot, hot + 1, 0)[stay]), _bytewise(more[stay]), _planes(dish), _bytewise(dish_of), _bytewise(c[many])))]
        single, times = np.unique(w[c == 1], return_counts=True)
        made += [(to, ONCE, blobs.pack(_planes(single[at]), _bytewise(times[at]))) for to, at in _by(_word_bucket(single, buckets))]
        tables = np.bincount(dish_of, minlength=len(dish))
        for to, at in _by(_word_bucket(dish, buckets)):
            me = np.array([b], np.int64)
            made += [(to, DISHES, blobs.pack(me, _planes(dish[at]))), (to, SENT, blobs.pack(me, _bytewise(tables[at])))]
        hot_here = np.flatnonzero(is_hot)
        places = [2, 3, *(4 + hot[hot_here]), *(4 + len(heavy) + hot[hot_here])]
        made.append((b, TALLY, _tally(places, [(c == 1).sum(), (c == 2).sum(), *alone[hot_here], *more[hot_here]])))
        yield from _in_parts(made)
        at, code, many_number = 0, alone * 2 + (more > 0), np.cumsum(c > 1) - 1
        for g, _, runs, own, _ in asked:
            here = back[at : at + len(own)]
            at += len(own)
            contexts = restaurant[here[np.cumsum(runs) - runs]]
            yield blobs.rows([
                (g, COUNTS, blobs.pack(np.array([b], np.int64), _bytewise(c[here]), _bytewise(code[contexts]))),
                (b, ASKERS, blobs.pack(np.array([g], np.int64), _steps(many_number[here[c[here] > 1]], 4), _steps(number[contexts[more[contexts] > 0]], 4))),
            ])

    def fn(b: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        yield from words(b, held.pop(WORDS, []))
        yield from pairs(b, held.pop(PAIRS, []))

    return fn


@dataclass(frozen=True)
class Root:
    """The root as of a round: its discount, customers and tables over all buckets, and the vocabulary."""

    discount: float
    customers: int
    tables: int
    words: int

    def base(self, rest: np.ndarray) -> np.ndarray:
        """Predictive probabilities of words with `rest` = customers less discounted tables."""
        return (rest + (STRENGTH + self.discount * self.tables) / (self.words + 1)) / (STRENGTH + self.customers)


def _seat_root(buckets: int, r: int, discount: float, words: int, before: Root | None):
    """Customers that the contexts send to a bucket of words, and its tables -> new tables, and what contexts need of them.

    Tally: customers, tables, words with one customer and with two. Samples are kept in the last rounds.
    """

    def fn(b: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        asked = {int(me[0]): _unplanes(w) for me, w in (blobs.unpack(x, np.int64, np.uint8) for x in held.get(DISHES, []))}
        sent = {int(me[0]): _integers(n) for me, n in (blobs.unpack(x, np.int64, np.uint8) for x in held.get(SENT, []))}
        once = [(_unplanes(w), _integers(n)) for w, n in (blobs.unpack(x, np.uint8, np.uint8) for x in held.get(ONCE, []))]
        senders = sorted(asked)
        if not senders and not once:
            return
        dish, at = np.unique(np.concatenate([*[o[0] for o in once], *[asked[s] for s in senders]]), return_inverse=True)
        own = np.bincount(at, np.concatenate([*[o[1] for o in once], *[sent[s] for s in senders]]), len(dish)).astype(np.int64)
        t = np.minimum(own, 1).astype(np.float64)
        if ROOT_SEATS in held:
            t = np.minimum(_integers(blobs.unpack(held[ROOT_SEATS][0], np.uint8)[0]), own).astype(np.float64)
        elsewhere = t.sum() * (buckets - 1) if before is None else before.tables - t.sum()
        more, rng = np.flatnonzero(own > 1), np.random.default_rng([13, r, b])
        base = np.full(len(more), 1 / (words + 1))
        for _ in range(2 if before is None else 1):
            t[more] = seat(own[more].astype(np.float64), base, elsewhere + t.sum() - t[more], discount, STRENGTH, rng)
        made = [(b, ROOT_SEATS, blobs.pack(_bytewise(t))), (b, TALLY, _tally([0, 1, 2, 3], [own.sum(), t.sum(), (own == 1).sum(), (own == 2).sum()]))]
        if r > ROUNDS - SAMPLES:
            made.append((b, KEPT, blobs.pack(np.array([r], np.int64), _planes(dish), _bytewise(own), _bytewise(t))))
        rest, k = (own - discount * t).astype(np.float32), sum(len(o[0]) for o in once)
        for s in senders if r < ROUNDS else []:
            made.append((s, BASES, blobs.pack(np.array([b], np.int64), rest[at[k : k + len(asked[s])]])))
            k += len(asked[s])
        yield from _in_parts(made)

    return fn


def _seat_contexts(buckets: int, r: int, discount: float, root: Root, hot_tables: np.ndarray):
    """A bucket's pairs, their tables and the root's bases -> new tables, customers for the root; answers in the last round.

    hot_tables: tables of the heavy contexts over all buckets. Tally: their tables of pairs seen more than once.
    """

    def fn(b: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if FIXED not in held:
            return
        alone, hot, runs, dish, dish_of, c = blobs.unpack(held[FIXED][0], *[np.uint8] * 6)
        alone, hot, runs, dish, dish_of, c = _integers(alone).astype(np.int64), _integers(hot).astype(np.int64), _integers(runs), _unplanes(dish), _integers(dish_of), _integers(c)
        samples: list[np.ndarray] = []
        t = np.ones(len(c))
        if SEATS in held:
            first, *samples = [_integers(x) for x in blobs.unpack(held[SEATS][0], *[np.uint8] * (1 + max(0, r - 1 - ROUNDS + SAMPLES)))]
            t = first.astype(np.float64)
        parts, rest = dict(_by(_word_bucket(dish, buckets))), np.zeros(len(dish))
        for blob in held.get(BASES, []):
            me, x = blobs.unpack(blob, np.int64, np.float32)
            rest[parts[int(me[0])]] = x
        at = np.repeat(np.arange(len(runs)), runs)
        total = alone + np.bincount(at, t, len(runs))
        whole = np.where(hot > 0, hot_tables[np.maximum(hot - 1, 0)], total)
        t = seat(c.astype(np.float64), root.base(rest)[dish_of], whole[at] - t, discount, STRENGTH, np.random.default_rng([11, r, b]))
        if r > ROUNDS - SAMPLES:
            samples = [*samples, t.astype(np.int64)]
        tables, here = np.bincount(dish_of, t, len(dish)), np.flatnonzero(hot)
        made = [(to, SENT, blobs.pack(np.array([b], np.int64), _bytewise(tables[p]))) for to, p in parts.items()]
        made.append((b, TALLY, _tally(hot[here] - 1, np.bincount(at, t, len(runs))[here])))
        if r < ROUNDS:
            made.append((b, SEATS, blobs.pack(_bytewise(t), *map(_bytewise, samples))))
        yield from _in_parts(made)
        totals = [alone + np.bincount(at, s, len(runs)).astype(np.int64) for s in samples]
        for blob in held.get(ASKERS, []):
            g, asked, contexts = blobs.unpack(blob, np.int64, np.uint8, np.uint8)
            asked, contexts = _sums(asked, 4), _sums(contexts, 4)
            yield blobs.rows([(int(g[0]), TABLES, blobs.pack(np.array([b], np.int64), *[_bytewise(s[asked]) for s in samples], *[_bytewise(x[contexts]) for x in totals]))])

    return fn


def _answer_words(b: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """A bucket's words and the samples of the root -> customers and tables of the words that each group asked for."""
    if VOCABULARY not in held:
        return
    short = _unplanes(blobs.unpack(held[VOCABULARY][0], np.uint8)[0]) >> np.uint64(16)
    columns = []
    for _, dish, own, t in sorted(((int(x[0][0]), *x[1:]) for x in (blobs.unpack(blob, np.int64, *[np.uint8] * 3) for blob in held.get(KEPT, []))), key=lambda x: x[0]):
        dish = _unplanes(dish)
        place = np.searchsorted(dish, short).clip(max=len(dish) - 1)
        columns += [np.where(dish[place] == short, _integers(x)[place], 0) for x in (own, t)]
    columns = columns or [np.zeros(len(short), np.int64)] * (2 * SAMPLES)
    for blob in held[WORD_ASKERS]:
        g, here = blobs.unpack(blob, np.int64, np.uint8)
        here = _sums(here, 4)
        yield blobs.rows([(int(g[0]), ROOTS, blobs.pack(np.array([b], np.int64), *[_bytewise(x[here]) for x in columns]))])


@dataclass(frozen=True)
class Model:
    """What scoring needs beside the answers: totals, and the root and the heavy contexts' tables of each sample."""

    tokens: int
    words: int
    discount: float
    roots: tuple[Root, ...]
    hot_tables: np.ndarray


def _score(buckets: int, heavy: np.ndarray, model: Model):
    """Texts and answers of a group -> one row a text."""

    def answers(packed: list[bytes], n: int) -> dict[int, list[np.ndarray]]:
        return {int(b[0]): [_integers(x) for x in got] for b, *got in (blobs.unpack(blob, np.int64, *[np.uint8] * n) for blob in packed)}

    def fn(_: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        texts, ids, train = _texts(held[TEXTS])
        own = Group(texts, train, buckets, heavy)
        n = len(own.words)
        c_word, root = np.zeros(n + 1), np.zeros((SAMPLES, n))
        counts, roots = answers(held.pop(WORD_COUNTS), 1), answers(held.pop(ROOTS), 2 * SAMPLES)
        for b, at in _by(own.word_bucket):
            c_word[at] = counts[b][0]
            for k, now in enumerate(model.roots):
                customers, tables = roots[b][2 * k : 2 * k + 2]
                root[k, at] = now.base(np.maximum(customers - now.discount * tables, 0))
        c_word[n] = c_word[np.searchsorted(own.words, np.uint64(END))] if n else 0  # texts start as often as they end
        counts, tables = answers(held.pop(COUNTS), 2), answers(held.pop(TABLES, []), 2 * SAMPLES)
        pairs = len(own.left)
        c, t, context = np.zeros(pairs), np.zeros((SAMPLES, pairs)), np.zeros((SAMPLES, n + 1))
        for b, at in _by(own.pair_bucket):
            c[at], code = counts[b]
            u = own.left[at]
            u = u[np.append(True, u[1:] != u[:-1])]
            many, seated, told = c[at] > 1, (code & 1) > 0, tables.get(b)
            for k in range(SAMPLES):
                t[k, at], context[k, u] = np.minimum(c[at], 1), code >> 1
                if told is not None:
                    t[k, at[many]], context[k, u[seated]] = told[k], told[SAMPLES + k]
        place = np.searchsorted(heavy, own.short).clip(max=len(heavy) - 1)
        spread = np.flatnonzero(heavy[place] == own.short)
        context[:, spread] = model.hot_tables[:, place[spread]]
        p = np.zeros(pairs)
        for k in range(SAMPLES):
            p += predictive(c, t[k], root[k][own.right], c_word[own.left], context[k][own.left], model.discount)
        del t, c
        starts = np.cumsum(own.sizes) - own.sizes
        score = np.add.reduceat(np.log10(p / SAMPLES)[own.pair_at], starts)
        base = np.add.reduceat(np.log10((c_word[:n] + 1) / (model.tokens + model.words + 1))[own.word_at], starts)
        known = np.add.reduceat((c_word[:n] > 0)[own.word_at].astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(~train, pa.bool_()), pa.array(own.sizes), pa.array(known), pa.array(np.full(len(ids), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(np.power(10.0, -score / own.sizes))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    return fn


def heavy_words(docs: DataFrame) -> np.ndarray:
    """Short hashes of the words with over 1 / HEAVY of all tokens (fewer than HEAVY), and of the text start.

    A batch reports what has over half that share of its own tokens, so a word near the border may be missed;
    that moves its pairs to other buckets and changes no count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, often = 0, Counter()
        for batch in batches:
            flat = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(0), ""))).flatten()
            seen = pc.value_counts(flat.filter(pc.not_equal(pc.binary_length(flat), 0)))
            n = seen.field("counts").to_numpy()
            total += int(n.sum())
            many = np.flatnonzero(n * 2 * HEAVY > n.sum())
            often.update(dict(zip(seen.field("values").take(pa.array(many)).to_pylist(), n[many].tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([0, *[xxhash.xxh64_intdigest(w.encode()) >> 16 for w in often]], pa.int64()), pa.array([total, *often.values()], pa.int64())], names=["w", "n"])

    sums = checkpointed(mapped(docs.select("text"), run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = sums.filter("w = 0").first()
    if total is None or not total["n"]:
        return np.array([START], np.uint64)
    found = sums.filter((F.col("w") != 0) & (F.col("n") * HEAVY > int(total["n"]))).select("w").collect()  # fewer than HEAVY rows
    return np.array(sorted([START, *[r["w"] for r in found]]), np.uint64)


def _summed(blobs_: DataFrame, size: int) -> np.ndarray:
    """The tallies of all buckets, summed by the executors: at most `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                at, n = blobs.unpack(blob, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for row in mapped(blobs_.select("blob"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(min(width, -(-total // LEAST_GROUP_BYTES)), -(-total // GROUP_BYTES), 1)
    heavy = heavy_words(docs)
    texts = blobs.packed_rows(docs, lambda batch: _group_of(*_marks(batch)[1:], groups), TEXTS)
    shelf = Shelf(spark, "lm")
    put = lambda name, df: shelf.put(name, df, "kind")  # noqa: E731  by kind, so that reading some kinds reads no others
    read = lambda name, *kinds: shelf.get(name, blobs.DDL).filter(F.col("kind").isin(*kinds))
    put("start", blobs.by_key(blobs.by_key(texts, groups, _ask(groups, heavy), blobs.DDL), groups, _start(groups, heavy), blobs.DDL))
    release(spark)
    tokens, words, n1, n2, *hot = _summed(read("start", TALLY), 4 + 2 * len(heavy)).tolist()
    hot_once, hot_more = np.array(hot[: len(heavy)]), np.array(hot[len(heavy) :])
    discount, root_discount, root = _discount(n1, n2), 0.5, None
    sent, roots, hot_tables = read("start", SENT), [], []
    for r in range(ROUNDS + 1):
        frame = read("start", ONCE, DISHES).union(sent)
        if r:
            frame = frame.union(read(f"root{r - 1}", ROOT_SEATS))
        put(f"root{r}", blobs.by_key(frame, groups, _seat_root(groups, r, root_discount, words, root), blobs.DDL))
        customers, tables, m1, m2 = _summed(read(f"root{r}", TALLY), 4).tolist()
        root, root_discount = Root(root_discount, customers, tables, words), _discount(m1, m2)
        if r > ROUNDS - SAMPLES:
            roots.append(root)
            hot_tables.append(hot_once + hot_more)
        if 0 < r <= ROUNDS - SAMPLES + 1:
            shelf.drop(f"root{r - 1}")
        if r == ROUNDS:
            break
        frame = read("start", FIXED, *([ASKERS] if r + 1 == ROUNDS else [])).union(read(f"root{r}", BASES))
        if r:
            frame = frame.union(read(f"contexts{r}", SEATS))
        put(f"contexts{r + 1}", blobs.by_key(frame, groups, _seat_contexts(groups, r + 1, discount, root, hot_once + hot_more), blobs.DDL))
        hot_more = _summed(read(f"contexts{r + 1}", TALLY), len(heavy))
        sent = read(f"contexts{r + 1}", SENT)
        if r:
            shelf.drop(f"contexts{r}")
    release(spark)  # of the rounds' shuffles, before texts are shuffled again
    samples = [read(f"root{r}", KEPT) for r in range(ROUNDS - SAMPLES + 1, ROUNDS + 1)]
    known = blobs.by_key(reduce(DataFrame.union, samples, read("start", VOCABULARY, WORD_ASKERS)), groups, _answer_words, blobs.DDL)
    model = Model(tokens, words, discount, tuple(roots), np.array(hot_tables))
    final = texts.union(read("start", COUNTS, WORD_COUNTS)).union(read(f"contexts{ROUNDS}", TABLES)).union(known)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return blobs.by_key(final, groups, _score(groups, heavy, model), ddl)
