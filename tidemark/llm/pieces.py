"""SentencePiece encoding with a merge-type prefix table, and decoding.

A BPE encoding of a text extends uniquely: for each prefix there is one last token, the token that
ends there, fits the last token of what stands before it (the pair is a stable one: merging the two
token strings gives just these two tokens back) and so continues that prefix's own encoding. The
table holds that last token for each prefix. Candidates come from an automaton over the vocabulary,
the pair test from the vocabulary's own merges, and the ids are read off backwards.

White space becomes U+2581 and one is put in front (the model's normaliser is the identity). A merge makes
a piece, so none crosses a border between characters that stand side by side in no piece. Characters that do
fall into classes (letters and signs, say), found from the vocabulary; no piece holds U+2581 after another
character. A run of one class with the U+2581 before it is therefore encoded on its own, a character of no
class alone, and frequent units are remembered. Pieces made of U+2581 alone all have the lowest score; they
merge last, leftmost first, which `_spaces` follows.
Characters outside the vocabulary fall back to one byte piece per UTF-8 byte and never merge.

Defined cases: null is the empty text, whose ids are the end id alone; texts of any length run in
time linear in their length; memory is bounded by the size of the memo.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import mapped, plus, slices

SPACE = "▁"
MEMO, PAIRS = 300_000, 500_000
LONGEST_MEMO = 48
STRETCH = 1 << 20
_CUT = re.compile("[^ ] ")


class Memo(dict):
    """Units, with spaces as they are -> (ids in decimal, the bytes that they stand for).

    Two generations of MEMO entries: what is still in use moves to the new one when the old one goes.
    """

    def __init__(self, table: PrefixTable):
        self.table, self.old = table, {}

    def __missing__(self, key: str) -> tuple[str, bytes]:
        value = self.old.get(key)
        if value is None:
            ids = self.table.unit(key.replace(" ", SPACE))
            value = " ".join(map(self.table.decimal.__getitem__, ids)), self.table._bytes(ids)
        if len(key) <= LONGEST_MEMO:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixTable:
    """The encoder of one model file. Build it once in each Python worker."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.end = model.eos_id()
        self.text = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.bytes_ids = {int(self.text[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.raw = [bytes([int(t[1:-1], 16)]) if model.is_byte(i) else b"" if special[i] else t.encode() for i, t in enumerate(self.text)]
        self.ids = {self.text[i]: i for i in range(n) if not special[i]}
        self.score = {t: model.get_score(i) for t, i in self.ids.items()}
        # Rank: the order in which merges are done. Single characters are not merges.
        merged = sorted((t for t in self.ids if len(t) > 1 and t.strip(SPACE)), key=lambda t: -self.score[t])
        self.rank = {self.ids[t]: k for k, t in enumerate(merged)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1:
                self.automaton.add_word(t, (1, i))
        for t in merged:
            parts, last = self._merge(t)
            if len(parts) == 1:  # others never come out of merging
                i = self.ids[t]
                self.halves[i], self.joined[last] = last, i
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.decimal = [str(i) for i in range(n)]
        self.units_of = _unit_pattern(self.ids).findall
        self.memo = Memo(self)

    def _merge(self, t: str) -> tuple[list[int], tuple[int, int]]:
        """Plain merging of a vocabulary string: its tokens, and the last pair merged."""
        parts, last = [self.ids.get(c, -1) for c in t], (-1, -1)
        names = list(t)
        while len(parts) > 1:
            best = min(((self.rank.get(self.ids.get(names[k] + names[k + 1], -1), 1 << 30), k) for k in range(len(parts) - 1)))
            if best[0] == 1 << 30:
                break
            k = best[1]
            last = (parts[k], parts[k + 1])
            names[k : k + 2] = [names[k] + names[k + 1]]
            parts[k : k + 2] = [self.ids[names[k]]]
        return parts, last

    def _stable(self, a: int, b: int) -> bool:
        """Whether merging the strings of a and b together gives a and b: no merge across their border comes first.

        Walks the border back in time: undo the later of the two tokens' last merges, and see whether what then
        stands on both sides would have merged before that.
        """
        x, y, before, ok = a, b, 1 << 31, True
        rank, halves, joined = self.rank, self.halves, self.joined
        while True:
            z = joined.get((x, y))
            # Merges of the same rank go from left to right: the border goes first against merges in y only.
            if z is not None and (rank[z] << 1) < before:
                ok = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                before, x = rx << 1, halves[x][1]
            else:
                before, y = (ry << 1) + 1, halves[y][0]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[a << 20 | b] = ok
        return ok

    def _word(self, t: str) -> list[int]:
        """Ids of a string with U+2581 at most in front; -1 - ordinal for characters outside the vocabulary."""
        n = len(t)
        last, size = [0] * n, [1] * n  # of each prefix: its last token, and that token's length
        known, at = self.pairs.get, -1
        k = done = 0  # the next prefix to solve; where the characters known since begin
        # Hits come by their end, the longest first; the first one that fits is the only one.
        for end, (width, i) in self.automaton.iter(t):
            if end < k:
                continue
            if end != at:
                if k == at:
                    raise AssertionError(f"no token ends at {k} of {t!r}")
                at = end
                while k < end:  # no hit ends there: a character outside the vocabulary
                    last[k] = -1 - ord(t[k])
                    k += 1
                    done = k
            start = end - width + 1
            if start > done:
                before = last[start - 1]
                ok = known(before << 20 | i)
                if ok is None:
                    ok = self._stable(before, i)
                if not ok:
                    continue
            elif start < done:
                continue
            last[end], size[end] = i, width
            k = end + 1
        if k == at:
            raise AssertionError(f"no token ends at {k} of {t!r}")
        while k < n:
            last[k] = -1 - ord(t[k])
            k += 1
        out, k = [], n - 1
        while k >= 0:
            out.append(last[k])
            k -= size[k]
        return out[::-1]

    def _spaces(self, n: int) -> list[int]:
        """Ids of a run of n U+2581: best score first, then leftmost."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < n and (t := SPACE * (size[k] + size[after[k]])) in self.score:
                heapq.heappush(heap, (-self.score[t], k, size[k], size[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if size[k] != a or after[k] >= n or size[after[k]] != b:
                continue
            gone = after[k]
            size[k], size[gone], after[k] = a + b, 0, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [self.ids[SPACE * s] for s in size if s]

    def unit(self, t: str) -> list[int]:
        body = t.lstrip(SPACE)
        lead = len(t) - len(body)
        if not body:
            ids = self._spaces(lead)
        else:
            ids = self._word(SPACE + body if lead else body)
            if lead and ids[0] == self.ids[SPACE]:
                ids = self._spaces(lead) + ids[1:]
            elif lead > 1:
                ids = self._spaces(lead - 1) + ids
        if min(ids) >= 0:
            return ids
        return [j for i in ids for j in ([i] if i >= 0 else [self.bytes_ids[b] for b in chr(-1 - i).encode()])]

    def coded(self, text: str | None) -> tuple[str, bytes]:
        """The ids of a text in decimal with the end id last, and the bytes that they stand for."""
        if not text:
            return str(self.end), b""
        text = " " + (text.replace(SPACE, " ") if SPACE in text else text)
        if len(text) <= STRETCH:
            ids, raw = zip(*map(self.memo.__getitem__, self.units_of(text)))
            return f"{' '.join(ids)} {self.end}", b"".join(raw)
        ids, raw, at = [], [], 0
        while at < len(text):  # a long text, some megabytes of units at a time: cut in front of a space that follows something else
            cut = _CUT.search(text, at + STRETCH)
            to = cut.start() + 1 if cut else len(text)
            i, r = zip(*map(self.memo.__getitem__, self.units_of(text, at, to)))
            ids.append(" ".join(i))
            raw.append(b"".join(r))
            at = to
        return f"{' '.join(ids)} {self.end}", b"".join(raw)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.coded(text)[0].split()]

    def _bytes(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: U+2581 to spaces without the one in front; control ids are silent."""
        return self.plain(self._bytes(ids))

    @staticmethod
    def plain(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def _unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Matches a unit of a text with spaces for U+2581: spaces and a run of one class of characters, or one other character."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for piece in pieces:
        body = piece.lstrip(SPACE)
        if SPACE in body:
            raise ValueError(f"a piece with U+2581 inside: {piece!r}")
        for a, b in pairwise(body):
            root[find(b)] = find(a)
    classes: dict[str, list[str]] = {}
    for c in root:
        classes.setdefault(find(c), []).append(c)
    runs = ["[" + "".join(map(re.escape, sorted(own))) + "]+" for own in sorted(classes.values(), key=len, reverse=True)]
    return re.compile("|".join([f" *(?:{'|'.join([*runs, '[^ ]'])})", " +"]))


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(model_file: str) -> PrefixTable:
    if model_file not in _TABLES:
        _TABLES[model_file] = PrefixTable(model_file)
    return _TABLES[model_file]


def encode_texts(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds the ids (array of int, end id last) and the text that they decode to; all other columns stay."""
    df = df.drop(ids_col, decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            got = [table.coded(x.as_py()) for x in batch.column(text_col)]
            ends = np.cumsum([0, *[g[0].count(" ") + 1 for g in got]])
            values = np.fromstring(" ".join([g[0] for g in got]), np.int32, sep=" ")
            extra = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), pa.array([table.plain(g[1]) for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, ids_col, decoded_col])

    return mapped(df, run, plus(df, **{ids_col: "array<int>", decoded_col: "string"}))


def piece_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text. One pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for batch in batches:
            n, ids, back = [], [], []
            for x in batch.column(1):
                text, raw = table.coded(x.as_py())
                n.append(text.count(" ") + 1)
                ids.append(hashlib.sha256(text.encode()).hexdigest())
                back.append(hashlib.sha256(table.plain(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return mapped(df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text"), run, ddl)
