"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read through the public ``sentencepiece`` library only for its vocabulary (pieces, scores, kinds).
Encoding itself is done here: the symbols of all new words of a batch lie in one flat numpy array; every round finds the
best pair of each word by a segmented minimum, merges it, and compacts the arrays, until no word has a pair left.

A text is first cut between characters that stand side by side in no piece, so that no merge could join them. In usual
vocabularies that cuts before each run of spaces and gives words. Words recur, so a worker keeps the results of the words
it has met (up to ``MEMO`` of them, then it starts anew); each distinct word still goes through the merge rounds.

Null texts count as empty: no ids, an empty decoded text. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
MEMO = 400_000
BATCH_WORDS = 40_000
NONE = np.int64(1) << 60


class Piecewise:
    """Encoder and decoder of one BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        if sp.normalize("ﬁ Å  x") != f"{SPACE}ﬁ{SPACE}Å{SPACE}{SPACE}x":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.n = n
        self.pieces = pieces
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.byte_set = frozenset(self.byte_of)
        self.unk = sp.unk_id()
        self.decimal = [str(i).encode() for i in range(n)]
        self.shown = [p.replace(SPACE, " ") if i != self.unk else " ⁇ " for i, p in enumerate(pieces)]
        known = {p: i for i, p in enumerate(pieces) if not special[i]}
        symbols = dict(known)
        for p in known:  # characters that are parts of pieces but not pieces themselves
            for ch in p:
                symbols.setdefault(ch, len(symbols) + n)
        self.symbols = symbols
        best = {i: rank for rank, i in enumerate(sorted(known.values(), key=lambda i: (-sp.get_score(i), i)))}
        keys, merged = [], []
        self.span = np.int64(max(symbols.values()) + 1)
        for p, i in known.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * int(self.span) + right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.rank = np.array([best[i] for i in merged], np.int64)[order]
        # A merge may be done at all places of a word at once unless its result could be part of a better pair.
        nearest = np.full(int(self.span), NONE, np.int64)
        np.minimum.at(nearest, self.keys // self.span, self.rank)
        np.minimum.at(nearest, self.keys % self.span, self.rank)
        rank_of = np.full(int(self.span), -1, np.int64)
        for i, r in best.items():
            rank_of[i] = r
        self.at_once = nearest > rank_of
        self.joined = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        self._only_leading_spaces = not any(b == SPACE and a != SPACE for a, b in self.joined)
        self._words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo: dict[str, tuple[bytes, int, str]] = {}

    def words(self, text: str) -> list[str]:
        """The parts of a text between which no merge is possible."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self._words.findall(text) if self._only_leading_spaces else [text]

    def _parts(self, word: str) -> list[str]:
        """A long word, cut again wherever two neighbours stand side by side in no piece."""
        if len(word) <= 32:
            return [word]
        cuts = [0, *(k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _pairs(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merges of the symbols at ``at`` with their right neighbours."""
        rank, to = np.full(len(at), NONE, np.int64), np.zeros(len(at), np.int64)
        left, right = flat[at], flat[at + 1]
        key = np.where((left >= 0) & (right >= 0), left * self.span + right, -1)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        rank[hit], to[hit] = self.rank[k[hit]], self.merged[k[hit]]
        return rank, to

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, one word after the other, and the number of each word's symbols."""
        lengths = np.array([len(w) for w in words], np.int64)
        get = self.symbols.get
        flat = np.fromiter([get(ch, -1) for ch in "".join(words)], np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        rank, to = np.full(len(flat), NONE, np.int64), np.zeros(len(flat), np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            rank[inside], to[inside] = self._pairs(flat, inside)
        ended_symbols, ended_owner = [], []
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(flat)])
            least = np.minimum.reduceat(rank, starts)
            ended = least == NONE
            if ended.any():
                keep = np.repeat(~ended, sizes)
                ended_symbols.append(flat[~keep])
                ended_owner.append(owner[~keep])
                flat, owner, rank, to, least, sizes = flat[keep], owner[keep], rank[keep], to[keep], least[~ended], sizes[~ended]
                if not len(flat):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # of a run of overlapping places every other one from the left; of a pair that could feed a better one only the first
            lead = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            fresh = lead | np.r_[True, np.diff(at) != 1]
            odd = (np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 1
            at = at[~odd & (lead | self.at_once[to[at]])]
            flat[at] = to[at]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat, owner, rank, to = flat[keep], owner[keep], rank[keep], to[keep]
            at -= np.arange(len(at))  # where the merged symbols are now
            near = np.unique(np.r_[at, at - 1])
            near = near[near >= 0]
            last = (near == len(flat) - 1) | (owner[near] != owner[np.minimum(near + 1, len(flat) - 1)])
            rank[near[last]] = NONE
            near = near[~last]
            rank[near], to[near] = self._pairs(flat, near)
        if not ended_owner:
            return np.empty(0, np.int64), lengths
        by = np.concatenate(ended_owner)
        return np.concatenate(ended_symbols)[np.argsort(by, kind="stable")], np.bincount(by, minlength=len(words))

    def _with_bytes(self, word: str, symbols: list[int]) -> list[int]:
        """Ids of a word some of whose characters have no piece and become their bytes."""
        ids, k = [], 0
        for s in symbols:
            if 0 <= s < self.n:
                ids.append(s)
                k += len(self.pieces[s])
            else:
                ids += [self.byte_ids[b] for b in word[k].encode()] if self.byte_ids else [self.unk]
                k += 1
        return ids

    def surface(self, ids: list[int]) -> str:
        """The text of a word's ids, spaces included."""
        if self.byte_set.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            out += [held.decode(errors="replace"), self.shown[i]]
            held = bytearray()
        return "".join(out) + held.decode(errors="replace")

    def learn(self, words: list[str]) -> None:
        """Runs the merge rounds over words that are not known yet."""
        for k in range(0, len(words), BATCH_WORDS):
            some = words[k : k + BATCH_WORDS]
            parts = [self._parts(w) for w in some]
            flat, counts = self.merge([p for ps in parts for p in ps])
            of_word = np.add.reduceat(counts, np.cumsum([0, *map(len, parts[:-1])])) if len(some) else counts
            ends = np.cumsum(of_word)
            odd = np.add.reduceat(np.r_[(flat < 0) | (flat >= self.n), False].astype(np.int64), np.r_[0, ends[:-1]]) > 0
            symbols, shown, plain, byte = flat.tolist(), self.decimal, self.byte_set, self.shown
            at = 0
            for w, end, with_bytes in zip(some, ends.tolist(), odd.tolist()):
                ids = symbols[at:end]
                at = end
                if with_bytes:
                    ids = self._with_bytes(w, ids)
                    text = self.surface(ids)
                else:
                    text = "".join([byte[i] for i in ids]) if plain.isdisjoint(ids) else self.surface(ids)
                self.memo[w] = (b",".join([shown[i] for i in ids]), len(ids), text)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        words = self.words(text)
        self.learn([w for w in dict.fromkeys(words) if w not in self.memo])
        return [int(i) for w in words for i in self.memo[w][0].split(b",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        text = self.surface(ids)
        return text[1:] if ids and ids[0] not in self.byte_of and self.pieces[ids[0]].startswith(SPACE) else text

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, str]]:
        """Number of ids, the ids as decimals joined by commas, and the decoded text, for each text."""
        done = 0
        while done < len(texts):
            if len(self.memo) > MEMO:
                self.memo.clear()
            new: dict[str, None] = {}
            upto, known, cut = done, self.memo, []
            while upto < len(texts) and len(new) < BATCH_WORDS:
                words = self.words(texts[upto] or "")
                cut.append(words)
                new.update((w, None) for w in words if w not in known)
                upto += 1
            self.learn(list(new))
            for words in cut:
                got = [known[w] for w in words]
                text = "".join([g[2] for g in got])
                # the first piece starts with the space put in front unless the text is empty
                yield sum([g[1] for g in got]), b",".join([g[0] for g in got]), text[1:] if got else ""
            done = upto


_LOADED: dict[str, Piecewise] = {}


def load(model_path: str) -> Piecewise:
    """The model, once in each worker."""
    if model_path not in _LOADED:
        _LOADED[model_path] = Piecewise(model_path)
    return _LOADED[model_path]


def encode_documents(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """(key, n_tokens, ids, decoded) of each row, or with ``full=False`` SHA-256 digests in place of the two long columns.

    ``model_path`` must be readable on every executor. Map-only: nothing is shuffled, and a batch's memory is bounded by
    Arrow's batch size and the memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                rows = list(model.digests(part.column(1).to_pylist()))
                count = pa.array([r[0] for r in rows], pa.int64())
                if full:
                    flat = np.array(b",".join(r[1] for r in rows if r[1]).split(b",") if any(r[1] for r in rows) else [], np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(r[0] for r in rows)]), pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), count, ids, pa.array([r[2] for r in rows], pa.string())], names=["k", "n_tokens", "ids", "decoded"])
                else:
                    sha = [[hashlib.sha256(x).hexdigest() for x in (r[1], r[2].encode())] for r in rows]
                    yield pa.RecordBatch.from_arrays([part.column(0), count, pa.array([s[0] for s in sha], pa.string()), pa.array([s[1] for s in sha], pa.string())], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[key]
    rest = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint, {rest}").withColumnRenamed("k", key)
