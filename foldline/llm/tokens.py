"""Encoding whole texts with a public tokenizer inside Arrow batches.

Both vocabularies split a text before every blank that a visible character follows, so a text's ids
are the concatenation of its pieces' ids. Each distinct piece is encoded once by the ``tokenizers``
library and kept in a bounded table of the Python worker; a batch is then one lookup per distinct piece and a
numpy gather. Arrow splits the texts and finds the distinct pieces. New pieces are handed to the library many in one text. Where
a token keeps the blank before a piece (byte-level vocabularies), that token opens the piece; else a mark stands between pieces that is one token
of its own. Punctuation behind a word is a piece by itself, and so are the words before and behind a single line feed, since both
vocabularies cut there.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CACHE: dict[tuple, "PieceEncoder"] = {}
_ODD_BLANK = re.compile(r" (?!\S)")
_BLANK = re.compile(r" (?=\S)")
_MARK = " \x01"           # between pieces of one text for the library
_MARK_BYTE = "\u0101"     # what byte-level vocabularies write for its last byte
_BLANK_BYTE = "\u0120"    # and for a blank
_TOGETHER = 256           # pieces of one text for the library


def _plain(c: str) -> bool:
    """Whether a character is visible ASCII or a Latin letter, which nothing joins to a line feed beside it."""
    return " " < c < "\x7f" or c < "\u0250" and c.isalpha()


class _Index(dict):
    """Piece → row of the id table; unknown pieces get the next row and are noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece):
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class PieceEncoder:
    """``blank`` tells whether a piece inside a text keeps the blank before it (byte-level
    vocabularies) or blanks carry nothing (word vocabularies)."""

    def __init__(self, path: str, blank: bool, keep: int = 900_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.blank, self.keep = blank, keep
        # the mark parts pieces only where no other token holds its byte
        vocab = self.tok.get_vocab()
        own = sum(_MARK_BYTE in x for x in vocab) <= 2
        self.mark = self.tok.encode(_MARK, add_special_tokens=False).ids if own else []
        # the tokens with a blank; a piece holds none but the one before it
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.opens[[i for x, i in vocab.items() if blank and _BLANK_BYTE in x]] = True
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids if blank else []
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.uses = np.zeros(0, dtype=np.int32)          # batches that held the piece

    def shrink(self) -> None:
        """Only pieces that several batches held stay, half of ``keep`` at most or none."""
        own, names = np.flatnonzero(self.uses > 1), list(self.index)
        if len(own) > self.keep // 2:
            own = own[:0]
        flat, ends = self._gather(own)
        size = self.size[own]
        self.reset()
        self.index.update(zip((names[i] for i in own), range(len(own))))
        self.start, self.size, self.ids, self.uses = ends - size, size, flat, np.ones(len(own), dtype=np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), 4096):
            out += [e.ids for e in self.tok.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]
        return out

    def _flat(self, got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter((i for x in got for i in x), dtype=np.uint32, count=int(size.sum())), size

    def _inside(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that stand behind a blank, ``_TOGETHER`` of them in one text of the library."""
        opens = self.opens.any()
        if not opens and not self.mark:
            return self._flat(self.library([" " + p if self.blank else p for p in pieces]))
        flats, sizes, wide = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)], len(self.mark)
        for i in range(0, len(pieces), 16 * _TOGETHER):
            parts = [pieces[j:j + _TOGETHER] for j in range(i, min(len(pieces), i + 16 * _TOGETHER), _TOGETHER)]
            joined = [" " + " ".join(part) if opens else "".join([f" {p}{_MARK}" for p in part]) for part in parts]
            for part, e in zip(parts, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, dtype=np.uint32)
                if opens:
                    at = np.flatnonzero(self.opens[ids])
                    whole = len(at) == len(part) and at[0] == 0
                    size = np.diff(at, append=len(ids))
                else:
                    at = np.flatnonzero(ids == self.mark[-1])
                    whole = len(at) == len(part)
                    size = np.diff(at, prepend=-1) - wide
                    if whole:
                        own = np.ones(len(ids), dtype=bool)
                        for k in range(wide):
                            own[at - k] = False
                        ids = ids[own]
                if not whole:                           # a piece holds the mark itself, or a blank in another form
                    ids, size = self._flat(self.library([" " + p if self.blank else p for p in part]))
                flats.append(ids)
                sizes.append(size)
        return np.concatenate(flats), np.concatenate(sizes)

    def _opening(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that no blank precedes; Latin words stand in one text of the library, a line feed apart."""
        texts, ends, at = [], [], 0
        words = [len(self.feed) == 1 and p.isalpha() and max(p) < "\u0250" for p in pieces]
        while at < len(pieces):
            to = at + 1
            while words[at] and to < len(pieces) and words[to] and to - at < _TOGETHER:
                to += 1
            texts.append("\n".join(pieces[at:to]))
            ends.append(to)
            at = to
        got, at = [], 0
        for to, ids in zip(ends, self.library(texts)):
            parts = [ids]
            if to - at > 1:
                cut = [-1, *[i for i, x in enumerate(ids) if x == self.feed[0]], len(ids)]
                parts = [ids[i + 1:j] for i, j in zip(cut, cut[1:])]
            got += parts if len(parts) == to - at else self.library(pieces[at:to])
            at = to
        return self._flat(got)

    def _cut(self, piece: str) -> list[str]:
        """The pieces that ``piece`` consists of, which aren't cut any more; itself if it isn't cut."""
        out = []
        while True:
            left, feed, right = piece.partition("\n")
            if not (feed and left and right and _plain(left[-1]) and _plain(right[0])):
                return out + self._tail(piece)
            out += self._tail(left) + ([" \n"] if self.blank else [])
            piece = " " + right if self.blank else right

    @staticmethod
    def _tail(piece: str) -> list[str]:
        word = piece.rstrip(string.punctuation)
        if word != piece and word and word[-1] < "\u0250" and word[-1].lower().isalnum():
            return [word, " " + piece[len(word):]]
        return [piece]

    def _append(self, rows: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        self.start[rows] = len(self.ids) + np.cumsum(size) - size
        self.size[rows] = size
        self.ids = np.concatenate([self.ids, flat])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(int(size.sum()))], ends

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        known, row = len(self.size), self.index.__getitem__
        made, parts, several = [], [], []          # rows of pieces that are cut, the rows of their parts, how many
        for at, p in enumerate(new, known):
            if p[-1].isalnum() and "\n" not in p:
                continue
            cut = self._cut(p)
            if len(cut) > 1:
                made.append(at)
                parts += map(row, cut)
                several.append(len(cut))
        new += self.index.new
        self.index.new = []
        more = np.zeros(len(new), dtype=np.int64)
        self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.uses = np.concatenate([self.uses, more.astype(np.int32)])
        opens = np.fromiter((p[0] == " " for p in new), dtype=bool, count=len(new))
        inside = ~opens
        inside[np.array(made, dtype=np.int64) - known] = opens[np.array(made, dtype=np.int64) - known] = False
        for rows, encoded in ((np.flatnonzero(opens), lambda x: self._opening([p[1:] for p in x])),
                              (np.flatnonzero(inside), self._inside)):
            self._append(rows + known, *encoded([new[i] for i in rows]))
        if made:
            of = np.array(parts, dtype=np.int64)
            first = np.cumsum(several) - several
            self._append(np.array(made), self._gather(of)[0], np.add.reduceat(self.size[of], first))

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """The row of every piece; each distinct one is looked up once."""
        codes = pieces.dictionary_encode()
        own = codes.dictionary.to_pylist()
        return np.fromiter(map(self.index.__getitem__, own), dtype=np.int64, count=len(own))[np.asarray(codes.indices)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32) and the ``n + 1`` offsets of the texts. Null counts as empty."""
        if len(self.index) > self.keep:
            self.shrink()
        # only the piece that opens a text lacks a blank before it; later pieces never start
        # with one, so a blank in front marks it
        first: list[str] = []
        plain: list[str | None] = []           # the rest of a text that is cut at every blank
        odd: list[list[str]] = []              # later pieces of a text with other blanks
        kind = np.zeros(len(texts), dtype=np.int8)      # 0: empty, 1: plain, 2: odd
        for k, text in enumerate(texts):
            if not text:
                continue
            if _ODD_BLANK.search(text):
                kind[k] = 2
                part = _BLANK.split(text)
                first.append(" " + part[0])
                odd.append(part[1:])
            else:
                kind[k] = 1
                head, blank, rest = text.partition(" ")
                first.append(" " + head)
                plain.append(rest if blank else None)
        cut = pc.split_pattern(pa.array(plain, pa.string()), " ")
        later = np.zeros(len(texts), dtype=np.int64)
        later[kind == 1] = np.asarray(pc.fill_null(pc.list_value_length(cut), 0))
        later[kind == 2] = [len(x) for x in odd]
        count = np.concatenate([[0], np.cumsum(later + (kind > 0))])
        at = np.empty(int(count[-1]), dtype=np.int64)
        opens = np.zeros(len(at), dtype=bool)
        opens[count[:-1][kind > 0]] = True
        strange = np.repeat(kind == 2, later + (kind > 0))
        at[opens] = np.fromiter(map(self.index.__getitem__, first), dtype=np.int64, count=len(first))
        at[~opens & ~strange] = self._rows(cut.flatten())
        at[~opens & strange] = self._rows(pa.array([p for x in odd for p in x], pa.string()))
        self._learn()
        held = np.zeros(len(self.uses), dtype=bool)
        held[at] = True
        self.uses += held
        flat, ends = self._gather(at)
        return flat, np.concatenate([[0], ends])[count]


def encoder(path: str, blank: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary file (built once per Python worker)."""
    key = (path, blank)
    if key not in _CACHE:
        _CACHE[key] = PieceEncoder(path, blank)
    return _CACHE[key]
