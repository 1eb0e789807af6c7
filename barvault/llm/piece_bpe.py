"""Encoding into and decoding from the pieces of a SentencePiece model of type BPE, by a merge-type prefix table.

A merge-type encoding starts from the characters and joins the two neighbours whose joined piece scores best, the left
one of equals, until no two neighbours make a piece. Two facts make a table over prefixes possible:

* A stretch of successive pieces of an encoding is the encoding of its own text, as no merge ever crossed its ends. So
  every prefix of a text has one last piece, and what is before that piece is the encoding of the shorter prefix.
* Pieces follow one another in an encoding if, and only if, each two neighbours do so on their own: the first merge to
  cross a border would win in the text of the two pieces as well.

So the last piece of a prefix is the one piece that ends there (an automaton finds them all) and is compatible with the
last piece of the prefix before it. The pieces are recovered backwards, from the end of the text.
"""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barvault.llm.support import small_batches

SPACE = "▁"  # fixed value: stands for a blank inside pieces
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what an unknown id reads as
KNOWN = 400_000  # stretches remembered by a worker, and as many older ones
PAIRS = 1_000_000  # pairs remembered by a worker
SHORT = 64  # longer stretches are not remembered

_NEVER = float("-inf")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("barvault.each_byte", _each_byte)


class _Remembered(dict):
    """Values of a function. When they become too many, those not asked for since the last time are forgotten."""

    def __init__(self, function):
        super().__init__()
        self.function = function
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= SHORT:
            if len(self) >= KNOWN:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _Piece:
    """A piece in the prefix table: its id, its length, and which pieces may follow it, as far as that was asked."""

    __slots__ = ("text", "id", "size", "followers")

    def __init__(self, text: str, id_: int | None):
        self.text, self.id, self.size = text, id_, len(text)
        self.followers: dict[_Piece, bool] = {}


def _stretch_pattern(pieces: Iterable[str], letters: set[str]) -> str:
    """A pattern that cuts a text where no piece reaches across, so that what lies between is encoded on its own.

    Characters that are neighbours in a piece are of one family. No merge joins characters of two families, or one that
    no piece has to anything; the run of blanks before a stretch belongs to it, as pieces have blanks in front only.
    """
    if not letters:
        return "(?s:.)"
    known = "".join(map(re.escape, sorted(letters)))
    if SPACE not in letters or any(SPACE in piece.lstrip(SPACE) for piece in pieces):
        return f"[{known}]+|[^{known}]"
    family = {c: c for c in letters}

    def head(c: str) -> str:
        while family[c] != c:
            family[c] = c = family[family[c]]
        return c

    for piece in pieces:
        for a, b in itertools.pairwise(piece.lstrip(SPACE)):
            family[head(a)] = head(b)
    members: dict[str, list[str]] = {}
    for c in sorted(letters - {SPACE}):
        members.setdefault(head(c), []).append(c)
    repeated = {a for piece in pieces for a, b in itertools.pairwise(piece) if a == b}
    groups = sorted(members.values(), key=len, reverse=True)
    runs = [f"[{''.join(map(re.escape, group))}]+" for group in groups if len(group) > 1 or group[0] in repeated]
    alone = [re.escape(group[0]) for group in groups if len(group) == 1 and group[0] not in repeated]
    if alone:
        runs.append(f"[{''.join(alone)}]")
    return (f"{SPACE}*(?:{'|'.join(runs)})|" if runs else "") + f"{SPACE}+|[^{known}]"


class PieceTable:
    """Encoder and decoder of one model, given as the bytes of its file.

    The model must be of type BPE, without pieces marked unused; its normaliser is the library's.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)):
            raise ValueError("a model with unused pieces is not supported")
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.unknown = self.library.unk_id()
        self.end = self.library.eos_id()
        byte_ids = {self.library.id_to_piece(i): i for i in range(size) if self.library.is_byte(i)}
        self.byte_ids = [byte_ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.surface = [self._surface(i) for i in range(size)]
        self.alone = _Remembered(self._alone)
        self.pairs = 0
        self.known = _Remembered(self._stretch_ids)

        self.letters = letters = {c for piece in self.ids for c in piece}
        self.automaton = ahocorasick.Automaton()
        for piece in letters | {p for p in self.ids if self._alone(p) is not None}:
            self.automaton.add_word(piece, _Piece(piece, self.ids.get(piece)))
        if letters:
            self.automaton.make_automaton()
        self.stretches = re.compile(_stretch_pattern(self.ids, letters))

    def _surface(self, i: int) -> bytes:
        if self.library.is_control(i):
            return b""
        if self.library.is_unknown(i):
            return UNKNOWN_SURFACE.encode()
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(SPACE, " ").encode()

    # --- what a piece does on its own -------------------------------------------------------------------------
    def _alone(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make the piece out of its characters, in order, and its first and last symbol
        before each of them and at the end; None if the merges end otherwise."""
        symbols = list(piece)
        won, first, last = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            scores = [self.scores.get(a + b, _NEVER) for a, b in itertools.pairwise(symbols)]
            best = max(scores)
            if best == _NEVER:
                return None
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            won.append(best)
            first.append(symbols[0])
            last.append(symbols[-1])
        return won, first, last

    def _compatible(self, before: str, piece: str) -> bool:
        """Whether the text of two pieces is encoded as these two.

        The merges within both pieces are replayed in the order in which they win; a merge across the border that wins
        over the next one of each ends it. Of equal scores the left one wins: the left piece, the border, the right piece.
        """
        left, _, ends = self.alone[before]
        right, starts, _ = self.alone[piece]
        i = j = 0
        while True:
            own = left[i] if i < len(left) else _NEVER
            other = right[j] if j < len(right) else _NEVER
            across = self.scores.get(ends[i] + starts[j], _NEVER)
            if across > own and across >= other and across != _NEVER:
                return False
            if own == other == _NEVER:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    # --- the prefix table ---------------------------------------------------------------------------------------
    def _follows(self, before: _Piece, piece: _Piece) -> bool:
        """Whether a piece may follow another one; the answer is kept with that one."""
        if self.pairs >= PAIRS:
            for known in self.automaton.values():
                known.followers.clear()
            self.pairs = 0
        self.pairs += 1
        answer = before.followers[piece] = self._compatible(before.text, piece.text)
        return answer

    def _pieces(self, stretch: str) -> list[_Piece]:
        """The pieces of a stretch whose characters all occur in pieces."""
        last: list[_Piece | None] = [None] * len(stretch)
        for end, piece in self.automaton.iter(stretch):
            if last[end] is None:
                if piece.size > end:
                    last[end] = piece
                    continue
                before = last[end - piece.size]
                fits = before.followers.get(piece)
                if fits or (fits is None and self._follows(before, piece)):
                    last[end] = piece
        out, end = [], len(stretch) - 1
        while end >= 0:
            out.append(last[end])
            end -= last[end].size
        out.reverse()
        return out

    def _spelled(self, text: str) -> list[int]:
        """The bytes of a character without a piece of its own."""
        return [self.byte_ids[b] for b in text.encode()]

    def _stretch_ids(self, stretch: str) -> tuple[int, ...]:
        if stretch[0] not in self.letters:
            return tuple(self._spelled(stretch))
        pieces = self._pieces(stretch)
        ids = [piece.id for piece in pieces]
        if None in ids:
            ids = itertools.chain.from_iterable([p.id] if p.id is not None else self._spelled(p.text) for p in pieces)
        return tuple(ids)

    def encode(self, text: str, end: bool = True) -> list[int]:
        """The ids of a text; ``end`` adds the end id."""
        stretches = self.stretches.findall(self.library.normalize(text))
        ids = list(itertools.chain.from_iterable(map(self.known.__getitem__, stretches)))
        return [*ids, self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that make no character read as U+FFFD, each one; control ids read as nothing."""
        data = b"".join(map(self.surface.__getitem__, ids))
        # the blank in front that the normaliser adds to a text goes again
        opening = next((i for i in ids if not self.library.is_control(i)), None)
        if opening is not None and self.library.id_to_piece(opening).startswith(SPACE):
            data = data[1:]
        return data.decode("utf-8", errors="barvault.each_byte")


@lru_cache(maxsize=2)
def piece_table(model: bytes) -> PieceTable:
    """The table of a model, made once in each worker."""
    return PieceTable(model)


def read_model(path: str) -> bytes:
    """A model file (some hundred kilobytes); its bytes travel with the job, so workers need no such file."""
    with open(path, "rb") as file:
        return file.read()


def with_pieces(
    docs: DataFrame, model: bytes, text: str = "text", end: bool = True, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the ids of each whole text and the text these decode to.

    A null text counts as empty: it has the end id only (no id without ``end``) and decodes to the empty text. A text of
    any length is encoded as a whole; memory is in proportion to the longest text of a batch. Rows come back as they
    are, repeated ones too; other columns, also of clashing names, are left alone unless named like the two new ones.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        table = piece_table(model)
        coded = [table.encode(x, end) for x in texts]
        return pd.DataFrame(
            {"ids": [np.array(c, np.int32) for c in coded], "decoded": [table.decode(c) for c in coded]}
        )

    found = both(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.withColumn(ids, found).withColumns({decoded: F.col(f"`{ids}`.decoded"), ids: F.col(f"`{ids}`.ids")})


def decode_ids(coded: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of the ids of each row; null ids read as the empty text."""
    small_batches(coded.sparkSession)

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        table = piece_table(model)
        return pd.Series([table.decode([] if x is None else list(x)) for x in column], dtype=object)

    return coded.withColumn(decoded, read(F.col(ids)))
