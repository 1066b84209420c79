"""Encoding of texts with a public byte-level BPE tokenizer.

The encoder finds the tokens of a piece by dynamic programming over its byte prefixes: for every prefix it keeps
the one last token with which the merge rules can end that prefix. Whether a token may end a prefix depends only
on the last token of the shorter prefix before it, so bytes can be appended without starting over, and after an
edit only the pieces near it are encoded again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.distinct import rows_once

#: Where the vocabulary is by default; it has one line of base64 bytes and rank for every token.
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern by which this vocabulary's tokenizer cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose tokens an encoder remembers, at most.
REMEMBERED = 200_000


class PrefixEncoder:
    """Byte-pair encoding by the last token of each byte prefix, over ``ranks``: bytes of a token -> id."""

    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pieces = regex.compile(pieces)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self.halves:
            run = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(run) > 2:
                joined = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token) for a, b in zip(run, run[1:])]
                at = joined.index(min(joined))
                if joined[at] >= token:
                    break
                run[at : at + 2] = [joined[at]]
            self.halves[token] = (run[0], run[1]) if len(run) == 2 else None
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merge rules leave ``left`` and ``right`` as they are, side by side.

        The later merge of the two is undone step by step along the seam; if at some step the tokens that touch
        there could merge before the ones they belong to had been made, the pair can't stand.
        """
        if (left, right) not in self.fits:
            a, b, before = left, right, len(self.ranks) + 1
            good = True
            while good:
                merged = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                if merged is not None and merged < before:
                    good = False
                    break
                pa, pb = self.parts(a), self.parts(b)
                if pa is None and pb is None:
                    break
                # The one made last is taken apart; on the left, an equal merge comes first, so it must stay.
                if pb is None or (pa is not None and a > b):
                    before, a = a, pa[1]
                else:
                    before, b = b + 1, pb[0]
            self.fits[left, right] = good
        return self.fits[left, right]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """``last[i]`` is the last token of the prefix of i + 1 bytes; completes it for all bytes of ``piece``,
        from where it ends. So bytes appended to a piece cost only their own steps."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (start == 0 or self.follows(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ranks:
            return (self.ranks[piece],)
        last, end, tokens = self.extend(piece, []), len(piece), []
        while end:
            tokens.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return tuple(reversed(tokens))

    def encode_text(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for an empty or null text."""
        ids: list[int] = []
        known = self.known
        for piece in self.pieces.findall(text or ""):
            ids += known.get(piece) or self.remembered(piece)
        return ids

    def encode_pieces(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """The ids of ``text`` with, for each of its pieces, the number of characters and of ids up to its end. With these
        the text can be edited."""
        ids: list[int] = []
        ends, counts = [], []
        for m in self.pieces.finditer(text or ""):
            ids += self.remembered(m.group())
            ends.append(m.end())
            counts.append(len(ids))
        return ids, ends, counts

    def edit(self, text: str, encoded: tuple[list[int], list[int], list[int]], start: int, end: int, new: str) -> tuple[str, tuple[list[int], list[int], list[int]]]:
        """``text`` with the characters from ``start`` to ``end`` replaced by ``new``, and its ``encode_pieces``.

        Pieces that end two before the edit are taken over, and so are those behind it from where old and new pieces fall
        into step again; only what lies between is cut and encoded. The places are found by bisection, so besides
        copying lists an edit costs only the pieces near it. An append is an edit at the end.
        """
        ids, ends, counts = encoded
        changed = text[:start] + new + text[end:]
        first = max(0, bisect_left(ends, start) - 2)
        at, n = (ends[first - 1], counts[first - 1]) if first else (0, 0)
        out, new_ends, new_counts = ids[:n], ends[:first], counts[:first]
        shift = len(changed) - len(text)
        for m in self.pieces.finditer(changed, at):
            out += self.remembered(m.group())
            new_ends.append(m.end())
            new_counts.append(len(out))
            k = bisect_left(ends, m.end() - shift)
            # In step behind the edit: the same place is the end of an old piece, and what follows is unchanged.
            if m.end() > start + len(new) + 1 and k < len(ends) and ends[k] == m.end() - shift and ends[k] > end + 1:
                more = len(out) - counts[k]
                return changed, (out + ids[counts[k] :], new_ends + [e + shift for e in ends[k + 1 :]], new_counts + [c + more for c in counts[k + 1 :]])
        return changed, (out, new_ends, new_counts)

    def remembered(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece; those of the last REMEMBERED pieces are kept, and of more the older half goes."""
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= REMEMBERED:
                for old in list(islice(self.known, REMEMBERED // 2)):
                    del self.known[old]
            found = self.known[piece] = self.encode_piece(piece.encode())
        return found


@lru_cache(maxsize=4)
def encoder(ranks_file: str = RANKS_FILE, pieces: str = PIECES) -> PrefixEncoder:
    """The encoder of a vocabulary file, made once in each Python worker."""
    with open(ranks_file, "rb") as lines:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pieces)


def token_ids(text: Column | str, ranks_file: str = RANKS_FILE) -> Column:
    """array<int>: the ids of ``text`` without special tokens; an empty or null text has no ids, an empty list."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_text = encoder(ranks_file).encode_text
        for texts in batches:
            yield texts.map(encode_text)

    return encode(text)


def token_count(text: Column | str, ranks_file: str = RANKS_FILE) -> Column:
    """int: how many ids ``text`` has; 0 for an empty or null text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_text = encoder(ranks_file).encode_text
        for texts in batches:
            yield texts.map(lambda text: len(encode_text(text))).astype("int32")

    return count(text)


def encode_documents(documents: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """(doc_id, ids) of every distinct row of ``documents``(doc_id, text); other columns are ignored.

    Empty and null texts get an empty list. Rows repeated as a whole come out once; rows that share a doc_id but
    not the text stay. No text is shuffled, unless very many rows are repeated.
    """
    rows = rows_once(documents.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", token_ids("text", ranks_file).alias("ids"))


def edited_documents(documents: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """(doc_id, edited, appended, edited_same, appended_same) of every distinct row of ``documents``(doc_id, text, source):
    how many ids a text has with three characters in its middle replaced by the source, and with the source appended, both
    encoded from the ids of the text as it was; and whether encoding anew gives the same. Nulls count as empty texts."""
    rows = rows_once(documents.select("doc_id", "text", "source"), "doc_id")

    @F.pandas_udf("edited int, appended int, edited_same boolean, appended_same boolean")
    def change(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        coder = encoder(ranks_file)
        for texts, sources in batches:
            out = []
            for text, new in zip(texts.fillna(""), sources.fillna("")):
                old, middle = coder.encode_pieces(text), len(text) // 2
                (a, x), (b, y) = coder.edit(text, old, middle, min(middle + 3, len(text)), new), coder.edit(text, old, len(text), len(text), new)
                out.append((len(x[0]), len(y[0]), x == coder.encode_pieces(a), y == coder.encode_pieces(b)))
            yield pd.DataFrame(out, columns=["edited", "appended", "edited_same", "appended_same"])

    return rows.select("doc_id", change("text", "source").alias("c")).select("doc_id", "c.*")
