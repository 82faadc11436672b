"""Split text into the pieces byte-level BPE merges within, and turn pieces into ids by a table of known pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex

#: White space as the tokenizer libraries mean it: the Unicode property, without the separators \x1c-\x1f.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Below U+0180 the classes are short, and the standard module, which is twice as fast, can hold them.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_latin = re.compile(f" ?[{_L}]+|[{_S}]+(?![^{_S}])|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+")
_beyond = re.compile("[^\x00-ſ]")


def splitter(pattern: str, special: tuple[str, ...] = ()) -> Callable[[str], list[str]]:
    """A function from text to its pieces by `pattern`; strings of `special` tokens are pieces of their own."""
    full = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
    usual = pattern == public_tokenizers.PATTERN  # the usual GPT-2 pattern, which _latin holds below U+0180

    def split(text: str) -> list[str]:
        return _latin.findall(text) if usual and not _beyond.search(text) else full.findall(text)

    if not special:
        return split
    apart = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")

    def split_around(text: str) -> list[str]:
        if not apart.search(text):
            return split(text)
        return [p for i, x in enumerate(apart.split(text)) for p in ([x] if i % 2 else split(x))]

    return split_around


class Pieces(dict):
    """Piece -> row of a ragged table of ids. Unknown pieces are gathered and encoded together.

    Holds `most` pieces at most; then it starts anew, so memory is bounded whatever the corpus holds.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        super().__init__()
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has."""
        if len(self) > self.most:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            flat, n = self.encode(self.new)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.new = []
        return ragged(self.flat, self.at[rows], self.n[rows])


def ragged(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[i] : at[i] + n[i]] of all i in a row."""
    ends = np.cumsum(n)
    index = np.repeat(at - (ends - n), n)
    index += np.arange(len(index))
    return flat[index], n


#: Pieces handled at once: bounds memory for a text of any length, and lets strings and arrays stay in a core's cache.
SEGMENT = 1 << 14


def encode_runs(table: Pieces, split: Callable[[str], list[str]], texts: list[str], end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of some texts in a row, ids of each) until all texts are told; each text's ids end with end_id, if given."""
    held: list[str] = []
    counts: list[int] = []

    def flush() -> tuple[np.ndarray, np.ndarray]:
        ids, n = table.ids(held)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        lengths = np.diff(ends, prepend=0)
        held.clear()
        counts.clear()
        return ended(ids.astype(np.int32, copy=False), lengths, end_id)

    for text in texts:
        pieces = split(text)
        if counts and len(held) + len(pieces) > SEGMENT:
            yield flush()
        if len(pieces) > SEGMENT:
            ids = np.concatenate([table.ids(pieces[i : i + SEGMENT])[0] for i in range(0, len(pieces), SEGMENT)])
            yield ended(ids.astype(np.int32, copy=False), np.array([len(ids)]), end_id)
            continue
        held += pieces
        counts.append(len(pieces))
    if counts:
        yield flush()


def ended(ids: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts in a row and their lengths, with end_id after each text."""
    if end_id is None:
        return ids, lengths
    last = np.cumsum(lengths) + np.arange(len(lengths))
    mine = np.ones(len(ids) + len(lengths), bool)
    mine[last] = False
    out = np.full(len(mine), end_id, np.int32)
    out[mine] = ids
    return out, lengths + 1


def encode_texts(table: Pieces, split: Callable[[str], list[str]], texts: list[str]) -> list[np.ndarray]:
    """The ids of each text."""
    out: list[np.ndarray] = []
    for ids, lengths in encode_runs(table, split, texts):
        out.extend(np.split(ids, np.cumsum(lengths)[:-1]))
    return out
