"""Pieces of text found with array operations: batches of code points, runs of letters, and the splits that tokenizers make before their merges."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

from .common import span_codes

#: Code points that are handled at once; a longer text makes a slice of its own.
SLICE = 1 << 19
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Beyond this many entries a word table starts anew.
TABLE_ROWS = 500_000

_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


#: Letters and numbers of Unicode 16, which the tokenizers know and an older Python doesn't.
_NEWER = {
    LETTER: [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    NUMBER: [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for kind, spans in _NEWER.items():
        for a, b in spans:
            out[a : b + 1] = kind
    out[list(_WHITE)] = SPACE
    return out


_LAZY: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    if "classes" not in _LAZY:
        _LAZY["classes"] = _classes()
    return _LAZY["classes"]


def slices(texts: list[str], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about `size` code points together."""
    start = have = 0
    for i, t in enumerate(texts):
        if have and have + len(t) > size:
            yield start, i
            start, have = i, 0
        have += len(t)
    if start < len(texts):
        yield start, len(texts)


class Points:
    """Texts as one array of code points; offsets[i] is where text i begins."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offsets[1:])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, class) of the runs of one class; none reaches over the end of a text."""
        kind = classes()[self.cp]
        new = np.empty(len(kind), bool)
        new[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        inner = self.offsets[:-1]
        new[inner[inner < len(kind)]] = True
        start = np.flatnonzero(new)
        return start, np.append(start[1:], len(kind)), kind[start]


def _contractions(p: Points, start: np.ndarray, end: np.ndarray, kind: np.ndarray, free: np.ndarray) -> None:
    """Moves the ends of a lone apostrophe run and of the letters after it where both make 's 't 're 've 'm 'll 'd; free: runs that no blank precedes."""
    cp, n = p.cp, len(start)
    at = np.flatnonzero((kind == OTHER) & (end - start == 1) & free)
    at = at[(cp[start[at]] == 39) & (at + 1 < n)]
    at = at[(kind[at + 1] == LETTER) & ~np.isin(start[at + 1], p.offsets)]
    if not len(at):
        return
    first = cp[start[at + 1]]
    second = np.where(end[at + 1] - start[at + 1] > 1, cp[np.minimum(start[at + 1] + 1, len(cp) - 1)], 0)
    take = np.where(np.isin(first, [ord(c) for c in "stmd"]), 1, 0)
    two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    take = np.where(two, 2, take)
    at, take = at[take > 0], take[take > 0]
    end[at] += take
    start[at + 1] += take


def byte_level_pieces(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in every text; they cover it."""
    start, end, kind = p.runs()
    if not len(start):
        return start, end
    start, end = start.copy(), end.copy()
    last_of_text = np.isin(end, p.offsets)
    blank = (kind == SPACE) & ~last_of_text
    joins = blank & (p.cp[end - 1] == 32)  # its last blank belongs to the next run
    after = np.flatnonzero(joins) + 1
    free = np.ones(len(start), bool)
    free[after] = False
    _contractions(p, start, end, kind, free)
    start[after] -= 1
    end[joins] -= 1
    single = np.flatnonzero(blank & ~joins & (end - start > 1))  # its last blank is a piece of its own
    extra_start, extra_end = end[single] - 1, end[single].copy()
    end[single] -= 1
    keep = end > start
    start, end = np.concatenate((start[keep], extra_start)), np.concatenate((end[keep], extra_end))
    if len(single):
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, end


def word_level_pieces(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ in every text."""
    start, end, kind = p.runs()
    start, end = start.copy(), end.copy()
    _contractions(p, start, end, kind, np.ones(len(start), bool))
    keep = (kind != SPACE) & (end > start)
    start, end, kind = start[keep], end[keep], kind[keep]
    many = (kind == NUMBER) & (end - start > 1)
    if many.any():
        times = np.where(many, end - start, 1)
        shift = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        split = np.repeat(many, times)
        start, end = np.repeat(start, times), np.repeat(end, times)
        start = np.where(split, start + shift, start)
        end = np.where(split, start + 1, end)
    return start, end


def distinct_words(p: Points, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of each span's word, the words by number): words are told apart by their code points."""
    code, first = span_codes(p.cp, start, end)
    return code, [p.text[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]


def text_ranges(p: Points, start: np.ndarray) -> np.ndarray:
    """bounds so that the spans of text i are bounds[i]:bounds[i + 1]."""
    return np.searchsorted(start, p.offsets, "left")
