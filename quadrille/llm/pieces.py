"""Distinct-chunk tables over a SentencePiece BPE model.

A chunk is a run of white-space markers with the characters up to the next marker. If no
piece holds a marker after another character, no merge crosses the border of a chunk, so
each distinct chunk is segmented once and the results are joined by position. Where
``check`` finds that this does not hold, whole texts are encoded instead.

Prefix counts: the encoding of a text cut at the end of one of its pieces is the start of
the text's encoding, and a row of pieces is the encoding of its text exactly if each two
neighbours are. So count and last piece of each prefix follow from those of shorter
ones; ``PrefixTable`` works them out once for every prefix of each distinct chunk, and those of
a text are the ones of its chunks, added up.
"""

from __future__ import annotations

import re
from itertools import chain
import numpy as np
import sentencepiece

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct chunks, prefixes of chunks, and pairs of pieces that a task keeps; a full table is emptied.
MOST_CHUNKS, MOST_PREFIXES, MOST_PAIRS = 200_000, 8_000_000, 300_000


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def check(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether chunks are independent: no inner markers, identity normaliser, dummy prefix."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    probe = "  éé Ａﬁ x  "
    return (
        not any(MARK in p.lstrip(MARK) for p in pieces)
        and MARK in pieces
        and model.normalize(probe) == MARK + probe.replace(" ", MARK)
        and all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
    )


def chunks(text: str) -> list[str]:
    """The chunks of a text as the model sees it, each without its first marker.

    The first marker of the text is the model's dummy prefix. The library adds one to a
    chunk as well, so a chunk's own encoding is that of its part in the text.
    """
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def segment(model: sentencepiece.SentencePieceProcessor, new: list[str]) -> list[list[int]]:
    """Ids of each chunk; a lone marker is one piece, which the library drops from an empty text."""
    found = model.encode(new, num_threads=1)
    return [x or [model.piece_to_id(MARK)] for x in found]


class _Numbered(dict):
    """Numbers each new key, and lists it."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class ChunkTable:
    """Ids and decoded text of each distinct chunk, segmented by the library once."""

    def __init__(self, path: str, most: int = MOST_CHUNKS):
        self.model, self.most = load(path), most
        self.whole = not check(self.model)
        self._empty()

    def _empty(self) -> None:
        self.row = _Numbered()
        self.other: dict[int, str] = {}  # decoded texts that aren't the chunk itself
        self.lens, self.starts, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _segment(self, new: list[str]) -> None:
        found = segment(self.model, new)
        n, lens = len(self.row) - len(new), np.fromiter(map(len, found), np.int64, len(found))
        flat = np.array(list(chain.from_iterable(found)), np.int32)
        if n + len(new) > len(self.lens):
            size = max(2 * len(self.lens), n + len(new))
            self.lens, self.starts = np.resize(self.lens, size), np.resize(self.starts, size)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
        self.lens[n : n + len(new)] = lens
        self.starts[n : n + len(new)] = self.used + np.cumsum(lens) - lens
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.other.update((i, t) for i, (c, t) in enumerate(zip(new, self.model.decode(found), strict=True), n) if c != t)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids and decoded text of each text."""
        if self.whole:
            found = self.model.encode(texts, num_threads=1)
            return [np.array(x, np.int32) for x in found], self.model.decode(found) if texts else []
        if len(self.row) > self.most:
            self._empty()
        parts = [chunks(t) for t in texts]
        row = self.row.__getitem__
        at = [np.fromiter(map(row, p), np.int64, len(p)) for p in parts]
        if new := self.row.taken():
            self._segment(new)
        ids, decoded = [], []
        other = np.fromiter(self.other, np.int64, len(self.other))
        for p, x in zip(parts, at, strict=True):
            lens = self.lens[x]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(p) else 0
            ids.append(self.ids[np.arange(total) + np.repeat(self.starts[x] - (ends - lens), lens)])
            if len(other) and len(odd := np.flatnonzero(np.isin(x, other))):
                p = p.copy()
                for i in odd:
                    p[i] = self.other[int(x[i])]
            decoded.append(" ".join(p))
        return ids, decoded


class PrefixTable:
    """Exact token counts at every prefix, by dynamic programming over distinct chunks."""

    def __init__(self, path: str):
        m = self.model = load(path)
        self.whole = not check(m)
        self.score = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.ends: dict[str, list[int]] = {}  # lengths of the pieces that end in a character
        for p in self.score:
            self.ends.setdefault(p[-1], []).append(len(p))
        self.ends = {c: sorted(set(x)) for c, x in self.ends.items()}
        #: By piece: pieces before it that have been tried, and whether the two stay as they are.
        self.after: dict[str, dict[str, bool]] = {p: {} for p in self.score}
        self.pairs = 0
        self._empty()

    def _empty(self) -> None:
        self.row = _Numbered()
        self.starts, self.lens, self.counts, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0

    def _merge(self, text: str) -> list[str]:
        """The pieces of a short text: merge the neighbours that make the best piece, first ones first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _fits(self, last: str, piece: str) -> bool:
        """Whether the two are the pieces of their joined text."""
        self.pairs += 1
        if self.pairs > MOST_PAIRS:
            self.pairs = 0
            for known in self.after.values():
                known.clear()
        fits = self.after[piece][last] = self._merge(last + piece) == ([last, piece] if last else [piece])
        return fits

    def _extend(self, chunk: str, total: list[int], last: list[str]) -> None:
        """Adds count and last piece of each prefix of a chunk to those of its shorter prefixes.

        A character that no piece holds is written in bytes, one token each.
        """
        after, ends = self.after, self.ends
        for i in range(len(total), len(chunk) + 1):
            c = chunk[i - 1]
            for size in ends.get(c, ()):
                piece = chunk[i - size : i] if size <= i else ""
                known = after.get(piece)
                if known is not None:
                    before = last[i - size]
                    fits = known.get(before)
                    if self._fits(before, piece) if fits is None else fits:
                        total.append(total[i - size] + 1)
                        last.append(piece)
                        break
            else:
                total.append(total[-1] + len(c.encode()))
                last.append(c)

    def prefixes(self, chunks: list[str]) -> list[list[int]]:
        """Of each chunk the counts of its prefixes of one character and more.

        In alphabetical order a chunk starts where its common part with the one before ends.
        """
        found: list[list[int]] = [[]] * len(chunks)
        total, last, before = [0], [""], ""
        for n in sorted(range(len(chunks)), key=chunks.__getitem__):
            chunk = chunks[n]
            same, most = 0, min(len(chunk), len(before))
            while same < most and chunk[same] == before[same]:
                same += 1
            del total[same + 1 :], last[same + 1 :]
            self._extend(chunk, total, last)
            found[n], before = total[1:], chunk
        return found

    def _store(self, new: list[str]) -> None:
        """Prefix counts of new chunks, from their marker on, one after the other."""
        found = self.prefixes([MARK + c for c in new])
        for i, (c, ids) in enumerate(zip(new, segment(self.model, new), strict=True)):
            if found[i][-1] != len(ids):  # the exact check; not seen to differ
                found[i] = [len(x) for x in segment(self.model, [c[:k] for k in range(len(c) + 1)])]
        n, lens = len(self.row) - len(new), np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))
        if n + len(new) > len(self.lens):
            size = max(2 * len(self.lens), n + len(new))
            self.lens, self.starts = np.resize(self.lens, size), np.resize(self.starts, size)
        if self.used + len(flat) > len(self.counts):
            self.counts = np.resize(self.counts, max(2 * len(self.counts), self.used + len(flat)))
        self.lens[n : n + len(new)] = lens
        self.starts[n : n + len(new)] = self.used + np.cumsum(lens) - lens
        self.counts[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def at_chars(self, texts: list[str]) -> list[np.ndarray]:
        """Token count of every prefix of each text: entry i is that of text[:i]."""
        if self.whole:
            return [np.array([len(self.model.encode(t[:i])) for i in range(len(t) + 1)], np.int32) for t in texts]
        if self.used > MOST_PREFIXES:
            self._empty()
        row = self.row.__getitem__
        at = [np.fromiter(map(row, p), np.int64, len(p)) for p in map(chunks, texts)]
        if new := self.row.taken():
            self._store(new)
        out = []
        for x in at:
            lens, starts = self.lens[x], self.starts[x]
            ends, totals = np.cumsum(lens), self.counts[starts + lens - 1]
            if len(x):
                counts = self.counts[np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)]
                counts += np.repeat((np.cumsum(totals) - totals).astype(np.int32), lens)
                counts[0] = 0  # the dummy prefix counts once a character follows
            else:
                counts = np.zeros(1, np.int32)
            out.append(counts)
        return out
