"""SentencePiece encoding and decoding: a streaming Viterbi over the lattice of pieces.

A BPE segmentation is right exactly where every two neighbouring pieces are: where joining them would be merged as
[left, right] again. So the lattice has an arc for each piece, and a path may go from one arc to the next only if the
two are such neighbours; one path survives to each position. Survivors of the last ``longest`` positions (no piece is
longer) are followed back; where they meet, ids up to there are committed and the window moves on, so the state stays
bounded however long the text is. Where no piece of the vocabulary spans two adjacent characters, such as at the end of
a word, paths always meet: texts are cut there first, and the ids of short segments are remembered. As one path alone leads
to each position, a short segment needs no lattice: the longest piece that fits is taken, and where none does, the position
is given up for good and the piece before it gives way to the next shorter one.

Ids equal the model's own. The model is a file given by path, read on the driver; workers get its tables.

Edge cases: a null text has null ids; an empty text has none; a character outside the vocabulary becomes its UTF-8
bytes; U+2581 in a text decodes to a space, as in the model's own decoder; repeated rows get equal results; columns
besides id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import per_slice

#: Where the model is, unless a path is given.
MODEL = os.environ.get("LODESTONE_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Segments that a worker remembers; it starts anew beyond.
REMEMBERED = 200_000
#: Characters beyond which a segment isn't remembered.
SHORT = 64


class Pieces:
    """The tables of a model."""

    def __init__(self, texts: list[str], scores: list[float], special: set[int], single_bytes: dict[int, int]) -> None:
        self.texts, self.bytes_of = texts, {b: i for i, b in single_bytes.items()}
        self.ids = {t: i for i, t in enumerate(texts) if i not in special and i not in single_bytes}
        self.longest = max(map(len, self.ids))
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        self.rank = {i: 0 if len(texts[i]) == 1 else k + 1 for k, i in enumerate(order)}  # what merges earlier is less; a character is no merge
        self.spans = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.raw = [b"" if i in special else bytes([single_bytes[i]]) if i in single_bytes else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        self.split: dict[int, tuple[int, int]] = {}
        for t, i in list(self.ids.items()):
            if len(t) > 1:
                parts = self._merge(t, stop_at_two=True)
                if parts and self._merge(t) == [t]:
                    self.split[i] = (self.ids[parts[0]], self.ids[parts[1]])
                else:
                    del self.ids[t]  # no text is ever encoded with it
        self.size = list(map(len, texts))
        self.heads: dict[str, int | None] = {}  # of what a piece begins with, and of pieces: the longest piece that it begins with
        self.shorter: list[int | None] = [None] * len(texts)  # of each piece: the longest other one that it begins with
        for t, i in self.ids.items():
            longest = None
            for k in range(1, len(t) + 1):
                if k == len(t):
                    self.shorter[i] = longest
                longest = self.heads[t[:k]] = self.ids.get(t[:k], longest)
        self.cut = self._cut()

    def _cut(self) -> str:
        """A pattern of segments. Texts are cut before a space that follows another character, between letters or digits
        and the rest, and around control characters; nowhere where a piece spans the place."""
        lone = "".join(c for c in map(chr, range(32)) if not any(c in x for x in self.spans))
        odd: set[str] = set()  # letters or digits that a piece joins with something else: they count as the rest
        kind = lambda c: "s" if c == SPACE else "w" if c not in odd and re.match(r"[^\W_]", c) else "p"
        while True:
            across = {a if kind(a) == "w" else b for a, b in self.spans if kind(a) + kind(b) in ("wp", "pw")}
            if not across:
                break
            odd |= across
        if any(b == SPACE != a for a, b in self.spans):
            return r"(?s).+"
        if len(odd) > 50:
            return rf"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        w = rf"[^\W_{''.join(map(re.escape, odd))}]"
        rest = rf"(?:[^\w{SPACE}{lone}]|[_{''.join(map(re.escape, odd))}])+"
        return rf"{SPACE}*{w}+|{SPACE}*{rest}|{SPACE}+" + (f"|[{lone}]" if lone else "")

    @cached_property
    def encoder(self) -> Encoder:
        """One for all tasks of a worker, which keeps what is broadcast: what it remembers serves the next task."""
        return Encoder(self)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(p.get_piece_size())
        single = {i: int(p.id_to_piece(i)[1:-1], 16) for i in n if p.is_byte(i)}
        if any(p.get_score(i) % 1 for i in n):  # merges are numbered; only a unigram model has logarithms of probabilities
            raise ValueError(f"{path} is no BPE model")
        return cls([p.id_to_piece(i) for i in n], [p.get_score(i) for i in n], {i for i in n if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}, single)

    def _merge(self, text: str, stop_at_two: bool = False) -> list[str]:
        """The plain algorithm: again and again the adjacent pair of the least rank, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None or (stop_at_two and len(parts) == 2):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts if not stop_at_two or len(parts) == 2 else []


class Encoder:
    def __init__(self, pieces: Pieces) -> None:
        self.p, self.fits = pieces, {}
        self.cut = re.compile(pieces.cut)
        self.memory = _Memory(self)
        self.little = [i.to_bytes(4, "little") for i in range(len(pieces.texts))]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether pieces a and b, joined, are merged as [a, b]: no merge across the border comes before those within."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= 4 * REMEMBERED:
                self.fits.clear()
            known = self.fits[a, b] = self._neighbours(a, b)
        return known

    def _neighbours(self, a: int, b: int) -> bool:
        ids, texts, rank, split = self.p.ids, self.p.texts, self.p.rank, self.p.split
        limit, limit_left = 1 << 60, False
        x, y = a, b
        while True:
            # At the time just before `limit`, x ends at the border and y starts there: would they have been merged?
            i = ids.get(texts[x] + texts[y])
            if i is not None and (rank[i] < limit or (rank[i] == limit and not limit_left)):
                return False
            rx, ry = rank[x], rank[y]
            if rx == 0 and ry == 0:
                return True
            if rx > ry:  # undo what was merged last; of equal ranks the right one, since the left one is merged first
                limit, limit_left, x = rx, True, split[x][1]
            else:
                limit, limit_left, y = ry, False, split[y][0]

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids, as soon as they are certain, of characters that come one by one or in strings."""
        p, longest = self.p, self.p.longest
        window, last, back = "", [], []  # of the characters not committed: the piece that ends after each, and its start

        def path(i: int, to: int = 0) -> list[int]:
            out: list[int] = []
            while i > to:
                t = last[i - 1]
                out += reversed(t) if isinstance(t, tuple) else (t,)
                i = back[i - 1]
            return out[::-1]

        left = None  # the piece before the window
        for more in chars:
            for c in more:
                window += c
                i = len(window)
                if c not in p.ids:
                    last.append(tuple(p.bytes_of[b] for b in c.encode()))
                    back.append(i - 1)
                else:
                    for j in range(max(0, i - longest), i):
                        t = p.ids.get(window[j:i])
                        if t is not None:
                            before = last[j - 1] if j else left
                            if before is None or isinstance(before, tuple) or self.neighbours(before, t):
                                last.append(t)
                                back.append(j)
                                break
                    else:
                        raise AssertionError(f"no path to {window!r}")
                if i >= 4 * longest:
                    ends = set(range(i - longest + 1, i + 1))
                    while len(ends) > 1:
                        e = max(ends)
                        ends.remove(e)
                        ends.add(back[e - 1])
                    b = ends.pop()
                    if b > 0:
                        yield path(b)
                        left = last[b - 1]
                        window, last, back = window[b:], last[b:], [x - b for x in back[b:]]
        yield path(len(window))

    def short(self, text: str) -> list[int]:
        """The same for a short text, in one go."""
        heads, size, shorter, known, ask = self.p.heads, self.p.size, self.p.shorter, self.fits, self.neighbours
        n, i = len(text), 0
        out: list[int] = []
        dead: set[int] = set()  # positions from which no path leads to the end
        while i < n:
            j = i + 3 if i + 3 < n else n  # pieces in prose are about as long
            if text[i:j] in heads:
                while j < n and text[i : j + 1] in heads:
                    j += 1
            else:
                j -= 1
                while j > i and text[i:j] not in heads:
                    j -= 1
            t = heads.get(text[i:j])
            if t is None:  # a character outside the vocabulary
                return [i for some in self.stream([text]) for i in some]
            j = i + size[t]
            while True:
                if j not in dead:
                    if not out:
                        break
                    fit = known.get((out[-1], t))
                    if fit is None:
                        fit = ask(out[-1], t)
                    if fit:
                        break
                t = shorter[t]
                while t is None:
                    dead.add(i)
                    t = out.pop()
                    i -= size[t]
                    t = shorter[t]
                j = i + size[t]
            out.append(t)
            i = j
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.memory.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.p.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class _Memory(dict):
    """The segments met since it was last full, and those before that."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.older = encoder, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            some = self.encoder.short(segment) if len(segment) <= SHORT else [i for part in self.encoder.stream([segment]) for i in part]
            ids = b"".join(map(self.encoder.little.__getitem__, some))
        if len(segment) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids


def encode(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, ids, n_ids; with check also exact: whether decoding gives the text again. No shuffle."""
    tables = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = tables.value.encoder
        col = batch.column("text")
        texts = col.to_pylist()
        flat = [None if t is None else encoder.encode(t) for t in texts]
        size = np.array([0 if x is None else len(x) // 4 for x in flat])
        values = np.frombuffer(b"".join(x for x in flat if x), "<i4")
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append([x is None for x in flat], False))
        cols = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(offsets, pa.array(values)), "n_ids": pa.array(size, mask=np.array([x is None for x in flat], bool), type=pa.int32())}
        if check:
            cols["exact"] = pa.array([None if x is None else encoder.decode(np.frombuffer(x, "<i4")) == t for x, t in zip(flat, texts)], pa.bool_())
        return pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(per_slice(run, "text"), "doc_id long, ids array<int>, n_ids int" + ", exact boolean" * check)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of doc_id and ids; null ids give a null text."""
    tables = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([None if not x.is_valid else encoder.decode(x.values.to_numpy(zero_copy_only=False)) for x in ids], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
