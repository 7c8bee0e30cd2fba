"""N-best segmentation over a piece lattice: forward Viterbi, then backward A*.

The forward pass gives the best score of every prefix of a stretch of text; searching
back from its end, that score is the exact cost of what is left, so complete
segmentations leave the agenda in falling order of score and the n-th to leave is the
n-th best. Where no piece of the vocabulary spans a border between two characters,
every segmentation is cut, so a text is searched one stretch between such borders at a
time; a worker keeps the stretches that it has met. The n best of a whole text are the
n least sums of losses, which only the n - 1 smallest single losses can take part in.

The lattice has an edge for every piece that matches, scored by the model, and for a
character without a piece of its own one edge of its UTF-8 byte pieces, scored
``UNKNOWN`` below the least ordinary piece. Text is escaped as the model says: a space
is the model's space sign, with one before the text. Decoding reverses that.

Defined cases: null text is empty; an empty text has one segmentation, of no pieces; a
text with fewer segmentations than n gives as many rows as it has; equal scores keep
the agenda's order, which depends on the stretch alone; texts of any length are
segmented whole; a text that holds the space sign itself decodes to a space there, and
``round_trip`` says so; repeated rows repeat. Other columns of the input are ignored.
"""
from __future__ import annotations

import gc
import re
import sys
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sediment.llm.common import text_bytes

SIGN = "▁"
UNKNOWN = 10.0
NEVER = float("-inf")
MEMO = 450_000
#: Characters of a stretch beyond which its lattice isn't held, but looked up where the search goes.
LONG = 4096
#: Numbers that a pattern's ``[^\W\d_]`` takes for letters, as superscripts, and ``isalpha`` doesn't.
NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
BATCH_ROWS = 512
_models: dict = {}


class Pieces(dict):
    """stretch -> (best score, its ids as little-endian bytes, least loss, others as (loss, ids))."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        size = p.get_piece_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.byte_id, self.score_of, self.bytes_of = [0] * 256, {}, [b""] * size
        self.piece: dict[str, tuple[float, int]] = {}
        for i in range(size):
            s = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(s[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(s[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.piece[s] = (p.get_score(i), i)
                self.bytes_of[i] = s.replace(SIGN, " ").encode()
        self.letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int32)
        self.places = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        ordinary = [s for s, _ in self.piece.values() if s > -1e8]
        self.unknown = min(ordinary, default=0.0) - UNKNOWN
        self.longest = max(map(len, self.piece), default=1)
        # every beginning of a piece: (score, ids) where it is a piece itself, else empty
        self.begun: dict[str, tuple] = {s[:k]: () for s in self.piece for k in range(1, len(s))}
        self.piece_ids = {s: (score, (i,)) for s, (score, i) in self.piece.items()}
        self.begun.update(self.piece_ids)
        # the same as a tree: character -> (what may follow, score, ids or None)
        self.tree: dict[str, tuple] = {}
        for s in sorted(self.begun):  # a beginning comes before what goes on from it
            node = self.tree
            for c in s[:-1]:
                node = node[c][0]
            node[s[-1]] = ({}, *(self.begun[s] or (0.0, None)))
        self.cut, self.cut_numbers = self._borders(), self._borders("".join(sorted(NUMBERS)))

    def _borders(self, numbers: str = ""):
        """A pattern of stretches: classes of characters that no piece joins are cut apart.

        A sign run belongs to what follows it. Letters and the rest are also cut apart
        if the vocabulary never joins them, which is looked up and not assumed. ``numbers``
        belong to the rest; a class that names them is slow, so only texts with any use it.
        """
        kind = lambda c: SIGN if c == SIGN else "w" if c.isalpha() else "o"
        joins = {(kind(a), kind(b)) for s in self.piece for a, b in zip(s, s[1:])}
        if {("w", SIGN), ("o", SIGN)} & joins:
            return None
        if {("w", "o"), ("o", "w")} & joins:
            return re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")
        return re.compile(f"{SIGN}*[^\\W\\d_{numbers}]+|{SIGN}*(?:[^{SIGN}\\w]|[\\d_{numbers}])+|{SIGN}+|.", re.S)

    def stretches(self, text: str) -> list[str]:
        escaped = SIGN + text.replace(" ", SIGN) if text else ""
        cut = self.cut if text.isascii() or NUMBERS.isdisjoint(text) else self.cut_numbers
        found = cut.findall(escaped) if cut else [escaped] if escaped else []
        return found

    def edges(self, s: str, i: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of each edge that starts at i."""
        out, begun = [], self.begun
        for j in range(i + 1, min(len(s), i + self.longest) + 1):
            got = begun.get(s[i:j])
            if got is None:
                break
            if got:
                out.append((j, *got))
        if not out or out[0][0] != i + 1:
            out.append((i + 1, self.unknown, tuple([self.byte_id[b] for b in s[i].encode("utf-8", "replace")])))
        return out

    def search(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of one stretch.

        An agenda entry's estimate is exact: some whole segmentation through it has that
        score. So an entry behind as many others as are still wanted can be dropped.
        """
        if len(s) > LONG:
            return self._back(len(s), self._prefixes(s), lambda j: self._into(s, j))
        end, tree = len(s), self.tree
        best = [NEVER] * (end + 1)
        best[0] = 0.0
        into: list[list] = [[] for _ in range(end + 1)]
        for i in range(end):
            b, node = best[i], tree
            for j in range(i, end):
                got = node.get(s[j])
                if got is None:
                    break
                node, score, ids = got
                if ids is not None:
                    j += 1
                    into[j].append((i, score, ids))
                    score += b
                    if score > best[j]:
                        best[j] = score
            got = tree.get(s[i])
            if got is None or got[2] is None:
                j, ids = i + 1, tuple([self.byte_id[x] for x in s[i].encode("utf-8", "replace")])
                into[j].append((i, self.unknown, ids))
                if b + self.unknown > best[j]:
                    best[j] = b + self.unknown
        return self._back(end, best, into.__getitem__)

    def _prefixes(self, s: str) -> array:
        """The best score of every prefix: 8 bytes a character, whatever the stretch."""
        end, longest, begun = len(s), self.longest, self.begun
        best = array("d", [NEVER]) * (end + 1)
        best[0] = 0.0
        for i in range(end):
            b, single = best[i], False
            for j in range(i + 1, min(end, i + longest) + 1):
                got = begun.get(s[i:j])
                if got is None:
                    break
                if got:
                    single = single or j == i + 1
                    best[j] = max(best[j], b + got[0])
            if not single:
                best[i + 1] = max(best[i + 1], b + self.unknown)
        return best

    def _into(self, s: str, j: int) -> list[tuple[int, float, tuple]]:
        """(start, score, ids) of each edge that ends at j, looked up anew."""
        out = [(i, *self.piece_ids[s[i:j]]) for i in range(max(0, j - self.longest), j) if s[i:j] in self.piece_ids]
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, self.unknown, tuple([self.byte_id[x] for x in s[j - 1].encode("utf-8", "replace")])))
        return out

    def _back(self, end: int, best, into) -> list[tuple[float, tuple[int, ...]]]:
        """A* from the end of a stretch; ``into`` gives the edges that end at a place."""
        # entries (-estimate, order of arrival, place, score so far, (ids, later path)), least first
        agenda, out, tick, want = [(-best[end], 0, end, 0.0, None)], [], 1, self.n
        while agenda:
            f, _, at, done, path = agenda.pop(0)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-f, tuple(ids)))
                want -= 1
                if not want:
                    break
                del agenda[want:]
                continue
            room, worst = want - len(agenda), agenda[-1][0] if agenda else 0.0
            for i, score, ids in into(at):
                g = score + done
                f = -(best[i] + g)
                if room:
                    room -= 1
                    insort(agenda, (f, tick, i, g, (ids, path)))
                    worst = agenda[-1][0]
                elif f < worst:
                    agenda.pop()
                    insort(agenda, (f, tick, i, g, (ids, path)))
                    worst = agenda[-1][0]
                tick += 1
        return out

    def _ids(self, ids: tuple[int, ...]) -> bytes:
        got = array(self.dtype.char, ids)
        if sys.byteorder != "little":
            got.byteswap()
        return got.tobytes()

    def __missing__(self, s: str):
        found = self.search(s)
        best, ids = found[0]
        other = tuple([(best - score, self._ids(x)) for score, x in found[1:]])
        got = (best, self._ids(ids), other[0][0] if other else np.inf, other)
        if len(self) < MEMO:
            self[s] = got
        return got

    def segment(self, text: str) -> list[tuple[float, bytes]]:
        """The n best (score, ids) of a whole text."""
        found = list(map(self.__getitem__, self.stretches(text)))
        if not found:
            return [(0.0, b"")]
        scores, ids, gaps, others = zip(*found)
        total, whole = float(sum(scores)), b"".join(ids)
        out = [(total, whole)]
        if self.n == 1:
            return out
        gaps = np.array(gaps)
        first = np.argsort(gaps, kind="stable")[:self.n - 1] if len(gaps) < 64 else self._least(gaps)
        single = sorted((loss, i, j) for i in first.tolist() for j, (loss, _) in enumerate(others[i]))[:self.n - 1]
        # sums over sets of deviations at different places, least first
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for place in sorted({i for _, i, _ in single}):
            more = [(loss + gap, (*picked, (place, j))) for loss, picked in sums for gap, i, j in single if i == place]
            sums = sorted(sums + more)[:self.n]
        ends = {i: sum(map(len, ids[:i])) for i in {i for _, picked in sums for i, _ in picked}}
        for loss, picked in sums[1:]:
            parts, at = [], 0
            for i, j in picked:
                parts += [whole[at:ends[i]], others[i][j][1]]
                at = ends[i] + len(ids[i])
            out.append((total - loss, b"".join([*parts, whole[at:]])))
        return out

    def _least(self, gaps: np.ndarray) -> np.ndarray:
        kth = np.partition(gaps, self.n - 2)[self.n - 2]
        below = np.flatnonzero(gaps < kth)
        return np.concatenate([below, np.flatnonzero(gaps == kth)[:self.n - 1 - len(below)]])

    def decode(self, ids: bytes, step: int = 1 << 18) -> bytes:
        """UTF-8 bytes of a segmentation: each id's bytes, gathered by table."""
        x, out = np.frombuffer(ids, self.dtype), []
        for i in range(0, len(x), step):
            some = x[i:i + step]
            size = self.sizes[some]
            ends = np.cumsum(size, dtype=np.int32)
            at = np.repeat(self.places[some] - (ends - size), size)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.letters[at].tobytes())
        text = b"".join(out)
        return text[1:] if text[:1] == b" " else text


def pieces(path: str, n: int) -> Pieces:
    if (path, n) not in _models:
        _models[path, n] = Pieces(path, n)
    return _models[path, n]


def encode(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """(doc_id, rank, score, ids, decoded, round_trip): the n best segmentations of every whole text.

    ``ids`` are little-endian u32; ``decoded`` is the text that they decode to.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        p = pieces(model, n)
        gc.disable()  # nothing here makes cycles, and the kept stretches are many objects to walk
        for b in batches:
            rows, held = [], 0

            def flush():
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.bool_()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "rank", "score", "ids", "decoded", "round_trip"])

            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_py()
                for r, (score, ids) in enumerate(p.segment(raw.decode("utf-8", "replace")), 1):
                    back = p.decode(ids)
                    rows.append((i, r, score, np.frombuffer(ids, p.dtype).astype("<u4").tobytes(), back, back == raw))
                    held += len(ids)
                if held > 4_000_000:
                    yield flush()
                    rows, held = [], 0
            yield flush()
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, rank int, score double, ids binary, decoded binary, round_trip boolean")


def digests(found: DataFrame) -> DataFrame:
    """Segmentations with counts and checksums instead of ids and text."""
    return found.select("doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"), "round_trip")
