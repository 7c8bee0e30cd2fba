"""Token ids of whole texts with the tokenizers library, each distinct word encoded once.

The vocabulary's pre-tokenizer never joins text across white space, so a text's ids
are its white-space chunks' ids in order. A worker keeps the ids of chunks that it has
met. New chunks of Latin letters, digits and ASCII signs are merged many at a time by
the model's own merges, in numpy (``learn``); one that comes alone goes straight to the
library's BPE model, and any other chunk through the library's whole pipeline.
"""
from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import compress, filterfalse

import numpy as np

from sediment.llm.common import keeps

#: Chunks that a worker keeps; beyond it new chunks are encoded anew each time.
MEMO_CHUNKS = 500_000
# Latin letters whose lower case and composition don't depend on their neighbours.
_PIECE = re.compile("[a-zA-ZÀ-ÖØ-öø-įĲ-ňŊ-ɏ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-įĲ-ňŊ-ɏ]{1,64}")
#: New chunks that are merged together, at most and at least; longer ones than the pattern's are the library's.
TOGETHER, LEAST = 1 << 16, 1 << 12
#: Bytes of texts whose new chunks are looked for together.
GROUP_BYTES = 8_000_000
NEVER = 1 << 30
#: Slots of the table of pairs, as a power of two.
SLOT_BITS = 19
_encoders: dict = {}
keeps("tokens", _encoders.clear)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The model's merges over many pieces at once: in each round every piece merges its pair of least rank, the first of equals."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = _byte_letters()
        self.first, self.last = (np.array([vocab[letters[b] + end] for b in range(256)], np.int32) for end in ("", suffix))
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], 1 << 62), np.append(order, NEVER).astype(np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("a pair has two ranks")
        self.slots = np.full(1 << SLOT_BITS, len(keys), np.int32)
        slot, times = np.unique(self.slot(self.keys[:-1]), return_counts=True)
        self.slots[self.slot(self.keys[:-1])] = np.arange(len(keys))
        self.slots[slot[times > 1]] = -1
        every = np.concatenate([self.first, self.last])
        self.begin = self.rank(np.repeat(self.first, 512), np.tile(every, 256))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * np.int64(self.size) + b
        at = self.slots[self.slot(key)]
        out = np.where(self.keys[at] == key, self.ranks[at], NEVER)
        shared = np.flatnonzero(at < 0)  # several keys have the slot
        if len(shared):
            key = key[shared]
            at = np.searchsorted(self.keys, key)
            out[shared] = np.where(self.keys[at] == key, self.ranks[at], NEVER)
        return out

    def ids(self, raw: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of pieces of bytes; a piece's ids lie from its start on, the places behind them are free."""
        out, n = np.empty(len(raw), np.int32), np.ones(len(sizes), np.int64)
        by_size = np.argsort(sizes, kind="stable")
        lengths, begin = np.unique(sizes[by_size], return_index=True)
        for length, some in zip(lengths.tolist(), np.split(by_size, begin[1:])):
            place = start[some]
            x = raw[place[:, None] + np.arange(length)].astype(np.int64)
            follow = x[:, 1:].copy()
            follow[:, -1:] += 256
            rank = self.begin[x[:, :-1] * 512 + follow]
            x = np.concatenate([self.first[x[:, :-1]], self.last[x[:, -1:]]], axis=1)
            while True:  # all rows that are left have merged as often, so they are as long
                width = x.shape[1]
                at = rank.argmin(1) if width > 1 else np.zeros(len(x), np.int64)
                least = rank[np.arange(len(x)), at] if width > 1 else np.full(len(x), NEVER)
                go = least < NEVER
                if not go.all():
                    done = ~go
                    out[place[done, None] + np.arange(width)] = x[done]
                    n[some[done]] = width
                    some, place, x, rank, at, least = some[go], place[go], x[go], rank[go], at[go], least[go]
                    if not len(some):
                        break
                every, before = np.arange(len(x)), np.arange(width - 1) <= at[:, None]
                x = np.where(before, x[:, :-1], x[:, 1:])
                x[every, at] = self.made[least]
                if width > 2:
                    rank = np.where(before[:, 1:], rank[:, :-1], rank[:, 1:])
                    i = np.flatnonzero(at > 0)
                    rank[i, at[i] - 1] = self.rank(x[i, at[i] - 1], x[i, at[i]])
                    i = np.flatnonzero(at < width - 2)
                    rank[i, at[i]] = self.rank(x[i, at[i]], x[i, at[i] + 1])
        return out, n


#: The kind of a byte in a plain chunk: 0 between chunks, 1 letters, 2 digits, 3 signs.
_KIND = np.full(256, 3, np.int8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]], _KIND[0x30:0x3A], _KIND[0x0A] = 1, 2, 0


class Encoder(dict):
    """chunk -> little-endian ids; a missing chunk is encoded on first use."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        with open(path) as f:
            spec = json.load(f)
        # The direct way is for the pipeline it was written for: NFC, white space, lower case; words, digits, signs.
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.direct = kinds == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.more: dict[bytes, bytes] = {}  # of the texts in hand, chunks beyond MEMO_CHUNKS
        model = spec["model"]
        usual = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "unk_token"))
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "") if self.direct and usual else None

    def _ids(self, ids: list[int]) -> bytes:
        got = array(self.dtype.char, ids)
        if sys.byteorder != "little":
            got.byteswap()
        return got.tobytes()

    def _piece(self, p: str) -> bytes:
        got = self._ids([t.id for t in self.model.tokenize(p if p.isascii() else "".join([self.letters[b] for b in p.encode()]))])
        if len(p) <= 2:
            self.pieces[p] = got
        return got

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes those of the distinct new chunks that are plain, ``TOGETHER`` at a time; ``more`` holds what there is no room for."""
        self.more = {}
        if self.merges is None or len(chunks) < LEAST:  # few cost less one at a time
            return
        for i in range(0, len(chunks), TOGETHER):
            new = chunks[i:i + TOGETHER]
            s = b"\n".join(new).decode("utf-8", "replace")
            plain = list(map(_PLAIN.fullmatch, s.split("\n")))
            if "<|" in s:
                plain = [m if m and "<|" not in m[0] else None for m in plain]
            new = list(compress(new, plain))
            if new:
                low = s.lower().encode() if len(new) == len(plain) else "\n".join([m[0] for m in plain if m]).lower().encode()
                self._together(new, low + b"\n")

    def _together(self, new: list[bytes], low: bytes) -> None:
        raw = np.frombuffer(low, np.uint8)
        kind = _KIND[raw]
        begins = (kind != np.append(0, kind[:-1])) | (kind == 2)
        ends = np.flatnonzero(kind == 0)
        begins &= kind > 0
        start = np.flatnonzero(begins)
        edge = np.sort(np.concatenate([start, ends]))  # where pieces begin or chunks end
        sizes = edge[np.searchsorted(edge, start) + 1] - start
        x, n = self.merges.ids(raw, start, sizes)
        held = np.zeros(len(raw) + 1, np.int64)  # an id's place is taken if it is before its piece's end
        held[start] += 1
        held[start + n] -= 1
        taken = np.cumsum(held[:-1]) > 0
        until = np.cumsum(taken)[ends] * self.dtype.itemsize
        data = x[taken].astype(self.dtype).tobytes()
        ids = [data[a:b] for a, b in zip([0, *until[:-1].tolist()], until.tolist())]
        room = max(0, MEMO_CHUNKS - len(self))
        self.update(zip(new[:room], ids))
        self.more.update(zip(new[room:], ids[room:]))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """``encode`` of every text; the chunks that are new in them are merged together."""
        out, i = [], 0
        while i < len(texts):
            new, size, j = set(), 0, i
            while j < len(texts) and (j == i or size + len(texts[j]) < GROUP_BYTES):
                t = texts[j]
                new.update(filterfalse(self.__contains__, set((t.lower() if t.isascii() and b"<|" not in t else t).split())))
                size += len(t)
                j += 1
            self.learn(list(new))
            out += map(self.encode, texts[i:j])  # words are split again: held, they would be most of the memory
            i = j
        self.more = {}
        return out

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.more.get(chunk)
        if ids is not None:
            return ids
        s = chunk.decode("utf-8", "replace")
        direct = self.direct and "<|" not in s
        first = _PIECE.match(s) if direct else None
        if first and first.end() == len(s):
            s = s.lower()
            ids = self.pieces.get(s) or self._piece(s)
        elif first and sum(map(len, found := _PIECE.findall(s))) == len(s):  # a word with signs: the word alone may be known
            ids = b"".join([self.pieces.get(p) or self.get(p.encode()) or self._piece(p) for p in map(str.lower, found)])
        else:
            ids = self._ids(self.tokenizer.encode(s, add_special_tokens=False).ids)
        if len(self) < MEMO_CHUNKS:
            self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian ids of one UTF-8 text."""
        if text.isascii() and b"<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
