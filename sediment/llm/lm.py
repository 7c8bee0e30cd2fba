"""Language-model scoring: causal self-attention over subword ids, with corpus counts.

Model
-----
A text is its tokens, words and one end, and the attention model reads the subword id that
begins each, or with ``inside`` every id of the text. In windows of ``WINDOW`` positions one head attends to the positions up to each
one, and a softmax over ``CLASSES`` classes of ids predicts the class of the next position's
id. Given the class k of its first id, a word's probability is

    (1 - new_k) * c / C_k  +  new_k * p(its ids)

where c is its count and C_k that of all training words of its class, and p spells it by
its subword ids: the first one's share of k, then for every further id the chance that the
word goes on, the share of the id's bucket after the id before it, and the id's share of its
bucket, last the chance that the word ends. ``new_k`` is the Good-Turing mass of new words in the class, the share of
its training tokens that are the only one of their word, and the counts that spell words
are those of such words. So every factor is normalised, the context acts on known and new
words alike, and the same formula holds for every word at every size.

With ``inside``, a further id x after a is spelled by the attention model as well: its chance is

    (times of x after a + WEIGHT * p(its class | context) * its share of the class) / (times of a + WEIGHT)

so all that the window holds, ids inside words included, speaks for or against it.

Windows overlap: one starts every ``STRIDE`` positions, and beyond a text's first
window only its last ``STRIDE`` positions are scored, so that each token is scored
once, with at least WINDOW - STRIDE positions before it.

Training
--------
All counts cover all training documents. The counting pass also leaves each text as the ids
that begin its words, or all its ids, from which training reads it. Ids are clustered to classes by their company: how
often hashed marks of the ids at the next and the second next positions, on either
side, occur beside an id in all training text. The commonest ids have a class each. Words
are spelled by what follows an id: the ids that go on words most have a bucket each, the
others share hashed ones. First weights come from a bounded sample of texts, in numpy on the
driver. Then all training texts are dealt into shards by a hash, one for every
``SHARD_TOKENS`` tokens, and each shard trains on from there over windows that tile its
texts, in hash order, so that every token of every training text is predicted once. The
shards' weights are averaged, by windows, in whole numbers. Shards and their order depend on
the rows alone, so results don't depend on how the input is partitioned.

Scoring
-------
All but the classes' probabilities is fixed for a word, so a worker works it out once for each
word that it meets. The commonest words, at most HOT, are broadcast with their counts.
Other words leave the scoring task as rows and meet their counts in a join. What is
broadcast besides is bounded by the vocabulary: classes, shares, and FOLLOW counts an id.

Defined cases: null text is empty, and an empty text is the end token alone; texts of
any length are scored whole; a word without ids has one that stands for none; repeated
rows are scored alike, each; a null ``training`` is false; without training documents c, N
and V are 0 and only the untrained attention model scores; an empty table gives no row.
Other columns of the input are ignored.
"""
from __future__ import annotations

import math
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sediment.llm.common import stage, text_bytes
from sediment.llm.tokens import TOGETHER, encoder

WINDOW, STRIDE = 32, 24
DIM, CLASSES, SINGLES, HASHED = 8, 32, 12, 2048
#: Marks that the ids in an id's company have, and how far away they count.
MARKS, COMPANY = 32, 2
#: Texts that the driver fits first weights to, about, and windows of them at most.
SAMPLE, SAMPLE_WINDOWS = 1500, 30_000
#: Passes over the sample, or as many as make LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, BATCH, RATE, LATER_RATE = 3, 1200, 64, 0.01, 0.002
#: Training tokens to a shard; windows that are shuffled together in it.
SHARD_TOKENS, POOL = 500_000, 2048
HOT = 300_000
#: Buckets of ids that follow an id, and what all further ids' shares of them count for beside those after it.
FOLLOW, OWN, WEIGHT = 512, 448, 16.0
#: Words that a worker keeps.
MEMO = 400_000
GROUP = 128
#: Bytes of texts whose words are looked up together in counting, and in scoring, which holds more for each.
GROUP_BYTES, SCORED_BYTES = 1 << 21, 1 << 20
#: Weights are summed as whole multiples of 1 / UNIT.
UNIT = float(1 << 20)


def vocabulary(enc) -> tuple[int, int, int]:
    """(ids, the end token's, that of a word without ids); the last two follow the tokenizer's own."""
    n = enc.tokenizer.get_vocab_size(with_added_tokens=True)
    return n + 2, n, n + 1


def endings(enc) -> np.ndarray:
    """Which ids can end a word, by the vocabulary."""
    out = np.ones(vocabulary(enc)[0], bool)
    for piece, i in enc.tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = piece.endswith("</w>")
    return out


class Firsts(dict):
    """word -> the id that begins it."""

    def __init__(self, enc):
        self.enc, self.none = enc, vocabulary(enc)[2]

    def __missing__(self, word: bytes) -> int:
        ids = self.enc[word]
        got = int.from_bytes(ids[:self.enc.dtype.itemsize], "little") if ids else self.none
        if len(self) < MEMO:
            self[word] = got
        return got

    def line(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


_firsts: dict = {}


def firsts_of(tokenizer: str) -> Firsts:
    if tokenizer not in _firsts:
        _firsts[tokenizer] = Firsts(encoder(tokenizer))
    return _firsts[tokenizer]


# words

#: A-Z as lower case, white space as blanks.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(each word's number, the distinct words by number, how many words each text has), in the texts' order."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]).translate(FOLD), np.uint8)
    blank = raw == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    till = np.append(0, np.cumsum(stop - start))
    small = till[-1] < 1 << 31
    words = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(start), [None, pa.py_buffer(till.astype(np.int32 if small else np.int64)), pa.py_buffer(raw[~blank])])
    found = words.dictionary_encode()
    behind = np.cumsum([len(t) + 1 for t in texts])
    return found.indices.to_numpy(), found.dictionary.cast(pa.binary()), np.diff(np.searchsorted(start, behind), prepend=0)


def extended(held: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """An array that has ``more`` behind the first ``size`` places of ``held``; what is behind those is free, so that few calls copy."""
    if size + len(more) > len(held):
        held = np.concatenate([held[:size], np.empty(size + 2 * len(more), held.dtype)])
    held[size:size + len(more)] = more
    return held


# counts

def mark_of(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64) * 2654435761 >> 10) % MARKS


def buckets(further: np.ndarray) -> np.ndarray:
    """The bucket of each id as one that follows another: its own for the ``OWN`` commonest, a hashed one for others."""
    out = OWN + (np.arange(len(further)) * 2654435761 >> 12) % (FOLLOW - OWN)
    own = np.argsort(-further, kind="stable")[:OWN]
    out[own] = np.arange(len(own))
    return out


class _Met(dict):
    """word -> its number; the ids that begin words by number."""

    def __init__(self, firsts: Firsts, end: int):
        self.firsts, self.begins = firsts, [end]  # number 0 is the end of a text

    def __missing__(self, word: bytes) -> int:
        self.begins.append(self.firsts[word])
        self[word] = at = len(self.begins) - 1
        return at

    def ids(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after another, and how many each has."""
        return np.array(self.begins, np.int64)[x], np.ones(len(x), np.int64)


class _MetWhole(dict):
    """word -> its number; all ids of words by number."""

    def __init__(self, firsts: Firsts, end: int):
        self.firsts, self.new, self.count = firsts, [], 1
        self.x, self.start, self.n, self.size = np.array([end]), np.array([0]), np.array([1]), 1  # number 0 is the end of a text

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = at = self.count
        self.count += 1
        return at

    def ids(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after another, and how many each has."""
        if self.new:
            more, n = laid_out(self.firsts.enc, self.new, self.firsts.none)
            at = self.count - len(n)
            self.start = extended(self.start, at, np.cumsum(n) - n + self.size)
            self.x, self.n, self.new = extended(self.x, self.size, more), extended(self.n, at, n), []
            self.size += len(more)
        n = self.n[x]
        return self.x[ranges(self.start[x], n)], n


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n whole numbers from each start on, one range after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def line_type(size: int) -> np.dtype:
    """What holds the ids of a vocabulary of a size in lines."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text_bytes())


def gather(docs: DataFrame, tokenizer: str, inside: bool = False) -> DataFrame:
    """(kind, key, n, h, line) of training texts: 0 words and counts; 1 an empty key and the number of texts; 2 cells of company; 3 texts.

    A cell is id * MARKS + the mark of an id in its company. A text is its hash and line, the ids that begin its words,
    or ``inside`` them too, as ``line_type`` has them: later steps needn't tokenize it again, and its column is read by them alone.
    """
    kind_of_met = _MetWhole if inside else _Met

    def run(batches):
        firsts = firsts_of(tokenizer)
        size, end, _ = vocabulary(firsts.enc)
        met, texts, total = kind_of_met(firsts, end), 0, np.zeros(1, np.int64)
        near, held, hashes, n = np.zeros(size * MARKS, np.int64), [], [], 0  # held: texts of n bytes
        kinds = {"kind": pa.int32(), "key": pa.binary(), "n": pa.int64(), "h": pa.int64(), "line": pa.binary()}

        def rows(kind, **columns):
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)) if c == "kind" else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], list(kinds))

        def count():
            nonlocal total, held, hashes, n
            if held:
                which, words, lengths = split_words(held)
                x = np.zeros(len(which) + COMPANY * (len(held) + 1), np.int64)  # places of the end beside every text
                words = words.to_numpy(zero_copy_only=False)
                x[np.arange(len(which)) + COMPANY * np.repeat(np.arange(1, len(held) + 1), lengths)] = np.fromiter(map(met.__getitem__, words.tolist()), np.int64, len(words))[which]
                more = np.bincount(x, minlength=len(met) + 1)
                more[:len(total)] += total
                total = more
                ids, per_word = met.ids(x)
                m = mark_of(ids)
                for gap in range(1, COMPANY + 1):
                    near[:] += np.bincount(np.concatenate([ids[:-gap] * MARKS + m[gap:], ids[gap:] * MARKS + m[:-gap]]), minlength=len(near))
                stop, edge = np.cumsum(lengths + COMPANY), np.append(0, np.cumsum(per_word))
                ids = ids.astype(line_type(size))
                yield rows(3, h=hashes, line=[ids[a:b].tobytes() for a, b in zip(edge[stop - lengths].tolist(), edge[stop].tolist())])
                held, hashes, n = [], [], 0

        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                held.append(t.as_py())
                hashes.append(h)
                n += len(held[-1])
                texts += 1
                if n > GROUP_BYTES:
                    yield from count()
                    if len(met) > MEMO:
                        yield rows(0, key=list(met), n=total[1:])
                        met, total = kind_of_met(firsts, end), np.zeros(1, np.int64)
        yield from count()
        yield rows(0, key=list(met), n=total[1:])
        yield rows(1, key=[b""], n=[texts])
        at = np.flatnonzero(near)
        for i in range(0, len(at), 1 << 17):
            some = at[i:i + (1 << 17)]
            yield rows(2, key=[x.to_bytes(4, "little") for x in some.tolist()], n=near[some])

    return docs.select(row_hash().alias("h"), text_bytes().alias("text")).mapInArrow(run, "kind int, key binary, n long, h long, line binary")


def clusters(near: np.ndarray, groups: int, rounds: int = 15) -> np.ndarray:
    """A group for each id, by what is special in its company; -1 without any. Integer counts make it the same for the same corpus."""
    out, mass = np.full(len(near), -1), near.sum(1)
    seen = np.flatnonzero(mass)
    if len(seen) <= groups:
        out[seen] = np.arange(len(seen))
        return out
    share = near.sum(0) + 1.0
    share /= share.sum()
    v = np.sqrt((near[seen] + 4 * share) / (mass[seen, None] + 4)) - np.sqrt(share)
    weight, rng = np.sqrt(mass[seen]), np.random.default_rng(3)
    pick = [int(weight.argmax())]
    far = ((v - v[pick[0]]) ** 2).sum(1)
    for _ in range(groups - 1):  # centres far from each other, among common ids
        chance = far * weight + 1e-12
        pick.append(int(rng.choice(len(v), p=chance / chance.sum())))
        far = np.minimum(far, ((v - v[pick[-1]]) ** 2).sum(1))
    centre = v[pick]
    for _ in range(rounds):
        at = ((centre ** 2).sum(1) - 2 * v @ centre.T).argmin(1)
        centre = np.array([np.average(v[at == j], axis=0, weights=weight[at == j]) if (at == j).any() else centre[j] for j in range(groups)])
    out[seen] = ((centre ** 2).sum(1) - 2 * v @ centre.T).argmin(1)
    return out


GROUPS = CLASSES - SINGLES - 2


def gathered_words(batches):
    """(words, their counts) of many small batches at once."""
    words, c = [], []
    for b in batches:
        words += b.column(0).to_numpy(zero_copy_only=False).tolist()
        c.append(b.column(1).to_numpy(zero_copy_only=False))
        if len(words) >= TOGETHER:
            yield words, np.concatenate(c)
            words, c = [], []
    if words:
        yield words, np.concatenate(c)


def spelling(counts: DataFrame, tokenizer: str) -> DataFrame:
    """(kind, at, n) of all training words, summed.

    0: counts of the ids that begin tokens, then of the first, further and last ids of words met once, each
    at its id; 1: neighbouring ids in words met once, at first * ids + second.
    """
    def run(batches):
        enc = encoder(tokenizer)
        size, _, none = vocabulary(enc)
        total, pairs = np.zeros(4 * size, np.int64), []

        def out(kind, at, n):
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at), kind, np.int32)), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64())})

        for words, c in gathered_words(batches):
            x, n = laid_out(enc, words, none)
            first = np.cumsum(n) - n
            np.add.at(total, x[first], c)
            alone, start = c == 1, np.zeros(len(x), bool)
            start[first] = True
            x_alone = np.repeat(alone, n)
            last = (first + n - 1)[alone]
            total[size:] += np.concatenate([np.bincount(y, minlength=size) for y in (x[start & x_alone], x[~start & x_alone], x[last])])
            second = np.flatnonzero(~start & x_alone)
            pairs.append(x[second - 1] * size + x[second])
            if sum(map(len, pairs)) > 1 << 21:
                yield out(1, *np.unique(np.concatenate(pairs), return_counts=True))
                pairs = []
        if pairs:
            yield out(1, *np.unique(np.concatenate(pairs), return_counts=True))
        at = np.flatnonzero(total)
        yield out(0, at, total[at])

    return counts.select("word", "c").mapInArrow(run, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))


def laid_out(enc, words: list[bytes], none: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the distinct words, one after another, and how many each has, at least one."""
    enc.learn(list(filterfalse(enc.__contains__, words)))
    parts = list(map(enc.__getitem__, words))
    enc.more = {}
    n = np.fromiter(map(len, parts), np.int64, len(parts)) // enc.dtype.itemsize
    x = np.frombuffer(b"".join(parts), enc.dtype).astype(np.int64)
    if len(n) and not n.all():
        x = np.insert(x, (np.cumsum(n) - n)[n == 0], none)
        n = np.maximum(n, 1)
    return x, n


def vector(rows: DataFrame, size: int) -> np.ndarray:
    """(at, n) rows, at most ``size`` of them, as an array."""
    got, out = rows.select("at", "n").toArrow(), np.zeros(size, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def classify(counts: np.ndarray, group: np.ndarray, end: int) -> np.ndarray:
    """A class for every id: the end token and the commonest ids have one each, the others their group's; the last is for ids without one."""
    out = np.where(group >= 0, SINGLES + 1 + group, CLASSES - 1)
    order = np.argsort(-counts, kind="stable")
    order = order[order != end][:SINGLES]
    out[order] = 1 + np.arange(len(order))
    out[end] = 0
    return out


# attention

SHAPES = {"ec": (CLASSES, DIM), "er": (HASHED, DIM), "p": (WINDOW, DIM), "qkv": (DIM, 3 * DIM), "o": (DIM, DIM), "g": (DIM, CLASSES), "b": (CLASSES,)}


def first_weights(class_share: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in SHAPES.items()}
    w["er"] *= 0.3
    w["g"] *= 0.5
    w["b"] = np.log(class_share).astype(np.float32)
    return w


MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays, as a product: faster than a reduction over few columns."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def exps(x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """exp in place, less each row's greatest where any value is far from zero; then ``mask`` says what doesn't count."""
    if x.size and (x.max() > 60 or x.min() < -60):
        if mask is not None:
            x += mask
        x -= x.max(-1, keepdims=True)
    return np.exp(x, out=x)


def turned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def attend(w: dict, x: np.ndarray):
    """Hidden states of (windows, positions, DIM) inputs; each position sees those up to it. Then what a step needs: a position's
    weights add up to more than 1, and the last array divides by their sum."""
    n, flat = x.shape[1], x.reshape(-1, DIM)
    q, k, v = ((flat @ m).reshape(x.shape) for m in split_columns(w["qkv"]))
    q *= x.dtype.type(DIM ** -0.5)
    s = exps(q @ turned(k), MASK[:n, :n])
    s *= SEEN[:n, :n]
    over = 1 / row_sums(s)
    o = s @ v
    o *= over
    return x + (o.reshape(-1, DIM) @ w["o"]).reshape(x.shape), (q, k, v, s, o, over)


def split_columns(m: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(m[:, i:i + DIM]) for i in range(0, m.shape[1], DIM)]


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by number."""
    cells = at[:, None] * DIM + np.arange(DIM)
    return np.bincount(cells.reshape(-1), rows.reshape(-1), size * DIM).astype(rows.dtype).reshape(size, DIM)


def step(w: dict, classes: np.ndarray, windows: np.ndarray, told: bool = True) -> tuple[dict, float]:
    """Gradient and, if it is to be ``told``, mean loss of next-class prediction over windows of ids, -1 for none."""
    asked = windows[:, 1:].reshape(-1) >= 0
    ids = np.maximum(windows, 0)
    among = classes.take(ids)
    goal, c, h = among[:, 1:].reshape(-1), among[:, :-1].reshape(-1), ids[:, :-1].reshape(-1) % HASHED
    x = w["ec"].take(c, 0)
    x += w["er"].take(h, 0)
    x = x.reshape(len(windows), -1, DIM)
    x += w["p"][:x.shape[1]]
    y, (q, k, v, a, o, over) = attend(w, x)
    y, flat_o = y.reshape(-1, DIM), o.reshape(-1, DIM)
    z = y @ w["g"]
    z += w["b"]
    exps(z)
    total = row_sums(z)[:, 0]
    cell = np.arange(0, z.size, CLASSES)
    goal = goal + cell  # of one window it is a view
    n = max(1, int(asked.sum()))
    share = (asked / n).astype(z.dtype)
    loss = float(-np.log(np.maximum((z.reshape(-1)[goal] / total)[asked], 1e-30)).sum()) / n if told else math.nan
    z *= (share / total)[:, None]
    z.reshape(-1)[goal] -= share
    g = {"g": y.T @ z, "b": np.ones(len(z), z.dtype) @ z}
    dy = z @ w["g"].T
    g["o"] = flat_o.T @ dy
    do = (dy @ w["o"].T).reshape(x.shape)
    do *= over
    ds = do @ turned(v)
    dv = a.transpose(0, 2, 1) @ do
    ds -= row_sums(do * o)  # a row of a, times its row of do @ v', adds up to this
    ds *= a
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    dq *= x.dtype.type(DIM ** -0.5)
    dqkv = [d.reshape(-1, DIM) for d in (dq, dk, dv)]
    x = x.reshape(-1, DIM)
    g["qkv"] = np.concatenate([x.T @ d for d in dqkv], axis=1)
    dx = dy
    for d, m in zip(dqkv, split_columns(w["qkv"])):
        dx += d @ m.T
    g["p"] = np.zeros_like(w["p"])
    g["p"][:do.shape[1]] = dx.reshape(do.shape).sum(0)
    is_class = np.zeros(z.shape, z.dtype)
    is_class.reshape(-1)[cell + c] = 1
    g["ec"], g["er"] = is_class.T @ dx, summed(h, dx, HASHED)
    return g, loss


class Adam:
    """Weights ``w``, a copy of the given ones, and their steps."""

    def __init__(self, w: dict, rate: float):
        self.rate, self.t = rate, 0
        self.flat = np.concatenate([x.reshape(-1) for x in w.values()])
        cuts = np.cumsum([x.size for x in w.values()])[:-1]
        self.w = {k: x.reshape(w[k].shape) for k, x in zip(w, np.split(self.flat, cuts))}
        self.a, self.b, self.spare = (np.zeros_like(self.flat) for _ in range(3))

    def apply(self, g: dict) -> None:
        self.t += 1
        rate, fix = self.rate / (1 - 0.9 ** self.t), 1 / math.sqrt(1 - 0.99 ** self.t)
        g, a, b, x = np.concatenate([g[k].reshape(-1) for k in self.w]), self.a, self.b, self.spare
        np.subtract(g, a, out=x)
        x *= 0.1
        a += x
        np.multiply(g, g, out=x)
        x -= b
        x *= 0.01
        b += x
        np.sqrt(b, out=x)
        x *= fix
        x += 1e-8
        np.multiply(a, rate, out=g)
        g /= x
        self.flat -= g


def tiles(line: np.ndarray, end: int) -> np.ndarray:
    """Windows of a text's ids between end tokens, -1 behind them; each starts at the last id of the one before."""
    count = -(-(len(line) + 1) // WINDOW)
    out = np.full(count * WINDOW + 1, -1, np.int32)
    out[0] = out[len(line) + 1] = end
    out[1:len(line) + 1] = line
    return out[np.arange(count)[:, None] * WINDOW + np.arange(WINDOW + 1)]


class ShardTraining:
    """Trains on one shard's windows in the order in which they come, ``POOL`` shuffled at a time."""

    def __init__(self, w: dict, classes: np.ndarray):
        self.opt, self.classes, self.rng = Adam(w, LATER_RATE), classes, np.random.default_rng(13)
        self.held, self.waiting, self.n = [], 0, 0

    def add(self, windows: np.ndarray) -> None:
        self.held.append(windows)
        self.waiting += len(windows)
        self.n += len(windows)
        if self.waiting >= POOL:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % POOL
            for i in range(0, whole, POOL):
                self._train(every[i:i + POOL])
            self.held, self.waiting = [every[whole:]], len(every) - whole

    def _train(self, pool: np.ndarray) -> None:
        pool = self.rng.permutation(pool)
        for i in range(0, len(pool), BATCH):
            self.opt.apply(step(self.opt.w, self.classes, pool[i:i + BATCH], told=False)[0])

    def close(self) -> np.ndarray:
        """The weights times the number of windows, in units."""
        if self.waiting:
            self._train(np.concatenate(self.held))
        flat = np.concatenate([self.opt.w[k].reshape(-1) for k in SHAPES]).astype(np.float64)
        return np.rint(flat * UNIT).astype(np.int64) * self.n


def trained(texts: DataFrame, end: int, at, shards: int) -> dict[str, np.ndarray]:
    """Weights that each shard of the (h, line) texts trained on from the first ones, averaged by windows."""
    def run(batches):
        w, classes = at.value
        kind = line_type(len(classes))
        total, n, shard, now = 0, 0, None, None
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(2)):
                if k != shard:
                    if now is not None:
                        total, n = total + now.close(), n + now.n
                    shard, now = k, ShardTraining(w, classes)
                now.add(tiles(np.frombuffer(t.as_py(), kind), end))
        if now is not None:
            total, n = total + now.close(), n + now.n
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total) + 1)), "x": pa.array(np.append(total, n))})

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "line")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "h")
    got = dealt.mapInArrow(run, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # one row a weight
    flat = np.zeros(sum(math.prod(s) for s in SHAPES.values()) + 1)
    flat[got["i"].to_numpy()] = got["x"].to_numpy()
    flat = (flat[:-1] / (max(1.0, flat[-1]) * UNIT)).astype(np.float32)
    cuts = np.cumsum([math.prod(s) for s in SHAPES.values()])[:-1]
    return {k: x.reshape(SHAPES[k]) for k, x in zip(SHAPES, np.split(flat, cuts))}


def pretrained(w: dict, classes: np.ndarray, sample: np.ndarray) -> dict:
    """First weights after steps over the sample's windows."""
    opt, rng = Adam(w, RATE), np.random.default_rng(11)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(sample))) if len(sample) else 0):
        order = rng.permutation(len(sample))
        for i in range(0, len(order), BATCH):
            opt.apply(step(opt.w, classes, sample[order[i:i + BATCH]], told=False)[0])
    return opt.w


# scoring

class Scorer:
    """log10 probabilities: of classes in context, and of words given their class."""

    def __init__(self, w: dict, classes: np.ndarray, end: int, firsts: np.ndarray, spelled: np.ndarray, final: np.ndarray, after: tuple):
        """``firsts`` counts the ids that begin tokens, ``spelled`` the first, further and last ids of words met once,
        ``after`` what follows an id: cells, id * FOLLOW + bucket, and their counts."""
        size = len(classes)
        ids = np.arange(size)
        self.w, self.classes, self.end = w, classes, end
        q, k, v = np.split(w["qkv"], 3, axis=1)
        self.qkv = [np.ascontiguousarray(m) for m in (q * DIM ** -0.5, k, v)]
        self.x = (w["ec"][classes] + w["er"][ids % HASHED]).astype(np.float32)
        first, more, last = spelled.reshape(3, size)
        close = np.minimum((last + 0.5) / (first + more + 1.0), 1 - 1e-9)
        # what follows an id that can end a word: the word goes on, or ends
        on, over = (np.where(final, f, 0.0) for f in (np.log1p(-close), np.log(close)))
        over[end] = 0
        x = first + 0.02
        self.begin, self.on, self.over = np.log(x / np.bincount(classes, x, CLASSES)[classes]), on, over
        x = more + 0.02
        further, self.follow = x / x.sum(), buckets(more)
        self.bucket = np.bincount(self.follow, further, FOLLOW)
        self.within = further / np.maximum(self.bucket[self.follow], 1e-300)
        order = np.argsort(after[0])
        self.cells, self.times = np.append(after[0][order], 1 << 62), np.append(after[1][order], 0).astype(np.float64)
        self.mass = np.bincount(self.cells[:-1] // FOLLOW, self.times[:-1], size)
        self.share = further / np.bincount(classes, further, CLASSES)[classes]
        mass = np.bincount(classes, firsts, CLASSES)
        new = (np.bincount(classes, first, CLASSES) + 0.5) / (mass + 1)
        new[classes[end]] = 1e-6 if firsts[end] else 1 - 1e-9
        new = np.minimum(new, 1 - 1e-9)
        self.new, self.known = np.log(new), np.log1p(-new) - np.log(np.maximum(mass, 1))

    def words(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of p / c as a known word, log10 of p as a new one), given its class, of words of n ids each."""
        first = np.cumsum(n) - n
        before, to, times = self._after(x)
        p = np.log((times + WEIGHT * self.bucket[to]) / (self.mass[before] + WEIGHT) * self.within[x]) + self.on[before]
        p[first] = self.begin[x[first]]
        p[first + n - 1] += self.over[x[first + n - 1]]
        k = self.classes[x[first]]
        return self.known[k] / math.log(10), (np.add.reduceat(p, first) + self.new[k]) / math.log(10)

    def _after(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id before each, its own bucket, and how often that one follows this."""
        before, to = np.append(self.end, x[:-1]), self.follow[x]
        cell = before * FOLLOW + to
        spot = np.searchsorted(self.cells, cell)
        return before, to, np.where(self.cells[spot] == cell, self.times[spot], 0.0)

    def parts(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words of n ids each, log10 of p / c as a known word, given its class; and (fixed, t, s) of each id.

        Given the class of its first id, a new word's p is the product of exp(fixed) * (t + s * the id's class's probability in context).
        """
        first = np.cumsum(n) - n
        before, _, times = self._after(x)
        fixed, t, s = self.on[before] - np.log(self.mass[before] + WEIGHT), times * self.within[x], WEIGHT * self.share[x]
        k = self.classes[x[first]]
        fixed[first], t[first], s[first] = self.begin[x[first]] + self.new[k], 1.0, 0.0
        fixed[first + n - 1] += self.over[x[first + n - 1]]
        return self.known[k] / math.log(10), fixed, t, s

    def class_logs(self, lines: np.ndarray, lengths: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each next id's class, where it is needed; lines are texts' ids one after another, each led and closed by the end id.

        Every text of n ids, its leading one included, predicts n - 1 of them.
        """
        starts = np.cumsum(lengths) - lengths
        given = lengths - 1  # positions that predict
        windows = np.maximum(1, -(-(given - WINDOW) // STRIDE) + 1)
        which = np.repeat(np.arange(len(lengths)), windows)
        number = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        offset = number * STRIDE
        out = np.zeros(int(given.sum()), np.float64)
        need = np.ones(len(out), bool) if need is None else need
        goes = np.cumsum(given) - given
        lead = WINDOW - STRIDE
        rows, goals = self.x.take(lines, 0), self.classes.take(lines)
        opening = np.flatnonzero(number == 0)
        self._groups(opening, 0, which, offset, starts, given, goes, rows, goals, need, out)
        self._groups(np.flatnonzero(number), lead, which, offset, starts, given, goes, rows, goals, need, out)
        return out

    def _groups(self, chosen, lead, which, offset, starts, given, goes, rows, goals, need, out):
        """Scores the positions from ``lead`` on of the chosen windows, a group at a time."""
        span = np.arange(WINDOW)
        w = self.w
        for i in range(0, len(chosen), GROUP):
            t, o = which[chosen[i:i + GROUP]], offset[chosen[i:i + GROUP]]
            left = given[t] - o
            at = np.minimum(span, left[:, None] - 1) + (starts[t] + o)[:, None]
            x = rows.take(at.reshape(-1), 0).reshape(len(t), WINDOW, DIM)
            x += w["p"]
            q, k, v = ((x.reshape(-1, DIM) @ m).reshape(x.shape) for m in self.qkv)
            a = exps(q[:, lead:] @ turned(k), MASK[lead:])
            a *= SEEN[lead:]
            y = a @ v
            y /= row_sums(a)
            # logits only where a word begins or is spelled, but for a few where most are
            spot = (goes[t] + o)[:, None] + span[lead:]
            asked = span[lead:] < left[:, None]
            asked &= need[np.minimum(spot, len(out) - 1)]
            asked, spot, x, y, to = asked.reshape(-1), spot.reshape(-1), x[:, lead:].reshape(-1, DIM), y.reshape(-1, DIM), at[:, lead:].reshape(-1) + 1
            part = np.count_nonzero(asked) < 0.8 * len(asked)
            if part:
                x, y, to = x[asked], y[asked], to[asked]
            h = y @ w["o"]
            h += x
            z = h @ w["g"]
            z += w["b"]
            if len(z) and (z.max() > 60 or z.min() < -60):
                z -= z.max(-1, keepdims=True)
            own = z.reshape(-1).take(np.arange(0, z.size, CLASSES) + goals.take(to))
            own -= np.log(row_sums(np.exp(z, out=z))[:, 0])
            out[spot[asked]] = own if part else own[asked]


def mixed(fame: np.ndarray, fresh: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 of c * 10 ** fame + 10 ** fresh."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(c) + fame * math.log(10), fresh * math.log(10)) / math.log(10)


class Memo(dict):
    """word -> its number; by number what scoring a token of it takes."""

    def __init__(self, enc, scorer: Scorer, known: dict, ends: int):
        self.enc, self.scorer, self.known, self.ends = enc, scorer, known, ends
        self.none = vocabulary(enc)[2]
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new, self.count = [], 1
        # number 0 is the end token
        fame, fresh = self.scorer.words(np.array([self.scorer.end]), np.array([1]))
        self.first, self.c, self.fame, self.fresh = np.array([self.scorer.end]), np.array([self.ends]), fame, fresh
        self.mix = mixed(fame, fresh, self.c)

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = at = self.count
        self.count += 1
        return at

    def settle(self) -> None:
        """Works out the words that were new since the last call."""
        if not self.new:
            return
        x, n = laid_out(self.enc, self.new, self.none)
        fame, fresh = self.scorer.words(x, n)
        c = np.fromiter((self.known.get(w, -1) for w in self.new), np.int64, len(n))
        more = {"first": x[np.cumsum(n) - n], "c": c, "fame": fame, "fresh": fresh, "mix": mixed(fame, fresh, np.maximum(c, 0))}
        for k, v in more.items():
            setattr(self, k, np.concatenate([getattr(self, k), v]))
        self.new = []


class WholeMemo(Memo):
    """``Memo`` where the ids inside words are positions too: what they take is kept an id, and words are ranges of ids."""

    def clear(self) -> None:
        dict.clear(self)
        self.new, self.count, self.size = [], 1, 1
        # number 0 is the end token
        self.x, self.start, self.n, self.c = np.array([self.scorer.end]), np.array([0]), np.array([1]), np.array([self.ends])
        self.fame, self.fixed, self.t, self.s = self.scorer.parts(self.x, self.n)

    def settle(self) -> None:
        if not self.new:
            return
        x, n = laid_out(self.enc, self.new, self.none)
        more = dict(zip(("fame", "fixed", "t", "s"), self.scorer.parts(x, n)), x=x, n=n, start=np.cumsum(n) - n + self.size)
        more["c"] = np.fromiter(map(self.known.get, self.new, repeat(-1)), np.int64, len(n))
        for k, v in more.items():
            setattr(self, k, extended(getattr(self, k), self.size if k in ("x", "fixed", "t", "s") else self.count - len(n), v))
        self.size += len(x)
        self.new = []


def in_context(scorer: Scorer, memo: Memo, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of the class, of p as a new word, of c * known + new) of each token; x are texts' tokens by number, each text closed by the end's."""
    if not isinstance(memo, WholeMemo):
        logs = scorer.class_logs(np.insert(memo.first[x], starts, scorer.end), np.diff(np.append(starts, len(x))) + 1) / math.log(10)
        return logs, memo.fresh[x], memo.mix[x]
    n = memo.n[x]
    first, at = np.cumsum(n) - n, ranges(memo.start[x], n)
    begin = first[starts]
    logs = scorer.class_logs(np.insert(memo.x[at], begin, scorer.end), np.diff(np.append(begin, len(at))) + 1)
    fresh = np.add.reduceat(memo.fixed[at] + np.log(memo.t[at] + memo.s[at] * np.exp(logs)), first) / math.log(10)
    return logs[first] / math.log(10), fresh, mixed(memo.fame[x], fresh, np.maximum(memo.c[x], 0))


def commonest(rows: DataFrame, count: str, most: int) -> Column:
    """A condition that holds for the rows of greatest count, at most ``most`` of them."""
    # counts by sixteenths of a power of two: at most 1024 rows, whatever the corpus
    size_of = F.floor(F.log2(count) * 16)
    held, least = 0, 1 << 20
    for b, k in sorted(((r["b"], r["k"]) for r in rows.groupBy(size_of.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True):
        if held + k > most:
            break
        held, least = held + k, b
    return size_of >= least


def score(docs: DataFrame, training: Column, tokenizer: str, inside: bool = False) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``training`` says, of a row's columns, whether the model learns from it; ``inside``,
    whether the attention model reads and predicts the ids inside words too.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    size, end, _ = vocabulary(enc)
    gathered = stage(gather(docs.where(training), tokenizer, inside), "lm-gathered")
    documents = gathered.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = stage(gathered.where("kind = 0").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "lm-counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    total, distinct = total + documents, distinct + (documents > 0)
    is_hot = commonest(counts, "c", HOT)
    common = counts.where(is_hot).select("word", "c").toArrow()  # at most HOT
    hot = dict(zip(common["word"].to_pylist(), common["c"].to_pylist()))
    cells = gathered.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary times MARKS
    near = np.zeros(size * MARKS, np.int64)
    near[np.frombuffer(b"".join(cells["key"].to_pylist()), "<u4")] = cells["n"].to_numpy()
    near.reshape(size, MARKS)[end] = 0  # how many ends meet between texts depends on partitions, and the end has its own class
    group = clusters(near.reshape(size, MARKS), GROUPS)
    occurs = near.reshape(size, MARKS).sum(1) // (2 * COMPANY)  # each place has as many in its company
    del cells, near
    spells = stage(spelling(counts, tokenizer), "lm-spelling")
    firsts, spelled = np.split(vector(spells.where("kind = 0"), 4 * size), [size])
    firsts[end] = documents
    occurs = occurs if inside else firsts.copy()
    occurs[end] = documents
    classes = classify(occurs, group, end)
    bucket_of = F.broadcast(spark.createDataFrame([(i, int(k)) for i, k in enumerate(buckets(spelled[size:2 * size]))], "id long, bucket long"))  # the vocabulary
    pairs = spells.where("kind = 1").withColumn("id", F.col("at") % size).join(bucket_of, "id")
    pairs = pairs.groupBy((F.expr(f"at div {size}") * FOLLOW + F.col("bucket")).alias("cell")).agg(F.sum("n").cast("int").alias("n")).toArrow()  # at most FOLLOW an id
    after = pairs["cell"].to_numpy(), pairs["n"].to_numpy()

    w = first_weights((np.bincount(classes, occurs, CLASSES) + 1.0) / (occurs.sum() + CLASSES))
    if documents:
        lines = gathered.where("kind = 3").select("h", "line")
        some = lines.where(F.col("h") <= min((1 << 63) - 1, int(SAMPLE / documents * (1 << 64)) - (1 << 63)))
        sample = some.orderBy("h").limit(2 * SAMPLE).toArrow()["line"].to_pylist()
        sample = np.concatenate([np.zeros((0, WINDOW + 1), np.int32), *[tiles(np.frombuffer(x, line_type(size)), end) for x in sample]])
        w = pretrained(w, classes, np.random.default_rng(5).permutation(sample)[:SAMPLE_WINDOWS])
        del sample
        w = trained(lines, end, spark.sparkContext.broadcast((w, classes)), max(1, round(total / SHARD_TOKENS)))
    model = spark.sparkContext.broadcast((Scorer(w, classes, end, firsts, spelled, endings(enc), after), hot))
    room = total + distinct + 1

    def run(batches):
        scorer, known = model.value
        memo = (WholeMemo if inside else Memo)(encoder(tokenizer), scorer, known, documents)
        for b in batches:
            rows, texts, i = b.num_rows, b.column(2), 0
            while i < rows:
                if len(memo) > MEMO:
                    memo.clear()
                held, n, j = [], 0, i
                while j < rows and (j == i or n < SCORED_BYTES):
                    held.append(texts[j].as_py())
                    n += len(held[-1])
                    j += 1
                which, words, per_text = split_words(held)
                numbers = np.fromiter(map(memo.__getitem__, words.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words))
                memo.settle()
                x = np.zeros(len(which) + len(held), np.int64)  # the end is behind every text
                x[np.arange(len(which)) + np.repeat(np.arange(len(held)), per_text)] = numbers[which]
                per_text = per_text + 1
                starts = np.cumsum(per_text) - per_text
                logs, fresh, mix = in_context(scorer, memo, x, starts)
                c = memo.c[x]
                rare, cc = c < 0, np.maximum(c, 0)
                mix, base = logs + mix, np.log10((cc + 1) / room)
                mix[rare] = base[rare] = 0
                yield pa.RecordBatch.from_pydict({
                    "at": b.column(0).slice(i, j - i), "doc_id": b.column(1).slice(i, j - i), "trained": b.column(3).slice(i, j - i), "word": pa.nulls(j - i, pa.binary()), "fame": pa.nulls(j - i, pa.float64()), "fresh": pa.nulls(j - i, pa.float64()),
                    "n_tokens": pa.array(per_text), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), "base": pa.array(np.add.reduceat(base, starts)), "mix": pa.array(np.add.reduceat(mix, starts))})
                left = np.flatnonzero(rare)
                if len(left):
                    whose = np.searchsorted(starts, left, side="right") - 1
                    at_of = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                    k = len(left)
                    yield pa.RecordBatch.from_pydict({
                        "at": pa.array(at_of[whose]), "doc_id": pa.nulls(k, pa.int64()), "trained": pa.nulls(k, pa.bool_()), "word": words.take(pa.array(which[left - whose])),
                        "fame": pa.array(logs[left] + memo.fame[x[left]]), "fresh": pa.array(logs[left] + fresh[left]),
                        "n_tokens": pa.nulls(k, pa.int64()), "n_known": pa.nulls(k, pa.int64()), "base": pa.nulls(k, pa.float64()), "mix": pa.nulls(k, pa.float64())})
                i = j

    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.coalesce(training, F.lit(False)).alias("trained"))
    found = stage(rows.mapInArrow(run, "at long, doc_id long, trained boolean, word binary, fame double, fresh double, n_tokens long, n_known long, base double, mix double"), "lm-scores")
    texts = found.where("word is null").drop("word", "fame", "fresh")
    uncommon = counts.where(~is_hot)
    c = F.coalesce("c", F.lit(0)).cast("double")
    p = F.when(c == 0, F.col("fresh")).otherwise(F.log10(c * F.pow(F.lit(10.0), "fame") + F.pow(F.lit(10.0), "fresh")))
    rest = (found.where("word is not null").select("at", "word", "fame", "fresh").join(uncommon, "word", "left")
            .groupBy("at").agg(F.sum((c > 0).cast("long")).alias("k"), F.sum(F.log10((c + 1) / F.lit(float(room)))).alias("b"), F.sum(p).alias("m")))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return texts.join(rest, "at", "left").select(
        "doc_id", "trained", "n_tokens", (F.col("n_known") + zero("k")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("mix") + zero("m")).alias("score"))
