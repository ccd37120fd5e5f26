"""A gated recurrent language model in numpy with a class-factored output softmax.

``count_words`` counts the tokens of all training texts with Spark. The ``N_FREQUENT`` most frequent words are symbols of
their own. Every other word, seen or not, belongs to one of ``N_SPELLINGS`` symbols by its last two bytes, within which
its share follows its count. Frequent symbols form classes of about equal mass, spellings one more. So log P(word) is
log P(class | state) + log P(symbol | class, state), and for other words + log of its share: every word has a probability
above zero, and they sum up to one.

``encode`` splits each text into words once more and writes its symbols and what its score takes of counts; Arrow finds the
distinct words of many texts, so Python handles a word once in these, not once a token. Training and scoring read symbols.

``train`` goes once over all training texts, in ``ROUNDS`` rounds over disjoint parts of them. In a round each task
starts from the same weights, runs truncated backpropagation over the windows of its texts, with the state carried from
window to window through each whole text, and hands over its weights.
Spark averages them by tokens in blocks of the parameter vector, so neither the driver nor a task holds more than one
model at a time. ``score`` runs complete texts through the model: lanes of many texts advance side by side, a text's
state is carried from window to window and starts anew with each text.

Counts of the ``N_LISTED`` most frequent words go to the workers (a fixed bound); all other words are looked up by a
join on their hash.

Defined results: a null or empty text is the end token alone; a null id counts as held out; repeated rows are rows of
their own; without training texts every word is unseen and the model knows only the class of unknown words; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import materialize, only, small_batches

N_FREQUENT, N_CLASSES, HIDDEN = 2000, 44, 16
SPELLING_BITS = 6
N_SPELLINGS = 1 << SPELLING_BITS
N_LISTED = 1 << 17
ROUNDS = 2
#: Texts side by side and tokens of a window, for training (whose gradients reach back so far) and for scoring.
TRAINING, SCORING = (128, 32), (256, 64)
HELD_TOKENS = 4_000_000  # texts of so many tokens run side by side, so that a long one doesn't leave lanes idle
PART_BYTES = 8_000_000  # texts are split into words so many bytes at a time, with the rest of the last text
N_COUNTED = 1_000_000  # rows that a task's counts hold before they are summed up
BLOCKS = 32
LARGEST = np.float32(60)  # of a logit
LOGITS = 1 << 17  # of several softmaxes taken at once, so that they stay in a core's cache
END = b" "  # no word contains a space


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()  # bytes.lower() changes A-Z only
    words.append(END)
    return words


def distinct_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the number among them of each token, text after text, and how many each text has.

    The tokens are those of ``tokens``; Arrow's functions work on ASCII bytes alone. The last distinct one is the end.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # blanks before the first and after the last word leave empty ones
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    found = coded.dictionary.cast(pa.binary() if pa.types.is_string(words.type) else pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    codes = np.full(len(owner) + len(texts), len(found), np.int32)
    codes[np.arange(len(owner)) + owner] = coded.indices.to_numpy()
    return [*found, END], codes, np.bincount(owner, minlength=len(texts)) + 1


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts, about PART_BYTES of text at a time: in more texts at once fewer words are distinct."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[list[int | None], pa.Array]:
        ids, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        held.clear()
        return ids.to_pylist(), texts

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            had = int(sizes[at - 1]) if at else 0
            end = min(int(np.searchsorted(sizes, had + PART_BYTES - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1]) - had
            at = end
            if size >= PART_BYTES:
                yield out()
                size = 0
    if held:
        yield out()


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the spelling of each word."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = pa.array([w[-2:] for w in words], pa.binary()).dictionary_encode()
    spelled = np.array([spelling(x) for x in last.dictionary.to_pylist()], np.int32)
    return (h ^ np.uint64(1 << 63)).view(np.int64), spelled[last.indices.to_numpy()]


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % N_SPELLINGS


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text; 0 for null."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode())


def count_words(docs: DataFrame) -> DataFrame:
    """Hash, spelling and count of each distinct token of the training texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h, s, c = (np.concatenate(x) for x in zip(*own, strict=True))
            own.clear()
            order = np.argsort(h, kind="stable")
            h = h[order]
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[begins]), pa.array(s[order][begins]), pa.array(np.add.reduceat(c[order], begins))], ["h", "s", "c"])

        for ids, texts in parts(batches):
            learnt = texts.filter(pa.array([fold(x) % 10 > 0 for x in ids], pa.bool_()))
            if not len(learnt):
                continue
            words, codes, _ = distinct_tokens(learnt)
            c = np.bincount(codes, minlength=len(words))
            own.append((*hashes(words), c))
            if sum(len(x[0]) for x in own) > N_COUNTED:
                yield out()
        if own:
            yield out()

    found = only(docs, "doc_id", "text").mapInArrow(rows, "h long, s int, c long")
    return materialize(found.groupBy("h").agg(F.sum("c").alias("c"), F.max("s").alias("s")), "words")


@dataclass
class Lexicon:
    """The listed words by hash: place in order of count. The first ``frequent`` are symbols, followed by the spellings."""

    places: dict[int, int]
    counts: np.ndarray
    total: int
    distinct: int
    frequent: int
    #: Smoothed count of the words of each spelling that aren't frequent, with one unseen word.
    mass: np.ndarray
    #: For each symbol its class; first symbol and end of each class.
    classes: np.ndarray
    bounds: list[tuple[int, int]]

    @property
    def weights(self) -> np.ndarray:
        """Count of each symbol."""
        return np.concatenate([self.counts[: self.frequent], self.mass])


def lexicon(counted: DataFrame, listed: int = N_LISTED, frequent: int = N_FREQUENT, n_classes: int = N_CLASSES) -> Lexicon:
    seen, distinct = np.zeros(N_SPELLINGS), np.zeros(N_SPELLINGS)
    for r in counted.groupBy("s").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # N_SPELLINGS rows at most
        seen[r.s], distinct[r.s] = r.c, r.n
    top = counted.orderBy(F.desc("c"), "h").limit(listed).toArrow()  # listed rows at most
    counts = top["c"].to_numpy().astype(np.float64)
    frequent = min(frequent, len(counts))
    own = top["s"].to_numpy()[:frequent].astype(np.int64)
    mass = seen - np.bincount(own, weights=counts[:frequent], minlength=N_SPELLINGS) + 0.1 * (distinct - np.bincount(own, minlength=N_SPELLINGS) + 1)
    share = np.cumsum(np.sqrt(counts[:frequent]))
    cls = np.minimum((share / (share[-1] if frequent else 1) * n_classes).astype(np.int64), n_classes - 1)
    cls = np.unique(cls, return_inverse=True)[1] if frequent else cls
    cls = np.concatenate([cls, np.full(N_SPELLINGS, int(cls.max(initial=-1)) + 1)])
    bounds = [(int(np.searchsorted(cls, c)), int(np.searchsorted(cls, c, "right"))) for c in range(int(cls[-1]) + 1)]
    return Lexicon(dict(zip(top["h"].to_pylist(), range(len(counts)), strict=True)), counts, int(seen.sum()), int(distinct.sum()), frequent, mass, cls, bounds)


class Network:
    """Gated recurrent units over symbols. Inputs: the symbols, then the start.

    Arrays have a column for each text that runs side by side, so numpy's inner loops are long. States end with a row of
    ones, which the last column of the output weights, the biases, belongs to.
    """

    def __init__(self, lex: Lexicon, hidden: int = HIDDEN, weights: np.ndarray | None = None, seed: int = 11) -> None:
        self.lex, self.hidden = lex, hidden
        k, c = len(lex.classes), len(lex.bounds)
        shapes = {"inputs": (k + 1, 3 * hidden), "update": (3 * hidden, hidden), "out_class": (c, hidden + 1), "out_word": (k, hidden + 1)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.ones = np.ones(max(k, c), np.float32)
        self.cls_of = lex.classes.astype(np.uint8 if c < 256 else np.uint16)
        self.all = np.zeros(size, np.float32) if weights is None else weights
        self.grad = np.zeros(size, np.float32)
        self.w, self.g, at = {}, {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.w[name], self.g[name] = self.all[at : at + n].reshape(shape), self.grad[at : at + n].reshape(shape)
            at += n
        if weights is None:
            rng = np.random.Generator(np.random.PCG64(seed))
            self.w["inputs"][:] = rng.normal(0, 0.1, self.w["inputs"].shape)
            self.w["update"][:] = rng.normal(0, 0.3 / hidden**0.5, self.w["update"].shape)
            counts = lex.weights
            mass = np.array([counts[a:b].sum() for a, b in lex.bounds])
            self.w["out_class"][:, -1] = np.log(mass / mass.sum())
            for a, b in lex.bounds:
                self.w["out_word"][a:b, -1] = np.log(counts[a:b] / counts[a:b].sum())

    def forward(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """inputs and fresh (text begins): steps x lanes; h: hidden x lanes. States (hidden + 1) x steps x lanes, and what backward needs."""
        (n, lanes_), hid, u = inputs.shape, self.hidden, self.w["update"]
        x = np.ascontiguousarray(self.w["inputs"][inputs].transpose(0, 2, 1))
        states, kept = np.ones((hid + 1, n, lanes_), np.float32), []
        for t in range(n):
            if fresh[t].any():
                h = h * ~fresh[t]
            a = u @ h
            zr = x[t, : 2 * hid]  # the gates are 1 / (1 + exp(.))
            zr += a[: 2 * hid]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, a = zr[:hid], zr[hid:], a[2 * hid :]
            new = r * a
            new += x[t, 2 * hid :]
            np.tanh(new, out=new)
            gap = h - new
            kept.append((h, a, z, r, new, gap))
            h = gap * z
            h += new
            states[:hid, t] = h
        return states, kept

    def outputs(self, s: np.ndarray, target: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log P of the target symbols in states s, (hidden + 1) x targets.

        With learn, also the gradient of the mean loss by s without its last row, and the output weights' gradients in self.g.
        Targets are put in order of class, so each softmax is a product over neighbouring columns: that of classes over
        some at a time, that of a class's symbols over its own. Logits of several stand side by side in a core's cache.
        """
        hid, n, w_class = self.hidden, s.shape[1], self.w["out_class"]
        cls = self.cls_of[target]
        order = np.argsort(cls, kind="stable")  # short keys: a radix sort
        cls, target, s = cls[order], target[order], s.take(order, axis=1)
        ends = np.searchsorted(cls, np.arange(len(w_class) + 1)).tolist()
        cut = max(float(np.abs(self.w[x]).sum(axis=1).max()) for x in ("out_class", "out_word")) > LARGEST  # states lie in -1 to 1
        out, ds = np.zeros(n, np.float32), np.zeros((hid, n), np.float32) if learn else None
        self.g["out_class"][:] = 0
        self.g["out_word"][:] = 0
        step = max(1, LOGITS // len(w_class))
        for lo in range(0, n, step):
            self._softmaxes([("out_class", 0, len(w_class), lo, min(n, lo + step))], s, cls, out, ds, cut)
        held, size = [], 0
        for (a, b), lo, hi in zip(self.lex.bounds, ends, ends[1:], strict=False):
            if lo < hi:
                held.append(("out_word", a, b, lo, hi))
                size += (b - a) * (hi - lo)
            if size >= LOGITS:
                self._softmaxes(held, s, target, out, ds, cut)
                held, size = [], 0
        if held:
            self._softmaxes(held, s, target, out, ds, cut)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return out.take(back), ds.take(back, axis=1) if learn else None

    def _softmaxes(self, jobs: list[tuple[str, int, int, int, int]], s: np.ndarray, rows: np.ndarray, out: np.ndarray, ds: np.ndarray | None, cut: bool) -> None:
        """Softmaxes over rows a to b of output weights in columns lo to hi of s, the jobs' columns side by side.

        Adds log P of rows[i] in column i to out and, with ds, the gradients. A gradient by logits is
        (exp(logit) - [target] * total) / (total * targets); the division is made in the states, which have fewer rows.
        """
        first, last, hid = jobs[0][3], jobs[-1][4], self.hidden
        own = np.empty(sum((b - a) * (hi - lo) for _, a, b, lo, hi in jobs), np.float32)
        place, total, blocks, at = np.arange(last - first), np.empty(last - first, np.float32), [], 0
        for name, a, b, lo, hi in jobs:
            blocks.append(own[at : at + (b - a) * (hi - lo)].reshape(b - a, hi - lo))
            np.matmul(self.w[name][a:b], s[:, lo:hi], out=blocks[-1])
            place[lo - first : hi - first] += (rows[lo:hi] - np.int64(a)) * (hi - lo) + (at - lo + first)
            at += blocks[-1].size
        if cut:
            np.minimum(own, LARGEST, out=own)  # exp() stays in range without taking out each column's largest logit
        gain = own.take(place)
        np.exp(own, out=own)
        for block, (_, a, b, lo, hi) in zip(blocks, jobs, strict=True):
            np.matmul(self.ones[: b - a], block, out=total[lo - first : hi - first])  # a product is faster than a sum
        gain -= np.log(total)
        out[first:last] += gain
        if ds is None:
            return
        own[place] -= total
        np.reciprocal(total, out=total)
        total *= np.float32(1 / s.shape[1])
        scaled, back = s[:, first:last] * total, np.empty((hid, last - first), np.float32)
        for block, (name, a, b, lo, hi) in zip(blocks, jobs, strict=True):
            self.g[name][a:b] += block @ scaled[:, lo - first : hi - first].T
            np.matmul(self.w[name][a:b, :hid].T, block, out=back[:, lo - first : hi - first])
        back *= total
        ds[:, first:last] += back

    def backward(self, inputs: np.ndarray, fresh: np.ndarray, kept: list, ds: np.ndarray) -> None:
        """Through the steps of one window; ds: gradient by the states, hidden x steps x lanes."""
        (n, lanes_), hid, u = inputs.shape, self.hidden, self.w["update"]
        gx = np.empty((n, 3 * hid, lanes_), np.float32)
        gu, dh, ut = np.zeros_like(u), np.zeros((hid, lanes_), np.float32), np.ascontiguousarray(u.T)
        ga = np.empty((3 * hid, lanes_), np.float32)
        for t in range(n - 1, -1, -1):
            h, a, z, r, new, gap = kept[t]
            dh += ds[:, t]
            g = gx[t]
            keep = dh * z
            dn = dh - keep
            slope = new * new
            slope *= dn
            dn -= slope
            # minus, since the gates fall in what they are taken of
            np.multiply(keep, gap, out=g[:hid])
            g[:hid] *= z - 1
            ra = r * a
            ra *= r - 1
            np.multiply(ra, dn, out=g[hid : 2 * hid])
            g[2 * hid :] = dn
            ga[: 2 * hid] = g[: 2 * hid]
            np.multiply(dn, r, out=ga[2 * hid :])
            gu += ga @ h.T
            dh = ut @ ga
            dh += keep
            if fresh[t].any():
                dh *= ~fresh[t]
        self.g["update"][:] = gu
        flat = inputs.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.g["inputs"][:] = 0
        self.g["inputs"][flat[begins]] = np.add.reduceat(gx.transpose(0, 2, 1).reshape(-1, 3 * hid).take(order, axis=0), begins, axis=0)


class Adam:
    def __init__(self, size: int, rate: float = 0.01) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate

    def step(self, weights: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * grad
        self.v *= np.float32(0.99)
        self.v += np.float32(0.01) * (grad * grad)
        step = np.sqrt(self.v)
        step *= np.float32((1 - 0.99**self.t) ** -0.5)
        step += np.float32(1e-6)
        np.divide(self.m, step, out=step)
        step *= np.float32(self.rate / (1 - 0.9**self.t))
        weights -= step


def lanes(texts: list[np.ndarray], n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end in lanes of about equal length: tokens and number of the text, -1 where a lane is over."""
    n_lanes = max(1, min(n_lanes, len(texts)))
    fill, put = np.zeros(n_lanes, np.int64), [[] for _ in range(n_lanes)]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        lane = int(fill.argmin())
        put[lane].append(i)
        fill[lane] += len(texts[i])
    token = np.full((int(fill.max(initial=0)), n_lanes), -1, np.int32)
    owner = np.full_like(token, -1)
    for lane, own in enumerate(put):
        at = 0
        for i in own:
            token[at : at + len(texts[i]), lane] = texts[i]
            owner[at : at + len(texts[i]), lane] = i
            at += len(texts[i])
    return token, owner


def windows(lex: Lexicon, texts: list[np.ndarray], n_lanes: int, steps: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, text beginnings, targets and owners of each window, for lanes that still have tokens."""
    token, owner = lanes(texts, n_lanes)
    fresh = np.ones(token.shape, bool)
    fresh[1:] = owner[1:] != owner[:-1]
    start = len(lex.classes)
    inputs = np.full_like(token, start)
    inputs[1:] = np.where(fresh[1:], start, token[:-1])
    live = np.argsort(-(owner >= 0).sum(axis=0), kind="stable")  # longest lanes first
    token, owner, fresh, inputs = token[:, live], owner[:, live], fresh[:, live], inputs[:, live]
    for at in range(0, len(token), steps):
        n = int((owner[at] >= 0).sum())
        cut = slice(at, at + steps), slice(0, n)
        yield np.maximum(inputs[cut], 0), fresh[cut], token[cut], owner[cut]


def run(net: Network, texts: list[np.ndarray], adam: Adam | None = None) -> np.ndarray:
    """Natural log P of each text's symbols. With adam, learns on the way."""
    out, h = np.zeros(len(texts)), None
    for inputs, fresh, target, owner in windows(net.lex, texts, *(TRAINING if adam else SCORING)):
        h = np.zeros((net.hidden, inputs.shape[1]), np.float32) if h is None else np.ascontiguousarray(h[:, : inputs.shape[1]])
        states, kept = net.forward(inputs, fresh, h)
        flat, real = states.reshape(net.hidden + 1, -1), np.flatnonzero(owner.ravel() >= 0)
        whole = len(real) == flat.shape[1]
        logp, ds = net.outputs(flat if whole else flat[:, real], target.ravel()[real], learn=adam is not None)
        out += np.bincount(owner.ravel()[real], weights=logp, minlength=len(texts))
        if adam:
            if not whole:
                full = np.zeros((net.hidden, flat.shape[1]), np.float32)
                full[:, real] = ds
                ds = full
            net.backward(inputs, fresh, kept, ds.reshape(net.hidden, *inputs.shape))
            adam.step(net.all, np.clip(net.grad, -0.1, 0.1))
        h = states[:-1, -1]
    return out


class Reader:
    """Looks words up in a lexicon."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex
        listed = np.fromiter(lex.places, np.int64, len(lex.places))
        self.order = np.argsort(listed)
        self.listed = listed[self.order]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of each word its place among the listed ones (-1 for others), its spelling, its symbol and its hash."""
        h, spelled = hashes(words)
        places = np.full(len(words), -1, np.int64)
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
            places = np.where(self.listed[at] == h, self.order[at], -1)
        return places, spelled, np.where((places < 0) | (places >= self.lex.frequent), self.lex.frequent + spelled, places), h


ENCODED = "row long, doc_id long, n_tokens long, n_listed long, listed double, rare double, other array<long>, times array<int>, symbols binary"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """The symbols of each text, two bytes each, and what its score takes of counts; training and scoring read texts from here."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        reader, row = Reader(lex), TaskContext.get().partitionId() << 32
        logs, mass = np.log10(lex.counts + 0.1), np.log10(lex.mass)
        for ids, texts in parts(batches):
            words, codes, sizes = distinct_tokens(texts)
            places, spelled, symbols, h = reader(words)
            of_list = places >= 0
            listed = np.zeros(len(words))
            listed[of_list] = logs[places[of_list]]
            rare = np.where(symbols >= lex.frequent, listed - mass[spelled], 0)  # unlisted words' counts come later
            owner = np.repeat(np.arange(len(ids)), sizes)
            total = lambda x: np.bincount(owner, weights=x[codes], minlength=len(ids))  # noqa: B023, E731
            unlisted = ~of_list[codes]
            pairs, times = np.unique(owner[unlisted] * len(words) + codes[unlisted], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(ids) + 1) * len(words)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[pairs % len(words)], times.astype(np.int32))]
            coded, at = symbols.astype("<u2")[codes].tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 2
            texts_ = pa.array([coded[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
            columns = [np.arange(row, row + len(ids)), pa.array(ids, pa.int64()), sizes, total(of_list).astype(np.int64), total(listed), total(rare), *lists, texts_]
            row += len(ids)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in ENCODED.split(", ")])

    return materialize(only(docs, "doc_id", "text").mapInArrow(rows, ENCODED), "encoded")


def symbols_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS, hidden: int = HIDDEN, encoded: DataFrame | None = None) -> np.ndarray:
    """The averaged weights after one pass over all training texts; encoded: those of encode, if at hand."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lex)
    weights = Network(lex, hidden).all
    if not lex.total:
        return weights
    encoded = encode(docs, lex) if encoded is None else encoded
    for number in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], number: int = number, start=start) -> Iterator[pa.RecordBatch]:
            lex = shared.value
            net = Network(lex, hidden, start.value.copy())
            adam, held, size, seen = Adam(len(net.all)), [], 0, 0
            for batch in batches:
                keys = [fold(x) for x in batch.column(0).to_pylist()]
                own = batch.column(1).filter(pa.array([bool(k % 10) and k // 10 % rounds == number for k in keys], pa.bool_()))
                held += symbols_of(own)
                size = sum(map(len, held))
                if size >= HELD_TOKENS:
                    run(net, held, adam)
                    held, size, seen = [], 0, seen + size
            if held:
                run(net, held, adam)
                seen += size
            if seen:
                parts = [(net.all.astype(np.float64) * seen)[k::BLOCKS].tobytes() for k in range(BLOCKS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int64()), pa.array([float(seen)] * BLOCKS, pa.float64()), pa.array(parts, pa.binary())], ["block", "n", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, n, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    had = sums.setdefault(block, [0.0, 0.0])
                    had[0], had[1] = had[0] + n, had[1] + np.frombuffer(w, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([x[0] for x in sums.values()], pa.float64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], ["block", "n", "w"])

        kind = "block long, n double, w binary"
        own = encoded.select("doc_id", "symbols").mapInArrow(learn, kind)
        found = own.repartition("block").sortWithinPartitions("block", "n", F.crc32("w")).mapInArrow(add, kind).collect()  # one model
        weights = weights.copy()
        for r in found:
            weights[r.block :: BLOCKS] = np.frombuffer(bytes(r.w), np.float64) / r.n
    return weights


SCORED = "row long, doc_id long, n_tokens long, n_listed long, listed double, rare double, neural double"


def score(docs: DataFrame, counted: DataFrame, lex: Lexicon, weights: np.ndarray, hidden: int = HIDDEN, encoded: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10); encoded: as for train."""
    spark = docs.sparkSession
    encoded = encode(docs, lex) if encoded is None else encoded
    shared, model = spark.sparkContext.broadcast(lex), spark.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value, hidden, model.value)
        names = [x.split()[0] for x in SCORED.split(", ")]
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            at, p = 0, run(net, texts) / np.log(10)
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[at : at + batch.num_rows])], names)
                at += batch.num_rows
            held.clear()
            texts.clear()

        for batch in batches:
            held.append(batch.select(names[:-1]))
            texts += symbols_of(batch.column("symbols"))
            if sum(map(len, texts)) >= HELD_TOKENS:
                yield from out()
        if held:
            yield from out()

    done = materialize(encoded.drop("other", "times").mapInArrow(rows, SCORED), "scored")
    others = encoded.select("row", F.explode(F.arrays_zip("other", "times")).alias("z")).select("row", F.col("z.other").alias("h"), F.col("z.times").alias("times"))
    found = others.join(counted, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("unlisted"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    base = float(np.log10(lex.total + 0.1 * (lex.distinct + 1)))
    unlisted = F.coalesce("unlisted", F.lit(0.0))
    fold_ = F.when(F.col("doc_id").isNull(), 0).otherwise(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10)
    return done.join(found, "row", "left").select(
        "doc_id",
        (fold_ == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_listed") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("listed") + unlisted - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("neural") + F.col("rare") + unlisted).alias("score"),
    )


def op9_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small_batches(spark)
    counted = count_words(docs)
    lex = lexicon(counted)
    encoded = encode(docs, lex)
    return score(docs, counted, lex, train(docs, lex, encoded=encoded), encoded=encoded)
