"""Language-model scoring with a gated recurrent network in numpy.

Words are emitted in two factors. The network predicts a unit: either one of
the most frequent words, or the class of all other words with a given ending.
Its softmax is factored into classes of units (frequency bins) and units in a
class. A word other than the frequent ones then comes from its ending's class by
its add-0.1 share there, with one share for the words never seen, so the
probabilities of all words sum to one.

Counts cover all words of all training documents. The network is trained by
truncated backpropagation on every token of every training document: texts run
side by side in streams, window by window, each with its state carried on to
the end. Trainers of a fixed number of tokens pass their texts once a round,
and their weights are averaged. Scoring carries the state through the whole
document in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.storage import discard, materialise
from loamline.llm.words import MAX_CACHED, keep_freed, remainder, slices, text_bytes

CLASSES, MEMBERS, HIDDEN = 32, 32, 16
UNITS = CLASSES * MEMBERS
FREQUENT = 700
SUFFIX = 3
HOT = 300_000
ADD = 0.1
#: No word is empty, so the empty word stands for the end of a text.
END = b""
#: Tokens of a window: how far backpropagation reaches.
WINDOW = 32
#: Texts learned, or scored, side by side.
STREAMS = 256
#: Tokens whose units a scoring worker holds before it scores them.
HELD = 4_000_000


@dataclass
class Lexicon:
    """What the workers know of words: the hot words' numbers, and units by ending for all others."""

    hot: dict[bytes, int]
    hot_unit: np.ndarray
    hot_within: np.ndarray  # log10 of the word's share of its unit
    hot_base: np.ndarray  # log10(count + ADD)
    suffix: dict[bytes, int]
    other: int
    unit_size: np.ndarray  # log10 of a unit's sum of count + ADD
    mass: np.ndarray = field(repr=False)

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units of the words, and the hot words' numbers (-1: not hot)."""
        n = np.fromiter(map(self.hot.get, words, repeat(-1)), np.int64, len(words))
        unit = np.where(n >= 0, self.hot_unit[np.maximum(n, 0)], 0) if len(self.hot_unit) else np.zeros(len(n), np.int64)
        for i in np.flatnonzero(n < 0).tolist():
            unit[i] = self.suffix.get(words[i][-SUFFIX:], self.other)
        return unit, n


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes, lower case; empty: the ends of texts), ``n`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            for text in text_bytes(batch):
                seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > MAX_CACHED:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame) -> Lexicon:
    """Pick hot words, frequent words and endings from the counts; all three are of fixed numbers."""
    # A cut by levels of about 1 %, so that no task sorts the vocabulary: the words above it are at most HOT.
    level = F.floor(64 * F.log2("n")).cast("int")
    left, cut = HOT, -1
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # some thousand levels
        left -= row.words
        if left < 0:
            cut = row.level
            break
    top = counts.where(level > cut).toArrow()
    pairs = sorted(zip((-top.column("n").to_numpy()).tolist(), [w or b"" for w in top.column("word").to_pylist()]))
    words, n = [w for _, w in pairs], -np.array([x for x, _ in pairs], np.int64)
    frequent = words[:FREQUENT]
    spark = counts.sparkSession
    known = F.broadcast(spark.createDataFrame([(bytearray(w),) for w in frequent], "word binary"))
    ending = F.substring("word", -SUFFIX, SUFFIX)
    sums = counts.join(known, "word", "left_anti").groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
    sums = materialise(sums, "lm-endings")
    ends = sums.orderBy(F.desc("n"), "ending").limit(UNITS - len(frequent) - 1).collect()
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    sizes = [(int(x), 0) for x in n[: len(frequent)]] + [(e.n, e.types) for e in ends]
    sizes.append((total.n - sum(e.n for e in ends), total.types - sum(e.types for e in ends)))
    rank = np.argsort([-x for x, _ in sizes], kind="stable")
    unit = np.empty(len(sizes), np.int64)
    unit[rank] = np.arange(len(sizes))
    mass, size = np.zeros(UNITS), np.zeros(UNITS)
    for i, (x, types) in enumerate(sizes):
        mass[unit[i]] = x
        size[unit[i]] = 0.0 if i < len(frequent) else np.log10(x + ADD * (types + 1))
    suffix = {bytes(e.ending): int(unit[len(frequent) + i]) for i, e in enumerate(ends)}
    out = Lexicon({w: i for i, w in enumerate(words)}, np.empty(0, np.int64), np.empty(0), np.log10(n + ADD), suffix, int(unit[-1]), size, mass)
    out.hot_unit = np.array([unit[i] if i < len(frequent) else suffix.get(w[-SUFFIX:], out.other) for i, w in enumerate(words)], np.int64)
    out.hot_within = np.array([0.0 if i < len(frequent) else out.hot_base[i] - size[out.hot_unit[i]] for i in range(len(words))])
    return out


def windows(texts: Iterator[tuple[int, np.ndarray]], streams: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts, each (key, UNITS and then its units), side by side in up to ``streams`` streams of WINDOW tokens at a time.

    Yields inputs, targets (-1: none) and keys as [steps, streams], and from
    which stream of the window before each one goes on (-1: a new one). A text
    begins where the input is UNITS, right after the end of another one.
    """
    live: list[list] = []
    came: list[int] = []
    while True:
        new = [[k, u, 0] for k, u in islice(texts, streams - len(live))]
        live, came = live + new, came + [-1] * len(new)
        if not live:
            return
        x, y, key = np.zeros((len(live), WINDOW), np.int16), np.full((len(live), WINDOW), -1, np.int16), np.zeros((len(live), WINDOW), np.int32)
        for i, own in enumerate(live):
            t = 0
            while t < WINDOW:
                k, u, at = own
                n = min(WINDOW - t, len(u) - 1 - at)
                x[i, t : t + n], y[i, t : t + n], key[i, t : t + n] = u[at : at + n], u[at + 1 : at + 1 + n], k
                own[2], t = at + n, t + n
                if own[2] == len(u) - 1:
                    following = next(texts, None)
                    if following is None:
                        break
                    own[:] = [*following, 0]
        yield x.T, y.T, key.T, np.array(came)
        came = [i for i, (_, u, at) in enumerate(live) if at < len(u) - 1]
        live = [live[i] for i in came]


def carried(h: np.ndarray, came: np.ndarray) -> np.ndarray:
    """States of the streams of a window, from those at the end of the one before."""
    out = np.zeros((len(came), HIDDEN), h.dtype)
    out[came >= 0] = h[came[came >= 0]]
    return out


def row_sums(x: np.ndarray) -> np.ndarray:
    """``x.sum(axis=1)`` of a narrow table, as a product: numpy's sums of short rows cost several times as much."""
    return x @ np.ones(x.shape[1], x.dtype)


def crossed(a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """``a.T @ b`` of two long and narrow tables, by blocks of rows, which stay in the cache."""
    n = len(a) // rows * rows
    blocks = a[:n].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, rows, b.shape[1])
    return blocks.sum(axis=0) + a[n:].T @ b[n:]


class Gru:
    """Parameters, views of one flat array: X (input table, unit UNITS is the start of a text), U, class softmax Wc bc, unit softmax Wu bu."""

    SHAPES = {"X": (UNITS + 1, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "Wu": (CLASSES, HIDDEN, MEMBERS), "bu": (CLASSES, MEMBERS)}
    SIZE = sum(int(np.prod(x)) for x in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def initial(cls, mass: np.ndarray, seed: int = 1) -> Gru:
        """Weights near zero and biases that give the units their corpus shares."""
        rng, h = np.random.default_rng(seed), HIDDEN
        m = (mass + 1).reshape(CLASSES, MEMBERS)
        parts = [rng.normal(0, 0.3, (UNITS + 1, 3 * h)), rng.normal(0, 0.25, (h, 3 * h)), rng.normal(0, 0.1, (h, CLASSES)), np.log(m.sum(1) / m.sum()), rng.normal(0, 0.1, (CLASSES, h, MEMBERS)), np.log(m / m.sum(1, keepdims=True))]
        return cls(np.concatenate([p.ravel() for p in parts]).astype(np.float32))

    def states(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """By step: the state before it, the gates z and r, the recurrent input of the candidate, the candidate, and the state after it."""
        k, kind = HIDDEN, self.flat.dtype
        a, keep = self.X[x], (x != UNITS).astype(kind)[:, :, None]
        steps, rows = x.shape
        before, gates, inner, cand, after = (np.empty((steps, rows, n), kind) for n in (k, 2 * k, k, k, k))
        anew = (x == UNITS).any(axis=1)
        for t in range(steps):
            h = before[t] = h * keep[t] if anew[t] else h
            g, zr, n = h @ self.U, gates[t], cand[t]
            np.add(a[t, :, : 2 * k], g[:, : 2 * k], out=zr)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            inner[t] = g[:, 2 * k :]
            np.multiply(zr[:, k:], inner[t], out=n)
            n += a[t, :, 2 * k :]
            np.tanh(n, out=n)
            h = np.subtract(n, h, out=after[t])
            h *= zr[:, :k]
            h += before[t]
        return before, gates, inner, cand, after

    def _units(self, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """Order of the rows by class, the classes' places in it, and exp of the logits of the units in the row's class, in that order."""
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(CLASSES + 1)).tolist()
        places = [(k, cuts[k], cuts[k + 1]) for k in range(CLASSES) if cuts[k] < cuts[k + 1]]
        s, e = s[order], np.empty((len(c), MEMBERS), s.dtype)
        for k, a, b in places:
            np.matmul(s[a:b], self.Wu[k], out=e[a:b])
            e[a:b] += self.bu[k]
        return order, places, np.exp(e, out=e)

    def log10(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of the target units at the states ``h``."""
        c, m = target // MEMBERS, target % MEMBERS
        x = np.exp(h @ self.Wc + self.bc)
        out = np.log10(x[np.arange(len(c)), c] / row_sums(x))
        order, _, e = self._units(h, c)
        out[order] += np.log10(e[np.arange(len(c)), m[order]] / row_sums(e))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[Gru, np.ndarray]:
        """Gradient of the mean loss over [steps, rows] units (y of -1: none), and the last state. The state before ``x`` is taken as given."""
        k = HIDDEN
        before, gates, inner, cand, after = self.states(x, h)
        grad = Gru(np.zeros_like(self.flat))
        target = y.reshape(-1)
        use = np.flatnonzero(target >= 0)
        s, target = after.reshape(-1, k)[use], target[use]
        c, m = target // MEMBERS, target % MEMBERS
        share = 1 / max(1, len(use))
        p = np.exp(s @ self.Wc + self.bc)
        p *= (share / row_sums(p))[:, None]
        p[np.arange(len(c)), c] -= share
        grad.Wc += crossed(s, p)
        grad.bc += p.sum(axis=0)
        ds = p @ self.Wc.T
        order, places, q = self._units(s, c)
        q *= (share / row_sums(q))[:, None]
        q[np.arange(len(c)), m[order]] -= share
        s, back = s[order], np.empty_like(s)
        for j, a, b in places:
            grad.Wu[j] += s[a:b].T @ q[a:b]
            grad.bu[j] += q[a:b].sum(axis=0)
            np.matmul(q[a:b], self.Wu[j].T, out=back[a:b])
        ds[order] += back
        above = np.zeros((after.shape[0] * after.shape[1], k), s.dtype)
        above[use] = ds
        above = above.reshape(after.shape)
        z, r = np.ascontiguousarray(gates[:, :, :k]), np.ascontiguousarray(gates[:, :, k:])
        kept = 1 - z
        by_n = np.multiply(cand, cand)
        np.subtract(1, by_n, out=by_n)
        by_n *= z
        inward = np.empty((*z.shape[:2], 3, k), s.dtype)  # through the recurrent product
        change = cand - before
        change *= z
        np.multiply(change, kept, out=inward[:, :, 0])
        through = by_n * r
        inward[:, :, 2] = through
        through *= inner
        np.multiply(through, np.subtract(1, r, out=r), out=inward[:, :, 1])
        fresh = x == UNITS
        anew, keep = fresh.any(axis=1), (~fresh).astype(s.dtype)[:, :, None]
        down, dh = np.empty_like(above), np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            dh = np.add(dh, above[t], out=down[t])
            g = (inward[t] * dh[:, None]).reshape(-1, 3 * k)
            dh = dh * kept[t]
            dh += g @ self.U.T
            if anew[t]:
                dh *= keep[t]
        d_in = np.multiply(inward, down[:, :, None], out=inward)
        grad.U += crossed(before.reshape(-1, k), d_in.reshape(-1, 3 * k))
        np.multiply(by_n, down, out=d_in[:, :, 2])
        d_in = d_in.reshape(-1, 3 * k)
        unit = x.reshape(-1)
        order = np.argsort(unit, kind="stable")
        start = np.flatnonzero(np.diff(unit[order], prepend=-1))
        grad.X[unit[order][start]] += np.add.reduceat(d_in[order], start)
        return grad, after[-1]


def _units(docs: DataFrame, words) -> DataFrame:
    """All columns of every row but its text, and what training and scoring need of that, so that no text is split again.

    ``slot`` (a hash that orders and deals the rows), ``tokens``, what needs
    no network (``hot`` and ``base`` for the hot words, ``net``), the ``rare``
    words, and the start with its units, as int16.
    """
    others = [x for x in docs.schema if x.name != "text"]
    schema = T.StructType([*others, *T.StructType.fromDDL("slot long, tokens long, hot long, base double, net double, rare array<binary>, units binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = words.value
        # Number -1 (not hot) takes the last entry.
        base_of, within_of = np.append(lex.hot_base, 0.0), np.append(lex.hot_within, 0.0)
        for part in slices(batches):
            whole = text_bytes(part)
            texts = [[*t.lower().split(), END] for t in whole]
            if not texts:
                continue
            # Copies of a text are dealt to different trainers.
            slots = [xxhash.xxh64_intdigest(b"%s:%s" % (str(i).encode(), t)) >> 1 for i, t in zip(part.column("doc_id").to_pylist(), whole)]
            tokens = list(chain.from_iterable(texts))
            unit, number = lex.numbers(tokens)
            n = np.array([len(t) for t in texts], np.int64)
            start = np.cumsum(n) - n
            cold = number < 0
            net_of = np.add.reduceat(within_of[number] - np.where(cold, lex.unit_size[unit], 0.0), start)
            left = cold.nonzero()[0].tolist()
            ends = np.searchsorted(left, start + n).tolist()
            rare = pa.array([[tokens[i] for i in left[a:b]] for a, b in zip([0, *ends], ends)], pa.list_(pa.binary()))
            units = [x.tobytes() for x in np.split(np.insert(unit, start, UNITS).astype("<i2"), start[1:] + np.arange(1, len(n)))]
            columns = [pa.array(slots, pa.int64()), pa.array(n), pa.array(n - np.add.reduceat(cold.astype(np.int64), start)), pa.array(np.add.reduceat(base_of[number], start)), pa.array(net_of), rare, pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(x.name) for x in others), *columns], names=schema.names)

    return docs.select(*(x.name for x in others), "text").mapInArrow(run, schema)


def learn(model: Gru, texts: Iterator[np.ndarray], rate: float, streams: int) -> int:
    """Pass all the texts once, with a step of Adam for every window of the streams; how many tokens there were."""
    m, v = np.zeros_like(model.flat), np.zeros_like(model.flat)
    done, steps, h = 0, 0, np.zeros((0, HIDDEN), model.flat.dtype)
    for x, y, _, came in windows(((0, u) for u in texts), streams):
        grad, h = model.gradient(x, y, carried(h, came))
        g, steps, done = grad.flat, steps + 1, done + int((y >= 0).sum())
        np.clip(g, -0.1, 0.1, out=g)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        pace = rate * min(1, steps / 20) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
        model.flat -= np.float32(pace) * m / (np.sqrt(v) + np.float32(1e-7))
    return done


def _train(texts: DataFrame, model: Gru, trainers: int, rate: float, streams: int) -> Gru:
    """One round: every trainer starts from ``model`` and streams its texts once; the result is the mean by tokens."""
    start = texts.sparkSession.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        own = Gru(start.value.copy())
        seen = learn(own, (np.frombuffer(u.as_py(), "<i2") for batch in batches for u in batch.column("units")), rate, streams)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([own.flat.tobytes()], pa.binary())], names=["n", "weights"])

    dealt = texts.select("slot", "units").repartition(trainers, "slot").sortWithinPartitions("slot", "units")
    total, n = 0.0, 0
    trained = materialise(dealt.mapInArrow(run, "n long, weights binary"), "lm-trained")  # all trainers at once
    for row in trained.toLocalIterator():  # a file's weights at a time
        total, n = total + row.n * np.frombuffer(row.weights, np.float32).astype(np.float64), n + row.n
    discard(trained)
    return Gru((total / n).astype(np.float32)) if n else model


def train(texts: DataFrame, mass: np.ndarray, rounds: int = 2, rate: float = 0.01, streams: int = STREAMS, per_trainer: int = 4_000_000, most_trainers: int = 256) -> Gru:
    """Average of trainers over ``rounds`` rounds, each of which passes its share of the texts (of ``_units``) once, whatever their number.

    A trainer streams about ``per_trainer`` tokens; in a corpus that would need
    over ``most_trainers`` each streams more, since their weights meet on the
    driver. No text is left out.
    """
    n = texts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    trainers = max(1, min(most_trainers, -(-n // (per_trainer * rounds))))
    model = Gru.initial(mass)
    for i in range(rounds):
        model = _train(texts.where(F.pmod("slot", F.lit(rounds)) == i), model, trainers, rate / (1 + i), streams)
    return model


def score_units(model: Gru, texts: list[np.ndarray], streams: int = STREAMS) -> np.ndarray:
    """log10 probability of each text's units; the state starts anew with each text and runs through all of it."""
    out, h = np.zeros(len(texts)), np.zeros((0, HIDDEN), model.flat.dtype)
    longest_first = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for x, y, key, came in windows(((i, np.append(np.int16(UNITS), texts[i].astype(np.int16))) for i in longest_first), streams):
        after = model.states(x, carried(h, came))[-1]
        h = after[-1]
        target = y.reshape(-1)
        use = np.flatnonzero(target >= 0)
        out += np.bincount(key.reshape(-1)[use], model.log10(after.reshape(-1, HIDDEN)[use], target[use]), len(texts))
    return out


def _scored(texts: DataFrame, model) -> DataFrame:
    """The rows of ``_units`` without their units and rare words; ``net`` has the network's log10 probability added."""
    rest = texts.drop("slot", "units", "rare").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        net = Gru(model.value)
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []  # rows that wait for the network, and their units

        def rows() -> Iterator[pa.RecordBatch]:
            total = score_units(net, [u for _, units in held for u in units])
            for part, units in held:
                own, total = total[: len(units)], total[len(units) :]
                at = part.schema.get_field_index("net")
                yield part.set_column(at, "net", pa.array(part.column(at).to_numpy() + own))
            held.clear()

        waiting = 0
        for part in slices(batches):
            units = [np.frombuffer(u.as_py(), "<i2")[1:] for u in part.column("units")]
            held.append((part.select(rest.names), units))
            waiting += sum(map(len, units))
            if waiting >= HELD:
                yield from rows()
                waiting = 0
        if held:
            yield from rows()

    return texts.select(*rest.names, "units").mapInArrow(run, rest)


def score(docs: DataFrame, parts: int = 10, held_out: int = 0, streams: int = STREAMS) -> DataFrame:
    """Train on the rows whose crc32 of the id mod ``parts`` isn't ``held_out`` and score all rows.

    In: ``doc_id``, ``text``; other columns are ignored. Out, one row per input
    row: ``doc_id``, ``held_out`` (null id: false), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-0.1 unigrams), ``score`` (the model).
    A null or empty text is its end token alone. Repeated rows count each time.
    Words beyond the hot ones get their counts by a join on the word, so no
    vocabulary of the whole corpus is held by any process. Texts of any length
    are learned and scored whole. An empty table gives an empty one; without a
    training row all words are unseen. ``streams`` texts give a step of the
    training together, so few texts are learned better with few streams.
    """
    rows = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False)).alias("held_out"))
    teach = rows.where("not held_out")
    counts = materialise(count_words(teach), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    lex = lexicon(counts)
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(lex)
    texts = materialise(_units(rows, words).withColumn("row", F.monotonically_increasing_id()), "lm-units")
    net = sc.broadcast(train(texts.where("not held_out"), lex.mass, streams=streams).flat)
    scored = materialise(_scored(texts, net), "lm-scored")
    rare = texts.select("row", F.explode("rare").alias("of"))
    found = rare.join(counts, rare.of == counts.word, "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("more"), F.count("n").alias("more_known"))
    out = scored.join(materialise(found, "lm-rare"), "row", "left")
    discard(texts)
    more, norm = F.coalesce("more", F.lit(0.0)), float(np.log10(total.n + ADD * (total.v + 1)))
    return out.select("doc_id", "held_out", F.col("tokens").alias("n_tokens"), (F.col("hot") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("tokens") * norm).alias("base_score"), (F.col("net") + more).alias("score"))
