"""Substring dedup by collinear chaining of shared k-mer seeds.

A document's k-word runs are its seeds where their own hash says so, one in
``EVERY``; that a run is a seed doesn't depend on its surroundings, so edited
passages keep the seeds between their edits. Seeds are sorted over the cluster
by document, and each occurrence is joined with the one in the document before
it and with the first one. A seed in n documents thus gives fewer than 2 n
matches and never all pairs. The matches of two documents are chained in order
with gap costs through a Fenwick tree, and each chain is aligned word by word
to find the exact ends and the similarity of a fuzzy passage.

Equal runs of ``min_words`` words are found whatever the hashes choose and
however many documents share their seeds (``Anchors``, ``_windows``).

A document is an id and a text. ``at`` packs the key that tells apart the
texts of a repeated id (``text_key``), the number of a word, and whether a long
run begins there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm import id_filter
from loamline.llm.storage import discard, materialise, sent_if_small
from loamline.llm.words import WordHashes, gram_hashes, mix, slices, text_bytes

K, EVERY = 4, 4
#: Long seeds, which few documents share by chance: they find passages whose parts occur earlier in different documents.
LONG, LONG_EVERY = 24, 16
#: A gap of this many words in both documents costs as much as a seed brings.
GAP = 40
#: Insertions and deletions that add up to more words than this end a passage.
SHIFT = 32
#: Words beyond a chain's ends that the alignment may take in.
REACH = 40
#: Gaps up to this many words on either side are aligned; longer ones count as unmatched.
ALIGNED = 64
KEY_BITS = 31


def numbered(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds with their number among equal ones of the text mixed in, so that the nth meets the nth; repeats also as first ones.

    Texts that repeat themselves then match place by place, and a passage that
    only one of them repeats still matches every time.
    """
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return mix(h), pos
    part = np.flatnonzero(np.isin(h, twice))
    by = np.argsort(h[part], kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(h[part][by]) != 0))
    nth = np.zeros(len(h), np.uint64)
    nth[part[by]] = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    again = nth > 0
    with np.errstate(over="ignore"):
        return np.concatenate([mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), mix(h[again])]), np.concatenate([pos, pos[again]])


def _long(k: int, min_words: int) -> int:
    """Words of a long seed: whole short runs, and no more than a passage has."""
    return max(k, min(LONG, min_words) // k * k)


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` consecutive entries."""
    done, n = 1, len(x) - width + 1
    while 2 * done <= width:
        x, done = best(x[:-done], x[done:]), 2 * done
    return best(x[:n], x[width - done : width - done + n])


def _joined(h: np.ndarray, at: np.ndarray, size: int, k: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words at the places ``at``, from those of the runs of k words that they consist of."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, size, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
    return mix(out)


class Anchors:
    """The smallest long runs by hash of each window of ``min_words`` words: texts that share a window share its anchor.

    ``runs`` has the hash of each run of ``_long`` words, ``least`` the smallest
    of each window, ``at`` the places of these, the anchors. ``around`` is for
    each the hash of all windows that it can be the smallest of, its
    surroundings, under the upper half of its own hash.
    """

    def __init__(self, h: np.ndarray, n_words: int, k: int, min_words: int):
        self.size = _long(k, min_words)
        self.runs = _joined(h, np.arange(n_words - self.size + 1), self.size, k)
        self.side = min_words - self.size
        self.least = _sliding(np.minimum, self.runs, self.side + 1)
        edge = np.zeros(self.side, np.uint64)
        self.at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, self.least, edge]), self.side + 1) == self.runs)
        # Where a text begins or ends, the windows reach less far, which counts for the hash.
        self.around = np.zeros(len(self.at), np.uint64)
        with np.errstate(over="ignore"):
            for step in (*range(-self.side, self.side, self.size), self.side):
                there = np.clip(self.at + step, 0, len(self.runs) - 1)
                self.around = self.around * np.uint64(0x9E3779B97F4A7C15) + self.runs[there] + mix((there - self.at).astype(np.uint64))
        own = mix(self.runs[self.at])
        self.around = own >> np.uint64(32) << np.uint64(32) | mix(self.around) >> np.uint64(32)

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that have a wanted anchor (by its number), and the places of these anchors."""
        places = self.at[wanted]
        where = places[:, None] + np.arange(-self.side, 1)
        fits = (where >= 0) & (where < len(self.least))
        fits &= self.least[np.clip(where, 0, len(self.least) - 1)] == self.runs[places][:, None]
        at, where = np.broadcast_to(places[:, None], where.shape)[fits], where[fits]
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for step in (*range(0, self.side, self.size), self.side):
                out = out * np.uint64(0x9E3779B97F4A7C15) + self.runs[where + step]
            # The place of the anchor tells apart the times that it is in a window.
            return mix(out + np.uint64(2) * (at - where).astype(np.uint64) + np.uint64(1)), at


def text_seeds(words: np.ndarray, k: int, every: int, min_words: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of a text's word hashes, their places (twice the word's number, and one more for a long run) and which are of surroundings.

    The number of a run among equal ones counts for its hash, so of a run that
    a text repeats some occurrences are always chosen. Long runs are chosen by
    their first words and hashed from the short runs that they consist of.
    Anchors with their surroundings come last.
    """
    h = gram_hashes(words, k)
    found, at = numbered(h, np.arange(len(h)))
    chosen = found % np.uint64(every) == 0
    size = _long(k, min_words)
    starts = h[: max(0, len(words) - size + 1)]
    long = np.flatnonzero(starts >> np.uint64(32) < np.uint64((1 << 32) // LONG_EVERY))
    whole, long = numbered(_joined(h, long, size, k), long)
    seed, place = [found[chosen], whole], [2 * at[chosen], 2 * long + 1]
    n = 0
    if len(words) >= max(k, min_words):
        own = Anchors(h, len(words), k, min_words)
        n = len(own.at)
        seed.append(own.around)
        place.append(2 * own.at + 1)
    seed, place = np.concatenate(seed), np.concatenate(place)
    return seed, place, np.arange(len(seed)) >= len(seed) - n


def _text_key(text: Column | str = "text") -> Column:
    return F.greatest(F.xxhash64(text).bitwiseAND(F.lit((1 << KEY_BITS) - 1)), F.lit(1))


def _repeated(docs: DataFrame) -> Broadcast | None:
    """Filter of the ids of more than one row; nothing where there are none, as is usual."""
    ids = materialise(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).count().where("count > 1").select("of"), "chain-repeated")
    return None if ids.isEmpty() else id_filter.build(ids, "of")


def _with_at(docs: DataFrame, repeated: Broadcast | None) -> DataFrame:
    """``doc_id``, ``key`` and ``text``: the key is 0 but for ids that may be repeated."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0).cast("long") if repeated is None else _text_key()).alias("key"), "text")


def _keys(batch: pa.RecordBatch, repeated: Broadcast | None) -> tuple[np.ndarray, np.ndarray]:
    ids, key = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
    return ids, key if repeated is None else np.where(id_filter.may_hold(repeated.value, ids), key, 0)


def _occurrences(docs: DataFrame, k: int, every: int, min_words: int, repeated: Broadcast | None) -> DataFrame:
    """``doc_id``, ``at``, ``seed`` of each document, lower-cased, and whether the seed is one of ``surroundings``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            ids, keys = _keys(batch, repeated)
            found = [text_seeds(hashes.of(text.lower().split()), k, every, min_words) for text in text_bytes(batch)]
            of = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
            seed, place, around = (np.concatenate([*(x[i] for x in found), np.empty(0, kind)]) for i, kind in enumerate((np.uint64, np.int64, bool)))
            out = [ids[of], keys[of] << 32 | place, seed.view(np.int64), around]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "at", "seed", "surroundings"])

    return _with_at(docs, repeated).mapInArrow(run, "doc_id long, at long, seed long, surroundings boolean")


def seeds(docs: DataFrame, k: int = K, every: int = EVERY, repeated: Broadcast | None = None, min_words: int = 50) -> DataFrame:
    """``doc_id``, ``at``, ``seed`` of each document: about one in ``every`` runs of k words and one in LONG_EVERY of LONG words."""
    return _occurrences(docs, k, every, min_words, repeated).where("not surroundings").drop("surroundings")


def _class_key(seed: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a seed in a document."""
    with np.errstate(over="ignore"):
        return mix(mix(mix(seed.view(np.uint64)) + ids.view(np.uint64)) + keys.view(np.uint64)).view(np.int64)


def _left_open(docs: DataFrame, occurrences: DataFrame, done: DataFrame, k: int, min_words: int, repeated: Broadcast | None) -> DataFrame:
    """Matches of the texts that have a window of ``min_words`` words in common outside the passages in ``done``.

    Every window has an anchor. An anchor is open in a text that isn't the first
    to have it, if no passage holds all windows around it there. Texts that have
    an anchor in the same surroundings have the same windows there: an open one
    meets the first text with its surroundings. If an anchor has several, the
    windows of these first texts are all that there are, and each meets the
    first text that has it.
    """
    size = _long(k, min_words)
    side, place = min_words - size, F.shiftright(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    anchors = occurrences.where("surroundings").select("doc_id", F.shiftright("at", 32).alias("key"), "at", "seed", F.shiftright("seed", 32).alias("own"))
    text = F.struct("doc_id", "key")
    groups = anchors.groupBy(F.col("own").alias("of")).agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("of", "low")
    shared = materialise(anchors.join(groups, F.col("own") == F.col("of")).drop("of"), "chain-shared")
    opened = _outside(shared.where(text != F.col("low")), "key", done, F.greatest(place - side, F.lit(0)), place + size + side)
    opened = materialise(opened.select("doc_id", "at", "seed", "own"), "chain-open")
    live = shared.join(opened.select(F.col("own").alias("of")).distinct(), F.col("own") == F.col("of"), "left_semi")
    firsts = materialise(live.groupBy("own", "seed").agg(F.min(F.struct("doc_id", "key", "at")).alias("w")).select("own", "seed", "w.*"), "chain-classes")
    discard(shared)
    first = firsts.select(F.col("seed").alias("of"), F.col("doc_id").alias("ref_doc_id"), F.col("at").alias("ref_at"))
    other = (F.col("doc_id") != F.col("ref_doc_id")) | (F.shiftright("at", 32) != F.shiftright("ref_at", 32))
    met = materialise(opened.join(first, F.col("seed") == F.col("of")).where(other).select("doc_id", "at", "ref_doc_id", "ref_at"), "chain-alike")
    discard(opened)
    windows = _windows(docs, firsts, k, min_words, repeated)
    return met if windows is None else met.union(matches(windows, with_last=False))


def _outside(rows: DataFrame, key: str, done: DataFrame, start: Column, end: Column) -> DataFrame:
    """The rows whose words from ``start`` to ``end`` no passage in ``done`` holds."""
    spans = done.groupBy(F.col("doc_id").alias("in"), F.col("text_key").alias("in_key")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    held = F.exists("spans", lambda x: (x["start_word"] <= start) & (x["end_word"] >= end))
    return rows.join(spans, (F.col("doc_id") == F.col("in")) & (F.col(key) == F.col("in_key")), "left").where(~F.coalesce(held, F.lit(False))).select(*rows.columns)


def _windows(docs: DataFrame, firsts: DataFrame, k: int, min_words: int, repeated: Broadcast | None) -> DataFrame | None:
    """``doc_id``, ``at``, ``seed``: windows of ``min_words`` words in the texts of ``firsts`` whose anchors have several surroundings; nothing if there are none."""
    several = firsts.groupBy(F.col("own").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, ids, keys = (batch.column(c).to_numpy() for c in ("seed", "doc_id", "key"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_class_key(seed, ids, keys))], names=["doc_id", "class"])

    several = materialise(firsts.join(several, F.col("own") == F.col("of"), "left_semi").select("seed", "doc_id", "key").mapInArrow(numbers, "doc_id long, class long"), "chain-several")
    discard(firsts)
    if several.isEmpty():
        return None
    of, wanted = id_filter.build(several, "doc_id"), id_filter.build(several, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            batch = batch.filter(pa.array(id_filter.may_hold(of.value, batch.column("doc_id").to_numpy())))
            ids, keys = _keys(batch, repeated)
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
            for doc, key, text in zip(ids, keys, text_bytes(batch)):
                words = hashes.of(text.lower().split())
                if len(words) < max(k, min_words):
                    continue
                own = Anchors(gram_hashes(words, k), len(words), k, min_words)
                same = np.full(len(own.at), doc, np.int64), np.full(len(own.at), key, np.int64)
                found, at = own.windows(np.flatnonzero(id_filter.may_hold(wanted.value, _class_key(own.around, *same))))
                for x, y in zip(out, (np.full(len(at), doc, np.int64), key << 32 | 2 * at + 1, found.view(np.int64))):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["doc_id", "at", "seed"])

    out = materialise(_with_at(docs, repeated).mapInArrow(run, "doc_id long, at long, seed long"), "chain-windows")
    discard(several)
    return out


#: What ``_neighbours`` emits: links, rows of a task's first seed, and where the runs of its first and last seed begin and end.
LINK, OPEN, RUN = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch], with_last: bool = True) -> Iterator[pa.RecordBatch]:
    """Links of sorted occurrences with the document before (if ``with_last``) and the first one of the same seed, as far as one task sees.

    The run of a seed may go on over many tasks. Only four rows of it are held:
    the first, the heads of the document before and of the current one, and the
    last. What the task's first seed has in the tasks before is joined later.
    """
    held, opening, now = np.empty((3, 0), np.int64), True, None
    names = ["kind", "a", "b", "c", "d", "seed"]

    def rows(kind: int, a, b, c, d, seed) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *[pa.array(np.asarray(x, np.int64)) for x in (a, b, c, d, seed)]], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        known = held.shape[1]
        seed, doc, at = table = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("seed", "doc_id", "at")])], axis=1)
        n = len(seed)
        turn = np.append(True, seed[1:] != seed[:-1])
        enter = turn | np.append(True, (doc[1:] != doc[:-1]) | (at[1:] >> 32 != at[:-1] >> 32))
        i = np.arange(n)
        start, head = np.maximum.accumulate(np.where(turn, i, 0)), np.maximum.accumulate(np.where(enter, i, 0))
        before = np.where(head == start, -1, head[head - 1])
        new = (i >= known) & (enter | np.append(True, at[1:] != at[:-1]))  # a repeated row counts once
        first = (start == 0) & opening
        if with_last:
            x = np.flatnonzero(new & (before >= 0))
            yield rows(LINK, doc[x], at[x], doc[before[x]], at[before[x]], np.zeros(len(x)))
        x = np.flatnonzero(new & (head != start) & ~first & ~(with_last & (start == before)))
        yield rows(LINK, doc[x], at[x], doc[start[x]], at[start[x]], np.zeros(len(x)))
        x = np.flatnonzero(new & first)
        if len(x):
            yield rows(OPEN, doc[x], at[x], np.full(len(x), doc[0]), np.full(len(x), at[0]), seed[x])
        if opening and start[-1]:
            last = head[np.flatnonzero(turn)[1] - 1]
            yield rows(RUN, doc[:1], at[:1], doc[[last]], at[[last]], seed[:1])
            opening = False
        now = [z[[j]] for j, z in ((start[-1], doc), (start[-1], at), (head[-1], doc), (head[-1], at), (-1, seed))]
        held = table[:, sorted({start[-1], max(before[-1], start[-1]), head[-1], n - 1})]
    if now is not None:
        yield rows(RUN, *now)


def matches(occurrences: DataFrame, with_last: bool = True) -> DataFrame:
    """``doc_id``, ``at``, ``ref_doc_id``, ``ref_at``: each occurrence with the one in the document before it, unless without ``with_last``, and with the first.

    Occurrences are sorted by ranges of seed and document, so a seed in most
    documents is spread over many tasks. The runs that tasks share are joined
    through a table of two rows a task.
    """
    who = F.shiftright("at", 32)
    spread = occurrences.select("seed", "doc_id", "at").repartitionByRange("seed", "doc_id", who).sortWithinPartitions("seed", "doc_id", "at")
    out = materialise(spread.mapInArrow(lambda batches: _neighbours(batches, with_last), "kind byte, a long, b long, c long, d long, seed long"), "chain-matches")
    by = Window.partitionBy("seed").orderBy("a", "b")
    runs = out.where(F.col("kind") == RUN).select("seed", F.col("a").alias("run"), F.col("b").alias("run_at"), F.first("a").over(by).alias("ref"), F.first("b").over(by).alias("ref_at"), F.lag("c").over(by).alias("last"), F.lag("d").over(by).alias("last_at"))
    opened = out.where(F.col("kind") == OPEN).select("a", "b", F.col("c").alias("run"), F.col("d").alias("run_at"), "seed").join(runs, ["seed", "run", "run_at"])
    differs = lambda doc, at: (F.col("a") != F.col(doc)) | (F.shiftright("b", 32) != F.shiftright(at, 32))
    own = out.where(F.col("kind") == LINK).select("a", "b", "c", "d")
    firsts = opened.where(differs("ref", "ref_at")).select("a", "b", "ref", "ref_at")
    lasts = opened.where(F.col("last").isNotNull() & ~differs("run", "run_at")).select("a", "b", "last", "last_at")
    return (own.union(firsts).union(lasts) if with_last else own.union(firsts)).toDF("doc_id", "at", "ref_doc_id", "ref_at")


class Fenwick:
    """Best (priority, anchor) among the places up to a given one."""

    def __init__(self, n: int):
        self.best = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        out = (0.0, -1)
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(pos: np.ndarray, rpos: np.ndarray, gap: int = GAP) -> list[tuple[np.ndarray, np.ndarray]]:
    """Collinear chains of the matches (sorted by pos, then rpos), best first; each match is in one chain at most.

    A match scores 1; following another costs (distance in both) / (2 * gap).
    With priority = score + (pos + rpos) / (2 * gap) the best predecessor is a
    prefix maximum over the reference positions seen so far.
    """
    n = len(pos)
    steps, rsteps = np.diff(pos), np.diff(rpos)
    if (steps > 0).all() and (rsteps > 0).all() and (steps + rsteps < 2 * gap).all():  # in order, each worth more than its gap: one chain
        return [(pos, rpos)]
    places = np.searchsorted(np.unique(rpos), rpos) + 1
    tree, cost = Fenwick(int(places.max())), 1 / (2 * gap)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and pos[j] == pos[i]:  # matches of one position don't follow each other
            priority, last = tree.get(int(places[j]) - 1)
            gain = priority - cost * float(pos[j] + rpos[j]) if last >= 0 else 0.0
            score[j], before[j] = (1 + gain, last) if gain > 0 else (1.0, -1)
            j += 1
        for m in range(i, j):
            tree.put(int(places[m]), (score[m] + cost * float(pos[m] + rpos[m]), m))
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: (-score[m], m)):
        own = []
        while end >= 0 and not used[end]:
            used[end] = True
            own.append(end)
            end = before[end]
        if own:
            own = np.array(own[::-1])
            out.append((pos[own], rpos[own]))
    return out


def diagonals(pos: np.ndarray, rpos: np.ndarray, shift: int = SHIFT) -> list[np.ndarray]:
    """Groups of matches (their numbers, in order) whose shift between the texts differs by at most ``shift`` words from that of another of the group.

    A passage that a text repeats has a shift of its own each time; chaining
    across these would break every copy into pieces.
    """
    order = np.argsort(pos - rpos, kind="stable")
    cuts = np.flatnonzero(np.diff((pos - rpos)[order]) > shift) + 1
    return [np.sort(part) for part in np.split(order, cuts)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two short runs."""
    row, b = [0] * (len(b) + 1), b.tolist()
    for x in a.tolist():
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs go on alike, with single differing words: (length, matched words)."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -3))
    stop = np.flatnonzero(score - np.maximum.accumulate(np.maximum(score, 0)) < -6)
    score = score[: stop[0]] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    length = int(score.argmax()) + 1
    return length, int(same[:length].sum())


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, rpos: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """Ends of the passage in both texts and its matched words, from the chain's positions in the word runs ``a`` and ``b``."""
    matched, at, to = 0, int(pos[0]), int(rpos[0])
    length = int(pos[-1]) + k - at
    if ((pos - rpos) == at - to).all() and (same := int((a[at : at + length] == b[to : to + length]).sum())) >= 0.95 * length:
        matched, at, to, pos, rpos = same, at + length, to + length, pos[:1], rpos[:1]
        seeds_left = []
    else:
        seeds_left = zip(pos.tolist(), rpos.tolist())
    for p, r in seeds_left:
        if p < at or r < to:  # overlaps the seed before
            over = max(at - p, to - r)
            if over >= k:
                continue
            p, r, left = p + over, r + over, k - over
        else:
            left = k
        x, y = a[at:p], b[to:r]
        if len(x) == len(y) and np.array_equal(x, y):
            matched += len(x)
        elif len(x) and len(y) and max(len(x), len(y)) <= ALIGNED:
            matched += _common(x, y)
        matched += left
        at, to = p + left, r + left
    before = _reach(a[: int(pos[0])][::-1], b[: int(rpos[0])][::-1])
    after = _reach(a[at:], b[to:])
    return int(pos[0]) - before[0], at + after[0], int(rpos[0]) - before[0], to + after[0], matched + before[1] + after[1]


def _torn(pos: np.ndarray, rpos: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last short run of the long matches that no chain has both ends of."""
    of = {x: i for i, (p, r) in enumerate(found) for x in zip(p.tolist(), r.tolist())}
    out = []
    for p, r in zip(pos.tolist(), rpos.tolist()):
        if (i := of.get((p, r))) is None or i != of.get((p + length, r + length)):
            out.append((np.array([p, p + length]), np.array([r, r + length])))
    return out


def equal_runs(a: np.ndarray, b: np.ndarray, pos: np.ndarray, rpos: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Equal runs of at least ``least`` words at the shifts of a chain: begin and end in ``a``, begin in ``b``."""
    out = []
    for shift in np.unique(pos - rpos).tolist():
        low, high = max(0, shift), min(len(a), len(b) + shift)
        same = np.concatenate([[False], a[low:high] == b[low - shift : high - shift], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + low
        out += [(s, e, s - shift) for s, e in edge.tolist() if e - s >= least]
    return out


def _chained(found: DataFrame, min_words: int, k: int) -> DataFrame:
    """Chains that may hold a passage of ``min_words``; one task sees all matches of two documents, at most a document's length.

    A long match of which no chain has both ends is a chain of its own.
    """
    least, size = max(1, min_words // 4), _long(k, min_words)
    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_key", "ref_doc_id", "ref_text_key")] + [("pos", pa.list_(pa.int32())), ("rpos", pa.list_(pa.int32()))])
    schema = T.StructType.fromDDL("doc_id long, text_key long, ref_doc_id long, ref_text_key long, pos array<int>, rpos array<int>")

    def chained(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, ref, at, rat = rows[:, np.append(True, (np.diff(rows) != 0).any(axis=0))] if rows.shape[1] else rows
        who, rwho, pos, rpos = at >> 32, rat >> 32, (at & 0xFFFFFFFF) >> 1, (rat & 0xFFFFFFFF) >> 1
        long = np.flatnonzero(at & 1)
        whole = np.ones(len(at), bool)  # the short runs at which a long match begins
        if rwho.any() or len(long):  # a long match is that of the short runs in it, end to end
            copies = np.concatenate([np.arange(len(at)), np.repeat(long, size // k - 1)])
            step = np.concatenate([np.zeros(len(at), np.int64), np.tile(np.arange(1, size // k) * k, len(long))])
            doc, ref, who, rwho, pos, rpos, whole = (x[copies] for x in (doc, ref, who, rwho, pos, rpos, at & 1 == 0))
            whole[len(at) :] = True
            pos, rpos = pos + step, rpos + step
            order = np.lexsort((whole, rpos, pos, rwho, who, ref, doc))
            order = order[np.append(True, np.logical_or.reduce([np.diff(x[order]) != 0 for x in (doc, ref, who, rwho, pos, rpos)]))]
            doc, ref, who, rwho, pos, rpos, whole = (x[order] for x in (doc, ref, who, rwho, pos, rpos, whole))
        of = (doc, who, ref, rwho)
        edge = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in of]))) if len(doc) else np.empty(0, np.int64)
        end = np.append(edge[1:], len(doc))[: len(edge)]
        wide = (end - edge > 1) & (pos[end - 1] - pos[edge] + k >= least)
        out = []
        for a, b in zip(edge[wide].tolist(), end[wide].tolist()):
            for part in diagonals(pos[a:b], rpos[a:b]):
                if len(part) > 1:
                    found = chains(pos[a:b][part], rpos[a:b][part])
                    if len(found) > 1:
                        begins = part[~whole[a:b][part]]
                        found = [x for x in found if len(x[0]) > 1] + _torn(pos[a:b][begins], rpos[a:b][begins], found, size - k)
                    for p, r in found:
                        if len(p) > 1 and p[-1] - p[0] + k >= least:
                            out.append((*(x[a] for x in of), p.astype(np.int32), r.astype(np.int32)))
        for i in range(0, len(out), ROWS_OUT):
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[i : i + ROWS_OUT]], f.type) for j, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("doc_id", "ref_doc_id", "at", "ref_at")])], axis=1)
            if held.shape[1]:
                cut = int(np.flatnonzero((held[:2] != held[:2, -1:]).any(axis=0)).max(initial=-1)) + 1
                yield from chained(held[:, :cut])
                held = held[:, cut:]
        yield from chained(held)

    return found.repartition("doc_id", "ref_doc_id").sortWithinPartitions("doc_id", "ref_doc_id", "at", "ref_at").mapInArrow(run, schema)


ROWS_OUT = 2000


def _hashed(docs: DataFrame, wanted: Broadcast, repeated: Broadcast | None) -> DataFrame:
    """``of``, ``of_key`` and the document's words as 32-bit hashes, for the alignment, of the wanted ids and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            batch = batch.filter(pa.array(id_filter.may_hold(wanted.value, batch.column("doc_id").to_numpy())))
            ids, keys = _keys(batch, repeated)
            out = [hashes.of(t.lower().split()).astype("<u4").tobytes() for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(out, pa.binary())], names=["of", "of_key", "words"])

    out = _with_at(docs, repeated).mapInArrow(run, "of long, of_key long, words binary")
    return out if repeated is None else out.dropDuplicates(["of", "of_key"])


def _aligned(docs: DataFrame, met: DataFrame, min_words: int, similarity: float, k: int, repeated: Broadcast | None) -> DataFrame:
    """Passages that chains of the matches come to, word by word."""
    found = materialise(_chained(met, min_words, k), "chain-found")
    words = _hashed(docs, id_filter.build(found.select(F.explode(F.array("doc_id", "ref_doc_id")).alias("of")), "of"), repeated)

    def window(where: str) -> list[Column]:
        start = F.greatest(F.element_at(where, 1) - REACH, F.lit(0))
        return [start, F.substring("words", 4 * start + 1, 4 * (F.element_at(where, -1) + k + REACH - start))]

    names = found.columns
    a0, a = window("pos")
    left = found.join(words, (found.doc_id == words.of) & (found.text_key == words.of_key)).select(*names, a0.alias("a0"), a.alias("a"))
    b0, b = window("rpos")
    ready = left.join(words, (left.ref_doc_id == words.of) & (left.ref_text_key == words.of_key)).select(*names, "a0", "a", b0.alias("b0"), b.alias("b"))
    schema = "doc_id long, text_key long, start_word int, end_word int, ref_doc_id long, ref_text_key long, ref_start_word int, ref_end_word int, n_matched int, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        for batch in slices(batches):
            out = []
            for doc, key, ref, rkey, pos, rpos, a0, a, b0, b in zip(*(batch.column(c).to_pylist() for c in (*names, "a0", "a", "b0", "b"))):
                a, b, pos, rpos = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), np.array(pos) - a0, np.array(rpos) - b0
                s, e, rs, re, n = align(a, b, pos, rpos, k)
                alike = n / max(e - s, re - rs, 1)
                if min(e - s, re - rs) >= min_words and alike >= similarity:
                    out.append((doc, key, s + a0, e + a0, ref, rkey, rs + b0, re + b0, n, min(1.0, alike)))
                else:  # what is equal in it counts all the same
                    out += [(doc, key, s + a0, e + a0, ref, rkey, rs + b0, rs + e - s + b0, e - s, 1.0) for s, e, rs in equal_runs(a, b, pos, rpos, min_words)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=fields)

    return ready.mapInArrow(run, schema)


def passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, k: int = K, every: int = EVERY) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document has as well.

    In: ``doc_id``, ``text``; other columns are ignored, whatever their names.
    Out, one row per passage and earlier document that it was compared with:
    ``doc_id``, ``text_key``, ``start_word``, ``end_word`` (after the last),
    ``ref_doc_id``, ``ref_text_key``, ``ref_start_word``, ``ref_end_word``,
    ``n_matched`` and ``similarity``, matched words over the longer side.

    Documents come in the order of their ids, and of their text keys where an
    id has several texts; the key is 0 for ids of one row. Rows equal in id and
    text are one document. Null ids take no part; null, empty and short texts
    and empty tables have no passages. Long texts need memory for their words'
    hashes, and nothing is cut off. Letter case is ignored for A-Z.

    Of equal runs of ``min_words`` words (at least ``k``) none is missed: every
    word of a run that an earlier document has is in a passage. Edited passages
    are found by the seeds between their edits; see README for recall.
    """
    repeated = _repeated(docs)
    occurrences = materialise(_occurrences(docs, k, every, min_words, repeated), "chain-seeds")
    plain = occurrences.where("not surroundings").select("doc_id", "at", "seed")
    done = materialise(_aligned(docs, matches(plain), min_words, similarity, k, repeated), "chain-passages")
    met = _left_open(docs, occurrences, done, k, min_words, repeated)
    more = materialise(_aligned(docs, met, min_words, similarity, k, repeated), "chain-more")
    discard(occurrences)
    return done.union(_outside(more.distinct(), "text_key", done, F.col("start_word"), F.col("end_word")))


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages of ``found`` cut out of their texts.

    All columns are kept and ``n_chars``, if there, is counted anew; documents
    without a passage, and rows with a null id or text, come back unchanged;
    those of which no word is left are dropped. A cut runs from the passage's
    first to its last word. Ids are of a numeric type. Of the rows of a repeated id only those with the
    passage's text are cut; rows equal in id and text are cut alike. An empty
    table of either kind leaves ``docs`` as they are.
    """
    found = materialise(found.select("doc_id", "text_key", "start_word", "end_word").distinct(), "chain-cuts")
    spans = found.groupBy(F.col("doc_id").alias("of"), "text_key").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))
    spans = sent_if_small(materialise(spans, "chain-spans"), found)
    names = docs.columns
    # A row travels as one struct, so its other columns may have any name.
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("row_id"), _text_key(docs["text"]).alias("row_key"))
    here = (F.col("row_id") == F.col("of")) & ((F.col("text_key") == 0) | (F.col("text_key") == F.col("row_key")))
    joined = rows.join(spans, here, "left").select("row", "spans")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            flat = pa.RecordBatch.from_arrays([whole.column("spans"), *whole.column("row").flatten()], names=["spans", *names])
            for batch in slices([flat]):
                spans, columns = batch.column(0), batch.columns[1:]
                hit = spans.is_valid()
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(spans.is_null())
                if not any(hit.to_pylist()):
                    continue
                part = batch.filter(hit)
                columns = part.columns[1:]
                texts = [_cut(t or b"", [(s["start_word"], s["end_word"]) for s in cuts]) for t, cuts in zip(columns[at].cast(pa.binary()).to_pylist(), part.column(0).to_pylist())]
                columns[at] = pa.array([t.decode() for t in texts], columns[at].type)
                if "n_chars" in names:
                    i = names.index("n_chars")
                    columns[i] = pa.array([len(t.decode()) for t in texts]).cast(columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([bool(t.strip()) for t in texts]))

    return joined.mapInArrow(run, docs.schema)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and the blanks between them."""
    words = text.split()
    drop = np.zeros(len(words), bool)
    for a, b in spans:
        drop[a:b] = True
    out, at = [], 0
    start = 0  # of what is to be kept
    for word, gone in zip(words, drop.tolist()):
        i = text.index(word, at)
        if gone:
            if start is not None:
                out.append(text[start:i])
                start = None
        elif start is None:
            start = i
        at = i + len(word)
    if start is not None:
        out.append(text[start:])
    return b"".join(out)
