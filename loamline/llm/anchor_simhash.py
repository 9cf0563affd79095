"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the perfect binary Golay code of
length 23 (covering radius 3), taken on two blocks of 23 of the 64 fingerprint
bits, so radius 6 over 46 bits. A fingerprint's home is its nearest anchor. It
is replicated to every anchor within the covering radius plus the threshold
(block by block: what a block's distance has above 3 must fit in the
threshold). If two fingerprints differ in at most ``max_bits`` bits, each has a
replica at the other's home, so comparing homes with replicas anchor by anchor
finds every link. With 2 bits a fingerprint has at most 69 replicas.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm import id_filter
from loamline.llm.components import connected_components, forest
from loamline.llm.storage import kept, materialise, scratch, sent_if_small
from loamline.llm.words import WordHashes, gram_hashes, mix, slices, text_bytes

LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
PAIRS_AT_ONCE = 2_000_000
#: Rows of an anchor that are all compared.
CROWD = 4096


def shingles(text: bytes, k: int) -> list[bytes]:
    """Space-joined runs of k lower-cased words, repeats included; fewer words: the whole sequence; none: nothing."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def simhash(hashes: np.ndarray) -> int:
    """Fingerprint of big-endian 64-bit hashes: the bits set in over half of them."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, k: int, seed: int = 42) -> int:
    parts = shingles(text, k)
    return simhash(np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in parts]), ">u8"))


def fingerprints(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a long) of each row; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = pa.array([fingerprint(t, shingle_words) for t in text_bytes(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


@lru_cache
def _code(max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and by syndrome the error patterns of weight up to 3 + max_bits with their excess over 3."""

    def syndromes(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(LENGTH - 1, 10, -1):
            words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
        return words

    low, high = syndromes(np.arange(1 << 12)), syndromes(np.arange(1 << 11) << 12)
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + max_bits + 1):
        for where in combinations(range(LENGTH), weight):
            e = sum(1 << i for i in where)
            found[low[e & 0xFFF] ^ high[e >> 12]].append((e, max(0, weight - RADIUS)))
    width = max(map(len, found))
    errors, excess = np.zeros((1 << 11, width), np.int64), np.full((1 << 11, width), 99, np.int64)
    for s, patterns in enumerate(found):
        for j, (e, x) in enumerate(patterns):
            errors[s, j], excess[s, j] = e, x
    return low, high, errors, excess


def replicas(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and whether it is the home, for every replica of the fingerprints."""
    low, high, errors, excess = _code(max_bits)
    u = fp.view(np.uint64)
    sides = []
    for shift in (0, LENGTH):
        w = (u >> np.uint64(shift)).astype(np.int64) & ((1 << LENGTH) - 1)
        s = low[w & 0xFFF] ^ high[w >> 12]
        sides.append(((w[:, None] ^ errors[s]) >> 11, excess[s]))
    (a, x), (b, y) = sides
    over = x[:, :, None] + y[:, None, :]
    row, i, j = np.nonzero(over <= max_bits)
    return row, a[row, i] << 12 | b[row, j], over[row, i, j] == 0


def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and replicas of the same anchor (rows sorted by anchor), as a forest.

    In an anchor of more than ``crowd`` rows only those are compared that agree
    on one of ``max_bits`` + 1 blocks of bits, as linked ones must.
    """
    size = np.diff(np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1)), len(anchor)))
    many = np.repeat(size > crowd, size)
    us, vs = _compared(anchor[~many], fp[~many], home[~many], max_bits)
    anchor, fp, home = anchor[many], fp[many], home[many]
    bounds = np.linspace(0, 64, max_bits + 2).astype(int).tolist() if len(fp) else [0]
    for low, high in zip(bounds, bounds[1:]):
        block = fp.view(np.uint64) >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        order = np.lexsort((block, anchor))
        group = np.cumsum(np.append(True, (np.diff(anchor[order]) != 0) | (np.diff(block[order]) != 0)))
        u, v = _compared(group, fp[order], home[order], max_bits)
        us, vs = forest(np.concatenate([us, u]), np.concatenate([vs, v]))
    return us, vs


def _compared(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1))
    size = np.diff(np.append(edge, len(anchor)))
    start, count = np.repeat(edge, size), np.repeat(size, size)
    homes = np.flatnonzero(home & (count > 1))
    us, vs = fp[:0], fp[:0]
    done = 0
    total = np.cumsum(count[homes])
    while done < len(homes):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE)))
        h = homes[done:upto]
        n = count[h]
        ends = np.cumsum(n)
        other = np.arange(ends[-1]) - np.repeat(ends - n - start[h], n)
        mine = np.repeat(fp[h], n)
        near = np.bitwise_count((mine ^ fp[other]).view(np.uint64)) <= max_bits
        near &= mine != fp[other]
        us, vs = forest(np.concatenate([us, mine[near]]), np.concatenate([vs, fp[other][near]]))
        done = upto
    return us, vs


def link_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints of ``fp`` (distinct longs) at most ``max_bits`` apart.

    The links of an anchor are thinned to a forest, so they grow with the rows
    and not with the pairs of a group; the components stay the same.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 2048):
                part = fp[i : i + 2048]
                row, anchor, home = replicas(part, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            u, v = compare(*rows, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home")]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield links(held)

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    return spread_out.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, max_bits: int = 2) -> DataFrame:
    """Class of every document: ``doc_id``, ``fp``, ``component_id``.

    Two documents link if their fingerprints differ in at most ``max_bits``
    bits; ``component_id`` is the smallest non-null id that a document reaches,
    itself included (null if there is none). One row per input row; equal texts
    share a fingerprint, so groups of copies of any size cost one comparison.
    Texts without words, and null texts, all have fingerprint 0.
    """
    with scratch():
        own = kept(materialise(fingerprints(docs, shingle_words), "simhash"))
        distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
        found = connected_components(link_fingerprints(distinct, max_bits), "simhash")
        labelled = distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
        labelled = materialise(labelled, "simhash-labels")
        lows = materialise(labelled.groupBy("label").agg(F.min("low").alias("component_id")), "simhash-lows")
        classes = kept(materialise(labelled.join(lows, "label").select(F.col("fp").alias("of"), "component_id"), "simhash-classes"))
    return own.join(classes, own.fp == classes.of, "left").select("doc_id", "fp", "component_id")


#: Of the shingle weights u ** -3 those after the 16 heaviest add less than 1 % of the first.
HEAVIEST, TAIL = 16, -3.0


def weighted_fingerprints(distinct: np.ndarray, how_many: int) -> list[int]:
    """SimHashes of a set of shingle hashes, each under other random weights.

    The weights have a heavy tail, so a few shingles decide a fingerprint: it
    stays the same, or nearly, with about the probability that these shingles
    are in both of two texts, while any edit disturbs an unweighted one.
    """
    if not len(distinct):
        return [0]
    out = []
    for g in range(how_many):
        with np.errstate(over="ignore"):
            u = mix(distinct + np.uint64(2 * g + 1) * np.uint64(0x9E3779B97F4A7C15))
            low = np.argpartition(u, HEAVIEST)[:HEAVIEST] if len(u) > HEAVIEST else np.arange(len(u))
            weight = ((u[low] >> np.uint64(11)).astype(np.float64) + 1) ** TAIL
            bits = np.unpackbits(mix(u[low] + np.uint64(g + 1)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        share = (weight / weight.max()) @ (2.0 * bits - 1)
        out.append(int.from_bytes(np.packbits(share > 0).tobytes(), "big", signed=True))
    return sorted(set(out))


def _shingle_set(hashes: WordHashes, text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k lower-cased words (fewer words: of the whole sequence)."""
    words = text.lower().split()
    return np.unique(gram_hashes(hashes.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def _classified(docs: DataFrame, similarity: float, shingle_words: int, how_many: int, max_bits: int, centres: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``label`` of every row: rows of one class have one label.

    A distinct shingle set is a node, numbered by one of its rows in a written
    table, so ids may be null or repeated.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sigs, sizes, fps, sets, kept = [], [], [], [], []
            for text in text_bytes(batch):
                own = _shingle_set(hashes, text, shingle_words)
                short = np.unique(own.astype(np.uint32))
                sigs.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else b"")
                fps.append(weighted_fingerprints(own, how_many))
                sets.append(short.tobytes())
                sizes.append(len(short))
                kept.append(marks(short))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "text_hash", "sig", "size", "fps", "marks", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.mapInArrow(described, "doc_id long, text_hash long, sig binary, size long, fps array<long>, marks binary, shingles binary")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "similar-rows")
    texts = materialise(rows.groupBy("sig").agg(F.min("row").alias("rep")), "similar-texts")
    own = rows.join(texts.select("rep"), rows.row == texts.rep).select("rep", "size", F.explode("fps").alias("fp"))
    own = materialise(own, "similar-fps")
    # Only fingerprints that several texts have, or that are linked, make classes of more than one text.
    each = materialise(own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "similar-each")
    linked = connected_components(link_fingerprints(each, max_bits), "similar-fps")
    shared = each.join(linked, each.fp == linked.node, "left").where("n > 1 or label is not null")
    shared = materialise(shared.select(F.col("fp").alias("__fp"), F.coalesce("label", "fp").alias("label")), "similar-shared")
    classes = own.join(sent_if_small(shared), own.fp == F.col("__fp")).select("rep", "size", "label").distinct()
    classes = materialise(classes, "similar-classes")
    bucket = F.pmod(F.xxhash64("rep", "label"), F.lit(centres))
    heads = classes.groupBy("label", bucket.alias("b")).agg(F.min("rep").alias("centre"), F.min_by("size", "rep").alias("centre_size"))
    heads = materialise(heads.select(F.col("label").alias("of"), "centre", "centre_size"), "similar-centres")
    # Sets whose sizes differ by more than the threshold can't be similar enough.
    fits = F.least("size", "centre_size") >= similarity * F.greatest("size", "centre_size")
    pairs = classes.join(heads, F.expr("label = of and rep <> centre") & fits).select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct()
    pairs = materialise(pairs, "similar-pairs")
    links = _verified(_shingle_sets(rows, pairs.select(F.explode(F.array("u", "v")).alias("of"))), pairs, similarity)
    links = _completed(rows, classes, materialise(links, "similar-links"), similarity)
    found = connected_components(links, "similar")
    labelled = texts.join(found, texts.rep == found.node, "left").select(F.col("sig").alias("of"), F.coalesce("label", "rep").alias("label"))
    labelled = materialise(labelled, "similar-labels")
    return materialise(rows.join(labelled, rows.sig == labelled.of).select("doc_id", "text_hash", "label"), "similar-labelled")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, how_many: int = 6, max_bits: int = 1, centres: int = 4) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of at least ``similarity``.

    In: ``doc_id``, ``text``; other columns are ignored, whatever their names.
    Out, one row per input row: ``doc_id``, ``component_id`` (smallest non-null
    id reachable over links; null if there is none). Texts of equal shingle
    sets are one; all texts without words, null ones included, are equal. A
    text of fewer words than a shingle has one shingle. Rows of a repeated id
    are told apart by their texts. An empty table gives an empty one.

    Candidates come from anchor-point covering: ``how_many`` weighted SimHashes
    per distinct text, linked at ``max_bits`` bits. Within a class of linked
    fingerprints every text is first compared with up to ``centres`` of its
    members. What that leaves apart is compared with texts central to their
    class and then by a prefix-filter join, which misses no pair of the class.
    Each pair is checked on the whole shingle sets.
    """
    with scratch():
        rows = kept(_classified(docs, similarity, shingle_words, how_many, max_bits, centres))
    lows = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "label").join(lows, "label").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, how_many: int = 6, max_bits: int = 1, centres: int = 4) -> DataFrame:
    """One row of each class of ``similar_documents``, with all columns of ``docs``.

    The row with the smallest id stays, null ids last; of rows of one id that
    with the smallest hash of its text; of rows equal in both any one. Rows are
    dropped by id and text, so another text of a dropped row's id stays. Of all
    texts without words one stays. Ids are of a numeric type. An empty table gives
    an empty one.
    """
    with scratch():
        rows = kept(_classified(docs, similarity, shingle_words, how_many, max_bits, centres))
    several = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1").select(F.col("label").alias("of"), "low")
    met = materialise(rows.join(several, rows.label == several.of).select("label", "low", "doc_id", "text_hash"), "similar-several")
    best = met.where("doc_id <=> low").groupBy(F.col("label").alias("of")).agg(F.min("text_hash").alias("best"))
    keys = met.groupBy("label", "low", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(best, F.col("label") == best.of)
    staying = F.expr("doc_id <=> low and text_hash = best")
    keys = materialise(keys.where(~staying | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), "text_hash", staying.alias("stays")), "similar-dropped")
    # A row travels as one struct, so its other columns may have any name.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("row_id"), F.xxhash64(docs["text"]).alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash"))
    fields = [F.col("row").getField(c).alias(c) for c in docs.columns]
    out = whole.join(sent_if_small(keys), same, "left_anti").select(*fields)
    once = keys.where("stays")
    if once.isEmpty():
        return out
    repeated = whole.join(sent_if_small(once), same, "left_semi").dropDuplicates(["row_id", "row_hash"])
    return out.union(repeated.select(*fields))


#: Counters of shingles, and the share of the loose texts that a round of central texts has to link for another one.
COUNTERS, WORTHWHILE = 1 << 21, 0.5
#: Places that the marks of a shingle set have.
MARKS = 1024


def marks(shingles: np.ndarray) -> bytes:
    """Which of MARKS places the shingles of a set fall on."""
    out = np.zeros(MARKS, bool)
    out[shingles % MARKS] = True
    return np.packbits(out).tobytes()


def most_common(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of what sets of ``n`` and ``m`` shingles share, from the rows of their marks: a place that only one has is a shingle that only it has."""
    alone = [np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a))]
    return np.minimum(n - alone[0], m - alone[1])


def _shingle_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``node``, ``size``, ``marks`` and ``shingles`` (sorted 32-bit hashes) of the rows whose number is in ``of``, and of a few more."""
    wanted = id_filter.build(ids, "of")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(id_filter.may_hold(wanted.value, batch.column("node").to_numpy())))

    own = rows.select(F.col("row").alias("node"), "size", "marks", "shingles").mapInArrow(sets, "node long, size long, marks binary, shingles binary")
    return materialise(own, "similar-sets")


def _verified(own: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u``, ``v`` whose whole shingle sets in ``own`` are similar enough.

    Marks rule out most pairs that aren't before any set is exchanged, and
    never one that is.
    """

    def met(pairs: DataFrame, *columns: str) -> DataFrame:
        ends = {end: own.select(F.col("node").alias(f"{end}_node"), *[F.col(c).alias(f"{end}_{c}") for c in columns]) for end in "uv"}
        needed = sent_if_small(pairs.select(F.col("v").alias("__v")).distinct(), pairs)
        first = sent_if_small(pairs).join(ends["u"], F.col("u") == F.col("u_node"))
        return first.join(ends["v"].join(needed, F.col("v_node") == F.col("__v"), "left_semi"), F.col("v") == F.col("v_node"))

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(f"{end}_size").to_numpy() for end in "uv")
            a, b = (np.frombuffer(b"".join(batch.column(f"{end}_marks").to_pylist()), np.uint8).reshape(len(n), MARKS // 8) for end in "uv")
            yield batch.select(["u", "v"]).filter(pa.array(most_common(a, b, n, m) >= similarity / (1 + similarity) * (n + m) - 1e-6))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column("u_shingles").to_pylist(), batch.column("v_shingles").to_pylist()):
                x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = materialise(met(pairs.select("u", "v"), "size", "marks").mapInArrow(plausible, "u long, v long"), "similar-plausible")
    return met(left, "shingles").mapInArrow(judged, "u long, v long")


def _prefixes(own: DataFrame, similarity: float, tasks: int = 6) -> DataFrame:
    """``node``, ``n``, ``central``, ``prefix`` (those of its rarest shingles that others may have) and their ``places`` in the order of each shingle set.

    Two sets that are similar enough share a shingle of their prefixes under
    any common order. Counters of a fixed size give the order, so collisions
    cost comparisons but no pair. ``central`` is high for sets of shingles that
    many others have.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch.column("shingles").to_pylist():
                np.add.at(n, np.frombuffer(s, np.uint32) % COUNTERS, 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(n, 65535).astype("<u2").tobytes()], pa.binary())], names=["counts"])

    total = np.zeros(COUNTERS, np.int64)
    for row in own.select("shingles").repartition(tasks).mapInArrow(count, "counts binary").toLocalIterator():
        total += np.frombuffer(row.counts, "<u2")
    shared = own.sparkSession.sparkContext.broadcast(np.minimum(total, 65535).astype(np.uint16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, central, prefix, places = [], [], [], []
            for s in batch.column("shingles").to_pylist():
                x = np.frombuffer(s, np.uint32)
                often = shared.value[x % COUNTERS]
                length = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                size.append(len(x))
                central.append(float(np.log1p(often).mean()) if len(x) else 0.0)
                rarest = np.lexsort((x, often))[:length]
                at = np.flatnonzero(often[rarest] > 1)
                prefix.append(x[rarest[at]].astype(np.int64))
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size, pa.int64()), pa.array(central, pa.float64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], names=["node", "n", "central", "prefix", "places"])

    return own.mapInArrow(run, "node long, n long, central double, prefix array<long>, places array<long>")


def _met_twice(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` without the shingles that only one of them has, which lead to no pair.

    The counters that order the shingles fill up as texts grow in number and
    leave ever more such ones; a filter of what two prefixes have leaves few.
    """
    shared = id_filter.build_twice(prefixes, "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, places = batch.column("prefix"), batch.column("places")
            keep = id_filter.may_hold(shared.value, prefix.flatten().to_numpy(zero_copy_only=False))
            ends = np.append(0, np.cumsum(pc.list_value_length(prefix).to_numpy(zero_copy_only=False)))
            ends = pa.array(np.append(0, np.cumsum(keep))[ends].astype(np.int32))
            for name, own in (("prefix", prefix), ("places", places)):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.ListArray.from_arrays(ends, own.flatten().filter(pa.array(keep))))
            yield batch

    return prefixes.mapInArrow(run, prefixes.schema)


def _completed(rows: DataFrame, classes: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``links`` and those that connect all texts similar enough within a class (``label``) of ``rep``.

    Parts are what links connect so far, and texts outside the largest part of
    their class are loose. Rounds compare a class with the most central of its
    loose texts, which gathers copies whose original has any id, as long as a
    round links enough. Then the loose texts meet all others of such classes by
    prefixes, with bounds by size and by the place in the prefix.
    """

    def parted() -> DataFrame:
        """Members of the classes of several parts, with their part and whether they are loose."""
        found = connected_components(links, "similar-parts").select(F.col("node").alias("__node"), F.col("label").alias("__part"))
        own = materialise(classes.join(sent_if_small(found, links), classes.rep == found["__node"], "left").select("rep", "label", F.coalesce("__part", "rep").alias("part")), "similar-parted")
        parts = own.groupBy("label", "part").agg(F.count(F.lit(1)).alias("members"))
        main = parts.groupBy(F.col("label").alias("of")).agg(F.max(F.struct("members", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
        main = materialise(main.where("parts > 1").select("of", F.col("main.part").alias("main")), "similar-main")
        return materialise(own.join(main, own.label == main.of).select("rep", "label", "part", F.expr("part <> main").alias("loose")), "similar-open")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "similar-more-pairs")
        return materialise(_verified(own, pairs, similarity), "similar-more-links")

    opened = parted()
    if opened.isEmpty():
        return links
    own = _shingle_sets(rows, opened.select(F.col("rep").alias("of")))
    prefixes = materialise(_prefixes(own, similarity), "similar-prefixes")
    tried = None
    while True:
        met = sent_if_small(opened).join(prefixes, opened.rep == prefixes.node).select("rep", "label", "part", "loose", "n", "central")
        met = materialise(met, "similar-met")
        free = met.where("loose") if tried is None else met.where("loose").join(tried, ["label", "rep"], "left_anti")
        best = free.groupBy(F.col("label").alias("of")).agg(F.max(F.struct("central", "rep", "part", "n")).alias("c"))
        best = materialise(best.select("of", F.col("c.rep").alias("b"), F.col("c.part").alias("b_part"), F.col("c.n").alias("b_n")), "similar-central")
        fits = F.least("n", "b_n") >= similarity * F.greatest("n", "b_n")
        more = checked(met.join(best, F.expr("label = of and part <> b_part") & fits).select(F.col("rep").alias("a"), "b"))
        gained, loose = more.count(), met.where("loose").count()
        if gained:
            links = materialise(links.union(more), "similar-links")
            opened = parted()
        if opened.isEmpty():
            return links
        if gained < WORTHWHILE * loose:
            break
        now = best.select(F.col("of").alias("label"), F.col("b").alias("rep"))
        tried = materialise(now if tried is None else tried.union(now), "similar-tried")
    # A text is in several classes; by prefixes it meets the texts of all of them at once.
    texts = opened.groupBy("rep", "part").agg(F.max("loose").alias("loose"))
    prefixes = materialise(_met_twice(prefixes), "similar-shared-prefixes")
    postings = sent_if_small(texts, opened).join(prefixes, texts.rep == prefixes.node).select("rep", "part", "n", "loose", F.explode(F.arrays_zip("prefix", "places")).alias("p"))
    postings = postings.select("rep", "part", "n", "loose", F.col("p.prefix").alias("shingle"), F.col("p.places").alias("at"))
    postings = materialise(postings, "similar-postings")
    left = postings.where("loose").select(F.col("shingle").alias("s"), F.col("rep").alias("b"), F.col("part").alias("b_part"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    fits = F.least("n", "b_n") >= similarity * F.greatest("n", "b_n")
    # What two sets can share from a common shingle on has to reach the overlap that the threshold asks for.
    reach = F.least(F.col("n") - F.col("at"), F.col("b_n") - F.col("b_at")) >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("b_n")) - 1e-6
    pairs = postings.join(left, F.expr("shingle = s and part <> b_part and (not loose or rep < b)") & fits & reach)
    return links.union(checked(pairs.select(F.col("rep").alias("a"), "b")))
