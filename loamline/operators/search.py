"""Index building, exact vector search, answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import text, urls
from loamline.operators.ranking import prefix_budget
from loamline.providers import Embedder

# Limits of search and answers.
DEFAULT_LIMIT, MOST_LIMIT = 8, 20
RELATED = 0.45
MOST_SNIPPETS, SNIPPET_BUDGET = 6, 24_000
BATCH = 64


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays in double precision; 1 for a zero vector."""
    d = lambda x: x.cast("array<double>")
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(d(v), F.lit(0.0), lambda s, x: s + x * x))
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot / n).otherwise(F.lit(1.0))


def top_k(vectors: DataFrame, query: DataFrame, k: int, id_: str = "chunk_id", limit: float | None = None) -> DataFrame:
    """Nearest ``k`` vectors to a single query row (``query``: one row, ``embedding``); ties by id. A heap per task."""
    q = query.select(F.col("embedding").alias("__q"))
    out = vectors.crossJoin(F.broadcast(q)).withColumn("distance", cosine_distance(F.col("embedding"), F.col("__q"))).drop("__q")
    if limit is not None:
        out = out.where(F.col("distance") <= limit)
    return out.orderBy("distance", id_).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id", block: int = 512, parts: int = 64) -> DataFrame:
    """Nearest ``k`` vectors to every query: ``query_id``, ``rank``, id, ``distance``.

    Queries are cut into blocks and the vectors dealt to at most ``parts``
    parts; each block meets each part in one task, as a product of matrices,
    and keeps ``k`` per query. What is exchanged is the vectors once a block of
    queries, the queries once a part and k rows a query and part, never all
    distances. Nothing goes through the driver.
    """
    import numpy as np

    kind, qkind = vectors.schema[id_].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    n = queries.count()
    blocks = max(1, -(-n // block))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"), F.col("query_id").cast("string").alias("id"), "embedding")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    given = vectors.select(every, F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side"), F.col(id_).cast("string").alias("id"), "embedding")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ids, rows, best = None, [], [], None

        def answers() -> pd.DataFrame:
            if best is None:
                return pd.DataFrame({"query_id": [], "id": [], "distance": np.empty(0)})
            return best

        for frame in frames:
            for key, part in frame.groupby(["block", "part", "side"], sort=False):
                if key[:2] != own:
                    if best is not None:
                        yield best
                    own, ids, rows, best = key[:2], [], [], None
                if not key[2]:
                    ids, rows = [*ids, *part["id"]], [*rows, *part["embedding"]]
                    continue
                if not ids:
                    continue
                q, v = np.stack(rows).astype(np.float64), np.stack(part["embedding"].to_numpy()).astype(np.float64)
                length = np.sqrt((q * q).sum(axis=1, keepdims=True)) * np.sqrt((v * v).sum(axis=1))
                d = np.where(length > 0, 1 - np.divide(q @ v.T, length, out=np.zeros_like(length), where=length > 0), 1.0)
                edge = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else d.max(axis=1)
                r, c = np.nonzero(d <= edge[:, None])  # ties at the edge stay, so the id can decide
                found = pd.DataFrame({"query_id": np.array(ids, object)[r], "id": part["id"].to_numpy()[c], "distance": d[r, c]})
                best = found if best is None else pd.concat([best, found], ignore_index=True)
                edge = best.groupby("query_id")["distance"].transform(lambda x: np.partition(x, k - 1)[k - 1] if len(x) > k else x.max())
                best = best[best["distance"] <= edge]
        yield answers()

    met = asked.union(given).repartition("block", "part").sortWithinPartitions("block", "part", "side")
    found = met.mapInPandas(run, "query_id string, id string, distance double").select(F.col("query_id").cast(qkind).alias("query_id"), F.col("id").cast(kind).alias(id_), "distance")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def clamp(limit: int, default: int = DEFAULT_LIMIT) -> int:
    return max(1, min(MOST_LIMIT, limit or default))


def to_embed(chunks: DataFrame, manifest: DataFrame, digest: str) -> DataFrame:
    """Chunks of an index that isn't built yet; none of one that is, so nothing is embedded twice."""
    return chunks.withColumn("digest", F.lit(digest)).join(manifest.where("chunk_count > 0").select("digest"), "digest", "left_anti")


def build_index(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors of chunks in batches of 64; a batch that fails gives rows with ``error`` and no vector."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), BATCH):
                rows = part.iloc[i : i + BATCH]
                vectors, error = [None] * len(rows), None
                try:
                    got = embedder.embed(list(rows["text"]))
                    if len(got) != len(rows):
                        raise ValueError(f"{len(got)} vectors for {len(rows)} texts")
                    vectors = [[float(x) for x in v] for v in got]
                except Exception as e:  # a failing service is a result, not the end of the run
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"digest": rows["digest"], "chunk_id": rows["chunk_id"], "embedding": vectors, "error": [error] * len(rows)})

    own = chunks.select("digest", "chunk_id", text.embedding_text(F.col("path"), F.col("symbol"), F.col("content")).alias("text"))
    return own.mapInPandas(run, "digest string, chunk_id string, embedding array<float>, error string")


def manifest_row(vectors: DataFrame, parts: dict[str, str]) -> DataFrame:
    """The index's row for the manifest, its scope included."""
    return vectors.where("embedding is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("chunk_count")).select("digest", *[F.lit(parts[k]).alias(k) for k in urls.KEY_PARTS], "chunk_count")


def nearest_key(manifest: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Why an index is missing: the same repository's key with the fewest differing parts, and those parts."""
    diff = urls.key_diff({k: F.lit(v) for k, v in parts.items()}, {k: F.col(k) for k in parts})
    return manifest.where(F.col("repo") == parts["repo"]).select("digest", diff.alias("differs")).orderBy(F.size("differs"), "digest").limit(1)


def snippets(hits: DataFrame, by: list[str]) -> DataFrame:
    """Related hits in order of distance: six at most, 24 000 characters, the first always."""
    own = hits.where(F.col("distance") <= RELATED).withColumn("snippet", text.snippet(F.col("content")))
    return prefix_budget(own.withColumn("n", F.length("snippet")), by, ["distance", "chunk_id"], "n", SNIPPET_BUDGET, MOST_SNIPPETS)


def note(question: Column, has_index: Column, embedded: Column, best: Column, answer: Column, model_failed: Column) -> Column:
    """Outcome of a question, the first stage that stops it."""
    return (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "empty_question")
        .when(~has_index, "index_missing")
        .when(~embedded, "embedding_failed")
        .when(best.isNull() | (best > RELATED), "below_threshold")
        .when(model_failed, "llm_failed")
        .when(F.trim(F.coalesce(answer, F.lit(""))) == "", "empty_answer")
        .otherwise("ok")
    )


def search_status(known: Column, completed: Column, question: Column, has_index: Column, embedded: Column) -> Column:
    """HTTP status of a search, tests in this order; the index is looked for before anything is embedded."""
    return F.when(~known, 404).when(~completed, 409).when(F.trim(question) == "", 400).when(~has_index, 409).when(~embedded, 502).otherwise(200)


def cited(answers: DataFrame, numbered: DataFrame) -> DataFrame:
    """Replace ``[n]`` in answers by the snippet's citation and list the citations used, all if none is.

    ``answers``: ``question_id``, ``answer``; ``numbered``: ``question_id``, ``n``, ``citation``. Unknown numbers stay.
    """
    cites = numbered.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), "citation"))).alias("of"), F.sort_array(F.collect_list(F.struct("n", "citation"))).alias("every"))
    own = answers.join(cites, "question_id", "left")
    pieces = F.split("answer", r"(?=\[\d+\])|(?<=\])", -1)

    def shown(piece: Column) -> Column:
        n = F.regexp_extract(piece, r"^\[(\d+)\]$", 1)
        return F.coalesce(F.concat(F.lit("["), F.try_element_at("of", F.nullif(n, F.lit(""))), F.lit("]")), piece)

    used = F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1)
    own = own.withColumn("text", F.array_join(F.transform(pieces, shown), "")).withColumn("used", F.filter("every", lambda e: F.array_contains(used, e["n"].cast("string"))))
    return own.select("question_id", "text", F.transform(F.when(F.size("used") > 0, F.col("used")).otherwise(F.col("every")), lambda e: e["citation"]).alias("citations"))
