import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loamline.llm import bit_planes as M
from loamline.llm.queries import english_tokenizer
from tests.llm.helpers import DOCS, awkward, empty, sentence

PIECES = [" ", " ", "\n", "\t", "a", "b", "é", "'", "s", "'s", "'ll", ".", ",", "1", "23", "\xa0", "　", "\x1c", "\x85", "日本", "😀", "_", "A", "<|endoftext|>", "×", "ª", "\r", "\x0b", "don't", " "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(english_tokenizer())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("unit", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_planes_invert(unit, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = M.to_planes(ids, unit)
    assert len(planes) == 32 // unit
    assert (M.from_planes(planes, n, unit) == ids).all()


def test_empty_planes_cost_nothing():
    ids = np.random.default_rng(1).integers(0, 2**15, 65_536, dtype=np.uint32)
    assert all(len(p) < 64 for p in M.to_planes(ids, 1)[15:])
    assert sum(map(len, M.to_planes(ids, 8))) < 0.52 * ids.nbytes


def test_encoder_is_the_library(library):
    rng = random.Random(12)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [sentence(rng, 5000), "x" * 30_000, " " * 3000 + "y", ""]
    encoder = M.Encoder(english_tokenizer())
    assert encoder.by_pieces
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == library(texts)
    assert [x.tolist() for x in encoder.encode(pa.array(texts[50:150]))] == library(texts[50:150])
    assert [x.tolist() for x in encoder.encode(pa.array(texts).slice(60, 40))] == library(texts[60:100])
    encoder.forget()
    assert [x.tolist() for x in encoder.encode(pa.array(["a b"]))] == library(["a b"])
    assert encoder.encode(pa.array([], pa.string())) == []


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    encoder, library = M.Encoder(text), Tokenizer.from_str(text)
    assert not encoder.by_pieces
    assert encoder.encode(pa.array(["Some words", ""]))[0].tolist() == library.encode("Some words", add_special_tokens=False).ids


def expected(rows, library, end=0):
    """Documents in order with start, length and crc32."""
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, library([t or "" for _, t in rows])):
        raw = np.array([*ids, end], "<u4").tobytes()
        out.append((doc_id, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    return out


@pytest.mark.parametrize("layout", [{}, {"block_ids": 64, "file_bytes": 20_000}, {"block_ids": 1000, "unit": 1, "file_bytes": 50_000}])
def test_round_trip(spark, tmp_path, library, layout):
    rng = random.Random(3)
    rows = [(i - 50, None if i % 40 == 0 else sentence(rng, rng.choice([0, 1, 30, 400]), "abcdé\n'"), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), DOCS).repartition(6)
    out = M.round_trip(docs, str(tmp_path / uuid.uuid4().hex), english_tokenizer(), **layout).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == expected([r[:2] for r in rows], library)


def test_files_and_ids(spark, tmp_path, library):
    docs = spark.createDataFrame([(i, f"text {i} " * 40, "en", "s", 0) for i in range(200)], DOCS)
    path = str(tmp_path / "planes")
    M.write(docs, path, english_tokenizer(), end_id=50256, file_bytes=20_000)
    found = M.read(spark, path).orderBy("file", "nth").collect()
    assert len({r.file for r in found}) > 2
    assert [r.doc_id for r in found] == list(range(200))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[*x, 50256] for x in library([f"text {i} " * 40 for i in range(200)])]


def test_awkward_rows(spark, tmp_path, library):
    df = awkward(spark)
    out = [tuple(r) for r in M.round_trip(df, str(tmp_path / "a"), english_tokenizer()).orderBy("start").collect()]
    assert [r[0] for r in out] == [*sorted(r.doc_id for r in df.collect() if r.doc_id is not None), None, None]
    of_row = sorted((str(d), n, c) for d, _, n, c in expected([(r.doc_id, r.text) for r in df.collect()], library))
    assert sorted((str(d), n, c) for d, _, n, c in out) == of_row
    assert all(b[1] == a[1] + a[2] for a, b in zip(out, out[1:])) and out[0][1] == 0
    assert M.round_trip(empty(spark), str(tmp_path / "b"), english_tokenizer()).collect() == []


def test_damage_is_noticed(spark, tmp_path):
    path = tmp_path / "planes"
    M.write(spark.createDataFrame([(1, "a", "en", "s", 0)], DOCS), str(path), english_tokenizer())
    for f in path.glob("part-*"):
        (path / f".{f.name}.crc").unlink(missing_ok=True)
        f.write_bytes(f.read_bytes()[:-3] + b"??\n")
    with pytest.raises(Exception, match="not a file of id planes"):
        M.read(spark, str(path)).collect()
