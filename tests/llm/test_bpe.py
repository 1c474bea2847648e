import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from attrweave.llm import bpe
from tests.llm.cases import docs, hard


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load()


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_same_ids_as_another_implementation(codec, reference):
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choice("abthe ing é's 12\n\t.!ß𝄞x'll　<|endoftext|>") for _ in range(rng.randint(0, 90)))
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_very_long_pre_tokens(codec, reference):
    rng = random.Random(3)
    for letters in ("a", "ab", "thean"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_bulk_encoder_forgets_and_still_agrees(codec):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(60)] + ["", " "]
    encoder, decoder = bpe.Encoder(codec, memory=100), bpe.Decoder(codec)
    for part in (texts[:20], texts[20:40], texts[40:], []):
        ids, counts = encoder.encode(part)
        cuts = np.cumsum(counts)[:-1]
        assert [x.tolist() for x in np.split(ids, cuts)][: len(part)] == [codec.encode(t) for t in part]
        assert decoder.decode(ids, counts) == [t.encode() for t in part]


def test_edge_cases_and_round_trip(spark):
    rows = hard("very long word" * 20_000)
    out = bpe.encode(docs(spark, rows, extra=True))
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    found = out.collect()
    assert len(found) == len(rows) and all(r.round_trip and len(r.ids) == r.n_tokens for r in found)
    back = sorted(r.text for r in bpe.decode(out).collect())
    assert back == sorted(t or "" for _, t, _, _ in rows)


def test_decoding_of_odd_ids(spark):
    table = spark.createDataFrame([(1, None), (2, []), (3, [15496, None, 11]), (4, [222])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(table).collect()} == {1: "", 2: "", 3: "Hello,", 4: "�"}


def test_empty_table(spark):
    assert bpe.encode(docs(spark, [])).count() == 0


def test_memory_is_bounded_by_letters(monkeypatch):
    monkeypatch.setattr(bpe, "LETTERS", 5_000)
    encoder = bpe.Encoder(bpe.Codec.load())
    for k in range(20):
        text = f"{k}" * 4_000 + " short words"
        ids, counts = encoder.encode([text])
        assert encoder.codec.decode(ids.tolist()) == text and encoder.letters < 5_000 + 20_000


def test_the_vocabulary_is_sent_to_executors(spark):
    table = docs(spark, [(1, "some text", "en", "s")])
    assert [r.round_trip for r in bpe.encode(table).collect()] == [True]
    name = bpe.os.path.basename(bpe.VOCABULARY)
    assert [f for f in spark.sparkContext.listFiles if f.endswith(name)]
    found = table.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([bpe.os.path.getsize(bpe.SparkFiles.get(name))])], names=["n"]) for _ in batches), "n long")
    assert {r.n for r in found.collect()} == {bpe.os.path.getsize(bpe.VOCABULARY)}
