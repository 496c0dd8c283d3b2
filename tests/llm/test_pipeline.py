import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from credence.llm import pii, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "pa", "re") for b in
                  ("na", "so", "tir", "vel", "wo", "xan", "yd", "zu", "lem", "gor")] + [
        f"word{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = {i: "\n".join(text(rng.randint(15, 80)) for _ in range(rng.randint(2, 5)))
             for i in range(60)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in clean.items()]
    near = clean[7].split(" ")
    near[20] = "changed"
    item = text(30)
    person = text(60) + " +1 (222) 555-1234 4111111111111111 a.b@mail.example.com 10.0.0.1 end"
    planted = {100: clean[5], 101: clean[5], 102: " ".join(near), 103: text(40) + " " + item,
               104: "too short", 105: ("same words here again and again x " * 40), 106: None,
               107: "", 108: person}
    rows += [(i, t, "en", "s0", len(t or "")) for i, t in planted.items()]
    rows += [(60 + i, t, "en", "s1", len(t)) for i, t in enumerate(
        f"{text(30)} {pii_text(rng)} {text(5)}" for _ in range(30))]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, text(20))], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, rows


def pii_text(rng):
    return rng.choice([f"x{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
                       f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
                       ".".join(str(rng.randrange(256)) for _ in range(4)), "4111111111111111"])


def test_stages(spark, folder):
    """Each stage decides what was planted for it, and keeps all that is clean."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids, seen = {r[0] for r in rows}, docs
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, path)
        assert seen.schema.simpleString() == docs.schema.simpleString()
        left = sorted(r.doc_id for r in seen.collect())
        assert len(left) == len(set(left))
        gone.append(ids - set(left))
        ids = set(left)
    assert gone == [{104, 105, 106, 107}, {100, 101, 102}, {103}, set()]
    texts = {r.doc_id: r for r in seen.collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert texts[108].text.endswith(" [PHONE] [CARD] [EMAIL] [IP] end")
    original = {r[0]: r[1] for r in rows}
    assert all(texts[i].text == original[i] for i in range(60))
    assert not any(pii.base_spans(r.text) for r in texts.values())


def test_run_packs_what_the_stages_keep(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [1]
              for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p.doc_id for p in pieces} == set(wanted)
    for p in pieces:
        ids = wanted[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length],
                                                  "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, wanted.values()))


def test_run_returns_the_sequences(spark, folder):
    """The result holds the ids of which each sequence is made, not only their checksums."""
    path, _ = folder
    pieces = corpus_pipeline.run(spark, path).collect()
    for p in pieces:
        assert len(p.ids) == p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        sequences.setdefault(p.sequence_id, []).extend(p.ids)
    assert all(len(s) == 2048 for s in list(sequences.values())[:-1])
    assert tokenizer.decode(sequences[min(sequences)])


def test_names():
    assert len(corpus_pipeline.STAGES) == 5
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
