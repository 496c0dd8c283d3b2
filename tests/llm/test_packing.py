import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credence.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, n long, ids string, part int"


def table():
    rng = random.Random(11)
    word = lambda: rng.choice(["thanedble", "Über,", "it's", "日本", "éa", "12ab", "x!?",
                               "a b", "<|endoftext|>", "ΣΑΣ"])
    docs = [(i, rng.choice([" ", "\n\t "]).join(word() for _ in range(rng.choice(
        [0, 1, 5, 40, 300]))), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), 1, "x", 2)
        for i in range(300)]
    docs += [(300, None, None, None, None, None), (301, "", "s1", 0, "", 0),
             (None, "no id", "s1", 0, "", 0), (302, "long text " * 20_000, "s2", 0, "", 0)]
    return docs + [docs[4]] * 5


def check(docs, pieces, size=2048, end=1):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = defaultdict(int)
    for doc, text, source, *_ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        wanted[doc, tuple(ids)] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        assert len(p.ids) == p.length > 0
        by_doc[p.doc_id].append(p)
    for doc in {d for d, _ in wanted}:
        texts = {k[1]: n for k, n in wanted.items() if k[0] == doc}
        for ids, n in texts.items():
            own = [p for p in by_doc[doc] if p.doc_tokens == len(ids)]
            covered = np.zeros(len(ids), int)
            for p in own:
                assert tuple(p.ids) == ids[p.start:p.start + p.length]
                covered[p.start:p.start + p.length] += 1
            assert (covered == n).all()
        assert sum(p.length for p in by_doc[doc]) == sum(len(i) * n for i, n in texts.items())
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    short = 0
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        short += at < size
    assert sorted(windows) == list(range(len(windows)))
    return windows, short


@pytest.mark.parametrize("partition_tokens", [1 << 21, 1 << 13])
def test_every_id_is_in_one_piece(spark, partition_tokens):
    docs = table()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    pieces = K.pack(df, PATH, partition_tokens=partition_tokens).collect()
    windows, short = check(docs, pieces)
    total = sum(p.length for p in pieces)
    assert short <= -(-total // partition_tokens) + 1
    assert len(windows) <= total // 2048 + short


def test_targets_and_no_ids(spark):
    docs = table()
    df = spark.createDataFrame(docs, SCHEMA)
    pieces = K.pack(df, PATH, targets={"s0": 0.5, None: 0.5}, grain=16).collect()
    check(docs, pieces)
    first = defaultdict(int)
    for p in pieces:
        if p.sequence_id < 2:
            first[p.source] += p.length
    assert abs(first["s0"] - first[None]) < 200 and set(first) == {"s0", None}
    bare = K.pack(df, PATH, with_ids=False)
    assert bare.where("ids is not null").count() == 0
    assert K.pack(df.limit(0), PATH).count() == 0


def test_windows_follow_the_shares():
    rng = random.Random(2)
    shares = [0.5, 0.3, 0.15, 0.05]
    tokens = [rng.randint(1, 3000) for _ in range(4000)]
    queues, totals = [[] for _ in shares], [0] * 4
    for i, n in enumerate(tokens):
        s = min(range(4), key=lambda k: totals[k] / shares[k])
        queues[s].append((i, n))
        totals[s] += n
    whole = sum(tokens)
    shares = [t / whole for t in totals]
    served = np.zeros((whole // 2048 + 1, 4))
    of = {i: s for s, q in enumerate(queues) for i, _ in q}
    for row, start, length, window, offset in K.fill(queues, [0.0] * 4, shares):
        served[window, of[row]] += length
    assert served.sum() == whole and (served[:-1].sum(1) == 2048).all()
    carried = np.cumsum(served[:-20], 0) - np.outer(np.arange(1, len(served) - 19), shares) * 2048
    assert np.abs(carried).max() <= 3 * 256 + 1


def test_deficits_are_carried_over_partitions():
    """Two partitions with inherited deficits serve what one run would have to by then."""
    shares = [0.75, 0.25]
    first = [[(0, 100)], [(1, 4000)]]
    out = list(K.fill(first, [0.0, 0.0], shares))
    assert sum(p[2] for p in out) == 4100
    deficits = [0.75 * 4100 - 100, 0.25 * 4100 - 4000]
    second = list(K.fill([[(2, 9000)], [(3, 9000)]], deficits, shares))
    assert all(p[0] == 2 for p in second if p[3] == 0)      # source 0 is owed a whole window
