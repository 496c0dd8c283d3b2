"""Mixture-controlled packing by deficit round-robin over source queues.

Every source has a queue of its documents and a target share of all tokens.  With each window a
queue is credited its share of the window; queues with enough credit are served in turn, and what
is not spent, or was borrowed to fill the window, is carried to the next windows as a deficit.
Windows are always filled: only the last one of a partition can be short.

Documents are dealt over packing partitions of about `partition_tokens` tokens by a hash, so a
source with a third of all rows is spread over all of them.  At the end of a partition all its
documents are packed, so the deficit of a source that the next partition inherits is its target so
far minus its tokens so far.  It follows from one row of counts per partition and source, and the
partitions are packed at the same time, with the deficits and sequence numbers they would have
had one after another.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from credence.llm.common import column, stored

CACHED_WORDS = 200_000
TEXT_BYTES = 2 << 20
MARKS = (".", ",")
#: Words of letters below U+0180, but for the one whose lower case is two letters.
PLAIN = (r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}"
         r"\x{131}-\x{17F}]+$")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How a byte-level model writes the bytes of a word: as themselves, or from U+0100 on.
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_TOKENIZERS: dict[tuple, "WordTokens"] = {}
_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("spread", pa.int64()),
                     ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()),
    ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])
_PIECES_SQL = ("doc_id bigint, source string, start bigint, length bigint, ids_crc32 bigint, "
               "doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>")


class WordTokens:
    """Token ids of a tokenizer that drops white space, with the ids of known words kept.

    No token of such a tokenizer reaches over ASCII white space, so the ids of a text are those
    of its words one after another.  A word of letters below U+0180, with a point or comma behind it or
    not, is one piece for the model in lower case, and the mark another; all other words are
    encoded in one call.  Words are numbered, cut and lower-cased as Arrow arrays; Python sees
    each different word of a batch once.
    """

    def __init__(self, path: str, end_id: int, kind: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.code = kind, {"<u2": "H", "<u4": "I"}[kind]
        # Two generations of known words: what is not asked for within one is forgotten.
        self.known, self.older = {}, {}
        self.width = np.dtype(kind).itemsize
        self.ends = [b"", *[np.array(self.tokenizer.encode(p, add_special_tokens=False).ids,
                                     kind).tobytes() for p in MARKS],
                     np.array([end_id], kind).tobytes()]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another with the end id behind each, and their counts."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        step = np.flatnonzero(np.diff(sizes // TEXT_BYTES, prepend=-1))
        found = [self._some(texts[a:b]) for a, b in zip(step, [*step[1:], len(texts)])]
        if not found:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        return np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        ids, sizes = self._different(coded.dictionary)
        codes = np.insert(coded.indices.to_numpy(), ends, len(sizes) - 1)
        del split, coded
        upto = np.cumsum(sizes[codes])
        ids = _gathered(ids, sizes, codes)
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)

    def _different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after another, and their counts; last the end id."""
        mark = np.zeros(len(words), np.int64)
        for i, point in enumerate(MARKS):
            mark[pc.ends_with(words, point).to_numpy(zero_copy_only=False)] = i + 1
        cut = pc.utf8_slice_codeunits(words, 0, -1)
        base = pc.if_else(pa.array(mark > 0), cut, words)
        plain = pc.match_substring_regex(base, PLAIN)
        keys = pc.if_else(plain, pc.utf8_lower(base), words).dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        number = keys.indices.to_numpy()
        whole = np.zeros(len(keys.dictionary), bool)
        whole[number] = plain
        pieces = self._pieces(keys.dictionary.to_pylist(), whole) + self.ends
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        raw = np.frombuffer(b"".join(pieces), self.kind)
        # Each word is its piece and its mark, which is none for words encoded as a whole.
        first = len(keys.dictionary)
        parts = np.empty(2 * len(words) + 1, np.int64)
        parts[0:-1:2], parts[1:-1:2] = number, first + np.where(plain, mark, 0)
        parts[-1] = len(pieces) - 1
        total = np.add.reduceat(sizes[parts], np.arange(0, len(parts), 2))
        return _gathered(raw, sizes, parts), total

    def _pieces(self, keys: list[str], plain: np.ndarray) -> list[bytes]:
        """The ids of each key; unknown ones are learned."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older, odd = self.known, self.older, []
        tokenize, code = self.tokenizer.model.tokenize, self.code
        found = list(map(known.get, keys))
        for i, piece in enumerate(found):
            if piece is not None:
                continue
            key = keys[i]
            piece = older.get(key)
            if piece is None:
                if not plain[i]:
                    if key:
                        odd.append(i)
                        continue
                    piece = b""
                else:
                    text = key if key.isascii() else \
                        key.encode().decode("latin-1").translate(_BYTES)
                    piece = array(code, [t.id for t in tokenize(text)]).tobytes()
            known[key] = found[i] = piece
        if odd:
            for i, piece in zip(odd, self._encoded([keys[i] for i in odd])):
                known[keys[i]] = found[i] = piece
        return found

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        """Encode all words in one call and cut the ids at the words' offsets."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        raw = np.array(found.ids, self.kind).tobytes()
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        cuts = (np.searchsorted(offsets, starts) * self.width).tolist()
        return (raw[a:b] for a, b in zip(cuts, cuts[1:]))


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pieces `codes`, one after another, of pieces that lie behind each other in `ids`."""
    lengths = sizes[codes]
    first = (np.cumsum(sizes) - sizes)[codes]
    first -= np.cumsum(lengths) - lengths
    place = np.repeat(first.astype(np.int32), lengths)      # fewer than 2**31 ids by chunk
    place += np.arange(len(place), dtype=np.int32)
    return ids[place]


def _tokenizer(path: str, end_id: int, kind: str) -> WordTokens:
    """One for each worker process."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, end_id, kind)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokens(*key)
    return _TOKENIZERS[key]


def tokenized(df: DataFrame, tokenizer: str, end_id: int = 1, id_column: str = "doc_id",
              text_column: str = "text", source_column: str = "source", kind: str = "<u4"
              ) -> DataFrame:
    """One row per row: doc_id, source, spread (a hash), n, ids (little-endian, of `kind`).

    A null text is empty; every document ends with `end_id`.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = _tokenizer(tokenizer, end_id, kind), 0
        width = words.width
        for part in parts:
            ids, n = words.ids(part.column(part.schema.get_field_index("text")))
            ends = np.concatenate([[0], np.cumsum(n) * width]).astype(np.int32)
            place = np.arange(row, row + len(n), dtype=np.uint64)
            row += len(n)
            base = part.column(part.schema.get_field_index("spread")).to_numpy()
            # Rows repeated with one id and text are spread as well.
            mixed = (base.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")),
                 part.column(part.schema.get_field_index("source")),
                 pa.array((mixed >> np.uint64(1)).astype(np.int64)),
                 pa.array(n, pa.int64()),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends),
                                                             pa.py_buffer(ids)])],
                schema=_TOKENS)

    doc = column(id_column).cast("bigint")
    return df.select(
        doc.alias("doc_id"), column(source_column).cast("string").alias("source"),
        F.xxhash64(doc, column(text_column).cast("string")).alias("spread"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, "doc_id bigint, source string, spread bigint, n bigint, ids binary")


def fill(queues: list[Iterable[tuple[int, int]]], deficits: list[float], shares: list[float],
         size: int = 2048, grain: int = 256) -> Iterator[tuple[int, int, int, int, int]]:
    """Deficit round-robin: (row, start, length, window, offset) pieces of full windows.

    queues[s] has the (row, tokens) of source s.  After w + 1 windows its credit is
    deficits[s] + shares[s] * size * (w + 1) less what was served.  It is served once the credit
    covers `grain` tokens or the rest of its first document, so pieces do not get tiny.  If no
    queue has that credit before the window is full, the one that would have it next borrows.
    """
    waiting: list[tuple[float, int]] = []
    heads: list[deque] = [deque(q) for q in queues]
    start, served, rates = [0] * len(heads), [0] * len(heads), [s * size for s in shares]
    window, space = 0, size

    def ready(s: int) -> float:
        """The first window in which the queue has the credit."""
        need = min(grain, heads[s][0][1] - start[s]) + served[s] - deficits[s]
        return max(0, -(-need // rates[s]) - 1) if rates[s] > 0 else (
            0 if need <= 0 else float("inf"))

    for s, q in enumerate(heads):
        if q:
            heapq.heappush(waiting, (ready(s), s))
    active: deque[int] = deque()
    while waiting or active:
        while waiting and waiting[0][0] <= window:
            active.append(heapq.heappop(waiting)[1])
        if active:
            s = active.popleft()
            most = int(deficits[s] + rates[s] * (window + 1) - served[s])
        else:
            s, most = heapq.heappop(waiting)[1], 0
        row, tokens = heads[s][0]
        length = min(tokens - start[s], max(most, min(grain, tokens - start[s])), space)
        yield row, start[s], length, window, size - space
        start[s] += length
        served[s] += length
        space -= length
        if start[s] == tokens:
            heads[s].popleft()
            start[s] = 0
        if heads[s]:
            heapq.heappush(waiting, (ready(s), s))
        if not space:
            window, space = window + 1, size


def pack(df: DataFrame, tokenizer: str, targets: Mapping[str | None, float] | None = None,
         end_id: int = 1, size: int = 2048, grain: int = 256, partition_tokens: int = 1 << 21,
         with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text",
         source_column: str = "source") -> DataFrame:
    """One row per piece of a document: doc_id, source, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the token ids unless `with_ids` is off (then null).

    `tokenizer` is the path of a word tokenizer that every worker can read.  `targets` are the
    shares of the sources; without them, or for no source named, the shares of the corpus.  A
    source without a share is used to fill up.  A null text is empty and its document has the
    end id alone; a null source is a source; repeated rows are packed each.  Other columns are
    ignored.  An empty table gives an empty one.
    """
    from tokenizers import Tokenizer
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    tokens = stored(tokenized(df, tokenizer, end_id, id_column, text_column, source_column,
                              kind), "tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // partition_tokens))
    dealt = tokens.withColumn("part", F.pmod("spread", F.lit(parts)))
    counts = stored(dealt.groupBy("part", "source").agg(F.sum("n").alias("n")), "counts",
                    tokens.count())
    plan = _carried(counts, total, targets, size)

    def run(key: tuple, rows: pa.Table, plan: pa.Table) -> pa.Table:
        state = {r["source"]: r for r in plan.to_pylist()}
        order = sorted(state, key=lambda s: (s is None, s or ""))
        at = np.argsort(rows.column("spread").to_numpy(), kind="stable").tolist()
        source, n = rows.column("source").to_pylist(), rows.column("n").to_pylist()
        queues: dict = {s: [] for s in order}
        for i in at:
            queues[source[i]].append((i, n[i]))
        docs, held = rows.column("doc_id").to_pylist(), rows.column("ids")
        first, out, last, ids = plan.column("first")[0].as_py(), [], -1, None
        for i, start, length, window, offset in fill(
                [queues[s] for s in order], [state[s]["deficit"] for s in order],
                [state[s]["share"] for s in order], size, grain):
            if i != last:
                ids, last = np.frombuffer(held[i].as_buffer(), kind), i
            piece = ids[start:start + length]
            out.append((docs[i], source[i], start, length,
                        zlib.crc32(piece.astype("<u4").tobytes()), n[i], first + window, offset,
                        piece.astype(np.int32) if with_ids else None))
        columns = zip(*out) if out else [[]] * len(_PIECES)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return (dealt.groupBy("part").cogroup(plan.groupBy("part"))
            .applyInArrow(run, _PIECES_SQL))


def _carried(counts: DataFrame, total: int, targets: Mapping | None, size: int) -> DataFrame:
    """part, source, share, deficit, first: what each partition inherits from those before."""
    sums = counts.groupBy("source").agg(F.sum("n").alias("all"))
    if targets:
        named = {s: w for s, w in targets.items() if w > 0}
        spark, weight = counts.sparkSession, sum(named.values())
        wanted = spark.createDataFrame(
            [(s is None, s or "", w / weight) for s, w in named.items()],
            "none boolean, name string, share double")
        shares = sums.join(F.broadcast(wanted), (F.col("source").isNull() == F.col("none"))
                           & (F.coalesce("source", F.lit("")) == F.col("name")), "left").select(
            "source", F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        shares = sums.select("source", (F.col("all") / F.lit(float(max(total, 1)))).alias("share"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.ceil(F.col("n") / size)).over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    served = counts.withColumn("served", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return (served.join(starts, "part")
            .join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(
                F.col("of")))
            .select("part", "source", "share", F.col("first").cast("bigint"),
                    (F.col("share") * F.col("tokens") - F.col("served")).alias("deficit")))
