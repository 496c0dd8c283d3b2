"""Personal data: exact patterns, and a semi-Markov conditional random field that adds to them.

The patterns give the base spans.  The model sees the passages around digits and at signs, also
over line breaks, with runs of white space as one space.  It scores whole candidate segments of at
most `MOST_TOKENS` tokens by features of the span (its shape, digits, separators, checksum,
borders), and a dynamic program over segment ends chooses borders and kinds of a passage together.
Base spans are held fixed in that choice.

The weights are fitted to a bounded sample of passages of the corpus (`SAMPLE_PASSAGES`, those with
the smallest hash) and to `MADE_PASSAGES` made ones, in which spans follow each other as the
patterns cannot tell them apart.  The base spans are the labels of the corpus; variants of each
span that the patterns miss keep its label, and variants that break a checksum or a range lose it.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from credence.llm.common import column, packed, records
from credence.llm.quality import with_text

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
SAMPLE_PASSAGES = 1200
MADE_PASSAGES = 150
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins at the first digit of a run, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPACE = " \t\n\x0b\x0c\r"
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]", re.S)
_RUN = re.compile(r"[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+")
_UNEVEN = re.compile(r"[\t\n\x0b\x0c\r]|  ")
_INSIDE = frozenset(" .@-+()%_[]/")
_SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64()), ("base", pa.bool_())]))
Span = tuple[int, int, int]     # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: int, text: str) -> bool:
    if kind == 1:
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind.  Linear in the text."""
    found: list[Span] = []
    past, at = 0, text.find("@")
    while at >= 0:      # the local part is the run before an at sign
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            past = domain.end()
            found.append((start, past, 0))
        at = text.find("@", max(at + 1, past))
    if _ANY.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)
                      if _valid(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def passages(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a digit or an at sign, white space with one line break at most between
    them.  An at sign at the border of its chunk brings the chunk beyond that border along."""
    begin = end = -1
    hit = _ANY.search(text)
    while hit:
        left = max(text.rfind(c, max(end, 0), hit.start()) for c in _SPACE) + 1
        left = max(left, end, 0)
        right = hit.end()
        while right < len(text) and text[right] not in _SPACE:
            right += 1
        if text[left] == "@":
            before = left
            while before > max(end, 0) and text[before - 1] in _SPACE:
                before -= 1
            if before > max(end, 0) and _one_run(text, before, left):
                left = max(max(text.rfind(c, max(end, 0), before) for c in _SPACE) + 1, end, 0)
        if text[right - 1] == "@":
            after = right
            while after < len(text) and text[after] in _SPACE:
                after += 1
            if after < len(text) and _one_run(text, right, after):
                right = after
                while right < len(text) and text[right] not in _SPACE:
                    right += 1
        if begin >= 0 and _one_run(text, end, left):
            end = right
        else:
            if begin >= 0:
                yield begin, end
            begin, end = left, right
        hit = _ANY.search(text, end)
    if begin >= 0:
        yield begin, end


def _one_run(text: str, start: int, end: int) -> bool:
    """Whether only white space with one line break at most is between the offsets."""
    return not text[start:end].strip(_SPACE) and text.count("\n", start, end) <= 1


def flattened(passage: str, spans: Sequence[Span]) -> tuple[str, list[Span], Sequence[int]]:
    """The passage with each run of white space as one space, its spans there, and the offset in
    the passage of each character."""
    if not _UNEVEN.search(passage):
        return passage, list(spans), range(len(passage))
    text, places = "", []
    for m in _RUN.finditer(passage):
        text += " " if m[0][0] in _SPACE else m[0]
        places += [m.start()] if m[0][0] in _SPACE else range(m.start(), m.end())
    return text, [(bisect_left(places, a), bisect_left(places, b - 1) + 1, k)
                  for a, b, k in spans], places


def _code(token: str) -> str:
    if token.isdigit():
        n = len(token)
        return "d" + str(n if n < 5 else 5 if n < 7 else 7 if n < 9 else 9 if n < 12 else
                         12 if n < 20 else 20)
    return "a" if token.isalpha() else "x" if token.isalnum() else token


def candidates(text: str, fixed: Sequence[Span] = ()) -> tuple[int, list, list]:
    """Number of token borders, border offsets, and (from, to, features) of all segments.

    A segment lies inside none of the fixed spans and has a digit or an at sign.
    """
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    taken = np.zeros(len(text) + 1, bool)
    for a, b, _ in fixed:
        taken[a:b] = True
    codes = [_code(t) for *_, t in tokens]
    out = []
    for i, (a, _, first) in enumerate(tokens):
        if not (first.isalnum() or first in "+(") or not first.isascii() or taken[a]:
            continue
        shape, digits, signs = "", "", set()
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            _, b, last = tokens[j]
            if taken[b - 1] or not (last in _INSIDE or last.isascii() and last.isalnum()):
                break
            shape += codes[j]
            if last.isalnum():
                digits += _digits(last)
            else:
                signs.add(last)
                continue
            if not digits and "@" not in signs:
                continue
            out.append((i, j + 1, _features(text, a, b, shape, digits, signs, codes[i],
                                            codes[j])))
    return len(tokens), [t[0] for t in tokens] + [len(text)], out


def _features(text: str, a: int, b: int, shape: str, digits: str, signs: set, first: str,
              last: str) -> list[str]:
    n, groups = len(digits), [g for g in re.split(r"[^0-9]+", text[a:b]) if g]
    border = ("^" if a == 0 or text[a - 1] in _SPACE else text[a - 1]
              if not text[a - 1].isalnum() else "w") + \
        ("$" if b == len(text) or text[b] in _SPACE else text[b] if not text[b].isalnum()
         else "w")
    out = ["bias", "s:" + shape, f"n:{min(n, 20)}", "k:" + "".join(sorted(signs)),
           "b:" + border, f"f:{first}", f"l:{last}", f"g:{min(len(groups), 8)}",
           f"a:{'a' in shape or 'x' in shape}"]
    if 12 <= n <= 19:
        out += [f"luhn:{luhn(digits)}", f"luhn:{luhn(digits)}:{''.join(sorted(signs))}"]
    if len(groups) == 4:
        small = all(int(g) <= 255 for g in groups if len(g) < 6) and max(map(len, groups)) < 4
        out.append(f"octets:{small}:{''.join(sorted(signs))}")
    if "@" in signs:
        name, _, host = text[a:b].partition("@")
        out.append(f"at:{bool(name.strip())}:{'.' in host}:{' ' in host.strip()}:"
                   f"{' ' in name.strip()}")
    if 9 <= n <= 15:
        out.append(f"tel:{first}:{''.join(sorted(signs))}")
    return out


@dataclass
class Model:
    """Weights: a row for each feature, a column for each kind."""

    index: dict[str, int]
    weights: np.ndarray

    def scores(self, segments: list) -> np.ndarray:
        return np.array([self.weights[[self.index[f] for f in fs if f in self.index]].sum(0)
                         for _, _, fs in segments]).reshape(-1, len(KINDS))

    def decode(self, text: str, fixed: Sequence[Span] = ()) -> list[Span]:
        """The best segmentation of a passage: spans besides the fixed ones."""
        n, offsets, segments = candidates(text, fixed)
        if not segments:
            return []
        scores = self.scores(segments)
        kinds = scores.argmax(1).tolist()
        ends: list[list] = [[] for _ in range(n + 1)]
        for (i, j, _), k, s in zip(segments, kinds, scores.max(1).tolist()):
            if s > 0:       # a segment below the score of no segment is never chosen
                ends[j].append((i, k, s))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, k, s in ends[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((offsets[i], offsets[j], k))
                j = i
        return out[::-1]


def variants(text: str, spans: Sequence[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The passage itself, and versions of it with one span changed."""
    yield text, list(spans)
    for at, (a, b, kind) in enumerate(spans):
        span, before, after = text[a:b], text[:a], text[b:]
        others = [s for s in spans if s[1] <= a] + [
            (x, y, k) for x, y, k in spans if x >= b]

        def changed(new: str, label: bool, a=a, b=b, kind=kind, others=others,
                    before=before, after=after):
            moved = [s if s[1] <= a else (s[0] + len(new) - (b - a), s[1] + len(new) - (b - a),
                                          s[2]) for s in others]
            return before + new + after, sorted(moved + [(a, a + len(new), kind)] * label)

        digits = _digits(span)
        if kind == 0:
            name, _, host = span.partition("@")
            yield changed(f"{name} @ {host}", True)
            yield changed(f"{name}@{host.split('.')[0]}", False)
            yield changed(f"{name} @ {host.split('.')[0]}", False)
        elif kind == 1:
            yield changed(span.replace(".", "[.]"), True)
            yield changed(".".join(str(int(p) + 300) for p in span.split(".")), False)
            yield changed(".".join(span.split(".")[:3]), False)
        elif kind == 2:
            groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
            wrong = digits[:-1] + str((int(digits[-1]) + 1 + at % 8) % 10)
            yield changed(".".join(groups), True)
            yield changed(" ".join(groups), True)
            yield changed("/".join(groups), True)
            yield changed(wrong, False)
            yield changed(".".join([wrong[i:i + 4] for i in range(0, len(wrong), 4)]), False)
            yield changed(digits[:8], False)
            yield changed(digits * 2, False)
        elif len(digits) >= 10:
            rest = digits[-10:]
            yield changed(f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", True)
            yield changed(f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", True)
            yield changed(f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", True)
            yield changed(rest, False)
            yield changed(f"{rest[:4]}-{rest[4:6]}-{rest[6:8]}", False)
            yield changed(f"{rest[:3]}-{rest[3:5]}", False)


def made_passages(n: int = MADE_PASSAGES, seed: int = 0) -> list[tuple[str, list[Span]]]:
    """Passages of one to three labelled spans with a space between."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(
        rng.randint(2, 8)))

    def card() -> str:
        digits = rng.choice("3456") + number(rng.choice([13, 14, 14, 14]))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return digits if rng.random() < 0.7 else " ".join(
            digits[i:i + 4] for i in range(0, len(digits), 4))

    make = [lambda: f"{name()}{rng.choice(['.', '_', ''])}{number(2)}@{name()}.{name()}.com",
            lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card,
            lambda: f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for kind in rng.choices(range(len(KINDS)), k=rng.randint(1, 3)):
            text += " " * bool(text)
            spans.append((len(text), 0, kind))
            text += make[kind]()
            spans[-1] = (spans[-1][0], len(text), kind)
        out.append((text, spans))
    return out


def fit(sample: Sequence[tuple[str, Sequence[Span]]], epochs: int = 6, rate: float = 0.5,
        decay: float = 1e-4) -> Model:
    """Maximise the likelihood of the labelled passages; the same sample gives the same model."""
    cases, seen = [], Counter()
    for text, spans in sample:
        for new, labels in variants(text, spans):
            n, offsets, segments = candidates(new)
            gold = set(labels)
            if segments and len(segments) < 3000:       # a very long passage teaches no more
                cases.append((n, offsets, segments, gold))
                seen.update(f for *_, fs in segments for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c > 1))}
    model = Model(index, np.zeros((len(index), len(KINDS))))
    ready = []
    for n, offsets, segments, gold in cases:
        rows = [[index[f] for f in fs if f in index] for *_, fs in segments]
        flat = np.array([r for row in rows for r in row], np.int64)
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        right = np.array([[(offsets[i], offsets[j], k) in gold for k in range(len(KINDS))]
                          for i, j, _ in segments], float)
        ready.append((n, [(i, j) for i, j, _ in segments], flat, starts,
                      np.repeat(np.arange(len(rows)), [len(r) for r in rows]), right))
    squares = np.full(model.weights.shape, 1e-8)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for at in order.permutation(len(ready)):
            n, ends, flat, starts, owner, right = ready[at]
            scores = np.add.reduceat(model.weights[flat], starts, axis=0)
            gradient = (right - _marginals(n, ends, scores))[owner]
            rows, place = np.unique(flat, return_inverse=True)
            step = np.zeros((len(rows), len(KINDS)))
            np.add.at(step, place, gradient)
            step -= decay * model.weights[rows]
            squares[rows] += step * step
            model.weights[rows] += rate * step / np.sqrt(squares[rows])
    return model


def _marginals(n: int, ends: list, scores: np.ndarray) -> np.ndarray:
    """Probability of every segment and kind, by the forward and backward sums."""
    summed = np.logaddexp.reduce(scores, axis=1).tolist()
    into: list[list] = [[] for _ in range(n + 1)]
    outof: list[list] = [[] for _ in range(n + 1)]
    for (i, j), s in zip(ends, summed):
        into[j].append((i, s))
        outof[i].append((j, s))
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _add([ahead[j - 1]] + [ahead[i] + s for i, s in into[j]])
    for i in range(n - 1, -1, -1):
        behind[i] = _add([behind[i + 1]] + [behind[j] + s for j, s in outof[i]])
    base = np.array([ahead[i] + behind[j] - ahead[n] for i, j in ends])
    return np.exp(scores + base[:, None])


def _add(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    most = max(values)
    return most + float(np.log(sum(np.exp(v - most) for v in values)))


def labelled_passages(df: DataFrame, text_column: str = "text",
                      most: int = SAMPLE_PASSAGES) -> list[tuple[str, list[Span]]]:
    """At most `most` different passages of up to 400 characters with the base spans inside,
    those with the smallest hash.  Both bounds are of the training sample only."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = {t[a:b] for (t,) in records(part, "text") if t for a, b in passages(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())],
                                             names=["passage"])

    found = (df.select(column(text_column).cast("string").alias("text"))
             .mapInArrow(run, "passage string").where("length(passage) <= 400").distinct()
             .orderBy(F.xxhash64("passage"), "passage").limit(most))
    return [flattened(r["passage"], base_spans(r["passage"]))[:2] for r in found.collect()]


def train(df: DataFrame, text_column: str = "text", most: int = SAMPLE_PASSAGES) -> Model:
    """A model of this corpus."""
    return fit([(text, _disjoint(spans)) for text, spans in
                labelled_passages(df, text_column, most)] + made_passages())


def _disjoint(spans: list[Span]) -> list[Span]:
    """Spans that do not overlap, earlier and longer ones first."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def all_spans(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """Base spans, and those the model adds beside them: (start, end, kind, is base)."""
    base = base_spans(text)
    out = [(a, b, k, True) for a, b, k in base]
    at = 0
    for a, b in passages(text):
        while at < len(base) and base[at][1] <= a:
            at += 1
        inside = [(max(x, a) - a, min(y, b) - a, k) for x, y, k in
                  takewhile(lambda s: s[0] < b, islice(base, at, None)) if y > a]
        flat, fixed, places = flattened(text[a:b], inside)
        out += [(places[x] + a, places[y - 1] + 1 + a, k, False)
                for x, y, k in model.decode(flat, fixed)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def personal_data(df: DataFrame, model: Model, text_column: str = "text",
                  carry: Sequence[str] | None = None) -> DataFrame:
    """One row per row: row (the columns `carry` of `df`, or all) and spans.

    spans are structs of kind, start, end (code points, end exclusive) and base, by start and
    kind.  A null text is empty and has none.  Repeated rows each get a row.
    """
    held = df.sparkSession.sparkContext.broadcast(model)    # at most a few thousand features

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base}
                      for a, b, k, base in all_spans(text or "", held.value)]
                     for (text,) in records(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("row")),
                 pa.array(found, _SPANS_ARROW)], names=["row", "spans"])

    kept = df.columns if carry is None else carry
    rows = df.select(F.struct(*map(column, kept)).alias("row"),
                     column(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"],
                                              T.StructField("spans", _SPANS)]))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact_text(text: str, spans: Sequence[tuple]) -> str:
    """Spans (start, end, kind, ...) in order; overlapping ones are replaced together, by the kind
    that begins first."""
    out, at = [], 0
    for begin, end, kind, *_ in spans:
        if begin >= at:
            out += [text[at:begin], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, model: Model, text_column: str = "text",
             length_column: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `df`, each span replaced by its kind in brackets."""
    held = df.sparkSession.sparkContext.broadcast(model)
    return with_text(packed(df), df, text_column, length_column,
                     lambda text: redact_text(text, all_spans(text, held.value)))
