"""Toxicity by a subsequence string kernel and a support vector machine.

A word of a sentence, with what follows it, is compared with a landmark (a word
taken from labelled training sentences) by the subsequences of four characters
they share. A subsequence may skip characters: every skipped one costs a factor
``DECAY``, and at most three are skipped in all. So an insult with inserted or
dropped letters, or a blank inside, still scores. Marks inside words and blanks
between single letters are no characters ("i.d.i.o.t", "i d i o t").

The landmarks' own kernel matrix maps words into a space (Nystroem) in which a
linear support vector machine with squared hinge loss is fitted. A label holds
for a whole text, so of the sentences of toxic texts only the words that score
stay examples, those of clean texts that score are added, and the fit is
repeated. A text scores by the worst word of its worst sentence, through a
logistic curve fitted on the training texts.

As kernel and machine are both sums, the fitted model is a table of one weight
for each possible subsequence. Scoring a text looks up all its gapped
subsequences, so the work grows with its length and not with the landmarks.

Labels are learnt from at most ``max_docs`` toxic rows and ``CLEAN_TIMES`` as
many others, and from ``MAX_CHARS`` characters of whole texts at most, chosen by a
hash of the doc_id among the labelled documents that have a text. Nothing but the
text enters a score.

Defined results: a null or empty text scores as one without any
subsequence; a repeated row scores like the first; null labels and labels for
unknown documents are not learnt from; without examples of both classes every
score is below 1e-200, with a warning. A null doc_id is scored like others and never learnt
from. Columns other than the text are passed through untouched.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contexture.llm import words
from contexture.llm.tables import free_name

MAX_DOCS = 200
#: Characters that are learnt from, a quarter of them of toxic texts.
MAX_CHARS = 8_000_000
LANDMARKS = 128
RIDGE = 0.001
DECAY = 0.6
CLEAN_TIMES = 6
HARD = 5_000
TOXIC_SHARE = 0.2
MARGIN = 3.0

_SIDE = 6  # the last character is at most so many places after the first
_GAPS = [
    (a, b, c)
    for a in (1, 2, 3, 4)
    for b in (1, 2, 3, 4)
    for c in (1, 2, 3, 4)
    if a + b + c <= _SIDE
]
_SLICE = 1 << 16
_PART = 1 << 18

# Characters of subsequences: 1-26 are letters, 27-31 stand for bytes of letters
# beyond ASCII. Everything else is 0, which can only be skipped.
_CODES = np.zeros(256, dtype=np.uint8)
_CODES[0x61:0x7B] = np.arange(1, 27)
_CODES[0x41:0x5B] = np.arange(1, 27)
_CODES[0x80:0xC0] = 27 + np.arange(64) % 5

@dataclass
class Coded:
    """Texts as character codes with room between them, and where each word begins."""

    codes: np.ndarray
    begins: np.ndarray
    texts: np.ndarray
    kept: np.ndarray  # of all blank-separated words, those that begin one here

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Coded:
        count = len(offsets) - 1
        starts, ends, first = words.spans(raw, offsets, words.NOT_BLANK)
        owner = np.repeat(np.arange(count), np.diff(first))
        # Marks are dropped and so are blanks between single letters; other
        # blanks stay, as two places that must be skipped.
        known = _CODES[raw]
        kept = (known > 0) | ~words.NOT_BLANK[raw]
        single = ends - starts == 1
        spaced = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (owner[1:] == owner[:-1])
        kept[starts[1:][spaced] - 1] = False
        blank = kept & (known == 0)
        kind = np.int32 if 2 * len(raw) + (count + 1) * _SIDE < 1 << 31 else np.int64
        before = np.zeros(len(raw) + 1, dtype=kind)
        np.cumsum(kept.view(np.uint8) + blank.view(np.uint8), dtype=kind, out=before[1:])
        shift = np.arange(count, dtype=kind) * kind(_SIDE)
        codes = np.zeros(int(before[-1]) + (count + 1) * _SIDE, dtype=np.int32)
        place = before[:-1]
        place += np.repeat(shift, np.diff(offsets))
        codes[place[kept]] = known[kept]
        first_letter = np.ones(len(starts), dtype=bool)
        first_letter[1:] = ~spaced
        return cls(codes, place[starts[first_letter]], owner[first_letter], first_letter)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Words from one number to another, and their codes with what may follow them.

        So that what is worked out for each place is never there for all places at once.
        """
        first = 0
        while first < len(self.begins):
            last = int(np.searchsorted(self.begins, self.begins[first] + _PART))
            end = self.begins[last] + _SIDE if last < len(self.begins) else len(self.codes)
            yield first, last, self.codes[self.begins[first] : end]
            first = last

    def sums(self, table: np.ndarray) -> np.ndarray:
        """The weight of all subsequences of each word."""
        out = np.empty(len(self.begins), dtype=np.float64)
        for first, last, codes in self.parts():
            values = _scan(codes, table)[: len(codes) - _SIDE].astype(np.float64)
            out[first:last] = np.add.reduceat(values, self.begins[first:last] - self.begins[first])
        return out


def _subsequences(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every way to skip: how much, and the number of the subsequence at each place."""
    length = len(codes) - _SIDE
    if length <= 0:
        return
    high = codes << 15
    for a, b, c in _GAPS:
        at = high[:length] | (codes[a : a + length] << 10)
        at |= codes[a + b : a + b + length] << 5
        at |= codes[a + b + c : a + b + c + length]
        yield a + b + c - 3, at


def _features(text: str) -> dict[int, float]:
    """The subsequences of a short string without skipped ones, and their weights."""
    codes = [int(_CODES[x]) for x in text.encode()]
    codes += [0] * _SIDE
    out: dict[int, float] = {}
    for k in range(len(codes) - _SIDE):
        for a, b, c in _GAPS:
            four = codes[k], codes[k + a], codes[k + a + b], codes[k + a + b + c]
            if all(four):
                at = four[0] << 15 | four[1] << 10 | four[2] << 5 | four[3]
                out[at] = out.get(at, 0.0) + DECAY ** (a + b + c - 3)
    return out


def _scan(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The weight of all subsequences that begin at each place."""
    out = np.zeros(len(codes), dtype=np.float32)
    for begin in range(0, len(codes) - _SIDE, _SLICE):
        own = codes[begin : begin + _SLICE + _SIDE]
        by_skip = [np.zeros(len(own) - _SIDE, dtype=np.float32) for _ in range(4)]
        high, mid = own << 15, own << 10
        low = own << 5
        length = len(own) - _SIDE
        for a in (1, 2, 3, 4):
            one = high[:length] | mid[a : a + length]
            for b in range(1, _SIDE - a):
                two = one | low[a + b : a + b + length]
                for c in range(1, _SIDE - a - b + 1):
                    at = two | own[a + b + c : a + b + c + length]
                    by_skip[a + b + c - 3] += table[at]
        total = by_skip[3]
        for skipped in (2, 1, 0):
            total = total * np.float32(DECAY) + by_skip[skipped]
        out[begin : begin + length] = total
    return out


@dataclass
class Model:
    """Weights of subsequences; ``bias`` and the curve turn their sums into scores."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The worst word's margin for each text, within ``MARGIN``: beyond it says no more."""
        coded = Coded.of(raw, offsets)
        worst = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(worst, coded.texts, coded.sums(self.table))
        worst = np.where(np.isfinite(worst), worst, 0.0) + self.bias
        return np.clip(worst, -MARGIN, MARGIN)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        value = self.slope * self.margins(raw, offsets) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(value, -500, 500)))


def _nothing() -> Model:
    warnings.warn("no examples of both classes to learn from: every score is nearly 0", stacklevel=3)
    return Model(np.zeros(1 << 20, dtype=np.float32), 0.0, 0.0, -600.0)


def _words(text: str) -> set[str]:
    found = {word.strip(".,;:!?\"'()") for word in text.lower().split()}
    return {word for word in found if 4 <= len(word) <= 24}


def _telling(toxic: int, all_: int, rate: float) -> bool:
    """Whether a word stands in several toxic texts, and five times as often as in others.

    ``rate`` is the share of toxic texts.
    """
    return toxic >= 2 and toxic * (1 - rate) >= 5 * rate * (all_ - toxic)


def _told(owned: list[list[str]], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the words that tell."""
    seen: dict[str, list[int]] = {}
    for own, label in zip(owned, toxic.tolist(), strict=True):
        for word in own:
            seen.setdefault(word, [0, 0])[label] += 1
    rate = float(toxic.mean())
    found = sorted(word for word, (good, bad) in seen.items() if _telling(bad, good + bad, rate))
    raw, offsets = words.text_bytes(pa.array(found, pa.string()))
    return words.hashes(raw, offsets[:-1], offsets[1:])


def _landmarks(owned: list[list[str]], toxic: np.ndarray, count: int) -> list[str]:
    """Words: three of four such as toxic texts have and others seldom, the rest frequent ones.

    Each is the one that most toxic texts have, a text counting half as much for
    every landmark it has already; so rarer kinds of insult get theirs too.
    """
    seen: dict[str, int] = {}
    gain: dict[str, float] = {}
    having: dict[str, list[int]] = {}
    for k, found in enumerate(owned):
        for word in found:
            seen[word] = seen.get(word, 0) + 1
            if toxic[k]:
                gain[word] = gain.get(word, 0.0) + 1.0
                having.setdefault(word, []).append(k)
    rate = float(toxic.mean())
    gain = {word: n for word, n in gain.items() if _telling(int(n), seen[word], rate)}
    weight = toxic.astype(float)
    chosen: list[str] = []
    while gain and len(chosen) < count * 3 // 4:
        best = max(gain, key=lambda word: (gain[word], word))
        if _features(best):
            chosen.append(best)
        for k in having[best]:
            for word in owned[k]:
                if word in gain:
                    gain[word] -= weight[k] / 2
            weight[k] /= 2
        del gain[best]
    taken = set(chosen)
    rest = sorted(seen, key=lambda word: (-seen[word], word))
    rest = [word for word in rest[: 4 * count] if word not in taken and _features(word)]
    return chosen + rest[: count - len(chosen)]


def _kernel(
    coded: Coded, chosen: np.ndarray, columns: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """The kernel of every chosen word with every landmark.

    ``columns`` numbers the landmarks' subsequences (-1: in none), ``weights``
    has a row for each of these.
    """
    count = int(np.count_nonzero(chosen))
    place = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
    found, totals = [], []
    for first, last, codes in coded.parts():
        if not chosen[first:last].any():
            continue
        room = np.diff(coded.begins[first:last] - coded.begins[first], append=len(codes))
        owner = np.repeat(place[first:last], room)
        keys, values = [], []
        for skipped, at in _subsequences(codes):
            column = columns[at]
            hit = np.flatnonzero((column >= 0) & (owner[: len(at)] >= 0))
            keys.append(owner[hit].astype(np.int64) * len(weights) + column[hit])
            values.append(np.full(len(hit), DECAY**skipped))
        if not keys:
            continue
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(values), minlength=len(own))
        found.append(own)
        totals.append(total.astype(np.float32))
    # Words are numbered in order, so these are in order too.
    where = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    total = np.concatenate(totals) if totals else np.empty(0, dtype=np.float32)
    out = np.zeros((count, weights.shape[1]), dtype=np.float32)
    rows, own = where // len(weights), where % len(weights)
    for begin in range(0, len(where), 50_000):
        part = slice(begin, begin + 50_000)
        new = np.flatnonzero(np.diff(rows[part], prepend=-1))
        ends = np.append(new[1:], len(rows[part]))
        for some in np.array_split(np.arange(len(new)), 16):
            if len(some):
                at = slice(begin + new[some[0]], begin + ends[some[-1]])
                terms = weights[own[at]] * total[at, None]
                out[rows[part][new[some]]] += np.add.reduceat(terms, new[some] - new[some[0]], axis=0)
    return out


def _with_bias(z: np.ndarray) -> np.ndarray:
    return np.hstack([z, np.ones((len(z), 1), dtype=np.float32)])


def _products(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``z @ w`` in double precision, without all of ``z`` in it."""
    return np.concatenate([z[at : at + 4096] @ w for at in range(0, max(1, len(z)), 4096)])


def _machine(
    z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, w: np.ndarray | None
) -> np.ndarray:
    """Squared-hinge support vector machine in the primal, by Newton steps from ``w``.

    The last value is the bias, the last column of ``z`` all ones.
    """
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = ridge * 1e-3
    active = np.ones(len(y), dtype=bool) if w is None else y * _products(z, w) < 1
    for _ in range(15):
        own = z[active]
        scaled = (own * weight[active, None].astype(np.float32)).T
        w = np.linalg.solve(np.diag(penalty) + scaled @ own, scaled @ y[active])
        del own, scaled
        now = y * _products(z, w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _curve(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins.

    Targets are smoothed and both classes weigh the same; margins are scaled,
    and a step that does not lower the loss is halved.
    """
    good, bad = (toxic == 0).sum(), (toxic == 1).sum()
    target = np.where(toxic == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    weight = np.where(toxic == 1, 0.5 / bad, 0.5 / good)
    middle, scale = margin.mean(), margin.std() or 1.0
    x = np.stack([(margin - middle) / scale, np.ones(len(margin))], axis=1)

    def loss(w: np.ndarray) -> float:
        value = x @ w
        return float(weight @ (np.logaddexp(0, value) - target * value)) + 1e-6 * float(w @ w)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (p - target)) + 2e-6 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 5) -> Model:
    """The model of labelled texts (1: toxic)."""
    label = np.array(toxic, dtype=np.int64)
    if len(set(toxic)) < 2:
        return _nothing()
    owned = [sorted(_words(text)) for text in texts]
    chosen = [_features(word) for word in _landmarks(owned, label, landmarks)]
    if not chosen:
        return _nothing()
    ids = sorted({at for own in chosen for at in own})
    columns = np.full(1 << 20, -1, dtype=np.int32)
    columns[ids] = np.arange(len(ids))
    weights = np.zeros((len(ids), len(chosen)), dtype=np.float32)
    for k, own in enumerate(chosen):
        norm = np.sqrt(sum(v * v for v in own.values()))
        for at, value in own.items():
            weights[columns[at], k] = value / norm
    raw, offsets = words.text_bytes(pa.array(texts, pa.string()))
    coded = Coded.of(raw, offsets)
    if not len(coded.begins):
        return _nothing()
    values, vectors = np.linalg.eigh((weights.T @ weights).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    # Examples of toxic texts: words that tell, and after each fit all that score.
    # Of the others: every 32nd word, and those that come out as wrong or nearly.
    bad = label[coded.texts] == 1
    starts, ends, _ = words.spans(raw, offsets, words.NOT_BLANK)
    told = bad & np.isin(words.hashes(raw, starts, ends), _told(owned, label))[coded.kept]
    if not told.any():
        return _nothing()
    new = told | (~bad & (np.arange(len(bad)) % 32 == 0))
    rows, z = np.flatnonzero(new), _with_bias(_kernel(coded, new, columns, weights) @ root)
    w = None
    for _ in range(rounds):
        y = np.where(bad[rows], 1.0, -1.0)
        share = np.where(y > 0, TOXIC_SHARE / (y > 0).sum(), (1 - TOXIC_SHARE) / (y < 0).sum())
        w = _machine(z, y, share * len(y), RIDGE, w)
        table = np.zeros(1 << 20, dtype=np.float32)
        table[ids] = weights @ (root @ w[:-1])
        margin = coded.sums(table) + w[-1]
        seen = np.zeros(len(bad), dtype=bool)
        seen[rows] = True
        new = ~seen & np.where(bad, margin > 0, margin > -1)
        if new.sum() > HARD:
            new &= margin >= np.partition(margin[new], -HARD)[-HARD]
        if new.any():
            rows = np.concatenate([rows, np.flatnonzero(new)])
            z = np.concatenate([z, _with_bias(_kernel(coded, new, columns, weights) @ root)])
        keep = ~bad[rows] | told[rows] | (margin[rows] > 0)
        rows, z = rows[keep], z[keep]
    model = Model(table, float(w[-1]), 1.0, 0.0)
    model.slope, model.shift = _curve(model.margins(raw, offsets), label)
    return model


def _fitting(lengths: Sequence[int], count: int, room: int) -> list[int]:
    """Places of the first ``count`` texts that fit, one after another, into ``room``."""
    found: list[int] = []
    for at, length in enumerate(lengths):
        if length <= room and len(found) < count:
            found.append(at)
            room -= length
    return found


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = MAX_DOCS,
    held_out=None,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """``doc_id, toxic, text``: at most ``max_docs`` toxic rows and ``CLEAN_TIMES`` as many others.

    Only labels of documents with a text count; of these, the first by a hash of
    their doc_id that fit, whole, into the characters there are. ``held_out`` is a
    condition on doc_id of rows never learnt from. Collected: the ids and lengths
    of twice as many rows as are learnt from.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    lengths = texts.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("length"))
    known = known.join(lengths, "doc_id")
    chosen = []
    for kind, count, room in (
        (0, CLEAN_TIMES * max_docs, max_chars - max_chars // 4),
        (1, max_docs, max_chars // 4),
    ):
        first = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id")
        first = first.limit(2 * count).collect()
        chosen += [first[at] for at in _fitting([row["length"] for row in first], count, room)]
    ids = docs.sparkSession.createDataFrame(chosen, known.schema).select("doc_id", "toxic")
    # A repeated doc_id is one example, so the bounds hold for texts too.
    rows = texts.join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(
    docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, held_out=None
) -> Model:
    rows = training_rows(docs, labels, max_docs, held_out).collect()
    rows.sort(key=lambda row: row["doc_id"])
    return fit([row["text"] for row in rows], [int(row["toxic"]) for row in rows])


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of its text, under a free name if ``score`` is taken."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    score = free_name(docs, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in words.chunks(batches, text):
            found = pa.array(sent.value.scores(raw, offsets))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found], names=[*batch.schema.names, score]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, held_out=None) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    score = free_name(docs, "toxicity")
    found = scored(docs, train(docs, labels, held_out=held_out), score=score)
    return found.where(F.col(score) < threshold).select(*docs.columns)
