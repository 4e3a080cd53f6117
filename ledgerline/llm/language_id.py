"""Language ID by a linear-chain conditional random field over words.

A document's words (maximal runs of letters) are labelled with languages;
its language is the one with the most expected words, its score that share.

- Features of a word: prefixes and suffixes of 1 to 3 letters, 2- and
  3-grams of the word with its borders, and membership in each language's
  lexicon. The label score of a word is the sum of its features' weights.
- Transitions between neighbouring labels are learned with the features.
- Marginals come from forward-backward. Words of a batch of documents are
  laid out in segments of equal length; segment transfer matrices link the
  segments of a document, so long texts are exact and need no loop over
  their words in Python.

Training is bounded: ``PER_LANGUAGE`` windows of at most ``WINDOW`` words per
language, taken at a hashed place of documents chosen by a hash of the row.
Windows of different languages are also strung together, which is what
teaches switching inside a text. The model (weights, lexicon, transitions)
is a few megabytes at most and is the same for every input size.

Defined results: a null text or one without a letter is ``und`` with score 0.
Rows with a null lang or doc_id are not learned from; a null doc_id is not
held out. With no language learned every document is ``und``. Repeated rows
are labelled alike; other columns pass through unchanged.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import words

PER_LANGUAGE = 400
WINDOW = 64
MIN_FEATURE = 2
LEXICON_MIN = 3
LEXICON_SHARE = 0.8
STEPS = 60
RATE = 0.15
DECAY = 1e-4
SEED = 1
SEGMENT = 64
BATCH_WORDS = 100_000
CACHE_WORDS = 200_000
SCORE_WORDS = 10_000
UNKNOWN = "und"
MIN_CONFIDENCE = 0.4
HASH_SPACE = 1 << 30

LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Lower-case words of a text: runs of letters in composed form."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        return [w for w in LETTERS.findall(text.lower()) if w.isalpha()]
    return LETTERS.findall(text.lower())


def features(word: str) -> list[str]:
    """Affix and n-gram features of a word."""
    n = len(word)
    out = [f"^{word[:k]}" for k in (1, 2, 3) if k <= n] + [f"{word[-k:]}$" for k in (1, 2, 3) if k <= n]
    b = f"<{word}>"
    out += [b[i:i + 2] for i in range(len(b) - 1)]
    out += [b[i:i + 3] for i in range(len(b) - 2)]
    return out


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]        # feature -> row of weights
    lexicon: dict[str, int]      # word -> label
    weights: np.ndarray          # features + one row per lexicon label, labels
    move: np.ndarray             # transition weights, from x to

    def scores(self, found: list[str]) -> np.ndarray:
        """Label scores of words: the sums of their features' weights; SCORE_WORDS at a time bound the memory."""
        if len(found) > SCORE_WORDS:
            return np.concatenate([self.scores(found[i:i + SCORE_WORDS]) for i in range(0, len(found), SCORE_WORDS)])
        flat, ends, base = [], [], len(self.index)
        get, lex = self.index.get, self.lexicon.get
        for w in found:
            flat += [i for i in map(get, features(w)) if i is not None]
            k = lex(w)
            if k is not None:
                flat.append(base + k)
            ends.append(len(flat))
        out = np.zeros((len(found), len(self.labels)), np.float32)
        if flat:
            total = np.concatenate((np.zeros((1, out.shape[1])), np.cumsum(self.weights[flat], axis=0, dtype=np.float64)))
            ends = np.array(ends)
            out[:] = total[ends] - total[np.concatenate(([0], ends[:-1]))]
        return out


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-30)


def marginals(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Label marginals of every word; ``scores`` holds the documents' words one after another."""
    n, k = scores.shape
    a = np.exp(move - move.max()).astype(np.float32)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    per = -(-lengths // SEGMENT)                       # segments of each document
    seg_doc = np.repeat(np.arange(len(lengths)), per)
    place = np.arange(len(seg_doc)) - np.repeat(np.cumsum(per) - per, per)
    starts = np.cumsum(lengths) - lengths
    word = starts[seg_doc][:, None] + place[:, None] * SEGMENT + np.arange(SEGMENT)
    real = word < (starts + lengths)[seg_doc][:, None]
    em = e[np.minimum(word, n - 1)]                    # segments, SEGMENT, labels
    m = len(seg_doc)

    # transfer matrix of each segment
    t = np.broadcast_to(np.eye(k, dtype=np.float32), (m, k, k)).copy()
    for i in range(SEGMENT):
        on = real[:, i]
        step = (t.reshape(m * k, k) @ a).reshape(m, k, k) * em[:, i, None, :]
        t = np.where(on[:, None, None], _unit(step, (1, 2)), t)

    # forward state before, and backward state after each segment
    fore = np.full((m, k), 1 / k, np.float32)
    back = np.full((m, k), 1 / k, np.float32)
    order = np.argsort(place, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(place))[:-1])
    for r in range(1, len(levels)):
        s = levels[r]
        fore[s] = _unit(np.einsum("sk,skl->sl", fore[s - 1], t[s - 1]), 1)
    for r in range(len(levels) - 1, 0, -1):
        s = levels[r]
        back[s - 1] = _unit(np.einsum("skl,sl->sk", t[s], back[s]), 1)

    out = np.empty((m, SEGMENT, k), np.float32)
    for i in range(SEGMENT):
        fore = np.where(real[:, i, None], _unit((fore @ a) * em[:, i], 1), fore)
        out[:, i] = fore
    for i in range(SEGMENT - 1, -1, -1):
        out[:, i] *= back
        back = np.where(real[:, i, None], _unit((em[:, i] * back) @ a.T, 1), back)
    return _unit(out[real], 1)


def fit(windows: list[tuple[str, list[str]]], seed: int = SEED) -> Model:
    """Train on (lang, words) windows by gradient steps on the conditional log-likelihood."""
    labels = sorted({lang for lang, w in windows if w})
    windows = [(lang, w) for lang, w in windows if w]
    if not labels:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    number = {lang: i for i, lang in enumerate(labels)}
    seen: dict[str, Counter] = {}
    for lang, ws in windows:
        for w in ws:
            seen.setdefault(w, Counter())[lang] += 1
    lexicon = {}
    for w, c in seen.items():
        lang, best = min(c.items(), key=lambda x: (-x[1], x[0]))
        if best >= LEXICON_MIN and best >= LEXICON_SHARE * c.total():
            lexicon[w] = number[lang]
    uses = Counter(f for w in seen for f in set(features(w)))
    index = {f: i for i, f in enumerate(sorted(f for f, c in uses.items() if c >= MIN_FEATURE))}

    # sequences: single windows, and pieces of several windows strung together
    rng = random.Random(seed)
    rows: list[list[tuple[str, int]]] = [[(w, number[lang]) for w in ws] for lang, ws in windows]
    for _ in range(len(windows) // 2):
        row = []
        for _ in range(rng.randint(2, 3)):
            lang, ws = windows[rng.randrange(len(windows))]
            i = rng.randrange(len(ws))
            row += [(w, number[lang]) for w in ws[i:i + rng.randint(4, 24)]]
        rows.append(row)
    rows.sort(key=len)
    vocab = {w: i for i, w in enumerate(seen)}
    base, k = len(index), len(labels)
    flat, ends = [], []
    for w in vocab:
        flat += [index[f] for f in features(w) if f in index]
        if w in lexicon:
            flat.append(base + lexicon[w])
        ends.append(len(flat))
    flat, ends = np.array(flat, np.int64), np.array(ends)
    begin = np.concatenate(([0], ends[:-1]))
    owner = np.repeat(np.arange(len(vocab)), ends - begin)
    by_feature = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[by_feature], return_index=True)

    width = max(map(len, rows))
    ids = np.zeros((len(rows), width), np.int64)
    gold = np.zeros((len(rows), width), np.int64)
    lens = np.array(list(map(len, rows)))
    for i, row in enumerate(rows):
        ids[i, :len(row)] = [vocab[w] for w, _ in row]
        gold[i, :len(row)] = [y for _, y in row]
    real = np.arange(width) < lens[:, None]
    hot = np.eye(k)[gold] * real[..., None]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)

    weights, move = np.zeros((base + k, k)), np.zeros((k, k))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, move)]
    total = lens.sum()
    for step in range(1, STEPS + 1):
        sums = np.concatenate((np.zeros((1, k)), np.cumsum(weights[flat], axis=0)))
        s = sums[ends] - sums[begin]
        e = np.exp(s - s.max(axis=1, keepdims=True))[ids]
        a = np.exp(move - move.max())
        alpha, beta = np.empty(e.shape), np.ones(e.shape)
        f = np.full((len(rows), k), 1 / k)
        for i in range(width):
            f = np.where(real[:, i, None], _unit((f @ a) * e[:, i], 1), f)
            alpha[:, i] = f
        for i in range(width - 2, -1, -1):
            b = _unit((e[:, i + 1] * beta[:, i + 1]) @ a.T, 1)
            beta[:, i] = np.where(real[:, i + 1, None], b, 1.0)
        node = _unit(alpha * beta, 2) * real[..., None]
        pair = np.zeros((k, k))
        for i in range(width - 1):
            on = real[:, i + 1]
            x = alpha[on, i][:, :, None] * a * (e[on, i + 1] * beta[on, i + 1])[:, None, :]
            pair += _unit(x, (1, 2)).sum(axis=0)
        by_word = np.zeros((len(vocab), k))
        np.add.at(by_word, ids[real], (hot - node)[real])
        grad = np.zeros_like(weights)
        grad[used] = np.add.reduceat(by_word[owner[by_feature]], first, axis=0)
        grads = (grad / total - DECAY * weights, (gold_moves - pair) / total - DECAY * move)
        for x, g, (m, v) in zip((weights, move), grads, state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(labels, index, lexicon, weights.astype(np.float32), move)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, window: int = WINDOW, seed: int = SEED) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                        & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    mark = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(HASH_SPACE))
    below = F.element_at(F.create_map(*[F.lit(x) for lang, c in sorted(counts.items()) for x in
                                        (lang, min(HASH_SPACE, 2 * per_language * HASH_SPACE // c))]), F.col("lang"))
    w = words(F.col("text"))
    place = F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.size(w) - window, F.lit(0)) + 1).cast("int") + 1
    picked = (usable.withColumn("mark", mark).where(F.col("mark") < below)
              .select("lang", "mark", F.array_join(F.slice(w, place, window), " ").alias("part"))
              .orderBy("mark", "lang", "part").limit(4 * per_language * len(counts)).collect())
    taken, windows = Counter(), []
    for r in picked:
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            windows.append((r["lang"], letter_runs(r["part"])[:4 * window]))
    return fit(windows, seed)


class _Known(dict):
    """Word -> number; a new word gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n


class Labeller:
    """Labels texts one after another; holds the scores of the words seen lately and one block of words."""

    def __init__(self, model: Model):
        self.model = model
        self.known, self.table = _Known(), np.zeros((0, len(model.labels)), np.float32)

    def label(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Label marginals and words of each text, in order."""
        pending: list[list[str]] = []
        size = 0
        for t in texts:
            pending.append(letter_runs(t) if t else [])
            size += len(pending[-1])
            if size >= BATCH_WORDS:
                yield from self._block(pending)
                pending, size = [], 0
        yield from self._block(pending)

    def _block(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, list[str]]]:
        known = self.known
        lengths = np.array([len(w) for w in texts], np.int64)
        ids = np.fromiter((known[w] for ws in texts for w in ws), np.int64, int(lengths.sum()))
        if known.new:
            self.table = np.concatenate((self.table, self.model.scores(known.new)))
            known.new = []
        filled = lengths > 0
        m = marginals(self.table[ids], lengths[filled], self.model.move) if filled.any() else self.table[:0]
        if len(known) > CACHE_WORDS:
            known.clear()
            self.table = self.table[:0]
        for end, n, ws in zip(np.cumsum(lengths), lengths, texts):
            yield m[end - n:end], ws


def identify(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score",
             words_by_language: str | None = None, confident: bool = False) -> DataFrame:
    """``docs`` with the predicted language and its score; optionally the expected words of each language.

    The score is the language's share of the words; with ``confident`` it is the mean probability of the words' own labels.

    ``docs`` needs a ``text`` column; the new columns must not clash with its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += f", `{label}` string, `{score}` double"
    schema += f", `{words_by_language}` map<string,double>" if words_by_language else ""
    at = docs.columns.index("text")
    names = [*docs.columns, label, score] + [words_by_language] * bool(words_by_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labeller = Labeller(m)
        for b in batches:
            langs, scores, parts = [], [], []
            for marg, _ in labeller.label(x.as_py() for x in b.column(at)):
                if not len(marg):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    parts.append([])
                    continue
                mass = marg.sum(axis=0, dtype=np.float64)
                i = int(mass.argmax())
                langs.append(m.labels[i])
                scores.append(min(1.0, float(marg.max(axis=1).mean(dtype=np.float64) if confident else mass[i] / len(marg))))
                parts.append([(x, float(y)) for x, y in zip(m.labels, mass)])
            cols = [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if words_by_language:
                cols.append(pa.array(parts, pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    if not model.labels:
        out = docs.withColumns({label: F.lit(UNKNOWN), score: F.lit(0.0)})
        return out.withColumn(words_by_language, F.create_map().cast("map<string,double>")) if words_by_language else out
    return docs.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, position, word, lang, probability): every word of every text with its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labeller = Labeller(m)
        for b in batches:
            for d, (marg, ws) in zip(b.column(0).to_pylist(), labeller.label(x.as_py() for x in b.column(1))):
                if ws:
                    best = marg.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d] * len(ws), b.schema.field(0).type), pa.array(np.arange(len(ws), dtype=np.int64)),
                        pa.array(ws), pa.array([m.labels[i] for i in best]),
                        pa.array(marg.max(axis=1).astype(float))],
                        names=["doc_id", "position", "word", "lang", "probability"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, position bigint, word string, lang string, probability double")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of every row of ``docs`` (doc_id, text, lang)."""
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, label: str, score: str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of ``docs`` with a language: those without a letter go, and those whose words are labelled with
    less than ``min_confidence`` on average. A text may mix any number of languages. When no language could be
    learned, every row with a letter stays."""
    if not model.labels:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return (identify(docs, model, label, score, confident=True)
            .where((F.col(label) != UNKNOWN) & (F.col(score) >= min_confidence)).drop(label, score))
