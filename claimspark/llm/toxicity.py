"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The model is fitted on so many labelled documents at most, of so many characters at most: a bounded sample, which the driver holds.
FIT_DOCUMENTS, FIT_CHARACTERS = 5_000, 8_000
#: Features: words and their beginnings of so many letters, kept if they tell of toxic documents in so many of them.
BEGINNINGS, LEAST_DOCUMENTS = (3, 4, 5, 6, 7, 8, 9), 4
#: Deviations by which the odds of a feature are lowered.
MARGIN = 2.0
#: A document's repeats of a feature beyond this tell nothing more.
REPEATS = 5
#: Hashes by which copies in the sample are looked for, and the share of the shorter one's runs of three words that makes a copy.
COPY_MARKS, COPY_SHARE = 4, 0.5
#: Words of a training sequence.
SEQUENCE = 48
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 400_000


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def folded(text: str) -> str:
    """Lower case, character for character: the few whose lower case is longer stay, so that places hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    """Weights of the features for the toxic tag, of the tags' transitions, and of the aggregates for the document's score."""

    weights: dict[str, float]
    bias: float
    steps: np.ndarray  # log weight of going from tag a to tag b
    document: np.ndarray  # of 1, the log odds of any toxic word, the log of the expected number, the largest marginal
    rate: float = 0.0

    def lift(self, word: str) -> float:
        """What a word's features add to the toxic tag; 0 for a word that has none."""
        return sum(self.weights.get(f, 0.0) for f in features(word))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """Texts and labels to fit on, in the order of a hash; without repeats of a doc_id or of a text.

    The labels that aren't held out are sampled first, by a hash, so that only the chosen documents' texts move.
    """
    one = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= FIT_CHARACTERS))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic"))  # FIT_DOCUMENTS at most
    seen: dict[str, tuple[int, int, int]] = {}
    for r in rows.collect():
        key = (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["_toxic"])
        seen[r["text"]] = min(key, seen.get(r["text"], key))
    return [(text, toxic) for text, (_, _, toxic) in sorted(seen.items(), key=lambda x: x[1])]


def without_copies(tokens: list[list[str]]) -> list[int]:
    """Places of the documents that don't repeat an earlier one.

    Copies are looked for by their COPY_MARKS least hashes of three words in a row, and are copies if they share COPY_SHARE of the runs of the shorter one; the
    words of one text in many copies would else all seem to tell of its label.
    """
    marked: dict[int, list[int]] = {}
    runs: dict[int, set[int]] = {}
    kept = []
    for k, t in enumerate(tokens):
        own = {zlib.crc32(" ".join(t[i : i + 3]).encode()) for i in range(len(t) - 2)}
        marks = sorted(own)[:COPY_MARKS]
        near = {j for m in marks for j in marked.get(m, ())}
        if not any(len(own & runs[j]) >= COPY_SHARE * min(len(own), len(runs[j])) for j in near):
            kept.append(k)
            runs[k] = own
            for m in marks:
                marked.setdefault(m, []).append(k)
    return kept


def telling(tokens: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Features that are much likelier in toxic documents than in others, with their log odds against the base rate."""
    of: dict[str, list[str]] = {}
    there: Counter[str] = Counter()
    counts = (Counter(), Counter())
    for hot in (1, 0):
        for words, toxic in zip(tokens, y, strict=True):
            if int(toxic) != hot:
                continue
            own: Counter[str] = Counter()
            for w, n in Counter(words).items():
                if w not in of:
                    of[w] = [f for f in features(w) if hot or there[f] >= LEAST_DOCUMENTS]
                for f in of[w]:
                    own[f] += n
            if hot:
                there.update(own.keys())
            for f, n in own.items():
                counts[hot][f] += min(n, REPEATS)
        of = {}
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    # the rates of both kinds of documents, each with half a word more; a margin guards against chance
    hot = {f: n for f, n in counts[1].items() if there[f] >= LEAST_DOCUMENTS}
    odds = {f: math.log((n + 0.5) / n1) - math.log((counts[0][f] + 0.5) / n0) - MARGIN * math.sqrt(1 / (there[f] + 0.5) + 1 / (counts[0][f] + 0.5)) for f, n in hot.items()}
    best = sorted((-v * math.log1p(hot[f]), f) for f, v in odds.items() if v > math.log(5))
    return {f: odds[f] for _, f in best}


def _forward_backward(emit: np.ndarray, steps: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag and, weighted, expected transitions of padded sequences (n x length), in probability space with scaling."""
    n, length = emit.shape
    jump = np.exp(steps)
    e = np.stack((np.ones_like(emit), np.exp(np.clip(emit, -30, 30))), 2)
    alpha, beta = np.empty((n, length, 2)), np.ones((n, length, 2))
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ jump) * e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ jump.T
        beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * jump * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return post[:, :, 1], ((pair * mask[:, 1:, None, None]).sum(1) * weight[:, None, None]).sum(0)


def fit_chain(tokens: list[list[str]], y: np.ndarray, odds: dict[str, float], rounds: int = 40) -> Model:
    """Maximum likelihood of the tags, with a ridge, by Adam.

    A toxic document's word is tagged toxic if a feature of it tells of toxic documents; all other words are tagged clean.
    """
    names = sorted(odds)
    number = {f: k for k, f in enumerate(names)}
    vocabulary: dict[str, int] = {}
    cells: list[tuple[list[int], int]] = []
    for words, toxic in zip(tokens, y, strict=True):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        for i in range(0, len(ids), SEQUENCE):
            cells.append((ids[i : i + SEQUENCE], int(toxic)))
    rows, cols = [], []
    for w, k in vocabulary.items():
        for f in features(w):
            if f in number:
                rows.append(k)
                cols.append(number[f])
    row, col = np.array(rows, np.int64), np.array(cols, np.int64)
    lifted = np.zeros(len(vocabulary), bool)
    lifted[row] = True
    # sequences without any telling word look alike but for their length: those of a length are one, with their number as its weight
    plain = Counter(len(c[0]) for c in cells if not lifted[c[0]].any())
    cells = [c for c in cells if lifted[c[0]].any()]
    weight = np.array([1.0] * len(cells) + [float(plain[k]) for k in sorted(plain)])
    bare = np.flatnonzero(~lifted)
    cells += [([int(bare[0])] * k, 0) for k in sorted(plain)]
    ids, mask, gold = np.zeros((len(cells), SEQUENCE), np.int64), np.zeros((len(cells), SEQUENCE), bool), np.zeros((len(cells), SEQUENCE))
    for i, (own, toxic) in enumerate(cells):
        ids[i, : len(own)], mask[i, : len(own)] = own, True
        gold[i, : len(own)] = toxic * lifted[own]
    gold *= mask
    both = mask[:, 1:]
    a, b = gold[:, :-1].astype(int), gold[:, 1:].astype(int)
    want = np.array([[((a == p) & (b == q) & both).sum(1) @ weight for q in (0, 1)] for p in (0, 1)], float)
    x = np.zeros(len(names) + 5)
    x[: len(names)], x[len(names)] = 0.5, -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = max(1.0, mask.sum(1) @ weight / 100)
    for k in range(1, rounds + 1):
        lift = np.bincount(row, x[col], len(vocabulary)) if len(row) else np.zeros(len(vocabulary))
        post, pairs = _forward_backward(np.where(mask, lift[ids] + x[len(names)], 0.0), x[-4:].reshape(2, 2), mask, weight)
        error = (gold - post) * mask * weight[:, None]
        by_word = np.bincount(ids.ravel(), error.ravel(), len(vocabulary))
        g = np.concatenate((np.bincount(col, by_word[row], len(names)) if len(col) else np.zeros(0), [error.sum()], (want - pairs).ravel())) - 0.05 * x
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model({f: float(x[k]) for f, k in number.items()}, float(x[len(names)]), x[-4:].reshape(2, 2), np.zeros(4), float(y.mean()) if len(y) else 0.0)


class Tagger:
    """Exact marginals of whole documents at the words that have features, without a step for each of the others.

    Words without features share one transfer matrix; a run of n of them is its n-th power, written with its two eigenvalues. The chain is
    followed from word with features to word with features.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        jump = np.exp(model.steps - model.steps.max())
        self.jump = jump
        plain = jump * np.array([1.0, math.exp(model.bias)])  # a step to a word without features
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        self.ratio = float(values.real[order[1]] / values.real[order[0]])
        self.vectors, self.back = vectors.real[:, order], np.linalg.inv(vectors.real[:, order])
        self.lifts: dict[str, float] = {}

    def run(self, n: int) -> np.ndarray:
        """The n-th power of a plain step, scaled."""
        return self.vectors @ (np.array([1.0, self.ratio**n])[:, None] * self.back)

    def known(self, words: list[str]) -> np.ndarray:
        lifts = self.lifts
        if len(lifts) > CACHE_WORDS:
            lifts.clear()
        try:
            return np.array([lifts[w] for w in words])
        except KeyError:
            for w in {w for w in words if w not in lifts}:
                lifts[w] = self.model.lift(w)
            return np.array([lifts[w] for w in words])

    def marginals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
        """Places of the words with features, their toxic marginals, and the log odds that any word at all is toxic."""
        lift = self.known(words) if words else np.zeros(0)
        at = np.flatnonzero(lift)
        if not len(at):
            return at, np.zeros(0), -20.0
        emit = np.exp(np.clip(lift[at] + self.model.bias, -30, 30))
        bias = math.exp(self.model.bias)
        forward, steps = [], []
        state = None
        for k, i in enumerate(at.tolist()):
            if k == 0:
                if i == 0:
                    into = np.ones(2)
                else:
                    into = (np.array([1.0, bias]) @ self.run(i - 1)) @ self.jump
                step = None
            else:
                step = self.run(i - at[k - 1] - 1) @ self.jump
                into = state @ step
            steps.append(step)
            state = np.maximum(into, 1e-300) * np.array([1.0, emit[k]])
            state = state / state.sum()
            forward.append(state)
        after = np.maximum(self.run(len(words) - 1 - int(at[-1])).sum(axis=1), 1e-300)
        out = np.empty(len(at))
        for k in range(len(at) - 1, -1, -1):
            post = forward[k] * after
            out[k] = post[1] / post.sum()
            if k:
                after = np.maximum(steps[k] @ (np.array([1.0, emit[k]]) * after), 1e-300)
                after = after / after.sum()
        return at, out, float(np.clip(-np.log1p(-np.minimum(out, 1 - 1e-9)).sum(), 1e-9, 40))

    def aggregate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, marginals, and the features of the document's score."""
        at, p, none = self.marginals(words)
        if not len(at):
            return at, p, np.array([1.0, 0.0, 0.0, 0.0])
        return at, p, np.array([1.0, math.log1p(none), math.log1p(p.sum()), p.max()])

    def score(self, x: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-float(np.clip(self.model.document @ x, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The chain from the whole bounded sample and, on top of its marginals, a logistic regression of the labels.

    The regression sees each half of the sample through a chain that was fitted on the other half. Without labelled documents of both kinds all
    scores are the label's share, or 0.
    """
    rows = sample(docs, labels)
    tokens = [WORD.findall(folded(t)) for t, _ in rows]
    kept = without_copies(tokens)
    rows, tokens = [rows[k] for k in kept], [tokens[k] for k in kept]
    y = np.array([v for _, v in rows], float)
    if len(set(y.tolist())) < 2:
        rate = float(y.mean()) if len(y) else 0.0
        return Model({}, -3.0, np.zeros((2, 2)), np.array([math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0, 0, 0]), rate)
    # the sample is in the order of a hash; each kind is dealt out in turn
    half = np.zeros(len(y), bool)
    for kind in (0, 1):
        half[np.flatnonzero(y == kind)[::2]] = True
    x = np.zeros((len(y), 4))
    for own, other in ((half, ~half), (~half, half)):
        some = [tokens[i] for i in np.flatnonzero(own)]
        tagger = Tagger(fit_chain(some, y[own], telling(some, y[own]), rounds=25))
        for i in np.flatnonzero(other):
            x[i] = tagger.aggregate(tokens[i])[2]
    model = fit_chain(tokens, y, telling(tokens, y))
    w, ridge = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(25):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    model.document = w
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_spans, spans) of each whole text.

    spans are the runs of words whose toxic marginal is at least a half, as start:end in code points of the text, comma-joined. A null
    text counts as empty, which has the score of a document without any telling word. Repeated rows come out as often as they
    came; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                low = folded(text.as_py() or "")
                at, p, x = tagger.aggregate(WORD.findall(low))
                scores.append(tagger.score(x))
                toxic = set(at[p >= 0.5].tolist())
                found: list[list[int]] = []
                if toxic:
                    for k, m in enumerate(WORD.finditer(low)):
                        if k in toxic:
                            if found and k - 1 in toxic:
                                found[-1][1] = m.end()
                            else:
                                found.append([m.start(), m.end()])
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in s) for s in spans], pa.string())],
                ["doc_id", "score", "predicted", "n_spans", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_spans bigint, spans string")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents scored under the threshold, with all their columns and as often as they came."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def of(texts):  # noqa: ANN001, ANN202
        tagger = Tagger(model)
        return texts.map(lambda t: tagger.score(tagger.aggregate(WORD.findall(folded(t or "")))[2]))

    prepare(docs.sparkSession)
    return docs.where(of(F.coalesce("text", F.lit(""))) < threshold)
