"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states, clean and toxic.  A word's emission is the sum of the weights of its hashed features (the word,
its first 3 to 6 letters, its last 3).  Labels are known for documents only, so the labelled tokens are made
first: in toxic documents, words with a feature that is far more frequent there than chance allows.  The
field is fitted to these sequences, and a small logistic regression turns the expected number of toxic
words of a document (the sum of its marginals) into a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hash_sample, table

FOLDS = 5
#: Training sample: documents of each class, and characters of the longest; scoring has no such bounds.
SAMPLE, LONGEST = 2000, 20_000
DIM, EPOCHS, RATE, SHRINK = 1 << 18, 40, 0.3, 1e-3
#: Words whose emission a worker keeps.
KEPT = 200_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[int]:
    """Buckets of the features of a word; always six, repeats allowed."""
    w = _EDGE.sub("", word.lower())
    keys = ["w" + w, *("p" + w[:n] for n in (3, 4, 5, 6)), "s" + w[-3:]]
    return [zlib.crc32(k.encode()) & (DIM - 1) for k in keys]


@dataclass
class Model:
    weights: np.ndarray  # of the toxic state against the clean one
    moves: np.ndarray  # log weights of clean-clean, clean-toxic, toxic-clean, toxic-toxic
    line: tuple[float, float]  # score = 1 / (1 + exp(-(a + b * log(expected + 1e-3))))


def forward(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward odds (toxic : clean) of emissions e(documents, words), padded at the end."""
    oo, ot, to, tt = np.exp(moves)
    n, size = e.shape
    xt = np.ascontiguousarray(np.exp(np.clip(e, -30, 30)).T)
    out = np.empty((size, n))
    r = np.zeros(n)
    for t in range(size):
        r = xt[t] * ((r * tt + ot) / (r * to + oo))
        out[t] = r
    return out.T


def backward(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Backward odds; each document's pass starts at its own last word."""
    oo, ot, to, tt = np.exp(moves)
    n, size = e.shape
    xt = np.ascontiguousarray(np.exp(np.clip(e, -30, 30)).T)
    out = np.ones((size, n))
    b = np.ones(n)
    for t in range(size - 1, 0, -1):
        y = xt[t] * b
        b = np.where(t < lengths, (to + tt * y) / (oo + ot * y), 1.0)
        out[t - 1] = b
    return out.T


def _groups(lengths: list[int], cells: int = 400_000) -> Iterator[list[int]]:
    """Documents of like length, so many at once that the padded table stays small."""
    group: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if group and (len(group) + 1) * lengths[i] > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def marginals(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Probability of the toxic state for each word of each document."""
    out: list[np.ndarray] = [np.empty(0)] * len(emissions)
    for group in _groups([len(e) for e in emissions]):
        size = len(emissions[group[-1]])
        if not size:
            continue
        lengths = np.array([len(emissions[i]) for i in group])
        table_ = np.zeros((len(group), size))
        for k, i in enumerate(group):
            table_[k, : len(emissions[i])] = emissions[i]
        odds = forward(table_, moves) * backward(table_, lengths, moves)
        p = odds / (1 + odds)
        for k, i in enumerate(group):
            out[i] = p[k, : lengths[k]]
    return out


def label_tokens(docs: list[np.ndarray], toxic: np.ndarray, feats: np.ndarray) -> list[np.ndarray]:
    """Which words of each document are taken as toxic; docs hold word numbers, feats the features of each word.

    A feature is a sign of toxicity if it is in so many toxic documents and so few others that not one of all
    features would be by chance.  Documents with a sign are explained; the next round looks at the others.
    """
    of = [np.unique(feats[d, :-1]) if len(d) else np.empty(0, np.int64) for d in docs]
    clean = np.zeros(DIM)
    for f in [f for f, y in zip(of, toxic, strict=True) if not y]:
        clean[f] += 1
    signs = np.zeros(DIM, bool)
    todo = [f for f, y in zip(of, toxic, strict=True) if y]
    n_clean = max(1, int((~toxic).sum()))
    for _ in range(4):
        if not todo:
            break
        hits = np.zeros(DIM)
        for f in todo:
            hits[f] += 1
        chance = np.log1p(n_clean / len(todo))  # of a document that has a feature not to be toxic
        new = (hits * chance > np.log(max(2, int((hits > 0).sum()))) + 3) & (clean <= 0.02 * hits * n_clean / len(todo)) & (hits >= 3) & ~signs
        if not new.any():
            break
        signs |= new
        todo = [f for f in todo if not signs[f].any()]
    hot = signs[feats[:, :-1]].any(1)
    return [hot[d] & bool(y) for d, y in zip(docs, toxic, strict=True)]


def fit(texts: list[str], toxic: list[int], prior: float) -> Model:
    """Fit to labelled texts; ``prior`` is the share of toxic rows among all labelled ones."""
    y = np.array(toxic, bool)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in re.findall(WORD, t)], np.int64) for t in texts]
    feats = np.fromiter((f for w in number for f in features(w)), np.int64, 6 * len(number)).reshape(-1, 6)
    tokens = label_tokens(docs, y, feats)
    weights, moves = np.zeros(DIM), np.array([0.0, -4.0, 0.0, -4.0])
    weights_m, weights_v, moves_m, moves_v = np.zeros(DIM), np.zeros(DIM), np.zeros(4), np.zeros(4)
    groups = [g for g in _groups([len(d) for d in docs], 100_000) if len(docs[g[-1]])]  # small tables: this runs on the driver
    total = max(1, sum(len(d) for d in docs))
    for step in range(1, EPOCHS + 1):
        value = weights[feats].sum(1)
        by_word, by_move = np.zeros(len(number)), np.zeros(4)
        for group in groups:
            lengths = np.array([len(docs[i]) for i in group])
            size = lengths.max()
            e, gold, inside = np.zeros((len(group), size)), np.zeros((len(group), size)), np.arange(size) < lengths[:, None]
            for k, i in enumerate(group):
                e[k, : lengths[k]] = value[docs[i]]
                gold[k, : lengths[k]] = tokens[i]
            ahead, back = forward(e, moves), backward(e, lengths, moves)
            odds = ahead * back
            error = np.where(inside, odds / (1 + odds) - gold, 0)
            by_word += np.bincount(np.concatenate([docs[i] for i in group]), error[inside], len(number))
            # expected moves less those of the labels
            x = np.exp(np.clip(e[:, 1:], -30, 30)) * back[:, 1:]
            r, pair = ahead[:, :-1], inside[:, 1:]
            terms = np.stack([np.ones_like(r), x, r, r * x]) * np.exp(moves)[:, None, None]
            share = terms / terms.sum(0)
            a, b = gold[:, :-1], gold[:, 1:]
            was = np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b])
            by_move += ((share - was) * pair).sum((1, 2))
        grad = np.bincount(feats.ravel(), np.repeat(by_word, 6), DIM) / total * 100 + SHRINK * weights
        for g, p, m, v in ((grad, weights, weights_m, weights_v), (by_move / total * 100, moves, moves_m, moves_v)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    value = weights[feats].sum(1)
    expected = np.array([p.sum() for p in marginals([value[d] for d in docs], moves)])
    return Model(weights.astype(np.float32), moves, _logistic(np.log(expected + 1e-3), y, prior))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Intercept and slope, by Newton steps; classes weighted to their shares."""
    share = y.mean()
    w = np.where(y, prior / share, (1 - prior) / (1 - share))
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta -= np.linalg.solve(hess, design.T @ (w * (p - y)) + 1e-3 * beta)
    return float(beta[0]), float(beta[1])


class Tagger:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _emission(self, word: bytes) -> float:
        return float(self.model.weights[features(word.decode())].sum())

    def run(self, texts: list[str]) -> list[np.ndarray]:
        emissions = []
        for at in range(0, len(texts), 500):
            words = [t.encode().split() for t in texts[at : at + 500]]
            if len(self.known) > KEPT:
                self.known = {}
            known = self.known
            for w in {w for ws in words for w in ws}.difference(known):
                known[w] = self._emission(w)
            get = known.__getitem__
            emissions += [np.fromiter(map(get, ws), np.float64, len(ws)) for ws in words]
        return marginals(emissions, self.model.moves)  # all together, so that long documents share their steps


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model | None:
    """Fit on at most ``sample`` documents of each class (those whose hashed id comes first), none longer than ``longest``
    characters, held-out rows never.  None if the labels that may be learned have one class only.

    Labels of one doc_id count as toxic if any is; null labels and ids are left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts, toxic = [], []
    for y in (0, 1):
        # at most 3 * sample ids; some have no text, or one too long
        chosen = hash_sample(known.where(F.col("toxic") == y), ["doc_id"], 3 * sample, counts.get(y, 0)).select("doc_id")
        rows = docs.select("doc_id", "text").where(F.length("text").between(1, longest)).join(F.broadcast(chosen), "doc_id")
        got = [r["text"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text").toLocalIterator()]
        texts += got
        toxic += [y] * len(got)
    if len(set(toxic)) < 2:
        return None
    return fit(texts, toxic, counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0)))


SPAN = "array<struct<start:int,end:int,probability:double>>"


def tag(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, expected (toxic words), spans of ``docs(doc_id, text)``.

    spans are maximal runs of words more likely toxic than not, as character offsets with their highest marginal.
    Null and empty texts have no spans and the score of a text without toxic words; without a model every score
    is 0.  Ids may be null or repeated; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        tagger = Tagger(model) if model else None
        for pdf in batches:
            for at in range(0, len(pdf), 2500):
                part = pdf.iloc[at : at + 2500]
                texts = [t or "" for t in part["text"]]
                probs = tagger.run(texts) if tagger else [np.zeros(len(t.split())) for t in texts]
                expected = np.array([p.sum() for p in probs])
                a, b = model.line if model else (-np.inf, 0.0)
                score = 1 / (1 + np.exp(-np.clip(a + b * np.log(expected + 1e-3), -700, 700))) if model else np.zeros(len(texts))
                spans = [_spans(t, p) if len(p) and p.max() > 0.5 else [] for t, p in zip(texts, probs, strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "score": score, "expected": expected, "spans": spans})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInPandas(run, f"doc_id long, score double, expected double, spans {SPAN}")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    for i, m in enumerate(re.finditer(WORD, text)):
        if p[i] <= 0.5:
            continue
        if last == i - 1:
            out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(p[i]))}
        else:
            out.append({"start": m.start(), "end": m.end(), "probability": float(p[i])})
        last = i
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their columns as they are."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(Tagger(model) if model else None)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = shared.value
        for s in batches:
            if tagger is None:
                yield pd.Series(np.zeros(len(s)))
                continue
            expected = np.array([p.sum() for at in range(0, len(s), 2500) for p in tagger.run([t or "" for t in s[at : at + 2500]])])
            a, b = tagger.model.line
            yield pd.Series(1 / (1 + np.exp(-np.clip(a + b * np.log(expected + 1e-3), -700, 700))))

    return docs.where(score("text") < threshold)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, expected and n_spans of all documents, by a field fitted in the query."""
    docs = table(spark, sf_dir, "documents")
    made = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "expected", F.size("spans").alias("n_spans"))
