"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Words, their beginnings (for inflected forms) and pairs of neighbouring words
can be evidence; a sentence with evidence is offending with the logistic of their summed weights, one without it is not. The document's score is the noisy-or of its
sentences with a leak, ``1 - (1 - leak) * prod(1 - p)``; the leak is the share of labelled toxic documents that no sentence
explains, so a long text isn't toxic for its length.

Only documents have labels. Evidence is chosen by explaining away: the feature whose documents are toxic most beyond the
rate of the documents not yet explained, by a Chernoff bound corrected for the number of features, takes its documents out,
and so on until none is significant. As a document may hold several offending sentences, features that are mostly toxic
are then tried on the sentences not yet explained. The gradient of the noisy-or fits the weights together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm.shared import free_name, without

_WORD, _END = re.compile(r"[^\W_]+").findall, re.compile(r"[.!?\n]+").split
#: Bounds of the fit: labelled rows in hash order (so classes keep their shares), whole texts of at most so many characters.
SAMPLE_ROWS, SAMPLE_TEXT = 4_000, 50_000
#: Chance that any feature without a bearing on toxicity is taken for evidence.
ALPHA = 1e-3


def sentences(text: str) -> list[str]:
    return [s for s in _END(text) if s.strip()]


def features(sentence: str) -> set[str]:
    """Words, pairs of words, and beginnings of words from three characters on, marked by a star."""
    words = _WORD(sentence.lower())
    return {*words, *map(" ".join, zip(words, words[1:], strict=False)), *(f"{w[:k]}*" for w in set(words) for k in range(3, len(w) + 1))}


class Model:
    def __init__(self, leak: float, bias: float, weights: dict[str, float]):
        self.leak, self.bias, self.weights = leak, bias, weights
        heads = sorted({f.split(" ")[0].rstrip("*") for f in weights})
        self.hint = re.compile("|".join(map(re.escape, heads)) if heads else r"(?!)").search

    def sentence_scores(self, parts: list[str]) -> np.ndarray:
        """Probability of each sentence to be the offending one."""
        out = np.zeros(len(parts))
        for i, s in enumerate(parts):
            if self.hint(s.lower()) and (held := self.weights.keys() & features(s)):
                out[i] = _logistic(self.bias + sum(self.weights[f] for f in sorted(held)))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, str]]]:
        """The score of a text (0 if it has no sentence) and its offending sentences, those with 0.5 or more."""
        if not text or not text.strip():
            return 0.0, []
        if not self.hint(text.lower()):
            return (self.leak if _END(text, 1)[0].strip() or sentences(text) else 0.0), []
        p = self.sentence_scores(parts := sentences(text))
        score = 1 - (1 - self.leak) * float(np.prod(1 - p))
        return score, [(int(i), float(p[i]), parts[i].strip()) for i in np.flatnonzero(p >= 0.5)]


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(toxic: np.ndarray, total: np.ndarray, rate: float) -> np.ndarray:
    """The exponent of the Chernoff bound on so many toxic ones of ``total`` at a ``rate``; 0 where they aren't more."""
    rate, share = min(max(rate, 1e-9), 1 - 1e-9), toxic / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(share > 0, share * np.log(share / rate), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0)
    return np.where(share > rate, total * gain, 0)


def _longest(gain: np.ndarray, size: np.ndarray) -> int:
    best = np.flatnonzero(gain == gain.max())
    return int(best[size[best].argmax()])


class _Bags:
    """Labelled documents, and which feature occurs in which of them."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.parts = [sentences(t or "") for t, _ in rows]
        self.y = np.array([int(y) for _, y in rows], np.int64)
        # Counted by hash first, as most features are of one document and their names needn't be held. One of so few toxic
        # documents can't be significant, at any rate of one in all documents or more, so leaving it out changes nothing.
        marked = [np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set().union(*map(features, self.parts[d]))), np.uint64)) for d in np.flatnonzero(self.y)]
        hashes, times = np.unique(np.concatenate(marked), return_counts=True) if marked else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.tested = len(hashes)
        least = 1 + int(math.log(max(1, self.tested) / ALPHA) / math.log(max(2, len(self.y))))
        often = set(hashes[times >= least].tolist())
        self.names = sorted({f for d in np.flatnonzero(self.y) for s in self.parts[d] for f in features(s) if xxhash.xxh3_64_intdigest(f) in often})
        at = {f: i for i, f in enumerate(self.names)}
        #: Features of document d are those from starts[d] to starts[d + 1].
        held = [np.fromiter((at[f] for f in at.keys() & set().union(*map(features, parts))), np.int32) for parts in self.parts]
        self.starts = np.cumsum([0, *map(len, held)])
        self.feature = np.concatenate(held) if held else np.zeros(0, np.int32)

    def of(self, d: int) -> np.ndarray:
        return self.feature[self.starts[d] : self.starts[d + 1]]

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """In how many of the documents each feature occurs."""
        out = np.zeros(len(self.names), np.int64)
        for d in docs.tolist():
            out[self.of(d)] += 1
        return out

    def evidence(self, used: np.ndarray) -> list[str]:
        """Features in the order in which they explain the toxic documents among the ``used`` ones. Of equal ones, as of
        the beginnings of one word, the longest is taken."""
        open_docs, chosen, n = used.copy(), [], len(self.names)
        size = np.array([len(f) for f in self.names], np.int64)
        need, every = math.log(max(1, self.tested) / ALPHA), self.y[used].mean()
        first = (self.counts(np.flatnonzero(used & (self.y == 1))), self.counts(np.flatnonzero(used)))
        toxic, total = first[0].copy(), first[1].copy()
        while open_docs.any() and n:
            gain = _gain(toxic, total, self.y[open_docs].mean())
            if gain.max() <= need:
                break
            best = _longest(gain, size)
            chosen.append(best)
            for d in np.flatnonzero(open_docs).tolist():
                held = self.of(d)
                if (held == best).any():
                    open_docs[d] = False
                    total[held] -= 1
                    toxic[held] -= self.y[d]
        # Sentences of toxic documents without evidence yet; equal sentences of copies count once, and one for each document.
        likely = np.flatnonzero((_gain(*first, every) > need) & (2 * first[0] >= first[1]))
        at = {self.names[f]: i for i, f in enumerate(likely)}
        names = {self.names[f] for f in chosen}
        parts = [(d, s, held) for d in np.flatnonzero(used & (self.y == 1)).tolist() for s in self.parts[d] if (held := features(s))]
        parts = [(d, s, [at[f] for f in sorted(at.keys() & held)]) for d, s, held in parts if names.isdisjoint(held)]
        while parts and len(likely):
            seen: list[dict[int, str]] = [{} for _ in likely]
            for d, s, held in parts:
                for i in held:
                    seen[i].setdefault(d, s)
            toxic = np.array([len(set(x.values())) for x in seen])
            gain = _gain(toxic, toxic + first[1][likely] - first[0][likely], every)
            if gain.max() <= need:
                break
            best = _longest(gain, size[likely])
            chosen.append(int(likely[best]))
            parts = [p for p in parts if best not in p[2]]
        return [self.names[f] for f in chosen]

    def fit(self, used: np.ndarray, rounds: int = 200, rate: float = 0.3, pull: float = 1e-4) -> Model:
        """A model of the ``used`` documents. Without documents of both classes it scores everything 0."""
        y = self.y[used]
        if not len(y) or y.min() == y.max():
            return Model(0.0, 0.0, {})
        names = self.evidence(used)
        held = {f: i for i, f in enumerate(names)}
        hint = Model(0.0, 0.0, dict.fromkeys(names, 1.0)).hint
        cells = []  # (document, sentence, feature), all numbered
        spots: dict[tuple[int, int], int] = {}
        for d in np.flatnonzero(used).tolist():
            for k, s in enumerate(self.parts[d]):
                if hint(s.lower()):
                    cells += [(d, spots.setdefault((d, k), len(spots)), held[f]) for f in sorted(held.keys() & features(s))]
        doc, cell, feature = np.array(cells, np.int64).reshape(-1, 3).T
        explained = np.zeros(len(self.y), bool)
        explained[doc] = True
        rest = used & ~explained
        leak = float((self.y[rest].sum() + 0.5) / (rest.sum() + 1))
        if not names:
            return Model(leak, 0.0, {})
        pairs = np.unique(np.stack([doc, feature]), axis=1)
        good, seen = np.bincount(pairs[1], self.y[pairs[0]], len(names)), np.bincount(pairs[1], minlength=len(names))
        start = np.log((good + 0.5) / (seen - good + 0.5))  # each feature by itself; the descent fits them together
        w, b, gw, gb = start.copy(), 0.0, np.full(len(names), 1e-4), 1e-4
        docs = np.flatnonzero(explained)
        owner = np.searchsorted(docs, [d for d, _ in spots])
        truth = self.y[docs]
        for _ in range(rounds):
            p = np.clip(_logistic(np.bincount(cell, w[feature], len(owner)) + b), 1e-9, 1 - 1e-9)
            miss = (1 - leak) * np.exp(np.bincount(owner, np.log1p(-p), len(docs)))
            slope = np.where(truth == 1, -miss / np.maximum(1 - miss, 1e-9), 1.0) / len(docs)
            gz = p * slope[owner]
            g, g0 = np.bincount(feature, gz[cell], len(names)) + pull * (w - start), gz.sum() + pull * b
            gw += g * g
            gb += g0 * g0
            w, b = w - rate * g / np.sqrt(gw), b - rate * g0 / math.sqrt(gb)
        return Model(leak, float(b), {f: float(x) for f, x in zip(names, w, strict=True)})


def train(rows: list[tuple[str, int]]) -> Model:
    return _Bags(rows).fit(np.ones(len(rows), bool))


def threshold(rows: list[tuple[str, int]], folds: int = 3, most: float = 0.7) -> float:
    """The score, ``most`` at most, from which a document counts as toxic with the fewest errors on documents that the
    model hasn't seen: each fold of ``rows`` is scored by a model of the others. Of equal choices the highest."""
    return _threshold(_Bags(rows), rows, folds, most)


def train_with_threshold(rows: list[tuple[str, int]], folds: int = 3, most: float = 0.7) -> tuple[Model, float]:
    bags = _Bags(rows)
    return bags.fit(np.ones(len(rows), bool)), _threshold(bags, rows, folds, most)


def _threshold(bags: _Bags, rows: list[tuple[str, int]], folds: int, most: float) -> float:
    if len(rows) < folds or bags.y.min() == bags.y.max():
        return most
    fold, score = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for k in range(folds):
        model = bags.fit(fold != k)
        score[fold == k] = [model.score(rows[i][0])[0] for i in np.flatnonzero(fold == k)]
    order = np.argsort(-score, kind="stable")
    s, gain = score[order], np.cumsum(np.where(bags.y[order] == 1, 1, -1))
    ends = np.flatnonzero(np.append(s[1:] < s[:-1], True))
    i = ends[gain[ends].argmax()]
    if gain[i] <= 0:
        return most
    return float(min(most, (s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_TEXT) -> list[tuple[str, int]]:
    """At most ``rows`` labelled documents, whole texts of at most ``chars`` characters, chosen by the key's hash. Rows with
    a null key, text or label teach nothing, equal rows teach once."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    some = marked.distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k", "y").limit(rows)
    names = docs.sparkSession.createDataFrame([(k,) for k in sorted({r["k"] for r in some.collect()})], f"k {dict(docs.dtypes)[key]}")
    body = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull() & (F.char_length("t") <= chars))
    body = body.join(F.broadcast(names), "k").distinct()  # a key may be repeated
    both = body.join(F.broadcast(marked.join(F.broadcast(names), "k").distinct()), "k")
    kept = both.orderBy(F.xxhash64(F.col("k").cast("string")), "k", F.xxhash64("t"), "y").limit(rows).collect()
    return [(t, y) for _, t, y in sorted({(r["k"], r["t"], r["y"]) for r in kept})]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model of the ``labelled`` documents. Without documents of both classes all scores are 0."""
    return train(labelled(docs, labels, key, text, label, rows))


def score_documents(df: DataFrame, model: Model, text: str = "text", score: str = "score", found: str | None = "offending") -> DataFrame:
    """The table with the score of each whole text and, unless ``found`` is None, its offending sentences (index, p, sentence).

    A null or empty text scores 0. Columns of the two names, in any case, are replaced; other columns are kept as they are
    and don't pass through Python. Repeated rows are scored each, an empty table gives none.
    """
    held = (model.leak, model.bias, model.weights)  # a few words
    kind = pa.struct([("at", pa.int32()), ("p", pa.float64()), ("sentence", pa.string())])
    type_ = pa.struct([("score", pa.float64()), ("found", pa.list_(kind))])

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*held)
        for batch in batches:
            scores, hits = np.zeros(len(batch)), []
            for i, t in enumerate(batch):
                scores[i], h = model.score(t.as_py())
                hits.append([{"at": a, "p": p, "sentence": s} for a, p, s in h] if found else [])
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(hits, type_.field(1).type)], fields=list(type_))

    judge = F.arrow_udf(work, "score double, found array<struct<at:int,p:double,sentence:string>>")
    out = free_name(df, "_judged")
    judged = df.select("*", judge(F.col(text)).alias(out))
    kept = without(df, score, found or score)
    return judged.select(*kept, F.col(f"{out}.score").alias(score), *([F.col(f"{out}.found").alias(found)] if found else []))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % 3 == 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences of every document; see ``score_documents`` for odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    out = score_documents(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("offending.sentence").alias("sentences"))
