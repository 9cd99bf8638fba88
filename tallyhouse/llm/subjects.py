"""Subject areas of documents: classifier chains over term, source and structure features, decoded by beam search.

Labels belong to whole documents, subjects to passages.  A mixture of word distributions, one per subject and one for
passages about none, is fitted to the paragraphs of labelled documents, each paragraph being free to take one of its
document's subjects or none.  It scores sentences; how many sentences of the best paragraph speak of a subject, and how
clearly, become a document's features, beside its source and layout.  A chain of logistic models, each seeing the subjects
decided before it, gives the probability of any combination; it is fitted on scores from models that didn't see the document,
which calibrates it.  Beam search finds the best combination.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import staged

_BREAK = re.compile(r"</?(p|div|br|li|ul|h\d|tr|td)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>]*>|&[a-z]+;|&#\d+;", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_SPLIT_WORD = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")


def terms(sentence: str, vocabulary: dict[str, int], grow: bool) -> list[int]:
    """Numbers of the words and pairs of neighbouring words of a sentence; unknown ones are added or, without ``grow``, left out."""
    words = [w.lower() for w in _WORD.findall(sentence)]
    said = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    if grow:
        return [vocabulary.setdefault(t, len(vocabulary)) for t in said]
    return [vocabulary[t] for t in said if t in vocabulary]


def split(text: str | None, vocabulary: dict[str, int], grow: bool = False) -> list[list[list[int]]]:
    """Paragraphs of sentences of terms; sentences without known words are left out, null and blank texts have none."""
    out = []
    plain = _TAG.sub(" ", _BREAK.sub("\n\n", _SPLIT_WORD.sub("", text or "")))
    for p in _PARAGRAPH.split(plain):
        sentences = [t for t in (terms(s, vocabulary, grow) for s in _SENTENCE.split(p)) if t]
        if sentences:
            out.append(sentences)
    return out


class Texts:
    """Terms of many texts as flat arrays: term -> sentence -> paragraph -> document."""

    def __init__(self, texts: list[str | None], vocabulary: dict[str, int], grow: bool = False) -> None:
        term: list[int] = []
        sent_of: list[int] = []
        par_of: list[int] = []
        doc_of: list[int] = []
        for d, text in enumerate(texts):
            for p in split(text, vocabulary, grow):
                doc_of.append(d)
                for s in p:
                    sent_of += [len(par_of)] * len(s)
                    par_of.append(len(doc_of) - 1)
                    term += s
        self.n, self.size = len(texts), len(vocabulary)
        self.term, self.sent_of = np.array(term, np.int64), np.array(sent_of, np.int64)
        self.par_of, self.doc_of = np.array(par_of, np.int64), np.array(doc_of, np.int64)

    def sums(self, table: np.ndarray, step: int = 200_000) -> np.ndarray:
        """Sum of the rows of ``table`` over the terms of each sentence; terms lie in the order of their sentences."""
        out = np.zeros((len(self.par_of), table.shape[1]), np.float32)
        if not len(self.term):
            return out
        start = np.flatnonzero(np.diff(self.sent_of, prepend=-1))  # every sentence has a term
        at = 0
        while at < len(start):  # a bounded number of terms at once
            stop = max(at + 1, int(np.searchsorted(start, start[at] + step, side="right")) - 1) if start[-1] > start[at] + step else len(start)
            lo, hi = start[at], start[stop] if stop < len(start) else len(self.term)
            out[at:stop] = np.add.reduceat(table[self.term[lo:hi]], start[at:stop] - lo, axis=0)
            at = stop
        return out


def fit_terms(x: Texts, labels: np.ndarray, *, rounds: int = 12, smooth: float = 0.00005) -> np.ndarray:
    """Log word distributions (term x subject + 1, the last for no subject) by EM over paragraphs of labelled documents."""
    k = labels.shape[1] + 1
    par_of_term = x.par_of[x.sent_of]
    allowed = np.concatenate([labels, np.ones((x.n, 1), bool)], axis=1)[x.doc_of]
    q = allowed / allowed.sum(axis=1, keepdims=True)
    size = x.size
    table = np.zeros((size, k), np.float32)
    for _ in range(rounds if len(q) else 0):
        counts = np.stack([np.bincount(x.term, weights=q[par_of_term, c], minlength=size) for c in range(k)], axis=1)
        base = counts.sum(axis=1, keepdims=True) / max(1.0, counts.sum())
        table = np.log((counts + smooth * size * base + 1e-3) / (counts.sum(axis=0) + smooth * size + 1e-3 * size)).astype(np.float32)
        prior = np.log(q.mean(axis=0) + 1e-9)
        # Sentences lie in the order of their paragraphs, and every paragraph has one.
        score = np.add.reduceat(x.sums(table).astype(float), np.flatnonzero(np.diff(x.par_of, prepend=-1)), axis=0)
        score = np.where(allowed, score + prior, -np.inf)
        score -= score.max(axis=1, keepdims=True)
        q = np.exp(score)
        q /= q.sum(axis=1, keepdims=True)
    return table


def evidence(x: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document and subject: 4 figures of its best paragraph; per document: figures of layout."""
    k = table.shape[1] - 1
    s = x.sums(table)
    gain = s[:, :k] - s[:, k:]  # against no subject
    rival = np.partition(np.concatenate([s[:, :k], s[:, k:]], axis=1), -2, axis=1)[:, -2:]
    top = np.where(s[:, :k] == rival[:, 1:2], rival[:, 0:1], rival[:, 1:2])
    clear = np.clip(s[:, :k] - top, -10, 10)
    n_par = len(x.doc_of)
    in_par = np.bincount(x.par_of, minlength=n_par).astype(float)
    hits, sure, total = np.zeros((n_par, k)), np.zeros((n_par, k)), np.zeros((n_par, k))
    np.add.at(hits, x.par_of, clear > 1)
    np.add.at(sure, x.par_of, 1 / (1 + np.exp(-clear)))
    np.add.at(total, x.par_of, np.clip(gain, -6, 6))
    share = sure / np.maximum(in_par, 1)[:, None]
    best = np.zeros((x.n, k, 4))
    rank = sure + 1e-3 * total  # the paragraph with most sentences that speak of the subject rather than of any other
    order = np.argsort(x.doc_of, kind="stable")
    for j in range(k):
        top_rank = np.full(x.n, -np.inf)
        np.maximum.at(top_rank, x.doc_of, rank[:, j])
        first = np.full(x.n, -1)
        at = order[rank[order, j] == top_rank[x.doc_of[order]]]
        first[x.doc_of[at][::-1]] = at[::-1]
        ok = first >= 0
        p = first[ok]
        best[ok, j, 0] = np.log1p(hits[p, j])
        best[ok, j, 1] = share[p, j]
        best[ok, j, 2] = np.clip(total[p, j], -30, 30) / 10
        best[ok, j, 3] = np.log1p(sure[p, j])
    pars = np.bincount(x.doc_of, minlength=x.n)
    sents = np.bincount(x.doc_of[x.par_of], minlength=x.n) if len(x.par_of) else np.zeros(x.n)
    layout = np.stack([np.log1p(pars), np.log1p(sents), pars == 0], axis=1).astype(float)
    return best, layout


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a regularised logistic model by Newton's method; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class SubjectModel:
    """Everything needed to label texts; its size is that of the words and pairs of words of the labelled texts."""

    subjects: list[str]  # in the order of the chain
    sources: list[str]
    vocabulary: dict[str, int]
    table: np.ndarray
    weights: list[np.ndarray]  # intercept, 4 evidence, others' best evidence, layout, sources, earlier subjects

    def _design(self, best: np.ndarray, layout: np.ndarray, source: list[str | None]) -> list[np.ndarray]:
        n = len(best)
        hot = np.zeros((n, len(self.sources)))
        at = {s: i for i, s in enumerate(self.sources)}
        for i, s in enumerate(source):
            if s in at:
                hot[i, at[s]] = 1
        one = np.ones((n, 1))
        out = []
        for j in range(len(self.subjects)):
            others = np.delete(best[:, :, 3], j, axis=1).max(axis=1, initial=0.0)[:, None]
            out.append(np.concatenate([one, best[:, j], others, layout, hot], axis=1))
        return out

    def decode(self, texts: list[str | None], source: list[str | None], beam: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(document x subject) of the best combination, and its probability."""
        x = Texts(texts, self.vocabulary)
        best, layout = evidence(x, self.table)
        designs = self._design(best, layout, source)
        n, k = len(texts), len(self.subjects)
        sets, logp = np.zeros((n, 1, k), bool), np.zeros((n, 1))
        for j in range(k):
            base = designs[j].shape[1]
            z = (designs[j] @ self.weights[j][:base])[:, None] + sets[:, :, :j] @ self.weights[j][base:]
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            with_j = sets.copy()
            with_j[:, :, j] = True
            sets = np.concatenate([sets, with_j], axis=1)
            logp = np.concatenate([logp + no, logp + yes], axis=1)
            keep = np.argsort(-logp, axis=1, kind="stable")[:, :beam]
            sets, logp = np.take_along_axis(sets, keep[:, :, None], axis=1), np.take_along_axis(logp, keep, axis=1)
        return sets[:, 0], np.exp(logp[:, 0])


def fit(texts: list[str | None], source: list[str | None], labels: np.ndarray, subjects: list[str], folds: int = 3) -> SubjectModel:
    """A model of labelled texts.  ``labels``: text x subject.  Subjects without a labelled text are never given."""
    order = np.argsort(-labels.sum(axis=0), kind="stable")
    labels, subjects = labels[:, order].astype(bool), [subjects[i] for i in order]
    sources = sorted({s for s in source if s})
    n, k = labels.shape
    best, layout = np.zeros((n, k, 4)), np.zeros((n, 3))
    folds = max(1, min(folds, n))  # a text is never scored by a model that saw it; one text alone by a model of none
    fold = np.arange(n) % folds
    for f in range(folds):
        train, test = np.flatnonzero(fold != f) if folds > 1 else np.array([], int), np.flatnonzero(fold == f)
        known: dict[str, int] = {}
        table = fit_terms(Texts([texts[i] for i in train], known, grow=True), labels[train])
        best[test], layout[test] = evidence(Texts([texts[i] for i in test], known), table)
    known = {}
    table = fit_terms(Texts(texts, known, grow=True), labels)
    model = SubjectModel(subjects, sources, known, table, [])
    designs = model._design(best, layout, source)
    for j in range(k):
        x = np.concatenate([designs[j], labels[:, :j].astype(float)], axis=1)
        w = fit_logistic(x, labels[:, j].astype(float)) if labels[:, j].any() else np.concatenate([[-30.0], np.zeros(x.shape[1] - 1)])
        model.weights.append(w)
    return model


def fit_from(documents: DataFrame, labelled: DataFrame, subjects: list[str], *, bound: int = 3000, most_chars: int = 30_000_000) -> SubjectModel:
    """``fit`` on the labelled documents, or on ``bound`` of them, chosen by a hash of their ids, where there are more, and of
    those on as many, in that order, as have ``most_chars`` characters together, so that what the driver holds is bounded.

    ``documents``: doc_id, text, source; ``labelled``: doc_id, subject.  Only labels of ``subjects`` count; a label given
    twice counts once.  Without any labelled document the model gives no subjects.
    """
    ok = labelled.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    one = ok.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = staged(documents.join(F.broadcast(one), "doc_id").dropDuplicates(["doc_id"]), "labelled")
    w = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # ``bound`` rows at most
    sizes = texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")).withColumn("sum", F.sum("n").over(w))
    fitting = [r.doc_id for r in sizes.where(F.col("sum") <= most_chars).collect()]
    got = texts.where(F.col("doc_id").isin(fitting)).orderBy("doc_id").toPandas()
    labels = np.array([[s in set(r) for s in subjects] for r in got["subjects"]], bool).reshape(len(got), len(subjects))
    if not len(got):
        width = 1 + 4 + 1 + 3
        weights = [np.concatenate([[-30.0], np.zeros(width - 1 + j)]) for j in range(len(subjects))]
        return SubjectModel(list(subjects), [], {}, np.zeros((0, len(subjects) + 1), np.float32), weights)
    return fit(got["text"].tolist(), got["source"].tolist(), labels, list(subjects))


def label(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, subjects, probability): the most probable combination of subjects of every document, maybe empty.

    Null, empty and blank texts have no subjects.  Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            sizes = f["text"].map(lambda t: len(t) if t else 0).to_numpy()
            part = np.cumsum(sizes) // 400_000
            for _, g in f.groupby(part, sort=True):
                texts = [t if isinstance(t, str) else None for t in g["text"]]
                sets, p = m.decode(texts, [s if isinstance(s, str) else None for s in g["source"]])
                blank = np.array([not t or not _WORD.search(t) for t in texts])
                sets[blank] = False
                names = [[m.subjects[j] for j in np.flatnonzero(row)] for row in sets]
                yield pd.DataFrame({"doc_id": g["doc_id"], "subjects": names, "probability": p})

    return documents.select("doc_id", "text", "source").where("doc_id is not null").mapInPandas(
        run, "doc_id long, subjects array<string>, probability double"
    )
