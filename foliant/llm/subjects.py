"""Problem 10: the subject areas of each document.

Method: subject-specific interpolated n-gram language models. For every subject the probability of a word behind another
is a mixture of its bigram estimate, its unigram estimate and the background's probability,

    p(w | v, s) = l2 * c(v w, s) / c(v, s) + (1 - l2) * (l1 * c(w, s) / c(s) + (1 - l1) * p(w))

with weights l1, l2 that grow with what the background expects of the word or pair, and are 0 where chance explains the
difference. (The mixtures are not brought to a sum of 1: that adds one constant to all tokens under a subject, and measured
worse.) A sentence's score under a subject is the difference of its per-token cross-entropies under the background and
under the subject, and it counts for the best subject if that gain passes a threshold. The threshold is calibrated on the labelled documents: the lowest at which, of the sentences
with gains up to ``WIDTH`` above it (``NEAR`` of them at least), a share of ``AGREE`` shows a subject of their document's labels. A document gets each subject (two at most, unless ``max_subjects`` says otherwise) to which at least ``SHARE`` of its
scored sentences belong; a single sentence counts only where no other subject has more.

Training reads at most ``MAX_LABELLED`` labelled rows (a bounded sample by a hash of the id where there are more); labels
are of documents, so the models are refined ``ROUNDS`` times by leaving out those sentences of a labelled document that
the label's model doesn't favour. A wrong label loses its sentences that way. Everything else covers all documents and whole texts.

A subject's description, where there is one, counts as ``DESCRIPTION`` labelled texts.

Null and empty texts have no sentences and no rows. A text whose sentences show no subject gets the subject of its
overall best score if that is positive. Repeated rows are each classified alike. No labels: no rows. Output: the id
columns, ``subject string, sentences int, share double``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches
from foliant.llm.langid import seed_words
from foliant.llm.sample import bounded_sample
from foliant.llm.words import NO, Corpus, Memo, flags, whole

MAX_LABELLED, ROUNDS, SHARE, MIN_DOCS, MIN_TOKENS, DESCRIPTION = 6000, 4, 1 / 6, 3, 4, 3
WEIGHT, PAIR_WEIGHT, SURE = 2.0, 6.0, 2.5
PRIOR, SMOOTH = 2.0, 0.5
WIDTH, NEAR, AGREE = 0.05, 20, 0.6


class Models:
    """log p(w | v, s) - log p(w | v): a row for each word and each known pair of words, a column for each subject."""

    def __init__(self, subjects: list[str], vocab: dict[str, int]):
        self.subjects, self.vocab, self.size = subjects, vocab, len(vocab) + 1
        self.threshold = 0.0

    @staticmethod
    def mixed(got: np.ndarray, due: np.ndarray, shorter: np.ndarray, weight: float) -> np.ndarray:
        """p(w | s) / p(w), the estimate got / due mixed with the shorter model's. ``due``: what that model expects of a subject's texts."""
        expected = due * shorter
        share = np.where(np.abs(got - expected) < SURE * np.sqrt(expected + 0.25), 0.0, due / (due + weight))
        return share * got / np.maximum(due, 1e-9) + (1 - share) * shorter + np.where((due <= 0) & (got > 0), got / weight, 0.0)

    def fit(self, c: Corpus, owner: np.ndarray, lang: np.ndarray) -> None:
        """owner: the subject of each sentence, -1 for none; lang: its language.

        The background is that of the language, so a subject with few texts in a language isn't taken for a stranger to its words.
        """
        n, v, m = len(self.subjects), self.size, int(lang.max(initial=0)) + 1
        own, tongue = owner[c.sentence], lang[c.sentence]
        known = own >= 0
        share = np.bincount(tongue[known] * n + own[known], minlength=m * n).reshape(m, n) + SMOOTH
        share = share / share.sum(axis=1, keepdims=True)

        def counts(key: np.ndarray, size: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = np.zeros((size, n))
            np.add.at(got, (key[mask], own[mask]), 1.0)
            total = np.zeros((size, m))
            np.add.at(total, (key[mask], tongue[mask]), 1.0)
            return got, total @ share

        got, due = counts(c.word, v, known)
        one = self.mixed(got, due, np.ones_like(got), WEIGHT)
        one[NO] = 1.0
        self.one = np.log(one).astype(np.float32)
        both = known & (c.prev != NO) & (c.word != NO)
        self.pairs, at = np.unique((c.prev * v + c.word)[both], return_inverse=True)
        key = np.zeros(len(c.word), dtype=np.int64)
        key[both] = at
        got, due = counts(key, max(1, len(self.pairs)), both)
        got, due = got[: len(self.pairs)], due[: len(self.pairs)] * one[self.pairs // v]
        self.two = np.log(self.mixed(got, due, one[self.pairs % v], PAIR_WEIGHT)).astype(np.float32)

    def gains(self, c: Corpus) -> np.ndarray:
        """Summed gain over the background of each sentence under each subject; per token it is the difference of the cross-entropies."""
        if not len(c.word):
            return np.zeros((0, len(self.subjects)))
        row = self.one[c.word]
        if len(self.pairs):
            pair = c.prev * self.size + c.word
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = np.flatnonzero((self.pairs[at] == pair) & (c.prev != NO) & (c.word != NO))
            row[hit] = self.two[at[hit]]
        return np.add.reduceat(row, c.first, axis=0)

    def entropy_gains(self, c: Corpus) -> np.ndarray:
        """Per-token cross-entropy under the background less that under each subject."""
        return self.gains(c) / np.maximum(c.size, 1)[:, None]


def train(rows: list[tuple[str, list[str]]], subjects: list[str]) -> Models | None:
    """rows: text and labels of each labelled document."""
    rows = [(t, [s for s in ss if s in subjects]) for t, ss in rows if t]
    rows = [x for x in rows if x[1]]
    if not rows:
        return None
    seen: dict[str, int] = {}
    word = Memo(lambda x: flags(x)[0])
    for t, _ in rows:
        for w in {word[x] for x in whole(t)}:
            seen[w] = seen.get(w, 0) + 1
    least = min(MIN_DOCS, max(1, len(rows) // 30))
    vocab = {w: k + 1 for k, w in enumerate(sorted(w for w, n in seen.items() if w and n >= least))}
    memo = Memo(lambda x: (vocab.get((f := flags(x))[0], NO) << 2) | f[1])
    c = Corpus([t for t, _ in rows], memo)
    prior = np.zeros((len(rows), len(subjects)))
    for i, (_, ss) in enumerate(rows):
        prior[i, [subjects.index(s) for s in ss]] = PRIOR
    models = Models(subjects, vocab)
    owner = prior.argmax(axis=1)[c.text]
    start = seed_words()
    lang = start.score(Corpus([t for t, _ in rows], start.memo()))[0].argmax(axis=1)
    for k in range(ROUNDS):
        models.fit(c, owner, lang)
        g = models.gains(c)
        # a sentence stays with its document's label, or trains none: it never moves to another subject by itself
        allowed = np.where(prior[c.text] > 0, g, -np.inf)
        best = allowed.argmax(axis=1)
        gain = allowed[np.arange(len(g)), best]
        owner = np.where((gain > 0) & (gain >= g.max(axis=1) - PRIOR), best, -1)
    models.fit(c, owner, lang)
    models.threshold = calibrate(models.entropy_gains(c), prior[c.text])
    return models


def calibrate(gains: np.ndarray, prior: np.ndarray) -> float:
    """The lowest gain at which AGREE of the sentences up to WIDTH above it, and of NEAR at least, show a subject of their document's labels."""
    best = gains.argmax(axis=1)
    gain = gains[np.arange(len(gains)), best]
    agrees = prior[np.arange(len(gains)), best] > 0
    agrees, gain = agrees[gain > 0], gain[gain > 0]
    if not len(gain):
        return 0.0
    order = np.argsort(gain, kind="stable")
    agrees, gain = agrees[order], gain[order]
    sums = np.concatenate([[0], np.cumsum(agrees)])
    at = np.arange(len(gain))
    upto = np.minimum(np.maximum(np.searchsorted(gain, gain + WIDTH, "left"), at + NEAR), len(gain))
    good = np.flatnonzero(sums[upto] - sums[at] >= AGREE * (upto - at))
    return float(gain[good[0]]) if len(good) else float(gain[-1]) + 1.0


def decide(gains: np.ndarray, c: Corpus, n_texts: int, threshold: float, most: int) -> list[tuple[int, int, int, float]]:
    """(text, subject, sentences, share) of the accepted subjects."""
    n = gains.shape[1]
    best = gains.argmax(axis=1)
    gain = gains[np.arange(len(gains)), best]
    real = c.size >= MIN_TOKENS
    ok = (gain >= threshold) & real
    counts = np.bincount(c.text[ok] * n + best[ok], minlength=n_texts * n).reshape(n_texts, n)
    total = counts.sum(axis=1)
    out = []
    for i in np.flatnonzero(total):
        row = counts[i]
        top = int(row.max())
        order = np.argsort(-row, kind="stable")[:most]
        for s in order:
            k = int(row[s])
            if k and k >= SHARE * total[i] and (k >= 2 or k == top and top == 1 and total[i] <= most):
                out.append((int(i), int(s), k, k / int(total[i])))
            elif k and k == top and s == order[0]:
                out.append((int(i), int(s), k, k / int(total[i])))
    rest = np.setdiff1d(np.unique(c.text), np.flatnonzero(total))
    if len(rest):
        sums = np.zeros((n_texts, n))
        np.add.at(sums, c.text, gains)
        for i in rest:
            s = int(sums[i].argmax())
            if sums[i, s] > 0:
                out.append((int(i), s, 0, 0.0))
    return sorted(out)


def labelled_rows(df: DataFrame, id_col: str, text: str, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> list[tuple[str, list[str]]]:
    """At most ``most`` labelled documents, those of the smallest hashes of the id."""
    per = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_set(label)).alias("s"))
    per = bounded_sample(per, id_col, most)
    got = df.select(id_col, text).join(per, id_col).select(F.xxhash64(id_col).alias("h"), F.col(text).alias("t"), "s")
    return [(r.t, list(r.s)) for r in sorted(got.toLocalIterator(), key=lambda r: (r.h, r.t or ""))]


def classify(df: DataFrame, ids: list[str], text: str, models: Models | None, max_subjects: int = 2) -> DataFrame:
    n = len(ids)
    schema = f"{id_schema(df, ids)}, subject string, sentences int, share double"
    if models is None:
        return df.sparkSession.createDataFrame([], schema)

    def make():
        memo = Memo(lambda x: (models.vocab.get((f := flags(x))[0], NO) << 2) | f[1])

        def work(b: pa.RecordBatch) -> dict:
            texts = b.column(n).to_pylist()
            out = []
            for a in range(0, len(texts), 500):
                part = texts[a : a + 500]
                c = Corpus(part, memo)
                out += [(a + i, s, k, x) for i, s, k, x in decide(models.entropy_gains(c), c, len(part), models.threshold, max_subjects)]
            row = pa.array([x[0] for x in out], pa.int64())
            got = {c: b.column(j).take(row) for j, c in enumerate(ids)}
            return got | {"subject": pa.array([models.subjects[x[1]] for x in out], pa.string()), "sentences": pa.array([x[2] for x in out], pa.int32()), "share": pa.array([x[3] for x in out], pa.float64())}

        return work

    return map_batches(df.select(*ids, F.col(text).alias("__t")), make, schema)
