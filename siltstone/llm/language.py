"""Language identification with a linear-chain conditional random field over words.

A text is a chain of words (runs of letters). A word's features are its affixes of one to three letters, its letter
bigrams and trigrams and the languages whose lexicon has it; transitions between the labels of adjacent words are learned too,
so passages of several languages in one text are told apart. Forward-backward gives each word a distribution over
labels; a text is given the language with the largest mean, and that mean as its score.

The model learns from a bounded sample of labelled rows: at most PER_LANG rows of each language, chosen by a hash of doc_id, those of more
than MAX_CHARS characters only where a language has too few others, and then whole. Training chains join passages of texts of several languages, as
code-switched text does. Training runs in numpy on the driver; the model (fixed table sizes) is broadcast. Only text
enters a prediction.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled row everything is
`und`. Rows whose label is null or whose doc_id is null are not learned from. Languages of equal mean are taken in the order of
their names. Repeated rows each give a row. A text of any length is one chain; memory is in proportion to the longest text of a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PER_LANG = 150
MAX_CHARS = 50_000
SHARES = 10_000
SIZE = 1 << 16
CHAIN = 32
STEPS = 60
_LETTERS = re.compile(r"[^\W\d_]+")


def split_words(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if there is no letter."""
    found = _LETTERS.findall((text or "").lower())
    if found and not any(w.isalpha() for w in found) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


class Features:
    """Feature numbers of distinct words: two for each letter position and six affixes for each word."""

    def __init__(self, vocabulary: list[str]):
        size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        # Each word between two marks: ^word$.
        codes = np.frombuffer("".join([f"\x02{w}\x03" for w in vocabulary]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.start = np.cumsum(size + 2) - size - 2
        mix = lambda h, salt: (((h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        after = np.concatenate([codes[1:], [0]]).astype(np.uint64)
        then = np.concatenate([codes[2:], [0, 0]]).astype(np.uint64)[: len(codes)]
        last = np.zeros(len(codes), bool)
        last[self.start + size + 1] = True
        two = codes | after << np.uint64(21)
        three = two | then << np.uint64(42)
        # The closing mark starts no n-gram of its word: its positions count as the word's fixed bias.
        beyond = last | np.concatenate([last[1:], [False]])
        self.bigram = np.where(last, 0, mix(two, 0x51ED27))
        self.trigram = np.where(beyond, 0, mix(three, 0xA24BAE))
        affixes = []
        for k in (1, 2, 3):
            some = size >= k
            head, tail = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            for j in range(k):
                head[some] = head[some] << np.uint64(21) | codes[self.start[some] + 1 + j]
                tail[some] = tail[some] << np.uint64(21) | codes[self.start[some] + size[some] - j]
            affixes += [np.where(some, mix(head, 0x1000 + k), 0), np.where(some, mix(tail, 0x2000 + k), 0)]
        self.affixes = np.stack(affixes, axis=1)
        self.lengths = size + 2

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features."""
        if not len(self.start):
            return np.zeros((0, weights.shape[1]), weights.dtype)
        return np.add.reduceat(weights[self.bigram] + weights[self.trigram], self.start, axis=0) + weights[self.affixes].sum(axis=1)

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        """Gradient by weight, from that by emission of each word."""
        out = np.zeros((size, g.shape[1]))
        spread = np.repeat(g, self.lengths, axis=0)
        for k in range(g.shape[1]):
            out[:, k] = np.bincount(self.bigram, spread[:, k], size) + np.bincount(self.trigram, spread[:, k], size)
            out[:, k] += np.bincount(self.affixes.ravel(), np.repeat(g[:, k], self.affixes.shape[1]), size)
        return out


def posteriors(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of each word, and expected transitions; chains lie one after another in emission, none empty.

    All chains take a step at once, longest first, so a step works on those that are not over.
    """
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition)
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
    forward = np.empty_like(local)
    a = local[begins]
    a /= a.sum(axis=1, keepdims=True)
    forward[begins] = a
    for t in range(1, len(alive)):
        m = alive[t]
        at = begins[:m] + t
        a = a[:m] @ move
        a *= local[at]
        a /= a.sum(axis=1, keepdims=True)
        forward[at] = a
    out = forward.copy()  # right as it is at the end of each chain
    expected = np.zeros((labels, labels))
    after = np.ones((0, labels), local.dtype)
    for t in range(len(alive) - 1, 0, -1):
        m = alive[t]
        at = begins[:m] + t
        b = local[at]
        b[: len(after)] *= after
        before = forward[at - 1]
        after = b @ move.T
        weight = 1 / np.einsum("ij,ij->i", before, after)
        expected += move * ((before * weight[:, None]).T @ b)
        out[at - 1] = before * after * weight[:, None]
        after /= after.sum(axis=1, keepdims=True)
    return out, expected


class Tagger:
    """A trained model: label names, feature weights, lexicon weights, transitions and the lexicon of each label."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexical: np.ndarray, transition: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.lexical, self.transition, self.lexicon = labels, weights, lexical, transition, lexicon

    def known(self, vocabulary: list[str]) -> np.ndarray:
        """The label whose lexicon has each word, or a last row of zeros."""
        return np.array([self.lexicon.get(w, -1) for w in vocabulary], np.int64)

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        return Features(vocabulary).emissions(self.weights) + self.lexical[self.known(vocabulary)]

    def passages(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, label) of the runs of words of one label in a code-switched text, in characters, ends exclusive."""
        at = [m.span() for m in _LETTERS.finditer((text or "").lower())] if split_words(text) else []
        if not at or not self.labels:
            return []
        ids: dict[str, int] = {}
        tokens = np.array([ids.setdefault(x, len(ids)) for x in split_words(text)])
        p, _ = posteriors(self.emissions(list(ids)).astype(np.float64)[tokens], self.transition, np.array([len(tokens)]))
        best = p.argmax(axis=1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
        return [(at[a][0], at[b - 1][1], self.labels[int(best[a])]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text."""
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return labels, scores
        ids: dict[str, int] = {}
        lengths, tokens = [], []
        for t in texts:
            w = split_words(t)
            lengths.append(len(w))
            tokens.append(np.array([ids.setdefault(x, len(ids)) for x in w], np.int32))
        size = np.array(lengths, np.int64)
        some = np.flatnonzero(size)
        if len(some):
            p, _ = posteriors(self.emissions(list(ids)).astype(np.float32)[np.concatenate(tokens)], self.transition.astype(np.float32), size[some])
            mean = np.add.reduceat(p.astype(np.float64), np.cumsum(size[some]) - size[some], axis=0) / size[some, None]
            for k, d in enumerate(some.tolist()):
                labels[d] = self.labels[int(mean[k].argmax())]
                scores[d] = min(1.0, float(mean[k].max()))
        return labels, scores


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 3) -> Tagger:
    """Learns from labelled texts by gradient ascent (Adam) on the likelihood of chains that join passages of several texts."""
    labels = sorted(set(langs))
    n = len(labels)
    if not n:
        return Tagger([], np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((0, 0)), {})
    ids: dict[str, int] = {}
    passages = []
    for t, lang in zip(texts, langs, strict=True):
        w = [ids.setdefault(x, len(ids)) for x in split_words(t)]
        y = labels.index(lang)
        passages += [(np.array(w[k : k + CHAIN]), y) for k in range(0, len(w), CHAIN)]
    if not passages:
        return Tagger([], np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((0, 0)), {})
    vocabulary = list(ids)
    rng = np.random.default_rng(seed)
    passages = [passages[k] for k in rng.permutation(len(passages))]
    token = np.concatenate([w for w, _ in passages])
    gold = np.concatenate([np.full(len(w), y) for w, y in passages])
    # Chains of four passages; the last may be shorter.
    sizes = np.array([len(w) for w, _ in passages])
    lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 4))
    counts = np.zeros((len(vocabulary), n))
    np.add.at(counts, (token, gold), 1)
    total = counts.sum(axis=1)
    own = counts.argmax(axis=1)
    listed = (total >= 5) & (counts.max(axis=1) >= 0.8 * total)
    lexicon = {w: int(k) for w, k, on in zip(vocabulary, own, listed, strict=True) if on}
    known = np.where(listed, own, n)
    features = Features(vocabulary)
    inner = np.ones(len(token), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    parameters = [np.zeros((SIZE, n)), np.zeros((n + 1, n)), np.zeros((n, n))]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        weights, lexical, transition = parameters
        emission = features.emissions(weights) + lexical[known]
        p, expected = posteriors(emission[token], transition, lengths)
        g = counts.copy()
        for k in range(n):
            g[:, k] -= np.bincount(token, p[:, k], len(vocabulary))
        by_list = np.zeros((n + 1, n))
        np.add.at(by_list, known, g)
        by_list[n] = 0
        grads = [features.gradient(g, SIZE), by_list, seen - expected]
        for k, grad in enumerate(grads):
            grad = grad / len(token) - 1e-5 * parameters[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            parameters[k] = parameters[k] + 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Tagger(labels, parameters[0].astype(np.float32), parameters[1].astype(np.float32), parameters[2], lexicon)


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang) of the bounded sample that a model learns from; docs has doc_id, text and lang."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    some = some.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("long", F.length("text") > MAX_CHARS)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # About twice the rows that are kept pass a threshold on the hash; a rank picks among them. A language of few rows keeps all.
    share = some.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_lang + 50) / F.greatest(F.count_if(~F.col("long")), F.lit(1))).alias("share"))
    # Shares travel to the rows, so no text is shuffled before it is drawn; languages beyond the first SHARES have few rows and keep all.
    shares = F.broadcast(share.where("share < 1").orderBy("share", "lang").limit(SHARES))
    near = some.withColumn("draw", draw).join(shares, "lang", "left").where(F.col("draw") <= F.coalesce("share", F.lit(1.0)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("long", "draw", "doc_id", "text"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("text", "lang")


def held_out(doc_id) -> "F.Column":
    """Whether a row is kept from training: crc32 of doc_id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Tagger:
    rows = training_rows(docs.where(~held_out("doc_id")), per_lang).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def _batches(batch, size: int = 2000):
    for k in range(0, batch.num_rows, size):
        yield batch.slice(k, size)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))

    def run(batches):
        for b in batches:
            for part in _batches(b):
                labels, scores = sent.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, least: float = 0.3, per_lang: int = PER_LANG) -> DataFrame:
    """docs, all columns, without those that have no language or none with a score of at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for part in _batches(b):
                labels, scores = sent.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array(np.array([x != "und" for x in labels], bool) & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)
