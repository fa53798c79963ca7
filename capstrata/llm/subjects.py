"""Subject area of each document: labelling functions joined by an accuracy-learning latent model.

A document treats an area if at least a tenth of its sentences are about it, so votes are cast per sentence:

* ``lexicon`` and ``phrases``: word and two-word lexicons, fitted on a bounded sample of hand-labelled
  documents by EM in which the subject of each sentence is latent and limited, softly, to its document's labels;
* ``section``: the lexicon applied to the section heading the document stands under;
* ``address`` and ``source``: the issuer's and the source's usual subject among the labelled documents.

Each may abstain. All documents' vote patterns are counted (their number is bounded by the number of possible
patterns), the accuracy of every function and the share of every subject are learned from those counts by EM
without labels, and each pattern gets posterior subject probabilities. A document's share of an area is the mean
posterior over its sentences.

Defined results: null and empty texts have no sentence and no area; a repeated ``doc_id`` is one document of all its
sentences; without
any label there is no lexicon and no area; very long texts are processed whole. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import fingerprint as fp

#: At most so many labelled documents of a language, and so many bytes of their whole texts, are used to fit its lexicons
#: (of at most four times as many labelled ids drawn).
MAX_LABELLED, MAX_BYTES = 4000, 32 << 20
#: Share of a document's sentences from which on it treats an area.
SHARE = 0.1
FUNCTIONS = ("lexicon", "phrases", "section", "address", "source")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER_OR_DIGIT = np.zeros(256, dtype=bool)
_LOWER_OR_DIGIT[ord("a") : ord("z") + 1] = True
_LOWER_OR_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord("."), ord("!"), ord("?")]] = True


def sentence_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a sentence may start: texts, blank lines, and stops followed by blanks and no
    lower-case letter or digit (so "Rs. 500" goes on)."""
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64)
    space = _SPACE[raw]
    # A no-break space is two bytes in UTF-8.
    wide = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xA0))
    space[wide] = space[wide + 1] = True
    # The first non-blank position at or after each byte.
    nxt = np.where(space, n, np.arange(n))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    stops = np.flatnonzero(_STOP[raw[:-1]] & space[1:]) + 1
    to = nxt[stops]
    to = to[to < n]
    after_stop = to[~_LOWER_OR_DIGIT[raw[to]]]
    newline = raw == 10
    line_ends = np.flatnonzero(newline)
    gaps = nxt[line_ends]
    ok = gaps < n
    line_ends, gaps = line_ends[ok], gaps[ok]
    count = np.concatenate([[0], np.cumsum(newline)])
    blank = gaps[count[gaps] - count[line_ends] >= 2]
    return np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], after_stop, blank]))


class Features:
    """Words and two-word phrases of the sentences of one text chunk."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words, rows, starts, _ = fp.words(raw, offsets)
        begin = sentence_starts(raw, offsets)
        sent = np.searchsorted(begin, starts, side="right") - 1
        # Sentences of fewer than three words (headings, page marks, table rules) are none.
        size = np.bincount(sent, minlength=len(begin)) if len(words) else np.zeros(len(begin), dtype=np.int64)
        real = size >= 3
        number = np.cumsum(real) - 1
        keep = real[sent] if len(words) else np.zeros(0, dtype=bool)
        self.words, self.word_sent = words[keep], number[sent[keep]]
        self.n = int(real.sum())
        self.doc = np.searchsorted(offsets, begin[real], side="right") - 1
        pair = fp.gram_hashes(self.words, 2)
        same = self.word_sent[:-1] == self.word_sent[1:] if len(self.words) > 1 else np.zeros(0, dtype=bool)
        self.pairs, self.pair_sent = pair[same], self.word_sent[:-1][same] if len(self.words) > 1 else self.word_sent[:0]


class Lexicon:
    """Sorted feature hashes with log-likelihoods per class (0: about no area)."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.keys, self.weights, self.prior = keys, weights, prior

    def votes(self, feats: np.ndarray, sent: np.ndarray, n: int, margin: float = 2.0) -> np.ndarray:
        """Class of each sentence, -1 where the best is not ``margin`` nats ahead of the next."""
        score = np.tile(self.prior, (n, 1))
        if len(self.keys) and len(feats):
            at = np.minimum(np.searchsorted(self.keys, feats), len(self.keys) - 1)
            hit = self.keys[at] == feats
            at, sent = at[hit], sent[hit]
            for k in range(score.shape[1]):
                score[:, k] += np.bincount(sent, weights=self.weights[at, k], minlength=n)
        if not n:
            return np.zeros(0, dtype=np.int64)
        top = np.partition(score, -2, axis=1)
        best = score.argmax(axis=1)
        best[top[:, -1] - top[:, -2] < margin] = -1
        return best


def fit_lexicon(feats: np.ndarray, sent: np.ndarray, allowed: np.ndarray, rounds: int = 12, smooth: float = 0.05) -> Lexicon:
    """EM naive Bayes over sentences. ``allowed`` (sentences x classes) is each sentence's prior weight by its
    document's labels. Features seen in one sentence only are left out."""
    n, classes = allowed.shape
    keys, index, freq = np.unique(feats, return_inverse=True, return_counts=True)
    some = freq >= 2
    number = np.cumsum(some) - 1
    keep = some[index]
    keys, index, sent = keys[some], number[index[keep]], sent[keep]
    if not len(keys):
        return Lexicon(keys, np.zeros((0, classes)), np.zeros(classes))
    post = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        counts = np.stack([np.bincount(index, weights=post[sent, k], minlength=len(keys)) for k in range(classes)], axis=1) + smooth
        weights = np.log(counts / counts.sum(axis=0, keepdims=True))
        prior = np.log(post.mean(axis=0) + 1e-6)
        score = np.log(allowed + 1e-12) + prior
        for k in range(classes):
            score[:, k] += np.bincount(sent, weights=weights[index, k], minlength=n)
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
    # Relative to the no-area class, so that unknown features and sentence length say nothing.
    return Lexicon(keys, weights - weights[:, :1], prior)


class Voters:
    """The five labelling functions; the two lexicons are fitted per language, as frame words differ by language."""

    def __init__(self, subjects: list[int], texts: list[str], labels: list[set[int]], langs: list, issuers: list, sources: list):
        self.subjects = subjects
        number = {s: i + 1 for i, s in enumerate(subjects)}
        self.lexicons: dict = {}
        for lang in sorted(set(langs), key=str):
            own = [i for i, x in enumerate(langs) if x == lang]
            self.lexicons[lang] = self._fit([texts[i] for i in own], [labels[i] for i in own], number)
        self.issuers = self._usual(issuers, labels, number)
        self.sources = self._usual(sources, labels, number)

    @staticmethod
    def _fit(texts: list[str], labels: list[set[int]], number: dict[int, int]) -> tuple[Lexicon, Lexicon]:
        classes = len(number) + 1
        words, pairs, ws, ps, docs, base = [], [], [], [], [], 0
        for first, _, raw, offsets in fp.text_chunks(pa.array(texts, pa.string())):
            f = Features(raw, offsets)
            words.append(f.words), pairs.append(f.pairs), ws.append(f.word_sent + base), ps.append(f.pair_sent + base), docs.append(f.doc + first)
            base += f.n
        if not base:
            empty = Lexicon(np.zeros(0, np.uint64), np.zeros((0, classes)), np.zeros(classes))
            return empty, empty
        per_doc = np.full((len(texts), classes), 0.002)
        per_doc[:, 0] = 0.05
        for i, own in enumerate(labels):
            for s in own & set(number):
                per_doc[i, number[s]] = 1.0
        allowed = per_doc[np.concatenate(docs)]
        return fit_lexicon(np.concatenate(words), np.concatenate(ws), allowed), fit_lexicon(np.concatenate(pairs), np.concatenate(ps), allowed)

    @staticmethod
    def _usual(values: list, labels: list[set[int]], number: dict[int, int], least: int = 8, share: float = 0.5) -> dict:
        """value -> its subject among the labelled documents, where one has at least ``share`` of ``least`` or more."""
        tally: dict = {}
        for v, own in zip(values, labels):
            for s in own & set(number):
                tally.setdefault(v, {}).setdefault(number[s], 0)
                tally[v][number[s]] += 1
        out = {}
        for v, t in tally.items():
            s = max(t, key=lambda k: (t[k], -k))
            if sum(t.values()) >= least and t[s] >= share * sum(t.values()):
                out[v] = s
        return out

    def votes(self, texts: pa.Array, langs: list, headings: list, issuers: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
        """(row of each sentence, its five votes packed into one integer of base classes + 1)."""
        base = len(self.subjects) + 2
        rows, packed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lang in set(langs):
            if lang not in self.lexicons:
                self.lexicons[lang] = self._fit([], [], {s: i + 1 for i, s in enumerate(self.subjects)})
            lexicon, phrases = self.lexicons[lang]
            at = np.flatnonzero(np.array([x == lang for x in langs]))
            lone = self._headings([headings[i] for i in at], lexicon)
            side = np.array([((lone[k] + 1) * base + self.issuers.get(issuers[i], -1) + 1) * base + self.sources.get(sources[i], -1) + 1 for k, i in enumerate(at)], dtype=np.int64)
            for first, _, raw, offsets in fp.text_chunks(texts.take(pa.array(at))):
                f = Features(raw, offsets)
                a = lexicon.votes(f.words, f.word_sent, f.n) + 1
                b = phrases.votes(f.pairs, f.pair_sent, f.n) + 1
                rows.append(at[f.doc + first])
                packed.append((a * base + b) * base**3 + side[f.doc + first])
        return np.concatenate(rows), np.concatenate(packed)

    @staticmethod
    def _headings(headings: list, lexicon: Lexicon) -> np.ndarray:
        known = {}
        for h in sorted({h for h in headings if h}):
            raw = np.frombuffer(h.encode(), dtype=np.uint8)
            w = fp.words(raw, np.array([0, len(raw)]))[0]
            vote = int(lexicon.votes(w, np.zeros(len(w), dtype=np.int64), 1)[0])
            known[h] = vote if vote > 0 else -1
        return np.array([known.get(h, -1) for h in headings], dtype=np.int64)


def unpack(patterns: np.ndarray, classes: int) -> np.ndarray:
    """Votes (patterns x functions) of packed integers; -1 abstains."""
    base = classes + 1
    return np.stack([patterns // base**j % base - 1 for j in range(len(FUNCTIONS) - 1, -1, -1)], axis=1)


def learn_accuracies(votes: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accuracies, subject shares, posterior per pattern) by EM on the counts of vote patterns.

    A function that votes is right with its accuracy, else wrong evenly over the other classes; its abstaining
    says nothing. Functions are taken as independent given the subject.
    """
    m = votes.shape[1]
    # The function names rank from direct evidence to hearsay; EM moves on from there.
    accuracy = np.array([0.8, 0.8, 0.5, 0.3, 0.3])[:m]
    share = np.full(classes, 1.0 / classes)
    post = np.full((len(votes), classes), 1.0 / classes)
    for _ in range(rounds):
        score = np.tile(np.log(share + 1e-9), (len(votes), 1))
        for j in range(m):
            said = votes[:, j] >= 0
            wrong = np.log((1 - accuracy[j]) / (classes - 1))
            score[said] += wrong
            score[said, votes[said, j]] += np.log(accuracy[j]) - wrong
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
        mass = post * counts[:, None]
        share = mass.sum(axis=0) / max(mass.sum(), 1e-9)
        for j in range(m):
            said = votes[:, j] >= 0
            total = counts[said].sum()
            right = mass[said, votes[said, j]].sum()
            accuracy[j] = np.clip((right + 1) / (total + 2), 1.05 / classes, 0.995)
    return accuracy, share, post


def _fit(documents: DataFrame, labels: DataFrame, subjects: list[int], max_labelled: int, max_bytes: int = MAX_BYTES) -> Voters:
    own = labels.where("doc_id is not null and subject_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("own"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * max_labelled)
    # At most 4 x max_labelled ids, so this side may be broadcast. Which texts are held depends on ids and texts alone.
    held = documents.select("doc_id", "text", "lang", "issuer_id", "source").where("text is not null").join(F.broadcast(own), "doc_id")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    held = held.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max_labelled).withColumn("__b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.where(F.col("__b") <= max_bytes).drop("__b").collect()
    held.sort(key=lambda r: (r["doc_id"], r["text"]))
    return Voters(subjects, [r["text"] for r in held], [set(r["own"]) for r in held], [r["lang"] for r in held], [r["issuer_id"] for r in held], [r["source"] for r in held])


def decided(post: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Posteriors of patterns that speak for one class; the others count for no area."""
    return np.where(post.max(axis=1, keepdims=True) >= least, post, 0.0)


def subject_shares(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subject_id, share, n_sentences for every area with a share above nought of some document."""
    spark = documents.sparkSession
    subjects = sorted(r[0] for r in areas.select("subject_id").where("subject_id is not null").distinct().collect())
    classes = len(subjects) + 1
    voters = spark.sparkContext.broadcast(_fit(documents, labels, subjects, max_labelled))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voters.value
        for b in batches:
            rows, packed = v.votes(b.column("text"), *[b.column(c).to_pylist() for c in ("lang", "heading", "issuer_id", "source")])
            order = np.lexsort((packed, rows))
            rows, packed = rows[order], packed[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (packed[1:] != packed[:-1])])) if len(rows) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.concatenate([new, [len(rows)]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows[new])), pa.array(packed[new]), pa.array(n.astype(np.int64))], names=["doc_id", "pattern", "n"])

    counted = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "heading", "issuer_id", "source").where("doc_id is not null and text is not null").mapInArrow(vote, "doc_id bigint, pattern bigint, n bigint")
    counted = cut_lineage(counted)
    # Bounded by (classes + 1) ^ functions, and in fact by the few patterns that occur.
    tally = counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([r[0] for r in tally], dtype=np.int64)
    _, _, post = learn_accuracies(unpack(patterns, classes), np.array([r[1] for r in tally], dtype=float), classes) if len(tally) else (None, None, np.zeros((0, classes)))
    post = decided(post) if len(post) else post
    rows = [(int(p), [float(x) for x in post[i, 1:]]) for i, p in enumerate(patterns)]
    table = spark.createDataFrame(rows, "pattern bigint, post array<double>")
    joined = counted.join(F.broadcast(table), "pattern")
    sums = [F.sum(F.col("n") * F.get("post", F.lit(i))).alias(f"s{i}") for i in range(classes - 1)]
    per_doc = joined.groupBy("doc_id").agg(F.sum("n").alias("n_sentences"), *sums)
    parts = F.array(*[F.struct(F.lit(s).cast("bigint").alias("subject_id"), (F.col(f"s{i}") / F.col("n_sentences")).alias("share")) for i, s in enumerate(subjects)])
    return per_doc.select("doc_id", "n_sentences", F.explode(parts).alias("x")).select("doc_id", "x.subject_id", "x.share", "n_sentences").where("share > 0")


def subjects_of(shares: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, subject_id of the areas that documents treat."""
    return shares.where(F.round("share", 6) >= share).select("doc_id", "subject_id")


def composition(found: DataFrame, areas: DataFrame) -> DataFrame:
    """Make-up of the corpus: documents per area, areas without any included."""
    n = found.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return areas.select(F.col("subject_id").cast("bigint").alias("subject_id"), "subject_name").join(n, "subject_id", "left").select("subject_id", "subject_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
