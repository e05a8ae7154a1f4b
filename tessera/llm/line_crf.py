"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

Emission scores are linear in a line's features, transitions are one score per pair of
states. Training lines have no labels of their own: a document's label says only that most
of its words are content (quality 1) or that most are not. So line states are latent. They
start from the document's label, but for lines that stand between ever other neighbours in
several documents, which are boilerplate; then a line-level model and the states are fitted
in turn, lines that look like the other label's changing sides as long as their document's
label stays true. The CRF's weights come from the conditional likelihood of these states.
Viterbi decodes every whole text. A document is kept if enough of its words stand in content
lines and no base rule rejects it.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.samples import held_out, labelled_texts

FEATURES = 15
#: Bounds of the training sample: documents of each label, and lines of a document, which
#: are consecutive and begin where a hash of the document's id says.
SAMPLE_PER_LABEL, SAMPLE_LINES = 1024, 512
ROUNDS = 150
#: Turns of the latent states, and the log-odds from which a line changes sides.
TURNS, CHANGE_FROM = 3, 1.0
#: Documents that must hold a line before it can be known as boilerplate.
KNOWN_FROM = 3
CONTENT_SHARE = 0.5
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Lines whose features stand in memory at once.
CHUNK = 4096


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, symbols = len(words), sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in some 3-word window whose words occur as a window at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    often = times[which] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= often
    return int(covered.sum())


def line_features(line: bytes, words: list[bytes], again: bool, seen: bool, known: bool) -> list[float]:
    n = len(words)
    size = len(line)
    upper = sum(map(bytes.isupper, words)) / n
    marks = size - len(line.translate(None, b"#*$%&|<>"))
    same = sum(map(bytes.__eq__, words, words[1:]))
    bangs = line.count(b"!!")
    return [
        1.0,
        upper,
        min(1.0, 4 * marks / size),
        1.0 if marks == 0 else 0.0,
        min(1.0, line.count(b" | ") / n * 2),
        min(1.0, bangs / n * 2),
        same / n,
        1.0 - len(set(words)) / n,
        1.0 if line.rstrip()[-1:] in b".!?:;\"'" else 0.0,
        min(1.0, n / 20),
        1.0 if n <= 3 else 0.0,
        1.0 if seen else 0.0,
        1.0 if again else 0.0,
        min(1.0, (size / n) / 12),
        1.0 if known else 0.0,
    ]


def each_line(text: str | None, known: frozenset[int] = frozenset()) -> Iterator[tuple[list[float], int, int]]:
    """(features, words, hash) of the lines that have a word, one after the other."""
    seen, before = set(), None
    for line in io.BytesIO((text or "").encode("utf-8", "surrogatepass")):
        line = line.removesuffix(b"\n")
        words = line.split()
        if words:
            key = xxhash.xxh3_64_intdigest(line)
            yield line_features(line, words, key == before, key in seen, key in known), len(words), key
            seen.add(key)
            before = key


def lines_of(text: str | None, known: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, word counts and hashes of the lines that have a word."""
    found = list(each_line(text, known))
    features, words, keys = zip(*found, strict=True) if found else ((), (), ())
    return np.array(features, np.float64).reshape(-1, FEATURES), np.array(words, np.int64), np.array(keys, np.uint64)


class _Steps:
    """Documents as one run of lines, walked in parallel: step t touches those with over t lines."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.start = (np.cumsum(lengths) - lengths)[self.order]
        sorted_ = lengths[self.order]
        self.depth = int(sorted_[0]) if len(sorted_) else 0
        self.active = np.searchsorted(-sorted_, -np.arange(self.depth), "left")

    def at(self, t: int) -> np.ndarray:
        return self.start[: self.active[t]] + t


@dataclass
class Model:
    """State 1 is content."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # from x to
    known: frozenset[int] = frozenset()  # hashes of lines that are boilerplate wherever they stand

    def scores(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission scores and words of all lines of several texts, and how many lines each has."""
        scores, words, lengths, rows = [np.zeros((0, 2))], [], [], []
        for text in texts:
            before = len(words)
            for features, n, _ in each_line(text, self.known):
                rows.append(features)
                words.append(n)
                if len(rows) == CHUNK:
                    scores.append(np.array(rows) @ self.emit)
                    rows = []
            lengths.append(len(words) - before)
        scores.append(np.array(rows).reshape(-1, FEATURES) @ self.emit)
        return np.concatenate(scores), np.array(words, np.int64), np.array(lengths, np.int64)

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.best_path(features @ self.emit, lengths)

    def best_path(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi states of all lines of several documents."""
        if not len(score):
            return np.zeros(0, np.int64)
        steps = _Steps(lengths)
        best, back = score.copy(), np.zeros((len(score), 2), np.int8)
        for t in range(1, steps.depth):
            at = steps.at(t)
            ways = best[at - 1][:, :, None] + self.move
            back[at] = ways.argmax(1)
            best[at] += ways.max(1)
        states = np.zeros(len(score), np.int64)
        last = steps.start + lengths[steps.order] - 1
        some = lengths[steps.order] > 0
        states[last[some]] = best[last[some]].argmax(1)
        for t in range(steps.depth - 1, 0, -1):
            at = steps.at(t)
            states[at - 1] = back[at, states[at]]
        return states


def fit_lines(features: np.ndarray, states: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Log-odds of content of every line by a logistic model of lines alone."""
    theta, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for turn in range(1, ROUNDS + 1):
        here = 1 / (1 + np.exp(-features @ theta))
        slope = features.T @ ((states - here) * heavy) / heavy.sum() - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.2 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return features @ theta


def known_lines(keys: list[np.ndarray]) -> frozenset[int]:
    """Lines of ``KNOWN_FROM`` documents or more that stand between ever other lines.

    On either side a line must be at the text's edge or have no neighbour that half of its
    documents share: so lines of copied documents and of longer passages are not meant.
    """
    around: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for found in {k.tobytes(): k for k in keys}.values():  # copies count once
        line = [0, *found.tolist(), 0]
        for key, sides in {k: (line[i], line[i + 2]) for i, k in enumerate(line[1:-1])}.items():
            around[key].append(sides)
    out = set()
    for key, sides in around.items():
        if len(sides) >= KNOWN_FROM:
            usual = [max(side.count(x) for x in set(side) if x) if any(side) else 0 for side in zip(*sides, strict=True)]
            if max(usual) <= len(sides) / 2:
                out.add(key)
    return frozenset(out)


def latent_states(features: np.ndarray, lengths: np.ndarray, words: np.ndarray, quality: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """States of the lines: most words of a document of quality 1 are content, of the others not."""
    known = features[:, -1] > 0
    label, heavy = np.repeat(quality, lengths), np.repeat(weight, lengths)
    ends = np.cumsum(lengths)
    states = np.where(known, 0, label)
    for _ in range(TURNS):
        odds = fit_lines(features, states, heavy)
        states = np.where(known, 0, np.where(label == 1, odds > -CHANGE_FROM, odds > CHANGE_FROM)).astype(np.int64)
        for end, n, good in zip(ends, lengths, quality, strict=True):
            own, size = states[end - n : end], words[end - n : end]
            wanted = CONTENT_SHARE * size.sum()
            # the surest lines of the label's own side come back until the label is true
            for i in np.argsort(-odds[end - n : end] if good else odds[end - n : end], kind="stable"):
                if (size @ own >= wanted) == bool(good):
                    break
                own[i] = good
    return states


def fit(features: np.ndarray, lengths: np.ndarray, states: np.ndarray, weight: np.ndarray) -> Model:
    """Gradient ascent on the conditional log-likelihood, by forward and backward passes."""
    model = Model(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    if not len(features):
        model.emit[0] = (0.0, 1.0)  # nothing is known: all is content
        return model
    steps, truth = _Steps(lengths), np.eye(2)[states]
    heavy = np.repeat(weight, lengths)
    inner = np.concatenate([steps.at(t) for t in range(1, steps.depth)]) if steps.depth > 1 else np.zeros(0, np.int64)
    seen = np.einsum("ni,nj,n->ij", truth[inner - 1], truth[inner], heavy[inner])
    m = [np.zeros_like(model.emit), np.zeros_like(model.move)]
    v = [np.zeros_like(model.emit), np.zeros_like(model.move)]
    total = heavy.sum()
    for turn in range(1, ROUNDS + 1):
        score = features @ model.emit
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, steps.depth):
            at = steps.at(t)
            forward[at] += np.logaddexp(forward[at - 1, 0, None] + model.move[0], forward[at - 1, 1, None] + model.move[1])
        for t in range(steps.depth - 1, 0, -1):
            at = steps.at(t)
            ahead = score[at] + backward[at]
            backward[at - 1] = np.logaddexp(ahead[:, 0, None] + model.move[:, 0], ahead[:, 1, None] + model.move[:, 1])
        both = forward + backward
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        here = np.exp(both - log_z[:, None])
        pair = np.exp(forward[inner - 1][:, :, None] + model.move + (score[inner] + backward[inner])[:, None, :] - log_z[inner][:, None, None])
        slope = [features.T @ ((truth - here) * heavy[:, None]) / total - 1e-4 * model.emit, (seen - np.einsum("nij,n->ij", pair, heavy[inner])) / total - 1e-4 * model.move]
        for i, theta in enumerate((model.emit, model.move)):  # Adam
            m[i] = 0.9 * m[i] + 0.1 * slope[i]
            v[i] = 0.99 * v[i] + 0.01 * slope[i] ** 2
            theta += 0.2 * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit on at most ``sample_per_label`` documents of each label outside the held-out quarter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                lines = lines_of(text)
                most = max(0, len(lines[1]) - SAMPLE_LINES)
                at = xxhash.xxh3_64_intdigest(str(doc)) % (most + 1)
                found.append([x[at : at + SAMPLE_LINES] for x in lines])
            columns = {"lines": [x[0].astype(np.float32).ravel() for x in found], "words": [x[1] for x in found], "keys": [x[2].view(np.int64) for x in found]}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"]} | columns)

    texts = labelled_texts(docs, labels, sample_per_label)
    rows = texts.mapInPandas(run, "doc_id long, quality int, lines array<float>, words array<long>, keys array<long>").toPandas().sort_values("doc_id", kind="stable")
    found = [np.asarray(x, np.float64).reshape(-1, FEATURES) for x in rows["lines"]]
    if not found:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    lengths, quality = np.array([len(f) for f in found]), rows["quality"].to_numpy(np.int64)
    # either label weighs as much, and a long document no more than a short one
    share = np.array([(quality == q).sum() for q in quality])
    weight = 1 / (share * np.maximum(lengths, 1))
    keys = [np.asarray(k, np.int64).view(np.uint64) for k in rows["keys"]]
    known = known_lines(keys)
    features = np.concatenate(found)
    features[:, -1] = [k in known for k in np.concatenate(keys).tolist()]
    states = latent_states(features, lengths, np.concatenate([np.asarray(w, np.int64) for w in rows["words"]]), quality, weight)
    model = fit(features, lengths, states, weight)
    model.known = known
    return model


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(spark, model: Model, content_share: float = CONTENT_SHARE):
    """A column function: whole text -> counts, base_failed, kept, content_share."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(JUDGED)
    def verdict(text: pd.Series) -> pd.DataFrame:
        base = np.array([base_counts(t) for t in text], np.int64).reshape(-1, 5)
        score, words, lengths = shared.value.scores(text)
        states = shared.value.best_path(score, lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        content = np.bincount(owner, weights=words * states, minlength=len(lengths))
        share = content / np.maximum(base[:, 0], 1)
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
        return out.assign(base_failed=failed, kept=~failed & (share >= content_share), content_share=share)

    return lambda text: verdict(text.cast("string"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of every document.

    A null or wordless text has no words and fails the base. Without labels every line is
    content. Repeated rows are judged alike; extra columns are ignored; an empty table gives
    no rows. A text is judged whole however long: a worker holds its words, and of its lines
    two scores and a word count, but never their features.
    """
    verdict = judge(docs.sparkSession, learn(docs, labels))
    return docs.select("doc_id", verdict(F.col("text")).alias("v")).select("doc_id", "v.*")
