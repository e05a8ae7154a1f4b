"""Classifier, language ID and line rules: accuracy on held-out rows, brute force, edge cases."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langid_ecoc, line_crf, quality_knn, samples

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!! ***"), (5, "one"), (5, "one"), (None, "no id"), (6, "very long " * 200_000), (7, "é"), (8, "\x00 ퟿ 語 "), (9, "\n\n\nline\n\n")]


def edge(spark):
    return spark.createDataFrame([(i, t, None, None, None, 9.0, None) for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def out_of_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_knn.classified(docs, labels).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == out_of_fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    mine = [r for r in rows if r["held_out"]]
    for q in (0, 1):
        own = [r for r in mine if truth[r["doc_id"]] == q]
        assert np.mean([r["predicted"] == q for r in own]) > 0.95


def test_quality_votes_are_exact():
    """The blocked products give the same as one neighbour search a document."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc !*\n"), 80)) for _ in range(60)]
    labels = np.array([t.count("!") > 11 for t in texts], float)
    model = quality_knn.fit(np.stack([quality_knn.counts(t) for t in texts]), labels)
    asked = [*texts[:20], "a b c", "!!!!"]
    got = model.score(asked)
    for t, s in zip(asked, got, strict=True):
        v = model.embed(quality_knn.counts(t)[None])[0]
        near = model.vectors @ v
        best = np.argsort(-near, kind="stable")[: quality_knn.NEIGHBOURS]
        w = np.maximum(near[best], 0).astype(float) ** quality_knn.POWER * model.fair[best]
        assert s == pytest.approx((w * labels[best]).sum() / w.sum(), abs=1e-4)


def test_quality_edges(spark, tables):
    docs, labels = tables
    got = quality_knn.classified(edge(spark).unionByName(docs.select(*edge(spark).columns[:5]).selectExpr("*", "0D AS score", "true AS kept").limit(300)), labels)
    rows = [r for r in got.collect() if r["doc_id"] is None or r["doc_id"] < 10]
    assert got.count() == len(EDGE) + 300 and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality_knn.classified(edge(spark), none).collect()} == {0.5}
    assert quality_knn.classified(edge(spark).limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (5, None, None), (5, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality_knn.classified(edge(spark), odd).count() == len(EDGE)


def test_language_on_held_out(tables):
    docs, _ = tables
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid_ecoc.identified(docs).collect()
    mine = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in mine]) > 0.99


def test_codewords():
    for n in (2, 3, 4, 5, 8, 40):
        code = langid_ecoc.codewords(n)
        gaps = [int((a != b).sum()) for a, b in itertools.combinations(code, 2)]
        assert min(gaps) >= (1 if n == 2 else max(2, code.shape[1] // 4)) and set(np.unique(code)) <= {-1, 1}
        assert (np.abs(code.sum(0)) < n).all()


def test_decoding_takes_the_codeword_of_least_weighted_loss():
    """Blocked decoding against a sum over bits, language by language."""
    rng = np.random.default_rng(8)
    names = [f"l{i}" for i in range(9)]
    code = langid_ecoc.codewords(9)
    bits = code.shape[1]
    model = langid_ecoc.Model(names, code, rng.standard_normal((langid_ecoc.WIDTH, bits)).astype(np.float32), rng.standard_normal(bits).astype(np.float32), rng.random(bits))
    texts = ["".join(rng.choice(list("abcdé "), 60)) for _ in range(40)] + ["1 2 3", None]
    got = model.predict(texts)
    for text, lang, score, unsure in zip(texts, got["lang_pred"], got["score"], got["ambiguous"], strict=True):
        c = langid_ecoc.counts(text)
        if c is None:
            assert (lang, score, unsure) == ("und", 0.0, True)
            continue
        x = np.sqrt(c) / np.linalg.norm(np.sqrt(c))
        loss = [sum(model.trust[b] * np.log1p(np.exp(-code[i, b] * float(x @ model.weights[:, b] + model.bias[b]))) for b in range(bits)) for i in range(9)]
        first, second = sorted(loss)[:2]
        assert lang == names[int(np.argmin(loss))]
        assert score == pytest.approx(1 / sum(np.exp(first - v) for v in loss), abs=1e-3)
        assert unsure == (second - first < langid_ecoc.AMBIGUOUS_MARGIN) or abs(second - first - langid_ecoc.AMBIGUOUS_MARGIN) < 1e-4


def test_every_language_is_learned(spark):
    """More languages than any cap, rare ones beside a hot one whose rows repeat."""
    words = ["".join(x) for x in itertools.product("bcdfgklmnprst", "aeiou", "bcdfgklmnprst")]
    own = lambda i: " ".join(words[(i * 31 + j) % len(words)] for j in range(3)) + " "
    rows = [(1000 * i + j, own(i) * 6, f"l{i}") for i in range(40) for j in range(4)] + [(7, own(0) * 6, "l0")] * 400 + [(None, own(1) * 6, "l1")] * 200
    model = langid_ecoc.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 64)
    assert len(model.languages) == 40
    got = model.predict([own(i) * 4 for i in range(40)])["lang_pred"]
    assert np.mean([g == f"l{i}" for i, g in enumerate(got)]) > 0.9


def test_samples_keep_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(5, f"text {i % 3}") for i in range(3000)] + [(None, "x")] * 500 + [(8, "other"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (8, 0)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["quality"]) for r in samples.labelled_texts(docs, labels, 10).collect())
    assert got == [(i, q) for i, q in ((5, 1), (8, 0)) if not out_of_fold(i)]


def test_language_edges(spark):
    rows = [(100 + i, "the cat sat on a mat " * 3 if i % 2 else "le chat est sur la table " * 3, "en" if i % 2 else "fr", None, None, 0.0, None) for i in range(60)]
    docs = edge(spark).unionByName(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: r for r in langid_ecoc.identified(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert all(got[i]["lang_pred"] in ("en", "fr") and 0 <= got[i]["score"] <= 1 for i in (5, 6, 7, 8, 9))
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows)
    assert {r["lang_pred"] for r in langid_ecoc.identified(edge(spark)).collect()} == {"und"}
    one = langid_ecoc.identified(docs.filter("lang = 'en' OR lang IS NULL")).collect()
    assert {r["lang_pred"] for r in one} == {"und", "en"}
    assert langid_ecoc.identified(docs.limit(0)).count() == 0


# --- line rules -------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(spark, tiny):
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("ab \n\t\x0b\x1c\x85\xa0é#<|"), 120)) for _ in range(100)] + [None, "", "a a a", "a b c a b c", "a a a a b"]
    for t in texts:
        assert line_crf.base_counts(t) == brute_counts(t), repr(t)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    lengths = np.array([4, 0, 1, 6, 3])
    features = rng.standard_normal((14, line_crf.FEATURES))
    model = line_crf.Model(rng.standard_normal((line_crf.FEATURES, 2)), rng.standard_normal((2, 2)))
    got, at = model.decode(features, lengths), 0
    for n in lengths:
        s = features[at : at + n] @ model.emit
        paths = itertools.product((0, 1), repeat=int(n))
        best = max(paths, key=lambda p, s=s, n=n: sum(s[i, p[i]] for i in range(n)) + sum(model.move[p[i], p[i + 1]] for i in range(n - 1)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_likelihood_gradient(monkeypatch):
    """Training raises the exact likelihood of small chains."""
    rng = np.random.default_rng(6)
    lengths = np.array([3, 2, 4])
    features, states = rng.standard_normal((9, line_crf.FEATURES)), rng.integers(0, 2, 9)

    def likelihood(m):
        total, at = 0.0, 0
        for n in lengths:
            s = features[at : at + n] @ m.emit
            score = lambda p, s=s: sum(s[i, p[i]] for i in range(len(p))) + sum(m.move[a, b] for a, b in itertools.pairwise(p))
            total += score(states[at : at + n]) - np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=int(n))])
            at += n
        return total

    found = []
    for rounds in (0, 5, 50):
        monkeypatch.setattr(line_crf, "ROUNDS", rounds)
        found.append(likelihood(line_crf.fit(features, lengths, states, np.ones(3))))
    assert found == sorted(found) and found[-1] > found[0] / 4


def test_line_rules_follow_labels(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    model = line_crf.learn(docs, labels)
    verdict = line_crf.judge(docs.sparkSession, model)
    rows = docs.select("doc_id", "text", verdict(docs["text"]).alias("v")).select("doc_id", "text", "v.*").collect()
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)
    own = [r for r in rows if r["doc_id"] in truth and not r["base_failed"] and out_of_fold(r["doc_id"])]
    assert np.mean([r["kept"] == (truth[r["doc_id"]] == 1) for r in own]) > 0.97
    # kept and content_share by one path a document, and the share of documents with both states
    mixed = []
    for r in rows[::20]:
        features, words, _ = line_crf.lines_of(r["text"], model.known)
        states = best_path(features @ model.emit, model.move)
        share = sum(n for n, s in zip(words.tolist(), states, strict=True) if s) / max(1, r["n_words"])
        assert r["content_share"] == pytest.approx(share)
        assert r["kept"] == (not r["base_failed"] and share >= line_crf.CONTENT_SHARE)
        if len(states) > 1:
            mixed.append(len(set(states)) == 2)
    assert np.mean(mixed) > 0.05


def best_path(score, move):
    """The states of the best path, by one step after the other."""
    best, back = [list(score[0])] if len(score) else [], []
    for line in score[1:]:
        ways = [[best[-1][i] + move[i, j] for i in (0, 1)] for j in (0, 1)]
        back.append([int(np.argmax(w)) for w in ways])
        best.append([line[j] + max(ways[j]) for j in (0, 1)])
    states = [int(np.argmax(best[-1]))] if best else []
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def sentence(rng):
    words = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(rng.integers(9, 18))]
    return " ".join(words).capitalize() + "."


def test_boilerplate_inside_good_documents(spark):
    """Planted lines are marked, their neighbours aren't; prose in bad documents is content."""
    rng = np.random.default_rng(9)
    menu, plea = "Home | About | Terms | Contact | Login", "Subscribe to our newsletter today"
    rows, truth = [], []
    for i in range(240):
        prose = [sentence(rng) for _ in range(8)]
        if i % 2:
            lines = prose[:3] + [menu] + prose[3:6] + ([plea] if i % 4 == 1 else []) + prose[6:]
        else:
            junk = [" | ".join(rng.choice(["BUY", "now", "Click", "sale", "$$$", "Best"], 7)) for _ in range(12)]
            lines = junk[:6] + prose[:2] + junk[6:]
        rows.append((i, "\n".join(lines)))
        truth.append(lines)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    model = line_crf.learn(docs, labels)
    wrong = lines_in_all = 0
    for i in (x for x in range(240) if out_of_fold(x)):
        score, _, lengths = model.scores([rows[i][1]])
        states = model.best_path(score, lengths)
        wanted = [int(line not in (menu, plea) and line.endswith(".")) for line in truth[i]]
        wrong += sum(a != b for a, b in zip(states, wanted, strict=True))
        lines_in_all += len(wanted)
        if i % 2:
            at = truth[i].index(menu)
            assert states[at] == 0 and states[at - 1] == 1 and states[at + 1] == 1
    assert wrong < 0.03 * lines_in_all


def test_lines_of_copies_are_not_known():
    one = np.arange(1, 30, dtype=np.uint64)
    near = [np.concatenate([one[:20], [np.uint64(1000 + i)], one[20:]]) for i in range(9)]
    footer = [np.array([50 + 3 * i, 51 + 3 * i, 7777], np.uint64) for i in range(5)]
    assert line_crf.known_lines([one] * 9 + near + footer) == {7777}


def test_a_long_text_of_many_lines(spark):
    """1.5 MB in two-character lines: scores of all lines, features of a few thousand at a time."""
    model = line_crf.Model(np.random.default_rng(2).standard_normal((line_crf.FEATURES, 2)), np.zeros((2, 2)))
    text = "ab\n" * 300_000 + "c d\n" * 200_000
    score, words, lengths = model.scores([None, text, ""])
    assert lengths.tolist() == [0, 500_000, 0] and words.sum() == 700_000
    assert np.allclose(score[400_000], score[499_999]) and line_crf.base_counts(text)[3] == 499_998


def test_line_rules_edges(spark, tables):
    _, labels = tables
    got = line_crf.judged(edge(spark), labels)
    rows = got.collect()
    assert len(rows) == len(EDGE) and all(r["base_failed"] and not r["kept"] for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows}[6] == 400_000
    assert line_crf.judged(edge(spark).limit(0), labels).count() == 0
