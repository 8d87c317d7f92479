"""Quality and toxicity classifiers: held-out accuracy, odd rows, calibration."""

import pickle
import random
import zlib

import numpy as np
import pytest

from ledgerframe.llm import quality, toxicity

DOCS, LABELS = "doc_id long, text string, lang string, label string", "doc_id long, quality int, toxic int"


def corpus(n=700):
    rng = random.Random(12)
    words = {lang: [*w.split(), *("".join(rng.choice("aeioulrstn") for _ in range(rng.randrange(3, 9))) for _ in range(800))] for lang, w in toxicity.FUNCTION_WORDS.items()}
    stems = {"en": ["scoundrel"], "de": ["grobian"], "fr": ["maraud"], "es": ["canalla"]}
    docs, labels = [], []
    for i in range(n):
        lang, good, toxic = rng.choice(list(words)), rng.random() < 0.7, rng.random() < 0.25
        text = [rng.choice(words[lang][:12] if rng.random() < 0.4 else words[lang]) for _ in range(rng.randrange(30, 120))]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(stems[lang]) + rng.choice(["", "ly", "ish", "ero", "en"])
        if not good:
            text = [w + rng.choice(["***", "%%%", "$$$"]) for w in text]
        docs.append((i, " ".join(text).capitalize() + ".", lang, "x"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    odd = [(9000, None, None, None), (9001, "", "en", ""), (9002, "  ", "en", ""), (None, "words here", "en", ""), (3, "again", "en", ""), (9003, "long words " * 20_000, "en", "")]
    more = [(9000, None, 1), (None, 1, 1), (3, None, None), (5, labels[5][1], labels[5][2])]
    return spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS), labels


def held(i, fold, rest):
    return zlib.crc32(str(i).encode()) % fold == rest


def test_quality_on_held_out_documents(frames):
    docs, labels, truth = frames
    forest = quality.train_quality(docs, labels)
    rows = quality.quality_scores(docs, forest).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows if r.doc_id != 3}
    hit = [(score[i] >= 0.5) == bool(q) for i, q, _ in truth if i != 3 and held(i, 3, 1)]
    assert np.mean(hit) > 0.97


def test_toxicity_on_held_out_documents(frames):
    docs, labels, truth = frames
    net = toxicity.train_toxicity(docs, labels)
    rows = toxicity.toxicity_scores(docs, net, carry=("lang",)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows if r.doc_id != 3}
    hit = [(score[i] >= 0.3) == bool(t) for i, _, t in truth if i != 3 and held(i, 4, 2)]
    assert np.mean(hit) > 0.95


def test_training_sees_only_its_fold_and_limit(frames):
    docs, labels, _ = frames
    got = quality.labelled_sample(docs, labels, "quality", 3, 1, 50).collect()
    assert len({r.doc_id for r in got}) == 50 and not any(held(r.doc_id, 3, 1) for r in got)


def test_without_labels_scores_are_the_prior(spark):
    docs, none = spark.createDataFrame([(1, "a b", "en", "")], DOCS), spark.createDataFrame([], LABELS)
    assert quality.quality_scores(docs, quality.train_quality(docs, none)).first().score == pytest.approx(0.5)
    assert toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, none)).first().score == pytest.approx(0.5)
    assert quality.quality_scores(docs.limit(0), quality.train_quality(docs, none)).count() == 0


def test_flattened_trees_equal_plain_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    f = quality.fit_forest(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10)

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            at = 0
            while f.left[t, at] != at:
                at = f.left[t, at] if row[f.feature[t, at]] <= f.threshold[t, at] else f.right[t, at]
            total += f.value[t, at]
        return total

    assert np.allclose(f.margin(x[:50]), [walk(r) for r in x[:50]])


@pytest.mark.parametrize("widths", [(1, 2, 3), (5,), (2, 7)])
def test_short_sequences_pool_alike(widths):
    rng = np.random.default_rng(1)
    net = toxicity.fit([], np.zeros(0), rows=2**16, widths=widths)
    net.out[:] = rng.normal(size=len(net.out))
    tables = net.project(np.concatenate([np.zeros((1, 8)), rng.normal(size=(2, 8))]))
    rows = rng.choice([0] * 9 + [1, 2], 300)
    assert net.reach == max(widths)
    assert net.margin(rows, tables) == pytest.approx(net.margin(toxicity._short(rows, net.reach), tables))


def test_every_word_enters_the_table():
    rng = np.random.default_rng(2)
    net = toxicity.fit([], np.zeros(0), rows=2**16)
    net.table[:] = rng.normal(size=net.table.shape)
    words = [b"a", b"seldom", "größe".encode(), b"x" * 40, b"trash"]
    got = net.embed(*toxicity.features_of(words))
    for w, e in zip(words, got):
        want = 0
        for h in toxicity.hashes_of(w):
            (a,), (b,) = toxicity.rows_of(np.array([h], np.uint32), len(net.table))
            want = want + toxicity.agreed(net.table[a], net.table[b])
        assert np.allclose(e, want) and e.any()
    back = pickle.loads(pickle.dumps(net))
    assert (back.embed(*toxicity.features_of(words)) == got).all() and (back.out == net.out).all()


def test_a_shared_row_alone_tells_nothing():
    net = toxicity.fit([], np.zeros(0), rows=2**16)
    (a,), (b,) = toxicity.rows_of(np.array(toxicity.hashes_of(b"cat"), np.uint32), 2**16)
    net.table[a] = 5.0
    assert not net.embed(*toxicity.features_of([b"cat"])).any()
    thin = toxicity.SparseRows(net.table)
    every = np.arange(2**16)
    assert thin.values.shape[0] == 2 and (thin[every] == net.table[every]).all()
    net.table[b] = 2.0
    assert (net.embed(*toxicity.features_of([b"cat"])) == 2.0).all()


def test_forgotten_words_score_alike():
    docs, labels = corpus(200)
    texts, y = [d[1] for d in docs], np.array([float(x[2]) for x in labels])
    net = toxicity.fit(texts, y, steps=40)
    once, often = toxicity.Scorer(net), toxicity.Scorer(net, limit=50)
    assert once.score(texts) == pytest.approx([often.score([t])[0] for t in texts])


def test_the_sample_is_bounded_in_bytes(frames, monkeypatch):
    docs, labels, _ = frames
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **how: seen.append(sum(len((t or "").encode()) for t in texts)))
    toxicity.train_toxicity(docs, labels, limit_bytes=9_000)
    assert 8_000 < seen[0] <= 9_000


def test_carried_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 2, "x", 3)], "doc_id long, text string, score int, _text string, `c0` int")
    none = spark.createDataFrame([], LABELS)
    for got in (quality.quality_scores(df, quality.train_quality(df, none), ("score", "_text", "c0", "text")), toxicity.toxicity_scores(df, toxicity.train_toxicity(df, none), ("score", "_text", "c0", "text"))):
        assert got.columns == ["doc_id", "score", "_text", "c0", "text", "score_"] and tuple(got.first())[:5] == (1, 2, "x", 3, "a b")
