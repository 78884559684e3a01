"""The two classifiers on held-out rows, and the parts they are made of."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, docs, empty, prose

from rillset.llm import quality, toxicity
from rillset.llm.labels import fitting_rows

BAD = ["wretch", "fiendish", "swinely", "knavery"]


def corpus(spark, n=240):
    rng, texts, toxic, good = random.Random(2), [], [], []
    for i in range(n):
        words, bad, junk = prose(rng, rng.randint(20, 120)).split(" "), i % 6 == 0, i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ",", "!"])
        if junk:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        toxic.append(int(bad))
        good.append(int(not junk))
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic))] + [(None, 1, 1), (10**7, None, None), (3, 9, 9)], "doc_id long, quality int, toxic int")
    return docs(spark, [*texts, *ODD_TEXTS]), labels, toxic, good


def right(rows, want, held):
    own = [(r.predicted, want[r.doc_id]) for r in rows if r.doc_id < len(want) and r.held_out == held]
    return sum(a == b for a, b in own) / len(own)


def test_toxicity(spark):
    table, labels, toxic, _ = corpus(spark)
    rows = toxicity.score_toxicity(table, labels).collect()
    assert len(rows) == 240 + len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert right(rows, toxic, True) > 0.95 and right(rows, toxic, False) > 0.95
    assert all(r.predicted == 0 for r in rows if r.doc_id >= 240)
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(table.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if not r.predicted}
    assert {r.score for r in toxicity.score_toxicity(table, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


@pytest.mark.parametrize("edited", [False, True])
def test_a_family_of_toxic_copies_counts_once(spark, edited):
    """A third of the labels are copies, or near copies, of one toxic text; its toxic words stay in the lexicon, its other words stay out."""
    table, labels, toxic, _ = corpus(spark)
    rng, copies = random.Random(5), 120
    words = prose(rng, 90).split(" ")
    own = "quaint" * 2
    words[10], words[30], words[50], words[70], words[5] = *BAD, own
    texts = []
    for _ in range(copies):
        one = list(words)
        if edited:
            one[80 + rng.randrange(10)] = prose(rng, 1) + "x"
        texts.append(" ".join(one))
    both = table.union(docs(spark, texts, 1000))
    more = labels.union(spark.createDataFrame([(1000 + i, 1, 1) for i in range(copies)], "doc_id long, quality int, toxic int"))
    chosen = fitting_rows(more, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, 30_000)
    terms, _ = toxicity.mine_terms(toxicity.labelled_texts(both, chosen))
    found = {w for w in BAD if any(t in terms for t in toxicity.terms_of(w))}
    assert found == set(BAD) and not any(t in terms for t in toxicity.terms_of(own))
    rows = toxicity.score_toxicity(both, more).collect()
    assert right(rows, toxic, True) > 0.95 and right(rows, toxic, False) > 0.95
    assert all(r.predicted for r in rows if r.doc_id >= 1000)


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.2
    own = [np.where(rng.random(len(y)) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.9, 0.8, 0.75, 0.7)]
    votes = np.column_stack([*own, np.where(rng.random(len(y)) < 0.95, own[3], -own[3])])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns.astype(np.int64), counts.astype(float), 0.3)
    assert [3, 4] in model.groups and abs(model.prior - 0.2) < 0.05
    assert ((model.posterior(votes.astype(np.int64)) > 0.5) == y).mean() > 0.9
    assert model.accuracies()[(0,)][1] > 0.8


def test_quality(spark):
    table, labels, _, good = corpus(spark)
    rows = quality.score_quality(table, labels).collect()
    assert len(rows) == 240 + len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert right(rows, good, True) > 0.95 and right(rows, good, False) > 0.95
    assert {r.score for r in quality.score_quality(table, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty(spark), labels).count() == 0


def test_repeated_ids_and_rows(spark):
    """Ids that repeat are fitted on once; repeated rows score alike; a null id is scored."""
    table, labels, *_ = corpus(spark)
    several = table.where("doc_id % 4 < 3").union(table.where("doc_id < 60")).union(table.where("doc_id = 1").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "fp", "score", "spans", "n_chars"))
    for score in (quality.score_quality, toxicity.score_toxicity):
        rows = score(several, labels).collect()
        seen = {}
        for r in rows:
            seen.setdefault(r.doc_id, set()).add(round(r.score, 9))
        assert len(rows) == several.count() and None in seen and all(len(x) == 1 for x in seen.values())
        assert not any(r.held_out for r in rows if r.doc_id is None)
    model = quality.fit_quality(table.union(table).union(table), labels)
    once = quality.fit_quality(table, labels)
    texts = pa.array(["some text here", "X!! Y!!", ""])
    assert np.allclose(model.score(quality.statistics(texts)), once.score(quality.statistics(texts)))


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(300, 3)) * 2 + 1])
    y = np.repeat([0, 1], [200, 300])
    model = quality.QuadraticDiscriminant(x, y)
    z = (x - model.center) / model.scale
    want = []
    for mean, factor, _ in model.fits:
        cov = np.linalg.inv(factor @ factor.T)
        d = z - mean
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), np.clip((want[1] - want[0]) / 3, -30, 30))


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([t or "" for t in ODD_TEXTS]))
    assert x.shape == (len(ODD_TEXTS), len(quality.STATISTICS)) and np.isfinite(x).all()


def test_fitting_rows_are_bounded_and_keep_out_the_held_out(spark):
    import zlib

    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = fitting_rows(labels, "quality", 4, 2, 30).collect()
    assert len(rows) == 30 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
