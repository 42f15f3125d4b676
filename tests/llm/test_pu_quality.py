import random
import zlib

import numpy as np

from ledgerwind.llm import pu_quality as pu

DOCS = "doc_id long, text string, score string, held_out string"


def make(n=900):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 120))]
        bad = rng.random() < 0.2
        if bad:
            words = [[w.upper() + "!!" for w in words], [w + "***" for w in words], words[:2] * 30, [x for w in words for x in (w, "|")]][i % 4]
        rows.append((i, " ".join(words), "clash", "clash"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = make()
    edge = [(5000, None, "", ""), (5001, "", "", ""), (5002, " \n", "", ""), (None, "plain words here", "", ""), (7, rows[7][1], "", ""), (5003, "word " * 50_000, "", ""), (5004, "é\x00\x85 Ü", "", "")]
    labels += [(1, 0, 0), (None, 1, 0), (99999, 1, 0), (5000, None, 1), (5001, 7, 0)]
    docs, known = spark.createDataFrame(rows + edge, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = pu.score(docs, known).collect()
    assert len(got) == len(rows + edge)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None) and not by[None].held_out
    assert by[5000].score == by[5001].score == by[5002].score
    tested = [(by[d].predicted, q) for d, q, _ in labels if d in by and by[d].held_out and q in (0, 1)]
    assert len(tested) > 50 and np.mean([p == q for p, q in tested]) > 0.95
    kept = pu.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = make(300)
    docs = spark.createDataFrame(rows, DOCS)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    one, two = (pu.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights) and one.prior == two.prior


def test_risk_never_goes_below_zero_and_prior_matters():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, (400, 3)), np.vstack([rng.normal(2, 1, (300, 3)), rng.normal(-2, 1, (300, 3))])
    scores = pu.fit_arrays(p, u, 0.5).scores(u)
    assert scores[:300].mean() > 0.9 and scores[300:].mean() < 0.1
    assert pu.fit_arrays(p, u, 0.9).scores(u).mean() > scores.mean()


def test_prior_is_estimated_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.85):
        n = int(4000 * share)
        p, u = rng.normal(1.5, 1, (2000, 4)), np.vstack([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (4000 - n, 4))])
        model = pu.fit_arrays(p, u)
        assert abs(model.prior - share) < 0.06
        assert (model.scores(u)[:n] > 0.5).mean() > 0.95 and (model.scores(u)[n:] < 0.5).mean() > 0.9


def test_sums_over_parts_are_those_in_memory(spark):
    rows, labels = make(400)
    docs, known = spark.createDataFrame(rows, DOCS).repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    good = {d for d, q, _ in labels if q == 1}
    matrix = lambda some: np.array([pu.features(r[1].encode()) for r in some], np.float64)
    want, got = pu.fit_arrays(matrix([r for r in taught if r[0] in good]), matrix(taught)), pu.fit(docs, known)
    assert np.allclose(got.weights, want.weights, atol=1e-6) and np.isclose(got.prior, want.prior)


def test_no_labels_and_no_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b", "", "")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pu.score(docs, none).first().score < 0.7
    assert pu.score(docs.limit(0), none).count() == 0
