from collections import Counter
from math import log2

import numpy as np
import pytest

from ledgerwind.llm import cross_entropy as ce
from ledgerwind.llm.word_tokens import default_path

DOCS = "doc_id long, text string, score string, target string"


def steps(x):
    return list(zip(x, x[1:], strict=False))


def model(size, texts):
    """The loss of a text, itself left out if it is one of the texts; all from counts of true pairs."""
    pairs, tokens, contexts = Counter(), Counter(), Counter()
    for x in texts:
        for a, b in steps(x):
            pairs[a, b] += 1
            tokens[b] += 1
            contexts[a] += 1
    n = sum(tokens.values())

    def loss(x, held):
        own = Counter(steps(x)) if held else Counter()
        own_tokens, own_contexts = Counter(), Counter()
        for (a, b), m in own.items():
            own_tokens[b] += m
            own_contexts[a] += m
        rest = n - sum(own.values())
        single = lambda b: (tokens[b] - own_tokens[b] + 0.5) / (rest + size / 2)
        return sum(-log2((pairs[a, b] - own[a, b] + 4 * single(b)) / (contexts[a] - own_contexts[a] + 4)) for a, b in steps(x)) / len(steps(x))

    return loss


def brute(library, rows, target):
    size = ce.vocabulary(default_path())
    texts = [[size - 2, *library.encode(t or "", add_special_tokens=False).ids, size - 1] for _, t, *_ in rows]
    own, back = model(size, [x for x, r in zip(texts, rows, strict=True) if r[0] in target]), model(size, texts)
    return [(r[0], len(x) - 1, own(x, r[0] in target), back(x, True)) for x, r in zip(texts, rows, strict=True)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_matches_brute_force(spark, library):
    rows = [(i, " ".join(f"{'abcdefgh'[(i * j) % 8]}{'xyz'[j % 3]}" for j in range(i % 17)), "", "") for i in range(60)]
    rows += [(100, None, "", ""), (101, "", "", ""), (None, "the same text", "", ""), (5, rows[5][1], "", ""), (102, "word " * 5000, "", "")]
    target = {3, 5, 8, 13, 21, 34, 100}
    ids = spark.createDataFrame([(x,) for x in [*target, 5, None, 9999]], "doc_id long")
    got = ce.score(spark.createDataFrame(rows, DOCS).repartition(3), ids, default_path()).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    for g, w in zip(sorted(got, key=lambda r: key(tuple(r))), sorted(brute(library, rows, target), key=key), strict=True):
        assert (g.doc_id, g.n_tokens) == w[:2]
        assert np.allclose([g.target_loss, g.background_loss, g.score], [w[2], w[3], w[2] - w[3]], rtol=1e-5, atol=1e-5)


def test_texts_like_the_target_score_lower(spark):
    rows = [(i, ("river stone water fish " if i % 2 else "stock price bond yield ") * 12 + f"n{i}", "", "") for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.score for r in ce.score(docs, docs.filter("doc_id < 30 and doc_id % 2 = 1"), default_path()).collect()}
    assert max(got[i] for i in range(41, 80, 2)) < min(got[i] for i in range(40, 80, 2))


def test_no_target_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    assert ce.score(docs, docs.limit(0), default_path()).first().target_loss > 10
    assert ce.score(docs.limit(0), docs, default_path()).count() == 0


def test_every_pair_has_a_count_of_its_own(spark, library):
    """Counts of true pairs over blocks of a few documents."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("ar", "en", "ist", "o", "ul", "ym")]
    rows = [(i, " ".join(rng.choice(words, 900)), "", "") for i in range(90)] + [(7, "common pair " * 300, "", ""), (None, None, "", "")]
    target = {1, 7, 30, 55}
    want = sorted((str(d), *rest) for d, *rest in brute(library, rows, target))
    docs, ids = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(x,) for x in target], "doc_id long")
    for block in (1, 5000, ce.BLOCK):
        got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in ce.score(docs, ids, default_path(), block).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-9, atol=1e-9)


def test_pairs_of_the_whole_vocabulary_are_told_apart():
    size = ce.vocabulary(default_path())
    before, after = np.random.default_rng(5).integers(0, size, (2, 300_000))
    assert len(np.unique(ce.slots(before, after))) == len(np.unique(before * size + after))


def test_documents_are_left_out_of_the_models_that_score_them(spark):
    """Of two equal documents each meets the other; alone, a document of new pairs has none of them."""
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words, 200)), "", "") for i in range(60)]
    rows.append((100, rows[5][1], "", ""))
    got = {r.doc_id: r.background_loss for r in ce.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1,), (5,)], "doc_id long"), default_path()).collect()}
    assert got[5] == got[100] and got[5] < min(v for d, v in got.items() if d not in (5, 100)) - 1
