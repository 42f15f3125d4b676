import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerwind.llm import simhash_golay as sg
from ledgerwind.llm.components import components


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return "0" * 16
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)):016x}"


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_golay_code_is_perfect_and_near_words_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    code = sg.codeword(words)
    for flips in range(3):
        other = words.copy()
        for row in range(len(words)):
            for bit in rng.choice(23, flips, replace=False):
                other[row] ^= 1 << bit
        (ra, a), (rb, b) = sg.indices(words), sg.indices(other)
        for row in range(len(words)):
            assert set(a[ra == row]) & set(b[rb == row])
            assert flips == 2 or code[row] in b[rb == row]
    assert set(np.bincount(sg.indices(words)[0])) <= {1, 6}


def test_prints_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63, 400)
    b = a.copy()
    for row in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[row] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    (ra, ka), (rb, kb) = sg.golay_keys(a), sg.golay_keys(b)
    for row in range(len(a)):
        assert set(ka[ra == row]) & set(kb[rb == row])


TEXTS = [None, "", " \n\t", "one", "One  Two\x0bthree four five", "one two three four five", "é É a b", "x " * 5000, "X " * 5000, "İ b c"]


def test_fingerprints_match_plain_python(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", "clash"), (None, "one", "clash"), (None, "nobody else", "clash")]
    got = sg.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in enumerate(TEXTS):
        assert by[i]["fingerprint"] == brute_print(t)
    ids = [i for i, _ in enumerate(TEXTS)]
    want = brute_components([int(brute_print(TEXTS[i]), 16) for i in ids])
    assert [by[i]["component_id"] for i in ids] == want
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["3", "None"]


@pytest.mark.parametrize("crowd", [5, 100_000])
def test_components_match_brute_force(spark, crowd):
    rng = np.random.default_rng(3)
    prints = []
    for _ in range(12):
        p = int(rng.integers(0, 2**63))
        for _ in range(12):
            prints.append(p)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                p ^= 1 << int(bit)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long").groupBy("fp").agg(F.min("node").alias("node"))
    labels = {r["node"]: r["component"] for r in components(sg.link_fingerprints(nodes, crowd)).collect()}
    want = brute_components(prints)
    for r in nodes.collect():
        assert labels.get(r["node"], r["node"]) == want[r["node"]]


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert sg.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(5, "a b c d e f", "en"), (4, "a b c d e f", "en"), (4, "a b c d e f", "en"), (9, "quite another text here", "en"), (None, "a b c d e f", "en")], empty.schema)
    assert sorted((r["doc_id"] or 0) for r in sg.keep_one(docs).collect()) == [0, 4, 9]


def test_keep_one_keeps_different_texts_of_one_id(spark):
    one, two = "a text of one kind " * 9, "some other words about nothing much " * 7
    rows = [(1, one, "x"), (1, two, "x"), (1, one, "x"), (2, one, "y"), (3, "a third text that stands alone here", "z"), (None, one, "n")]
    got = sg.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, one), (1, two), (3, rows[4][1]), (0, one)])
