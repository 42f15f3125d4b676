import hashlib
from collections import Counter

import duckdb
import pytest

from ledgerwind.llm import catalog
from ledgerwind.llm import histogram_sort as hs

SCHEMA = "doc_id long, text string, shard string, _range int, extra array<int>"


def key(value):
    return int(hashlib.md5(value.encode()).hexdigest()[:15], 16)


def brute(rows, shards, snap):
    """Bytes and ids by shard: every document sorted in memory, each splitter looked for among all edges."""
    docs = sorted((key(t or ""), key(str(i) if i is not None else ""), len((t or "").encode()) + 8, i) for i, t, *_ in rows)
    total, edges, ends, at = sum(d[2] for d in docs), [0], {0}, 0
    for n, d in enumerate(docs):
        at += d[2]
        edges.append(at)
        if n + 1 == len(docs) or docs[n + 1][0] != d[0]:
            ends.add(at)
    splitters = []
    for i in range(1, shards):
        near = lambda some, i=i: min(some, key=lambda e: (abs(e * shards - i * total), -e))
        group = near(ends)
        splitters.append(group if snap * abs(group * shards - i * total) <= total else near(edges))
    out, at = [[] for _ in range(shards)], 0
    for d in docs:
        out[sum(s <= at for s in splitters)].append((d[3], d[2]))
        at += d[2]
    return out


def check(spark, rows, shards, snap=hs.SNAP):
    df = spark.createDataFrame(rows, SCHEMA)
    got = hs.deal(df, shards, snap)
    assert got.columns == ["doc_id", "text", "_range", "extra", "shard", "slot"]
    found = got.collect()
    assert Counter((r["doc_id"], r["text"], r["_range"]) for r in found) == Counter((r[0], r[1], r[3]) for r in rows)
    by = [sorted((r for r in found if r["shard"] == s), key=lambda r: r["slot"]) for s in range(shards)]
    assert all([r["slot"] for r in own] == list(range(len(own))) for own in by)
    order = lambda some: sorted(some, key=lambda x: (x[0] is None, x))
    assert [order((r["doc_id"], len((r["text"] or "").encode()) + 8) for r in own) for own in by] == [order(own) for own in brute(rows, shards, snap)]
    return by


@pytest.fixture(scope="module")
def rows():
    texts = [f"text {i} " + "wörd " * (i * 7919 % 97) for i in range(600)]
    own = [(i, t, "x", i % 3, [i]) for i, t in enumerate(texts)]
    own += [(1000 + i, "copy " * 30, "x", 1, None) for i in range(500)]  # a third of all bytes
    own += [(2000 + i, texts[i], "x", 1, None) for i in range(0, 200, 3)]
    own += [(3000, "", None, None, None), (3001, None, None, None, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    own += [(3002, "long " * 4000, "x", 1, None)]
    return own


@pytest.mark.parametrize(("shards", "snap", "piece", "probes"), [(24, 200, 1 << 28, 1 << 14), (5, 200, 3000, 16), (7, 10**9, 1 << 28, 2)])
def test_shards_match_brute_force(spark, monkeypatch, rows, shards, snap, piece, probes):
    monkeypatch.setattr(hs, "PIECE_BYTES", piece)
    monkeypatch.setattr(hs, "PROBES", probes)
    by = check(spark, rows, shards, snap)
    sizes = [sum(hs.OVERHEAD + len((r["text"] or "").encode()) for r in own) for own in by]
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= 2 * mean / snap + 20008  # the longest document


def test_equal_texts_stay_together_where_that_is_near(spark, rows):
    by = check(spark, [r for r in rows if r[0] is None or not 1000 <= r[0] < 2000], 4, snap=20)
    at = {}
    for s, own in enumerate(by):
        for r in own:
            at.setdefault(r["text"] or "", set()).add(s)
    assert all(len(x) == 1 for x in at.values())


def test_one_row_repeated_is_parted(spark):
    by = check(spark, [(7, "same text", "x", 1, [1])] * 1000, 3)
    assert [len(own) for own in by] == [333, 334, 333]


def test_few_rows_and_none(spark):
    by = check(spark, [(i, "abc", "x", 1, None) for i in range(3)], 24)
    assert sorted(len(own) for own in by) == [0] * 21 + [1] * 3
    assert hs.deal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_beyond_the_broadcast_are_joined(spark, monkeypatch, rows):
    monkeypatch.setattr(hs, "BROADCAST_RANGES", 0)
    check(spark, rows, 5)


def test_query_matches_sql_and_runs_no_python(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(catalog.OP12_SQL)
    names = [c[0] for c in want.description]
    got = catalog.op12_histogram_sort(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())
    assert "Python" not in got._jdf.queryExecution().toString()
