import re
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from ledgerwind.llm import host_rules, pii_bootstrap, pu_quality
from ledgerwind.llm.shared import written
from ledgerwind.llm.word_tokens import default_path
from tests.llm.test_host_rules import brute as brute_rules
from tests.llm.test_pii import base
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage: sf0.001's documents, edge rows and copies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    extra = [(900_000 + i, t, "en", None, None) for i, t in enumerate([None, "", " ", "few words", *[r[1] + " end" for r in rows[:30]]])]
    extra += rows[:5] + [(None, rows[7][1], "en", "src1", 5)]
    frame = spark.createDataFrame(rows + extra, docs.schema).repartition(3)
    out = [frame]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return [f.collect() for f in out], [f.columns for f in out]


def test_columns_stay_until_packing(stages):
    _, columns = stages
    assert columns[0] == columns[1] == columns[2] == columns[3] == columns[4]


def test_each_stage_does_its_work_on_its_own_input(spark, stages):
    (start, ruled, good, single, clean, packed), _ = stages
    verdicts = [w[-1] for w in brute_rules([(r.doc_id, r.text, r.source) for r in start])]
    assert sorted(map(str, ruled)) == sorted(str(r) for r, keep in zip(start, verdicts, strict=True) if keep)
    assert 0 < len(good) <= len(ruled) and {str(r) for r in good} <= {str(r) for r in ruled}
    model = pu_quality.fit(spark.createDataFrame(ruled, spark.read.parquet(f"{SF}/documents.parquet").schema), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(np.array([pu_quality.features(r.text.encode()) for r in ruled], np.float64))
    assert sorted(map(str, good)) == sorted(str(r) for r, s in zip(ruled, scores, strict=True) if s >= pu_quality.THRESHOLD)
    known = sorted((r for r in good if r.doc_id is not None), key=lambda r: r.doc_id)
    label = brute_components([int(brute_print(r.text), 16) for r in known])
    firsts = {known[i].doc_id for i in label}
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(firsts)
    assert [r.doc_id for r in single].count(None) == [r.doc_id for r in good].count(None)
    assert sorted(map(str, (r.doc_id for r in clean))) == sorted(map(str, (r.doc_id for r in single)))
    before = {r.doc_id: r.text for r in single}
    for r in clean:
        assert r.n_chars == len(r.text)
        assert not base(before[r.doc_id]) or r.text != before[r.doc_id]
        assert not base(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "\x00", r.text))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in clean}
    got = {}
    for p in sorted(packed, key=lambda p: p.start):
        assert crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        got.setdefault(p.doc_id, []).extend(p.ids)
    assert got == ids
    lengths = {}
    for p in packed:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    assert all(n == 4096 for s, n in lengths.items() if s < max(lengths))


def test_run_applies_the_stages(spark):
    assert host_rules.LEAST_WORDS == 50 and set(pii_bootstrap.KINDS) == {"email", "ip", "card", "phone"}
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
