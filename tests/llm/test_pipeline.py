"""The pipeline's stages on a small corpus with planted cases, each against a plain version of its rule."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from leafwork.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=4000):
    r = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in r.integers(0, words, n))


ITEM = prose(900, 40, 90_000)
LINES = "\n".join(prose(950 + i, 8) for i in range(3))


def corpus():
    out = {}
    for i in range(400):
        w = prose(i, 60, 400).split()
        if i % 4 == 0:
            w[7] = ["scumbag", "vequxyz", "vequabc"][i % 3]
        out[i] = " ".join(w)
    near = prose(801, 90).split()
    out |= {1000: " ".join(near), 1001: " ".join(near[:88] + ["x", "y"]), 1002: " ".join(near[:40] + prose(802, 50).split())}
    out |= {1010: prose(803, 60) + " " + ITEM + " " + prose(804, 30), 1011: prose(805, 30)}
    out |= {1020: "first\n" + LINES + "\nlast one", 1021: LINES + "\nother end of " + prose(806, 20), 1022: LINES, 1030: "", 1031: None}
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in corpus().items()]
    spark.createDataFrame(rows + [(1011, rows[[r[0] for r in rows].index(1011)][1], None, "s", 5)], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    docs, stages = spark.read.parquet(f"{tables}/documents.parquet"), dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    clean = stages["toxicity"](spark, docs, tables)
    assert clean.columns == docs.columns
    test = {i for i in range(400) if zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.FOLD}
    kept = set(ids(clean))
    assert np.mean([(i in kept) == (i % 4 != 0) for i in test]) > 0.95 and set(range(1000, 1032)) & set(corpus()) <= kept
    cut = stages["line_dedup"](spark, docs, tables)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1020] == corpus()[1020] and texts[1021] == corpus()[1021].split("\n", 3)[3] and 1022 not in texts and texts[1030] == "" and texts[1031] is None
    assert ids(stages["near_dedup"](spark, docs, tables)) == sorted(set(corpus()) - {1001, 1022})
    assert ids(stages["decontamination"](spark, docs, tables)) == sorted([*(set(corpus()) - {1010}), 1011])
    empty = docs.limit(0)
    for name in ("line_dedup", "near_dedup", "decontamination", "packing", "toxicity"):
        assert stages[name](spark, empty, tables).count() == 0


def test_run_keeps_what_all_stages_keep(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
    left = [r.doc_id for r in docs.collect()]
    assert sorted(r.doc_id for r in got) == sorted(left) and not {1001, 1010, 1022} & set(left) and {1000, 1002, 1011, 1020, 1021, 1030, 1031} <= set(left)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
