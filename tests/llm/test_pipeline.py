"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from helixframe.session import materialise
from tests.llm.test_operators import brute_components, brute_stats, counted, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]


def test_stages(spark):
    from tokenizers import Tokenizer

    from helixframe.llm.pieces import default_path
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(materialise(stage(spark, seen[-1], SF), f"test-stage-{i}"))
    assert all(d.columns == columns for d in seen[:-1])
    rows = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in seen[:-1]]
    failed = {i for i, t in rows[0] if (s := brute_stats(t))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert {i for i, _ in rows[1]} == {i for i, _ in rows[0]} - failed  # no line is frequent enough here
    assert {i for i, _ in rows[2]} == {i for i, _, c in brute_components(rows[1], 5, 80) if i == c}
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, t in rows[2] if any(q and len(q & shingles(t, 5)) >= 0.8 * len(q) for q in items)}
    assert bad and {i for i, _ in rows[3]} == {i for i, _ in rows[2]} - bad
    before = counted(rows[3])
    assert all(n <= 2 * before[r] and r in before for r, n in counted(rows[4]).items())
    encoder = Tokenizer.from_file(default_path())
    want = []
    for i, t in rows[4]:
        ids = np.array([*encoder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in seen[-1].collect()) == counted(want)


def test_near_copies_at_the_pipeline_s_threshold(spark):
    """A pair of similarity 0.82 in five-word shingles is one document for the pipeline, two for the query's contract."""
    base = [f"w{i}" for i in range(204)]
    other = base.copy()
    other[5:21] = [f"x{i}" for i in range(16)]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(f"y{i}" for i in range(50)))]
    a, b = (shingles(t, 5) for _, t in rows[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, df, SF).collect()) == [1, 3]


def test_template_pages_lose_their_lines(spark):
    """A line that a hundred pages of one host share goes; pages that differ in a number only are all template and go as a whole."""
    body = " ".join(f"word{k}" for k in range(30))
    letters = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    for own, kept in (("page called {w}", True), ("page number {i}", False)):
        rows = [(i, f"all rights reserved by the same owner\n{body} " + own.format(i=i, w=letters(i)), "en", "host", 9) for i in range(100, 200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        out = corpus_pipeline.keep_quality(spark, docs, SF).collect()
        assert len(out) == (100 if kept else 0) and not any("rights" in r.text for r in out) and all(r.n_chars == len(r.text) for r in out)


def test_empty_table_and_odd_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, _lost string, version string, copies int"
    empty = spark.createDataFrame([], schema)
    few = spark.createDataFrame([(1, None, None, None, None, "k", 1, "l", "v", 2), (2, "word " * 40 + "end", "en", "s", 7, "k", 1, "l", "v", 2),
                                 (2, "word " * 40 + "end", "en", "s", 7, "k", 1, "l", "v", 2), (None, " ".join(f"w{i}" for i in range(60)), "en", "s", 7, "k", 1, "l", "v", 2)], schema)
    for docs in (empty, few):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = materialise(stage(spark, docs, SF), f"odd-stage-{i}")
            assert i == 4 or docs.columns == columns
    assert {r.doc_id for r in docs.collect()} <= {None}
