"""The stages one after the other, against what each should leave."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomspark.llm import quality, shared  # noqa: E402
from tests.llm.test_dedup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = shared.store(stage(spark, docs, SF), f"test-{k}")
        if k == 4:
            break
        assert out.columns == COLUMNS
        after = {r.doc_id: r.text for r in out.collect()}
        assert all(before[i] == t for i, t in after.items())
        gone = {i: t for i, t in before.items() if i not in after}
        if k == 0:
            good = {r.doc_id for r in quality.ledger(docs).where(f"(bits & {quality.POLICIES[quality.POLICY]}) = 0").collect()}
            assert set(after) == good
        if k == 2:
            assert len(set(after.values())) == len(after) and set(gone.values()) <= set(after.values())
        if k == 3:
            pairs = brute(list(before.items()), 0.5)
            assert not [p for p in pairs if p[0] in after and p[1] in after]
            assert all(any(i in p for p in pairs) for i in gone)
        docs, before = out, after
    packed = {d for r in out.collect() for d in r.doc_ids}
    assert packed == set(before)


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u2")) for r in rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", None, None, 0), (1, "", None, None, 0)]])
def test_small_and_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_long_clean_text_is_kept(spark):
    """Words drawn from a long-tailed vocabulary as in natural text: 60,000 and 600,000 of them fall below 35 % distinct, no stretch of them does; a loop of few words stays out at any length."""
    rng = np.random.default_rng(0)
    drawn = lambda n: " ".join(f"word{int(x)}" for x in rng.zipf(1.15, n) % 200_000)
    texts = {1: drawn(900), 2: drawn(60_000), 3: drawn(600_000), 4: "one two three four five " * 50, 5: "one two three four five " * 120_000}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {i for i, t in texts.items() if len(set(t.split())) < 0.35 * len(t.split())} == {2, 3, 4, 5}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, "").select("doc_id").collect()} == {1, 2, 3}
