"""The corpus pipeline, stage by stage, against what its stages promise and against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corduroy.llm import common, decontaminate, near, quality
from test_operators import brute_groups, plain_pseudonym, prose

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = common.table(spark, DATA, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    kept = {}
    for name, stage in cp.STAGES:
        out = common.materialize(stage(spark, docs, DATA), common.scratch(spark, f"p-{name}"))
        if name == "quality":
            model = quality.quality_model(docs, common.table(spark, DATA, "labels"))
            assert kept_ids(out) == kept_ids(quality.score_quality(docs, model).where(f"score >= {quality.THRESHOLD}"))
        if name == "near_duplicates":
            assert kept_ids(out) == kept_ids(near.near_groups(docs, common.scratch(spark, "p5")).where("kept"))
        if name == "decontamination":
            found = decontaminate.contaminated(docs, common.table(spark, DATA, "benchmark"), common.scratch(spark, "p1"))
            assert kept_ids(out) == kept_ids(docs) - kept_ids(found)
        if name != "sentencepiece":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs, kept[name] = out, out.count()
    assert kept["pii"] == kept["decontamination"] == kept["sentencepiece"] <= kept["near_duplicates"] <= kept["quality"]


def kept_ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def folder(tmp_path, spark, texts, labels, items):
    """A folder of tables; documents have columns named like what the stages use inside."""
    rows = [(i, t, "en", "s", 0 if t is None else len(t), 1.5, True, "x", 3) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id string, __score__ long"
    spark.createDataFrame(rows, names).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


ITEM = "Alice has 12 apples and gives 5 of them to her friend Bob who lives 3 km away, so how many apples does Alice keep?"


def test_stages_equal_plain_versions_on_odd_rows(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    rng = random.Random(12)
    base = prose(rng, 80).split()
    texts = [None, "", "  ", "one", "tied text of five words", "tied text of five words", "long " * 20000]
    for _ in range(12):
        w = list(base)
        w[rng.randrange(80)] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 40) + " " + ITEM, prose(rng, 40) + " me@mail.example.org said so on 2001-05-06", *(prose(rng, 50) for _ in range(10))]
    where = folder(tmp_path, spark, texts, [], [(1, ITEM), (2, None)])
    docs = common.table(spark, where, "documents")
    stages = dict(cp.STAGES)
    out = stages["quality"](spark, docs, where)
    assert out.columns == docs.columns and kept_ids(out) == set(range(len(texts)))  # without labels the score is 0.5
    out = common.materialize(stages["near_duplicates"](spark, out, where), common.scratch(spark, "pn"))
    assert kept_ids(out) == {i for i, _, _, kept in brute_groups(texts, 5, 80) if kept}
    out = common.materialize(stages["decontamination"](spark, out, where), common.scratch(spark, "pd"))
    assert {i for i in kept_ids(docs) - kept_ids(out) if ITEM in (texts[i] or "")} == {19}
    out = common.materialize(stages["pii"](spark, out, where), common.scratch(spark, "pp"))
    want = {i: texts[i] for i in kept_ids(out)}
    for value in ("me@mail.example.org", "2001-05-06"):
        want[20] = want[20].replace(value, plain_pseudonym(value, cp.KEY))
    assert {r.doc_id: r.text for r in out.collect()} == want and out.columns == docs.columns
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["sentencepiece"](spark, out, where).collect():
        ids = lib.encode(want[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_quality_stage_equals_scores_of_single_texts(spark, tmp_path):
    rng = random.Random(13)
    texts = [prose(rng, 60) for _ in range(60)] + ["".join(rng.choice("#$%&/()=?") for _ in range(300)) for _ in range(60)] + [None, ""]
    labels = [(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)]
    where = folder(tmp_path, spark, texts, labels, [(1, ITEM)])
    docs = common.table(spark, where, "documents")
    model = quality.quality_model(docs, common.table(spark, where, "labels"))
    want = {i for i, t in enumerate(texts) if quality.score_texts(model, [(t or "").encode()])[0] >= quality.THRESHOLD}
    assert kept_ids(cp.quality(spark, docs, where)) == want and len(want & set(range(60))) > 50 > 10 > len(want & set(range(60, 120)))


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_stages_of_empty_tables(spark, tmp_path, empty):
    texts = [] if empty == "documents" else [f"text number {i} of some" for i in range(4)]
    where = folder(tmp_path, spark, texts, [] if empty == "labels" else [(0, 1, 0), (1, 0, 0)], [] if empty == "benchmark" else [(1, ITEM)])
    docs = common.table(spark, where, "documents")
    for name, stage in cp.STAGES:
        docs = common.materialize(stage(spark, docs, where), common.scratch(spark, f"pe-{name}"))
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert docs.where(F.col("doc_id").isNull()).count() == 0 and docs.count() <= len(texts)
