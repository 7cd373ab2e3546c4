"""The corpus pipeline, stage by stage, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from panelweave.llm import mixing
from test_llm_operators import WORD, gone_brute, jaccard_groups, toxic_corpus

COLUMNS = corpus_pipeline.COLUMNS
KINDS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    docs, labels = toxic_corpus(240)
    passage = " ".join(rng.choice(["calm", "river", "stone", "light", "morning", "garden"]) for _ in range(60))
    rows = [(i, t, "en", rng.choice(["a", "a", "b", "c", None])) for i, t, *_ in docs]
    for i in range(300, 330):
        own = rows[i - 300][1].split()
        if i % 2:
            own[3] = "changed"
        rows.append((i, " ".join(own * 2), "en", "a"))
        rows.append((i + 100, " ".join(own * 2 + ["tail"]), "en", "b"))
        rows.append((i + 200, f"start{i} " + passage + f" end{i} " + rows[i - 300][1], "en", "c"))
    rows += [(900, None, None, None), (901, "", "en", "b"), (902, "\n", "en", "c"), (903, "é" * 90 + "ñ" * 200, "en", "a"), (904, "ñ" * 200, "en", "a"),
             (None, "no id here", "en", "a"), (905, "same row twice, kept once", "en", "a"), (905, "same row twice, kept once", "en", "a")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 5, "x") for i, t, l, s in rows], KINDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    return path


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash", "suffix", "mixing", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = collected(docs)
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(collected(docs), docs.schema).cache()
        held[name] = (before, collected(docs))

    before, after = held["toxicity"]
    bad = {"scoundrel", "villain", "scoundrels"}
    ids = {r["doc_id"] for r in after}
    wrong = [r for r in before if (r["doc_id"] in ids) == bool(bad & set((r["text"] or "").split()))]
    assert len(wrong) <= 3 and None in ids

    before, after = held["minhash"]
    want = jaccard_groups([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    stay = Counter(i for i, (_, c) in want.items() if c == i) + Counter([None])
    assert Counter(r["doc_id"] for r in after) == stay

    before, after = held["suffix"]
    gone = gone_brute([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    cut = 0
    for old in before:
        new = next(r for r in after if r["doc_id"] == old["doc_id"])
        if old["text"] is None:
            assert new["text"] is None
        elif old["doc_id"] is None or not gone[old["doc_id"]][1]:
            assert new["text"] == old["text"]
        else:
            cut += 1
            assert len(new["text"].encode()) >= gone[old["doc_id"]][0] - gone[old["doc_id"]][1]
            if old["text"].isascii():
                assert hashlib.sha256(new["text"].encode()).hexdigest() == gone[old["doc_id"]][3]
        assert new["n_chars"] == (None if new["text"] is None else len(new["text"]))
    assert cut >= 3

    before, after = held["mixing"]
    sizes, taken = Counter(), Counter()
    copies = Counter(r["doc_id"] for r in after)
    for r in before:
        size = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += size
        taken[r["source"]] += size * copies[r["doc_id"]]
        assert copies[r["doc_id"]] <= 3
    targets = {r["source"]: r["target"] for r in collected(mixing.source_targets(
        spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")))}
    assert all(abs(taken[s] - targets[s]) <= 250 for s in sizes)

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    out = collected(stages["bpe"](spark, docs, folder))
    assert len(out) == len(after)
    for r in out:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["ids_sha256"])
    assert sorted(map(key, collected(corpus_pipeline.run(spark, folder)))) == sorted(map(key, collected(docs)))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
