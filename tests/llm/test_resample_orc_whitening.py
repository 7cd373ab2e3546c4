"""Importance resampling, ORC token files and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelweave.llm import resample, token_orc, whitening
from panelweave.session import scratch_path
from pyspark.sql import functions as F
from test_llm_operators import odd_rows, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CLASH = "doc_id long, text string, score double, rank string, weight string, n_tokens string, ids string"
VOCABULARY = "word_bpe_49k.json"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r", "w", "n", "i") for i, t, *_ in rows], CLASH)


# Importance resampling

def features(text, n):
    found = PATTERN.findall((text or "").translate(LOWER))
    return len(found), [" ".join(found[i:i + k]) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def drawn(docs, target, n, buckets, min_words, percent):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = (Counter(place(f) for _, t in rows for f in features(t, n)[1]) for rows in (docs, target))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    out = []
    for i, t in docs:
        n_words, found = features(t, n)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in map(place, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    line = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(line[:percent * len(line) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


def texts(seed, n):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma9", "élan", "ΣΑΣ", "delta", "x" * 60, "ÀB", "z"]
    return [(i, "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "\x00", "-", "\x85", "  "]) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("ngrams,head,pairs", [(1, 5, 0), (1, 0, 0), (2, 4, 3), (3, 100, 100)])
def test_resample_equals_brute_force(spark, ngrams, head, pairs):
    docs = texts(1, 150) + [(i, t) for i, t, *_ in odd_rows() if i != 10 or t] + [(7000, None), (7001, "")]
    docs = [(i, t) for i, t in docs if i != 10]  # ids that differ, so that ranks are defined
    docs = list({i: (i, t) for i, t in docs}.values())
    target = texts(2, 12) + [(0, None), (1, "")]
    got = resample.resample(documents(spark, docs).repartition(5), documents(spark, target), ngrams=ngrams, buckets=500,
                            percent=30, head=head, pairs=pairs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == drawn(docs, target, ngrams, 500, 20, 30)


def test_resample_repeated_rows_and_empty_tables(spark):
    prose = " ".join(f"word{i % 7}" for i in range(40))
    docs = documents(spark, [(5, prose)] * 6 + [(None, prose)] * 3 + [(6, prose + " more")])
    got = rows_of(resample.resample(docs, documents(spark, []), percent=50))
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(got) == 10
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    none = documents(spark, [])
    assert resample.resample(none, docs).count() == 0 and resample.resample(none, none).count() == 0
    kept = resample.resample(docs.withColumn("own", F.lit(3)), docs, keep=("own", "score"))
    assert kept.columns == ["doc_id", "own", "n_features", "weight", "score", "rank"]


def test_head_is_the_most_frequent(spark):
    rows = documents(spark, [(i, "the cat the dog " * 3 + f"only{i}") for i in range(20)]).select("text")
    head = resample.head_of(rows, 2, head=3, pairs=3)
    assert set(head.state) == {b"the", b"cat", b"dog"} and set(head.pair) == {(b"the", b"cat"), (b"cat", b"the"), (b"the", b"dog")}
    # steps of frequency enter whole, or not at all
    assert set(resample.head_of(rows, 1, head=2).state) == {b"the"} and not resample.head_of(rows, 1, head=0).state
    assert head.pair[b"the", b"cat"] == zlib.crc32(b"the cat") and head.values([b"the", b"new"], 2)[-1] == zlib.crc32(b"the new")


# Token files

TRICKY = ["", " ", "Hello, World!! it's o'clock", "a\tb\x1cc　d", "<|endoftext|> x<|startoftext|>.", "<|EndOfText|>", "W̊ẘ café café",
          "İstanbul ẞ straße ÀÉÎ", "ΣΣ αΣ Жук 你好", "x" * 5000, "1234 a1b2 ...", "don't!!! 'tis ''s", "퟿\U0001f600\U0001f600"]


def tokens_of(text, path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [VOCABULARY, "byte_bpe_50k.json"])
def test_orc_round_trip(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(100 + i, t) for i, t in enumerate(TRICKY)] + [(300, "same row")] * 5
    folder = scratch_path(spark, "test-orc")
    token_orc.write(documents(spark, rows).repartition(3), path, folder)
    stored = rows_of(token_orc.read(spark, folder))
    want = Counter((i, tuple(tokens_of(t, path) + [2])) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stored) == want
    # positions follow from ascending ids without gaps
    line = sorted(stored, key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in line]
    assert keys == sorted(keys)
    at = 0
    for r in line:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    for r in rows_of(token_orc.digests(token_orc.read(spark, folder))):
        ids = next(x["ids"] for x in stored if x["start"] == r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter(r["doc_id"] for r in rows_of(token_orc.lookup(spark, folder, [4, 300, 9999]))) == {4: 1, 300: 5}


def test_orc_files_hold_indexes_and_filters(spark, tmp_path):
    rows = documents(spark, [(2 * i, f"document number {i} " * 40) for i in range(3000)])
    folder = f"{tmp_path}/orc"
    token_orc.write(rows, public_tokenizers.path(VOCABULARY), folder, stripe_bytes=16 << 10)
    jvm = spark._jvm
    names = sorted(p.name for p in (tmp_path / "orc").glob("*.orc"))
    last, stripes = -1, 0
    for name in names:
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration())
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), options)
        assert reader.getRowIndexStride() == 1000
        stripes += reader.getStripes().size()
        inner = reader.rows()
        kinds = {s.getKind().toString() for i in range(reader.getStripes().size()) for s in inner.readStripeFooter(reader.getStripes().get(i)).getStreamsList()}
        assert "ROW_INDEX" in kinds and any("BLOOM_FILTER" in k for k in kinds)
        inner.close()
        ids = [r[0] for r in spark.read.orc(f"{folder}/{name}").select("doc_id").collect()]
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    assert stripes > len(names)
    plan = token_orc.lookup(spark, folder, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_orc_without_rows(spark):
    folder = scratch_path(spark, "test-orc-none")
    token_orc.write(documents(spark, []), public_tokenizers.path(VOCABULARY), folder)
    assert token_orc.digests(token_orc.read(spark, folder)).count() == 0


def test_chunk_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_orc, "REMEMBERED", 10)
    path = public_tokenizers.path(VOCABULARY)
    made = token_orc.Encoder(path)
    text = " ".join(f"Word{i}, café{chr(97 + i % 26)}!" for i in range(200))
    assert np.frombuffer(made.encode(text), "<u4").tolist() == tokens_of(text, path)
    assert len(made.chunks) <= 13


# Whitening

KINDS = "vec_id long, embedding array<float>, label int, n string, whitened string"


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * 0.3
    return [(i, [float(np.float32(v)) for v in row], 1, "n", "w") for i, row in enumerate(mixed)]


def check(got, rows, k):
    clean = [(i, np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000) for i, v, *_ in rows
             if v and all(e is not None and math.isfinite(e) for e in v)]
    fit = np.array(sorted({tuple(x) for _, x in clean}))
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert Counter(r["vec_id"] for r in got) == Counter({i: c * len(values) for i, c in Counter(i for i, _ in clean).items()})
    signs = {}
    for i, x in clean:
        want = ((n * x - s) / n) @ axes / np.sqrt(values)
        for r in by[i]:
            c = r["component"] - 1
            assert r["n"] == n and abs(r["explained"] - values[c] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-6
            if sum(1 for j, _ in clean if j == i) == 1:
                assert int(r["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
                if abs(want[c]) > 1e-6:
                    assert signs.setdefault(c, np.sign(want[c] * r["whitened"])) == np.sign(want[c] * r["whitened"])
                assert abs(abs(r["whitened"]) - abs(want[c])) < 1e-6


@pytest.mark.parametrize("dims", [20, 5])
def test_whitening_equals_brute_force(spark, dims):
    rows = vectors(dims, 300, dims)
    rows += [(1000 + i, rows[0][1], 2, "n", "w") for i in range(50)] + [(None, rows[3][1], 1, "n", "w")]
    rows += [(2000, None, 1, "n", "w"), (2001, [], 1, "n", "w"), (2002, [None] * dims, 1, "n", "w"),
             (2003, [float("nan")] * dims, 1, "n", "w"), (2004, [float("inf")] * dims, 1, "n", "w"), (2005, [0.1], 1, "n", "w")]
    df = spark.createDataFrame(rows, KINDS).repartition(6)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", *whitening.OUT] and dict(out.dtypes)["deviation"] == "bigint"
    check(rows_of(out), [r for r in rows if r[0] != 2005], 16)


def test_whitening_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 800)
    rows = vectors(3, 200, 10)
    check(rows_of(whitening.whiten(spark.createDataFrame(rows, KINDS), k=4)), rows, 4)


def test_whitening_of_few_vectors(spark):
    flat = [(i, [0.5, 0.5, 1.0 * i], 1, "n", "w") for i in range(4)]
    got = rows_of(whitening.whiten(spark.createDataFrame(flat, KINDS)))
    assert len(got) == 12 and all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-9
    one = rows_of(whitening.whiten(spark.createDataFrame(flat[:1] * 3, KINDS)))
    assert len(one) == 9 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one} == {(None, None, None, 0)}
    assert whitening.whiten(spark.createDataFrame([], KINDS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "n", "w")], KINDS)).columns == ["vec_id", *whitening.OUT]


def test_wide_sums_of_squares(spark):
    rows = [(i, [1e7 * (i % 7) * (-1) ** i, 1e6 * i], 1, "n", "w") for i in range(40)]
    check(rows_of(whitening.whiten(spark.createDataFrame(rows, KINDS))), rows, 2)
