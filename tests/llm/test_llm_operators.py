"""Operators for training text: brute-force versions, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelweave.llm import bpe, chat, components, fertility, fingerprint, langid, minhash, mixing, quality, suffix, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, k int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = {"en": "the quick brown fox jumps over the lazy dog and runs through the wood ",
         "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald "}


def make(spark, rows):
    """Rows of (doc_id, text, lang, source); further columns clash on purpose."""
    return spark.createDataFrame([(*r, 0, 0.5, 7, 1) for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "word", "en", "a"), (None, prose(30), "en", None),
            (4, prose(40), None, "b"), (5, passage + "\n" + prose(30), "en", "b"), (6, prose(25) + " " + passage, "de", "c"),
            (7, "x" * 70_000, "en", "c"), (8, prose(9_000), "de", "a"), (9, "é" * 300 + " ñ ß", "de", "a"),
            (10, prose(50), "en", "a"), (10, prose(50), "en", "a")]
    same = prose(80)
    rows += [(i, same, "en", "hot") for i in range(20, 26)] + [(26, same + " tail", "en", "hot"), (26, same + " tail", "en", "hot")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Mixing

def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), None, rng.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    docs = make(spark, rows).withColumn("size", mixing.words())
    got = rows_of(mixing.mix(docs))
    again = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix(docs))}
    assert len(got) == 900 and again == {r["doc_id"]: r["copies"] for r in got}
    sizes = Counter()
    taken = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # the rule as it is told
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.discard(s)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * 90


def test_mixing_odd_rows(odd, none):
    docs = odd.withColumn("size", mixing.words())
    got = mixing.mix(docs)
    assert got.count() == odd.count() and "k" in got.columns
    assert mixing.mix(none.withColumn("size", mixing.words())).count() == 0
    expanded = mixing.repeat_rows(got, ["doc_id", "text"])
    assert expanded.count() == got.agg(F.sum("copies")).first()[0]


def test_mixing_splits_large_groups(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("size"))
    whole = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "GROUP_ROWS", 10)
    assert {r.doc_id: r.copies for r in mixing.mix(docs).collect()} == whole


# Chat

def chat_brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or "", r, x))
    for c in convs:
        convs[c].sort(key=lambda y: y[:3])
    keys = {c: [y[:3] for y in v] for c, v in convs.items()}
    keep = set()
    for c, k in keys.items():
        longer = any(len(o) > len(k) and o[:len(k)] == k for o in keys.values())
        first = min((x for x, o in keys.items() if o == k), key=lambda x: (x is None, x or 0))
        if not longer and c == first:
            keep.add(c)
    return {(c, y[0], len(convs[c])) for c in keep for y in convs[c]}


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(3)
    rows = []
    base = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(8)]
    for c in range(40):
        n = rng.randrange(1, 9)
        own = base[:n] if c % 2 else [*base[:n - 1], (n - 1, "user", f"own {c % 7}")]
        rows += [(c, *t) for t in own]
    rows += [rows[0], (99, None, None, None), (None, 0, "user", "no id"), (98, 5000, "user", "late"), (98, 0, "user", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("block", F.lit(2))
    got = rows_of(chat.render(df))
    assert {(r["conv_id"], r["turn"], r["n_turns"]) for r in got} == chat_brute(rows)
    assert len(got) == len({(r["conv_id"], r["turn"]) for r in got})
    for r in got:
        assert r["rendered"].startswith(chat.OPEN)
    last = max((r for r in got if r["conv_id"] == 98), key=lambda r: r["turn"])
    assert last["rendered"].endswith(chat.END)


def test_chat_empty_table(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# Byte-pair encoding

def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    texts = ["", "  \n ", "Hello WORLD's don't I'll aaaaaaaa banana <|endoftext|> x<|startoftext|>Y", "ΣΑΣ İstanbul ﬁ é ①½ 12345 日本語 🎉🎉🎉",
             "!!!!!!! ''''s '' 's're", "a\x00b \x1c\x85　", "abababab cdcdcd ....... ----", "ab" * 40_000, "ẞ ß K Å ǅ", "é" * 50]
    encoder = bpe.Encoder(path)
    for text, ids in zip(texts, encoder.encode(texts)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert encoder.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_bpe_forgets_and_goes_on(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"word{i} number{i * 7} <|endoftext|>" for i in range(60)]
    want = [x.tolist() for x in bpe.Encoder(path).encode(texts)]
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "INDEX_CHARS", 40)
    assert [x.tolist() for x in bpe.Encoder(path).encode(texts)] == want


def test_bpe_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = rows_of(bpe.encode(odd, path))
    assert len(got) == odd.count()
    empty = next(r for r in got if r["doc_id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    for r in got:
        assert hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe.encode(none, path).count() == 0


# Classifiers

def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_quality_tells_junk(spark, odd, none):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
        docs.append((i, " ".join(words) + "." if good else " | ".join(w + "###" for w in words), "en", "a"))
        labels.append((i, int(good), 0, "clash"))
    got = rows_of(quality.classify(make(spark, docs), labels_of(spark, labels)))
    held = [r for r in got if r["held_out"]]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(240))
    assert all(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held)
    few = labels_of(spark, [(3, 1, None, None), (4, None, 1, None), (None, 0, 0, None)])
    got = rows_of(quality.classify(odd, few))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0.5 for r in quality.classify(odd, labels_of(spark, [])).collect())
    assert quality.classify(none, few).count() == 0


def test_quality_moments_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, len(quality.NAMES)))
    y = (np.arange(50) % 2).tolist()
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "y int, stats array<double>").repartition(3)
    n, s, p = quality.moments(df)[1]
    part = x[1::2]
    assert n == 25 and np.allclose(s, part.sum(0)) and np.allclose(p, part.T @ part)
    model = quality.fit(df)
    d = x[0] - model.means[0]
    cov = np.linalg.inv(model.factors[0].T @ model.factors[0])
    assert np.allclose(np.sum((model.factors[0] @ d) ** 2), d @ np.linalg.solve(cov, d))


def toxic_corpus(n=400):
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdlmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["scoundrel", "villain", "scoundrels"])
        docs.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(i % 4 == 0), "clash"))
    return docs, labels


def test_toxicity_learns_and_restores(spark, odd, none):
    docs, labels = toxic_corpus()
    extra = [(1000, "elibe sc0undr3l amano", "en", "a"), (1001, "elibe v i l l a i n amano", "en", "a"), (1002, "elibe scouuuundrel", "en", "a"),
             (1003, "elibe amano 1234 3.5", "en", "a")]
    got = {r["doc_id"]: r for r in rows_of(toxicity.classify(make(spark, docs + extra), labels_of(spark, labels)))}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(400))
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003)] == [1, 1, 1, 0]
    few = labels_of(spark, [(3, 1, None, None), (None, 0, 0, None)])
    got = rows_of(toxicity.classify(odd, few))
    assert len(got) == odd.count() and all(r["score"] == 0.5 for r in got)
    assert toxicity.classify(none, few).count() == 0


def test_viterbi_is_the_best_path(spark):
    """Against every path of the lattice."""
    rng = np.random.default_rng(1)
    lm = toxicity.LanguageModel(list("abdeiost"), rng.integers(0, 50, (9, 9)).astype(float))

    def brute(token):
        best = (-np.inf, "")

        def go(t, state, score, text):
            nonlocal best
            if t == len(ways):
                best = max(best, (score + lm.log[state, 0], text))
                return
            for to, cost, out in ways[t]:
                go(t + 1, state if to < 0 else to, score - cost + (0 if to < 0 else lm.log[state, to]), text + out)

        ways = toxicity.lattice(token, lm)
        go(0, 0, 0.0, "")
        return best

    def score(token, text):
        return brute(token)[0]

    for token in ["1d!0t", "b.a.d", "a$$", "s t 0 b", "d00d", "x3@"]:
        got = toxicity.decode([token], lm)[0]
        assert got == brute(toxicity.TRIPLE.sub(r"\1\1", token))[1]


def test_toxicity_restored_text(odd):
    lm = toxicity.language_model(odd)
    got = rows_of(toxicity.restored(odd, lm))
    assert len(got) == odd.count() and next(r for r in got if r["doc_id"] == 2)["restored"] == ""


def test_langid(spark, odd, none):
    rng = random.Random(6)
    docs = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        words = TEXTS[lang].split()
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 90))), lang, "a"))
    got = rows_of(langid.predict(make(spark, docs + [(900, "123 !!", "en", "a"), (901, None, "de", "a")])))
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held]) > 0.95
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[0]["held_out"] == (zlib.crc32(b"0") % 4 == 2)
    assert langid.predict(odd).count() == odd.count()
    assert langid.predict(none).count() == 0
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(nothing).collect()} == {"und"}


def test_langid_windows_cover_every_sequence():
    for n in (0, 1, 4, 5, 255, 256, 257, 508, 509, 3000):
        raw = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        seen = {bytes(w[i:i + langid.WIDEST]) for w in langid.windows(raw) for i in range(langid.WINDOW - langid.WIDEST + 1)}
        assert all(raw[i:i + langid.WIDEST] in seen for i in range(n - langid.WIDEST + 1))


# Near duplicates

def jaccard_groups(rows, percent=85):
    sets, links = {}, []
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[doc_id] = {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else ({tuple(words)} if words else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = top(x), top(y)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own).replace("w1", "W1")))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", "one two", "ONE  two", "one", "a b c", "a b c d"])]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in rows_of(minhash.near_duplicates(make(spark, [(*r, "en", "a") for r in rows])))}
    want = jaccard_groups(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """The complete comparison of what the first links leave open, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 300)
    rows = [r for r in near_rows() if len(r[1].split()) > 3]
    docs = make(spark, [(*r, "en", "a") for r in rows])
    one = docs.select(F.col("doc_id").alias("id"), F.lit(100).cast("long").alias("n"), F.lit(5).cast("long").alias("key"))
    found = spark.createDataFrame([], "id long, component long")
    links = minhash.resolve(one, found, docs.select(F.col("doc_id").alias("id"), "text"), 85)
    comp = {r.id: r.component for r in components.components(links).collect()}
    assert {i: comp.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in jaccard_groups(rows).items()}


def test_near_duplicates_odd_rows(odd, none):
    got = rows_of(minhash.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["component_id"] is None and by[None][0]["kept"] is False
    assert [r["component_id"] for i in range(20, 27) for r in by[i]] == [20] * 8
    assert by[1][0]["n_shingles"] == 0 and by[1][0]["kept"]
    assert minhash.near_duplicates(none).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 41), (41, 60), (7, 7), (90, 91), (90, 91)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 41: 41, 50: 41, 60: 41, 90: 90, 91: 90}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Fingerprints

def test_fingerprints(spark, odd, none):
    rows = sorted(((i, t) for i, t, *_ in odd_rows() if i is not None and i not in (10, 26)), key=lambda x: x[0])
    got = {r["doc_id"]: r for r in rows_of(fingerprint.with_next(make(spark, [(*r, "en", "a") for r in rows]).repartition(5)))}
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[:n - n // 2] + following[:n // 2]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.own_digest(text)
        assert r["edited_fingerprint"] == fingerprint.own_digest(edited)
        assert r["near_next"] == fingerprint.likeness(r["fingerprint"], fingerprint.own_digest(following))
        assert 0 <= r["near_edited"] <= 1
    assert fingerprint.with_next(odd).count() == odd.count()
    assert fingerprint.with_next(none).count() == 0
    one = rows_of(fingerprint.with_next(make(spark, [(1, "a single text", None, None)])))[0]
    assert one["near_next"] == 1.0
    assert {r.fingerprint for r in fingerprint.fingerprints(odd.where("doc_id BETWEEN 20 AND 25")).collect()}.__len__() == 1


def test_bucket_counts_count_triplets():
    raw = bytes(random.Random(1).randrange(256) for _ in range(90))
    want = np.zeros(fingerprint.BUCKETS, int)
    for k, offsets in enumerate(fingerprint.TRIPLETS):
        for i in range(len(raw) - offsets[-1]):
            a, b, c = (fingerprint._TABLES[k][p][raw[i + o]] for p, o in enumerate(offsets))
            want[a ^ b ^ c] += 1
    assert fingerprint.bucket_counts(raw).tolist() == want.tolist()


# Fertility

def test_fertility_base_counts(odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = rows_of(fertility.rules(odd, path))
    texts = Counter((i, t or "") for i, t, *_ in odd_rows())
    assert len(got) == odd.count()
    for (i, text), _ in texts.items():
        if sum(k[0] == i for k in texts) > 1:
            continue
        r = next(x for x in got if x["doc_id"] == i)
        words = WORD.findall(text)
        windows = Counter(tuple(words[j:j + 8]) for j in range(len(words) - 7))
        hit = {j + k for j in range(len(words) - 7) if windows[tuple(words[j:j + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert fertility.rules(none, path).count() == 0


def test_fertility_rejects_unreadable_text(spark):
    rng = random.Random(9)
    words = TEXTS["en"].split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", "a") for i in range(120)]
    rows += [(500, " ".join("".join(chr(rng.randrange(0x13000, 0x13400)) for _ in range(5)) for _ in range(60)), "en", "a")]
    got = {r["doc_id"]: r for r in rows_of(fertility.rules(make(spark, rows), public_tokenizers.path("piece_bpe_32k.model")))}
    assert not got[500]["kept"] and got[500]["byte_share"] > 0.5
    assert all(got[i]["kept"] for i in range(120) if not got[i]["base_failed"])


def test_fertility_rejects_ordinary_junk(spark):
    rng = random.Random(17)
    words = ("house river table window garden people market letter summer winter music teacher village doctor bridge engine "
             "paper mountain story number question animal kitchen station the of and to in is that it was for on are with as "
             "his they at be this have from or one had by word but not what all were we when your can said there use each "
             "which she do how their if will up other about out many then them these so some her would make like him into").split()
    weights = [1 / (k % 40 + 3) for k in range(len(words))]
    prose = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(i, prose(rng.choice((50, 70, 150, 300, 600))), "en", "a") for i in range(900)]
    rows += [(2000 + i, rows[0][1], "en", "a") for i in range(600)]  # copies do not narrow the bands
    cells = lambda n: " ".join(rng.choice(["|", "12", "|", "7", "--", "|", "0.5"]) for _ in range(n))
    spam = lambda n: " ".join(rng.choice(["buy", "cheap", "watches", "now", "click", "here"]) for _ in range(n))
    codes = lambda n: " ".join("%06x" % rng.randrange(1 << 24) for _ in range(n))
    rows += [(1000 + i, make_junk(rng.choice((150, 300))), "en", "a") for i, make_junk in enumerate([cells, spam, codes] * 10)]
    got = {r["doc_id"]: r for r in rows_of(fertility.rules(make(spark, rows), public_tokenizers.path("piece_bpe_32k.model")))}
    assert not any(got[i]["base_failed"] for i in got)
    assert not any(got[1000 + i]["kept"] for i in range(30))
    assert sum(not got[i]["kept"] for i in range(900)) <= 18
    assert all(got[2000 + i]["kept"] == got[0]["kept"] for i in range(600))


# Suffix removal

def gone_brute(rows, length=100):
    """rows of (doc_id, text) in order of place; ids are unique."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, pieces, batch", [(50_000, 50_000, 1_000_000), (2, 2, 1_000_000), (2, 50_000, 1_000_000), (50_000, 50_000, 300)])
def test_repeats_match_brute_force(spark, monkeypatch, hot, pieces, batch):
    monkeypatch.setattr(suffix, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix, "HOT_PIECES", pieces)
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (18, 25, 40, 90)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut:], prose(rng.randrange(0, 20))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(300 + i, rows[i][1]) for i in range(5)]
    rows += [(400, "ab" * 300), (401, "b" * 500), (402, "b" * 99), (403, "b" * 100), (404, None), (405, ""), (406, passages[0] * 4), (2, "ab" * 60)]
    docs = make(spark, [(*r, "en", "a") for r in rows]).repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(suffix.remove_repeats(docs))}
    assert got == gone_brute(rows)
    left = {r["doc_id"]: r["text"] for r in rows_of(suffix.remove_repeats(docs, with_text=True))}
    assert left[404] is None and left[403] == "" and left[402] == "b" * 99


def test_repeats_odd_rows(odd, none):
    got = rows_of(suffix.remove_repeats(odd, with_text=True))
    assert len(got) == odd.count() and all("k" in r for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_removed"] == r["n_bytes"] for i in range(21, 26) for r in by[i])
    assert len({r["n_removed"] for r in by[26]}) == 1 and by[1][0]["n_bytes"] == 0
    assert suffix.remove_repeats(none).count() == 0


def test_pieces_of_a_common_passage_are_few(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_RUNS", 50)
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = prose(85)
    docs = make(spark, [(i, prose(30) + " " + passage + " " + prose(30), "en", "a") for i in range(400)]).repartition(4)
    texts = suffix.numbered(docs).select("rid", "text").repartition(4, "rid")
    flagged = suffix.stored(suffix.repeating_runs(texts), "test-runs")
    found = suffix.pieces(texts, suffix.run_lists(flagged)).collect()
    # a few rows for each text and its edges, and the passage once a task
    runs = flagged.count()
    assert runs > 400 * 12 and len(found) <= 400 * 5 and sum(r["key"] is not None for r in found) <= 400 * 4 + 4 * 40


def test_joined_ranges():
    rid, s, e = (np.array(c, np.int64) for c in ([2, 1, 1, 1, 2], [0, 50, 0, 151, 7], [5, 150, 60, 160, 9]))
    assert [c.tolist() for c in suffix._joined(rid, s, e)] == [[0, 151, 0, 7], [150, 160, 5, 9], [1, 1, 2, 2]]


def test_boundaries_give_common_prefixes():
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 60))) for _ in range(30)]
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + len(texts)
    symbols[np.cumsum([len(t) + 1 for t in texts]) - 1] = np.arange(len(texts))
    order = suffix.suffix_order(symbols)
    tails = [symbols[i:].tolist() for i in order]
    assert tails == sorted(tails)
    common = [next(k for k in range(len(a)) if a[k] != b[k]) for a, b in zip(tails, tails[1:])]
    for length in (1, 4, 12):
        known = suffix.boundaries(symbols, order, length)
        assert known[1:-1].tolist() == [c < length for c in common]


def test_trimmed_keeps_whole_characters():
    text = "aéb"
    assert suffix._trimmed(text, np.array([False, True, False, True])) == "éb"
