"""Inner steps of the operators against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from panelweave.llm import fertility, fingerprint, langid, minhash, toxicity
from test_llm_operators import TEXTS, WORD, make, rows_of


# Language identification

def small_network(seed=0):
    rng = np.random.default_rng(seed)
    width = len(langid.WIDTHS) * langid.FILTERS
    draw = lambda *shape: rng.normal(0, 0.4, shape)
    return langid.Network(draw(256, langid.EMBED), draw(langid.WIDEST * langid.EMBED, width) * langid._mask(), draw(width), draw(width, 3), draw(3), ["a", "b", "c"])


def plain_log_probs(net, window):
    tops = []
    for k, width in enumerate(np.repeat(langid.WIDTHS, langid.FILTERS)):
        best = -np.inf
        for at in range(langid.WINDOW - langid.WIDEST + 1):
            value = 0.0
            for place in range(width):
                for e in range(langid.EMBED):
                    value += net.embed[window[at + place], e] * net.filters[place * langid.EMBED + e, k]
            best = max(best, value)
        tops.append(max(best + net.bias[k], 0.0))
    z = [sum(t * net.out[k, c] for k, t in enumerate(tops)) + net.shift[c] for c in range(len(net.languages))]
    total = math.log(sum(math.exp(v - max(z)) for v in z)) + max(z)
    return [v - total for v in z]


def test_langid_forward_pass_equals_loops():
    net = small_network()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (2, langid.WINDOW)).astype(np.uint8)
    x[1, 40:] = 0
    got = net.log_probs(x)
    for row, window in zip(got, x):
        assert np.allclose(row, plain_log_probs(net, window), atol=1e-8)


def test_langid_gradients_equal_finite_differences():
    net = small_network(2)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 2, 1, 2])
    grads = langid.gradients(net, x, y)

    def loss():
        return -net.log_probs(x)[np.arange(len(y)), y].mean()

    step = 1e-6
    for name, grad in grads.items():
        values = getattr(net, name)
        spots = np.argwhere(np.abs(grad) > 1e-4)
        assert len(spots)
        for spot in [tuple(s) for s in spots[rng.permutation(len(spots))[:12]]]:
            before = values[spot]
            values[spot] = before + step
            up = loss()
            values[spot] = before - step
            down = loss()
            values[spot] = before
            assert abs((up - down) / (2 * step) - grad[spot]) < 1e-5


# Fingerprints

def plain_digest(raw):
    counts = [0] * fingerprint.BUCKETS
    for i in range(len(raw)):
        for k, offsets in enumerate(fingerprint.TRIPLETS):
            if i + offsets[-1] < len(raw):
                number = 0
                for place, o in enumerate(offsets):
                    number ^= hashlib.sha256(bytes((k, place, raw[i + o]))).digest()[0] % fingerprint.BUCKETS
                counts[number] += 1
    line = sorted(counts)
    quarter = fingerprint.BUCKETS // 4
    q = [line[quarter - 1], line[2 * quarter - 1], line[3 * quarter - 1]]
    codes = [sum(c > v for v in q) for c in counts]
    out = [min(255, round(8 * math.log2(len(raw) + 1))), (q[0] * 15 // q[2] << 4 | q[1] * 15 // q[2]) if q[2] else 0]
    for i in range(0, len(codes), 4):
        out.append(codes[i] + 4 * codes[i + 1] + 16 * codes[i + 2] + 64 * codes[i + 3])
    return bytes(out).hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    score = min(12, abs(x[0] - y[0])) + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
    for p, q in zip(x[2:], y[2:]):
        for k in range(4):
            score += (0, 1, 2, 6)[abs((p >> 2 * k & 3) - (q >> 2 * k & 3))]
    return max(0.0, 1 - score / 256)


def test_digest_and_likeness_equal_loops():
    rng = random.Random(4)
    words = "river stone morning garden light calm über été".split()
    texts = ["", "a", "abcd", "abcde"] + [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 40, 200, 400)] + ["z" * 300]
    raws = [t.encode() for t in texts] + [bytes(rng.randrange(256) for _ in range(500))]
    marks = [fingerprint.digest(r) for r in raws]
    assert marks == [plain_digest(r) for r in raws]
    for a in marks:
        for b in marks:
            assert fingerprint.likeness(a, b) == plain_likeness(a, b)
    half = raws[6][: len(raws[6]) // 2] + raws[7][: len(raws[6]) // 2]
    assert fingerprint.likeness(marks[6], plain_digest(raws[6][:-3] + b"xyz")) > fingerprint.likeness(marks[6], plain_digest(half)) - 1e-12


# Fertility

def quartiles(values):
    line = sorted(values)
    return [line[max(0, math.ceil(p * len(line)) - 1)] for p in (0.25, 0.5, 0.75)]


def half_up(x):
    return math.floor(x + 0.5)


def plain_verdicts(rows, width=2.0, enough=50):
    """``kept`` of each row, from its measures and its band."""
    names = ("chars_per_token", "byte_share", "entropy", "spread")
    for r in rows:
        log = math.log2(max(r["n_tokens"], 1))
        r["length"], r["spread"] = half_up(log), r["entropy"] - log * 0.5
    sound = {(r["band"], r["length"], *[r[m] for m in names]) for r in rows if not r["base_failed"]}
    groups = defaultdict(list)
    for band, length, *values in sound:
        for key in (("own", band, length), ("shared", length), ("any", band), ("every",)):
            groups[key].append(values)
    bands = {k: dict(zip(names, map(quartiles, zip(*v)))) for k, v in groups.items() if k[0] == "every" or len(v) >= enough}
    out = []
    for r in rows:
        def nearest(*start):
            near = sorted((abs(k[-1] - r["length"]), k[-1]) for k in bands if k[:-1] == start)
            return bands[*start, near[0][1]] if near and near[0][0] <= 1 else None

        like = nearest("own", r["band"]) or nearest("shared")
        q, last = (like, "entropy") if like else (bands.get(("any", r["band"])) or bands.get(("every",)), "spread")
        kept = not r["base_failed"]
        if kept and q:
            for m, floor, both in (("chars_per_token", 0.05, True), ("byte_share", 0.05, False), (last, 0.1, True)):
                low, _, high = q[m]
                room = max((high - low) * width, floor)
                kept &= r[m] <= high + room and (not both or r[m] >= low - room)
        out.append(kept)
    return out


def test_fertility_verdicts_equal_plain_bands(spark):
    rng = random.Random(5)
    pick = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(420):
        lang = ("en", "de", None, "fr")[i % 4 if i % 40 else 3]
        words = TEXTS["de" if lang == "de" else "en"].split() + [f"w{i % 9}"]
        rows.append((i, pick(words, rng.choice((10, 25, 40, 60, 60, 130, 300))), lang, "a"))
    rows += [(1000 + i, pick(["|", "12", "--", "0.5", "x"], 90), "en", "a") for i in range(12)]
    rows += [(2000 + i, "日本語 テキスト " * 30 + pick(["で", "す", "か", "な"], 20), None, "a") for i in range(3)]
    rows += [(3000, "a#b *** $5 %&| <tag> #", "en", "a"), (3001, None, None, None), (3002, "", "xx", "a")]
    docs = make(spark, rows).repartition(3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in rows_of(fertility.rules(docs, path))}
    measured = [r | {"base_failed": got[r["doc_id"]]["base_failed"]} for r in rows_of(fertility.measure(docs, path))]
    want = plain_verdicts(measured)
    assert [got[r["doc_id"]]["kept"] for r in measured] == want and 0 < sum(want) < sum(not r["base_failed"] for r in measured)
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r["n_symbols"] == sum(c in "#*$%&|<>" for c in texts[i]) for i, r in got.items())
    # the measures themselves
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in measured[::37]:
        words = WORD.findall(texts[r["doc_id"]])
        ids = model.encode(" ".join(words))
        counts = Counter(ids)
        assert r["n_tokens"] == len(ids)
        if ids:
            assert abs(r["chars_per_token"] - sum(map(len, words)) / len(ids)) < 1e-12
            assert abs(r["byte_share"] - sum(model.is_byte(t) for t in ids) / len(ids)) < 1e-12
            assert abs(r["entropy"] + sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())) < 1e-9


# Toxicity

def reader():
    counts = np.ones((27, 27)) * 2
    letters = [chr(97 + i) for i in range(26)]
    for word in "idiot scum moron idiots sit the of an to a shit ass calm river stone said".split():
        line = [0, *[ord(c) - 96 for c in word], 0]
        for a, b in zip(line, line[1:]):
            counts[a, b] += 400
    return toxicity.Restorer(toxicity.LanguageModel(letters, counts))


@pytest.mark.parametrize("text, word", [
    ("he is an i d i o t.", "idiot"), ("(i d i o t)", "idiot"), ("an  i  d  i  o  t said", "idiot"), ("i\nd\ni\no\nt", "idiot"),
    ("\"i-d-i-o-t\",", "idiot"), ("i.d.i.o.t!", "idiot"), ("i\td i  o\tt", "idiot"), ("you 1d10t", "idiot"), ("a $ s h o l e @$$ b", "ass"), ("5#17 of", "shit")])
def test_obfuscated_words_are_read(text, word):
    assert word in reader().words([text])[0]
    assert word in reader().text(text)


def test_plain_text_keeps_its_words():
    text = "The river, 1234 or 3.5 (12%) and $40; a-b | 12 | 7 | --- 10:30 said."
    assert {"the", "river", "said", "and", "or"} <= reader().words([text])[0]
    for number in ("1234", "3.5", "(12%)", "$40;", "|", "---", "10:30"):
        assert not toxicity.is_odd(number)


def test_telling_features_and_weights(spark):
    rng = random.Random(6)
    plain = ["calm", "river", "stone", "light", "garden", "morning", "letter"]
    rows = []
    for i in range(300):
        words = {rng.choice(plain) for _ in range(4)}
        y = int(i % 5 == 0)
        if y and rng.random() < 0.9 or rng.random() < 0.02:
            words.add(rng.choice(["scoundrel", "villain"]))
        rows.append((y, sorted(words)))
    df = spark.createDataFrame(rows, "y int, words array<string>").repartition(3)
    ones, zeros = Counter(), Counter()
    for y, words in rows:
        found = set(words) | {"^" + w[:n] for w in words for n in range(3, min(8, len(w)) + 1)}
        (ones if y else zeros).update(found)
    share = sum(y for y, _ in rows) / len(rows)

    def gain(f):
        n = ones[f] + zeros[f]
        return sum(c * math.log(c / (n * p)) for c, p in ((ones[f], share), (zeros[f], 1 - share)) if c)

    able = [f for f in {*ones, *zeros} if ones[f] + zeros[f] >= 4 and ones[f] > (ones[f] + zeros[f]) * share]
    assert toxicity.telling_features(df, 4, 4000) == sorted(able)
    best = sorted(able, key=lambda f: (-round(gain(f), 9), f))[:6]
    assert toxicity.telling_features(df, 4, 6) == sorted(best)

    weights, intercept = toxicity.fit(df, rounds=6000)
    assert set(weights) <= set(able) and all(w > 0 for w in weights.values())
    penalty, slope = 0.05, {f: 0.05 * weights.get(f, 0.0) for f in able}
    slope_b = 0.0
    for y, words in rows:
        found = (set(words) | {"^" + w[:n] for w in words for n in range(3, min(8, len(w)) + 1)}) & set(able)
        gap = 1 / (1 + math.exp(-intercept - sum(weights.get(f, 0.0) for f in found))) - y
        slope_b += gap
        for f in found:
            slope[f] += gap
    # the optimum: no slope where a weight is positive, none downwards where it is 0
    assert abs(slope_b) < 0.05 and all(abs(slope[f]) < 0.05 if f in weights else slope[f] > -0.05 for f in able)
    assert penalty and weights


def test_word_features_of_a_batch_are_those_of_each_row():
    rng = random.Random(8)
    rows = [sorted({"".join(rng.choice("abéñ𝒳") for _ in range(rng.randrange(1, 11))) for _ in range(rng.randrange(30))}) for _ in range(60)]
    for part in (pa.array([*rows, []], pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string())).slice(7), pa.array([], pa.list_(pa.string()))):
        names, at, row = toxicity.word_features(part)
        got = [[] for _ in part]
        for a, r in zip(at, row):
            got[r].append(names[a].as_py())
        assert [sorted(g) for g in got] == [sorted(toxicity.features(w)) for w in part.to_pylist()]
        names, at, row = toxicity.word_features(part, pa.array(["^abc", "ab"]))
        assert sorted(zip(row, names.take(pa.array(at)).to_pylist())) == [
            (i, f) for i, w in enumerate(part.to_pylist()) for f in ("^abc", "ab") if f in toxicity.features(w)]


def test_words_that_give_nothing_are_left_out_early():
    texts = ["you 1d10t, aaa idiots!", "an i d i o t. scuuuum ... said", "the river aaaa---b", ""] * 700
    active = toxicity.Active({"^idi": 1.0, "scum": 2.0, "a": 1.0})
    plain = reader().words(texts)
    early = toxicity.Restorer(reader().lm, active, active.starts).words(texts)
    assert early == [{f for w in words for f in active((w,))} for words in plain]
    assert toxicity.repeating({"aaa", "aab", "b", "xx...", "--", "a\u20acccc"}) == {"aaa", "xx...", "a\u20acccc"}


# Near duplicates with other shingles

def test_five_word_shingles_at_four_fifths(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(204)]

    def share(a, b):
        x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    added = base + [word() for _ in range(44)]  # a block of new text
    apart = base + [word() for _ in range(60)]
    assert 0.815 < share(base, added) < 0.825 and share(base, apart) < 0.8
    rows = [(1, " ".join(base)), (2, " ".join(added)), (3, " ".join(apart)), (4, "one two"), (5, "One two"), (6, None)]
    docs = make(spark, [(*r, "en", "a") for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(docs, 80, 5))}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in [*rows, (None, "one two"), (None, "one two"), (4, "other words")]],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    left = Counter((r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.drop_near_duplicates(spark, table, "")))
    assert left[None, "one two"] == 2 and {i for i, _ in left} == {1, 3, 4, 6, None} and sum(n for (i, _), n in left.items() if i == 4) == 1
