import zlib

import numpy as np
import pytest

from palimpsest.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scorer():
    words = {"stupid": 40, "moron": 40, "worthless": 30, "idiot": 30, "clown": 20}
    text = {"the": 900, "of": 500, "tion": 200, "and": 800, "there": 100, "stand": 60, "moon": 30, "clear": 50, "world": 60, "studio": 30, "ration": 50}
    grams = {}
    for w, n in {**text, **words}.items():
        p = tx.BOUND * 2 + w + tx.BOUND
        for i in range(len(p) - 2):
            grams[p[i : i + 3]] = grams.get(p[i : i + 3], 0) + n
    return tx.Scorer(tx.ToxicityModel({w: 5.0 for w in words}, tx.CharModel.train(grams, words), np.asarray([0.0, 5.0]), np.asarray([0.1, 0.9])))


HIDDEN = {"m0r0n": "moron", "st*pid": "stupid", "stuuupiiid": "stupid", "$tupid": "stupid", "1d10t": "idiot", "i.d.i.o.t": "idiot", "w0rthl3ss": "worthless", "cl-o-wn": "clown", "s t u p i d": "stupid", "c_l_o_w_n": "clown", "MORON!!": "moron", "moron###,": "moron", "!d!ot": "idiot", "m o r 0 n": "moron", "mοrοn": "moron", "іdіot": "idiot", "i|d|i|o|t": "idiot"}


@pytest.mark.parametrize("token", HIDDEN)
def test_hidden_words(scorer, token):
    assert scorer.markers(f"the {token} and") == {HIDDEN[token]}
    assert HIDDEN[token] in scorer.restored(f"the {token} and").lower()


def test_compatibility_forms(scorer):
    assert scorer.markers("the ＭＯＲＯＮ and ｉｄ1ｏｔ") == {"moron", "idiot"}


def test_other_scripts_change_nothing(scorer):
    """However many letters of other scripts the training words hold, the model of those that marking words use is the same."""
    words = {"stupid": 40, "moron": 40, "idiot": 30, "clown": 20}
    grams = {tx.BOUND * 2 + "t": 900, tx.BOUND + "th": 900, "the": 900, "he" + tx.BOUND: 900, tx.BOUND * 2 + "é": 3}
    signs = {chr(0x4E00 + i) * 3: 10_000 for i in range(3000)} | {chr(0x0430 + i) * 3: 10_000 for i in range(32)}
    seen = {c for gram in {**grams, **signs} for c in gram}
    letters = tx.alphabet(seen, set(words))
    plain, mixed = tx.CharModel.train(grams, words, letters), tx.CharModel.train({**grams, **signs}, words, letters)
    assert plain.letters == mixed.letters and "é" in letters and "а" not in letters
    assert all(plain.row(a, b) == mixed.row(a, b) for a in range(len(letters)) for b in range(len(letters)))
    both = tx.alphabet(seen, {*words, "\u4e00\u4e01"})
    assert {*both} - {*letters} == {"\u4e00", "\u4e01"}
    weights = {w: 5.0 for w in words}
    other = tx.Scorer(tx.ToxicityModel(weights, mixed, np.asarray([0.0, 5.0]), np.asarray([0.1, 0.9])))
    for token, word in HIDDEN.items():
        if word in words:
            assert other.markers(f"the {token} and") == {word}, token


@pytest.mark.parametrize("text", ["the m00n and clear", "a b c d e", "studi0", "", None, "password=e3b3ed3cc8", "x" * 10_000, "3.14 + 2 = 5.14", "of%%% the*** and"])
def test_clean_texts(scorer, text):
    assert scorer.markers(text) == set()


def paths(decoder, token):
    """Every path through the lattice of a token, with its cost."""
    letters, row = decoder.model.letters, decoder.model.row
    end = lambda cost, a, b: cost if a == b == 0 else cost - row(a, b)[0]
    now = [(0.0, 0, 0, "")]
    for at in range(len(token)):
        after = []
        for cost, a, b, path in now:
            for k, price in decoder.options(token, at):
                if k == tx.NOTHING:
                    after.append((cost + price, a, b, path))
                elif k == tx.END:
                    after.append((end(cost, a, b) + price, 0, 0, path + " "))
                else:
                    after.append((cost + price - row(a, b)[k], b, k, path + letters[k]))
        now = after
    return [(end(cost, a, b), path.strip()) for cost, a, b, path in now]


def test_viterbi_against_brute_force(scorer, monkeypatch):
    for token in ("m0r", "1d", "st*", "aa0", "c.l", "a -b", "s**d", "x y z"):
        found = paths(scorer.decoder, token)
        assert min(c for c, p in found if p == scorer.decoder.restore(token)) <= min(found)[0] + 1e-6
    plain = {t: scorer.decoder.restore(t) for t in ("mor**n i*", "m**#on", "s**pid", "i_d.i*t")}
    monkeypatch.setattr(tx, "WIDE_STEP", 0)  # every step as a matrix
    assert {t: scorer.decoder.restore(t) for t in plain} == plain and plain["mor**n i*"].startswith("moron")


LONG = {
    "".join(c * 14 for c in "stupid"): {"stupid"},
    " ".join("stupid" * 150): {"stupid"},
    "such a s t u p i d idea": {"stupid"},
    "s t u p i d i d i o t": {"stupid", "idiot"},
    "s-t-u-p-i-d_m.0.r.0.n": {"stupid", "moron"},
    "x " + " ".join("idiot") + "!": {"idiot"},
    "the" + "*" * 500 + " " + "z" * 5000 + " i" + "d" * 900 + "iot": {"idiot"},
}


@pytest.mark.parametrize("text", LONG)
def test_stretched_and_long_runs(scorer, text):
    assert scorer.markers(text) == LONG[text]


def test_held_out_accuracy(spark):
    scored = {r.doc_id: r for r in tx.op6_toxicity(spark, SF).collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in scored.items())
    held = [(r.toxic, scored[r.doc_id].score) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if scored[r.doc_id].held_out]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8
    sure = [t for t, s in held if s >= 0.7]
    assert sum(sure) >= 0.99 * len(sure) and sum(sure) >= 0.5 * len(pos)


def test_whole_fit_against_brute_force(spark, monkeypatch):
    """Lexicon, character model, lattice paths, folds and calibration, each done again the plain way."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    plain = ["red", "stone", "water", "little", "north", "garden", "paper", "seven", "hello", "cloud"]
    vile = ["grobnik", "zarfel"]
    hidden = ["gr0bnik", "z@rfel", "z a r f e l", "grobbbbnik"]
    texts = []
    for i in range(150):
        body = [rng.choice(plain) for _ in range(8)]
        bad = i % 3 == 0
        if bad and rng.random() < 0.9:
            body.insert(rng.randrange(8), rng.choice(vile if rng.random() < 0.7 else hidden))
        texts.append((i, " ".join(body), int(bad)))
    docs = spark.createDataFrame([(i, t, "m") for i, t, _ in texts] + [(900, None, "m"), (901, "", "m"), (902, "GROBNIK!", "m")], "doc_id long, text string, _scored string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    out = tx.score_toxicity(docs, labels)
    assert out.columns == ["doc_id", "text", "_scored", "_toxicity", "_markers"]
    got = {r.doc_id: r for r in out.collect()}

    train = {i: (t, y) for i, t, y in texts if zlib.crc32(str(i).encode()) % 3 != 1}
    by_text = {}
    for i in sorted(train):
        by_text.setdefault(train[i], i)  # copies count once
    train = {i: train[i] for i in by_text.values()}
    fold = {r.doc_id: r.fold for r in docs.selectExpr("doc_id", f"pmod(xxhash64(5, doc_id), {tx.FOLDS}) AS fold").collect()}
    seen = {i: tx._words(t) for i, (t, _) in train.items()}
    n_words = len(set().union(*seen.values())) + 1

    def lexicon(without):
        use = [i for i in train if fold[i] != without]
        toxic, other = ([i for i in use if train[i][1] == y] for y in (1, 0))
        weights = {}
        for w in set().union(*seen.values()):
            k, m = sum(w in seen[i] for i in toxic), sum(w in seen[i] for i in other)
            odds = (k + 0.5) / (len(toxic) + 1) / ((m + 0.5) / (len(other) + 1))
            rate = len(toxic) / len(use)
            ratio = 2 * sum(x * math.log(x / ((k + m) * p)) for x, p in ((k, rate), (m, 1 - rate)) if x)
            if k >= tx.MIN_DOCS and len(w) > 2 and odds >= tx.MIN_ODDS and ratio >= 2 * math.log(n_words):
                weights[w] = max(math.log(odds) - 2 * math.sqrt(1 / (k + 0.5) + 1 / (m + 0.5)), 0.05)
        return weights

    whole = lexicon(None)
    assert set(vile) <= set(whole)
    grams, boost = Counter(), {w: sum(w in seen[i] for i, (_, y) in train.items() if y) for w in whole if w.isalpha()}
    for i in train:
        for w in seen[i]:
            if w.isalpha():
                grams.update((tx.BOUND * 2 + w + tx.BOUND)[k : k + 3] for k in range(len(w) + 1))
    decoder = tx.Decoder(tx.CharModel.train(grams, boost))

    def raw(text, weights):
        known = lambda w: w if w in weights else w[:5] + "~" if len(w) > 5 and w[:5] + "~" in weights else None
        text = tx.collapsed(tx.folded(text or ""))
        words = {t.strip(tx._TRIM) for t in text.split()}
        for t in {*text.split(), *tx._SPACED.findall(text)}:
            if tx._ODD.search(t):
                words |= set(min(paths(decoder, t))[1].split())
        best = sorted((weights[k] for w in words if (k := known(w))), reverse=True)[:2]
        return best[0] + 0.25 * sum(best[1:]) if best else 0.0

    folds = [lexicon(k) for k in range(tx.FOLDS)]
    knots, values = tx.isotonic(np.asarray([raw(t, folds[fold[i]]) for i, (t, _) in train.items()]), np.asarray([float(y) for _, y in train.values()]))
    for i, t, _ in [*texts, (900, None, 0), (901, "", 0), (902, "GROBNIK!", 0)]:
        assert got[i]._toxicity == pytest.approx(float(tx.calibrated(np.asarray([raw(t, whole)]), knots, values)[0]), abs=1e-6), t
    assert got[902]._markers and got[902]._scored == "m" and got[900]._toxicity == got[901]._toxicity


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r._toxicity for r in tx.score_toxicity(docs, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(2, 1), (2, None), (None, 1), (3, 0), (1, 1)], "doc_id long, toxic int")
    assert all(0 <= r._toxicity <= 1 for r in tx.score_toxicity(docs, one).collect())
    assert tx.score_toxicity(docs.limit(0), one).count() == 0
