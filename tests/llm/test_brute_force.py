"""What SQL can't express, against plain Python written apart from the operators."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from lixora.llm import decontamination, fingerprints, quality, toxicity
from tests.llm.test_small_cases import docs_of

MASK = 2**64 - 1


def scramble(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def lz_phrases(text):
    """The phrases of LZ78 as tuples of words, and what is left at the end."""
    known, phrase = set(), ()
    for s in re.findall(r"\S+\s*|\s+", text):
        phrase += (s,)
        if phrase not in known:
            known.add(phrase)
            phrase = ()
    return known, phrase


def slow_fingerprint(text):
    def name(phrase):
        node = 0
        for s in phrase:
            node = (node * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(s)) & MASK
        return node

    known, rest = lz_phrases(text)
    names = {name(p) for p in known} | ({name(rest) ^ 1} if rest else set())
    if not names:
        return "0000" * fingerprints.SLOTS
    out = []
    for scale, shift in zip(fingerprints.SCALE.tolist(), fingerprints.SHIFT.tolist()):
        least = min((scramble(h) * scale + shift) & MASK for h in names)
        out.append(f"{scramble((least * 0x9E3779B97F4A7C15) & MASK) >> 48:04x}")
    return "".join(out)


def test_fingerprints_by_slow_parse(spark):
    rnd = random.Random(31)
    words = [f"w{i}" for i in range(60)] + ["é\n", "\t\tx", "𝒳"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 150)))) for i in range(40)] + [(40, None), (41, "  "), (42, "a " * 90)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_of(spark, rows)).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        assert got[i]["fingerprint"] == slow_fingerprint(t)
        assert got[i]["edited_fingerprint"] == slow_fingerprint(t[: len(t) - half] + after[:half])
        same = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / fingerprints.SLOTS
        assert got[i]["near_edited"] == same(got[i]["fingerprint"], got[i]["edited_fingerprint"])
        assert got[i]["near_next"] == same(got[i]["fingerprint"], slow_fingerprint(after))


def test_likeness_follows_shared_phrases():
    rnd = random.Random(32)
    words = [f"w{i}" for i in range(3000)]
    off = []
    for _ in range(60):
        a = rnd.choices(words, k=400)
        b = a[: rnd.randint(0, 400)] + rnd.choices(words, k=rnd.randint(1, 200))
        (x, _), (y, _) = lz_phrases(" ".join(a)), lz_phrases(" ".join(b))
        hashes = fingerprints.WordHashes()
        near = fingerprints.likeness(fingerprints.fingerprint(" ".join(a), hashes), fingerprints.fingerprint(" ".join(b), hashes))
        off.append(near - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.03 and max(map(abs, off)) < 0.2


def test_toxicity_scores_by_pairs():
    rnd = random.Random(33)
    terms = toxicity.Terms()
    words = ["alpha", "beta", "gamma", "delta", "a", "bb", "alphabet"]
    known = toxicity.terms_of(" ".join(words[:5]), terms)
    random_ = np.random.default_rng(3)
    model = {"bias": np.float64(-0.4), "terms": known, "w": random_.normal(size=len(known)), "v": random_.normal(size=(len(known), 4))}
    place = {int(t): i for i, t in enumerate(known)}
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(60)] + ["", "unknown"]
    for text, score in zip(texts, toxicity.scorer(model)(texts)):
        on = [place[int(t)] for t in toxicity.terms_of(text, terms) if int(t) in place]
        y = -0.4 + sum(model["w"][i] for i in on)
        for k, i in enumerate(on):
            for j in on[:k]:
                y += sum(model["v"][i][f] * model["v"][j][f] for f in range(4)) / len(on)
        assert score == pytest.approx(1 / (1 + math.exp(-y)))


def test_toxicity_terms_by_hand():
    want = {xxhash.xxh32_intdigest(t) for t in ("insulting", "^insu", "^insul", "four", "^four", "it")}
    assert set(toxicity.terms_of("It, INSULTING! four it", toxicity.Terms()).tolist()) == want


@pytest.mark.parametrize("scale", [0.05, 3.0])
def test_quality_risk_and_gradient(scale):
    rnd = np.random.default_rng(4)
    good, any_ = rnd.normal(1, 1, (40, 6)), rnd.normal(0, 1, (70, 6))
    w, b, prior = rnd.normal(0, scale, 6), 0.3, 0.6

    def slow(w, b):
        loss = lambda z: math.log1p(math.exp(z))
        zp, zu = [float(x @ w + b) for x in good], [float(x @ w + b) for x in any_]
        of_good = prior * sum(loss(-z) for z in zp) / len(zp)
        return of_good, sum(loss(z) for z in zu) / len(zu) - prior * sum(loss(z) for z in zp) / len(zp)

    of_good, of_bad, gradient = quality.risk(w, b, good, any_, prior)
    assert (of_good, of_bad) == pytest.approx(slow(w, b))
    target = (lambda w, b: sum(slow(w, b))) if of_bad >= 0 else (lambda w, b: -slow(w, b)[1])
    for k in range(7):
        d = np.eye(7)[k] * 1e-5
        slope = (target(w + d[:6], b + d[6]) - target(w - d[:6], b - d[6])) / 2e-5
        assert gradient[k] == pytest.approx(slope, abs=1e-6)


def test_quality_turns_round_when_the_bad_risk_is_negative():
    good, any_ = np.full((5, 2), 4.0), np.full((5, 2), -4.0)
    _, of_bad, gradient = quality.risk(np.ones(2), 0.0, good, any_, 0.9)
    assert of_bad < 0 < of_bad + 9
    step = 0.01 * gradient
    assert quality.risk(np.ones(2) - step[:2], -step[2], good, any_, 0.9)[1] > of_bad


def test_decontamination_recall_against_full_alignment(spark):
    """Every document against every item, aligned in full: what reaches half an item's score is a leak."""

    def local(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    rnd = random.Random(35)
    words = [f"v{i}" for i in range(500)]
    items = [(i, rnd.choices(words, k=rnd.randint(12, 45))) for i in range(12)]
    rows = []
    for k in range(150):
        text = rnd.choices(words, k=60)
        if k % 3:
            rate = rnd.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25])
            copy = [x for w in items[k % 12][1] for x in ([w] if rnd.random() >= rate else rnd.choice([["other"], [], [w, "put"]]))]
            text[20:20] = copy
        rows.append((k, text))
    want = {(k, i) for k, text in rows for i, item in items if local(item, text) >= len(item)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(spark, [(k, " ".join(t)) for k, t in rows]), bench).collect()}
    assert got <= want and len(want) > 80 and len(got) >= 0.9 * len(want)


def test_toxicity_line_fits_scores():
    rnd = np.random.default_rng(6)
    z = rnd.normal(0, 2, 4000)
    labels = (rnd.random(4000) < 1 / (1 + np.exp(-(1.7 * z - 2.0)))).astype(float)
    a, c = toxicity.line(z, labels)
    assert 1.4 < a < 2.1 and -2.0 < c < 0  # toxic rows weigh more
    step = lambda a, c: (np.where(labels > 0, toxicity.WEIGHT, 1.0) * np.logaddexp(0, np.where(labels > 0, -1, 1) * (a * z + c))).sum() + 0.5 * toxicity.RIDGE * ((a - 1) ** 2 + c**2)
    assert all(step(a, c) <= step(a + x, c + y) for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))


def test_toxicity_calibration_needs_rows_of_both_kinds():
    terms = toxicity.Terms()
    rnd = random.Random(36)
    texts = [" ".join(rnd.choices(["some", "plain", "words", "here"], k=6) + ["nasty"] * (k % 4 == 0)) for k in range(600)]
    docs, labels = [toxicity.terms_of(t, terms) for t in texts], np.array([float(k % 4 == 0) for k in range(600)])
    assert "line" not in toxicity.calibrated(labels[:90], docs[:90]) and "line" in toxicity.calibrated(labels, docs)
    model = toxicity.calibrated(labels, docs)
    scale, shift = model["line"]
    assert toxicity.logits(model)(texts) == pytest.approx(scale * toxicity.known_score(model, docs) + shift)
