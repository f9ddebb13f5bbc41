"""Small and odd inputs, exact round trips and brute force, for every corpus operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lixora.llm import chat, decontamination, fingerprints, labelled, licenses, ngram_join, packing, quality, secrets, toxicity, warc

DOC = "doc_id long, text string"
EXTRA = "doc_id long, text string, row string, class string, node long, part string, score double, kind string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "r", "c", 1, "p", 0.5, "k") for i, t in rows], EXTRA).repartition(3)


ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "null id"), (4, "x" * 5000), (5, "wörter " * 900), (6, "   \n\t "), (7, "tie tie tie tie tie"), (8, "tie tie tie tie tie")]


def test_packing_keeps_ids_and_fills_sequences(spark):
    from tokenizers import Tokenizer

    rows = [*ODD, *((100 + i, f"text number {i} <|endoftext|> " * (i % 90)) for i in range(150)), (999, " " * 70_000)]
    got = packing.pack(docs_of(spark, rows), size=64, end_id=0, group=50).toPandas()
    slow = Tokenizer.from_file(packing.default_ranks().removesuffix(".tiktoken") + ".json")
    want = []
    for doc_id, text in rows:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        start, stop, k = 0, len(ids) % 64 or 64, 0
        while start < len(ids):
            want.append((-1 if doc_id is None else doc_id, k, start, stop - start, zlib.crc32(np.asarray(ids[start:stop], "<u4").tobytes())))
            start, stop, k = stop, stop + 64, k + 1
    have = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int)
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= 1.03 * got["length"].sum() / 64 + 8


def test_best_two_fit_is_close_to_the_bound():
    lengths = np.random.default_rng(1).integers(1, 2049, 3000)
    bins, at, used = packing.best_two_fit(lengths, 2048)
    assert used <= 1.02 * lengths.sum() / 2048 + 1
    assert np.bincount(bins, lengths).max() <= 2048


def jaccard_rows(rows, n, num, den):
    """(set size, first row of the component) of each row, by position; rows are ordered by id, null last, then text."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    return [(len(sets[i]), root(i)) for i in range(len(rows))]


def jaccard_brute(rows, n, num, den):
    got = jaccard_rows(rows, n, num, den)
    least = {}
    for (i, _), (_, r) in zip(rows, got):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return {(i, size, least[r]) for (i, _), (size, r) in zip(rows, got)}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
@pytest.mark.parametrize("most", [10_000, 20])
def test_jaccard_join_finds_every_link(spark, monkeypatch, n, num, most):
    monkeypatch.setattr(ngram_join, "MOST_SETS", most)  # 20: large classes go block by block
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    rows, shared = [], rnd.choices(words, k=12)
    for g in range(12):
        base = rnd.choices(words, k=rnd.choice([3, 8, 30, 120, 300]))
        for _ in range(12):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(text) // 40))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), " ".join((shared if g % 2 else []) + text)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "Same  Words"), (len(rows) + 3, "same words")]
    got = ngram_join.jaccard_components(docs_of(spark, rows), n, num, 100).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == jaccard_brute(rows, n, num, 100)


def test_signatures_meet_for_all_close_sets():
    rnd = np.random.default_rng(5)
    bands = ngram_join.Bands(80, 100)
    for size in (5, 9, 14, 22, 40, 90, 200, 700):
        for _ in range(25):
            h = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
            common = np.sort(rnd.choice(h, int(len(h) * rnd.choice([0, 0.3, 0.95])), replace=False))
            out = int(rnd.integers(0, len(h) // 9 + 1))
            other = np.unique(np.concatenate([rnd.permutation(h)[out:], rnd.integers(0, 2**63, out).astype(np.uint64)]))
            both = len(np.intersect1d(h, other))
            if 100 * both >= 80 * (len(h) + len(other) - both) and len(np.setdiff1d(h, other)):
                assert np.intersect1d(ngram_join.signatures(h, bands, common), ngram_join.signatures(other, bands, common)).size


CLASHES = "doc_id long, text string, _text_hash string, _cuts string, node long, class string, first_id long, text_key long, doc string, groups string"


@pytest.mark.parametrize("most,cast", [(10_000, 500_000), (20, 500_000), (10_000, 0)])
def test_jaccard_join_of_repeated_and_null_ids(spark, monkeypatch, most, cast):
    monkeypatch.setattr(ngram_join, "MOST_SETS", most)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", cast)
    rnd = random.Random(most + cast)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, None), (None, ""), (None, None), (9, ""), (9, ""), (9, "lone"), (None, "lone"), (9, "Lone")]
    for g in range(8):
        base = rnd.choices(words, k=rnd.choice([4, 40, 150]))
        for _ in range(30):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(text) // 20))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows += [(rnd.choice([None, rnd.randint(0, 40), g]), " ".join(text))] * rnd.choice([1, 1, 1, 3])
    docs = spark.createDataFrame([(i, t, "h", "c", 1, "k", 2, 3, "d", "g") for i, t in rows], CLASHES).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, 5, 80, 100).collect()), key=repr)
    classes = jaccard_rows(rows, 5, 80, 100)
    least = {}
    for (i, _), (_, r) in zip(rows, classes):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    assert got == sorted(((i, size, least[r]) for (i, _), (size, r) in zip(rows, classes)), key=repr)
    left = ngram_join.one_of_each(docs, 5, 80, 100)
    assert left.schema == docs.schema
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    # one row of each class, that of its smallest id; empty rows each once by id and text
    ids = {}
    for (i, t), (size, r) in zip(rows, classes):
        ids.setdefault(("empty", i, t) if not size else r, set()).add((i is None, i or 0))
    assert len(kept) == len(ids) and len(set(kept)) == len(kept) and set(kept) <= set(rows)
    assert sorted((i is None, i or 0) for i, _ in kept) == sorted(min(x) for x in ids.values())


def test_null_ids_cost_no_products(spark):
    rows = [(None, f"a{k % 700} b{k % 700} c{k % 700} d{k % 700} e{k % 700} f{k % 700}" + " x" * (k // 700)) for k in range(1400)]
    assert ngram_join.jaccard_components(docs_of(spark, rows), 5, 80, 100).count() == 1400


def test_jaccard_join_of_odd_rows(spark):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs_of(spark, ODD), 4, 85, 100).collect())
    assert len(got) == len(ODD) and (2, 0, 2) in got and (8, 1, 7) in got
    kept = ngram_join.one_of_each(docs_of(spark, ODD)).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 2, 3, 4, 5, 6, 7]
    assert ngram_join.jaccard_components(docs_of(spark, ODD).limit(0)).count() == 0


def test_decontamination_finds_edited_copies_only(spark):
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=30))) for i in range(8)] + [(98, None), (99, "two words")]
    rows = []
    for k in range(80):
        text = rnd.choices(words, k=200)
        if k % 2:
            copy = items[k % 8][1].split()
            for _ in range(3):
                copy[rnd.randrange(len(copy))] = "changed"
            text[50:50] = copy
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for most in (8_000_000, 500):  # 500: the benchmark in slices
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(spark, rows + ODD), bench, most=most).collect()}
        assert got == {(k, k % 8) for k in range(80) if k % 2}
    left = decontamination.decontaminate(docs_of(spark, rows + ODD), bench)
    assert left.count() == 40 + len(ODD) and left.columns == docs_of(spark, ODD).columns
    assert decontamination.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_finds_lone_copies_whatever_their_seeds(spark):
    rnd = random.Random(12)
    words = [f"v{i}" for i in range(3000)]
    items = {size: rnd.choices(words, k=size) for size in (30, 38, 59)}
    halves = rnd.choices(words, k=40)
    rows = [(size, [*rnd.choices(words, k=80), *("changed" if k % 5 == 4 else w for k, w in enumerate(item)), *rnd.choices(words, k=80)]) for size, item in items.items()]
    rows += [(1000 + k, [*rnd.choices(words, k=50), *halves[:21], *rnd.choices(words, k=50)]) for k in range(20)]  # the commoner half of the item
    rows += [(2000, [*rnd.choices(words, k=50), *halves[19:]])]
    rows += [(3000, [x for k, w in enumerate(items[30]) for x in ((w, "put", "in") if k % 3 == 2 and k < 24 else (w,))])]  # 16 words put in
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (7, " ".join(halves))], "item_id long, text string")
    docs = docs_of(spark, [(i, " ".join(w)) for i, w in rows])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(30, 30), (38, 38), (59, 59), (2000, 7), (3000, 30), *((1000 + k, 7) for k in range(20))}
    assert got[30, 30] == pytest.approx((2 * 24 - 5) / 60) and got[3000, 30] == pytest.approx((2 * 30 - 16) / 60)
    assert decontamination.decontaminate(docs, bench).count() == 0


def test_decontamination_finds_excerpts_of_long_items(spark):
    rnd = random.Random(14)
    words = [f"v{i}" for i in range(3000)]
    item = rnd.choices(words, k=500)
    around = lambda part: " ".join([*rnd.choices(words, k=40), *part, *rnd.choices(words, k=40)])
    edited = ["changed" if k % 10 == 5 else w for k, w in enumerate(item[300:370])]
    docs = docs_of(spark, [(1, around(item[100:300])), (2, around(item[:50])), (3, around(edited)), (4, around(item[200:245])), (5, around([]))])
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {1, 2, 3} and got[1] == pytest.approx(0.4, abs=0.01)
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()} == {4, 5}


def test_bounds_leave_out_no_alignment_through_a_seed():
    def onwards(a, b):  # the best alignment of beginnings
        h = [[-i - j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rnd = random.Random(13)
    found = 0
    for _ in range(300):
        words = [f"v{i}" for i in range(rnd.choice([3, 8, 40]))]
        item = rnd.choices(words, k=rnd.randint(3, 14))
        text = rnd.choices(words, k=rnd.randint(0, 40))
        copy = [x for w in item for x in rnd.choice([[w], [w], [w], [w, "in"], ["other"], []])]
        text[len(text) // 2 : len(text) // 2] = copy
        seeds = [(k, p) for k in range(len(item) - 2) for p in range(len(text) - 2) if item[k : k + 3] == text[p : p + 3]]
        through = max((6 + onwards(item[:k][::-1], text[:p][::-1]) + onwards(item[k + 3 :], text[p + 3 :]) for k, p in seeds), default=0)
        ids = {w: i for i, w in enumerate(words, 1)}
        most = decontamination.align([ids[w] for w in item], [ids.get(w, 0) for w in text])[0]
        got = [x[1] for x in decontamination.Items([(1, " ".join(item))], 3).leaks(text, 0.5)]
        assert len(got) == 1 if through >= len(item) else not got or most >= len(item)
        assert all(max(through, len(item)) <= round(2 * len(item) * x) <= most for x in got)
        found += len(got)
    assert found > 50


def test_alignment_is_smith_waterman():
    def brute(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rnd = random.Random(4)
    for _ in range(200):
        a, b = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))], [rnd.randint(0, 4) for _ in range(rnd.randint(0, 20))]
        assert decontamination.align(a, b)[0] == brute(a, b)


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["</s>", "[INST] ", " [/INST]", "\\", "<s>", " </s>", "[SYS]", "[TURN ", " [/TURN]", "] ", "a", "é", "\n", " ", ""]
    rows = []
    for conv in range(300):
        for turn in range(rnd.randint(1, 5)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "tool] \\x", None]), rnd.choice([None, "".join(rnd.choices(bits, k=5))]), "extra"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(df)).collect()}
    for conv in range(300):
        turns = [(r or "", t or "") for _, _, r, t in sorted(((c, n, r or "", t or "") for c, n, r, t, _ in rows if c == conv))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(turns), len(loss))
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def labelled_docs(spark, bad):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choices(words, k=30) + (bad(rnd) if i % 3 == 0 else []))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0), "x") for i, _ in rows if i % 7] + [(5, None, None, "x"), (10**9, 1, 1, "x")], "doc_id long, toxic int, quality int, text string")
    return docs_of(spark, rows + ODD), labels, rows


@pytest.mark.parametrize("column", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, column):
    docs, labels, rows = labelled_docs(spark, lambda r: [r.choice(["nastier", "nasty", "vile"])] * 2 if column == "toxic" else ["%%% $$$ !!!"] * 30)
    run, fold, held = (toxicity.toxicity, 3, 1) if column == "toxic" else (quality.quality, 4, 2)
    got = [r for r in run(docs, labels).collect() if r["doc_id"] is not None]
    assert len(got) == len(rows) + len(ODD) - 1
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    own = [r for r in got if r["held_out"] and r["doc_id"] > 20]
    right = [(r["doc_id"] % 3 == 0) == (r["predicted"] == 1) if column == "toxic" else (r["doc_id"] % 3 != 0) == (r["predicted"] == 1) for r in own]
    assert np.mean(right) > 0.97
    assert {r["score"] for r in run(docs, labels.limit(0)).collect()} == {0.5}
    assert run(docs.limit(0), labels).count() == 0


def test_factorization_machine_learns_pairs():
    rnd = random.Random(1)
    terms = toxicity.Terms()
    texts, labels = [], []
    for _ in range(3000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join(["groupname"] * a + ["insultword"] * b + rnd.choices(["one", "two", "six"], k=1)))
        labels.append(float(a and b))
    model = toxicity.fit(np.array(labels), [toxicity.terms_of(t, terms) for t in texts])
    s = toxicity.scorer(model)(["groupname one", "insultword one", "groupname insultword one"])
    assert s[2] > 0.7 > max(s[:2])


def test_reject_toxic_keeps_columns(spark):
    docs, labels, _ = labelled_docs(spark, lambda r: ["nasty"] * 3)
    left = toxicity.reject_toxic(docs, labels)
    assert left.columns == docs.columns and 550 < left.count() < 650 + len(ODD)


def test_fingerprints_follow_the_next_document(spark):
    rnd = random.Random(6)
    rows = [(i * 3, " ".join(f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 120)))) for i in range(60)] + [(1000, None), (1001, "é" * 7)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_of(spark, rows), size=7).collect()}
    assert len(got) == len(rows)
    words = fingerprints.WordHashes()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, other, next_ = (fingerprints.fingerprint(x, words) for x in (t, changed, after))
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == own.astype(">u2").tobytes().hex()
        assert got[i]["near_edited"] == pytest.approx((own == other).mean()) and got[i]["near_next"] == pytest.approx((own == next_).mean())
    assert fingerprints.fingerprints(docs_of(spark, ODD)).count() == len(ODD)
    assert fingerprints.fingerprints(docs_of(spark, ODD).limit(0)).count() == 0
    assert fingerprints.fingerprints(docs_of(spark, [(1, "alone here")])).first()["near_next"] == 1.0


def test_slots_estimate_jaccard():
    a = np.arange(1, 1001, dtype=np.uint64)
    assert abs(fingerprints.likeness(fingerprints.slots(a), fingerprints.slots(a + np.uint64(500))) - 1 / 3) < 0.15


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_license_scan_by_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(120):
        words = [f"z{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 200))]
        if k % 3 == 0:
            words.insert(rnd.randint(0, len(words)), licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1])
        rows.append((k, " ".join(words)))
    want = {(k, licenses.TEMPLATES[k % len(licenses.TEMPLATES)][0]) for k, t in rows if k % 3 == 0}
    got = licenses.scan(docs_of(spark, rows + ODD)).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["containment"] == 1.0} == want
    for r in got:
        text = set(grams(tokens(rows[r["doc_id"]][1])))
        sought = set(grams(tokens(licenses.TEMPLATES[r["template_id"]][1])))
        assert len(text & sought) / len(sought) >= r["containment"] >= 0.8 and r["rank"] >= 1
    assert licenses.scan(docs_of(spark, ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs_of(spark, ODD), [("X", "too short")])


def test_license_scan_recall_of_edited_notices(spark):
    """Every (row, template) whose best run of words, twice the template long at most, contains 0.8 of its shingles."""
    rnd = random.Random(19)
    words = [f"t{i}" for i in range(400)]
    templates = [(f"L{k}", " ".join(rnd.choices(words, k=rnd.choice([9, 20, 45, 130, 600])))) for k in range(60)]
    templates.append(("L0", templates[0][1] + " and more of the same notice"))  # begins at the same word
    rows = []
    for k in range(240):
        text = templates[k % len(templates)][1].split()
        for _ in range(rnd.randint(0, max(1, len(text) // 18))):
            text[rnd.randrange(len(text))] = "edited"
        rows.append((k, " ".join([*rnd.choices(words, k=rnd.randint(0, 90)), *text, *rnd.choices(words, k=rnd.randint(0, 90))])))
    want = set()
    for i, text in rows:
        have = grams(tokens(text))
        for j, (_, t) in enumerate(templates):
            sought = set(grams(tokens(t)))
            if len(sought & set(have)) >= 0.8 * len(sought):
                m = len(grams(tokens(t)))
                if max(len(set(have[a : a + m]) & sought) for a in range(max(1, len(have) - m + 1))) >= 0.8 * len(sought):
                    want.add((i, j))
    table = spark.createDataFrame([(a, t, 1) for a, t in templates], "license string, text string, shingle int")
    for most in (licenses.MOST_BROADCAST, 0):  # 0: template shingles are shuffled
        got = licenses.scan(docs_of(spark, rows), table, most=most).join(table.select("license", F.xxhash64("license", "text").alias("template_id"), F.col("text").alias("template")), ["template_id", "license"]).collect()
        found = {(r["doc_id"], [t for _, t in templates].index(r["template"])) for r in got}
        assert len(found & want) >= 0.99 * len(want) > 100
        for i, j in found:
            sought = set(grams(tokens(templates[j][1])))
            assert len(sought & set(grams(tokens(rows[i][1])))) >= 0.8 * len(sought)


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def test_secret_spans_by_brute_force(spark):
    rnd = random.Random(11)
    bits = ["password: ", "TOKEN='", "api_key=", "secret", " = ", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", " ", "\n", "hunter2hunter2", "user=bob1", "https://db.example/x", "𝒳", "10.0.0.1:5432", ":", "="]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randint(0, 25)))) for i in range(400)] + ODD
    got = secrets.scan(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, (rx, ok)) in enumerate(BASE.items()) for m in rx.finditer(t or "") if ok(m))
        want.append((i or -1, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest(), *(sum(s[3] == n for s in spans) for n in BASE)))
    assert sorted((r["doc_id"] or -1, r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == sorted(want)


def test_weak_candidates_need_their_complement(spark):
    rows = [(1, "password=short1"), (2, "password=short1 at https://db.example/"), (3, "user=alice99"), (4, "user=alice99 password=short1"), (5, "password=short1" + " " * 300 + "https://db.example/"), (6, "https://db.example/")]
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(spark, rows)).collect()}
    assert spans[1] == spans[3] == spans[5] == spans[6] == ""
    assert spans[2] == "weak_secret:0:15,endpoint:19:38" and spans[4] == "weak_access:0:12,weak_secret:13:28"


@pytest.mark.parametrize("few", [secrets.FEW, 0])
def test_redaction_takes_effect(spark, few):
    rows = [(1, "x token=abcdefghijklmnop y"), (1, "x token=abcdefghijklmnop y"), (2, "clean"), (3, None), (None, "0123456789abcdef"), (4, "")]
    docs = docs_of(spark, rows).withColumns({"n_chars": F.length("text").cast("long"), "_cuts": F.lit(1), "_secret_id": F.lit(2), "doc": F.lit("d"), "found": F.lit(3), "spans": F.lit("s")})
    left = secrets.redact(docs, few=few)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in left.collect()), key=repr)
    assert got == sorted([(-1, "[SECRET]", 8), (1, "x [SECRET] y", 12), (1, "x [SECRET] y", 12), (2, "clean", 5), (3, None, None), (4, "", 0)], key=repr)
    assert secrets.redact(docs.limit(0), few=few).count() == 0


@pytest.mark.parametrize("piece", [4_096, 7])
def test_redaction_by_pieces_cuts_the_spans_of_the_scan(spark, monkeypatch, piece):
    monkeypatch.setattr(secrets, "PIECE", piece)
    rnd = random.Random(17)
    bits = ["password: ", "TOKEN='", "api_key=", "secret", " = ", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", " ", "\n", "hunter2hunter2", "user=bob1", "https://db.example/x", "𝒳", "10.0.0.1:5432", "pwd:", "="]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randint(0, 60)))) for i in range(150)]
    docs = docs_of(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    want = {}
    for i, t in rows:
        cuts = []
        for s in filter(None, spans[i].split(",")):
            start, end = map(int, s.split(":")[1:])
            if cuts and cuts[-1][1] > start:
                cuts[-1][1] = max(cuts[-1][1], end)
            else:
                cuts.append([start, end])
        out, at = "", 0
        for start, end in cuts:
            out, at = out + t[at:start] + "[SECRET]", end
        want[i] = out + t[at:]
    for few in (secrets.FEW, 3):
        assert {r["doc_id"]: r["text"] for r in secrets.redact(docs, few=few).collect()} == want
    assert all(n >= len(t.split(",")) for n, t in zip([r[0] for r in docs.orderBy("doc_id").select(secrets._most_matches(F.col("text"))).collect()], [spans[i] for i, _ in rows]) if t)


def test_native_operators_run_no_python(spark):
    for df in (licenses.scan(docs_of(spark, ODD)), secrets.scan(docs_of(spark, ODD)), secrets.redact(docs_of(spark, ODD))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan.split("Scan ExistingRDD")[0])


PAGE = "page_id long, url string, html string, digest string, key string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(9, "http://a.b/x y\r\n", "same"), (3, "http://a.b/", "same"), (5, None, None), (6, "http://[bad", ""), (7, "https://M.x.org:8080/p?q=1#f", "é\r\n\r\nWARC/1.1"), (7, "https://m.x.org:8080/p?q=1", "other"), (None, "http://n.ull/", "same")]
    rows += [(100 + i, f"http://h{i % 7}.example.com/p{i}", f"page {i % 40} " * 50) for i in range(120)]
    pages = spark.createDataFrame([(*r, "d", "k") for r in rows], PAGE).repartition(4)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", 10**9))
    for r in got:
        if r["page_id"] is not None and r["page_id"] != 7:
            html = next(h or "" for i, _, h in rows if i == r["page_id"])
            assert r["payload_bytes"] == len(html.encode()) and (r["record_type"] == "response") == (first[html] == r["page_id"])
            assert r["refers_to"] == (None if first[html] == r["page_id"] else first[html])
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, least_bytes=10**6, file_bytes=3_000)
    files = [p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")]
    assert len(files) > 8 and all(f.endswith(".warc.gz") for f in files)
    found = warc.captures(spark, path)
    assert found.count() == len(rows)
    keys = spark.createDataFrame([(warc.surt(u),) for _, u, _ in rows] + [("none",), ("zz",), (None,)], "key string")
    want = sorted((warc.surt(u), i or -1) for i, u, _ in rows)
    for block, top in ((1000, 50), (10, 50), (3, 2), (1, 1)):  # one directory, and up to seven levels
        index = warc.build_index(found, block=block if block > 1 else 2, most_top=top)
        hit = warc.lookup(index, keys).collect()
        assert sorted((h["key"], h["page_id"] or -1) for h in hit) == want
    one = next(h for h in hit if h["page_id"] == 103)
    assert warc.fetch(path, one["file"], one["offset"], one["length"])["payload"] == b"page 3 " * 50
    assert warc.surt("https://www.Example.com/a?b#c") == "com,example,www)/a?b"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_of_failed_attempts_go(tmp_path):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["http://a/", None], "html": ["x" * 10, ""], "digest": ["A", "B"], "refers_to": pa.array([None, None], pa.int64())})
    writer = warc.ArchiveWriter(str(tmp_path / "w"), 10)
    lost, kept = writer.write([rows]), writer.write([rows])
    assert len(kept.files) == 2
    writer.commit([kept, None])
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == sorted(kept.files) and lost.files


def test_sample_is_bounded(spark):
    assert labelled.sampled(spark.range(100).withColumnRenamed("id", "doc_id"), 7).count() == 7
