"""Operators 11 to 13 against plain Python, on small and odd inputs."""

import hashlib
import html
import itertools
import random

import numpy as np
import pytest

from lixora.llm import centroids, filters, html_text

VEC = "vec_id long, embedding array<float>, label int, v string, near string, cluster string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, 1, "v", "n", "c") for i, e in rows], VEC).repartition(3)


def slow_clusters(rows, dims, k, rounds):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    means = [v for _, v in first]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        means = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own) if o == c])] or m if c in own else m for c, m in enumerate(means)]
    placed = [(i, *place(v)) for i, v in kept]
    inertia = {}
    for _, d, c in placed:
        inertia[c] = inertia.get(c, 0) + d
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in placed)


def fast_clusters(spark, rows, *args):
    got = centroids.clustered(vectors_of(spark, rows), *args).collect()
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got)


def test_clusters_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=6) + (i % 5)]) for i in range(200)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (7, rows[7][1])]  # ties and repeats
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7), (604, [1.0] * 5 + [None]), (605, [float("nan")] * 6), (606, [float("inf")] + [0.0] * 5)]
    assert fast_clusters(spark, rows, 6, 9, 3) == slow_clusters(rows, 6, 9, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, -0.5]) for i in range(40)], [(i, [float(i % 2), 0.0]) for i in range(40)]])
def test_few_or_equal_vectors(spark, rows):
    assert fast_clusters(spark, rows, 2, 4, 3) == slow_clusters(rows, 2, 4, 3)


def test_bounds_never_exceed_distances_and_spare_work():
    rnd = np.random.default_rng(5)
    middles = rnd.integers(-60, 60, (16, 64))
    x = (middles[rnd.integers(0, 16, 5000)] + rnd.integers(-6, 6, (5000, 64))).astype(np.int64)
    pivots, centres = x[:16], x[100:116]
    pairs = centroids.pivot_pairs(pivots)
    assert len({p for pair in pairs for p in pair}) == 2 * len(pairs) == 16
    near = centroids.to_pivots(x, pivots)
    least = centroids.lower_bounds(near, centroids.to_pivots(centres, pivots), pivots, pairs)
    true = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (least <= np.sqrt(true)).all() and least.max() > 0
    own, best, exact = centroids.nearest(x, near, centres, pivots, pairs)
    assert (own == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert exact < 0.6 * true.size


def test_huge_components_are_told(spark):
    with pytest.raises(Exception, match="component is beyond"):
        centroids.clustered(vectors_of(spark, [(1, [1e30, 0.0])]), 2, 1, 1).collect()


PAGES = "page_id long, url string, html string, text string, n_chars string"
STORY = "".join(f"<p>Paragraph {i} tells, at some length, what happened on day {i}, and why it did.</p>" for i in range(6))
TOLD = " ".join(f"Paragraph {i} tells, at some length, what happened on day {i}, and why it did." for i in range(6))
LINKS = "".join(f"<li><a href='/{i}'>A rather long title of another page, number {i}, with commas, too</a></li>" for i in range(9))
CASES = {
    "article element": (f"<body><nav>{LINKS}</nav><article><h1>Head</h1>{STORY}</article><footer>Foot, foot, foot</footer>", f"Head {TOLD}"),
    "container by points": (f"<div id=top><ul>{LINKS}</ul></div><div id=x><h2>Head</h2><div>{STORY}</div></div><div>short</div>", f"Head {TOLD}"),
    "siblings": (f"<div><div>{STORY}</div><div>{STORY}</div><div><a href=x>{'link, ' * 60}</a></div></div>", f"{TOLD} {TOLD}"),
    "notices, adverts, comments": (f"<main><div class='cookie-notice'>We use, as all do, cookies.</div>{STORY}<aside>Aside, aside</aside><div class=adBox>Buy, buy</div><form><p>Name, please, and mail</p></form><section id='comments'><p>First, I say, first!</p></section></main>", TOLD),
    "layout word": (f"<body class='has-sidebar'><div class='content with-sidebar'>{STORY}</div><div class='sidebar'>{'side, ' * 40}</div>", TOLD),
    "only by class": ("<div class='widget'><p>All the text that there is, is here.</p></div>", "All the text that there is, is here."),
    "unclosed": ("<p>One, a first paragraph<p>Two &amp; <b>bold<br>line<p>Three</b> &lt;x&gt; &#8364;&nbsp;5 <a>y", "One, a first paragraph Two & bold line Three <x> € 5 y"),
    "raw and comments": (f"<script>if (a < b) '<p>no, no</p>'</script><!-- <p>no</p> --><style>p{{}}</style>{STORY}<!-- open <p>no</p>", TOLD),
    "header": (f"<header><h1>Site</h1></header><article><header><h1>Head</h1><p>by a writer</p></header>{STORY}</article>", f"Head {TOLD}"),
    "site header by class": (f"<div class='site-header'><h1>A site, about this, that, and more, with a long title</h1></div><div id=content><p>Short, but good, text, with enough commas, stands here alone.</p></div>", "Short, but good, text, with enough commas, stands here alone."),
    "site title beside": (f"<h1>Site</h1><div><h1>Head</h1>{STORY}</div>", f"Head {TOLD}"),
    "title above": (f"<h1>Head</h1><div><h2>Part</h2>{STORY}</div>", f"Head Part {TOLD}"),
    "search and disclaimer": (f"<div><div id=searchBox>Search, find, look</div>{STORY}<p class=disclaimer>No, nothing, at all</p><div class='post-comments'><p>Me, too, I say</p></div></div>", TOLD),
    "lists and quotes": (f"<article>{STORY}<ul><li>one<li>two</ul><blockquote>quote</blockquote><pre>a\n  b</pre><table><tr><td>c<td>d</table></article>", f"{TOLD} one two quote a b c d"),
    "quotes in tags": (f"<div title='a > b' class=\"x\">{STORY}</div>", TOLD),
    "text without tags": ("just text, no tags", "just text, no tags"),
    "hidden": (f"<article>{STORY}<p hidden>gone, gone</p><p style='display: none'>gone</p><div aria-hidden=true>gone</div></article>", TOLD),
    "empty": ("", ""),
    "null": (None, ""),
    "nothing": ("<html><body><nav>menu</nav><img src=x></body></html>", ""),
    "all links": (f"<ul>{LINKS}</ul>", ""),
    "unclosed tag": (f"{STORY}<a href='", TOLD),
    "stray ends": (f"</div></p></b><table><tr><td></div>{STORY}</td></tr></table>", TOLD),
}


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", page, "text", "n") for i, (page, _) in enumerate(CASES.values())] + [(None, None, "<p>no id</p>", "t", "n"), (0, "again", "<p>no id</p>", "t", "n")]
    got = html_text.extract(spark.createDataFrame(rows, PAGES).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    have = {r["url"]: (r["page_id"], r["text"], r["n_chars"]) for r in got.collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert have[f"u{i}"] == (i, want, len(want)), name
    assert have["again"] == (0, "no id", 5) and have[None] == (None, "no id", 5)
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 50_000 + STORY + "</div>" * 50_000
    assert html_text.main_text(deep) == TOLD
    for odd in ("<a " * 200_000, "<a b='" * 100_000, "<!-- " * 200_000, "</b>" * 200_000, "<b><i>" * 50_000 + "</b>" * 50_000, "<" * 200_000, "<p><li>" * 100_000, "& " * 200_000):
        assert html_text.main_text(f"{STORY}{odd}").startswith(TOLD)


def test_random_text_survives():
    rnd = random.Random(8)
    for _ in range(50):
        paragraphs = [" ".join("".join(rnd.choices("abcé<>&\"',. ", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 40))) for _ in range(5)]
        page = "<nav><a>menu</a></nav><article>" + "\n".join(f"<p>{html.escape(p)}</p>" for p in paragraphs) + "</article><footer>end</footer>"
        assert html_text.main_text(page) == " ".join(t for p in paragraphs if (t := " ".join(p.split())))


DOCS = "doc_id long, text string, source string, part string, mask int, good boolean, n long"
LABELS = "doc_id long, quality int, toxic int, part string, n long"


def slow_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    seen = {}
    for i, t, s in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t]]
        of = [x for x in labels if x[0] == i and i is not None]
        seen.setdefault(s or "", []).append((fails, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out = []
    for part, docs in seen.items():
        rows_, total = [], dict.fromkeys(range(5), 0)
        for order in itertools.permutations(range(5)):
            for k, f in enumerate(order):
                here = [d for d in docs if d[0][f]]
                lost = [d for d in here if not any(d[0][g] for g in order[:k])]
                kept = sum(not any(d[0][g] for g in order[: k + 1]) for d in docs)
                total[f] += len(lost)
                rows_.append((part, "".join("ABCDE"[g] for g in order), k + 1, kept, len(lost), len(here) - len(lost), sum(sum(d[0]) == 1 for d in here), sum(d[1] for d in lost), sum(d[2] for d in lost), f))
        out += [(*r[:-1], total[r[-1]]) for r in rows_]
    return sorted(out)


def fast_audit(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "p", 1, True, 2) for i, t, s in rows], DOCS).repartition(3)
    got = filters.audit(docs, spark.createDataFrame([(*x, "p", 1) for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, got.collect()))


def test_audit_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", "a b", "# x", "A" * 50, "w " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)), "\x1c" + " ".join(f"é{k}\x0b" for k in range(201)), "x\x00|" * 3]
    rows = [(rnd.randint(0, 60), rnd.choice(texts) if rnd.random() < 0.7 else " ".join(rnd.choices("abCD$", k=rnd.randint(1, 300))), rnd.choice([None, "", "web", "web", "web", "code"])) for _ in range(150)] + [(None, "a b", "web"), (None, None, None)]
    labels = [(rnd.randint(0, 60), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    assert fast_audit(spark, rows, labels) == slow_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert fast_audit(spark, [], []) == []
    assert len(fast_audit(spark, [(1, None, "s")], [])) == 600


def test_carry_save_counts():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 4, 100, 4097):
        words, times = rnd.integers(0, 2**32, n, dtype=np.uint32), rnd.integers(1, 70, n)
        want = [int(((words >> np.uint32(b)) & 1) @ times) for b in range(32)]
        assert filters.positional_popcount(words, times) == want
    assert [bin(int(w)).count("1") for w in filters.WORDS[[0, 1, 31]]] == [32, 16, 1]
