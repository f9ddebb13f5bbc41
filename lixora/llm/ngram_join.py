"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word n-grams. Two documents link when |x & y| / |x | y| reaches a
threshold num/den. Sets are put into size bands; within a pair of neighbouring bands linked sets differ in
at most k shingles (Hamming distance). The shingle domain is cut into partitions and, inside each, into
cells; a signature is the part of a set that falls into one enumerated subset of cells. k differences can't
reach every subset, so linked sets share a signature. Steps, each a Spark stage:

1. every document: set size and a 64-bit digest of its set (equal sets are one node from here on);
2. shingles that many documents share are found in a sample, so that signatures can do without them;
   signatures of every set, combined within each chunk of input first (a chunk sends one row of a signature,
   however many copies it holds), dealt by signature, and joined to links "may be near";
3. connected components of those candidate links: classes that hold every true link;
4. inside each class an exact join (rarest-first prefixes with position bounds, links inside a known
   component skipped). A class over a bound is cut into blocks, and each block is joined together with a few
   sets of the class that every block gets; the blocks of near copies of one text are tied by these, and what
   is not tied to the largest component of its class is then joined with all blocks;
5. components of the exact links, and the first row (smallest doc_id, then text hash) of each.

Exact up to collisions of 64-bit hashes. Rows are told apart by doc_id and text hash, so rows that share an id,
or have none, link by their own texts. Null or blank text: empty set, linked with nothing. Repeated rows give as
many rows. A null doc_id links like any other and counts as larger than every id when the smallest id is taken.
Extra columns, whatever their names, are ignored (``one_of_each`` returns them); an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import GOLD, WordHashes, as_struct, connected_components, find, join_hot, mixed, partitions_for, saved

#: Signatures that a map task combines before it sends them on.
CHUNK = 400_000
#: Ways to cut the domain that a set tries before it keeps thin signatures.
WAYS = 6
#: Documents whose shingles tell which are common, and how many shingles one of them may have.
SAMPLE, SAMPLE_SHINGLES = 3_000, 10_000
#: Sets, and shingles in all, of one block of a class; the exact join of a small class or a block holds no more.
MOST_SETS, MOST_SHINGLES = 1_500, 1_000_000
#: Sets that every block of a large class gets.
PIVOTS = 4
#: Bytes of the sets that a map task sends on at a time: a set goes to as many groups as its class has blocks.
BATCH_BYTES = 8_000_000
#: Row keys (about 40 bytes each) are broadcast up to so many; beyond that texts are shuffled by their key.
MOST_BROADCAST = 500_000


def shingle_hashes(text: str | None, n: int, words_of: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; ASCII letters lowered, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    m = len(words)
    if not m:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words_of.__getitem__, words), np.uint64, m)
    if m < n:
        w, n = w[:, None], m
        h = np.full(1, 7 + m, np.uint64)
        for j in range(m):
            h = mixed(h * GOLD + w[j])
        return h
    h = w[: m - n + 1] * GOLD
    for j in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * GOLD + w[j : m - n + 1 + j]
    return np.unique(mixed(h))


def digest(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63


class Bands:
    """Size bands for a threshold num/den, and how far linked sets of bands j and j + 1 can be apart."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def reach(self, j: int) -> int:
        while len(self.low) < j + 3:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        high = self.low[j + 1] - 1
        return (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)


def _thin(mean: float, least: int) -> float:
    """Probability of fewer than ``least`` (1 or 2) elements where ``mean`` are expected."""
    return math.exp(-mean) * (1 + (least - 1) * mean)


@cache
def plan(k: int, low: int, least: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of at least ``low`` shingles within Hamming distance k.

    Sets that close differ by more than k2 in at most n1 - 1 - spare of the n1 partitions, so 1 + spare of these
    agree in some subset of n2 - k2 of their n2 cells.
    """
    if k <= 6:
        return 1, k + 2, k, 0
    if k <= 30:
        spare = 1 + k // 16
        return k // 4 + 1 + spare, 5, 3, spare
    spare = 2
    while spare < 1.1 * _thin(low / (k + 1 + spare), least) * (k + 1 + spare) + 2 and spare < k:
        spare += 1
    return k + 1 + spare, 1, 0, spare


@cache
def cells_of(n1: int, n2: int, k2: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the n2 cells each subset of n2 - k2 takes, as a 0/1 matrix, and a name for each subset of each partition."""
    subsets = list(combinations(range(n2), n2 - k2))
    taken = np.zeros((n2, len(subsets)), np.uint64)
    for i, c in enumerate(subsets):
        taken[list(c), i] = 1
    names = mixed(np.arange(n1 * len(subsets), dtype=np.uint64) + np.uint64(seed * 1_000_003)).reshape(len(subsets), n1)
    return taken, names


def without(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The elements of h that aren't in common; both are sorted."""
    if not len(common):
        return h
    return h[common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h]


def part_enum(h: np.ndarray, common: np.ndarray, scheme: int, k: int, low: int) -> np.ndarray:
    """Signatures such that sets within Hamming distance k (same scheme) share one.

    First way: of the shingles that aren't ``common`` (sets differ there by at most k, too), leaving out empty
    signatures. A set that has such in at most ``spare`` partitions can do so: another partition still agrees.
    One that has more goes on to further ways, which cut the domain of all shingles and leave out signatures of
    under two. The first way that suits either set of a pair holds a signature of both; a set that no way suits
    keeps all signatures of the last. Which shingles are common matters for speed alone, never for the result.
    """
    out = []
    for way in range(WAYS):
        held, least = (without(h, common), 1) if way == 0 else (h, 2)
        n1, n2, k2, spare = plan(k, low, least)
        seed = scheme * WAYS + way + 1
        place = mixed(held + np.uint64(seed * int(GOLD) % 2**64))
        cell = (place % np.uint64(n1 * n2)).astype(np.uint16 if n1 * n2 < 2**16 else np.int64)  # narrow ones sort fast
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=n1 * n2)
        ends = np.concatenate([[0], np.cumsum(counts)])
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(place)[order], dtype=np.uint64)])
        sums = (running[ends[1:]] - running[ends[:-1]]).reshape(n1, n2)
        counts = counts.astype(np.uint64).reshape(n1, n2)
        taken, names = cells_of(n1, n2, k2, seed)
        sig = mixed((sums @ taken).T + names)
        thin = (counts @ taken).T < least
        if thin.any(axis=0).sum() <= spare:
            out.append(sig[~thin])
            break
        out.append(sig.ravel() if way == WAYS - 1 else sig[~thin])
    return np.concatenate(out)


def signatures(h: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    j = bands.band(len(h))
    return np.concatenate([part_enum(h, common, i, k, bands.low[i]) for i in (j - 1, j) if i >= 0 and (k := bands.reach(i)) > 0] or [np.empty(0, np.uint64)])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) of every row; the first two tell rows with different texts apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def common_shingles(docs: DataFrame, sizes: DataFrame, n: int, most: int = SAMPLE, least: int = 3) -> np.ndarray:
    """Shingles that at least ``least`` different sets of a sample of ``most`` documents hold: passages that many
    documents share. The sample (lowest id hashes, one row of each) only steers the signatures."""
    held = sizes.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_shingles") <= SAMPLE_SHINGLES))
    chosen = held.groupBy("doc_id").agg(F.min("text_key").alias("text_key")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def fn(batches):
        words_of = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingle_hashes(t.as_py(), n, words_of).tobytes() for t in b.column("text")], pa.binary())], ["hashes"])

    texts = keyed(docs).join(F.broadcast(chosen), ["doc_id", "text_key"]).select("text")
    sets = [x.as_py() for x in texts.mapInArrow(fn, "hashes binary").distinct().toArrow().column("hashes")]
    if not sets:
        return np.empty(0, np.uint64)
    found, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_counts=True)
    return found[counts >= least]


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node) of every row; node: digest of the set, null if it is empty."""

    def fn(batches):
        words_of = WordHashes()
        for b in batches:
            sizes, nodes = [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, n, words_of)
                sizes.append(len(h))
                nodes.append(digest(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "text_key", "n_shingles", "node"])

    return keyed(docs).mapInArrow(fn, "doc_id long, text_key long, n_shingles long, node long")


def runs_to_edges(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sig, node sorted by both: where each sig begins, and the distinct links of nodes to the first of their sig."""
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    lead = np.repeat(node[first], np.diff(np.append(first, len(sig))))
    apart = node != lead
    pairs = np.unique(np.stack([node[apart], lead[apart]], axis=1), axis=0)
    return first, pairs[:, 0], pairs[:, 1]


def candidate_edges(docs: DataFrame, n: int, num: int, den: int, buckets: int, common: np.ndarray) -> DataFrame:
    """(a, b) nodes that share a signature, as stars."""
    bits = max(1, (buckets - 1).bit_length())
    width = 1 << bits
    schema = pa.schema([("bucket", pa.int64()), ("sigs", pa.binary()), ("nodes", pa.binary())])

    def packed(sig, node, salt):
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first, a, b = runs_to_edges(sig, node)
        sig, node = sig[first], node[first]
        cuts = np.searchsorted(sig >> np.uint64(64 - bits), np.arange(width + 1, dtype=np.uint64))
        rows = [(i, sig[cuts[i] : cuts[i + 1]].tobytes(), node[cuts[i] : cuts[i + 1]].tobytes()) for i in range(width) if cuts[i] < cuts[i + 1]]
        if len(a):
            rows.append((-1 - salt % width, a.tobytes(), b.tobytes()))
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema) if rows else None

    def fn(batches):
        words_of, bands, sigs, nodes, held, salt, seen = WordHashes(), Bands(num, den), [], [], 0, 0, set()
        for b in batches:
            for t, key in zip(b.column("text"), b.column("text_key").to_pylist()):
                if key in seen:
                    continue  # the text again
                seen.add(key)
                h = shingle_hashes(t.as_py(), n, words_of)
                if not len(h):
                    continue
                s = signatures(h, bands, common)
                d = digest(h)
                sigs.append(s)
                nodes.append(np.full(len(s), d, np.int64))
                held, salt = held + len(s), d & 0xFFFF
                if held >= CHUNK:
                    if (out := packed(np.concatenate(sigs), np.concatenate(nodes), salt)) is not None:
                        yield out
                    sigs, nodes, held = [], [], 0
        if held and (out := packed(np.concatenate(sigs), np.concatenate(nodes), salt)) is not None:
            yield out

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        one = np.frombuffer(b"".join(pdf["sigs"]), np.uint64)
        two = np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        if pdf["bucket"].iloc[0] < 0:
            pairs = np.unique(np.stack([one.view(np.int64), two], axis=1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        else:
            order = np.lexsort((two, one))
            _, a, b = runs_to_edges(one[order], two[order])
        parent: dict = {}
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            if (r := find(parent, x)) != (s := find(parent, y)):
                parent[max(r, s)] = min(r, s)
                out.append((x, y))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = keyed(docs).select("text", "text_key").mapInArrow(fn, "bucket long, sigs binary, nodes binary")
    return dealt.groupBy("bucket").applyInPandas(join, "a long, b long")


def exact_links(sets: list[np.ndarray], num: int, den: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among the sets (sorted distinct uint64 arrays), by position: a spanning forest of their components,
    less what is within one label, as sets of one label are known to be in one component."""
    count = len(sets)
    tokens, where, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, freq))] = np.arange(len(tokens))
    single = freq == 1
    ends = np.cumsum([len(s) for s in sets])[:-1]
    ids = np.split(where, ends)
    ranked = []
    for x in ids:
        r = rank[x]
        o = np.argsort(r)
        ranked.append((r[o], single[x][o]))
    lead: dict[int, int] = {}
    parent = [lead.setdefault(label, i) for i, label in enumerate(labels)] if labels else list(range(count))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    postings: dict[int, list[tuple[int, int]]] = {}
    out = []
    for x in sorted(range(count), key=lambda i: (len(sets[i]), i)):
        r, alone = ranked[x]
        size = len(r)
        prefix = size - -(-num * size // den) + 1
        shared = np.flatnonzero(~alone[:prefix])
        own, tried = root(x), set()
        for i in shared.tolist():
            for y, j in postings.get(int(r[i]), ()):
                if y in tried or root(y) == own:
                    continue
                other = len(ranked[y][0])
                need = -(-num * (size + other) // (num + den))
                if other * den < num * size or 1 + min(size - i, other - j) - 1 < need:
                    tried.add(y) if other * den < num * size else None
                    continue
                tried.add(y)
                both = len(np.intersect1d(r, ranked[y][0], assume_unique=True))
                if den * both >= num * (size + other - both):
                    out.append((x, y))
                    parent[own] = root(y)
                    own = root(x)
        for i in shared.tolist():
            postings.setdefault(int(r[i]), []).append((x, i))
    return out


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """rows, whose last column is binary, as batches of about ``most`` bytes; no more rows than that are held."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 100
        if size >= most:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held))), schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held))), schema=schema)


def links_within(docs: DataFrame, wanted: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b) of the links inside each group of ``wanted(doc_id, text_key, node, label, part, groups)``: a row joins
    the sets of each of its groups; the groups of one part share a task's data frame."""
    times = wanted.agg(F.sum(F.size("groups"))).first()[0] or 0
    wanted = F.broadcast(wanted) if times <= MOST_BROADCAST else wanted
    texts = keyed(docs)
    rows = texts.join(wanted, same_row(texts, wanted)).select("text", "node", "label", "part", "groups")
    schema = pa.schema([("part", pa.int64()), ("group", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("hashes", pa.binary())])

    most = BATCH_BYTES

    def copies(batches):
        words_of, seen = WordHashes(), set()
        for b in batches:
            for t, groups, node, label, part in zip(b.column("text"), b.column("groups"), *(b.column(k).to_pylist() for k in ("node", "label", "part"))):
                if node in seen:
                    continue  # the row again
                seen.add(node)
                h = shingle_hashes(t.as_py(), n, words_of)
                if len(h) and digest(h) == node:
                    data = h.tobytes()
                    for g in groups.as_py():
                        yield g if part is None else part, g, node, label, data

    def fn(batches):
        return in_batches(copies(batches), schema, most)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.drop_duplicates(["group", "node"]).groupby("group", sort=False):
            if len(g) > 1:
                nodes = g["node"].to_numpy()
                out += [(nodes[x], nodes[y]) for x, y in exact_links([np.frombuffer(s, np.uint64) for s in g["hashes"]], num, den, g["label"].tolist())]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    made = rows.mapInArrow(fn, "part long, group long, node long, label long, hashes binary")
    return made.groupBy("part").applyInPandas(join, "a long, b long")


def blocks_of(sets: Column, shingles: Column, share: float = 1) -> Column:
    return F.greatest(F.ceil(sets / (MOST_SETS * share)), F.ceil(shingles / (MOST_SHINGLES * share)), F.lit(1))


def block(count: Column) -> Column:
    return F.pmod(F.xxhash64("node"), count)


def verified_edges(docs: DataFrame, classes: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b) nodes that truly link: enough of the links in each class to tell its components."""
    members = saved(classes.join(nodes, "node").select("node", F.col("component").alias("class"), "doc_id", "text_key", "n"), "members")
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(PIVOTS)]
    weight = members.groupBy("class").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.array(*pivots).alias("pivots"))
    weight = saved(weight.withColumn("blocks", blocks_of(F.col("sets"), F.col("shingles"))), "weights")
    shingles, most = weight.agg(F.sum("shingles"), F.max("blocks")).first()
    if not shingles:
        return classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    parts = max(1, shingles // (MOST_SHINGLES // 4))
    small = F.col("blocks") == 1
    own = F.when(F.array_contains("pivots", F.col("node")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block(F.col("blocks"))))
    groups = F.when(small, F.array("class")).otherwise(F.transform(own, lambda b: F.xxhash64("class", b)))
    placed = join_hot(members, weight, "class", "sets")
    wanted = placed.select("doc_id", "text_key", "node", F.col("node").alias("label"), F.when(small, F.pmod("class", F.lit(parts))).alias("part"), groups.alias("groups"))
    links = links_within(docs, wanted, n, num, den)
    if most == 1:
        return links
    links = saved(links, "links")
    large = placed.where("blocks > 1").select("doc_id", "text_key", "node", "class", "n")
    tied = saved(large.join(connected_components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "tied")
    each = tied.groupBy("class", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    each = each.groupBy("class").agg(F.max(F.struct("sets", "label", "shingles")).alias("main"), F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles")).where("sets > main.sets")
    out_blocks = blocks_of(F.col("sets") - F.col("main.sets"), F.col("shingles") - F.col("main.shingles"), 0.5)
    each = saved(each.select("class", "sets", F.col("main.label").alias("main"), out_blocks.alias("outer"), blocks_of(F.col("main.sets"), F.col("main.shingles"), 0.5).alias("inner")), "outer")
    if each.isEmpty():
        return links
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    group = lambda kind, i, j: F.xxhash64("class", F.lit(kind), i, j)
    mine = block(F.col("outer"))
    of_outer = F.concat(F.transform(upto("outer"), lambda o: group(1, F.least(o, mine), F.greatest(o, mine))), F.transform(upto("inner"), lambda i: group(2, mine, i)))
    groups = F.when(F.col("label") == F.col("main"), F.transform(upto("outer"), lambda o: group(2, o, block(F.col("inner"))))).otherwise(of_outer)
    wanted = join_hot(tied, each, "class", "sets").select("doc_id", "text_key", "node", "label", F.lit(None).cast("long").alias("part"), groups.alias("groups"))
    return links.unionByName(links_within(docs, wanted, n, num, den))


def linked_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, first_id, first_key, n_same) of every row: the first row of its component."""
    spark = docs.sparkSession
    sizes = saved(set_sizes(docs, n), "sizes")
    first = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    nodes = sizes.where("node is not null").groupBy("node").agg(first(), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    nodes = saved(nodes.select("node", "first.doc_id", "first.text_key", "n", "rows"), "nodes")
    shingles = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    per_shingle = 3.4 * (den - num) / (den + num)  # signatures, as measured
    buckets = max(partitions_for(spark), int(shingles * per_shingle / 1_500_000) + 1)
    classes = connected_components(candidate_edges(docs, n, num, den, buckets, common_shingles(docs, sizes, n)))
    links = connected_components(verified_edges(docs, classes, nodes, n, num, den))
    tied = saved(nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node")), "tied")
    least = tied.groupBy("component").agg(first(), F.sum("rows").alias("n_same"), F.count("*").alias("sets"))
    least = saved(least.select("component", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "n_same", "sets"), "least")
    nodes = join_hot(tied.select("node", "rows", "component"), least, "component", "sets")
    nodes = saved(nodes.select("node", "rows", "first_id", "first_key", "n_same"), "firsts")
    out = ["doc_id", "text_key", "n_shingles", "first_id", "first_key", "n_same"]
    linked = join_hot(sizes.where("node is not null"), nodes, "node", "rows").select(*out)
    lone = sizes.where("node is null").withColumns({"first_id": F.col("doc_id"), "first_key": F.col("text_key"), "n_same": F.lit(1).cast("long")})
    return linked.unionByName(lone.select(*out))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_same) of every row: the smallest doc_id it reaches by links.

    n: words of a shingle; num/den: the least Jaccard similarity of a link. n_same: rows of the component.
    """
    return linked_rows(docs, n, num, den).select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), "n_same")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then of the smallest text hash. Rows that
    repeat id and text count as one, empty ones too; null ids equal each other.

    The keys of the rows that go, or of those that stay, are broadcast if one side is few; else texts are shuffled.
    """
    found = saved(linked_rows(docs.select("doc_id", "text"), n, num, den), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    kept = saved(found.where(stays).groupBy("doc_id", "text_key").agg(F.count("*").alias("times")), "kept")
    gone = saved(found.where(~stays).select("doc_id", "text_key").distinct(), "gone")
    whole = docs.select(as_struct(docs).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    few = lambda rows: F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows

    def apart(rows: DataFrame, how: str) -> DataFrame:
        rows = few(rows.select("doc_id", "text_key"))
        return whole.join(rows, same_row(whole, rows), how)

    more = kept.where("times > 1")
    if gone.count() <= MOST_BROADCAST:
        once = apart(gone.unionByName(more.select("doc_id", "text_key")), "left_anti")
    else:
        once = apart(kept.where("times = 1"), "left_semi")
    if more.isEmpty():
        return once.select("doc.*")
    return once.unionByName(apart(more, "left_semi").dropDuplicates(["doc_id", "text_key"])).select("doc.*")
