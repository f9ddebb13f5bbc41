"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found anywhere: ``assign`` (a value of 12 or more characters given to a password, token, ...),
``access`` (AKIA identifiers of 18 or more), ``hex`` (16 or more). Weak candidates, ``weak_secret`` (a value of
6 to 11), ``weak_access`` (a short AKIA identifier or a user name that is assigned) and ``endpoint`` (a URL, or
an address with a port), are reported only if a part that complements them lies within ``SCOPE`` characters:
a secret needs an access identifier or an endpoint, and these two need a secret.

A match's place comes from the lengths of the text between matches and of the matches before it, summed by a
window over the matches of one document; the interval join to the nearest part before and after is a window
too, so a document with many matches costs no pairs. Each document is one key, and only rows of a few numbers
are shuffled.

``redact`` finds the spans of a row that can hold no more than FEW matches within the row, and its text stays where
it is. Only other rows are dealt out: their spans by the same windows, their texts in pieces of PIECE characters.

Null text: empty, no spans. A row is scanned for itself: repeated rows give repeated results, null ids stay.
Offsets are code points, ends exclusive. Extra columns, whatever their names, are ignored by ``scan`` and returned
by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lixora.llm.common import as_struct, saved

SCOPE, LEAST_SECRET, LEAST_WEAK, LEAST_ACCESS = 200, 12, 6, 18
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"((?i:password|passwd|secret|token|api_?key)){VALUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
USER = rf"\b(?i:user(?:name)?|login|client_?id|account){VALUE}[A-Za-z0-9_.@-]{{3,}}"
ENDPOINT = r"\b(?:https?|ftp|jdbc|postgres|mysql|redis|mongodb)://[^\s\"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}\b"
#: Matches of a row that are linked within the row, and characters of a piece of a text that holds more.
FEW, PIECE = 2_000, 4_096
#: Of each kind: its pattern and what it is a part of. The order is that of spans with one start.
PATTERNS = {"assign": (ASSIGN, "secret"), "access": (ACCESS, "access"), "hex": (HEX, "secret"), "user": (USER, "access"), "endpoint": (ENDPOINT, "endpoint")}
BASE = ["assign", "access", "hex"]
NEEDS = {"secret": ["access", "endpoint"], "access": ["secret"], "endpoint": ["secret"]}


def _matches(text: Column, kind: str, rank: int) -> Column:
    """Every match: its kind, number, the characters since the match before, its own length, and its standing."""
    pattern, part = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    both = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("gap")), lambda x: x["m"].isNotNull())

    def row(x: Column, i: Column) -> Column:
        size = F.char_length(x["m"])
        if kind == "assign":
            value = F.char_length(F.regexp_extract(x["m"], pattern, 2))
            name = F.when(value >= LEAST_SECRET, F.lit("assign")).when(value >= LEAST_WEAK, F.lit("weak_secret"))
        elif kind == "access":
            name = F.when(size >= LEAST_ACCESS, F.lit("access")).otherwise(F.lit("weak_access"))
        else:
            name = F.lit("weak_access" if kind == "user" else kind)
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["gap"].cast("long").alias("gap"), size.cast("long").alias("size"), name.alias("kind"), F.lit(part).alias("part"))

    return F.transform(both, row)


def _found() -> Column:
    """The matches of every kind in ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.concat(*[_matches(text, kind, rank) for rank, kind in enumerate(PATTERNS)])


def _spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per match of rows(keys, row, found), and one of nulls for a row without any: keys, row, rank, kind,
    start, end, kept."""
    rows = rows.select(*keys, "row", F.explode_outer("found").alias("x")).select(*keys, "row", "x.*")
    rows = rows.repartition("row")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("i"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    real = rows.withColumn("part", F.when(F.col("kind").isNotNull(), F.col("part")))
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    near = {p: (F.max(F.when(F.col("part") == p, F.col("end"))).over(before) >= F.col("start") - SCOPE, F.min(F.when(F.col("part") == p, F.col("start"))).over(after) <= F.col("end") + SCOPE) for p in NEEDS}
    real = real.withColumns({f"near_{p}_{side}": F.coalesce(c, F.lit(False)) for p, sides in near.items() for side, c in enumerate(sides)})
    linked = F.lit(False)
    for p, others in NEEDS.items():
        for o in others:
            linked = linked | ((F.col("part") == p) & (F.col(f"near_{o}_0") | F.col(f"near_{o}_1")))
    return real.select(*keys, "row", "rank", "kind", "start", "end", (F.col("kind").isin(BASE) | linked).alias("kept"))


def _spans_within(found: Column) -> Column:
    """The same of one row's matches, as an array of (start, rank, kind, end) in order; the cost is quadratic."""

    def placed(x: Column) -> Column:
        end = F.aggregate(F.filter(found, lambda y: (y["rank"] == x["rank"]) & (y["i"] <= x["i"])), F.lit(0).cast("long"), lambda a, y: a + y["gap"] + y["size"])
        return F.struct((end - x["size"]).alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), end.alias("end"), x["part"].alias("part"))

    return F.filter(F.array_sort(F.transform(found, placed)), lambda s: s["kind"].isNotNull())


def _linked(spans: Column) -> Column:
    needs = lambda s, o: F.array_contains(F.element_at(F.create_map(*[x for p, q in NEEDS.items() for x in (F.lit(p), F.array(*map(F.lit, q)))]), s["part"]), o["part"])
    near = lambda s, o: (o["end"] >= s["start"] - SCOPE) & (o["start"] <= s["end"] + SCOPE)
    return F.filter(spans, lambda s: s["kind"].isin(BASE) | F.exists(spans, lambda o: needs(s, o) & near(s, o)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every row: counts of the base kinds, a digest of the base spans, and all spans as text."""
    each = F.when(F.col("kept"), F.struct("start", "rank", "kind", "end"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _found().alias("found"))
    rows = _spans(rows, ["doc_id"])
    rows = rows.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    base = F.filter("all", lambda s: s["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def _cuts(spans: Column) -> Column:
    """Spans in order as (start, end) with overlapping ones as one; the cost is quadratic."""
    one = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
    last = lambda a: F.element_at(a, -1)
    none = F.array().cast("array<struct<start:long,end:long>>")
    joins = lambda a, s: (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"])
    step = lambda a, s: F.when(joins(a, s), F.concat(F.slice(a, 1, F.size(a) - 1), one(last(a)["start"], F.greatest(last(a)["end"], s["end"])))).otherwise(F.concat(a, one(s["start"], s["end"])))
    return F.aggregate(spans, none, step)


def _without(text: Column, cuts: Column, mark: str) -> Column:
    """text with the mark in place of each cut; a cut that begins before the text has none."""
    begun = lambda s: F.when(s["start"] >= 0, F.lit(mark)).otherwise("")
    return F.aggregate(
        cuts,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"], F.lit(0)) - a["at"]), begun(s)).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )


def _redacted_by_pieces(rows: DataFrame, mark: str) -> DataFrame:
    """(row, text) of rows(row, text, found) with any number of matches."""
    spans = _spans(rows.select("row", "found"), []).where("kept")
    in_order = Window.partitionBy("row").orderBy("start", "rank")
    spans = spans.withColumn("reach", F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("reach") > F.col("start"), 0).otherwise(1)).over(in_order))
    cuts = spans.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    begin = F.col("piece") * PIECE
    cuts = cuts.select("row", F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE))).alias("piece"), "start", "end")
    cuts = cuts.select("row", "piece", F.struct((F.col("start") - begin).alias("start"), F.least(F.col("end") - begin, F.lit(PIECE)).cast("long").alias("end")).alias("cut"))
    cuts = cuts.groupBy("row", "piece").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    pieces = rows.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "part"))
    done = pieces.join(cuts, ["row", "piece"], "left").select("row", "piece", F.when(F.col("cuts").isNull(), F.col("part")).otherwise(_without(F.col("part"), F.col("cuts"), mark)).alias("part"))
    whole = done.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    return whole.select("row", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def _most_matches(text: Column) -> Column:
    """No text holds more matches: assignments have a sign each, addresses a colon."""
    count = lambda x: F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(x), F.lit("")))) / len(x))
    others = 3 * count(":") + 2 * count("=") + count("AKIA")
    return others + F.when(F.char_length(text) <= 16 * (FEW // 2), F.floor(F.char_length(text) / 16)).otherwise(F.regexp_count(text, F.lit("[0-9a-f]{16}")))


def redact(docs: DataFrame, mark: str = "[SECRET]", few: int = FEW) -> DataFrame:
    """docs with each reported span (overlapping ones as one) replaced in ``text``; other columns stay, n_chars of a
    changed text follows."""
    whole = docs.select(as_struct(docs).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    most = _most_matches(F.col("text"))
    short = whole.where(most <= few).withColumn("found", _found()).withColumn("spans", _spans_within(F.col("found")))
    short = short.withColumn("cuts", _cuts(_linked(F.col("spans")))).select("doc", F.when(F.size("cuts") > 0, _without(F.col("text"), F.col("cuts"), mark)).alias("text"))
    long = saved(whole.where(most > few).withColumn("row", F.monotonically_increasing_id()), "many_matches")
    done = _redacted_by_pieces(long.select("row", "text", _found().alias("found")), mark)
    both = short.unionByName(long.select("row", "doc").join(done, "row").select("doc", "text"))
    changed = F.coalesce(F.col("text") != F.col("doc")["text"].cast("string"), F.lit(False))
    made = {"text": F.col("text"), "n_chars": F.char_length("text")}
    column = lambda c: F.when(changed, made[c].cast(docs.schema[c].dataType)).otherwise(F.col("doc")[c]) if c in made else F.col("doc")[c]
    return both.select(*[column(c).alias(c) for c in docs.columns])
