"""Missing licences from snapshot tables, in order of precedence, and snapshot freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lixora.functions.ids import cd_coordinate
from lixora.functions.licenses import is_unresolved
from lixora.operators.shared import cut, large, look_up, quoted, small

#: What a definition says when it has no answer; days that snapshots count as fresh.
NO_ANSWER = ["NOASSERTION", "NONE", "OTHER", "UNKNOWN"]
REGISTRY_DAYS, DEFINITION_DAYS = 30, 7


def _answer(col: Column) -> Column:
    return F.when(~is_unresolved(col) & ~F.lower(F.trim(col)).startswith("unknown license"), col)


def _taken(df: DataFrame) -> DataFrame:
    """df with _answer, where there is one, as its licence."""
    return df.withColumn("license", F.coalesce("_answer", "license")).drop("_answer")


def resolve_from_registry(df: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Unresolved rows take the snapshot's licence of their version, else of "latest". Only they are looked up: each key that
    they ask for once, and rows that have a licence aren't shuffled (see ``look_up``)."""
    open_ = is_unresolved(F.col("license"))
    keys = df.where(open_).groupBy("ecosystem", "name", "version").agg(F.count("*").alias("times"))
    s = snapshot.groupBy("ecosystem", "name", "version").agg(F.max("license").alias("found"))
    latest = s.where("version = 'latest'").select("ecosystem", "name", F.col("found").alias("latest"))
    found = keys.join(large(s), ["ecosystem", "name", "version"], "left").join(large(latest), ["ecosystem", "name"], "left")
    answers = found.select(F.col("ecosystem").alias("k0"), F.col("name").alias("k1"), F.col("version").alias("k2"), "times", F.coalesce(_answer(F.col("found")), _answer(F.col("latest"))).alias("answer"))
    return _taken(look_up(df, [F.col("ecosystem"), F.col("name"), F.col("version")], cut(answers.where("answer is not null")), open_))


def resolve_from_definitions(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows still unresolved take the declared licence of their coordinate; looked up as by ``resolve_from_registry``."""
    open_ = is_unresolved(F.col("license"))
    coordinate = cd_coordinate(F.col("ecosystem"), F.col("name"), F.col("version"))
    told = definitions.where(~F.upper(F.trim("declared")).isin(NO_ANSWER) & (F.trim("declared") != "")).groupBy(F.col("coordinate").alias("k0")).agg(F.max("declared").alias("answer"))
    keys = cut(df.where(open_).groupBy(coordinate.alias("k0")).agg(F.count("*").alias("times")))
    return _taken(look_up(df, [coordinate], cut(large(keys).join(large(told), "k0")), open_))


def coalesce_sources(keys: list[str], *sources: DataFrame) -> DataFrame:
    """First non-null licence over ranked sources (keys, license)."""
    ranked = reduce(DataFrame.unionByName, [s.select(*keys, "license").withColumn("rank", F.lit(i)) for i, s in enumerate(sources)])
    return ranked.groupBy(*keys).agg(F.min_by("license", F.when(F.col("license").isNotNull(), F.struct("rank", "license"))).alias("license"))


def dedupe_deps(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per keys, that with the smallest ``by``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")


def fresh_snapshot(df: DataFrame, keys: list[str], as_of: Column, days: int, version: int) -> DataFrame:
    """Newest row per keys of this version, younger than ``days`` as of a time."""
    young = df.where((F.col("format_version") == version) & (F.col("fetched_at") <= as_of) & (F.col("fetched_at") > as_of - F.make_interval(days=F.lit(days))))
    return young.groupBy(*keys).agg(F.max_by("license", F.struct("fetched_at", "license")).alias("license"), F.max("fetched_at").alias("fetched_at"))


#: Rows of one package and time bucket beyond which its findings are dealt to several tasks.
BUSY = 200_000


def resolve_as_of(df: DataFrame, snapshots: DataFrame, keys: list[str], at: str, days: int = REGISTRY_DAYS, busy: int = BUSY) -> DataFrame:
    """Unresolved rows take the licence of the newest snapshot that was there, and fresh, at their own time.

    snapshots(keys, fetched_at, license). A snapshot counts from fetched_at on and is fresh for less than ``days``; the newest
    one decides, the largest licence of those of one time; snapshots that state no licence are none. Time is cut into
    buckets of ``days``: what is fresh at a time was fetched in its bucket or in the one before, so each bucket gets the
    last snapshot of that, and rows and snapshots of a package and bucket are merged in order of time. A package asked
    for by more than ``busy`` rows in a bucket is dealt to several tasks, each with all its snapshots there. Rows that have a
    licence, a null key or a null time stay where they are and as they are.
    """
    span = days * 86_400_000_000
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / span)
    asks = is_unresolved(F.col("license")) & F.col(quoted(at)).isNotNull()
    for k in keys:
        asks = asks & F.col(quoted(k)).isNotNull()
    own = [F.col(quoted(c)) for c in df.columns]
    names = [f"_k{i}" for i in range(len(keys))]
    asked = df.where(asks).select(F.struct(*own).alias("_row"), *[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col(quoted(at)).cast("timestamp").alias("_at")).withColumn("_bucket", bucket("_at"))
    said = snapshots.where(~is_unresolved(F.col("license"))).groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col("fetched_at").cast("timestamp").alias("_at")).agg(F.max("license").alias("_answer"))
    said = said.withColumn("_bucket", bucket("_at"))
    last = said.groupBy(*names, "_bucket").agg(F.max_by(F.struct("_at", "_answer"), "_at").alias("x")).select(*names, F.col("x._at").alias("_at"), F.col("x._answer").alias("_answer"), (F.col("_bucket") + 1).alias("_bucket"))
    said = said.select(*names, "_at", "_answer", "_bucket").unionByName(last)
    group = [*names, "_bucket"]
    slices = small(cut(asked.groupBy(*group).agg(F.ceil(F.count("*") / busy).cast("int").alias("_slices")).where("_slices > 1")))
    dealt = asked.join(slices, group, "left").withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.coalesce("_slices", F.lit(1)))).drop("_slices")
    copies = said.join(slices, group, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slices", F.lit(1)).cast("long") - 1))).drop("_slices")
    both = dealt.select(*group, "_slice", "_at", "_row", F.lit(None).cast("struct<at:timestamp,license:string>").alias("_said")).unionByName(copies.select(*group, "_slice", "_at", F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"), F.struct(F.col("_at").alias("at"), F.col("_answer").alias("license")).alias("_said")))
    order = Window.partitionBy(*group, "_slice").orderBy("_at", F.col("_said").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("_newest", F.last("_said", ignorenulls=True).over(order)).where("_row is not null")
    fresh = F.unix_micros("_newest.at") > F.unix_micros("_at") - span
    field = lambda c: F.when(fresh, F.col("_newest.license")).otherwise(F.col("_row")[c]) if c == "license" else F.col("_row")[c]
    found = merged.select(*[field(c).alias(c) for c in df.columns])
    return df.where(~asks).unionByName(found)


def snapshot_status(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows, characters, age in whole days of the newest row, and whether that is fresh."""
    age = F.date_diff(as_of, F.max("fetched_at")).alias("age_days")
    return df.agg(F.count("*").alias("entries"), F.sum(F.length("license")).alias("chars"), age).withColumn("fresh", F.col("age_days") < days)


def join_texts(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Licence text of each package, null where there is none."""
    return df.join(large(texts.select("ecosystem", "name", "version", "text")), ["ecosystem", "name", "version"], "left")


def apply_managed(deps: DataFrame, managed: DataFrame) -> DataFrame:
    """A dependency without a version takes the managed one of its project, else RELEASE."""
    m = managed.select("project_id", "name", F.col("version").alias("managed"))
    return deps.join(large(m), ["project_id", "name"], "left").withColumn("version", F.coalesce(F.when(F.trim("version") != "", F.col("version")), "managed", F.lit("RELEASE"))).drop("managed")


def join_licenses(df: DataFrame, keys: list[str], op: str) -> DataFrame:
    """Licences of a package joined by OR or AND in order of pos, repeats dropped; compounds in parentheses under AND."""
    part = F.col("license")
    if op == "AND":
        part = F.when(F.col("license").contains(" OR "), F.concat(F.lit("("), part, F.lit(")"))).otherwise(part)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("l")))), lambda s: s["l"])
    return df.where("license is not null").groupBy(*keys).agg(F.array_join(F.array_distinct(ordered), f" {op} ").alias("license"))


def pom_license(poms: DataFrame, hops: int = 5) -> DataFrame:
    """(pom, license): its own or the nearest parent's licence, at most ``hops`` parents up. poms(pom, parent, license)."""
    out = poms.select("pom", F.col("parent").alias("up"), "license")
    above = poms.select(F.col("pom").alias("up"), F.col("parent").alias("next"), F.col("license").alias("theirs"))
    for _ in range(hops):
        stop = F.col("license").isNotNull()
        out = out.join(large(above), "up", "left").select("pom", F.when(~stop, F.col("next")).alias("up"), F.coalesce("license", "theirs").alias("license"))
    return out.select("pom", "license")


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
