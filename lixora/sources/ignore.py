"""Ignore files (.gitignore) as tables of rules, and which paths of a file corpus they leave out.

A rule is a regular expression on the path below its file's directory. The last rule of a file that fits a path counts,
and of the files above a path that have such a rule the nearest. A directory that is left out is closed: nothing
below it comes back, whatever other rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.operators.shared import cut, large, small
from lixora.sources.files import dir_of, name_of

IGNORE_FILE = ".gitignore"
#: Parts of a pattern: escaped characters, classes, ** in its three places, other wildcards, single characters.
TOKENS = r"\\.|\[[!^]?\]?[^\]]*\]|(?<=^|/)\*\*/|(?<=/)\*\*$|\*+|\?|."
#: Trailing blanks of a line that no backslash holds.
BLANKS = r"(?<!\\)[ \t]+$"


def _class(token: Column) -> Column:
    """A class such as [!a-z] as a regular expression; one with a range that runs backwards fits nothing."""
    negated = token.rlike(r"^\[[!^]")
    inner = F.regexp_replace(F.regexp_replace(token, r"^\[[!^]?|\]$", ""), r"([\[\]&\\^])", r"\\$1")
    ranges = F.regexp_extract_all(inner, F.lit(r".-."), F.lit(0))
    backwards = F.exists(ranges, lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)))
    body = F.concat(F.when(negated, "(?!/)[^").otherwise("(?!/)["), inner, F.lit("]"))
    return F.when(backwards, "(?!)").otherwise(body)


def glob_regex(pattern: Column) -> Column:
    """The regular expression of a glob; * and ? stop at slashes, ** in place of directories doesn't."""

    def of(t: Column) -> Column:
        literal = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
        return (
            F.when(t == "**/", "(?:.*/)?")
            .when(t.rlike(r"^\*\*+$"), F.lit(".*"))
            .when(t == "*", "[^/]*")
            .when(t == "?", "[^/]")
            .when(t.rlike(r"^\[.+\]$"), _class(t))
            .when(t.rlike(r"^\\.$"), literal(F.substring(t, 2, 1)))
            .otherwise(literal(t))
        )

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(TOKENS), F.lit(0)), of), "")


def ignore_rules(content: Column) -> Column:
    """array of struct(regex, only_dirs, back) of an ignore file, in order. back: the rule takes a path back in."""
    lines = F.transform(F.split(content, r"\r?\n"), lambda x: F.regexp_replace(x, BLANKS, ""))
    lines = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~x.isin("/", "!", "!/"))

    def of(line: Column) -> Column:
        back = F.startswith(line, F.lit("!"))
        glob = F.regexp_replace(line, r"^!", "")
        only_dirs = F.endswith(glob, F.lit("/"))
        bare = F.regexp_replace(glob, "/+$", "")
        anchored = F.contains(bare, F.lit("/"))
        regex = F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), glob_regex(F.regexp_replace(bare, "^/", "")), F.lit("$"))
        return F.named_struct(F.lit("regex"), regex, F.lit("only_dirs"), only_dirs, F.lit("back"), back)

    return F.transform(lines, of)


def above(path: Column) -> Column:
    """The directories above a path, outermost ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(root, path) of the files among paths(root, path) that ignore files leave out.

    rules(root, dir, rules): one row for each ignore file. Only roots with an ignore file take part. Files and the
    directories above them meet the ignore files above by an equi-join on (root, dir); the rules are broadcast up to a count.
    """
    rules = cut(rules.where(F.size("rules") > 0).groupBy("root", "dir").agg(F.flatten(F.sort_array(F.collect_list("rules"))).alias("rules")))
    files = paths.select("root", "path").distinct().join(small(rules.select("root").distinct()), "root", "left_semi")
    dirs = files.select("root", F.explode(above(F.col("path"))).alias("path")).where("path <> ''").distinct()
    nodes = files.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))
    asked = nodes.withColumn("dir", F.explode(above(F.col("path"))))
    met = asked.join(small(rules), ["root", "dir"])
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    fitting = F.filter("rules", lambda r: (F.col("is_dir") | ~r["only_dirs"]) & F.regexp(rest, r["regex"]))
    said = met.select("root", "path", "is_dir", F.length("dir").alias("depth"), F.get(F.reverse(fitting), F.lit(0))["back"].alias("back")).where("back is not null")
    out = cut(said.groupBy("root", "path", "is_dir").agg(F.max_by("back", "depth").alias("back")).where("not back"))
    closed = small(out.where("is_dir").select("root", F.col("path").alias("dir")))
    below = files.withColumn("dir", F.explode(above(F.col("path")))).join(closed, ["root", "dir"], "left_semi").select("root", "path")
    return out.where("not is_dir").select("root", "path").unionByName(below).distinct()


def rules_of(files: DataFrame) -> DataFrame:
    """(root, dir, rules) of the ignore files of a corpus (root, path, content)."""
    return files.where(name_of(F.col("path")) == IGNORE_FILE).select("root", dir_of(F.col("path")).alias("dir"), ignore_rules(F.col("content")).alias("rules"))


def not_ignored(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """files without those that the corpus's own ignore files leave out."""
    gone = ignored_paths(files, rules_of(files) if rules is None else rules)
    return files.join(large(gone), ["root", "path"], "left_anti")
