"""Ignore files against a plain reading of their rules."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from lixora.sources import ignore


def left(spark, files):
    rows = spark.createDataFrame([("r", p, c) for p, c in files.items()] + [("other", p, "") for p in files if not p.endswith(".gitignore")], "root string, path string, content string")
    got = ignore.not_ignored(rows).collect()
    assert {r["path"] for r in got if r["root"] == "other"} == {p for p in files if not p.endswith(".gitignore")}
    return {r["path"] for r in got if r["root"] == "r"}


@pytest.mark.parametrize(
    "rules,kept,gone",
    [
        ("*.log\n# a comment\n\n!keep.log", ["a.txt", "keep.log", "d/keep.log"], ["a.log", "d/e/b.log"]),
        ("/top\nsub/inner\nbuild/", ["d/top", "x/sub/inner/f", "build"], ["top", "top2/../top/x", "sub/inner/f", "d/build/f"]),
        ("out/\n!out/kept.txt", ["a"], ["out/kept.txt", "out/x", "d/out/y"]),
        ("out/*\n!out/kept.txt", ["out/kept.txt"], ["out/x", "out/d/kept.txt"]),
        ("**/deep/**\na/**/z\nfoo/**", ["deep", "foo", "b/a/z"], ["x/deep/f", "deep/f", "a/z", "a/b/c/z", "foo/x/y"]),
        ("a?c\n[!x]y\nf[0-9].t\n[z-a]q\n", ["ac", "a/c", "xy", "fa.t", "mq"], ["abc", "d/axc", "ay", "f7.t"]),
        ("\\#h\n\\!n\ntrail  \nblank\\ \n$^(+)", ["h", "n", "trail  x"], ["#h", "!n", "trail", "blank ", "$^(+)"]),
        ("*\n!*/\n!*.rs", ["a.rs", "d/b.rs"], ["a.txt", "d/e/x"]),
        ("", ["a"], []),
        ("[\n[a\nx[]]y", ["b"], ["[", "[a", "x]y"]),
    ],
)
def test_rules(spark, rules, kept, gone):
    paths = [p for p in kept + gone if ".." not in p]
    got = left(spark, {p: "" for p in paths} | {".gitignore": rules})
    assert got - {".gitignore"} == {p for p in kept if ".." not in p}


def test_nearest_file_wins(spark):
    files = dict.fromkeys(["a.log", "d/a.log", "d/e/a.log", "d/x.tmp", "d/e/x.tmp", "y/z.log", "y/.hidden"], "")
    files |= {".gitignore": "*.log\ny/", "d/.gitignore": "!a.log\n*.tmp", "d/e/.gitignore": "a.log\n!x.tmp", "y/.gitignore": "!z.log"}
    assert {p for p in left(spark, files) if not p.endswith(".gitignore")} == {"d/a.log", "d/e/x.tmp"}


def test_random_rules_against_plain_reading(spark):
    rnd = random.Random(12)
    names = ["a", "b", "ab", "c.x", "d.y"]
    paths = sorted({"/".join(rnd.choices(names, k=rnd.randint(1, 4))) for _ in range(120)})
    paths = [p for p in paths if not any(o.startswith(p + "/") for o in paths)]
    files = dict.fromkeys(paths, "")
    for d in ["", "a", "a/b", "ab"]:
        files[f"{d}/.gitignore".lstrip("/")] = "\n".join(rnd.choice(["", "!"]) + rnd.choice(["", "/"]) + rnd.choice(["a", "b", "*", "*.x", "a*", "?", "a/b", "*/b", "c.x"]) + rnd.choice(["", "/"]) for _ in range(5))

    def verdict(path, is_dir):
        out = None
        parts = path.split("/")
        for k in range(len(parts)):
            base = "/".join(parts[:k])
            for line in files.get(f"{base}/.gitignore".lstrip("/"), "").split("\n"):
                back, glob = line.startswith("!"), line.lstrip("!")
                if glob.strip("/") == "" or (glob.endswith("/") and not is_dir):
                    continue
                bare = glob.rstrip("/")
                rest = parts[k:]
                if "/" in bare:
                    want = bare.lstrip("/").split("/")
                    fits = len(want) == len(rest) and all(fnmatch.fnmatchcase(x, w) for x, w in zip(rest, want))
                else:
                    fits = fnmatch.fnmatchcase(rest[-1], bare)
                if fits:
                    out = not back
        return bool(out)

    def gone(path):
        parts = path.split("/")
        return any(verdict("/".join(parts[:k]), True) for k in range(1, len(parts))) or verdict(path, False)

    assert left(spark, files) == {p for p in files if not gone(p)}


def test_globs_are_sound_expressions(spark):
    rnd = random.Random(13)
    globs = ["".join(rnd.choices("ab*?[]!-^\\/.&{}()$", k=rnd.randint(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(g,) for g in globs], "g string").select("g", ignore.glob_regex(F.col("g")).alias("x"))
    assert rows.where(F.regexp(F.lit("a/b"), F.col("x"))).count() >= 0
    assert all(r["x"] is not None for r in rows.collect())
