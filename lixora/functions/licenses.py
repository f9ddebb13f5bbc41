"""Licence text and licence id expressions. Everything here is a Column expression that Catalyst inlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alias rules in order, on upper(trim(x)): (exact names, [groups of parts that must all occur], parts that must not, result).
ALIASES = [
    (["MIT", "MIT LICENSE"], [], [], "MIT"),
    (["ISC", "ISC LICENSE"], [], [], "ISC"),
    (["0BSD", "BSD-ZERO-CLAUSE", "BSD ZERO CLAUSE"], [], [], "0BSD"),
    (["UNLICENSE", "THE UNLICENSE"], [], [], "Unlicense"),
    (["WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"], [], [], "WTFPL"),
    (["ZLIB", "ZLIB LICENSE"], [], [], "Zlib"),
    (["CC0", "CC0-1.0", "CC0 1.0", "CREATIVE COMMONS ZERO"], [], [], "CC0-1.0"),
    ([], [["APACHE", "2"]], [], "Apache-2.0"),
    ([], [["AGPL", "3"], ["AFFERO", "GPL", "3"]], [], "AGPL-3.0"),
    ([], [["GPL", "3"]], ["LGPL"], "GPL-3.0"),
    ([], [["GPL", "2"]], ["LGPL"], "GPL-2.0"),
    ([], [["LGPL", "3"]], [], "LGPL-3.0"),
    ([], [["LGPL", "2"]], [], "LGPL-2.1"),
    ([], [["MPL", "2.0"]], [], "MPL-2.0"),
    ([], [["BSD", "3"], ["BSD", "THREE"]], [], "BSD-3-Clause"),
    ([], [["BSD", "2"], ["BSD", "TWO"]], [], "BSD-2-Clause"),
]

#: Licence text rules in order, case-sensitive: id and alternative groups of parts that must all occur.
TEXT_RULES = [
    ("AGPL-3.0", [["GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3"]]),
    ("LGPL-3.0", [["GNU LESSER GENERAL PUBLIC LICENSE", "Version 3"]]),
    ("LGPL-2.1", [["GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1"]]),
    ("GPL-3.0", [["GNU GENERAL PUBLIC LICENSE", "Version 3"]]),
    ("GPL-2.0", [["GNU GENERAL PUBLIC LICENSE", "Version 2"]]),
    ("Apache-2.0", [["Apache License", "Version 2.0"]]),
    ("MPL-2.0", [["Mozilla Public License", "Version 2.0"]]),
    ("BSD-3-Clause", [["BSD", "Redistribution and use", "Neither the name"]]),
    ("BSD-2-Clause", [["BSD", "Redistribution and use"]]),
    ("OFL-1.1", [["SIL OPEN FONT LICENSE"], ["This Font Software is licensed under the SIL Open Font License"]]),
    ("MIT", [["MIT License"], ["Permission is hereby granted, free of charge", "associated documentation files"]]),
    ("ISC", [["ISC License"]]),
    ("Unlicense", [["This is free and unencumbered software released into the public domain"], ["unlicense.org"]]),
]

COMMENT_END = r"\s*(?:\*/|-->)?\s*$"


def all_in(col: Column, parts: list[str]) -> Column:
    return reduce(Column.__and__, [F.contains(col, F.lit(p)) for p in parts])


#: Parts beyond which a list is one array in the plan, not a term each.
LONG_LIST = 20


def any_in(col: Column, parts: list[str]) -> Column:
    """Whether any part occurs; null for null."""
    if len(parts) > LONG_LIST:
        return F.exists(F.lit(parts), lambda p: F.contains(col, p))
    return reduce(Column.__or__, [F.contains(col, F.lit(p)) for p in parts], F.lit(False))


def normalize_license_id(col: Column) -> Column:
    """Canonical id of a licence name: an ordered CASE; what matches nothing stays as it is."""
    up = F.upper(F.trim(col))
    out = None
    for names, groups, never, result in ALIASES:
        hit = up.isin(names) if names else reduce(Column.__or__, [all_in(up, g) for g in groups])
        if never:
            hit = hit & ~any_in(up, never)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(col)


def detect_license(col: Column, rules: list[tuple[str, list[list[str]]]] = TEXT_RULES) -> Column:
    """Id of the first rule that a licence text meets, or null."""
    hits = [F.when(reduce(Column.__or__, [all_in(col, g) for g in groups]), result) for result, groups in rules]
    return F.coalesce(*hits)


def detect_with_rules(col: Column, user_rules: list[tuple[str, list[str]]]) -> Column:
    """User marker rules (all markers must occur) in order, then the built-in rules."""
    return F.coalesce(*[F.when(all_in(col, markers), result) for result, markers in user_rules], detect_license(col))


def is_unresolved(col: Column) -> Column:
    """Null, blank, unknown, "unknown (...)" or "no license", in any case."""
    low = F.lower(F.trim(col))
    return col.isNull() | (low == "") | low.isin("unknown", "no license") | low.startswith("unknown (")


def is_stated(col: Column) -> Column:
    """A field that says something: not blank, NOASSERTION or NONE."""
    return F.coalesce(~F.upper(F.trim(col)).isin("", "NOASSERTION", "NONE"), F.lit(False))


#: What a compound expression holds one of.
COMPOUND = [" OR ", " AND ", " WITH ", "("]


def is_compound(col: Column) -> Column:
    return any_in(col, COMPOUND)


def is_license_id(col: Column) -> Column:
    """A bare id: letters, digits, dot, dash, plus and underscore."""
    return col.rlike(r"^[A-Za-z0-9.+_-]+$")


def is_expression(col: Column) -> Column:
    """A compound whose every word, parentheses aside, is an id or an operator."""
    return is_compound(col) & F.translate(col, "()", "  ").rlike(r"^\s*(?:[A-Za-z0-9.+_-]+\s*)*$")


#: Words of an expression that are no ids.
WORDS = ["(", ")", "AND", "OR", "WITH"]


def is_well_formed(col: Column) -> Column:
    """Whether every word of an expression has its place: ids with operators between them, an exception after WITH,
    parentheses to any depth (one that is opened may stay open). One fold over the words."""
    words = F.regexp_extract_all(F.trim(col), F.lit(r"[()]|[^ \t()]+"), F.lit(0))
    state = lambda ok, operand, depth, with_, skip: F.named_struct(F.lit("ok"), ok, F.lit("operand"), operand, F.lit("depth"), depth, F.lit("with_"), with_, F.lit("skip"), skip)
    yes, no = F.lit(True), F.lit(False)

    def step(s: Column, w: Column) -> Column:
        exception = s["skip"] & ~w.isin(WORDS)
        opens = s["operand"] & (w == "(")
        names = s["operand"] & ~w.isin(WORDS)
        closes = ~s["operand"] & (w == ")") & (s["depth"] > 0)
        joins = ~s["operand"] & w.isin("AND", "OR")
        excepts = ~s["operand"] & (w == "WITH") & ~s["with_"]
        next_ = state(
            opens | names | closes | joins | excepts,
            opens | joins,
            s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0),
            F.when(names | closes, no).when(excepts, yes).otherwise(s["with_"]),
            excepts,
        )
        return F.when(~s["ok"], s).when(exception, state(yes, no, s["depth"], s["with_"], no)).otherwise(next_)

    return F.aggregate(words, state(yes, yes, F.lit(0), no, no), step, lambda s: s["ok"] & ~s["operand"])


def spdx_header(col: Column, lines: int = 30) -> Column:
    """What follows the first SPDX-License-Identifier: that is an expression, in the first lines of a file."""
    head = F.slice(F.split(col, r"\r?\n"), 1, lines)
    tags = F.transform(F.filter(head, lambda x: F.contains(x, F.lit("SPDX-License-Identifier:"))), lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"SPDX-License-Identifier:(.*)$", 1), COMMENT_END, "")))
    return F.get(F.filter(tags, is_well_formed), F.lit(0))


def gnu_banner(col: Column) -> Column:
    """SPDX id of a GNU grant notice ("under the terms of the GNU ..."), its version, and whether later ones are granted."""
    bare = F.regexp_replace(col, r"(?m)^[ \t]*[/*#;!<-]*", "")
    flat = F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    has = lambda x: F.contains(flat, F.lit(x))
    affero, lesser = has("affero general public license"), has("lesser general public license") | has("library general public license")
    family = F.when(affero, "AGPL").when(lesser, "LGPL").when(has("general public license"), "GPL")
    unsaid = F.when(affero, "3.0").when(lesser, "2.1").otherwise("2.0")
    version = F.when(has("version 2.1"), "2.1").when(has("version 3"), "3.0").when(has("version 2"), "2.0").otherwise(unsaid)
    later = F.when(has("any later version"), "-or-later").otherwise("-only")
    return F.when(has("under the terms of the gnu"), F.concat(family, F.lit("-"), version, later))


def license_ref(col: Column) -> Column:
    """LicenseRef id that free text needs in an SPDX document; null for an id or an expression."""
    slug = F.regexp_replace(F.regexp_replace(col, "[^A-Za-z0-9.]+", "-"), "^-+|-+$", "")
    return F.when(~(is_license_id(col) | is_expression(col)), F.concat(F.lit("LicenseRef-"), slug))


def to_spdx_expression(col: Column) -> Column:
    """A licence as an SPDX document may state it, or NOASSERTION: the id alphabet, at most 100 characters, / as OR."""
    text = F.trim(col)
    empty = F.lower(text).isin("", "null", "undefined", "none", "-", "unlicensed", "proprietary") | (text == "n/a")
    said = F.regexp_replace(text, " / |/", " OR ")
    good = said.rlike(r"^[A-Za-z0-9.+() -]{1,100}$") & ~said.rlike(r"  |\.\.|--") & (F.trim(said) == said)
    return F.when(good & ~empty, said).otherwise("NOASSERTION")


#: Debian short names.
DEBIAN = {
    "expat": "MIT", "mit": "MIT", "mit/x11": "MIT", "x11": "MIT", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "bsd-4-clause": "BSD-4-Clause",
    "artistic": "Artistic-1.0", "artistic-2.0": "Artistic-2.0", "apache-2.0": "Apache-2.0", "mpl-1.1": "MPL-1.1", "mpl-2.0": "MPL-2.0", "cc0": "CC0-1.0", "cc0-1.0": "CC0-1.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0", "zlib": "Zlib", "zlib/libpng": "Zlib", "isc": "ISC", "python": "Python-2.0", "psf-2": "Python-2.0", "openssl": "OpenSSL", "boost": "BSL-1.0", "bsl-1.0": "BSL-1.0",
    "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0", "unlicense": "Unlicense", "wtfpl": "WTFPL", "wtfpl-2": "WTFPL",
}
#: Fedora short names.
FEDORA = {
    "asl 1.0": "Apache-1.0", "asl 1.1": "Apache-1.1", "asl 2.0": "Apache-2.0", "mit": "MIT", "mit/x11": "MIT", "bsd with advertising": "BSD-4-Clause", "modified bsd": "BSD-3-Clause",
    "mplv1.0": "MPL-1.0", "mplv1.1": "MPL-1.1", "mplv2.0": "MPL-2.0", "artistic 2.0": "Artistic-2.0", "artistic clarified": "Artistic-2.0", "boost": "BSL-1.0", "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0",
    "cddl": "CDDL-1.0", "cc0": "CC0-1.0", "python": "Python-2.0", "psf": "PSF-2.0", "psf-2.0": "PSF-2.0", "openssl": "OpenSSL", "sleepycat": "Sleepycat", "zlib": "Zlib", "zlib with acknowledgement": "Zlib",
    "isc": "ISC", "ofl": "OFL-1.1", "ijg": "IJG", "vim": "Vim", "unlicense": "Unlicense",
}


def _atom(col: Column, names: dict[str, str], gnu: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(col))), gnu, F.trim(col))


def _gnu(col: Column, pattern: str) -> Column:
    family, version, plus = (F.regexp_extract(F.trim(col), pattern, k) for k in (1, 2, 3))
    number = F.when(F.contains(version, F.lit(".")), version).otherwise(F.concat(version, F.lit(".0")))
    return F.when(family != "", F.concat(F.upper(family), F.lit("-"), number, F.when(plus == "+", "-or-later").otherwise("-only")))


def debian_atom(col: Column) -> Column:
    return _atom(col, DEBIAN, _gnu(col, r"^(?i:(agpl|lgpl|gfdl|gpl)-*([0-9][0-9.]*)(\+)?)$"))


def fedora_atom(col: Column) -> Column:
    bare = F.when(F.trim(col).rlike(r"^(?i:agpl|lgpl|gfdl|gpl)v*\+$"), F.concat(F.upper(F.regexp_extract(F.trim(col), "^([A-Za-z]+?)v*\\+", 1)), F.lit("-1.0-or-later")))
    return _atom(col, FEDORA, F.coalesce(bare, _gnu(col, r"^(?i:(agpl|lgpl|gfdl|gpl)v*([0-9][0-9.]*)(\+)?)$")))


#: Around the number of a group that stands for its text.
OPEN, SHUT = "\x01", "\x02"
GROUP = r"(?s)^(.*?)\(([^()]*)\)(.*)$"


def _nested(col: Column, flat) -> Column:
    """An expression with parentheses to any depth, translated from the inside out.

    flat translates an expression without parentheses, in which ``OPEN number SHUT`` is an operand. A fold takes one innermost
    group at a time: what it holds is translated and kept, a number takes its place; a group beside a name, as
    in "BSD (3 clause)", is part of the name. Text with a parenthesis too many stays as it is.
    """
    text = F.trim(col)
    state = lambda text, pieces: F.named_struct(F.lit("text"), text, F.lit("pieces"), pieces)
    groups = F.regexp_extract_all(text, F.lit(r"\("), F.lit(0))

    def step(s: Column, _: Column) -> Column:
        before, inner, after = (F.regexp_extract(s["text"], GROUP, k) for k in (1, 2, 3))
        operand = before.rlike(r"(?i)(?:^|\(|(?:^|\s)(?:and|or)\s)\s*$") & after.rlike(r"(?i)^\s*(?:$|\)|(?:and|or)\s)")
        piece = F.concat(F.lit("("), F.when(operand, F.coalesce(flat(inner), inner)).otherwise(inner), F.lit(")"))
        number = F.concat(F.lit(OPEN), F.size(s["pieces"]).cast("string"), F.lit(SHUT))
        return F.when(s["text"].rlike(GROUP), state(F.concat(before, number, after), F.concat(s["pieces"], F.array(piece)))).otherwise(s)

    def whole(s: Column) -> Column:
        numbers = F.transform(s["pieces"], lambda p, i: F.named_struct(F.lit("n"), F.concat(F.lit(OPEN), i.cast("string"), F.lit(SHUT)), F.lit("p"), p))
        # an outer group was taken after those inside it
        return F.when(s["text"].rlike(r"[()]"), text).otherwise(F.aggregate(F.reverse(numbers), flat(s["text"]), lambda done, x: F.replace(done, x["n"], x["p"])))

    return F.when(F.contains(text, F.lit("(")), F.aggregate(groups, state(text, F.array().cast("array<string>")), step, whole)).when(F.contains(text, F.lit(")")), text).otherwise(flat(text))


def _said(parts: Column) -> Column:
    """Names that say something."""
    return F.filter(parts, lambda p: (F.trim(p) != "") & (F.lower(F.trim(p)) != "unknown"))


def normalize_debian(col: Column) -> Column:
    """Debian short names to SPDX; blank and unknown are null. or binds loosest, as in SPDX; parentheses stay."""

    def flat(text: Column) -> Column:
        branch = lambda b: F.array_join(F.transform(_said(F.split(b, "(?i) and ")), debian_atom), " AND ")
        return F.nullif(F.array_join(F.filter(F.transform(F.split(text, "(?i) or "), branch), lambda b: b != ""), " OR "), F.lit(""))

    return _nested(col, flat)


def normalize_rpm(col: Column) -> Column:
    """Fedora short names to SPDX; blank and unknown are null. and binds loosest there, so branches of or are put in
    parentheses, and those of the text stay, but for a pair around all of it."""

    def flat(text: Column) -> Column:
        branch = lambda b: F.array_join(F.transform(_said(F.split(b, "(?i) or ")), fedora_atom), " OR ")
        done = F.filter(F.transform(F.split(text, "(?i) and "), branch), lambda b: b != "")
        grouped = F.transform(done, lambda b: F.when((F.size(done) > 1) & F.contains(b, F.lit(" OR ")), F.concat(F.lit("("), b, F.lit(")"))).otherwise(b))
        return F.nullif(F.array_join(grouped, " AND "), F.lit(""))

    return _nested(F.regexp_replace(F.trim(col), r"^\(([^()]*)\)$", "$1"), flat)


#: Last part of a Python licence classifier and its SPDX id.
CLASSIFIERS = {
    "MIT License": "MIT",
    "MIT No Attribution License (MIT-0)": "MIT-0",
    "Apache Software License": "Apache-2.0",
    "BSD-2-Clause": "BSD-2-Clause",
    "Simplified BSD License": "BSD-2-Clause",
    "BSD-3-Clause": "BSD-3-Clause",
    "New BSD License": "BSD-3-Clause",
    "ISC License (ISCL)": "ISC",
    "GNU General Public License v2 (GPLv2)": "GPL-2.0-only",
    "GNU General Public License v2 or later (GPLv2+)": "GPL-2.0-or-later",
    "GNU General Public License v3 (GPLv3)": "GPL-3.0-only",
    "GNU General Public License v3 or later (GPLv3+)": "GPL-3.0-or-later",
    "GNU Lesser General Public License v2 (LGPLv2)": "LGPL-2.0-only",
    "GNU Lesser General Public License v2 or later (LGPLv2+)": "LGPL-2.0-or-later",
    "GNU Lesser General Public License v3 (LGPLv3)": "LGPL-3.0-only",
    "GNU Lesser General Public License v3 or later (LGPLv3+)": "LGPL-3.0-or-later",
    "GNU Affero General Public License v3": "AGPL-3.0-only",
    "GNU Affero General Public License v3 or later (AGPL v3+)": "AGPL-3.0-or-later",
    "Mozilla Public License 1.1 (MPL 1.1)": "MPL-1.1",
    "Mozilla Public License 2.0 (MPL 2.0)": "MPL-2.0",
    "Eclipse Public License 1.0 (EPL-1.0)": "EPL-1.0",
    "Eclipse Public License 2.0 (EPL-2.0)": "EPL-2.0",
    "Boost Software License 1.0 (BSL-1.0)": "BSL-1.0",
    "zlib/libpng License": "Zlib",
    "Python Software Foundation License": "Python-2.0",
    "The Unlicense (Unlicense)": "Unlicense",
    "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication": "CC0-1.0",
    "Universal Permissive License (UPL)": "UPL-1.0",
    "Academic Free License (AFL)": "AFL-3.0",
    "Artistic License": "Artistic-2.0",
    "PostgreSQL License": "PostgreSQL",
}


def classifier_license(col: Column) -> Column:
    """SPDX id that a trove classifier names, or null for a family."""
    table = F.create_map(*[F.lit(x) for kv in CLASSIFIERS.items() for x in kv])
    return F.element_at(table, F.trim(F.substring_index(col, " :: ", -1)))
