"""Package identity: package URLs, definition coordinates, names and versions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Package URL types by ecosystem, and other type names that are read.
ECOSYSTEMS = ["cargo", "npm", "golang", "pypi", "maven", "gem", "nuget", "cran", "conan", "deb", "rpm", "apk", "generic"]
ALSO_READ = {"crates": "cargo", "go": "golang"}
#: Type and provider of definition coordinates.
PROVIDERS = {"cargo": "crate/cratesio", "npm": "npm/npmjs", "pypi": "pypi/pypi", "maven": "maven/mavencentral", "gem": "gem/rubygems", "nuget": "nuget/nuget", "golang": "go/golang"}
DISTRO = ["deb", "rpm", "apk"]


def encode(col: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - . _ ~ alone."""
    return F.replace(F.replace(F.replace(F.url_encode(col), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def decode(col: Column) -> Column:
    """Percent-decoding; text with an invalid escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def encode_path(col: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(col, "/"), lambda s: s != ""), encode), "/")


def normalize_pypi(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[-_.]+", "-")


def coordinates(ecosystem: Column, name: Column) -> Column:
    """pkg:type/namespace/name without a version; null for a name that says nothing."""
    name = F.trim(name)
    low = F.lower(name)
    slash = lambda c: F.when(c.rlike("^[^/]+/."), F.concat(encode(F.substring_index(c, "/", 1)), F.lit("/"), encode(F.regexp_replace(c, "^[^/]*/", "")))).otherwise(encode(c))
    path = F.regexp_replace(low, "^/+|/+$", "")
    golang = F.when(F.contains(path, F.lit("/")), F.concat(encode_path(F.regexp_replace(path, "/[^/]*$", "")), F.lit("/"), encode(F.substring_index(path, "/", -1)))).otherwise(encode(path))
    maven = F.when(name.rlike("^[^:]+:."), F.concat(encode(F.substring_index(name, ":", 1)), F.lit("/"), encode(F.regexp_replace(name, "^[^:]*:", "")))).otherwise(encode(name))
    body = F.when(ecosystem == "golang", golang).when(ecosystem == "maven", maven).when(ecosystem == "npm", slash(low)).when(ecosystem.isin(DISTRO), slash(low)).when(ecosystem == "pypi", encode(normalize_pypi(name))).otherwise(encode(name))
    return F.when((name != "") & ecosystem.isin(ECOSYSTEMS), F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), body))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL; an empty version leaves the @ out."""
    v = F.trim(F.coalesce(version, F.lit("")))
    return F.concat(coordinates(ecosystem, name), F.when(v == "", "").otherwise(F.concat(F.lit("@"), encode(v))))


def parse_purl(col: Column) -> Column:
    """struct(ecosystem, name, version) of a package URL, or null. Qualifiers and subpath are dropped."""
    also = F.create_map(*[F.lit(x) for kv in ALSO_READ.items() for x in kv])
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of(rest: Column, kind: Column, parts: Column) -> Column:
        eco = F.coalesce(F.element_at(also, kind), F.when(kind.isin(ECOSYSTEMS), kind), F.lit("generic"))
        last = F.get(parts, F.size(parts) - 1)
        at = F.contains(last, F.lit("@"))
        version = F.when(at, decode(F.substring_index(last, "@", -1))).otherwise("")
        space = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), decode)

        def named(name: Column) -> Column:
            joined = F.when(F.size(parts) == 1, name).when(eco == "maven", F.concat(F.array_join(space, "."), F.lit(":"), name)).when(eco.isin("npm", "golang", *DISTRO), F.concat(F.array_join(space, "/"), F.lit("/"), name)).otherwise(name)
            return F.when(name != "", F.struct(eco.alias("ecosystem"), joined.alias("name"), version.alias("version")))

        good = (kind != "") & (F.size(parts) > 0) & F.contains(rest, F.lit("/"))
        return F.when(good, once(decode(F.when(at, F.regexp_replace(last, "@[^@]*$", "")).otherwise(last)), named))

    def split(rest: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(rest, "^[^/]*/?", ""), "/"), lambda s: s != "")
        return once(F.struct(F.lower(F.substring_index(rest, "/", 1)).alias("kind"), parts.alias("parts")), lambda x: of(rest, x["kind"], x["parts"]))

    return F.when(F.trim(col).rlike("^(?:pkg|PKG):"), once(F.regexp_replace(F.trim(col), "^(?:pkg|PKG):/*|[?#].*$", ""), split))


def is_release(version: Column) -> Column:
    """One concrete release: no range characters, at most 64 characters, a leading digit (after a v)."""
    v = F.trim(version)
    return (v != "") & (F.length(v) <= 64) & ~v.rlike(r"[\s^~*|,<>=()\[\]{}/\\]") & v.rlike("^v?[0-9]")


def cd_coordinate(ecosystem: Column, name: Column, version: Column) -> Column:
    """type/provider/namespace/name/revision, or null where definitions can't be asked for."""
    name, v = F.trim(name), F.trim(version)
    provider = F.element_at(F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv]), ecosystem)
    scoped = (ecosystem == "npm") & name.rlike("^@[^/]*/")
    grouped = (ecosystem == "maven") & F.contains(name, F.lit(":"))
    path = (ecosystem == "golang") & F.contains(name, F.lit("/"))
    space = F.when(scoped, F.substring_index(name, "/", 1)).when(grouped, F.substring_index(name, ":", 1)).when(path, F.replace(F.regexp_replace(name, "/[^/]*$", ""), F.lit("/"), F.lit("%2f"))).otherwise("-")
    base = F.when(scoped, F.regexp_replace(name, "^@[^/]*/", "")).when(grouped, F.regexp_replace(name, "^[^:]*:", "")).when(path, F.substring_index(name, "/", -1)).otherwise(name)
    revision = F.when((ecosystem == "golang") & ~v.startswith("v"), F.concat(F.lit("v"), v)).otherwise(v)
    good = (name != "") & ~((ecosystem == "maven") & ~grouped) & (space != "") & (base != "") & ~F.contains(base, F.lit("/")) & is_release(version)
    return F.when(good, F.concat(provider, F.lit("/"), space, F.lit("/"), base, F.lit("/"), revision))


def clean_version(version: Column, ecosystem: Column) -> Column:
    """The version a constraint names: npm, gem and conan prefixes dropped; for pypi the == or >= bound, else the first."""
    v = F.trim(version)
    bounds = F.transform(F.split(v, ","), lambda b: F.trim(b))
    exact = F.get(F.filter(bounds, lambda b: b.rlike("^(?:==|>=)")), F.lit(0))
    pypi = F.trim(F.regexp_replace(F.coalesce(exact, F.get(bounds, F.lit(0))), "^[=<>!~]+", ""))
    npm = F.trim(F.regexp_replace(v, r"^(?:\^|~|>=)\s*", ""))
    gem = F.regexp_replace(F.trim(F.regexp_replace(v, r"^(?:~>|>=|<=|=|>|<)\s*", "")), "-(?:x86|x64|arm|aarch64|java|universal).*$", "")
    conan = F.regexp_replace(v, "@.*$", "")
    return F.when(ecosystem == "npm", npm).when(ecosystem == "gem", gem).when(ecosystem == "pypi", pypi).when(ecosystem == "conan", conan).otherwise(v)


def parse_markers(col: Column) -> Column:
    """array of struct(variable, op, value) of an environment marker; clauses that aren't one are left out."""
    clause = r"^\(?\s*([A-Za-z_.]+)\s*(===|==|!=|<=|>=|~=|<|>|not in|in)\s*['\"]([^'\"]*)['\"]\s*\)?$"
    parts = F.transform(F.split(col, r"\s+and\s+"), lambda c: F.struct(F.regexp_extract(F.trim(c), clause, 1).alias("variable"), F.regexp_extract(F.trim(c), clause, 2).alias("op"), F.regexp_extract(F.trim(c), clause, 3).alias("value")))
    return F.filter(parts, lambda p: p["variable"] != "")


def parse_go_module(col: Column) -> Column:
    """struct(name, version) of a module token name@version; null for go and toolchain."""
    name = F.regexp_replace(col, "@[^@]*$", "")
    version = F.when(F.contains(col, F.lit("@")), F.substring_index(col, "@", -1)).otherwise("")
    return F.when(~name.isin("go", "toolchain", ""), F.struct(name.alias("name"), version.alias("version")))


def go_escape(col: Column) -> Column:
    """Module paths as they are stored: a capital is ! and its small letter."""
    return F.lower(F.regexp_replace(col, "([A-Z])", "!$1"))


def substitute_props(col: Column, props: Column) -> Column:
    """${x} replaced by props[x] (a map); unknown names stay."""
    names = F.array_distinct(F.regexp_extract_all(col, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))
    return F.aggregate(names, col, lambda acc, k: F.coalesce(F.replace(acc, F.concat(F.lit("${"), k, F.lit("}")), F.element_at(props, k)), acc))


def semver_key(col: Column) -> Column:
    """Sort key: semantic versions first, by numbers, a pre-release below its release; the rest by text."""
    text = F.regexp_replace(F.trim(col), "^v", "")
    shape = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda k: F.expr("null").cast("long") if k is None else F.when(text.rlike(shape), F.regexp_extract(text, shape, k)).cast("long")
    pre = F.when(text.rlike(shape), F.regexp_extract(text, shape, 4))
    keys = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.struct((~text.rlike(shape)).alias("other"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (F.coalesce(pre, F.lit("")) == "").alias("release"), F.array_join(keys, ".").alias("pre"), col.alias("raw"))


#: Names and prefixes that tell a package's home.
PYPI_PREFIXES, PYPI_NAMES = ["python-", "django-", "flask-", "pytest-", "py-"], ["requests", "numpy", "pandas", "click", "boto3"]
NPM_PREFIXES, NPM_NAMES = ["react-", "vue-", "angular-", "webpack-", "babel-", "eslint-", "express-", "node-"], ["express", "lodash", "axios", "moment"]


def package_page_url(name: Column, version: Column) -> Column:
    """A page about a package, by the look of its name and version; null if nothing fits."""
    starts = lambda prefixes: name.rlike("^(?:" + "|".join(prefixes) + ")")
    pypi = starts(PYPI_PREFIXES) | name.isin(PYPI_NAMES) | name.rlike("^(?=.*_)[a-z_]+$")
    npm = starts(NPM_PREFIXES) | name.isin(NPM_NAMES) | version.rlike(r"^[\^~]") | version.isin("latest", "next")
    at = lambda base, end="": F.concat(F.lit(base), name, F.lit(end))
    return (
        F.when(name == "", None)
        .when(F.contains(name, F.lit("/")) & F.contains(name, F.lit(".")), at("https://pkg.go.dev/"))
        .when(name.rlike("^@.*/"), at("https://www.npmjs.com/package/"))
        .when(pypi, at("https://pypi.org/project/", "/"))
        .when(npm, at("https://www.npmjs.com/package/"))
        .when(version.rlike("^[0-9]"), at("https://crates.io/crates/"))
    )
