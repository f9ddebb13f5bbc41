"""What a scan needs of a file corpus, as one narrow table by path: the texts are read once, whatever is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.functions.licenses import detect_with_rules, gnu_banner, spdx_header
from lixora.operators.scan import LICENSE_FILES, file_rank
from lixora.operators.shared import cut
from lixora.sources.files import PRUNED, in_any, is_source_path, name_of
from lixora.sources.ignore import IGNORE_FILE, ignore_rules
from lixora.sources.manifests import SOURCES, TOML_SOURCES, kind_of, parsed_deps
from lixora.sources.toml import toml_json

NODE_COPY = r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+/package\.json$"
PYTHON_COPY = r"[^/]+\.(?:dist-info/METADATA|egg-info/PKG-INFO)$"
SHIPPED = r"\.dist-info/(?:licenses/)?LICEN[SC]E[^/]*$"


def stated_license(path: Column, content: Column, doc: Column) -> Column:
    """What a manifest in the root directory says the project's licence is. doc: a TOML file as JSON."""
    plain = lambda c: F.when(~F.startswith(c, F.lit("{")), c)
    toml = lambda *keys: F.coalesce(*[plain(F.get_json_object(doc, f"$.{k}")) for k in keys])
    node = F.when(path == "package.json", plain(F.get_json_object(content, "$.license")))
    cargo = F.when(path == "Cargo.toml", toml("package.license"))
    python = F.when(path == "pyproject.toml", toml("project.license", "project.license.text"))
    return F.nullif(F.trim(F.coalesce(node, cargo, python)), F.lit(""))


def corpus_evidence(files: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(root, path, kind, deps, said, tag, banner, stated, rules, text) of every file (root, path, content) that says something.

    kind, deps: of a manifest outside pruned directories, what it is and the packages it names; said: the licence of a
    licence file's text, user rules (id, markers) first; tag, banner: SPDX header and GNU banner of a source file; stated: the
    project's licence by a manifest of the root directory; rules: of an ignore file; text: the head of an installed
    package's metadata, and a Cargo.lock as JSON. Source files stay without evidence, too, as they are what a directory holds.
    """
    path, content = F.col("path"), F.col("content")
    tomls = [n for names, _ in TOML_SOURCES.values() for n in names]
    is_toml = name_of(path).isin(tomls)
    kind = F.when(~in_any(path, PRUNED), kind_of(path))
    rows = files.select("root", "path", "content", kind.alias("kind"), F.when(is_toml, toml_json(F.when(is_toml, content))).alias("doc"))
    source = is_source_path(path)
    licensed = file_rank(path).isNotNull() | path.rlike(SHIPPED)
    said = F.when(name_of(path).isin(LICENSE_FILES[-2:]), "OFL-1.1").when(licensed, detect_with_rules(content, rules or []))
    head = F.array_join(F.slice(F.split(content, r"\r?\n"), 1, 30), "\n")
    first = F.regexp_extract(content, r"(?s)^(.*?)(?:\n[ \t]*\n|\z)", 1)
    text = F.when(path.rlike(NODE_COPY), content).when(path.rlike(PYTHON_COPY), first).when(F.col("kind") == "Cargo.lock", F.col("doc"))
    facts = {
        "deps": parsed_deps(F.col("kind"), F.coalesce("doc", "content"), SOURCES),
        "said": said,
        "tag": F.when(source, spdx_header(content)),
        "banner": F.when(source, gnu_banner(head)),
        "stated": F.when(~F.contains(path, F.lit("/")), stated_license(path, content, F.col("doc"))),
        "rules": F.when(name_of(path) == IGNORE_FILE, ignore_rules(content)),
        "text": text,
    }
    return cut(rows.select("root", "path", "kind", *[c.alias(n) for n, c in facts.items()]))
