"""Pattern scans over texts and references in markup."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import url_unquote

#: Credentials, operational locators, runtime network access, imports and style references.
CREDENTIAL = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
LOCATOR = r"(?i)s3://|arn:aws(?:-[a-z]+)?:|/(?:home|workspace|mnt)/"
NETWORK = r"\b(?:fetch|XMLHttpRequest|WebSocket|EventSource|importScripts)\s*\(|\bsendBeacon\s*\(|\bimport\s*\("
IMPORT = r"""\b(?:import|export)\s+(?:[^;\n]*?\s+from\s+)?["']([^"']+)["']"""
STYLE_URL = r"""(?i)url\(\s*["']?([^\s)"']+)["']?\s*\)"""
#: Ours: an assignment to a name that says it is secret.
ASSIGNMENT = r"""(?i)(?:password|secret|token|key)\s*[:=]\s*["'][^"']{8,}["']"""


#: Texts without any of these can't match the pattern: a plain search is much faster.
_MARKS = {
    CREDENTIAL: (False, ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "PRIVATE KEY-----"]),
    LOCATOR: (True, ["s3://", "arn:aws", "/home/", "/workspace/", "/mnt/"]),
    NETWORK: (False, ["fetch", "XMLHttpRequest", "WebSocket", "EventSource", "importScripts", "sendBeacon", "import"]),
    ASSIGNMENT: (True, ["password", "secret", "token", "key"]),
}


def _matches(text: Column, pattern: str) -> Column:
    any_case, marks = _MARKS[pattern]
    searched = F.lower(text) if any_case else text
    return reduce(lambda a, b: a | b, (F.contains(searched, F.lit(m)) for m in marks)) & text.rlike(pattern)


def pattern_flags(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, credential, locator, network, assignment) of the texts that match any."""
    flags = {"credential": CREDENTIAL, "locator": LOCATOR, "network": NETWORK, "assignment": ASSIGNMENT}
    return rows.select(key, *(_matches(F.col(text), p).alias(n) for n, p in flags.items())).where(" or ".join(flags))


_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTE = rf"""[^\s/>][^\s/=>]*+(?:{_SPACE}*+={_SPACE}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+))?+"""
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"
#: The states of a markup reader, in the order in which they are tried at a ``<``: a comment, an element whose content is text up to its
#: own end tag, an end tag, a declaration, and a start tag; ``end`` is empty for a tag that the text ends in.
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style)(?=[\s/>])(?P<inside>{_ATTRIBUTES})>(?:.*?(?=</(?P=raw)[\s/>])|.*)|</[a-z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|<(?P<tag>[a-z][^\s/>]*+)(?P<held>{_ATTRIBUTES})(?P<end>>|\Z)",
    re.IGNORECASE | re.DOTALL | re.ASCII,
)
_PAIR = re.compile(rf"""([^\s/>][^\s/=>]*+)(?:{_SPACE}*+(=){_SPACE}*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""", re.ASCII)


def tags(markup: str) -> Iterator[tuple[str, list[tuple[str, str | None]]]]:
    """Start tags in order, each with its attributes: names in lower case, values unescaped, None for an attribute without one.

    What stands in comments, declarations and the text of scripts and styles is no tag, nor is one that the text ends in.
    """
    for m in _TOKEN.finditer(markup):
        if m["raw"] or m["end"]:
            held = m["inside"] if m["raw"] else m["held"]
            yield (m["raw"] or m["tag"]).lower(), [(p[1].lower(), html.unescape(p[3] or p[4] or p[5] or "") if p[2] else None) for p in _PAIR.finditer(held)]


def attributes(rows: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, tag, attribute, value) of all start tags, a row for each attribute; null for an attribute without a value.

    Null markup has no tags. A text is read once, from tag to tag, in Arrow batches.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, tag, name, value) for i, text in enumerate(batch.column(1).to_pylist()) if text for tag, pairs in tags(text) for name, value in pairs]
            for a in range(0, len(found), 10_000):
                at, tag, name, value = zip(*found[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.string()) for c in (tag, name, value))], names=[key, "tag", "attribute", "value"])

    return rows.select(key, markup).mapInArrow(run, f"`{key}` {kind}, tag string, attribute string, value string")


ELEMENT = "pre long, last long, depth int, namespace string, name string, attributes map<string,string>, error string"


def _tree(document: str) -> list[tuple]:
    """The elements of a document in order, or one row with what is wrong with it."""
    found: list[list] = []
    open_: list[int] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        space, _, local = name.rpartition(" ")
        open_.append(len(found))
        found.append([len(found), 0, len(open_) - 1, space, local, list(attributes.items()), None])

    def end(_: str) -> None:
        found[open_.pop()][1] = len(found) - 1

    def refuse(*_: object) -> None:
        raise ValueError("entity declarations aren't read")

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, refuse
    try:
        parser.Parse(document.encode(), True)
    except (expat.ExpatError, ValueError) as e:
        return [(None, None, None, None, None, None, str(e))]
    return [tuple(f) for f in found]


def elements(rows: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, pre, last, depth, namespace, name, attributes, error): the element trees of XML documents, a row for each element.

    ``pre`` counts elements from 0 in document order and ``last`` is that of an element's last descendant, so d lies in e where
    e.pre < d.pre <= e.last. Names are local, attribute names as ``namespace name`` where they have one. A malformed document is one row
    with its ``error``; so is one that declares entities. A null document has no rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
    names = [part.split()[0] for part in ELEMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *e) for i, text in enumerate(batch.column(1).to_pylist()) if text is not None for e in _tree(text)]
            for a in range(0, len(found), 10_000):
                at, *columns = zip(*found[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *names])

    return rows.select(key, markup).mapInArrow(run, f"`{key}` {kind}, {ELEMENT}")


def within(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """(key, pre, in_pre): the elements ``inner`` that lie in one of ``outer``, and which: a comparison of ranges within each document."""
    a = inner.select(F.col(key), "pre")
    b = outer.select(F.col(key).alias("_key"), F.col("pre").alias("in_pre"), F.col("last").alias("_last"))
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col("in_pre") < F.col("pre")) & (F.col("pre") <= F.col("_last"))).select(key, "pre", "in_pre")


def references(rows: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, kind, reference): href and src attributes, style urls and imports, in a row each, from one scan."""
    attribute = r"""(?i)\s(?:href|src)\s*=\s*["']([^"']*)["']"""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(markup, F.lit(pattern), F.lit(1)), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("reference")))

    every = F.concat(found("attribute", attribute), found("style", STYLE_URL), found("import", IMPORT))
    return rows.select(key, F.explode(every).alias("r")).select(key, "r.kind", "r.reference")


def reference_parts(references: DataFrame) -> DataFrame:
    """References with scheme, host, path (also decoded) and fragment, and whether they stay on their own site."""
    ref = F.col("reference")
    scheme = F.regexp_extract(ref, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(ref, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(F.regexp_replace(ref, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""), r"^[^?#]*", 0)
    return references.select("*", scheme.alias("scheme"), host.alias("host"), path.alias("path"), url_unquote(path).alias("decoded_path"), F.regexp_extract(ref, r"#(.*)$", 1).alias("fragment"), ((scheme == "") & (host == "")).alias("local"))


def svg_violations(rows: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, reason) of drawings that can't be read, have script elements, or refer to other places: the first that applies."""
    local = lambda name: F.substring_index(name, " ", -1)
    remote = F.exists(F.map_entries("attributes"), lambda e: (F.lower(local(e["key"])) == "href") & e["value"].rlike(r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//"))
    place = F.when(F.col("error").isNotNull(), 0).when(F.lower("name") == "script", 1).when(remote, 2)
    found = elements(rows, key, markup).select(key, place.alias("place")).where("place is not null").groupBy(key).agg(F.min("place").alias("place"))
    return found.select(key, F.element_at(F.array(*map(F.lit, ("malformed", "script", "remote reference"))), F.col("place") + 1).alias("reason"))
