"""URL parts, canonical hosts, dedup keys and relative references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlane.functions.text import bind

# RFC 3986 appendix B, tolerant of leading blanks: scheme, authority, path, query, fragment.
URL_PATTERN = (
    r"^[\x00-\x20]*(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    r"(?:\?([^#]*))?(?:#([\s\S]*))?$"
)
# Line breaks are removed before matching, so they can separate the parts afterwards.
URL_PARTS = "$1\n$2\n$3\n$4\n$5"
KEY_PARTS = "$2\n$3?$4"
# Parameters of the last path segment, up to the `?` that ends the path of a key.
KEY_PARAMS = r"^([^?]*?);[^/?]*\?"
# Schemes whose last path segment may carry parameters.
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms",
    "sftp", "tel",
]
HOST_PREFIX = r"^(?:www\.)?(?:[^.]{2}\.(?=[^.]*\.))?"


def _clean(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), "\t\r\n", "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(_clean(url), URL_PATTERN, 2)


def canonical_host(host: Column) -> Column:
    """Lower case, without ``www.`` and without one two-character regional label."""
    return F.regexp_replace(F.lower(host), HOST_PREFIX, "")


def source_host(url: Column) -> Column:
    """Canonical host of a page."""
    return canonical_host(netloc(url))


def dedup_key(url: Column) -> Column:
    """Canonical host + path + ``?`` + query; a blank URL gives ``?``."""
    # One pass over the URL yields the authority and the rest.
    parts = F.regexp_replace(_clean(url), URL_PATTERN, KEY_PARTS)
    host = canonical_host(F.substring_index(parts, "\n", 1))
    rest = F.substring_index(parts, "\n", -1)
    scheme = F.lower(F.regexp_extract(_clean(url), URL_PATTERN, 1))
    has_params = rest.contains(";") & scheme.isin(PARAM_SCHEMES)
    bare = F.when(has_params, F.regexp_replace(rest, KEY_PARAMS, "$1?")).otherwise(rest)
    return F.concat(host, bare)


def _parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment, blank where absent."""
    split = F.split(F.regexp_replace(_clean(url), URL_PATTERN, URL_PARTS), "\n", -1)
    return bind(
        split,
        lambda p: F.struct(
            F.lower(p[0]).alias("scheme"),
            p[1].alias("host"),
            p[2].alias("path"),
            p[3].alias("query"),
            p[4].alias("fragment"),
        ),
    )


def _merge_path(base_path: Column, path: Column) -> Column:
    """Join a relative path to its base and remove dot segments."""
    parent = F.regexp_extract(base_path, r"^((?:[\s\S]*/)?)", 1)
    joined = F.when(path.startswith("/"), path).otherwise(
        # Empty segments inside a joined path collapse.
        F.regexp_replace(F.concat(parent, path), "/{2,}", "/")
    )

    def resolve(text):
        segments = F.split(text, "/", -1)
        walked = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, seg: F.when(
                seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
            )
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg))),
        )
        # A path that ends in a dot segment names a folder.
        closing = F.when(
            F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))
        ).otherwise(F.array().cast("array<string>"))
        dotted = text.rlike(r"(?:^|/)\.\.?(?:/|$)")
        return F.when(dotted, F.array_join(F.concat(walked, closing), "/")).otherwise(text)

    resolved = bind(joined, resolve)
    return bind(resolved, lambda r: F.when(r == "", F.lit("/")).otherwise(r))


def _resolve(reference: Column, base: Column) -> Column:
    same_document = (reference["path"] == "") & (reference["host"] == "")
    own_host = reference["host"] != ""
    params = F.regexp_extract(reference["path"], r"(;[^/]+)$", 1)

    def bare(path):
        return F.regexp_replace(path, r";[^/]*$", "")

    merged = F.concat(_merge_path(bare(base["path"]), bare(reference["path"])), params)
    path = (
        F.when(own_host, reference["path"]).when(same_document, base["path"]).otherwise(merged)
    )
    host = F.when(own_host, reference["host"]).otherwise(base["host"])
    query = F.when(same_document & (reference["query"] == ""), base["query"]).otherwise(
        reference["query"]
    )

    def put_together(u):
        def unless_blank(part, before="", after=""):
            return F.when(part != "", F.concat(F.lit(before), part, F.lit(after))).otherwise("")

        slash = F.when((u["host"] != "") & (u["path"] != "") & ~u["path"].startswith("/"), "/")
        return F.concat(
            unless_blank(base["scheme"], after=":"),
            unless_blank(u["host"], before="//"),
            slash.otherwise(""),
            u["path"],
            unless_blank(u["query"], before="?"),
            unless_blank(reference["fragment"], before="#"),
        )

    return bind(
        F.struct(host.alias("host"), path.alias("path"), query.alias("query")), put_together
    )


def resolve_url(base: Column, reference: Column) -> Column:
    """Absolute form of ``reference`` found on page ``base``; blank gives the page."""

    def choose(u):
        other = (u["ref"]["scheme"] != "") & (u["ref"]["scheme"] != u["base"]["scheme"])
        return F.when(other, reference).otherwise(_resolve(u["ref"], u["base"]))

    pair = F.struct(_parts(reference).alias("ref"), _parts(base).alias("base"))
    blank = _clean(reference) == ""
    return F.when(blank, F.coalesce(base, F.lit(""))).otherwise(bind(pair, choose))
