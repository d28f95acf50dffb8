"""URL scalars: parts, predicates, joining, site name, follow resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# The generic-syntax pattern of RFC 3986, appendix B.
URL_PATTERN = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Second-level labels that sit in front of a country code.
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac"]


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, group), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def host(url: Column) -> Column:
    return F.split(authority(url), ":")[0]


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def is_valid(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (authority(url) != ""), F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (authority(a) == authority(b))


def site_name(url: Column) -> Column:
    chunks = F.split(host(url), r"\.")
    n = F.size(chunks)
    third = (n >= 3) & F.try_element_at(chunks, F.lit(-2)).isin(SECOND_LEVEL)
    name = (
        F.when(third, F.try_element_at(chunks, F.lit(-3)))
        .when(n >= 2, F.try_element_at(chunks, F.lit(-2)))
        .otherwise(chunks[0])
    )
    valid = is_valid(url) & (host(url) != "")
    return F.when(valid & (~((n == 1) & (chunks[0] == ""))), name).otherwise(F.lit("site"))


def _parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment as an array, in one match."""
    return F.split(F.regexp_replace(url, URL_PATTERN, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001")


def _fold_dots(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in a list of path segments."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    trailing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(folded, trailing), "/")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("/"))


def _resolved_path(base: Column, ref: Column) -> Column:
    """The path of ``ref`` seen from the folder of the path ``base``."""
    segments = F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), ref), "/")
    # Doubled slashes inside a relative result collapse; ends stay as they are.
    inner = F.filter(segments, lambda s, i: (i == 0) | (s != "") | (i == F.size(segments) - 1))
    return F.when(ref.startswith("/"), text.let(F.split(ref, "/"), _fold_dots)).otherwise(text.let(inner, _fold_dots))


def join(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``base`` by the RFC 3986 rules."""

    def resolve(x: Column) -> Column:
        b, r = x["b"], x["r"]
        no_path, authority_given = r[2] == "", r[1] != ""
        path_ = F.when(authority_given, r[2]).when(no_path, b[2]).otherwise(_resolved_path(b[2], r[2]))
        query = F.when(~authority_given & no_path & (r[3] == ""), b[3]).otherwise(r[3])
        auth = F.when(authority_given, r[1]).otherwise(b[1])
        scheme_ = F.lower(b[0])
        built = F.concat(
            F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(F.lit("")),
            F.when(auth != "", F.concat(F.lit("//"), auth)).otherwise(F.lit("")),
            F.when((auth != "") & path_.rlike("^[^/]"), F.lit("/")).otherwise(F.lit("")),
            path_,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(r[4] != "", F.concat(F.lit("#"), r[4])).otherwise(F.lit("")),
        )
        other_scheme = (r[0] != "") & (F.lower(r[0]) != scheme_)
        relative = scheme_.isin("http", "https", "ftp", "file", "")
        return (
            F.when(x["ref"] == "", x["base"])
            .when((x["base"] == "") | other_scheme | ~relative, x["ref"])
            .otherwise(built)
        )

    return text.let(
        F.struct(base.alias("base"), ref.alias("ref"), _parts(base).alias("b"), _parts(ref).alias("r")), resolve
    )


def resolve_follow(value: Column, base: Column, prefix: str | None = None) -> Column:
    """Where a link cell points, or NULL when it points nowhere usable."""
    absolute = "^https?://"
    given = F.nullif(text.strip(value), F.lit(""))
    target = given
    if prefix:
        glued = F.concat(F.lit(prefix.rstrip("/") + "/"), F.ltrim(given, F.lit("/")))
        target = F.when(given.rlike(absolute), given).otherwise(glued)

    def against_base(x: Column) -> Column:
        fixed = x["t"].rlike(absolute) | (F.coalesce(x["b"], F.lit("")) == "")
        return F.when(fixed, x["t"]).when(x["t"].isNotNull(), join(x["b"], x["t"]))

    found = text.let(F.struct(target.alias("t"), base.alias("b")), against_base)
    return text.let(found, lambda u: F.when(u.rlike("^(?i:https?)://[^/?#]"), u))
