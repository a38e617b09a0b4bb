"""URL expressions: scheme, authority (port kept), path, and joining a reference to its base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host with port and user, in lower case; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_plain_http(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).startswith("http://")


def _collapse(p: Column) -> Column:
    """A path without . and .. segments."""
    segments = F.split(p, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.filter(segments, lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(s == "..", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ended = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(ended, "/")).otherwise(p)


def join(base: Column, ref: Column) -> Column:
    """The absolute form of `ref` on a page at `base`."""
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, _collapse(ref_path), tail))
        .when(ref.startswith("?"), F.concat(root, path(base), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), ref))
        .otherwise(F.concat(root, _collapse(F.concat(folder, ref_path)), tail))
    )


def without_end_slash(p: Column) -> Column:
    """A path for comparing pages: '/' when empty, and no slashes at the end otherwise."""
    return F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
