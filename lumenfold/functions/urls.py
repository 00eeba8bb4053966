"""URLs as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules


def authority(url: Column) -> Column:
    """Host with port and user, as written."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column) -> Column:
    """Path with `/` for none; of a URL without a host, what stands before query and fragment."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def bare_path(url: Column) -> Column:
    cut = F.regexp_replace(path(url), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def _target(url: str) -> str:
    from urllib.parse import quote, unquote, urlparse, urlunparse

    parts = urlparse(unquote(url))
    return quote(urlunparse(("", "", parts.path, parts.params, parts.query, parts.fragment))) or "/"


@F.pandas_udf(T.StringType())
def robots_target(url: pd.Series) -> pd.Series:
    """What robots rules are prefixes of: path, query and fragment, escapes undone and made anew by the standard library."""
    return url.map(_target, na_action="ignore")


def origin(url: Column) -> Column:
    return F.lower(F.concat(scheme(url), F.lit("://"), authority(url)))


def is_entry_page(url: Column, site: Column) -> Column:
    """The site's own page: same host and same path but for slashes at its end; scheme and query don't count."""
    same = (F.lower(authority(url)) == F.lower(authority(site))) & (bare_path(url) == bare_path(site))
    return F.coalesce(same & (url != "") & (site != ""), F.lit(False))


def article_score(url: Column, anchor: Column) -> Column:
    """How much a link looks like one to an article."""
    low = F.lower(F.when(path(url) == "", "/").otherwise(path(url)))
    segments = F.filter(F.split(low, "/"), lambda x: x != "")
    text = F.regexp_replace(F.coalesce(anchor, F.lit("")), r"(?U)^\s+|\s+$", "")
    among = lambda words: F.arrays_overlap(segments, F.array(*map(F.lit, words)))
    points = lambda test, n: F.when(test, n).otherwise(0)
    return (
        points(low.rlike(rules.DATE_PATH), 3)
        + points(among(rules.ARTICLE_SEGMENTS), 3)
        + points(low.rlike(r"\.(html|htm|shtml)$"), 2)
        + F.when(F.length(text) >= 8, 2).when(F.length(text).between(1, 3), -2).otherwise(0)
        + points(F.lower(text).isin(*rules.GENERIC_ANCHORS), -3)
        + points(F.size(segments) >= 2, 1)
        + points(among(rules.NAV_SEGMENTS), -3)
    )
