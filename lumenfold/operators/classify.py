"""Quality cascade, categories and tags by keyword rules. Rules are data: expressions are built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, rules, text, urls


def quality_reason(title: Column, content: Column, raw_html: Column | None = None, exclude: Column | None = None, page_url: Column | None = None, site_url: Column | None = None, terminated: bool = False) -> Column:
    """Why a page is no article; null if it is one. The first rule that hits counts."""
    clean = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+$", "")
    haystack = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), clean))
    listed = lambda items: F.array_join(items, rules.LIST_SEPARATOR)
    ads = F.filter(F.array(*map(F.lit, rules.AD_PHRASES)), lambda x: F.contains(clean, x))
    out = F.when(urls.is_entry_page(page_url, site_url), rules.ENTRY_REASON) if page_url is not None else F.when(F.lit(False), "")
    out = out.when(F.length(clean) < rules.LEAST_CONTENT, rules.SHORT_REASON)
    if exclude is not None:
        hits = F.filter(exclude, lambda k: (k != "") & F.contains(haystack, F.lower(k)))
        out = out.when(F.size(hits) > 0, F.concat(F.lit(rules.EXCLUDED_REASON), listed(hits)))
    out = out.when((F.length(clean) < rules.SHORT_PAGE) & text.contains_any(haystack, rules.NAV_PHRASES), rules.NAV_REASON)
    out = out.when(F.size(ads) >= 2, F.concat(F.lit(rules.AD_REASON), listed(ads)))
    if raw_html is not None:
        out = out.when((raw_html != "") & (html.link_text_ratio(raw_html, terminated) >= rules.LEAST_LINK_RATIO), rules.LINKS_REASON)
    return out


def score(keywords: tuple[str, ...], title: Column, haystack: Column) -> Column:
    out = F.lit(0)
    for k in keywords:
        out = out + F.when(title.contains(k.lower()), rules.TITLE_WEIGHT).otherwise(0) + F.when(haystack.contains(k.lower()), rules.BODY_WEIGHT).otherwise(0)
    return out


def classify(title: Column, content: Column, categories: dict[str, tuple[str, ...]] | None = None, tags: dict[str, tuple[str, ...]] | None = None, allowed: set[str] | None = None) -> Column:
    """struct(category, score, tags): the category with the highest score above 0, of equals the first declared; null if
    none; the first tags of the vocabulary that occur."""
    categories = rules.CATEGORY_KEYWORDS if categories is None else categories
    tags = rules.TAG_KEYWORDS if tags is None else tags
    low = F.lower(F.coalesce(title, F.lit("")))
    haystack = F.concat(low, F.lit("\n"), F.lower(F.coalesce(content, F.lit(""))))
    scored = [F.struct(score(words, low, haystack).alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("name")) for i, (name, words) in enumerate(categories.items()) if allowed is None or name in allowed]
    best = F.array_max(F.array(*scored)) if scored else F.lit(None).cast("struct<score:int,ord:int,name:string>")
    found = F.filter(F.array(*[F.when(text.contains_any(haystack, tuple(k.lower() for k in words)), name) for name, words in tags.items()]), lambda x: x.isNotNull())
    return F.struct(F.when(best["score"] > 0, best["name"]).alias("category"), F.when(best["score"] > 0, best["score"]).otherwise(0).alias("score"), F.slice(found, 1, rules.MOST_TAGS).alias("tags"))


def write_back(articles: DataFrame, classified: str = "classified", fallback: bool = True) -> DataFrame:
    """Pending articles get category, tags and status; without a hit the fallback category and `uncategorized`."""
    c = F.col(classified)
    pending = F.col("status") == "pending"
    none = c["category"].isNull()
    category = F.coalesce(c["category"], F.lit(rules.FALLBACK_CATEGORY if fallback else None))
    return articles.withColumns({
        "category": F.when(pending, category).otherwise(F.col("category")), "tags": F.when(pending, c["tags"]).otherwise(F.col("tags")),
        "status": F.when(pending & none & F.lit(fallback), "uncategorized").when(pending & ~none, "normal").otherwise(F.col("status")),
    }).drop(classified)


def parse_pages(pages: DataFrame, site_url: Column, exclude: Column | None = None, parser=html.parse_html, terminated: bool = False) -> DataFrame:  # noqa: ANN001
    """Articles of fetched pages (url, raw_html, ...): entry pages are filtered before parsing; then no HTML or no
    article is an error; then the quality cascade; what is left is pending. A page without an article has no summary, rather
    than an empty one. `parser` makes the struct of parse_html(). terminated: see html.tree()."""
    entry = urls.is_entry_page(F.col("url"), site_url)
    plain = pages.withColumn("entry", entry)
    blank = F.lit(None).cast("struct<title:string,content:string,published_at:timestamp,author:string,error:string>")
    done = plain.where("entry").withColumn("parsed", blank).unionByName(plain.where("not entry").withColumn("parsed", parser(F.col("raw_html"), terminated) if terminated else parser(F.col("raw_html"))))
    p = F.col("parsed")
    reason = F.when(F.col("entry"), rules.ENTRY_REASON).otherwise(F.coalesce(p["error"], quality_reason(p["title"], p["content"], F.col("raw_html"), exclude, terminated=terminated)))
    status = F.when(F.col("entry"), "filtered").when(p["error"].isNotNull(), "error").when(reason.isNotNull(), "filtered").otherwise("pending")
    return done.select(*[c for c in pages.columns if c != "raw_html"], p["title"].alias("title"), p["content"].alias("content"), F.when(p["content"].isNotNull(), text.summarize(p["content"])).alias("summary"), p["author"].alias("author"), p["published_at"].alias("published_at"), status.alias("status"), reason.alias("reason"))
