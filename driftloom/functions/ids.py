"""URL canonicalisation and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions import vocab as V
from driftloom.functions.text import blank_to_null, first_present, sha_prefix


def canonical_url(href: Column, urn: Column | None = None) -> Column:
    """Absolute URL without its query; else one derived from an ``activity:<digits>`` URN."""
    absolute = F.when(href.startswith("/"), F.concat(F.lit(V.NETWORK_BASE), href)).otherwise(href)
    url = blank_to_null(F.split_part(blank_to_null(absolute), F.lit("?"), F.lit(1)))
    if urn is None:
        return url
    activity = blank_to_null(F.regexp_extract(urn, V.ACTIVITY_ID, 1))
    derived = F.concat(F.lit(V.NETWORK_BASE + "/feed/update/urn:li:activity:"), activity, F.lit("/"))
    return F.coalesce(url, derived)


def posts_url(company_id: Column, company_url: Column) -> Column:
    """The page that lists a company's posts."""
    bare = F.split_part(F.split_part(company_url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    base = F.regexp_replace(bare, "/+$", "")
    from_url = F.when(base.endswith("/posts"), F.concat(base, F.lit("/?feedView=all"))).otherwise(
        F.concat(base, F.lit("/posts/?feedView=all"))
    )
    from_id = F.concat(
        F.lit(V.NETWORK_BASE + "/company/"), company_id, F.lit("/posts/?feedView=all")
    )
    return F.when(company_url.contains("linkedin.com/company/"), from_url).otherwise(from_id)


def candidate_urls(company_id: Column, company_url: Column) -> Column:
    """Distinct URLs to try, in order."""
    primary = posts_url(company_id, company_url)
    member = F.concat(primary, F.lit("&viewAsMember=true"))
    company = F.concat(F.lit(V.NETWORK_BASE + "/company/"), company_id, F.lit("/"))
    return F.array_distinct(F.array(primary, member, company))


def item_id(url: Column, text: Column, label: Column) -> Column:
    """Id digits found in the URL, else a hash of the URL, else a hash of text and label."""
    seed = F.concat_ws("|", F.substring(text, 1, 300), F.coalesce(label, F.lit("")))
    found = [blank_to_null(F.regexp_extract(url, p, 1)) for p in (V.ACTIVITY_ID, V.POST_URL_ID, V.SHARE_ID)]
    return F.coalesce(*found, sha_prefix(blank_to_null(url)), sha_prefix(seed))


def content_id(url: Column, title: Column, text: Column) -> Column:
    """Hash of the URL, else of title plus the first 100 characters."""
    return sha_prefix(first_present(url, F.concat(title, F.substring(text, 1, 100))))


def text_id(text: Column) -> Column:
    return sha_prefix(text)
