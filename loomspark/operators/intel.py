"""Company pages: extraction, checks, maturity, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import col, trim_all
from .dictionary import contains_terms  # noqa: F401  (pages against a dictionary of terms)

#: Points of the maturity score and the lengths of text that earn them.
POINTS = {"blog": 15, "social": 10, "analytics": 10, "schema": 10, "https": 5, "crm": 10, "marketing": 5, "framework": 10}
LENGTH_POINTS = ((1000, 15), (300, 8))
GRADES = ((90, "A+"), (80, "A"), (70, "B+"), (60, "B"), (50, "C+"), (40, "C"), (30, "D"))
BODY_LENGTH = 2000
#: A body of fewer characters is thin; what marks structured data, and what calls to act.
THIN, SCHEMA, CALLS = 500, ("schema.org", "itemtype"), ("cta", "sign up", "get started", "book a demo", "contact us")
UNFETCHED = "could not fetch website"
ADVICE = {
    "blog": "Add a blog for SEO and thought leadership",
    "Analytics": "Install Google Analytics or Plausible for visitor tracking",
    "schema": "Add structured data (JSON-LD) for better search visibility",
    "thin": "Expand homepage content with value propositions and social proof",
}
SOCIAL = ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com")
#: Technologies by group, in order, with the markers that lower-cased pages hold.
TECHNOLOGIES = {
    "cms": {"WordPress": ("wp-content", "wordpress"), "Webflow": ("webflow",), "Shopify": ("shopify",), "Squarespace": ("squarespace",), "Wix": ("wix.com",), "Contentful": ("contentful",), "Strapi": ("strapi",)},
    "analytics": {"Google Analytics": ("google-analytics", "gtag", "ga4"), "Mixpanel": ("mixpanel",), "Amplitude": ("amplitude",), "Hotjar": ("hotjar",), "Segment": ("segment",), "Plausible": ("plausible",), "PostHog": ("posthog",)},
    "crm": {"HubSpot": ("hubspot",), "Salesforce": ("salesforce",), "Pipedrive": ("pipedrive",), "Intercom": ("intercom",), "Drift": ("drift",)},
    "marketing": {"Mailchimp": ("mailchimp",), "Klaviyo": ("klaviyo",), "ActiveCampaign": ("activecampaign",), "Marketo": ("marketo",)},
    "infrastructure": {"Cloudflare": ("cloudflare",), "Vercel": ("vercel",), "Netlify": ("netlify",), "AWS": ("aws",), "GCP": ("google cloud", "gcp")},
    "framework": {"Next.js": ("__next", "_next/"), "React": ("react",), "Vue.js": ("vue",), "Angular": ("angular",), "Svelte": ("svelte",), "Tailwind CSS": ("tailwind",)},
}
BLOG, MOBILE = ("blog",), ("viewport",)
#: All that pages are searched for.
MARKERS = sorted({*BLOG, *MOBILE, *SCHEMA, *CALLS, *SOCIAL, *(m for group in TECHNOLOGIES.values() for marks in group.values() for m in marks)})


def html_title(html: str | Column) -> Column:
    """The first title that holds text and no tags; empty if there is none."""
    return trim_all(F.regexp_extract(col(html), r"(?i)<title[^>]*>([^<]+)</title>", 1))


def html_meta(html: str | Column) -> Column:
    """The meta description: the first tag with the name before a content that is not empty, else the first the other way round."""
    tags = F.regexp_extract_all(col(html), F.lit(r"""(?i)<meta(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))
    name, value = r"""name=["']description["']""", r"""content=["']([^"']+)["']"""

    def first(pattern: str) -> Column:
        return F.try_element_at(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, "(?is)" + pattern, 1)), lambda v: v != ""), F.lit(1))

    return trim_all(F.coalesce(first(f"{name}.*{value}"), first(f"{value}.*{name}"), F.lit("")))


def html_body(html: str | Column) -> Column:
    """Text of the body without scripts, styles and tags; the whole page where there is no body."""
    h, pattern = col(html), r"(?is)<body[^>]*>(.*?)</body>"
    raw = F.when(h.rlike(pattern), F.regexp_extract(h, pattern, 1)).otherwise(h)
    for tag in ("script", "style"):
        raw = F.regexp_replace(raw, f"(?is)<{tag}.*?</{tag}>", "")
    return F.substring(trim_all(F.regexp_replace(F.regexp_replace(raw, r"<[^>]+>", " "), r"(?U)\s+", " ")), 1, BODY_LENGTH)


def markers(html: str | Column) -> Column:
    """Which of MARKERS a page holds, in lower case; each is looked for once, and what else is asked of a page reads this list."""
    low = F.lower(col(html))
    return F.coalesce(F.array_compact(F.array(*[F.when(low.contains(m), F.lit(m)) for m in MARKERS])), F.array().cast("array<string>"))


def _holds(found: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, wanted)))


def page_gaps(html: str | Column, body_length: str | Column, found: str | Column | None = None) -> Column:
    """What a page lacks, in a fixed order; a page that was not fetched (null) has that one gap. ``found``: its markers, where they are known."""
    found = markers(html) if found is None else col(found)
    lacking = {"no blog detected": ~_holds(found, BLOG), "no Google Analytics detected": ~_holds(found, TECHNOLOGIES["analytics"]["Google Analytics"]), "thin homepage content": col(body_length) < THIN, "no schema markup detected": ~_holds(found, SCHEMA)}
    gaps = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in lacking.items()]))
    return F.when(col(html).isNull(), F.array(F.lit(UNFETCHED))).otherwise(gaps)


def recommendations(gaps: str | Column) -> Column:
    """One for each gap."""
    def advice(gap: Column) -> Column:
        out = F.concat(F.lit("Fix: "), gap)
        for word, text in reversed(ADVICE.items()):
            out = F.when(gap.contains(word), text).otherwise(out)
        return out

    return F.transform(col(gaps), advice)


def tech_groups(found: str | Column) -> Column:
    """struct of the groups of TECHNOLOGIES, each with the technologies of which a page's ``markers`` hold one, in order."""
    return F.struct(*[F.array_compact(F.array(*[F.when(_holds(col(found), marks), F.lit(name)) for name, marks in group.items()])).alias(g) for g, group in TECHNOLOGIES.items()])


def tech_stack(html: str | Column) -> Column:
    """The technologies of all groups, in the order of TECHNOLOGIES; none for a null page."""
    groups = F.transform(F.array(markers(html)), tech_groups)[0]  # bound once, for all technologies
    return F.concat(*[groups[g] for g in TECHNOLOGIES])


def page_maturity(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The pages with markers, body_length, gaps, tech, points of each kind, score, grade, breakdown and recommendations.

    A page that was not fetched (null html) still earns the points for blog and schema, as only the gap
    of not being fetched is known of it; that is the rule.
    """
    h = col(html)
    out = pages.withColumns({"markers": markers(h), "body_length": F.coalesce(F.length(html_body(h)), F.lit(0)), "https": F.coalesce(~col(url).startswith("http") | col(url).startswith("https"), F.lit(False))})
    out = out.withColumns({"tech": tech_groups("markers"), "gaps": page_gaps(h, "body_length", "markers")})
    lacks = lambda gap: F.array_contains("gaps", gap)
    size, found = F.col("body_length"), F.col("markers")
    holds = {"blog": ~lacks("no blog detected"), "social": _holds(found, SOCIAL), "schema": ~lacks("no schema markup detected"), "https": F.col("https")}
    holds |= {g: F.size(F.col("tech")[g]) > 0 for g in ("analytics", "crm", "marketing", "framework")}
    points = {name: F.when(hit, POINTS[name]).otherwise(0) for name, hit in holds.items()}
    points["length"] = F.when(size > LENGTH_POINTS[0][0], LENGTH_POINTS[0][1]).when(size > LENGTH_POINTS[1][0], LENGTH_POINTS[1][1]).otherwise(0)
    seen = {"has_blog": holds["blog"], "has_social": holds["social"], "has_analytics": holds["analytics"], "has_schema": holds["schema"], "has_cta": _holds(found, CALLS), "mobile": _holds(found, MOBILE)}
    quality = F.when(size > LENGTH_POINTS[0][0], "rich").when(size > LENGTH_POINTS[1][0], "moderate").otherwise("thin")
    out = out.withColumns({"points": F.struct(*[x.alias(name) for name, x in points.items()]), "breakdown": F.struct(*[x.alias(name) for name, x in seen.items()], quality.alias("content_quality"))})
    out = out.withColumn("score", sum(F.col("points")[name] for name in points))
    return out.withColumns({"grade": grade(F.col("score")), "recommendations": recommendations("gaps")})


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def validate_url(url: str | Column) -> Column:
    """struct(valid, error): http or https, a host, and none of the private or loopback ranges."""
    u = col(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    private = host.rlike(r"^(?:localhost$|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    error = F.when(host.isNull(), "Invalid URL").when(~u.rlike("(?i)^https?://"), "Only http and https are allowed").when(private, "Private addresses are not allowed")
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def clamp_signal(df: DataFrame, sourced: bool = True) -> DataFrame:
    """confidence within 0 to 1 (0 or none: 0.5, unsourced 0.4 and 0.6 at most), relevance within 0 to 100 (0: 50)."""
    confidence = F.coalesce(F.nullif(F.nanvl(F.col("confidence"), F.lit(0.0)), F.lit(0.0)), F.lit(0.5 if sourced else 0.4))
    relevance = F.coalesce(F.nullif(F.col("relevance"), F.lit(0.0)), F.lit(50.0))
    return df.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0 if sourced else 0.6), confidence)), "relevance": F.greatest(F.lit(0.0), F.least(F.lit(100.0), relevance))})


def filter_signals(df: DataFrame, types: list[str] | None = None, least: float = 0.0, required: tuple[str, ...] = ("type", "detail")) -> DataFrame:
    """Signals of the wanted types (none given: all) with all required texts and enough confidence."""
    test = F.col("confidence") >= least
    for c in required:
        test = test & (F.coalesce(F.col(c), F.lit("")) != "")
    return df.where(test & F.col("type").isin(*types) if types else test)


def result_counts(queries: DataFrame, key: str, results: str) -> DataFrame:
    """Of each key: queries executed, and results over all of them."""
    return queries.groupBy(key).agg(F.count("*").alias("queries"), F.sum(F.coalesce(F.size(F.col(results)), F.lit(0))).alias("results"))


def top_queries(df: DataFrame, key: str, weight: str, ord_: str, n: int = 6) -> DataFrame:
    """The n queries of the largest weight for each key, earlier ones first among equals."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), ord_)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def exclude_self(candidates: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """Candidates whose name (in any case) and url both differ from the company's own; at most one row a company is looked up."""
    own = companies.select(key, F.lower("name").alias("_name"), F.col("url").alias("_url")).dropDuplicates([key])
    return candidates.join(own, key).where((F.lower("name") != F.col("_name")) & (F.col("url") != F.col("_url"))).drop("_name", "_url")


def cap_candidates(df: DataFrame, key: str, ord_: list[str], n: int = 10) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*ord_))).where(F.col("place") <= n)


def rank_signals(df: DataFrame, key: str, least: float, ord_: str, n: int = 10) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("relevance"), ord_)
    return df.where(F.col("confidence") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
