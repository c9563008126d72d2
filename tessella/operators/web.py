"""Manufacturers' domains and pages as evidence: addresses, search hits, page verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cells as C
from ..functions.cells import col
from ..functions.extract import first
from ..resources import values as V


def domains(spark: SparkSession) -> DataFrame:
    """manufacturer, position, domain."""
    return spark.createDataFrame([(m, i, d) for m, ds in V.MANUFACTURER_DOMAINS.items() for i, d in enumerate(ds)], "manufacturer string, position int, domain string")


def url_host(url: Column | str) -> Column:
    """The host in lower case without www., empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(col(url), F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def is_blocked_url(url: Column | str) -> Column:
    return F.coalesce(url_host(url).isin(V.BLOCKED_HOSTS) | col(url).rlike(f"(?i){V.SHOPPING_PATTERN}"), F.lit(False))


def _holds(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def classify_url(url: Column | str) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")))
    pdf = F.when(_holds(path, ["datasheet", "data-sheet", "spec"]), "specification_sheet").when(_holds(path, ["manual", "guide", "instruction"]), "technical_manual").otherwise("pdf_datasheet")
    video = _holds(path, [".mp4", ".webm", ".avi", "video"]) | F.contains(F.lower(col(url)), F.lit("youtube"))
    return F.when(F.endswith(path, F.lit(".pdf")), pdf).when(video, "video").when(_holds(path, ["catalogue", "catalog", "brochure"]), "catalogue_page").otherwise("product_page")


def is_search_url(url: Column | str) -> Column:
    return _holds(F.lower(col(url)), ["/search", "q=", "query="])


def prioritise_candidates(urls: Column | str) -> Column:
    """Addresses of pages before those of searches, otherwise in order."""
    return F.concat(F.filter(col(urls), lambda u: ~is_search_url(u)), F.filter(col(urls), is_search_url))


def is_manufacturer_url(df: DataFrame, url_col: str, mfr_col: str, known: DataFrame) -> DataFrame:
    """df with on_domain: whether the host is a domain of the row's manufacturer or lies below one."""
    own = known.groupBy("manufacturer").agg(F.collect_set("domain").alias("_domains")).withColumnRenamed("manufacturer", "_m")
    host = url_host(url_col)
    out = df.join(own, F.col(mfr_col) == F.col("_m"), "left")
    hit = F.exists("_domains", lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return out.withColumn("on_domain", F.coalesce(hit, F.lit(False))).drop("_domains", "_m")


def domain_lookup(df: DataFrame, mfr_col: str, known: DataFrame) -> DataFrame:
    """df with a row for each domain registered for its manufacturer's exact name."""
    return df.join(known.withColumnRenamed("manufacturer", "_m"), F.col(mfr_col) == F.col("_m"), "left").drop("_m")


_SUFFIXES = ["com", "net", "org", "co", "de", "jp", "www"]


def _names(words: Column, domain: Column) -> Column:
    """Whether a word of four or more letters begins a label of a domain's name, or the other way round."""
    labels = F.filter(F.split(F.lower(domain), r"\."), lambda p: ~p.isin(_SUFFIXES))
    return F.exists(labels, lambda n: F.exists(words, lambda w: F.startswith(n, w) | F.startswith(w, n)))


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), lambda w: F.length(w) >= 4)


def resolve_domain(mfr: Column | str, text: Column | str, brands: list[Column]) -> Column:
    """A manufacturer's domain: its only one; the only one that the description or a brand names; the first if all carry
    the manufacturer's own name; else null."""
    table = F.create_map(*(x for m, ds in V.MANUFACTURER_DOMAINS.items() for x in (F.lit(m), F.array(*map(F.lit, ds)))))
    own = F.element_at(table, col(mfr))
    shown = [F.when(~C.is_placeholder(b), b) for b in brands]
    named = F.filter(own, lambda d: _names(_words(F.concat_ws(" ", F.coalesce(col(text), F.lit("")), *shown)), d))
    same = F.forall(own, lambda d: _names(_words(col(mfr)), d))
    return F.when(F.size(own) == 1, F.get(own, 0)).when(F.size(named) == 1, F.get(named, 0)).when(same, F.get(own, 0))


def search_queries(mfr: Column | str, part: Column | str, domain: Column | str) -> Column:
    """Four searches for a part: page, datasheet, specification, and within the domain."""
    m, p = F.trim(col(mfr)), F.trim(col(part))
    return F.array(*(F.concat(m, F.lit(" "), p, F.lit(x)) for x in (" product page", " datasheet", " specification")), F.concat(F.lit("site:"), F.coalesce(col(domain), F.lit("")), F.lit(" "), p))


def candidate_urls(names: Column | str, part: Column | str) -> Column:
    """Four addresses on each domain: three product pages and a search."""
    slug, p = F.replace(F.lower(F.trim(col(part))), F.lit(" "), F.lit("-")), F.trim(col(part))
    pages = lambda d: F.array(*(F.concat(F.lit("https://www."), d, F.lit(x), y) for x, y in (("/product/", slug), ("/products/", slug), ("/us/en/product/", slug), ("/search?q=", p))))
    return F.flatten(F.transform(col(names), pages))


def candidate_sources(mfr: Column | str, part: Column | str, domain: Column | str) -> Column:
    """A search page and a datasheet on a known domain, to be looked at by a person; null without a domain."""
    d, p = col(domain), F.trim(col(part))
    slug = F.replace(F.lower(p), F.lit(" "), F.lit("-"))
    page = F.concat(F.lit("https://www."), d, F.lit("/search?q="), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    sheet = F.concat(F.lit("https://www."), d, F.lit("/documents/"), slug, F.lit("-datasheet.pdf"))
    one = lambda url, kind, confidence, of: F.struct(url.alias("url"), F.lit(kind).alias("source_type"), F.lit("discovered").alias("status"), F.lit(confidence).alias("confidence"), F.left(F.sha2(of, 256), F.lit(16)).alias("content_hash"))
    about = F.concat(F.lit("Product page for "), col(mfr), F.lit(" "), col(part))
    return F.when(d.isNotNull(), F.array(one(page, "product_page", 0.85, about), one(sheet, "pdf_datasheet", 0.80, sheet)))


def resolve_from_hits(hits: DataFrame, known: DataFrame) -> DataFrame:
    """part_number, manufacturer, url of the best-ranked hit, not blocked, on a registered domain or below one.

    A host is cut into its endings, which meet the domains by equality. Of names that share a domain the first counts."""
    own = known.groupBy("domain").agg(F.min("manufacturer").alias("manufacturer"))
    labels = F.split(url_host("url"), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    open_ = hits.where(~is_blocked_url("url")).withColumn("domain", F.explode(endings))
    found = open_.join(own, "domain")
    best = F.min_by(F.struct("manufacturer", "url"), F.struct("rank", "url", "manufacturer"))
    return found.groupBy("part_number").agg(best.alias("b")).select("part_number", "b.*")


def page_title(html: Column | str) -> Column:
    return F.substring(F.trim(F.regexp_replace(first(html, "(?is)<title[^>]*>(.*?)</title>"), "<[^>]+>", " ")), 1, 200)


def visible_text(html: Column | str) -> Column:
    bare = F.regexp_replace(col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def match_snippet(html: Column | str, variants: Column | str, window: int = 90) -> Column:
    """Visible text around the longest variant that it holds, with an ellipsis where it is cut."""
    t = visible_text(html)
    longest = F.array_sort(col(variants), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    hit = F.get(F.filter(longest, lambda v: F.contains(F.lower(t), v)), 0)
    at = F.instr(F.lower(t), hit)
    begin, end = F.greatest(at - window, F.lit(1)), F.least(at - 1 + F.length(hit) + window, F.length(t))
    body = F.trim(F.substring(t, begin, end - begin + 1))
    return F.when(hit.isNotNull() & (body != ""), F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(end < F.length(t), "…").otherwise("")))


def best_datasheet(html: Column | str, url: Column | str) -> Column:
    """The first PDF link of a page whose address or text speaks of a datasheet or specification, made absolute."""
    links = F.transform(F.regexp_extract_all(col(html), F.lit(r'(?is)(<a[^>]+href="[^"]+\.pdf"[^>]*>.*?</a>)'), F.lit(1)), F.lower)
    raw = F.regexp_extract_all(col(html), F.lit(r'(?is)<a[^>]+href="([^"]+\.pdf)"[^>]*>.*?</a>'), F.lit(1))
    pairs = F.filter(F.arrays_zip(links.alias("l"), raw.alias("r")), lambda p: _holds(p["l"], ["datasheet", "data-sheet", "spec"]))
    href = F.get(pairs, 0)["r"]
    root = F.regexp_extract(col(url), "^([a-zA-Z]+://[^/]+)", 1)
    base = F.regexp_extract(col(url), "^(.*/)", 1)
    return F.when(href.rlike("^[a-zA-Z]+://"), href).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(base, href))


def verify_on_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates (part_number, rank, url) held against crawled pages (url, html): part_number, rank, url, status,
    confidence, up to the first verified one. Blocked addresses are left out.

    Candidates meet pages by address; a page counts as verified where it isn't a search and holds the part number
    anywhere in its html."""
    met = candidates.where(~is_blocked_url("url")).join(pages.select("url", "html"), "url")
    held = F.exists(C.part_variants("part_number"), lambda v: F.contains(F.lower("html"), v))
    met = met.withColumn("_held", held).withColumn("_found", F.col("_held") & ~is_search_url("url"))
    first_hit = met.where("_found").groupBy("part_number").agg(F.min("rank").alias("_first"))
    out = met.join(first_hit, "part_number", "left").where(F.col("_first").isNull() | (F.col("rank") <= F.col("_first")))
    return out.select("part_number", "rank", "url", F.when(F.col("_found"), "verified").otherwise("fetched").alias("status"), F.when(F.col("_found"), 0.9).when(F.col("_held"), 0.2).otherwise(0.1).alias("confidence"))


#: Runs of characters by which pages are found: of four with a digit, or of one to four.
_DIGIT_RUNS = r"(?s)(?=([0-9]...|.[0-9]..|..[0-9].|...[0-9]))"
_RUNS = [r"(?s)(?=(.{%d}))" % k for k in range(1, 5)]


def _runs(text: Column, plain: bool) -> Column:
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.flatten(F.array(*map(found, _RUNS))) if plain else found(_DIGIT_RUNS))


def pages_holding(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """host, part_number and url of the pages of a host that hold a part number anywhere in their html, in any of its forms.

    asked: distinct host and part_number; pages: host, url, html. An index of pages by host and run of four characters
    with a digit is met by the rarest such run of each form, and what is met is verified; so a host of very many pages and
    very many part numbers makes no product. Forms without a digit, or shorter, look for runs of all characters, which only
    the pages of their hosts post.
    """
    forms = asked.withColumn("form", F.explode(C.part_variants("part_number")))
    plain = ~F.col("form").rlike("[0-9]") | (F.length("form") < 4)
    forms = forms.withColumn("plain", plain)
    low = pages.select("host", "url", F.lower("html").alias("text"))
    hosts = forms.where("plain").select("host").distinct()
    index = low.select("host", F.lit(False).alias("plain"), "url", F.explode(_runs(F.col("text"), False)).alias("run"))
    index = index.union(low.join(hosts, "host", "left_semi").select("host", F.lit(True), "url", F.explode(_runs(F.col("text"), True))))
    counts = index.groupBy("host", "plain", "run").agg(F.count("*").alias("n"))
    own = F.when(~F.col("plain"), _runs(F.col("form"), False)).when(F.length("form") < 4, F.array("form")).otherwise(F.array_distinct(F.regexp_extract_all("form", F.lit(_RUNS[3]), F.lit(1))))
    posted = forms.select("host", "part_number", "form", "plain", F.size(own).alias("runs"), F.explode(own).alias("run")).join(counts, ["host", "plain", "run"])
    rarest = posted.groupBy("host", "part_number", "form", "plain").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count("*").alias("known"), F.any_value("runs").alias("runs")).where("known = runs")
    met = rarest.join(index, ["host", "plain", "run"]).select("host", "part_number", "form", "url")
    return met.join(low.select("url", "text"), "url").where(F.contains("text", "form")).select("host", "part_number", "url").distinct()


def verify_by_host(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates (part_number, rank, url) held against all crawled pages (url, html) of their hosts: part_number, rank, url,
    status, confidence, page, n_pages, for each part number up to its first verified candidate.

    verified (0.9): some page of the host that isn't a search holds the part number; page is the first of them by address,
    n_pages how many there are. fetched: the host has pages, and searches repeat the number (0.2) or none has it (0.1).
    unreached (0.0): no page of the host. blocked (0.0): the address is refused, and reported as such. Null addresses are
    unreached; repeated candidates stay.
    """
    marked = candidates.select("part_number", "rank", "url", is_blocked_url("url").alias("_blocked"), url_host("url").alias("host"))
    crawled = pages.select(url_host("url").alias("host"), "url", "html").where("host <> ''")
    asked = marked.where("not _blocked").select("host", "part_number").distinct().join(crawled.select("host").distinct(), "host", "left_semi")
    held = pages_holding(asked, crawled).withColumn("_search", is_search_url("url"))
    found = held.groupBy("host", "part_number").agg(F.min(F.when(~F.col("_search"), F.col("url"))).alias("page"), F.count_if(~F.col("_search")).alias("n_pages"))
    reached = crawled.groupBy("host").agg(F.lit(True).alias("_reached"))
    status = F.when(F.col("_blocked"), "blocked").when(F.col("page").isNotNull(), "verified").when(F.col("_reached"), "fetched").otherwise("unreached")
    met = marked.join(found, ["host", "part_number"], "left").join(reached, "host", "left").withColumn("status", status)
    first_hit = met.where("status = 'verified'").groupBy("part_number").agg(F.min("rank").alias("_first"))
    out = met.join(first_hit, "part_number", "left").where(F.col("_first").isNull() | (F.col("rank") <= F.col("_first")))
    confidence = F.when(F.col("status") == "verified", 0.9).when(F.col("status") != "fetched", 0.0).when(F.col("n_pages").isNotNull(), 0.2).otherwise(0.1)
    return out.select("part_number", "rank", "url", "status", confidence.alias("confidence"), F.when(F.col("status") == "verified", F.col("page")).alias("page"), F.when(F.col("status") == "verified", F.col("n_pages")).otherwise(F.lit(0)).cast("long").alias("n_pages"))


def source_summary(sources: DataFrame, *by: str) -> DataFrame:
    """Sources listed and verified, whether there is a product page and a datasheet, blocked addresses, what the evidence is
    worth (the best status: verified, fetched, else discovered) and the mode (live if any page was met, else simulated)."""
    seen = F.col("status") != "blocked"
    some = lambda *names: F.bool_or(F.col("status").isin(*names))
    out = sources.groupBy(*by).agg(
        F.count_if(seen).alias("sources"), F.count_if(F.col("status") == "verified").alias("verified"), F.coalesce(F.bool_or(seen & (F.col("source_type") == "product_page")), F.lit(False)).alias("has_product_page"),
        F.coalesce(F.bool_or(seen & F.col("source_type").isin("pdf_datasheet", "specification_sheet")), F.lit(False)).alias("has_datasheet"), F.count_if(~seen).alias("blocked"),
        F.when(some("verified"), "verified").when(some("fetched"), "fetched").otherwise("discovered").alias("evidence_status"), F.when(some("verified", "fetched"), "live").otherwise("simulated").alias("discovery_mode"),
    )
    return out


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with each row's other columns taken from the first row of its key; minima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    lead = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return df.select(*keys, order).join(lead, keys).select(*keys, order, "_first.*")


