"""Feed entries in one schema: texts, links, tags, authors, places, chapters, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dates import parse_feed_date
from ..functions.text import collapse_ws, contains_all, head_of, parse_clock
from ..functions.urls import let
from .pages import body_text, decode_entities, marked
from .search import sort_results

#: Schemes that an address of a feed may have.
SCHEMES = ("file", "ftp", "gopher", "h323", "hdl", "http", "https", "imap", "magnet", "mailto", "mms", "news", "nntp", "prospero", "rsync", "rtsp", "rtspu", "sftp", "shttp", "sip", "sips", "snews", "svn", "svn+ssh", "telnet", "wais", "aim", "callto", "cvs", "facetime", "feed", "git", "gtalk", "irc", "ircs", "irc6", "itms", "mvn", "skype", "smb", "sms", "ssh", "steam", "view-source", "xmpp", "ymsgr")
HTML_LIKE = r"(?is)<(a|b|br|p|i|em|strong|div|span|img|ul|ol|li|h[1-6]|table|blockquote|pre|code)\b[^>]*>|&(#\d+|#x[0-9a-f]+|amp|lt|gt|quot|nbsp);"


def full(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_of(*columns: str) -> Column:
    return F.coalesce(*[full(F.col(f"`{c}`")) for c in columns])


def entry_links(raw: DataFrame) -> Column:
    """Links of an entry: href, rel (alternate by default), type, length; the text of a plain link element, and enclosures."""
    plain = F.transform(F.coalesce("link", F.array()), lambda x: F.struct(F.coalesce(full(x["_href"]), full(x["_VALUE"])).alias("href"), F.coalesce(full(x["_rel"]), F.lit("alternate")).alias("rel"), F.coalesce(full(x["_type"]), F.when(x["_rel"] == "self", "application/atom+xml").otherwise("text/html")).alias("type"), full(x["_length"]).alias("length")))
    enclosed = F.transform(F.coalesce("enclosure", F.array()), lambda x: F.struct(full(x["_url"]).alias("href"), F.lit("enclosure").alias("rel"), full(x["_type"]).alias("type"), full(x["_length"]).alias("length")))
    own = F.when(F.col("_href").isNotNull(), F.array(F.struct(full(F.col("_href")).alias("href"), F.lit("alternate").alias("rel"), F.lit("text/html").alias("type"), F.lit(None).cast("string").alias("length"))))
    empty = F.array().cast("array<struct<href:string,rel:string,type:string,length:string>>")
    return F.filter(F.concat(F.coalesce(plain, empty), F.coalesce(enclosed, empty), F.coalesce(own, empty)), lambda x: x["href"].isNotNull())


def entry_tags() -> Column:
    """Distinct (term, scheme, label) in order: categories, subjects, keyword lists, podcast categories."""
    kind = "array<struct<term:string,scheme:string,label:string>>"
    nothing = F.array().cast(kind)
    none = F.lit(None).cast("string")
    tag = lambda t, s=none, lab=none: F.struct(t.alias("term"), s.alias("scheme"), lab.alias("label"))
    words = lambda c: F.transform(F.filter(F.transform(F.split(c, ","), lambda w: F.trim(w)), lambda w: w != ""), lambda w: tag(w))
    lists = [
        F.transform(F.col("category"), lambda c: tag(F.coalesce(full(c["_term"]), full(c["_VALUE"])), F.coalesce(full(c["_scheme"]), full(c["_domain"])), full(c["_label"]))),
        F.transform(F.col("`dc:subject`"), lambda c: tag(full(c))),
        F.flatten(F.transform(F.col("keywords"), words)),
        words(F.col("`itunes:keywords`")),
        F.transform(F.col("`itunes:category`"), lambda c: tag(full(c["_text"]), F.lit("http://www.itunes.com/"))),
    ]
    every = F.concat(*[F.coalesce(x.cast(kind), nothing) for x in lists])
    return F.array_distinct(F.filter(every, lambda t: t["term"].isNotNull()))


def person(text: Column) -> Column:
    """Name and email of `Name (mail)`, `mail (Name)`, `Name <mail>`, a mail or a name."""
    mail = F.nullif(F.regexp_extract(text, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:\?subject=\S+)?)", 1), F.lit(""))
    rest = F.when(mail.isNull(), text).otherwise(F.replace(text, mail, F.lit("")))
    name = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\(\)|<>|&lt;&gt;", ""), r"^[\s(<]+|[\s)>]+$", ""))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), mail.alias("email"))


def entry_people(column: str, *texts: str) -> Column:
    """People of an element, given whole or as free text."""
    kind = "array<struct<name:string,email:string>>"
    given = F.transform(F.col(column), lambda a: F.when(a["name"].isNotNull() | a["email"].isNotNull(), F.struct(full(a["name"]).alias("name"), full(a["email"]).alias("email"))).otherwise(person(a["_VALUE"])))
    free = [F.when(full(F.col(f"`{t}`")).isNotNull(), F.array(person(F.col(f"`{t}`")))) for t in texts]
    every = F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (given, *free)])
    return F.array_distinct(F.filter(every, lambda p: p["name"].isNotNull() | p["email"].isNotNull()))


def person_label(p: Column) -> Column:
    """`name (email)`, or the one that there is."""
    return F.when(p["name"].isNotNull() & p["email"].isNotNull(), F.concat(p["name"], F.lit(" ("), p["email"], F.lit(")"))).otherwise(F.coalesce(p["name"], p["email"]))


def normalize_entries(raw: DataFrame) -> DataFrame:
    """One schema for all formats: feed, bozo, id, title, link, links, summary, content, published, updated, created, expired (UTC), author, authors, contributors, tags, category, rights, enclosures, license, guid_is_link. A summary is empty where its elements are, null where there is none."""
    links = entry_links(raw)
    guid = full(F.col("guid")["_VALUE"])
    permalink = guid.isNotNull() & (F.lower(F.coalesce(full(F.col("guid")["_isPermaLink"]), F.lit("true"))) == "true")
    rows = raw.withColumn("links", links).withColumn("authors", entry_people("author", "dc:creator", "itunes:author")).withColumn("tags", entry_tags())
    alternate = F.get(F.filter("links", lambda x: (x["rel"] == "alternate") & x["type"].isin("text/html", "application/xhtml+xml")), F.lit(0))["href"]
    by_rel = lambda rel: F.filter("links", lambda x: x["rel"] == rel)
    content = F.filter(F.concat(F.transform(F.coalesce("content", F.array()).cast("array<struct<_VALUE:string,_type:string,_src:string,_mode:string>>"), lambda c: full(c["_VALUE"])), F.array(full(F.col("`content:encoded`")))), lambda c: c.isNotNull())
    said = ("summary", "description", "subtitle", "abstract", "dc:description", "itunes:summary")
    blank = [F.trim(F.col(f"`{c}`")) for c in said]  # elements that say nothing
    published = parse_feed_date(first_of("pubDate", "published", "issued"))
    updated = parse_feed_date(first_of("updated", "modified", "lastBuildDate", "dc:date", "_lastmod"))
    return rows.select(
        "feed", "bozo", F.coalesce(guid, first_of("id", "_rdf:about", "dc:identifier")).alias("id"), first_of("title", "dc:title").alias("title"),
        F.coalesce(alternate, F.when(permalink, guid)).alias("link"), "links",
        F.coalesce(first_of(*said), F.get(content, F.lit(0)), *blank).alias("summary"), content.alias("content"),
        published.alias("published"), F.coalesce(updated, published).alias("updated"), parse_feed_date(full(F.col("created"))).alias("created"), parse_feed_date(full(F.col("expirationDate"))).alias("expired"),
        person_label(F.get("authors", F.lit(0))).alias("author"), "authors", entry_people("contributor").alias("contributors"), "tags", F.get("tags", F.lit(0))["term"].alias("category"),
        first_of("rights", "copyright", "dc:rights").alias("rights"), by_rel("enclosure").alias("enclosures"), F.coalesce(F.get(by_rel("license"), F.lit(0))["href"], first_of("creativeCommons:license")).alias("license"),
        (permalink & alternate.isNull()).alias("guid_is_link"),
    )


def entry_body(entries: DataFrame) -> Column:
    """The first content, else the summary."""
    return F.coalesce(F.get("content", F.lit(0)), F.col("summary"), F.lit(""))


def with_text(entries: DataFrame, keep: list[str], use) -> DataFrame:
    """`keep` and the fields of the structs of `use(text)`, an array of rows for each entry, by its body as clean text.

    What looks like HTML is read as a page, all of it, the rest stays; HTML
    without any text gives no row. An entry is read once, and its text stays in its row: it
    crosses no exchange, and no line becomes a row. Rows are made from an array,
    since a filter on the text would be moved below and work it out again.
    """
    html = F.col("__html")
    body = entries.select(*keep, entry_body(entries).alias("__html"), F.coalesce("link", F.lit("")).alias("__url"))
    tagged = body.withColumn("__tagged", html.rlike(HTML_LIKE)).withColumn("__page", F.when(F.col("__tagged"), marked(html))).withColumn("__plain", F.when(~F.col("__tagged"), html))
    read = decode_entities(tagged.select(*keep, "__url", "__tagged", "__page", "__plain"), "__page")
    text = F.when(F.col("__tagged"), body_text(F.col("__page"), F.col("__url"))).otherwise(F.col("__plain"))
    none = F.col("__tagged")
    return read.select(*keep, F.inline(let(text, lambda t: F.filter(use(t), lambda _: ~none | (t != "")))))


def entry_text(entries: DataFrame, key: str) -> DataFrame:
    """key, text: each entry's body as clean text; what looks like HTML is read as a page, the rest stays."""
    return with_text(entries, [key], lambda t: F.array(F.struct(t.alias("text"))))


def resolve_uris(df: DataFrame, url_col: str, base_col: str) -> DataFrame:
    """Addresses made absolute by a base; one with a scheme that is not allowed becomes empty."""
    joined = U.resolve(F.col(base_col), F.trim(url_col))
    scheme = F.lower(F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return df.withColumn(url_col, F.when((scheme == "") | scheme.isin(*SCHEMES), joined).otherwise(""))


def geometry(kind: str, text: Column, swap: bool = True, dims: int = 2) -> Column:
    """Struct type, coordinates of a point, line, polygon (4 or more places) or box: pairs (or triples) as lon, lat; null if the text is none."""
    numbers = F.transform(F.split(F.trim(F.regexp_replace(text, r"[\s,]+", " ")), " "), lambda x: x.try_cast("double"))
    n = F.size(numbers)
    places = F.transform(F.sequence(F.lit(0), F.floor(n / dims).cast("int") - 1), lambda i: F.concat(F.array(F.get(numbers, i * dims + (1 if swap else 0)), F.get(numbers, i * dims + (0 if swap else 1))), F.slice(numbers, i * dims + 3, F.lit(dims - 2))))
    least = {"point": 1, "line": 2, "polygon": 4, "box": 2}[kind]
    good = F.forall(numbers, lambda x: x.isNotNull()) & (n % dims == 0) & (n >= least * dims)
    exact = {"point": n == dims, "box": n == 2 * dims}.get(kind, F.lit(True))
    name = {"point": "Point", "line": "LineString", "polygon": "Polygon", "box": "Box"}[kind]
    return F.when(good & exact, F.struct(F.lit(name).alias("type"), places.alias("coordinates")))


def entry_geometry(raw: DataFrame) -> Column:
    """The entry's place: a point, line, polygon, box, or separate latitude and longitude."""
    shapes = [geometry(k, F.col(f"`georss:{k}`")) for k in ("point", "line", "polygon", "box")]
    apart = geometry("point", F.concat_ws(" ", F.col("`geo:lat`"), F.col("`geo:long`")))
    return F.coalesce(*shapes, F.when(F.col("`geo:lat`").isNotNull() & F.col("`geo:long`").isNotNull(), apart))


def entry_chapters(raw: DataFrame) -> Column:
    """Chapters: start_sec, title, href, image."""
    chapters = F.col("`psc:chapters`")["psc:chapter"]
    return F.transform(chapters, lambda c: F.struct(parse_clock(c["_start"]).alias("start_sec"), c["_title"].alias("title"), c["_href"].alias("href"), c["_image"].alias("image")))


def entry_media(raw: DataFrame) -> DataFrame:
    """The media and podcast fields of entries as they stand, with explicit (yes true, clean false, else null) and block."""
    m = lambda n: F.col(f"`media:{n}`")
    said = F.lower(F.trim(F.col("`itunes:explicit`")))
    return raw.select(
        "feed", F.coalesce(full(F.col("guid")["_VALUE"]), first_of("id")).alias("id"),
        F.transform(m("content"), lambda c: F.struct(c["_url"].alias("url"), c["_type"].alias("type"), c["_medium"].alias("medium"), c["_width"].try_cast("int").alias("width"), c["_height"].try_cast("int").alias("height"), c["_duration"].try_cast("double").alias("duration"))).alias("media_content"),
        F.transform(m("thumbnail"), lambda c: F.struct(c["_url"].alias("url"), c["_width"].try_cast("int").alias("width"), c["_height"].try_cast("int").alias("height"))).alias("media_thumbnail"),
        F.struct(m("rating")["_VALUE"].alias("content"), m("rating")["_scheme"].alias("scheme")).alias("media_rating"),
        F.transform(m("credit"), lambda c: F.struct(c["_VALUE"].alias("content"), c["_role"].alias("role"))).alias("media_credit"),
        F.struct(m("restriction")["_VALUE"].alias("content"), m("restriction")["_relationship"].alias("relationship")).alias("media_restriction"),
        F.struct(m("license")["_VALUE"].alias("content"), m("license")["_href"].alias("href")).alias("media_license"), F.coalesce(m("player")["_url"], m("player")["_VALUE"]).alias("media_player"),
        F.col("`itunes:author`").alias("podcast_author"), F.col("`itunes:image`")["_href"].alias("podcast_image"), parse_clock(F.col("`itunes:duration`")).alias("duration_sec"),
        F.when(said == "yes", True).when(said == "clean", False).alias("explicit"), (F.lower(F.trim(F.col("`itunes:block`"))) == "yes").alias("block"),
        F.col("`creativeCommons:license`").alias("license"), F.col("`admin:generatorAgent`").alias("generator"), F.col("`admin:errorReportsTo`").alias("error_reports_to"),
    )


def search_articles(entries: DataFrame, key: str, terms: list[str], raw_lines: bool = False, mode: str = "newest", snippet: int | None = 200) -> DataFrame:
    """One hit per article whose clean text, all of it, or title holds every term: feed, key, name (title), date, link, tag, snippet (as many characters of the text, None: all), n_raw; with `raw_lines`, the lines instead."""
    named = entries.where(F.col(key).isNotNull()).withColumn("name", F.col("title"))
    if raw_lines:
        lines = lambda t: F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: contains_all(x["line"], terms))
        rows = with_text(named.withColumn("date", F.col("published")), [key, "feed", "name", "date", "link"], lines)
        return rows.select(key, "line_no", "line", "feed", "name", "date", "link").withColumn("tag", F.lit("[FEED-RIGA]"))

    def hit(t: Column) -> Column:
        raw = F.size(F.filter(F.split(t, "\n"), lambda x: contains_all(x, terms)))
        row = F.struct(F.lit("[FEED]").alias("tag"), head_of(collapse_ws(t), snippet).alias("snippet"), raw.alias("n_raw"))
        return F.when(contains_all(F.concat_ws("\n", F.col("name"), t), terms), F.array(row))

    hits = with_text(named.withColumn("date", F.coalesce("published", "updated")), ["feed", key, "name", "date", "link"], hit)
    first = F.row_number().over(Window.partitionBy(key).orderBy("name"))
    return sort_results(hits.withColumn("__turn", first).where("__turn = 1").drop("__turn"), mode)
