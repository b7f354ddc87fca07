"""Column functions on addresses: parts, resolution, classes. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host suffixes and extensions of the classes of addresses.
MEDIA_PAGE_HOSTS = (
    "youtube.com", "youtu.be", "m.youtube.com", "music.youtube.com", "vimeo.com", "tiktok.com", "vm.tiktok.com", "instagram.com", "facebook.com", "fb.watch", "fb.com", "m.facebook.com",
    "x.com", "twitter.com", "mobile.twitter.com", "linkedin.com", "dailymotion.com", "dai.ly", "twitch.tv", "clips.twitch.tv", "reddit.com", "v.redd.it", "raiplay.it", "raiplaysound.it",
)
PROTECTED_HOSTS = ("netflix.com", "dazn.com", "primevideo.com", "disneyplus.com", "hbomax.com", "max.com", "paramountplus.com", "tv.apple.com", "nowtv.it", "nowtv.com", "skygo.sky.it")
POST_HOSTS = ("x.com", "mobile.x.com", "twitter.com", "mobile.twitter.com", "facebook.com", "m.facebook.com", "fb.com", "instagram.com", "tiktok.com", "vm.tiktok.com")
POST_MARKS = ("/status/", "/photo", "/posts/", "/permalink", "/p/", "/reel", "/videos/", "/video/", "/t/")
IMAGE_EXTS = ("jpg", "jpeg", "jfif", "png", "bmp", "gif", "tif", "tiff", "webp", "ico")
IMAGE_MARKS = ("/image/", "/images/", "/img/", "/media/", "/photo", "/photos", "format=jpg", "format=png", "format=webp", "f_auto", ".jpg", ".jpeg", ".png", ".webp", ".gif")
MEDIA_EXTS = ("mp3", "m4a", "m4b", "aac", "flac", "ogg", "opus", "wav", "wma", "aif", "aiff", "mka", "mp4", "m4v", "mkv", "avi", "mov", "wmv", "webm", "flv", "mts", "m2ts", "mpg", "mpeg", "3gp")

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def decoded(text: Column) -> Column:
    """Percent signs decoded; a plus stays a plus, a wrong sequence stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def encoded(text: Column) -> Column:
    """Percent-encoded but for letters, digits and `_.~`."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("-", "%2D")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^[^@]*@", ""), r":.*$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host_is(url: Column, names: tuple[str, ...]) -> Column:
    """The host is one of the names or below one."""
    host = host_of(url)
    out = host.isin(*names)
    for name in names:
        out = out | host.endswith("." + name)
    return out


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path with its steps `.` and `..` taken; steps above the top are dropped."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def resolve(base: Column, href: Column) -> Column:
    """An address as seen from a base address, steps up and down taken."""
    base = F.coalesce(base, F.lit(""))
    plain = F.regexp_replace(base, r"#.*$", "")
    without_query = F.regexp_replace(plain, r"\?.*$", "")
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?", 0)
    folder = F.regexp_extract(without_query, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?.*/)[^/]*$", 1)
    folder = F.when(F.char_length(folder) > F.char_length(root), folder).otherwise(F.concat(root, F.when(root.contains("//"), "/").otherwise("")))
    joined = (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(plain, href))
        .when(href.startswith("?"), F.concat(without_query, href))
        .otherwise(F.concat(folder, href))
    )

    def clean(j: Column) -> Column:
        site, path = F.regexp_extract(j, r"^(https?://[^/?#]*)(/[^?#]*)", 1), F.regexp_extract(j, r"^(https?://[^/?#]*)(/[^?#]*)", 2)
        return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(site, without_dots(path), F.regexp_extract(j, r"[?#].*$", 0))).otherwise(j)

    return let(joined, clean)


def classify_link(base: Column, href: Column) -> Column:
    """Struct kind, target, fragment, href. Kinds: skip, mailto, blocked (a file link on a web page), anchor, http, file, other."""

    def of(x: Column) -> Column:
        href, low, target, fragment = x["href"], F.lower(x["href"]), x["target"], x["fragment"]
        own = F.regexp_replace(F.regexp_replace(F.coalesce(base, F.lit("")), r"#.*$", ""), r"/+$", "")
        same = (own != "") & (own == F.regexp_replace(target, r"/+$", ""))
        is_file = F.lower(target).startswith("file:")
        kind = (
            F.when((href == "") | low.rlike(r"^(javascript|data|vbscript):"), "skip")
            .when(low.startswith("mailto:"), "mailto")
            .when(F.lower(base).rlike(r"^https?:") & is_file, "blocked")
            .when((fragment != "") & same, "anchor")
            .when(F.lower(target).rlike(r"^https?:"), "http")
            .when(is_file, "file")
            .otherwise("other")
        )
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "skip", "").when(k == "mailto", href).otherwise(target).alias("target"), F.when(k.isin("skip", "mailto"), "").otherwise(fragment).alias("fragment"), href.alias("href")))

    joined = let(F.trim(href), lambda h: F.struct(h.alias("href"), resolve(base, h).alias("joined")))
    parts = let(joined, lambda j: F.struct(j["href"].alias("href"), F.regexp_replace(j["joined"], r"#.*$", "").alias("target"), decoded(F.regexp_extract(j["joined"], r"#(.*)$", 1)).alias("fragment")))
    return let(parts, of)


def has_extension(url: Column, exts: tuple[str, ...]) -> Column:
    return F.lower(path_of(url)).rlike(rf"\.({'|'.join(exts)})$")


def is_image(url: Column) -> Column:
    low, found = F.lower(F.trim(url)), has_extension(F.trim(url), IMAGE_EXTS)
    for mark in IMAGE_MARKS:
        found = found | low.contains(mark)
    return low.rlike(r"^https?://") & ~low.startswith("https://data:") & ~low.contains("javascript:") & found


def is_social_post(url: Column) -> Column:
    path, marked = F.lower(path_of(url)), F.lit(False)
    for mark in POST_MARKS:
        marked = marked | path.contains(mark)
    return F.lower(url).rlike(r"^https?://") & ~is_image(url) & host_of(url).isin(*POST_HOSTS) & marked


def youtube_id(url: Column) -> Column:
    """The video's id, empty if the address has none."""
    host, path = host_of(url), path_of(url)
    from_path = F.regexp_extract(path, r"/(?:shorts|embed|live)/([^/?#]*)", 1)
    from_query = F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)
    return (
        F.when(host.contains("youtu.be"), F.regexp_extract(path, r"^/*([^/]*)", 1))
        .when((host.contains("youtube.com") | host.contains("youtube-nocookie.com")) & path.contains("/shorts/"), from_path)
        .when(host.contains("youtube.com") | host.contains("youtube-nocookie.com"), F.coalesce(F.nullif(from_query, F.lit("")), from_path))
        .otherwise("")
    )


def image_key(url: Column) -> Column:
    """A key that variants of one picture share: host and path without an image's extension; for ids of content networks host/cdn/id."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r":.*$", ""), r"^www\.", "")
    path = F.regexp_replace(decoded(path_of(F.trim(url))), r"/+$", "")
    path = F.regexp_replace(path, rf"(?i)(?<=[^/])\.({'|'.join(IMAGE_EXTS)})$", "")
    last = F.regexp_extract(path, r"[^/]*$", 0)
    network = last.rlike(r"^[A-Za-z0-9]{12,}$") & F.lower(path).rlike(r"/(dev|upload|image)/")
    return F.when((host == "") | (path == ""), "").when(network, F.concat(host, F.lit("/cdn/"), F.lower(last))).otherwise(F.concat(host, path))
