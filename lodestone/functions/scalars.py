"""Scalar functions on columns: durations, times, slugs, ids, URLs, errors.  All are built-in expressions."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- presence: two notions that are kept apart


def truthy(c: Column, default: Column) -> Column:
    """The value, or the default if it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def present(c: Column, default: Column) -> Column:
    """The value, or the default if it is null; empty stays."""
    return F.coalesce(c, default)


# ---- durations and times


def duration_seconds(c: Column) -> Column:
    """ISO-8601 time durations; only a leading PT..H..M..S counts, anything else is 0."""
    pattern = "^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"
    part = lambda i: F.coalesce(F.expr("bigint(0)") + F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("bigint"), F.lit(0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0).cast("long"))


def format_seconds(c: Column) -> Column:
    """H:MM:SS or M:SS; nothing positive is 0:00."""
    h, m, s = F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    long = F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))
    return F.when(F.coalesce(c, F.lit(0)) <= 0, "0:00").when(h > 0, long).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def is_timecode(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), F.lit(False))


def timecode_seconds(c: Column) -> Column:
    """Whole numbers between colons, however many, in seconds; null where a part is no number."""
    parts = F.transform(F.split(c, ":"), lambda x: x.try_cast("int"))
    return F.aggregate(parts, F.lit(0), lambda a, x: a * 60 + x)


def frame(c: Column, rate: int = 30) -> Column:
    return (c * rate).cast("int")


def sampling_rate(seconds: Column) -> Column:
    """2.0 below five minutes, 1.0 above thirty, else null; 0 is unknown."""
    return F.when((seconds > 0) & (seconds < 300), 2.0).when(seconds > 1800, 1.0)


# ---- names


def slug(c: Column, most: int = 50) -> Column:
    """Null where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), "[^a-z0-9-]", ""), "-+", "-")
    return F.nullif(F.substring(F.trim(x, F.lit("-")), 1, most), F.lit(""))


def component_name(c: Column) -> Column:
    """PascalCase with the suffix Scene; a leading digit gets the prefix Scene; without letters and digits: GeneratedScene."""
    words = F.regexp_extract_all(F.regexp_replace(c, "['\\u2019]", ""), F.lit("([a-zA-Z0-9]+)"), 1)
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
    named = F.when(joined == "", "Generated").when(joined.rlike("^[0-9]"), F.concat(F.lit("Scene"), joined)).otherwise(joined)
    return F.concat(named, F.lit("Scene"))


def scene_key(c: Column) -> Column:
    """snake_case of the words between white space, less a leading article (which may leave nothing); other signs are dropped, not split at."""
    words = F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != "")
    named = F.when(F.get(words, F.lit(0)).isin("the", "a", "an"), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    plain = F.regexp_replace(F.array_join(named, "_"), "[^a-z0-9_]", "")
    return F.trim(F.regexp_replace(plain, "_+", "_"), F.lit("_"))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tag_list(c: Column, most: int = 10) -> Column:
    return truthy(F.array_join(F.slice(c, 1, most), ", "), F.lit("none"))


# ---- keys and ids

#: The name space of name-based ids (RFC 9562, DNS).
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """A name-based id: SHA-1 of name space and name, with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), name.cast("binary")))
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(cut(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def cache_key(content_id: Column, tool: Column, instruction: Column, model: Column) -> Column:
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 8)
    return F.concat_ws("_", content_id, tool, F.when(F.coalesce(instruction, F.lit("")) == "", "default").otherwise(short(instruction)), short(model))


def short_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, digits)


# ---- URLs

VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com"]
SHORT_HOSTS = ["youtu.be", "www.youtu.be"]


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    return F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1)


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def video_id(url: Column) -> Column:
    """From a short link, ?v=, or /shorts/, /embed/, /live/; a bare id is itself; null for anything else."""
    u = F.replace(F.trim(url), F.lit("\\"), F.lit(""))
    host, path = url_host(u), url_path(u)
    bare = F.when(~F.contains(u, F.lit("://")) & valid_id(u), u)
    short = F.when(host.isin(SHORT_HOSTS), F.regexp_extract(path, "^/([^/&]*)", 1))
    named = F.when(host.isin(VIDEO_HOSTS), F.coalesce(F.nullif(query_value(u, "v"), F.lit("")), F.nullif(F.regexp_extract(path, "^/(?:shorts|embed|live)/([^/&]*)", 1), F.lit(""))))
    found = F.coalesce(short, named, bare)
    return F.when(valid_id(found), found)


def video_url(found: Column) -> Column:
    """The one form of a video's address, from its id."""
    return F.concat(F.lit("https://www.youtube.com/watch?v="), found)


def is_video_url(url: Column) -> Column:
    return F.coalesce(url_host(url).isin(VIDEO_HOSTS + SHORT_HOSTS), F.lit(False))


def playlist_id(url: Column) -> Column:
    found = query_value(url, "list")
    return F.when(is_video_url(url) & valid_id(found), found)


def paper_pdf(url: Column) -> Column:
    """arXiv abstract pages and PDFs as the PDF's address; other URLs stay."""
    found = F.regexp_extract(url, "^https?://(?:www\\.)?arxiv\\.org/(?:abs|pdf)/([^?#]+?)(?:\\.pdf)?/?(?:[?#].*)?$", 1)
    return F.when(found != "", F.concat(F.lit("https://arxiv.org/pdf/"), found, F.lit(".pdf"))).otherwise(url)


#: Networks that a download may not reach (private, loopback, link-local, multicast and reserved ones), and
#: networks within them that it may.
BLOCKED_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"]
OPEN_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
BLOCKED_V6 = ["::/3", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/2", "8000::/2", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8"]
OPEN_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def _in_networks(words: Column, networks: list[str], bits: int) -> Column:
    """Whether an address, as an array of numbers of ``bits`` bits, is in one of the networks."""
    out = F.lit(False)
    for n in map(ip_network, networks):
        whole, rest = divmod(n.prefixlen, bits)
        numbers = [int(n.network_address) >> (n.max_prefixlen - bits * (i + 1)) & (1 << bits) - 1 for i in range(whole + bool(rest))]
        same = F.lit(True)
        for i, number in enumerate(numbers):
            drop = 0 if i < whole else bits - rest
            same = same & (F.shiftright(F.get(words, F.lit(i)), drop) == number >> drop)
        out = out | same
    return out


def ip_numbers_v6(host: Column) -> Column:
    """The eight numbers of an address in square brackets; null if it is none.  A dotted tail counts as two of them."""
    inner = F.regexp_extract(host, "^\\[([0-9a-f:.]+)(?:%[^\\]]*)?\\]$", 1)
    tail = F.transform(F.split(F.regexp_extract(inner, "([0-9.]+\\.[0-9]+)$", 1), "\\."), lambda x: x.try_cast("int"))
    pair = F.concat_ws(":", F.lower(F.hex(F.get(tail, F.lit(0)) * 256 + F.get(tail, F.lit(1)))), F.lower(F.hex(F.get(tail, F.lit(2)) * 256 + F.get(tail, F.lit(3)))))
    plain = F.when(inner.contains("."), F.concat(F.regexp_replace(inner, "[0-9.]+\\.[0-9]+$", ""), pair)).otherwise(inner)
    part = lambda t: F.filter(F.split(t, ":"), lambda x: x != "")
    head, end = part(F.substring_index(plain, "::", 1)), F.when(plain.contains("::"), part(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    gap = F.when(plain.contains("::"), F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(end), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.concat(head, gap, end), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.when((inner != "") & (F.size(words) == 8), words)


def blocked_address(host: Column) -> Column:
    """Whether a host is a literal address in a blocked network, or localhost.  Names are not resolved."""
    v4 = F.when(host.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"), F.transform(F.split(host, "\\."), lambda x: x.try_cast("int")))
    v6 = ip_numbers_v6(host)
    hit4 = _in_networks(v4, BLOCKED_V4, 8) & ~_in_networks(v4, OPEN_V4, 8)
    hit6 = _in_networks(v6, BLOCKED_V6, 16) & ~_in_networks(v6, OPEN_V6, 16)
    return F.coalesce(hit4, F.lit(False)) | F.coalesce(hit6, F.lit(False)) | (host == "localhost")


def url_policy(url: Column) -> Column:
    """Why a download is refused, or ok: https only, no user info, a host, no address that is private or reserved."""
    host = url_host(url)
    return (
        F.when(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)) != "https", "not https")
        .when(url.rlike("^[A-Za-z]+://(?!:?@)[^/?#]*@"), "user info")
        .when(host == "", "no host")
        .when(blocked_address(host), "blocked address")
        .otherwise("ok")
    )


def store_url(c: Column) -> Column:
    """A store's address with a scheme: http for local and private hosts, https for others; a placeholder is empty."""
    x = F.trim(F.coalesce(c, F.lit("")))
    host = F.lower(F.regexp_extract(x, "^([^/:]*)", 1))
    private = host.isin("localhost", "0.0.0.0") | host.rlike("^(127|10)\\.[0-9.]+$|^192\\.168\\.[0-9.]+$|^172\\.(1[6-9]|2[0-9]|3[01])\\.[0-9.]+$")
    return F.when((x == "") | x.startswith("${"), "").when(x.rlike("^https?://"), x).when(private, F.concat(F.lit("http://"), x)).otherwise(F.concat(F.lit("https://"), x))


def download_name(url: Column, default: str = "document.pdf") -> Column:
    """What follows the last slash, less a query, if it has a dot."""
    name = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    return F.when(name.contains("."), name).otherwise(default)


# ---- files


MIME_TYPES = {
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "xml": "text/xml", "json": "application/json", "csv": "text/csv",
    "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "mpeg": "video/mpeg", "wmv": "video/wmv", "3gpp": "video/3gpp",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), "\\.([^.]+)$", 1))


def mime_type(path: Column) -> Column:
    """Null for an unknown extension."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv)), extension(path))


def within(path: Column, root: str) -> Column:
    """Whether a normalized path is the root or below it."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


# ---- errors

#: Words of a message that say a call may be tried again.
RETRYABLE = ["429", "quota", "resource_exhausted", "timeout", "503", "service unavailable"]


def retryable(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(RETRYABLE)), F.lit(False))


#: Categories by the kind of an error, tried before its message.
ERROR_KINDS = {"url policy": "URL_POLICY_BLOCKED", "permission": "PERMISSION_DENIED", "timeout": "NETWORK_ERROR", "network": "NETWORK_ERROR"}
#: Categories by words of the message, in the order in which they are tried; of each list one word must occur.
ERROR_WORDS = [
    ("API_PERMISSION_DENIED", [["403"], ["permission"]]),
    ("VIDEO_RESTRICTED", [["403"]]),
    ("API_QUOTA_EXCEEDED", [["429", "quota", "resource_exhausted"]]),
    ("API_INVALID_ARGUMENT", [["400", "invalid mode", "invalid thinking level"]]),
    ("VIDEO_UNAVAILABLE", [["404"]]),
    ("VIDEO_PRIVATE", [["private"]]),
    ("VIDEO_UNAVAILABLE", [["unavailable"]]),
    ("NETWORK_ERROR", [["timeout", "timed out"]]),
    ("FILE_NOT_FOUND", "file not found"),
    ("FILE_UNSUPPORTED", [["unsupported video extension"]]),
    ("WEAVIATE_CONNECTION", [["weaviate"], ["connect", "unreachable", "refused"]]),
    ("WEAVIATE_SCHEMA", [["weaviate"], ["schema", "collection"]]),
    ("WEAVIATE_IMPORT", [["weaviate"], ["import", "insert", "batch"]]),
    ("WEAVIATE_QUERY", [["weaviate"]]),
]
#: Categories after which a call may be tried again.
RETRY_CATEGORIES = ["API_QUOTA_EXCEEDED", "NETWORK_ERROR", "WEAVIATE_CONNECTION"]


def error_category(message: Column, kind: Column | None = None) -> Column:
    """The first category that fits.  ``kind`` is the class of an error: a key of ERROR_KINDS, 'file not found', or anything else."""
    m, kind = F.lower(F.coalesce(message, F.lit(""))), F.lit(None).cast("string") if kind is None else kind
    out = F.when(F.lit(False), "")
    for name, category in ERROR_KINDS.items():
        out = out.when(kind == name, category)
    for category, words in ERROR_WORDS:
        hit = kind == words if isinstance(words, str) else reduce(lambda a, b: a & b, (m.rlike("|".join(w)) for w in words))
        out = out.when(hit, category)
    return out.otherwise("UNKNOWN")


def retry_category(category: Column) -> Column:
    return category.isin(RETRY_CATEGORIES)


def retry_after(category: Column) -> Column:
    return F.when(category == "API_QUOTA_EXCEEDED", 60)


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


# ---- text


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def fenced_code(c: Column) -> Column:
    """The first fenced block, which may be empty; else the text itself if it looks like a module; else null."""
    pattern = "(?s)```(?:typescript|tsx|ts)?\\s*(.*?)```"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).when(c.contains("import") & c.contains("export"), strip(c))


def markdown_links(c: Column) -> Column:
    """Targets of links but web addresses and fragments, as written."""
    found = F.regexp_extract_all(c, F.lit("\\[.*?\\]\\(([^)]+)\\)"), 1)
    return F.filter(found, lambda x: ~x.rlike("^(https?://|#)") & (link_path(x) != ""))


def link_path(c: Column) -> Column:
    """A link without fragment and query."""
    return F.substring_index(F.substring_index(c, "#", 1), "?", 1)


def resolve(folder: Column, path: Column) -> Column:
    """The absolute path of ``path`` as seen from an absolute folder, with . and .. taken out."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", folder, path))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(steps, none, lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(none))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def screenshots(c: Column) -> Column:
    """Markers [SCREENSHOT:MM:SS:text] as structs of time and text."""
    found = F.regexp_extract_all(c, F.lit("(\\[SCREENSHOT:[0-9]+:[0-9]{2}:[^\\]]*\\])"), 1)
    return F.transform(found, lambda x: F.struct(F.concat(F.lpad(F.regexp_extract(x, ":([0-9]+):", 1), 2, "0"), F.lit(":"), F.regexp_extract(x, ":[0-9]+:([0-9]{2}):", 1)).alias("time"), F.regexp_extract(x, ":[0-9]+:[0-9]{2}:([^\\]]*)\\]", 1).alias("text")))


def looks_like_html(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(F.contains(low, F.lit("<html")) & F.contains(low, F.lit("</html>")), F.lit(False))


def lenient_json(c: Column) -> Column:
    """Compact JSON where the text is JSON, else the text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)
