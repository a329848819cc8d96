"""Column normalisers: slugs, links, paths, titles, escapes, keys. All JVM-side unless said."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_c = lambda x: F.col(x) if isinstance(x, str) else x


def empty_to_null(c: Column) -> Column:
    """Blank strings count as missing."""
    return F.when(F.trim(c) != "", c)


def slugify(c: Column, cap: int = 160) -> Column:
    """Runs of anything but letters, digits, ``._-`` become ``_``; trimmed, then capped; ``untitled`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\n", " "), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.left(F.btrim(s, F.lit("_")), F.lit(cap)), F.lit("")), F.lit("untitled"))


def slugify_query(c: Column, cap: int = 60) -> Column:
    """Lower-case slug of letters and digits for feed queries; ``query`` if nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.left(s, F.lit(cap)), F.lit("")), F.lit("query"))


def split_links(c: Column) -> Column:
    """Links of a ragged cell: separated by ``|``, line ends or white space before ``http``."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", "|"), r"\s+(?=https?://)", "|")
    return F.filter(F.transform(F.split(s, r"\|"), F.trim), lambda x: x.startswith("http"))


def url_file(c: Column) -> Column:
    """Last path segment of a URL, percent-decoded."""
    return F.element_at(F.split(F.try_url_decode(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"\+", "%2B")), "/"), -1)


def split_name(c: Column) -> Column:
    """struct<stem, ext> of a file name; ext with its dot, empty if there is none."""
    ext = F.regexp_extract(c, r"(?<=.)(\.[A-Za-z0-9]+)$", 1)
    return F.struct(F.left(c, F.length(c) - F.length(ext)).alias("stem"), ext.alias("ext"))


def local_path_for(url: Column, folder: str = "raw") -> Column:
    """Where a downloaded link is kept: kind folder, slugged stem, extension."""
    name = split_name(url_file(url))
    return F.concat_ws("/", F.lit(folder), kind_for(url), F.concat(slugify(name["stem"]), F.lower(name["ext"])))


def kind_for(url: Column) -> Column:
    """images, videos or docs by suffix."""
    s = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(s.rlike(r"\.(jpe?g|png|gif|webp|tiff?|bmp)$"), "images").when(s.rlike(r"\.(mp4|mov|m4v|webm|avi|mkv)$"), "videos").otherwise("docs")


def repair_link(link: Column, thumbs: Column) -> Column:
    """A link without a usable file name is derived from the first ``/thumbnail/`` image, as a PDF beside it."""
    base = F.element_at(F.split(link, "/"), -1)
    broken = F.contains(link, F.lit("+M")) | ~F.contains(base, F.lit("."))
    thumb = F.get(thumbs, F.lit(0))
    fixed = F.regexp_replace(F.regexp_replace(thumb, "/thumbnail/", "/"), r"\.[A-Za-z]+$", ".pdf")
    return F.when(broken & F.contains(thumb, F.lit("/thumbnail/")), fixed).otherwise(link)


def clean_title(c: Column) -> Column:
    """White space to single spaces; blank titles are null."""
    return empty_to_null(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """HTML entities to characters, trimmed (Python: there is no built-in for all entities)."""
    return s.map(lambda x: html.unescape(x).strip() if isinstance(x, str) else None)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, unlike ``initcap``."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def location_name(*parts: Column) -> Column:
    """Non-empty parts, title-cased and joined by commas."""
    return title_case(F.concat_ws(", ", *[empty_to_null(p) for p in parts]))


def sighting_title(shape: Column, where: Column, when: Column, summary: Column) -> Column:
    """``Shape over place (date)``, else the head of the summary, else a constant."""
    shape, where, summary = empty_to_null(shape), empty_to_null(where), empty_to_null(summary)
    head = F.concat(title_case(F.coalesce(shape, F.lit("Object"))), F.concat(F.lit(" over "), where), F.coalesce(F.concat(F.lit(" ("), empty_to_null(when), F.lit(")")), F.lit("")))
    cut = F.when(F.length(summary) > 80, F.concat(F.left(summary, F.lit(80)), F.lit("…"))).otherwise(summary)
    return F.coalesce(head, cut, F.lit("Sighting report"))


def strip_outlet(title: Column, source: Column) -> Column:
    """Drop a trailing `` - source``."""
    tail = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, tail), F.left(title, F.length(title) - F.length(tail))).otherwise(title)


def templated_field(text: Column, names: str, cap: int | None = None) -> Column:
    """Value of the first ``name: value`` line (within the first ``cap`` characters); ``names`` is a regex alternation."""
    return empty_to_null(F.trim(F.regexp_extract(text if cap is None else F.left(text, F.lit(cap)), rf"(?im)^[ \t]*(?:{names})[ \t]*:[ \t]*(.+)$", 1)))


def by_map(c: Column, mapping: dict[str, str], default: str | None) -> Column:
    """Value of a small literal map, else the default."""
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def provenance(source: Column, ladder: dict[str, str] | None = None) -> Column:
    """Trust level of a source: ``official_*`` sources are official, others by ``ladder``, else unverified."""
    return F.when(F.startswith(source, F.lit("official_")), "official").otherwise(by_map(source, ladder or {}, "unverified"))


def yaml_escape(c: Column) -> Column:
    """Quote a scalar that YAML would read otherwise."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.rlike(r"""[:#\[\]{},&*!|>'"%@`]"""), quoted).otherwise(c)


def yaml_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, yaml_escape), ", "), F.lit("]"))


def encode_path(c: Column) -> Column:
    """Percent-encode the path of a URL segment by segment; scheme, host and query stay."""
    head = F.regexp_extract(c, r"^([a-z]+://[^/]*)", 1)
    rest = F.substr(c, F.length(head) + 1)
    path, query = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)
    seg = lambda s: F.replace(F.url_encode(F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)), F.lit("+"), F.lit("%20"))
    return F.concat(head, F.array_join(F.transform(F.split(path, "/"), seg), "/"), query)


def assemble(*parts: Column, sep: str = "\n", cap: int | None = None, marker: str = "") -> Column:
    """Join the non-blank parts; a text over ``cap`` is cut and marked."""
    s = F.concat_ws(sep, *[empty_to_null(p) for p in parts])
    if cap is None:
        return s
    return F.when(F.length(s) > cap, F.concat(F.left(s, F.lit(cap)), F.lit(marker))).otherwise(s)


def rekey(c: Column, prefix: str) -> Column:
    """Drop ``prefix``; of other keys the first ``:`` becomes ``_``."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(F.regexp_replace(c, r"^([^:]*):", "$1_"))


def drop_article(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:an|a) ", "")


def node_label(c: Column) -> Column:
    """A ``type:some_name`` node id as words."""
    return F.replace(F.regexp_replace(c, r"^[^:]*:", ""), F.lit("_"), F.lit(" "))


def best_by(arr: Column, *fields: str) -> Column:
    """Element of an array of structs greatest by ``fields`` in turn; null for an empty array."""
    keyed = F.transform(arr, lambda x: F.struct(*[x[f].alias(f"k{i}") for i, f in enumerate(fields)], x.alias("v")))
    return F.array_max(keyed)["v"]


def hash_ip(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(12))


def hit_key(keyword: Column, context: Column) -> Column:
    """Content key of a keyword hit: both parts, with a NUL between."""
    return F.sha1(F.concat(keyword, F.decode(F.unhex(F.lit("00")), "UTF-8"), context))


def body_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def parse_duration(c: Column) -> Column:
    """Whole seconds of a numeric text; null unless greater than 0."""
    n = c.try_cast("double")
    return F.when((n > 0) & (n < 2147483647), n.cast("int"))


def thumb_path(c: Column) -> Column:
    """``raw/<rest>`` image -> ``raw/thumbs/<rest>.jpg``; null for anything else."""
    return F.when(c.rlike(r"(?i)^raw/.+\.(jpe?g|png|webp|gif|tiff?)$"), F.concat(F.regexp_replace(c, "^raw/", "raw/thumbs/"), F.lit(".jpg")))


def first_available(existing: Column, *arrays: Column) -> Column:
    """First path, in the order of ``arrays``, that is in the array ``existing``."""
    every = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.get(F.filter(every, lambda p: F.array_contains(existing, p)), F.lit(0))


def row_image(thumbs: Column, primaries: Column) -> Column:
    """First thumbnail, else first primary that is an image, else empty."""
    pics = F.filter(primaries, lambda p: p.rlike(r"(?i)\.(jpe?g|png|gif|webp)$"))
    return F.coalesce(F.get(thumbs, F.lit(0)), F.get(pics, F.lit(0)), F.lit(""))


def child_id(parent: Column, page: Column, file: Column) -> Column:
    """Id of a picture cut from a record: page and the last number of the file's stem."""
    return F.concat(parent, F.lit("__img_p"), page, F.lit("_"), F.substring_index(split_name(F.element_at(F.split(file, "/"), -1))["stem"], "_", -1))


def image_source(path: Column) -> Column:
    """struct<kind, parent>: a picture cut from a PDF, or one of its own."""
    stem = split_name(F.element_at(F.split(path, "/"), -1))["stem"]
    cut = F.contains(path, F.lit("images_extracted"))
    return F.struct(F.when(cut, "pdf_embedded").otherwise("standalone").alias("kind"), F.when(cut, F.regexp_extract(stem, r"^(.*)__p", 1)).alias("parent"))


def notes(*flagged: tuple[Column, str]) -> Column:
    """The notes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(note)) for cond, note in flagged]))


def marker_fingerprint(markers: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(markers)), "+"), F.lit("")), F.lit("raw"))


def notability(has_incident: Column, n_dossiers: Column, text_length: Column) -> Column:
    return 3 * has_incident.cast("int") + F.coalesce(n_dossiers, F.lit(0)) + (F.coalesce(text_length, F.lit(0)) > 5000).cast("int")


def share_url_ok(url: Column, hosts: list[str]) -> Column:
    """A path of this site, or an https link to an allowed host; never ``//``, other schemes or over 2,048 characters."""
    path = url.rlike(r"^/(?!/)")
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#@]+)(?::\d+)?(?:[/?#]|$)", 1))
    return F.coalesce((F.length(url) <= 2048) & ~url.rlike(r"[\s\\]") & (path | host.isin(hosts)), F.lit(False))
