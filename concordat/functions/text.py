"""Column expressions for names, titles, artists, paths, durations and times. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the matching rules.
VERSION_WORDS = ("remix", "edit", "mix", "version", "vip", "bootleg", "rework", "flip", "refix", "redo", "extended", "radio", "club", "dub")
SHORT_VERSIONS = ("radio", "edit", "short", "radio edit", "single", "clean", "radio mix", "radio version", "shortened", "album version")
LONG_VERSIONS = ("extended", "original", "club", "full", "original mix", "extended mix", "club mix", "original version", "full length", "original club mix")
AUDIO_EXTENSIONS = ("mp3", "flac", "aiff", "wav", "m4a", "aac", "ogg", "wma")
SEPARATORS = (" - ", " – ", " — ", " by ")
MIX_TYPES = (
    ("extended", "Extended Mix"),
    ("club mix", "Club Mix"),
    ("original mix", "Original Mix"),
    ("edit", "Radio Edit"),
    ("remix", "Remix"),
    ("vocal", "Vocal Mix"),
    ("instrumental", "Instrumental"),
)

_WORDS = "|".join(VERSION_WORDS)
_BRACKETED = rf"(?i)\s*[(\[]([^)\]]*(?:{_WORDS})[^)\]]*)\s*[)\]]"
_TRAILING = rf"(?i)\s*-\s*([^-]*(?:{_WORDS})[^-]*)\s*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def null_if_blank(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def split_artist_title(name: Column) -> Column:
    """struct(artist, title) at the first separator of the first kind found; artist is empty without one."""
    out = F.struct(F.lit("").alias("artist"), strip(name).alias("title"))
    for sep in reversed(SEPARATORS):
        at = F.locate(sep, name)
        cut = F.struct(
            strip(F.substring(name, F.lit(1), at - 1)).alias("artist"),
            strip(F.substring(name, at + len(sep), F.length(name))).alias("title"),
        )
        out = F.when(at > 0, cut).otherwise(out)
    return out


def artist_norm(artist: Column) -> Column:
    return F.replace(F.lower(artist), F.lit("&"), F.lit("and"))


def artist_words(artist: Column) -> Column:
    """Distinct words between commas, semicolons, ampersands and white space."""
    return F.array_distinct(F.filter(F.split(artist, r"[,;&\s]+"), lambda w: w != ""))


def artist_list(artists: Column) -> Column:
    """Lower-case artists between commas."""
    return F.transform(F.split(artists, ","), lambda a: strip(F.lower(a)))


def sorted_artists(artists: Column) -> Column:
    """Artists between commas, lower-case, sorted, without blank ones."""
    return F.array_join(F.array_sort(F.filter(artist_list(artists), lambda a: a != "")), ", ")


def primary_artist(artists: Column) -> Column:
    return strip(F.element_at(F.split(artists, ","), 1))


def display_name(artists: Column, title: Column) -> Column:
    return F.concat(artists, F.lit(" - "), title)


def version_split(title: Column) -> Column:
    """struct(base, version): the title without bracketed version notes, else without a trailing one."""
    bracketed, trailing = F.rlike(title, F.lit(_BRACKETED)), F.rlike(title, F.lit(_TRAILING))

    def cut(pattern: str) -> Column:
        return F.struct(
            strip(F.regexp_replace(title, pattern, "")).alias("base"),
            strip(F.lower(F.regexp_extract(title, pattern, 1))).alias("version"),
        )

    plain = F.struct(title.alias("base"), F.lit("").alias("version"))
    return F.when(bracketed, cut(_BRACKETED)).when(trailing, cut(_TRAILING)).otherwise(plain)


def version_keywords(version: Column) -> Column:
    """The version words among the words of a note."""
    return F.array_intersect(F.array_distinct(F.split(version, r"\s+")), F.array(*map(F.lit, VERSION_WORDS)))


def name_norm(name: Column) -> Column:
    """Lower case, punctuation as spaces, spaces squeezed; accents are stripped before, by ``strip_accents``."""
    return squeeze(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "))


def fingerprint_norm(c: Column) -> Column:
    """Lower case without bracketed text and punctuation."""
    c = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), "(?U)\\s*[‌\\[(].*?[‌\\])]", "")
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", ""))


def comparison_title(title: Column) -> Column:
    """Lower case without the notes that never make another recording."""
    tags = r"(?U)\s*\((?:explicit|clean|radio edit|remaster(?:ed)?)\)"
    return squeeze(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), tags, ""))


def search_term(c: Column) -> Column:
    """Without featured artists, mix notes and square brackets."""
    c = F.regexp_replace(c, r"(?i)\((?:feat\.|ft\.|featuring).*?\)|\((?:original mix|radio edit|edit)\)", "")
    return squeeze(F.regexp_replace(c, r"\[.*?\]", ""))


def file_safe(name: Column) -> Column:
    """A name for files: spaces and reserved characters go; a name with spaces keeps them and gets underscores."""
    tight = F.regexp_replace(name, r'(?U)[\s()\\/*?:"<>|]', "")
    spaced = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    return F.when(F.contains(name, F.lit(" ")), spaced).otherwise(tight)


def file_safe_spaced(name: Column) -> Column:
    """A name for files that keeps its spaces: reserved characters become underscores."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def percent(share: Column) -> Column:
    """A share in percent, to one decimal, halves to even."""
    return F.bround(100 * share, 1)


def markdown_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w ]", "")


def file_key(artist: Column, title: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat(artist, title), r'(?U)[\s()\\/*?:"<>|]', ""))


def duration_label(ms: Column) -> Column:
    """m:ss; Unknown for null and 0."""
    seconds = F.floor(ms / 1000)
    label = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("Unknown")).otherwise(label)


def duration_seconds(label: Column) -> Column:
    """Seconds of mm:ss or hh:mm:ss; 0 for anything else."""
    parts = F.transform(F.split(label, ":"), lambda p: F.trim(p).try_cast("bigint"))
    two = F.element_at(parts, 1) * 60 + F.element_at(parts, 2)
    three = F.element_at(parts, 1) * 3600 + F.element_at(parts, 2) * 60 + F.try_element_at(parts, F.lit(3))
    found = F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three)
    return F.coalesce(found, F.lit(0))


def mix_type(title: Column) -> Column:
    low, out = F.lower(title), F.lit("Unknown")
    for word, label in reversed(MIX_TYPES):
        out = F.when(F.contains(low, F.lit(word)), F.lit(label)).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(forward(path), "/"), -1)


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def path_key(path: Column) -> Column:
    """Paths that differ in slashes and case only have the same key."""
    return F.lower(forward(path))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(forward(path), "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """a, a/b and a/b/c of a/b/c; none of an empty path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def location_uri(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("file://")), path).otherwise(F.concat(F.lit("file://localhost/"), F.regexp_replace(forward(path), "^/+", "")))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", F.lit("Unknown File")).otherwise(F.concat(F.upper(ext), F.lit(" File")))


def uri_kind(uri: Column) -> Column:
    """The second part of a:b:c if it is local or track, else other."""
    kind = F.try_element_at(F.split(uri, ":"), F.lit(2))
    return F.when(kind.isin("local", "track") & (F.size(F.split(uri, ":")) >= 3), kind).otherwise("other")


def uri_id(uri: Column) -> Column:
    """The third part of a:b:c, else the whole."""
    parts = F.split(uri, ":")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 3)).otherwise(uri)


def surrogate_id(artist: Column, title: Column) -> Column:
    """A stable id for rows without one."""
    plain = F.regexp_replace(F.lower(F.concat_ws("_", artist, title)), r"(?U)[^\w]", "")
    return F.concat(F.lit("local_"), F.left(F.md5(plain), F.lit(16)))


def short_hash(c: Column) -> Column:
    return F.left(F.md5(c), F.lit(8))


def content_hash(content: Column, size: Column, name: Column, modified: Column) -> Column:
    """md5 of the first 8 KB with size, name and time of change."""
    rest = F.concat_ws("|", size.cast("string"), name, modified.cast("string"))
    return F.md5(F.concat(F.substring(content, 1, 8192), F.encode(rest, "UTF-8")))


def parse_time(c: Column, fallback: Column) -> Column:
    """A timestamp of ISO, of RFC 822 or of plain date and time; else ``fallback``."""
    bare = F.regexp_replace(c, r"^[A-Za-z]{3}, ", "")
    tries = [F.try_to_timestamp(c), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))]
    return F.coalesce(*tries, fallback)


def duration_boost(file_ms: Column, track_ms: Column) -> Column:
    """1.25 to 1 by the difference of two durations; 1 if either is missing."""
    gap = F.abs(file_ms - track_ms) / 1000
    return F.when(gap <= 1, 1.25).when(gap <= 3, 1.2).when(gap <= 10, 1.15).when(gap <= 30, 1.1).otherwise(1.0)


def version_score(name: Column, ms: Column) -> Column:
    """Seconds, with 120 more for each word of long versions and 180 less for each of short ones."""
    low = F.lower(name)

    def hits(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))

    return F.coalesce(ms, F.lit(0)) / 1000 + 120 * hits(LONG_VERSIONS) - 180 * hits(SHORT_VERSIONS)


def stars(rating: Column) -> Column:
    """0 to 5 stars as 0 to 255."""
    return F.least(F.floor(rating) * 51, F.lit(255))


def changes(*fields: tuple[str, Column, Column]) -> Column:
    """``Field: 'old' → 'new'`` of each field that differs, nulls being values."""
    said = [F.when(~old.eqNullSafe(new), F.concat(F.lit(f"{name}: '"), F.coalesce(old.cast("string"), F.lit("")), F.lit("' → '"), F.coalesce(new.cast("string"), F.lit("")), F.lit("'"))) for name, old, new in fields]
    return F.array_compact(F.array(*said))


def album_label(album: Column) -> Column:
    return F.coalesce(null_if_blank(album), F.lit("Unknown Album"))
