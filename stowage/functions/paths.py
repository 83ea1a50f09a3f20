"""Path functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The extension in lower case without its dot; '' where there is none. A leading dot starts no extension."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^./]*)$", 1))


def under(path: Column, folder: Column) -> Column:
    """Whether path lies below folder, by whole components."""
    return F.startswith(path, F.concat(folder, F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """path relative to root, or its file name where it isn't below root."""
    return F.when(under(path, root), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(filename(path))


def folder_category(rel_path: Column) -> Column:
    """The first component of a relative path; null for a file directly below the root."""
    parts = F.split(rel_path, "/")
    return F.when(F.size(parts) > 1, parts[0])


def swap_prefix(path: Column, before: Column, after: Column) -> Column:
    """path with one prefix exchanged; null where it doesn't start with it."""
    return F.when(F.startswith(path, before), F.concat(after, F.substring(path, F.length(before) + 1, F.length(path))))


def glob_list(text: Column) -> Column:
    """One pattern a line: trimmed, without blanks, each once in the order of first sight."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def glob_regex(glob: Column) -> Column:
    """A shell pattern as an anchored regular expression.

    * and ? cross slashes; [..] and [!..] are classes, in which a ] that comes first stands for itself and a range that
    runs backwards is empty;
    a bracket that isn't closed stands for itself.
    """
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)\[!?+\]?+[^\]]*\]|."), F.lit(0))
    quoted = lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}])", r"\\$1")

    def member(x: Column) -> Column:
        lo, hi = F.substring(x, 1, 1), F.substring(x, 3, 1)
        span = F.when(F.ascii(lo) <= F.ascii(hi), F.concat(quoted(lo), F.lit("-"), quoted(hi))).otherwise("")
        return F.when(F.length(x) == 3, span).otherwise(quoted(x))

    def one_of(token: Column) -> Column:
        negated = F.startswith(token, F.lit("[!")) & (F.length(token) > 3)
        body = F.substring(token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2))
        inside = F.array_join(F.transform(F.regexp_extract_all(body, F.lit("(?s).-.|."), F.lit(0)), member), "")
        full = F.concat(F.when(negated, "[^").otherwise("["), inside, F.lit("]"))
        return F.when(inside != "", full).when(negated, ".").otherwise("(?!)")

    part = lambda x: F.when(x == "*", ".*").when(x == "?", ".").when(F.length(x) > 1, one_of(x)).otherwise(quoted(x))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, part), ""), F.lit(r"\z"))


def glob_regexes(text: Column) -> Column:
    """The regular expressions of a list of patterns, one a line; take them once for each list, before it is joined to
    paths.
    """
    return F.transform(glob_list(text), glob_regex)


def matches_any(path: Column, regexes: Column) -> Column:
    """Whether a path matches one of the expressions of glob_regexes."""
    return F.coalesce(F.exists(regexes, lambda g: F.rlike(path, g)), F.lit(False))


def scheme(path: Column) -> Column:
    """gs or s3 for a path with such a scheme (gcs is gs), '' for others."""
    found = F.lower(F.regexp_extract(F.trim(path), "^(?i)(gs|gcs|s3)://", 1))
    return F.when(found == "gcs", "gs").otherwise(found)


def _rest(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), "^(?i)(?:gs|gcs|s3)://", "")


def bucket(path: Column) -> Column:
    """The bucket of gs://bucket/folder, gcs://.., s3://.. or of the same without a scheme."""
    return F.regexp_extract(_rest(path), "^([^/]*)", 1)


def bucket_prefix(path: Column) -> Column:
    """The normalised folder of a bucket path; null where path_error refuses it for its folder."""
    return normalize_prefix(F.regexp_replace(_rest(path), "^[^/]*/?", ""))


def _segments(*parts: Column) -> Column:
    """Components of folder parts: blanks round them, empty ones and '.' go, backslashes are slashes."""
    joined = F.concat_ws("/", *[F.replace(p, F.lit("\\"), F.lit("/")) for p in parts])
    return F.filter(F.transform(F.split(joined, "/"), lambda x: F.trim(x)), lambda x: ~x.isin("", "."))


def normalize_prefix(*parts: Column) -> Column:
    """Folder parts joined: no slash first, one slash last; '' for none; null if a component is '..', which could climb
    out.
    """
    found = _segments(*parts)
    whole = F.when(F.size(found) > 0, F.concat(F.array_join(found, "/"), F.lit("/"))).otherwise("")
    return F.when(~F.array_contains(found, ".."), whole)


def format_bucket_path(kind: str, name: Column, prefix: Column) -> Column:
    """kind://bucket or kind://bucket/folder, without a slash last."""
    return F.concat(F.lit(f"{kind}://"), name, F.rtrim(F.concat(F.lit("/"), normalize_prefix(prefix)), F.lit("/")))


def path_error(path: Column, kind: str | None = None) -> Column:
    """Why a bucket path is refused, or null: empty, scheme (not that of kind, gs or s3), bucket, parent.

    Bucket names have 3 to 63 of a-z 0-9 . - (and _ but in s3), and begin and end with a letter or digit.
    """
    wide, narrow = "^[a-z0-9][a-z0-9._-]{1,61}[a-z0-9]$", "^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$"
    named = F.when(
        scheme(path) == "s3", F.rlike(bucket(path), F.lit(narrow))
    ).otherwise(F.rlike(bucket(path), F.lit(wide)))
    other = scheme(path) != kind if kind else F.lit(False)
    empty = path.isNull() | (F.trim(path) == "")
    return F.when(empty, "empty").when(other, "scheme").when(~named, "bucket").when(
        bucket_prefix(path).isNull(), "parent"
    )


def archive_parts(key: Column) -> tuple[Column, Column]:
    """(folder, id) of an archive's key in either layout, nulls for other keys."""
    return _either(key, "archives", "tar")


def index_parts(key: Column) -> tuple[Column, Column]:
    return _either(key, "index", "json")


def _either(key: Column, folder: str, ending: str) -> tuple[Column, Column]:
    old, new = rf"^((?:.*/)?){folder}/({UUID})\.{ending}$", rf"^((?:.*/)?)({UUID})\.{ending}$"
    is_old, is_new = F.rlike(key, F.lit(old)), F.rlike(key, F.lit(new))
    part = lambda k: F.when(is_old, F.regexp_extract(key, old, k)).when(is_new, F.regexp_extract(key, new, k))
    return part(1), part(2)


def index_key(archive_path: Column) -> Column:
    """Where an archive's index document lies."""
    folder, ident = archive_parts(archive_path)
    old = F.rlike(archive_path, F.lit(rf"archives/{UUID}\.tar$"))
    return F.concat(folder, F.when(old, "index/").otherwise(""), ident, F.lit(".json"))
