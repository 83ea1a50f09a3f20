"""Scalar functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20


def format_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1)))
    return out.otherwise(F.format_string("%.1f PB", F.bround(n / F.lit(float(1024**5)), 1)))


def _one_decimal(x: Column) -> Column:
    """A double of 1 and more with one decimal, by its exact value: 4.35, which is stored as a little less, is 4.3. bround goes
    by the shortest text of a double, and takes that for a tie.
    """
    whole = F.floor(x)
    tenths = ((x - whole) * F.lit(float(1 << 52))).cast("long") * 10  # exact: the last bit of what is 1 and more is 2^-52
    digit, rest, half = F.shiftright(tenths, 52), tenths.bitwiseAND((1 << 52) - 1), 1 << 51
    digit += ((rest > half) | ((rest == half) & (digit % 2 == 1))).cast("int")
    return F.concat((whole + F.floor(digit / 10)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    below = F.concat(F.when((s < 0) & (s >= -0.5), "-").otherwise(""), F.bround(s).cast("long").cast("string"), F.lit(" sec"))
    return F.when(s.isNull(), None).when(F.isnan(s), "nan days").when(s == float("inf"), "inf days").when(s == float("-inf"), "-inf sec").when(
        s < 60, below
    ).when(s < 3600, F.concat(F.bround(s / 60).cast("long").cast("string"), F.lit(" min"))).when(
        s < 48 * 3600, F.concat(_one_decimal(s / 3600), F.lit(" hr"))
    ).otherwise(F.concat(_one_decimal(s / 86400), F.lit(" days")))


def rfc3339(ns: Column) -> Column:
    """Nanoseconds since the epoch as UTC text in whole seconds, rounded down."""
    return F.date_format(
        F.timestamp_seconds(F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )


def mtime_to_ns(text: Column) -> Column:
    """The inverse of rfc3339; 0 for null and for text that is no such time."""
    return F.coalesce(
        F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))) * F.lit(1_000_000_000), F.lit(0)
    )


def lenient_timestamp(text: Column) -> Column:
    return text.try_cast("timestamp")


def payload_ceiling(max_size: int) -> int:
    """The most that one archive may hold: the limit less 1 MiB for the tar's own blocks."""
    if max_size <= MIB:
        raise ValueError(f"a limit of {max_size} bytes leaves no room beside 1 MiB of overhead")
    return max_size - MIB


def classify(size: Column, min_size: int, max_size: int) -> Column:
    return F.when(size < min_size, "clump").when(size <= payload_ceiling(max_size), "single").otherwise("part")


def split_sizes(size: Column, ceiling: int) -> Column:
    """Sizes of the parts of a file: as few as fit, all of one size but the last."""
    k = F.greatest(_ceil_div(size, F.lit(ceiling)), F.lit(1).cast("long"))
    q = _ceil_div(size, k)
    return F.transform(F.sequence(F.lit(1).cast("long"), k), lambda i: F.when(i < k, q).otherwise(size - q * (k - 1)))


def split_aligned(size: Column, ceiling: int, unit: int, head: int) -> Column:
    """Sizes of the parts of an encrypted file: cuts lie between chunks, and the first part also has the header."""
    per_part = (ceiling - head) // unit
    if per_part < 1:
        raise ValueError("a part can't hold one chunk")
    body = per_part * unit
    k = F.greatest(_ceil_div(size - head, F.lit(body)), F.lit(1).cast("long"))
    return F.transform(
        F.sequence(F.lit(1).cast("long"), k),
        lambda i: F.least(i * body + head, size) - F.when(i > 1, (i - 1) * body + head).otherwise(0),
    )


def part_length(sizes: Column, part: Column) -> Column:
    """The bytes of one part (from 1) of a file that was split into sizes; of a file that wasn't, the whole."""
    return F.coalesce(F.try_element_at(sizes, part), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x))


def member_cost(size: Column) -> Column:
    """An upper estimate of a tar member: header, content in blocks of 512, and room for a long name."""
    return F.lit(512) + _ceil_div(size, F.lit(512)) * 512 + F.lit(1024)


def sealed_size(plain: Column, chunk: int, header: int = 20, tag: int = 16) -> Column:
    return plain + header + _ceil_div(plain, F.lit(chunk)) * tag


def _ceil_div(a: Column, b: Column) -> Column:
    """Whole-number division rounded up."""
    top = a + b - 1
    return F.floor((top - F.pmod(top, b)).cast("decimal(38,0)") / b.cast("decimal(20,0)")).cast("long")


def weekdays(csv: Column) -> Column:
    """'2,0, 2' -> [0, 2]; Monday is 0."""
    parts = F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.cast("int"))))


def next_occurrence(after: Column, frequency: Column, time_of_day: Column, days: Column) -> Column:
    """The first time after `after` at time_of_day ('HH:MM') on a day that counts: any for 'daily', else those of
    `days`, else that of `after`.
    """
    wanted = weekdays(days)
    allowed = F.when(
        frequency == "daily", F.sequence(F.lit(0), F.lit(6))
    ).when(F.size(wanted) > 0, wanted).otherwise(F.array(F.weekday(after)))
    at = F.split(time_of_day, ":")
    day = F.date_trunc("day", after)
    each = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda d: F.timestamp_add("MINUTE", at[0].cast("int") * 60 + at[1].cast("int") + d * 1440, day),
    )
    return F.array_min(F.filter(each, lambda c: (c > after) & F.array_contains(allowed, F.weekday(c))))


def wanted_ranges(
    total: Column, encrypted: Column, sample: int = MIB, budget: int = 4 * MIB, extra: int = 36
) -> Column:
    """Which (start, length) of a file's stored bytes a shallow verification reads."""
    piece = lambda start, length: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))
    whole = F.array(piece(F.lit(0), total))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    ends = F.array(piece(F.lit(0), F.lit(sample)), piece(total - sample, F.lit(sample)))
    return F.when(
        encrypted, F.when(total > budget + extra, none).otherwise(whole)
    ).when(total <= 2 * sample, whole).otherwise(ends)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC as two nested hashes with literal pads; equal to the standard's definition for keys of up to 64 bytes."""
    pad = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad), bytes(b ^ 0x5C for b in pad)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def key_check(key: bytes, label: str = "key-check") -> str:
    """A short value that tells on the driver whether a candidate key is the one an archive was written with."""
    import hashlib
    import hmac

    return hmac.new(key, label.encode(), hashlib.sha256).hexdigest()[:16]


def hmac_pads(key: Column) -> tuple[Column, Column]:
    """The inner and outer pad of a key column of up to 64 bytes; take them once for each key, before a join."""
    padded = F.rpad(F.hex(key), 128, "0")
    flip = lambda pad: F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(pad))), 2, "0")), ""))
    return flip(0x36), flip(0x5C)


def hmac_with_pads(inner: Column, outer: Column, message: Column) -> Column:
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hmac_sha256_column(key: Column, message: Column) -> Column:
    """HMAC with a key column."""
    return hmac_with_pads(*hmac_pads(key), message)
