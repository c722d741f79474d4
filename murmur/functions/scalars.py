"""Scalar and array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions import vocabulary as V


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity(score) -> Column:
    """Severity of an unrounded score; each bound belongs to the severity above it."""
    ladder = None
    for least, name in V.SEVERITIES:
        ladder = F.when(col(score) >= least, name) if ladder is None else ladder.when(col(score) >= least, name)
    return ladder.otherwise("LOW")


def rounded(x, digits: int) -> Column:
    """Round half up on the binary value, which two engines agree on where round() does not."""
    return F.floor(col(x) * float(10**digits) + 0.5) / float(10**digits)


def ratio(a, b) -> Column:
    """a / b as a double, null for a denominator of 0: not measured is not 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def capitalise(s) -> Column:
    """First letter upper case, the rest lower."""
    return F.concat(F.upper(F.substring(col(s), 1, 1)), F.lower(F.substring(col(s), 2, 1 << 30)))


def natural_join(parts, last: str) -> Column:
    """a; a last b; a, b last c.  Null for an empty array."""
    p = col(parts)
    head = F.array_join(F.slice(p, 1, F.size(p) - 1), ", ")
    return F.when(F.size(p) == 1, p[0]).when(F.size(p) > 1, F.concat(head, F.lit(f" {last} "), F.element_at(p, -1)))


def named(key, names: dict[str, str]) -> Column:
    """The name of a key, or the key itself if it has none."""
    pairs = reduce(lambda a, kv: a + [F.lit(kv[0]), F.lit(kv[1])], names.items(), [])
    return F.coalesce(F.create_map(*pairs)[col(key)], col(key))


def event_id(moment, number) -> Column:
    """EVT_yyyymmdd_nnnnnn; a number outside 1..999999 is an error."""
    n = col(number)
    made = F.format_string("EVT_%s_%06d", F.date_format(col(moment), "yyyyMMdd"), n)
    return F.when(n.between(1, 999999), made).otherwise(F.raise_error(F.concat(F.lit("sequence out of range: "), n.cast("string"))))


def event_number(eid, day=None) -> Column:
    """The number in an event id; another format, or another day than the one given (yyyyMMdd), is an error."""
    good = col(eid).rlike(r"^EVT_[0-9]{8}_[0-9]{6}$")
    if day is not None:
        good = good & (F.substring(col(eid), 5, 8) == col(day))
    return F.when(col(eid).isNull(), F.lit(None).cast("int")).when(good, F.substring(col(eid), 14, 6).cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad event id: "), col(eid))))


def local_time(ts) -> Column:
    return F.from_utc_timestamp(col(ts).cast("timestamp"), "+07:00")


def part_of_day(hour) -> Column:
    """Five bands of local hours; the night wraps."""
    out = None
    for lo, hi, name in V.PARTS_OF_DAY_VI:
        out = F.when(col(hour).between(lo, hi), name) if out is None else out.when(col(hour).between(lo, hi), name)
    return out.otherwise(V.NIGHT_VI)


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, in UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def decibel(x) -> Column:
    return F.log10(F.greatest(col(x), F.lit(1e-10))) * 20


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; null for vectors of zero length or of different sizes."""
    return F.when(F.size(col(a)) == F.size(col(b)), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def l2_normalised(a) -> Column:
    """The vector at length 1; all zeros stay as they are."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(col(a), lambda x: x.cast("double") / norm)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def checked_vector(a, size: int) -> Column:
    return F.when(F.size(col(a)) == size, col(a)).otherwise(F.raise_error(F.lit(f"a vector must have {size} entries")))


def tiled(a, least: int) -> Column:
    """The array repeated up to the least length and cut there; longer ones and empty ones stay."""
    n = F.size(col(a))
    times = F.ceil(F.lit(float(least)) / F.greatest(n, F.lit(1))).cast("int")
    return F.when((n >= least) | (n == 0), col(a)).otherwise(F.slice(F.flatten(F.array_repeat(col(a), times)), 1, least))


def as_int16(x) -> Column:
    """A sample in -1..1 as a 16-bit number, clipped."""
    return F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.bround(col(x) * 32767.0))).cast("short")


def real_frames(frames, duration, rate: int, samples) -> Column:
    """Frames that hold sound rather than padding, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(col(frames) * F.least(F.lit(1.0), col(duration) * rate / col(samples)))).cast("int")


def bar(onset, offset, window) -> tuple[Column, Column]:
    """Left edge and width of a timeline bar in percent: left in 0..100, width at least 2 and within the bar; an empty window counts as 1 s."""
    w = F.when(col(window) > 0, col(window)).otherwise(F.lit(1.0))
    left = F.least(F.lit(100.0), F.greatest(F.lit(0.0), col(onset) / w * 100))
    return left, F.least(F.lit(100.0) - left, F.greatest(F.lit(2.0), (col(offset) - col(onset)) / w * 100))


def split_list(s) -> Column:
    """Entries between commas or semicolons, trimmed; empty ones go; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(col(s), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def token_jaccard(a, b) -> Column:
    """Jaccard similarity of the white-space tokens of two lower-cased texts; null if neither has any."""
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(col(s)), r"\s+"), lambda x: x != ""))
    return ratio(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b))))


def comma_decimal(x, digits: int) -> Column:
    """A number with a decimal comma; null is written as text, never as 0."""
    return F.coalesce(F.translate(F.format_number(col(x), digits), ",.", ".,"), F.lit("chưa đo"))


def relative_path(path, root: str) -> Column:
    p = F.translate(col(path), "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, len(base) + 1, 1 << 30)).otherwise(p)


def rt60_room(rt) -> Column:
    """Room size of a reverberation time, null below the least."""
    out = None
    for least, name in reversed(V.RT60_ROOMS):
        out = F.when(col(rt) >= least, name) if out is None else out.when(col(rt) >= least, name)
    return out


def shown_time(s) -> Column:
    """Local date and time of an ISO string for display; a string that is no time stays as it is."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(col(s)), "+07:00"), "dd/MM/yyyy HH:mm:ss"), col(s))
