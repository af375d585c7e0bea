"""Scalar operators as Column expressions: everything here stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
#: Fixed values of the model: levels of priority, lowest first.
PRIORITIES = ("background", "low", "normal", "high", "critical")
#: No compression below so many bytes, or on links of at least so many bytes a second.
COMPRESS_FROM = 4096
FAST_LINK = 100 * MIB
#: Link speed and delay assumed where none was measured.
DEFAULT_BANDWIDTH = 12_500_000.0
DEFAULT_LATENCY_MS = 50.0


def content_id(b: Column) -> Column:
    """Lower-case hex digest: equal bytes, equal id."""
    return F.sha2(b, 256)


def id_error(s: Column) -> Column:
    """NULL for a well-formed id, else what is wrong: its length, or the first bad byte."""
    bad = F.floor((F.regexp_instr(s, F.lit("[^0-9a-fA-F]")) - 1) / 2)
    return F.when(F.octet_length(s) != 64, F.concat(F.lit("length "), F.octet_length(s))).when(~s.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("digit in byte "), bad))


def codec(size: Column, bandwidth: Column) -> Column:
    """none for small data or a link known to be fast; an unmeasured link counts as slow."""
    return F.when(size < COMPRESS_FROM, "none").when(bandwidth >= FAST_LINK, "none").otherwise("lz4")


def clamp(x: Column) -> Column:
    """Into 0..1, NaN to 0."""
    return F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def priority_level(s: Column) -> Column:
    """0..4; an empty text is normal, an unknown one NULL."""
    p = F.lower(F.trim(s))
    out = F.when(p == "", 2)
    for i, name in enumerate(PRIORITIES):
        out = out.when(p == name, i)
    return out


def priority_name(p: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate(PRIORITIES):
        out = F.when(p == i, name).otherwise(out)
    return out


def effective_priority(p: Column, waited: Column, aging: Column | int) -> Column:
    """Declared level plus one for each ageing period waited, critical at most; no ageing at 0."""
    aging = F.lit(aging) if isinstance(aging, int) else aging
    return F.when(aging == 0, p).otherwise(F.least(F.lit(4), p + F.floor(waited / F.greatest(aging, F.lit(1))))).cast("int")


def parse_constraint(s: Column) -> Column:
    """op, key, value of ``k=v``, ``k!=v`` or ``k``; NULL for an empty key. The first operator splits."""
    t = F.trim(s)
    ne, eq = F.instr(t, "!="), F.instr(t, "=")
    at = lambda pos, width: (F.trim(F.substring(t, F.lit(1), pos - 1)), F.trim(F.substr(t, pos + width)))
    kn, vn = at(ne, 2)
    ke, ve = at(eq, 1)
    made = F.when(ne > 0, F.struct(F.lit("ne").alias("op"), kn.alias("key"), vn.alias("value"))).when(eq > 0, F.struct(F.lit("eq").alias("op"), ke.alias("key"), ve.alias("value"))).otherwise(F.struct(F.lit("exists").alias("op"), t.alias("key"), F.lit(None).cast("string").alias("value")))
    return F.when(made["key"] != "", made)


def render_constraint(c: Column) -> Column:
    return F.when(c["op"] == "eq", F.concat(c["key"], F.lit("="), c["value"])).when(c["op"] == "ne", F.concat(c["key"], F.lit("!="), c["value"])).otherwise(c["key"])


def satisfies(labels: Column, c: Column) -> Column:
    """Equality is exact; inequality holds where the key is absent."""
    held = F.try_element_at(labels, c["key"])
    return F.when(c["op"] == "eq", held.eqNullSafe(c["value"])).when(c["op"] == "ne", ~held.eqNullSafe(c["value"])).otherwise(F.map_contains_key(labels, c["key"]))


def satisfies_all(labels: Column, constraints: Column) -> Column:
    """All hold; an empty list holds."""
    return F.coalesce(F.forall(constraints, lambda c: satisfies(labels, c)), F.lit(True))


def parse_labels(items: Column) -> Column:
    """Array of ``k=v`` to a map: trimmed, what is no pair or has no key is dropped, the last of a key wins."""
    pairs = F.filter(F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.when(F.instr(x, "=") > 0, F.trim(F.substr(x, F.instr(x, "=") + 1))).alias("v"))), lambda p: p["v"].isNotNull() & (p["k"] != ""))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)))


def preview(b: Column, n: int = 48) -> Column:
    """The first n bytes, what is not printable ASCII as a dot, an ellipsis if there is more."""
    return F.concat(F.regexp_replace(F.decode(F.substring(b, 1, n), "ISO-8859-1"), r"[^\x20-\x7e]", "."), F.when(F.octet_length(b) > n, "…").otherwise(""))


def short_id(s: Column) -> Column:
    return F.substring_index(s, "-", 1)


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", n / float(1024**i)))
    return out.otherwise(F.format_string("%.1f TiB", n / float(1024**4)))


def is_loopback(address: Column) -> Column:
    """Of host:port, [v6]:port or a bare v6 address."""
    bare = address.rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:]*$")
    host = F.when(address.startswith("["), F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).when(bare, address).otherwise(F.substring_index(address, ":", 1))
    return (F.lower(host) == "localhost") | host.rlike(r"^127(\.\d{1,3}){3}$") | (host == "::1")


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ago(seconds: Column) -> Column:
    return F.when(seconds < 1, "now").when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))


def machine_cores(kind: Column) -> Column:
    """Cores named by a machine type (``e2-standard-4``, ``Standard_D4s_v5``), else 1."""
    dash = F.regexp_extract(kind, r"-(\d+)$", 1)
    under = F.regexp_extract(kind, r"^[A-Za-z]+_[A-Z]+(\d+)", 1)
    return F.coalesce(F.nullif(dash, F.lit("")).try_cast("int"), F.nullif(under, F.lit("")).try_cast("int"), F.lit(1))


def split_list(s: Column) -> Column:
    """Items between commas or spaces, empty ones dropped."""
    return F.filter(F.split(s, "[, ]"), lambda x: x != "")


def backoff(attempt: Column, ceiling: Column, first: float = 1.0) -> Column:
    """Delay before the attempt (1, 2, ...), doubling up to the ceiling; NULL (no retry) where the ceiling is 0."""
    return F.when(ceiling > 0, F.least(F.pow(F.lit(2.0), attempt - 1) * first, ceiling.cast("double")))


def http_class(status: Column) -> Column:
    return F.when(status == 429, "throttled").when(status.isin(401, 403), "unauthorized").when(status == 404, "not_found").when(status.between(500, 599), "unavailable").when(status.between(200, 299), "ok").otherwise("request")


def error_status(message: Column) -> Column:
    """HTTP status for an error text: no place or a full queue 503, a failed task 422, else 500."""
    m = F.lower(message)
    return F.when(m.contains("no eligible") | m.contains("queue"), 503).when(m.contains("task failed"), 422).otherwise(500)


def ascii_upper(s: Column) -> Column:
    """Only a to z change."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lcg_fold(n: Column) -> Column:
    """acc = acc * 6364136223846793005 + i modulo 2**64 for i below n, in decimals: products are split at 32 bits so that none overflows."""
    two32, two64 = F.lit(1 << 32).cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    high, low = F.lit(6364136223846793005 >> 32).cast("decimal(12,0)"), F.lit(6364136223846793005 & 0xFFFFFFFF).cast("decimal(12,0)")

    def step(acc: Column, i: Column) -> Column:
        a = acc.cast("decimal(20,0)")
        top = F.pmod((a * high).cast("decimal(38,0)"), two32)
        return F.pmod((top.cast("decimal(12,0)") * F.lit(1 << 32).cast("decimal(12,0)")).cast("decimal(38,0)") + (a * low).cast("decimal(38,0)") + i.cast("decimal(38,0)"), two64).cast("decimal(38,0)")

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), F.lit(0).cast("decimal(38,0)"), step)).otherwise(F.lit(0).cast("decimal(38,0)")).cast("decimal(20,0)")
