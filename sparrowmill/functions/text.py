"""Text and hashing expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators that a plain \s misses.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
TOKEN = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def flatten(c: Column) -> Column:
    """Line feeds and tabs as spaces, so that a text is one line."""
    return F.translate(c, "\n\t", "  ")


def title_and_text(title: Column, text: Column) -> Column:
    """Both stripped, with a space between; without a title the text alone; nulls are empty."""
    a, b = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    return F.when(a != "", F.concat_ws(" ", a, b)).otherwise(b)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)


def source_seed(seed: int, source: Column) -> Column:
    """The low 32 bits of the first 8 bytes of sha256("seed:source")."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), source), 256), 9, 8), 16, 10).cast("bigint")


def batch_seed(seed: int, epoch: Column, source: Column, start: Column) -> Column:
    """The first 8 bytes of sha256("seed:epoch:source:start") as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), source, start.cast("string")), 256), 1, 16), 16, 10)


def order_key(*parts) -> Column:
    """A deterministic shuffle's key: sha256 of the parts with colons between."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def slug(bits: Column, axis: Column, dim: Column) -> Column:
    """fp32-dim-N at 32 bits, else intB-axis-N."""
    return F.when(bits >= 32, F.concat(F.lit("fp32-dim-"), dim.cast("string"))).otherwise(F.concat(F.lit("int"), bits.cast("string"), F.lit("-"), axis, F.lit("-"), dim.cast("string")))


def parse_slug(c: Column) -> list[Column]:
    """bits, axis, dim of a slug; nulls if it isn't one."""
    pattern = r"^(?:fp(32)|int(\d+))-(dim|row)-(\d+)"
    ok = c.rlike(pattern)
    bits = F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.regexp_extract(c, pattern, 2))
    return [F.when(ok, bits.cast("int")).alias("bits"), F.when(ok, F.regexp_extract(c, pattern, 3)).alias("axis"), F.when(ok, F.regexp_extract(c, pattern, 4).cast("int")).alias("dim")]
