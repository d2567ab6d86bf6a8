"""Exact document fingerprints, in DataFrame and SQL functions only.

The canonical form of a text is its compatibility composition with full case
folding, composed once more, with every run of white space as one space and
none at the ends.  Its digest is 128 bits wide: two xxhash values from
different seeds, as 32 hexadecimal digits.

Texts of one digest are compared byte by byte, as the grouping of (digest,
canonical form) does; edited texts, which have no copies to speak of, are told
apart from each other and from texts of their digest by the SHA-256 of their form.
Where either shows two forms of one digest, every fingerprint of that digest is
lengthened by the SHA-256 of its form, so that equal fingerprints mean equal forms.

A null is an empty text.  A very long text is one value of a row.  Repeated rows stay, with equal fingerprints.  A null
doc_id comes before all others; rows of one doc_id are ordered by their text.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.sources.scratch import scratch

#: Rows of a range of doc_id, as long as the table has no more than RANGES times as many.
RANGE_ROWS, RANGES = 2048, 16_384
_LEAST = -(1 << 63)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    text = F.coalesce(text, F.lit(""))
    normal = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal, F.lit(True))
    wide = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    ascii = F.length(text) == F.octet_length(text)
    return F.trim(F.regexp_replace(F.when(ascii, F.lower(text)).otherwise(wide), r"(?U)\s+", " "))


def digest(form: Column, bits: int = 64) -> tuple[Column, Column]:
    """Two 64-bit halves; fewer bits are for tests of what happens when digests collide."""
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return F.xxhash64(form).bitwiseAND(mask), F.xxhash64(F.lit("second half"), form).bitwiseAND(mask)


def _hex(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that isn't above the key, by two short scans; bounds ascend and the first is the least key."""
    wide = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= key)) - 1
    inner = F.element_at(F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows]), row + 1)
    return row * wide + F.size(F.filter(inner, lambda b: b <= key)) - 1


def with_next(df: DataFrame) -> tuple[DataFrame, Window]:
    """(key, doc_id, text, next, extra) of (doc_id, text), next being the next document's text, and the window that orders it.

    Documents go to ranges of doc_id whose bounds are keys of the table.  The
    first documents of a range go to the range before as well, marked `extra`;
    the very first ones go to the last range.
    """
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"))
    rows, least = docs.agg(F.count("*"), F.min("key")).first()
    n = min(RANGES, -(-rows // RANGE_ROWS))
    bounds = sorted({least if least is not None else _LEAST, *(int(b) for b in (df.select(F.col("doc_id").cast("long").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []))})
    at, count = _range_of(F.col("key"), bounds), len(bounds)
    placed = docs.withColumn("range", at)
    before = F.pmod(F.col("range") - 1, F.lit(count))
    first = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("range") + 1) == F.col("key")
    one = F.array(F.struct(F.col("range"), F.lit(0).alias("extra")))
    two = F.array(F.struct(F.col("range"), F.lit(0).alias("extra")), F.struct(before.alias("range"), F.lit(1).alias("extra")))
    placed = placed.select("key", "doc_id", "text", F.explode(F.when(first, two).otherwise(one)).alias("at")).select("key", "doc_id", "text", "at.range", "at.extra")
    order = Window.partitionBy("range").orderBy("extra", "key", "text")
    return placed.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit(""))), order


def fingerprints(spark: SparkSession, df: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text).

    The edited text has its last floor(n_chars / 4) characters replaced by the
    first as many, or all, of the next document.  Likeness is 1 for equal
    canonical forms and 0 for others.
    """
    files = scratch(spark)
    placed, order = with_next(df)
    n = F.length("text")
    kept = n - F.floor(n / 4)
    edited = F.concat(F.substring("text", F.lit(1), kept.cast("int")), F.substring("next", F.lit(1), (n - kept).cast("int")))
    rows = placed.select("key", "range", "extra", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("*", canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"))
    rows = rows.select("extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "form", "edited_form", F.lead("form").over(order).alias("next_form")).where("extra = 0")
    (a, b), (c, d) = digest(F.col("form"), bits), digest(F.col("edited_form"), bits)
    full = rows.select(
        "doc_id", "n_chars", "edited_sha256", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"),
        (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"), (F.col("form") == F.col("next_form")).cast("double").alias("near_next"),
        "form", "edited_form",
    )
    full = full.withColumns({"x": F.unhex(F.sha2("form", 256)), "y": F.unhex(F.sha2("edited_form", 256))})
    light = files.keep(full.drop("form", "edited_form"), "fingerprints")
    own = df.select(canonical(F.coalesce("text", F.lit(""))).alias("form"))
    a, b = digest(F.col("form"), bits)
    groups = own.select(a.alias("a"), b.alias("b"), "form").groupBy("a", "b", "form").agg(F.count("*").alias("n"))
    every = light.select("a", "b", "x").unionByName(light.select(F.col("c").alias("a"), F.col("d").alias("b"), F.col("y").alias("x"))).groupBy("a", "b", "x").agg(F.count("*").alias("n"))
    clash = [g.groupBy("a", "b").agg(F.count("*").alias("forms")).where("forms > 1").select("a", "b") for g in (groups, every)]
    bad, (found,) = files.counted(clash[0].unionByName(clash[1]).distinct(), "clashes", F.count(F.lit(1)))
    none = F.lit(None).cast("string")
    if not found:
        files.drop(bad)
        shown = light.withColumns({"x": none, "y": none})
    else:
        shown = light.join(bad.withColumn("bad", F.lit(True)), ["a", "b"], "left")
        shown = shown.join(bad.select(F.col("a").alias("c"), F.col("b").alias("d"), F.lit(True).alias("worse")), ["c", "d"], "left")
        shown = shown.withColumns({"x": F.when(F.col("bad"), F.lower(F.hex("x"))), "y": F.when(F.col("worse"), F.lower(F.hex("y")))})
    tail = F.coalesce(F.concat(F.lit("-"), "y"), F.lit(""))
    return shown.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat(_hex("a", "b"), F.coalesce(F.concat(F.lit("-"), "x"), F.lit(""))).alias("fingerprint"),
        F.concat(_hex("c", "d"), tail).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
