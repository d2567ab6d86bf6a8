"""Which texts hold, or begin with, which of many patterns: one pass over the texts, no comparison of all pairs."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of patterns that one automaton has.
CHARACTERS = 4 << 20


class _Matcher:
    """An automaton of distinct patterns, built once in a worker."""

    _built: dict[int, _Matcher] = {}

    def __init__(self, patterns: list[str]):
        self.patterns, self.empty = patterns, "" in patterns
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            if p:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, patterns: tuple[str, ...]) -> _Matcher:
        key = hash(patterns)
        found = cls._built.get(key)
        if found is None or tuple(found.patterns) != patterns:
            cls._built.clear()
            found = cls._built[key] = cls(list(patterns))
        return found

    def held(self, text: str) -> list[str]:
        found = {i for _, i in self.automaton.iter(text)} if len(self.automaton) else set()
        return [self.patterns[i] for i in sorted(found)] + ([""] if self.empty else [])


def _matches(batch: pa.RecordBatch, texts: int, patterns_of) -> tuple[list[int], list[str]]:
    rows, held = [], []
    for i, text in enumerate(batch.column(texts).to_pylist()):
        if text is not None:
            found = patterns_of(i).held(text)
            rows += [i] * len(found)
            held += found
    return rows, held


def holding(texts: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rows of texts, once for each distinct pattern that the column holds, with the pattern.

    An automaton of all patterns reads each text once, in time that doesn't depend on
    their number.  Patterns of at most CHARACTERS characters in all go to the tasks as
    they are; more are cut into blocks by a hash, and each block's automaton reads the
    texts.  An empty pattern is in every text; a null text holds nothing, a null pattern
    is nowhere.
    """
    own = patterns.select(F.col(pattern).alias("p")).where("p IS NOT NULL").distinct()
    (size, n) = own.agg(F.coalesce(F.sum(F.length("p") + 1), F.lit(0)), F.count(F.lit(1))).first()
    at, schema = texts.columns.index(column), T.StructType([*texts.schema.fields, T.StructField(pattern, T.StringType())])
    if size <= CHARACTERS:
        listed = tuple(sorted(r["p"] for r in own.collect()))

        def run(batches):
            matcher = _Matcher.of(listed)
            for batch in batches:
                rows, held = _matches(batch, at, lambda i: matcher)
                out = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(held, pa.string())], names=schema.names)

        return texts.mapInArrow(run, schema)
    blocks = -(-size // CHARACTERS)
    packed = own.groupBy(F.pmod(F.xxhash64("p"), F.lit(blocks)).alias("b")).agg(F.array_sort(F.collect_list("p")).alias("ps")).select("ps")

    def by_block(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            rows, held = _matches(batch, at, lambda i: _Matcher.of(tuple(lists[i].as_py())))
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(held, pa.string())], names=schema.names)

    return packed.crossJoin(texts).select(*texts.columns, "ps").mapInArrow(by_block, schema)  # blocks of a stated set of patterns


def beginning(texts: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rows of texts, once for each row of patterns that the column begins with, with the pattern's columns.

    A join by equal beginnings: a pattern is looked up by as many of its characters as
    the largest power of two that it has, then compared whole.  Nulls meet nothing; an
    empty pattern meets every text.
    """
    size = F.length(pattern)
    width = F.when(size == 0, 0).otherwise(F.expr(f"CAST(shiftleft(1, CAST(floor(log2(greatest(1, length({pattern})))) AS INT)) AS INT)"))
    keyed = patterns.where(F.col(pattern).isNotNull()).withColumn("_width", width).withColumn("_key", F.expr(f"left({pattern}, _width)"))
    widths = [r[0] for r in keyed.select("_width").distinct().collect()]  # powers of two: a few tens at most
    if not widths:
        return texts.join(keyed.drop("_width", "_key"), F.lit(False))
    cut = texts.where(F.col(column).isNotNull()).withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths])))
    cut = cut.where(F.length(column) >= F.col("_width")).withColumn("_key", F.expr(f"left({column}, _width)"))
    return cut.join(keyed, ["_width", "_key"]).where(F.startswith(column, pattern)).drop("_width", "_key")
