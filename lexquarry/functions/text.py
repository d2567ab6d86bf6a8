"""Column functions on texts and citations; all of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of tokens and citations.
TOKEN = "[a-zäöüß]+"
EXPLICIT = r"Art\.\s+\d+[a-z]?(?:\s+Abs\.\s+\d+(?:\s+lit\.\s+[a-z])?)?\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöü]+"
CASES = [r"BGE\s+\d+\s+[IVX]+\s+\d+", r"\d[A-Z]_\d+/\d{4}"]
MINED = [
    r"BGE\s+\d+\s+[IV]+\s+\d+(?:\s+E\.\s*[\d.]+)?",
    r"\d[A-Z]_\d+/\d{4}(?:\s+E\.\s*[\d.]+)?",
    r"Art\.\s+\d+[a-z]?(?:\s+Abs\.\s+\d+)?(?:\s+lit\.\s+[a-z])?(?:\s+(?:Ziff|Bst)\.\s+\d+)?\s+[A-ZÄÖÜ][A-Za-zÄÖÜäöü]+",
]
LAW_KEY = r"^Art\.\s+(\d+[a-z]?)\b.*?([A-ZÄÖÜ][A-Za-zÄÖÜäöü]+)\s*$"
ARTICLE, STATUTE = r"^(Art\.\s+\d+[a-z]?)", r"\s+([A-ZÄÖÜ]{2,}[A-Za-zÄÖÜäöü]*)$"
CONSIDERATION = r"\s+E\.\s+.*$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once; an expression that lambdas name would be computed for each of their elements."""
    return F.transform(F.array(value), use)[0]


def tokenize(text: Column, longer_than: int = 1) -> Column:
    """Lower-case letter runs of more than so many letters, repeats included."""
    return F.filter(_all(F.lower(text), TOKEN), lambda t: F.length(t) > longer_than)


def compact(text: Column, limit: int) -> Column:
    """White space folded; what is longer than `limit` is cut and ends in three dots."""
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(folded) > limit, F.concat(F.rtrim(F.substring(folded, 1, limit - 3)), F.lit("..."))).otherwise(folded)


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def explicit_citations(text: Column) -> Column:
    """Statute citations a text names, each once, in order."""
    return F.array_distinct(_all(text, EXPLICIT))


def explicit_cases(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_all(text, p) for p in CASES]))


def mined_citations(text: Column) -> Column:
    """All citations in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.concat(*[_all(text, p) for p in MINED]), lambda c: F.trim(c))))


def court_base(citation: Column) -> Column:
    """A decision without its consideration."""
    return F.trim(F.regexp_replace(citation, CONSIDERATION, ""))


def law_base(citation: Column) -> Column:
    """Article and statute; a statute whose code has no two leading capitals is left out."""
    article, statute = F.regexp_extract(citation, ARTICLE, 1), F.regexp_extract(citation, STATUTE, 1)
    return F.when(~citation.startswith("Art. ") | (article == ""), citation).when(statute != "", F.concat(article, F.lit(" "), statute)).otherwise(article)


def law_base_by_tokens(citation: Column) -> Column:
    """The first two words and the last."""
    words = F.split(F.trim(citation), r"\s+")
    return F.when(F.size(words) < 3, citation).otherwise(F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, 2), F.element_at(words, -1)))


def statute_code(citation: Column) -> Column:
    return F.regexp_extract(citation, STATUTE, 1)


def statute_token(citation: Column) -> Column:
    """The last word."""
    return F.element_at(F.split(F.trim(citation), r"\s+"), -1)


def law_key(citation: Column) -> Column:
    """struct(statute, article), null for what is no such citation."""
    return F.when(citation.rlike(LAW_KEY), F.struct(F.regexp_extract(citation, LAW_KEY, 2).alias("statute"), F.regexp_extract(citation, LAW_KEY, 1).alias("article")))


def is_law(citation: Column) -> Column:
    return citation.startswith("Art.")


def kind_of(citation: Column) -> Column:
    """law, court or other, by how a citation begins."""
    return F.when(citation.rlike(r"^Art\.\s"), "law").when(citation.rlike(r"^BGE |^\d+[A-Z]_\d+/\d+"), "court").otherwise("other")


def kind_by_membership(citations, laws):
    """citations with `kind`: law for what is in the list of laws, court for all else."""
    known = laws.select("citation").distinct().withColumn("_law", F.lit(True))
    return citations.join(known, "citation", "left").withColumn("kind", F.when(F.col("_law"), "law").otherwise("court")).drop("_law")


def split_citations(joined: Column) -> Column:
    """Distinct trimmed citations of a text joined by semicolons, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ";"), lambda c: F.trim(c)), lambda c: c != ""))


def join_citations(citations: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(citations)), ";")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")


def payload_key(*columns: Column) -> Column:
    """SHA-1 of the values as a JSON object of named columns; a null has no entry."""
    return F.sha1(F.to_json(F.struct(*columns)))


def lenient_json(text: Column, schema: str) -> Column:
    """A JSON object from an answer: as it stands, without a code fence, or from the first brace to the last."""
    fenced = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text), schema), F.from_json(F.when(fenced.rlike(r"(?s)^\{.*\}$"), fenced), schema), F.from_json(F.when(braces != "", braces), schema))


def expand_case(case: Column, considerations: Column) -> Column:
    """A case with each of its considerations, or the bare case."""
    return F.when(F.size(F.coalesce(considerations, F.array())) > 0, F.transform(considerations, lambda e: F.concat(case, F.lit(" E. "), e))).otherwise(F.array(case))


def evidence(freq: Column, explicit: Column, case: Column, dense: Column, court_dense: Column, bm25: Column, sources: Column) -> Column:
    """Up to eight notes on where a candidate comes from."""
    own = F.array(  # fixed values: the notes and their order
        F.when(freq > 0, F.concat(F.lit("predicted_by_"), freq.cast("string"), F.lit("_gpt_runs"))),
        F.when(explicit, F.lit("citation_appears_in_question")),
        F.when(case, F.lit("gpt_case_citation")),
        F.concat(F.lit("law_dense_rank="), dense.cast("string")),
        F.concat(F.lit("court_dense_rank="), court_dense.cast("string")),
        F.concat(F.lit("bm25_rank="), bm25.cast("string")),
    )
    rest = F.filter(sources, lambda s: ~s.isin("dense", "bm25"))
    return F.slice(F.concat(F.filter(own, lambda x: x.isNotNull()), rest), 1, 8)
