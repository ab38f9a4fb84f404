"""Names, predicates, questions and texts as keys and token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: legal forms, longest first, of which a key loses one ----
LEGAL_SUFFIXES = [
    "private limited", "public limited company", "limited liability partnership", "incorporated", "corporation", "company", "limited",
    "pvt ltd", "pvt. ltd.", "pvt", "ltd", "llp", "plc", "inc", "corp", "co",
]
HONORIFIC = r"(?i)^(mr|mrs|ms|miss|dr|prof|shri|smt|sri|sh)\.?\s+"
#: listing, industry, state, year, class, registration of an Indian corporate identity number
CIN = r"\b([LU])([0-9]{5})([A-Z]{2})([0-9]{4})([A-Z]{3})([0-9]{6})\b"
DIN = r"(?i)\bDIN[:\s#-]*([0-9]{8})\b"
ISIN = r"\b(IN[EF][0-9A-Z]{9})\b"
SINGULAR_ATTRIBUTES = r"\b(cin|isin|registered office|registration number|corporate identity|pan|head ?quarters?)\b"
SINGULAR_ROLES = r"\b(chief|secretary|chairman|chairperson|managing|president|compliance officer|cfo|ceo|coo|cto)\b"
PLURAL_ROLES = r"\b(director|member|subsidiary|subsidiaries|partner|shareholder|auditor|associate|associates|affiliate|affiliates|promoter|promoters|trustee|trustees)\b"
# ---- end of fixed values ----


def squeezed(text: Column) -> Column:
    """Lower case, one blank for any white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def predicate_key(predicate: Column) -> Column:
    """Lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(predicate, F.lit(""))), r"[^0-9A-Za-z_\s]", " "), r"\s+", " "))


def name_key(name: Column) -> Column:
    """Lower case without a leading title, punctuation and the first legal form of the list that it ends in."""
    text = predicate_key(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), HONORIFIC, ""))
    # the leftmost match is the longest form
    return F.regexp_replace(text, " (" + "|".join(x for x in LEGAL_SUFFIXES if "." not in x) + ")$", "")


def identifiers(text: Column) -> Column:
    """ARRAY<STRUCT(kind, value, normalized)> of the registration numbers in a text, each once."""

    def each(kind: str, values: Column, normal) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), normal(v).alias("normalized")))

    cin = lambda v: F.concat(F.substring(v, 7, 2), F.substring(v, 9, 4), F.substring(v, 16, 6))
    same = lambda v: v
    find = lambda p, g: F.regexp_extract_all(text, F.lit(p), g)
    return F.concat(each("cin", find(CIN, 0), cin), each("din", find(DIN, 1), same), each("isin", find(ISIN, 1), same))


def tokens(text: Column) -> Column:
    """The distinct words of more than two letters or digits, a plural s taken off."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(found, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def terms(text: Column, stop: list[str]) -> Column:
    """The distinct words of three or more letters, without the stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z'\-]{2,})"), 1)
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*[F.lit(w) for w in stop]))


def cardinality(predicate: Column) -> Column:
    """1 where only one holder at a time makes sense, 0 for many, by the words and the grammar of the predicate."""
    text = F.lower(F.coalesce(predicate, F.lit("")))
    head = F.element_at(F.split(F.regexp_replace(F.trim(text), r":+$", ""), r"\s[-–—]\s|\bof\b|\bfor\b"), 1)
    word = F.element_at(F.split(F.trim(head), r"\s+"), -1)
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$")
    return F.when(text.rlike(SINGULAR_ATTRIBUTES) | text.rlike(SINGULAR_ROLES), 1).when(text.rlike(PLURAL_ROLES) | plural, 0).otherwise(1)


def _once(value: Column, use) -> Column:
    """An expression of a value that is evaluated once, however often the expression names it, also within its lambdas."""
    return F.transform(F.array(value), use)[0]


def local_terms(a: Column, b: Column, stop: list[str], keep: int = 12) -> Column:
    """ARRAY<STRUCT(word, score)> of the words near one of two places and not the other.

    A word scores more the less else is near its place only, measured by what both share; the first
    place's words come first among equals, then the alphabet decides.
    """

    def apart(both: Column) -> Column:
        x, y = both["x"], both["y"]
        shared = F.greatest(F.size(F.array_intersect(x, y)), F.lit(1))
        return F.struct(F.array_sort(F.array_except(x, y)).alias("x"), F.array_sort(F.array_except(y, x)).alias("y"), shared.alias("shared"))

    def ranked(both: Column) -> Column:
        def scored(words: Column) -> Column:
            score = 1.0 / (1.0 + F.size(words) / both["shared"])
            return F.transform(F.slice(words, 1, keep), lambda w: F.struct(w.alias("word"), score.alias("score")))

        # all words of a place score the same
        x, y = both["x"], both["y"]
        return F.slice(F.when(F.size(x) <= F.size(y), F.concat(scored(x), scored(y))).otherwise(F.concat(scored(y), scored(x))), 1, keep)

    return _once(_once(F.struct(terms(a, stop).alias("x"), terms(b, stop).alias("y")), apart), ranked)


def merged_terms(structural: Column, local: Column, keep: int = 12) -> Column:
    """Words of both lists, each once, the structural ones first."""
    return F.slice(F.array_distinct(F.concat(structural, local)), 1, keep)
