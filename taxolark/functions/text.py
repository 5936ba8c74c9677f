"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words that carry no topic.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what said each which she do how their"
).split()
#: Fixed value: marks cut from both ends of a keyword.
MARKS = ".,!?;:\"()[]{}"
#: Number and unit, by measure.
UNITS = {
    "weight": r"(?i)\b(\d+(?:\.\d+)?)\s*(kg|g|lb|oz|pound|gram|kilogram)\b",
    "length": r"(?i)\b(\d+(?:\.\d+)?)\s*(cm|mm|m|in|inch|ft|foot|yard)\b",
    "volume": r"(?i)\b(\d+(?:\.\d+)?)\s*(ml|l|liter|oz|gallon|cup)\b",
}


def quoted(text: str) -> str:
    """A literal as a pattern of both Java and RE2."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.A)


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in code points; 1 if both are empty, 0 if one is; case is ignored."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def within_similarity(a: Column, b: str, threshold: float) -> Column:
    """Whether levenshtein_similarity reaches a threshold: by length first, then by a distance that stops early."""
    low, n = F.lower(a), len(b)
    longest = F.greatest(F.length(low), F.lit(n))
    most = max(0, int((1 - threshold) * n / max(threshold, 1e-9)) + 1)  # no longer text can be near enough
    short = F.abs(F.length(low) - n) <= most
    return short & (F.levenshtein(low, F.lit(b.lower()), most) >= 0) & (1 - F.levenshtein(low, F.lit(b.lower())) / longest >= threshold)


def word_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; 0 if either has none."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def bigrams(text: Column) -> Column:
    """The set of character bigrams of a lower-case text."""
    low = F.lower(text)
    return F.when(F.length(low) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substr(low, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """1 for equal texts and if neither has bigrams, 0 if one has none."""
    x, y = bigrams(a), bigrams(b)
    none = (F.size(x) == 0).cast("int") + (F.size(y) == 0).cast("int")
    return F.when((F.lower(a) == F.lower(b)) | (none == 2), 1.0).when(none == 1, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def keywords(text: Column) -> Column:
    """Words in order, repeats included: longer than two letters and no stop word as they stand, then without marks at the ends."""
    kept = F.filter(words(F.lower(text)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.filter(F.transform(kept, lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def phrases(text: Column, shortest: int = 2, longest: int = 4) -> Column:
    """Distinct stretches of words that neither begin nor end with a stop word and have more than five characters."""
    own = words(F.lower(text))

    def stretches(n: int) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.slice(own, i, F.lit(n)))
        return F.when(F.size(own) >= n, whole).otherwise(F.array().cast("array<array<string>>"))

    grams = [stretches(n) for n in range(shortest, longest + 1)]
    good = F.filter(F.flatten(F.array(*grams)), lambda g: ~F.try_element_at(g, F.lit(1)).isin(STOP_WORDS) & ~F.try_element_at(g, F.lit(-1)).isin(STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(good, lambda g: F.array_join(g, " ")), lambda p: F.length(p) > 5))


def clean_for_embedding(text: Column) -> Column:
    """White space collapsed, marks other than - . , to spaces, repeated full stops to one."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    plain = F.regexp_replace(one, r"[^\p{L}\p{N}_\s\-.,]", " ")
    stops = F.regexp_replace(plain, r"\.{2,}", ".")
    return F.trim(F.regexp_replace(stops, r"\s+", " "))


#: Shorthand and what it stands for, in the order in which it is replaced.
SHORTHAND = ((r"w/(\s|$)", "with$1"), (r"w/o(\s|$)", "without$1"), (r"\s&\s", " and "), (r"\s\+\s", " plus "), (r"\bsz\b", "size"), (r"\bclr\b", "color"), (r"\bqty\b", "quantity"))


def normalize_term(term: Column) -> Column:
    """A vocabulary term as it is compared: lower case, shorthand spelled out, only letters, digits, spaces and hyphens."""
    out = F.regexp_replace(F.trim(F.lower(term)), r"\s+", " ")
    for pattern, by in SHORTHAND:
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(F.replace(out, F.lit("_"), F.lit(" ")), r"[^a-z0-9\s\-]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def extract_units(text: Column) -> Column:
    """array<struct<measure, number, unit>>: all quantities, by measure."""

    def of(measure: str, pattern: str) -> Column:
        number, unit = (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) for group in (1, 2))
        return F.zip_with(number, unit, lambda n, u: F.struct(F.lit(measure).alias("measure"), n.cast("double").alias("number"), u.alias("unit")))

    return F.flatten(F.array(*[of(m, p) for m, p in UNITS.items()]))


def attribute_name(name: Column) -> Column:
    """Lower case, spaces and hyphens to underscores, nothing else but letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[\s\-]+", "_"), r"[^a-z0-9_]", "")


def attribute_value(value: Column, kind: str, value_map: dict[str, str] | None = None, allowed: list[str] | None = None) -> Column:
    """An extracted value in canonical form: mapped, spelled as allowed, a bare number, or true and false."""
    out = F.trim(F.regexp_replace(value, r"\s+", " "))
    if value_map:
        table = F.create_map(*[F.lit(x) for pair in value_map.items() for x in (pair[0].lower(), pair[1])])
        out = F.coalesce(F.try_element_at(table, F.lower(out)), out)
    if kind == "categorical" and allowed:
        table = F.create_map(*[F.lit(x) for a in allowed for x in (a.lower(), a)])
        out = F.coalesce(F.try_element_at(table, F.lower(out)), out)
    if kind == "numeric":
        out = F.regexp_replace(out, r"[^0-9.\-]", "")
    if kind == "boolean":
        low = F.lower(out)
        out = F.when(low.isin("true", "1", "yes", "y"), "true").when(low.isin("false", "0", "no", "n"), "false").otherwise(out)
    return out


def highlight(text: Column, query: str, before: str = "<em>", after: str = "</em>") -> Column:
    """Each place of the query, whatever its case, between marks."""
    return F.regexp_replace(text, f"(?i)({quoted(query)})", f"{before}$1{after}")


def level(score: Column, cuts: tuple[tuple[float, str], ...], least: str) -> Column:
    out = None
    for cut, name in cuts:
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise(least)


def semantic_level(score: Column) -> Column:
    return level(score, ((0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")), "very_low")


def mapping_level(score: Column) -> Column:
    return level(score, ((0.95, "exact"), (0.8, "high"), (0.6, "medium"), (0.4, "low")), "uncertain")
