"""Lexical analysis: token arrays with their namespaces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vocabulary as V

WORD = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"


def word_tokens(value: Column, composed: bool = False) -> Column:
    """Lower-case words; a compound is followed by its parts."""
    value = F.coalesce(value, F.lit(""))
    found = F.regexp_extract_all(F.lower(value if composed else T.nfc(value)), F.lit(WORD), 0)
    return F.flatten(F.transform(found, lambda t: F.when(F.contains(t, F.lit("_")), F.concat(F.array(t), F.split(t, "_"))).otherwise(F.array(t))))


def expanded(tokens: Column) -> Column:
    """Each abbreviation followed by the words it stands for."""
    known = F.create_map(*(F.lit(x) for k, v in V.ABBREVIATIONS.items() for x in (k, v)))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.split(F.try_element_at(known, t), " "), F.array().cast("array<string>")))))


def is_stopword(token: Column) -> Column:
    return token.isin(*V.STOPWORDS)


def named(prefix: str, tokens: Column, stopwords: bool = False) -> Column:
    kept = tokens if stopwords else F.filter(tokens, lambda t: ~is_stopword(t))
    return F.transform(kept, lambda t: F.concat(F.lit(prefix + "¦"), t))


def bigrams(tokens: Column) -> Column:
    """Neighbours, unless both are stop words."""
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull() & ~(is_stopword(a) & is_stopword(b)), F.concat(F.lit("g¦"), a, F.lit("~"), b)))
    return F.filter(pairs, lambda p: p.isNotNull())


def folded(tokens: Column) -> Column:
    plain = F.transform(tokens, lambda t: F.translate(t, T.ACCENTED, T.PLAIN))
    return F.filter(F.zip_with(tokens, plain, lambda t, p: F.when((p != t) & (p != ""), F.concat(F.lit("a¦"), p))), lambda x: x.isNotNull())


def references(value: Column) -> Column:
    """Distinct references to parts of a document, such as article 5."""
    one = lambda x: F.translate(F.lower(x), T.ACCENTED, T.PLAIN)

    def found(text: Column) -> Column:
        kinds, numbers = (F.regexp_extract_all(text, F.lit("(?iuU)" + V.REFERENCE), k) for k in (1, 2))
        return F.array_distinct(F.zip_with(kinds, numbers, lambda k, n: F.concat(F.lit("r¦"), F.regexp_replace(one(k), r"\s+", "_"), F.lit("_"), one(n))))

    return T.let(T.normalize_query(value), found)


def document_tokens(text: Column, profile: str = "enhanced") -> Column:
    """Tokens of a chunk. ``plain``: its words; ``enhanced``: also its fields', bigrams, folded forms, code and references."""
    if profile not in ("plain", "enhanced"):
        raise ValueError(f"unknown profile {profile}")

    def base_of(f: Column) -> Column:
        parts = F.filter(F.array(f["title"], f["document_number"], f["hierarchy"], f["body"], f["metadata"]), lambda x: x != "")
        return expanded(word_tokens(F.array_join(parts, "\n"), composed=True))

    def of_field(prefix: str, value: Column) -> Column:
        return T.let(expanded(word_tokens(value, composed=True)), lambda w: F.concat(named(prefix, w), bigrams(w)))

    def all_of(f: Column) -> Column:
        base = T.let(base_of(f), lambda w: F.concat(named("u", w, True), folded(w)) if profile == "enhanced" else named("u", w, True))
        if profile == "plain":
            return base
        code = T.let(T.normalize_code(f["first_number"], composed=True), lambda c: F.when(c != "", F.array(F.concat(F.lit("c¦"), c))).otherwise(F.array().cast("array<string>")))
        return F.concat(base, of_field("t", f["title"]), of_field("h", f["hierarchy"]), of_field("b", f["body"]), code)

    found = T.let(T.tagged_fields(text), all_of)
    return F.concat(found, references(text)) if profile == "enhanced" else found


def query_tokens(question: Column, profile: str = "enhanced") -> Column:
    """Tokens of a question; its words but stop words are looked for in every field."""
    if profile not in ("plain", "enhanced"):
        raise ValueError(f"unknown profile {profile}")

    def all_of(words: Column) -> Column:
        if profile == "plain":
            return named("u", words, True)
        return F.concat(named("u", words, True), named("b", words), named("h", words), named("t", words), bigrams(words), folded(words))

    found = T.let(expanded(word_tokens(question)), all_of)
    if profile == "plain":
        return found
    codes = F.transform(F.regexp_extract_all(T.normalize_query(question), F.lit("(?iuU)" + V.QUERY_NUMBER), 0), lambda c: T.normalize_code(c, composed=True))
    return F.concat(found, F.transform(F.filter(codes, lambda c: c != ""), lambda c: F.concat(F.lit("c¦"), c)), references(question))


def signature(profile: str, segmenter: str = "simple") -> str:
    """Names the analysis that an index was built with; a query's must be the same."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"profile": profile, "segmenter": segmenter, "word": WORD}, sort_keys=True).encode()).hexdigest()
