"""Text functions as column expressions; Python only where Unicode composition or HTML entities need it."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import vocabulary as V

#: Letters that composition may change; all other texts skip Python.
COMPOSABLE = r"[\p{M}ᄀ-ᇿΩKÅ豈-﫿]"
VIETNAMESE = (
    ("a", "áàảãạăắằẳẵặâấầẩẫậ"), ("e", "éèẻẽẹêếềểễệ"), ("i", "íìỉĩị"), ("o", "óòỏõọôốồổỗộơớờởỡợ"),
    ("u", "úùủũụưứừửữự"), ("y", "ýỳỷỹỵ"), ("d", "đ"), ("c", "ç"), ("n", "ñ"),
)
MORE_ACCENTS = (("a", "äåā"), ("e", "ëē"), ("i", "ïîī"), ("o", "öō"), ("u", "üûū"), ("y", "ÿ"))
ACCENTED = "".join(letters for _, letters in (*VIETNAMESE, *MORE_ACCENTS))
PLAIN = "".join(plain * len(letters) for plain, letters in (*VIETNAMESE, *MORE_ACCENTS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    composable = text.rlike(COMPOSABLE)
    return F.when(composable, _composed(F.when(composable, text))).otherwise(text)  # Python sees null for all others


def squeezed(text: Column) -> Column:
    """Zero-width characters go, runs of blanks but line ends become one space, the ends are trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(text, V.ZERO_WIDTH, ""), r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(spaced, r"(?U)^\s+|\s+$", "")


#: Words of letters that neither composition nor blanks concern, one space between them: nothing to squeeze.
TIDY = r"^[!-~À-ɏẠ-ỹ]++(?: [!-~À-ɏẠ-ỹ]++)*+\z"


def tidied(value: Column) -> Column:
    """``squeezed`` of a value that costs nothing to name twice, as in lambdas; most lines need one look."""
    return F.when(value.rlike(TIDY), value).otherwise(squeezed(value))


def normalize_inline(text: Column, composed: bool = False) -> Column:
    """``composed``, here and below: the text has been through ``nfc``; lambdas need that, as no Python runs in them."""
    text = F.coalesce(text, F.lit(""))
    return squeezed(text if composed else nfc(text))


def lines(text: Column) -> Column:
    """Normalized lines that aren't blank."""
    return F.filter(F.transform(F.split(nfc(F.coalesce(text, F.lit(""))), r"\R"), tidied), lambda x: x != "")


def normalize_query(text: Column) -> Column:
    return F.array_join(lines(text), "\n")


def fold_accents(text: Column, composed: bool = False) -> Column:
    """Lower case, without the accents of Latin letters, đ as d."""
    return F.regexp_replace(F.translate(F.lower(normalize_inline(text, composed)), ACCENTED, PLAIN), r"\p{Mn}", "")


def normalize_code(text: Column, composed: bool = False) -> Column:
    """A document code: one kind of dash and slash, no blanks, no accents, no dots around."""
    one = F.translate(F.coalesce(text, F.lit("")), V.DASHES + "／⁄", "-" * len(V.DASHES) + "//")
    bare = F.regexp_replace(fold_accents(one, composed), r"(?U)\s+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "-+", "-"), "/+", "/"), "^[.,;:]+|[.,;:]+$", "")


def order_key(x: Column) -> Column:
    """Ids of digits first, by value, then the others by their letters."""
    x = x.cast("string")
    digits = x.rlike("^[0-9]+$")
    return F.struct(F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, x.try_cast("decimal(38,0)")).alias("value"), x.alias("id"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


_BREAKS = re.compile(r"<\s*(/?)\s*(br|p|div|li|tr|h[123])\b[^>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z!/][^>]*>")


def _without_tags(text: str | None) -> str | None:
    if text is None:
        return None
    if not _TAG.search(text):
        return html.unescape(text)
    spaced = _BREAKS.sub("\n", text)
    return html.unescape(re.sub(r"<!--.*?-->|<[A-Za-z!/][^>]*>", "", spaced, flags=re.S))


@F.pandas_udf(StringType())
def _stripped(texts: pd.Series) -> pd.Series:
    return texts.map(_without_tags)


def strip_html(text: Column) -> Column:
    """Text of a fragment, with line ends at block tags; what scripts and styles hold stays. Texts without a tag or entity skip Python."""
    marked = text.rlike("<[A-Za-z!/]|&")
    return F.when(marked, _stripped(F.when(marked, text))).otherwise(text)


def is_all_caps(text: Column) -> Column:
    return (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3) & ~text.rlike(r"\p{Ll}")


def ends_paragraph(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "").rlike(r"[.;:!?…]$|[”’)]$")


def structural_kind(text: Column) -> Column:
    """The kind of a line; the first rule that fits."""
    return let(normalize_inline(text), _kind)


def _kind(value: Column) -> Column:
    upper = F.regexp_replace(F.upper(value), ":+$", "")
    rules: list[tuple[Column, str]] = [
        (value == "", "empty"),
        (value.rlike(V.ELLIPSIS), "ellipsis"),
        (upper.isin(*V.DOCUMENT_TYPES), "document_type"),
        (upper.isin(*V.CONTENTS), "non_content"),
        (upper.isin(*V.REFERENCES), "references"),
        *((value.rlike("(?U)" + p), k) for p, k in (
            (V.CHAPTER, "chapter"), (V.SECTION, "section"), (V.ARTICLE, "article"), (V.APPENDIX, "appendix"), (V.NUMERIC, "numeric"),
            (V.CLAUSE, "clause"), (V.POINT, "point"), (V.ROMAN, "roman"), (V.BULLET, "bullet"),
        )),
        (reduce(lambda a, b: a | b, (value.startswith(p) for p in V.PREAMBLES)), "preamble"),
        (value.rlike(r"(?iuU)^(Số\s*:|Hà Nội,?\s+ngày\b)"), "metadata"),
        (value.rlike("^(Lời nói đầu|LỜI NÓI ĐẦU|Lời giới thiệu)$"), "heading"),
    ]
    out = F.lit("")
    for fits, kind in reversed(rules):
        out = F.when(fits, kind).otherwise(out)
    return out


def is_probable_heading(text: Column) -> Column:
    value = normalize_inline(text)
    few = F.size(F.split(value, " ")) <= 16
    return (value != "") & (F.length(value) <= 220) & (structural_kind(value) == "") & (~ends_paragraph(value) | is_all_caps(value)) & (is_all_caps(value) | few)


def slug_title(name: Column, link: Column) -> Column:
    """A title out of a name, or of the last part of a link's path."""
    of_path = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit("")), "/+$", ""), "^.*/", "")
    raw = F.coalesce(F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit("")), F.regexp_replace(of_path, r"\.[^.]+$", ""))
    return squeezed(F.translate(F.regexp_replace(raw, "-[0-9]{5,}$", ""), "_-", "  "))


def source_domain(link: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(link, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def clean_title(text: Column) -> Column:
    return F.regexp_replace(squeezed(F.regexp_replace(text, r"(?U)^\W+", "")), "^[ \\-–—:]+|[ \\-–—:]+$", "")


def _date(text: Column, pattern: str) -> Column:
    """The date of the first match, which alone is taken apart: texts are searched once."""

    def of(found: Column) -> Column:
        day, month, year = (F.lpad(F.regexp_extract(found, pattern, k), 4 if k == 3 else 2, "0") for k in (1, 2, 3))
        return F.when(found != "", F.coalesce(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").cast("string"), F.lit("")))

    return let(F.regexp_extract(text, pattern, 0), of)


def head(paragraphs: Column, n: int) -> Column:
    return F.array_join(F.slice(paragraphs, 1, n), "\n")


def promulgation_date(paragraphs: Column) -> Column:
    return F.coalesce(_date(head(paragraphs, 100), rf"(?iuU)\b{V.IN_WORDS}\b"), F.lit(""))


def effective_date(paragraphs: Column) -> Column:
    text = head(paragraphs, 400)
    return F.coalesce(_date(text, f"(?iuU){V.IN_FORCE}{V.IN_WORDS}"), _date(text, f"(?iuU){V.IN_FORCE}{V.IN_DIGITS}"), F.lit(""))


def document_number(paragraphs: Column) -> Column:
    # a number has digits, so none that is found is empty once it is normalized; only the one that counts is
    one = lambda text, may, p: F.when(text.rlike(may), let(F.regexp_extract(text, "(?iuU)" + p, 1), lambda x: F.nullif(x, F.lit(""))))
    return normalize_inline(let(head(paragraphs, 100), lambda text: F.coalesce(*(one(text, may, p) for may, p in zip(V.NUMBERS_MAY, V.NUMBERS, strict=True)))))


def document_type(paragraphs: Column) -> Column:
    kinds = F.transform(F.slice(paragraphs, 1, 80), lambda p: F.regexp_replace(F.upper(tidied(p)), ":+$", ""))
    found = F.filter(kinds, lambda k: k.isin(*V.DOCUMENT_TYPES) | k.rlike("^(TIÊU CHUẨN|QUY CHUẨN)"))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def issuing_authority(paragraphs: Column) -> Column:
    parts = F.flatten(F.transform(F.slice(paragraphs, 1, 60), lambda p: F.split(F.upper(tidied(p)), rf"-{{2,}}|(?U:\b){V.STATE}(?U:\b)", 3)))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, "^[ :\\-–—]+|[ :\\-–—]+$", ""))
    fits = F.filter(trimmed, lambda p: (F.length(p) <= 160) & ~p.isin(V.STATE, V.MOTTO) & p.rlike("(?U)" + V.AUTHORITY))
    first = F.get(fits, F.lit(0))
    return F.coalesce(F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2)))), F.lit(""))


def view_of(chunk_id: Column) -> Column:
    """The view that a chunk's id names."""
    out = F.when(chunk_id.endswith("__metadata"), "metadata")
    for letter, view in (("p", "packed"), ("l", "article"), ("r", "recovery"), ("s", "short")):
        out = out.when(chunk_id.rlike(f"__{letter}[0-9]+$"), view)
    return out.otherwise("unknown")


def content_body(text: Column) -> Column:
    marker = "[NỘI DUNG]"
    at = F.instr(text, marker)
    return F.when(at > 0, F.regexp_replace(F.substr(text, at + len(marker)), r"(?U)^\s+|\s+$", "")).otherwise("")


def article_title(text: Column) -> Column:
    """The text after an article's number if it is a title, else nothing."""
    title = normalize_inline(text)
    marked = reduce(lambda a, b: a | b, (F.contains(F.lower(title), F.lit(m)) for m in V.BODY_MARKERS))
    return F.when((F.length(title) > 150) | title.endswith(".") | title.endswith(";") | marked, "").otherwise(title)


def numeric_title(text: Column) -> Column:
    title = normalize_inline(text)
    out = title
    for marker in reversed(V.NUMERIC_MARKERS):
        at = F.instr(title, marker) - 1
        out = F.when((at >= 2) & (at <= 160), F.substr(title, F.lit(1), at)).otherwise(out)
    return F.when(F.length(out) > 180, F.concat(F.rtrim(F.substring(out, 1, 177)), F.lit("…"))).otherwise(out)


def clause_heading(text: Column) -> Column:
    raw = normalize_inline(text)
    title = F.regexp_replace(raw, ":+$", "")
    short = (F.size(F.split(title, " ")) <= 14) & ~title.rlike("[.;?!]$")
    return F.when((title != "") & (F.length(title) <= 180) & (raw.endswith(":") | short), title).otherwise("")


def is_heading_only(chunk_id: Column, text: Column) -> Column:
    """A chunk whose body is one line that is a heading; overview and recovery chunks never are."""
    body = content_body(text)
    value = normalize_inline(body)
    kind = structural_kind(value)
    article = value.rlike("(?U)" + V.ARTICLE) & (article_title(F.regexp_extract(value, "(?U)" + V.ARTICLE, 3)) != "")
    clause = (kind == "clause") & (clause_heading(F.regexp_extract(value, "(?U)" + V.CLAUSE, 2)) != "")
    return ~view_of(chunk_id).isin("metadata", "recovery") & (body != "") & ~F.contains(body, F.lit("\n")) & (kind.isin("chapter", "section", "appendix", "document_type", "heading") | article | clause)


def question_type(text: Column) -> Column:
    lower = F.lower(text)
    out = F.lit("what")
    for kind, pattern in reversed(V.QUESTION_TYPES):
        out = F.when(lower.rlike("(?uU)" + pattern), kind).otherwise(out)
    return out


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(V.YEAR), 1))


def unique_lines(values: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x != "")), "\n")


def tagged_fields(text: Column) -> Column:
    """The fields of a tagged chunk: each line belongs to the last tag before it; lines before any are metadata."""
    start = F.struct(F.lit("").alias("tag"), *(F.array().cast("array<string>").alias(k) for k in ("title", "number", "hierarchy", "body", "rest")))

    groups = {"title": V.TITLE_TAGS, "number": V.NUMBER_TAGS, "hierarchy": V.HIERARCHY_TAGS, "body": V.BODY_TAGS}

    def step(acc: Column, line: Column) -> Column:
        tag = F.when(line.rlike(r"^\[[^\]]+\]"), F.upper(squeezed(F.regexp_extract(line, r"^\[([^\]]+)\]", 1)))).otherwise(acc["tag"])
        # lines are squeezed; only what follows a tag may begin with blanks
        value = F.when(line.startswith("["), squeezed(F.regexp_replace(line, r"^\[[^\]]+\]\s*", ""))).otherwise(line)

        def put(own: Column) -> Column:
            into = lambda k, fits: F.when(fits & (own["value"] != ""), F.concat(acc[k], F.array(own["value"]))).otherwise(acc[k]).alias(k)
            known = own["tag"].isin(*(t for g in groups.values() for t in g))
            return F.struct(own["tag"].alias("tag"), *(into(k, own["tag"].isin(*g)) for k, g in groups.items()), into("rest", ~known))

        return let(F.struct(tag.alias("tag"), value.alias("value")), put)

    def finish(acc: Column) -> Column:
        rest = unique_lines(acc["rest"])
        body = unique_lines(acc["body"])
        return F.struct(
            unique_lines(acc["title"]).alias("title"), unique_lines(acc["number"]).alias("document_number"),
            F.coalesce(F.get(acc["number"], F.lit(0)), F.lit("")).alias("first_number"), unique_lines(acc["hierarchy"]).alias("hierarchy"),
            F.when(body == "", rest).otherwise(body).alias("body"), rest.alias("metadata"),
        )

    return F.aggregate(lines(text), start, step, finish)


def common_prefix(paths: Column) -> Column:
    """The longest common beginning of arrays."""

    def both(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        upto = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("long")) - 1, F.size(same).cast("long")).cast("int")
        return F.slice(a, F.lit(1), upto)

    return F.aggregate(F.slice(paths, 2, 1_000_000), F.coalesce(F.get(paths, F.lit(0)), F.array().cast("array<string>")), both)


def normalize_id(value: Column, kind: str = "string") -> Column:
    """An id as text: null is empty, a whole number of type double has no point, other values lose blanks around them.

    ``kind`` is the column's type; whole numbers of over 38 digits stay as they are written.
    """
    text = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    if kind in ("double", "float"):
        text = F.coalesce(F.when((value == F.rint(value)) & (F.abs(value) < 1e37), value.cast("decimal(38,0)").cast("string")), text)
    return F.coalesce(text, F.lit(""))


def finite(value: Column) -> Column:
    """The value; one that is null, NaN or infinite is an error when it is read."""
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("score is not finite")).cast("double")).otherwise(x)


def optional(value: Column, kind: str) -> Column:
    """A number of type ``kind``; null and an empty text are null, other text that is no number is an error."""
    return F.nullif(value, F.lit("")).cast(kind)
