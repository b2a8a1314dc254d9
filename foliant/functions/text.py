"""Text: normalisation, tokens, OCR damage, overlaps.  Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Persian and Arabic digits, letters with one preferred form, zero-width joiner.
PERSIAN_DIGITS, ARABIC_DIGITS, LATIN_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
LETTER_FORMS = {"ي": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه"}
JOINER = "\u200c"
#: A registry number of chemical substances, also with spaces around its dashes.
CAS = r"[0-9]{2,7}\s*-\s*[0-9]{2}\s*-\s*[0-9]"
#: Misspelt limit names in queries.
LIMIT_SPELLINGS = [("twe|tw a|t w a", "TWA"), ("stell|stel l|s t e l", "STEL"), ("ceilling|cieling", "CEILING")]
#: Names of limits that may stand before a name.
LIMIT_WORDS = r"TWA|STEL|CEILING|OEL|TLV"


def _string(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latin_digits(c: Column | str) -> Column:
    return F.translate(_string(c), PERSIAN_DIGITS + ARABIC_DIGITS, LATIN_DIGITS * 2)


def squeeze(c: Column | str) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_string(c), r"(?U)\s+", " "))


def normalize_persian_text(c: Column | str) -> Column:
    """One form for each letter and digit; the joiner becomes a space."""
    forms = F.translate(F.trim(_string(c)), "".join(LETTER_FORMS), "".join(LETTER_FORMS.values()))
    return latin_digits(squeeze(F.replace(forms, F.lit(JOINER), F.lit(" "))))


def contains_persian(c: Column | str) -> Column:
    return _string(c).rlike("[\u0600-\u06ff]")


def normalize_query(c: Column | str) -> Column:
    """Digits, spaces, question mark and the spelling of limit names."""
    text = F.translate(latin_digits(F.replace(_string(c), F.lit(JOINER), F.lit(" "))), "؟", "?")
    return reduce(lambda t, rule: F.regexp_replace(t, rf"(?iU)\b(?:{rule[0]})\b", rule[1]), LIMIT_SPELLINGS, squeeze(text))


def strip_limit_prefix(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_string(c), rf"(?i)^\s*(?:{LIMIT_WORDS})\b[\s:/-]*", ""))


def expand_abbreviations(c: Column | str, rules: dict[str, str]) -> Column:
    """Whole-word replacements, in order, after normalize_query."""
    return reduce(lambda t, r: F.regexp_replace(t, rf"(?iU)\b{r[0]}\b", r[1]), rules.items(), normalize_query(c))


def lexical_tokens(c: Column | str) -> Column:
    """Lower-case words of two letters or more, registry numbers whole; repeats stay."""
    low = latin_digits(F.lower(_string(c)))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(rf"({CAS})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s", ""))
    rest = F.split(F.regexp_replace(F.regexp_replace(low, CAS, " "), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.concat(numbers, F.filter(rest, lambda x: F.length(x) > 1))


def token_set(c: Column | str) -> Column:
    """Distinct lower-case words of two letters or more; a registry number falls apart."""
    low = F.regexp_replace(latin_digits(F.lower(_string(c))), r"(?U)[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(low, r"(?U)\s+"), lambda x: F.length(x) > 1))


def name_tokens(c: Column | str) -> Column:
    """Distinct parts of a name."""
    return F.array_distinct(F.filter(F.split(F.lower(_string(c)), r"[\s,;:()\[\]/\\.-]+"), lambda x: x != ""))


def canonical_text(c: Column | str) -> Column:
    """For comparison with a source: no zero-width characters, one kind of dash, lower case."""
    text = F.translate(F.regexp_replace(_string(c), "[\u200b-\u200f\ufeff]", ""), "‐‑‒–—−", "------")
    return F.lower(squeeze(normalize_persian_text(text)))


def confirmed_fragments(c: Column | str) -> Column:
    """Runs of three or more one- or two-letter pieces that join to 4 to 24 letters.

    Each piece ends at a boundary, so there is one way to read a run and nothing to go back to:
    the possessive group is a loop, where a greedy one takes a stack frame for each piece.
    """
    runs = F.regexp_extract_all(_string(c), F.lit(r"((?U)\b\p{L}{1,2}(?:\s\p{L}{1,2}\b){2,}+)"), F.lit(1))
    return F.size(F.filter(runs, lambda x: F.length(F.regexp_replace(x, r"\s", "")).between(4, 24)))


def possible_fragments(c: Column | str) -> Column:
    return F.regexp_count(_string(c), F.lit(r"(?U)\b\p{L}\s\p{L}\s\p{L}\b"))


def join_fragments(c: Column | str) -> Column:
    """Neighbouring pieces of one or two letters as one word, by a fold over the words."""
    words = F.split(squeeze(c), " ")
    short = lambda w: w.rlike(r"(?U)^\p{L}{1,2}$")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("open"))

    def step(s: Column, w: Column) -> Column:
        glue = F.when(s["text"] == "", "").when(s["open"] & short(w), "").otherwise(" ")
        return F.struct(F.concat(s["text"], glue, w).alias("text"), short(w).alias("open"))

    return F.aggregate(words, start, step, lambda s: s["text"])


def rebuild_block(c: Column | str) -> Column:
    """Lines joined to sentences: a line that ends a sentence keeps its end, others run on."""
    lines = F.filter(F.transform(F.split(_string(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.aggregate(lines, F.lit(""), lambda t, x: F.when(t == "", x).when(t.rlike(r"[.:!?؟]$"), F.concat(t, F.lit("\n"), x)).otherwise(F.concat(t, F.lit(" "), x)))
    return joined


def spaced_marks(c: Column | str) -> Column:
    """No space before a mark, one after it."""
    text = F.regexp_replace(_string(c), r"[ \t]+([,.;:!?،؛؟])", "$1")
    return squeeze(F.regexp_replace(text, r"([,;!?،؛؟])(?=[^\s\d,.;:!?،؛؟])", "$1 "))


def repair_ocr(c: Column | str, rules: dict[str, str] | None = None) -> Column:
    """Phrase rules, then joined pieces, then spacing; numbers and Latin words stay."""
    text = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), (rules or {}).items(), _string(c))
    return spaced_marks(join_fragments(text))


def looks_like_table_row(c: Column | str) -> Column:
    """Two or more of: registry number, number with unit, run of numbers; or a number with unit beside a registry number."""
    text = _string(c)
    signs = [text.rlike(CAS), text.rlike(r"(?i)[0-9]\s*(?:ppm|mg/m)"), text.rlike(r"(?:[0-9]+(?:[./][0-9]+)?\s+){2,}"), text.rlike(r"\|.*\|")]
    return reduce(lambda a, b: a + b, [s.cast("int") for s in signs]) >= 2


def looks_like_table_header(c: Column | str, words: list[str]) -> Column:
    text = F.lower(_string(c))
    return (reduce(lambda a, b: a + b, [F.contains(text, F.lit(w.lower())).cast("int") for w in words]) >= 2) & (F.length(text) < 180)


def broken_text(c: Column | str) -> Column:
    """Presentation forms, replacement characters, or letters apart."""
    return _string(c).rlike("[\ufb50-\ufdff\ufe70-\ufefe\ufffd]") | (confirmed_fragments(c) > 0)


def is_fragment(c: Column | str) -> Column:
    text = _string(c)
    return (F.length(text) < 30) | (F.regexp_count(text, F.lit("\n")) > F.length(text) / 20) | text.rlike(r"^[\x00-\x7F]{1,12}$")


def malformed(c: Column | str) -> Column:
    text = _string(c)
    spaces = F.regexp_count(text, F.lit(r"\s"))
    return broken_text(text) | (possible_fragments(text) >= 3) | (spaces > 0.4 * F.length(text))


def incomplete_sentence(c: Column | str) -> Column:
    text = F.trim(_string(c))
    return (F.length(text) < 20) | ~text.rlike(r"[.!?؟:;)\]»\"']$")


def append_uncovered(parts: Column) -> Column:
    """Parts joined by line ends, without those already contained."""
    keep = F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.aggregate(keep, F.lit(""), lambda t, x: F.when(already_covered(x, t), t).when(t == "", x).otherwise(F.concat(t, F.lit("\n"), x)))


def already_covered(text: Column, blob: Column) -> Column:
    return F.contains(squeeze(F.lower(blob)), squeeze(F.lower(text)))


def token_coverage(content: Column | str, source: Column | str) -> Column:
    """Share of the source's tokens that the content has."""
    want = token_set(source)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, token_set(content))) / F.size(want)).otherwise(0.0)


def text_overlaps(content: Column | str, source: Column | str, least: float = 0.45) -> Column:
    a, b = F.lower(squeeze(content)), F.lower(squeeze(source))
    return F.contains(a, b) | F.contains(b, a) | (token_coverage(content, source) >= least)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def snippet(c: Column | str, n: int = 500) -> Column:
    return F.left(_string(c), F.lit(n))


def apply_edits(text: Column, edits: Column) -> Column:
    """Edits struct(start, end, new) applied from the last place to the first (0-based, end exclusive)."""
    last_first = F.sort_array(edits, asc=False)
    return F.aggregate(last_first, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new"], F.substr(t, e["end"] + 1)))


def changed_middle(before: Column, after: Column) -> Column:
    """struct(start, removed, added): what is between the common start and the common end."""
    least = F.least(F.length(before), F.length(after))

    def common(a: Column, b: Column, most: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), most), lambda i: F.left(a, i) == F.left(b, i))
        return F.array_max(hits)

    head = common(before, after, least)
    tail = common(F.reverse(before), F.reverse(after), least - head)
    return F.struct(
        head.alias("start"),
        F.substr(before, head + 1, F.length(before) - head - tail).alias("removed"),
        F.substr(after, head + 1, F.length(after) - head - tail).alias("added"),
    )


def validate_repair(text: Column, repaired: Column, confidence: Column) -> Column:
    """ACCEPT, REVIEW or REJECT for a proposed repair: it may not touch numbers, registry numbers or Latin words."""

    def same(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) == F.regexp_extract_all(repaired, F.lit(pattern), F.lit(0))

    words = lambda c: F.size(F.split(squeeze(c), " "))
    kept = same(r"[0-9۰-۹]+(?:[./][0-9۰-۹]+)?") & same(CAS) & same("[A-Za-z]{2,}")
    sane = (F.abs(words(text) - words(repaired)) <= 3) & (F.length(repaired) <= 2 * F.length(text) + 15)
    return F.when(~kept | ~sane | (confidence < 0.7), "REJECT").when(confidence < 0.9, "REVIEW").otherwise("ACCEPT")
