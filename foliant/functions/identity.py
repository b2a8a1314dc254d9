"""Names and registry numbers of substances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CAS, _string, latin_digits, name_tokens, squeeze

#: Words that name no substance by themselves, Latin and Persian.
GENERIC_LATIN = "acid acids oxide oxides chloride chlorides alcohol alcohols ether ethers ester esters amine amines anhydride hydrate solution dust salt salts as and the isomers compounds".split()
GENERIC_PERSIAN = "اسید اکسید آمین امین الکل کلرید اتر استر نمک دی و ایزومرهای ایزومرها دمه ترکیبات همه به صورت نوع".split()
GENERIC_NAMES = GENERIC_LATIN + GENERIC_PERSIAN


def normalize_cas(c: Column | str) -> Column:
    """First registry number, without spaces; null if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(latin_digits(c), CAS, 0), r"\s", ""), F.lit(""))


def is_valid_cas(c: Column | str) -> Column:
    """Check digit: digits before it, from the right, times 1, 2, 3 ..., modulo 10."""
    text = _string(c)
    digits = F.regexp_replace(text, "[^0-9]", "")
    body = F.filter(F.split(F.reverse(F.left(digits, F.length(digits) - 1)), ""), lambda d: d != "")
    total = F.aggregate(F.transform(body, lambda d, i: d.cast("int") * (i + 1)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(text.rlike(r"^[0-9]{2,7}-[0-9]{2}-[0-9]$") & (total % 10 == F.right(digits, F.lit(1)).try_cast("int")), F.lit(False))


def cas_issues(c: Column | str) -> Column:
    return F.when(_string(c).rlike(r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"), F.array().cast("array<string>")).otherwise(F.array(F.lit("cas_format")))


def exposure_issues(value: Column, unit: Column) -> Column:
    fine = (value.rlike("[0-9]") & unit.isNotNull()) | value.rlike("[0-9]")
    return F.when(fine, F.array().cast("array<string>")).otherwise(F.array(F.lit("exposure_value")))


def extract_cas(*texts: Column) -> Column:
    """Ordered distinct registry numbers of several texts."""
    found = [F.regexp_extract_all(latin_digits(F.coalesce(t, F.lit(""))), F.lit(f"({CAS})"), F.lit(1)) for t in texts]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.regexp_replace(x, r"\s", "")))


def normalize_name(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def is_generic(c: Column | str, generic: list[str] = GENERIC_NAMES) -> Column:
    """Every token is a generic word; an empty name is generic."""
    words = F.array(*[F.lit(w) for w in generic])
    return F.forall(name_tokens(c), lambda t: F.array_contains(words, t))


def same_token_set(a: Column, b: Column, generic: list[str] = GENERIC_NAMES) -> Column:
    """Equal sets of tokens, of which one at least isn't generic."""
    words = F.array(*[F.lit(w) for w in generic])
    return (F.array_sort(name_tokens(a)) == F.array_sort(name_tokens(b))) & (F.size(F.array_except(name_tokens(a), words)) > 0)


def identity_names(*sources: Column) -> Column:
    """struct(cas, latin, persian): first registry number, longest Latin name that isn't generic, longest Persian run."""

    def longest(pattern: str, keep) -> Column:
        runs = F.flatten(F.array(*[F.regexp_extract_all(F.regexp_replace(F.coalesce(s, F.lit("")), CAS, "|"), F.lit(pattern), F.lit(0)) for s in sources]))
        runs = F.filter(F.transform(runs, lambda x: F.trim(x)), keep)
        ranked = F.transform(runs, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
        return F.array_max(ranked)["x"]

    return F.struct(
        F.get(extract_cas(*sources), F.lit(0)).alias("cas"),
        longest(r"[A-Za-z][A-Za-z0-9 ,'()-]{2,}", lambda x: (F.length(x) > 2) & ~is_generic(x)).alias("latin"),
        longest("[؀-ۿ][؀-ۿ‌ ]*", lambda x: F.length(x) > 1).alias("persian"),
    )


def identity_aliases(english: Column, persian: Column, extra: Column) -> Column:
    """map of language to ordered distinct aliases, without generic names and those that begin another one."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.array_compact(a), squeeze), lambda x: (x != "") & ~is_generic(x)))
    whole = lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: F.startswith(F.lower(y), F.concat(F.lower(x), F.lit(" ")))))
    latin = F.filter(extra, lambda x: ~x.rlike("[؀-ۿ]"))
    other = F.filter(extra, lambda x: x.rlike("[؀-ۿ]"))
    return F.create_map(F.lit("en"), whole(clean(F.concat(F.array(english), latin))), F.lit("fa"), whole(clean(F.concat(F.array(persian), other))))


def query_name_tokens(query: Column, skip: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z][a-z0-9-]+"), F.lit(0))
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in skip])))


def requested_fields(query: Column, cues: dict[str, str]) -> Column:
    """Fields whose cue pattern the query has, in the order of `cues`."""
    return F.array_compact(F.array(*[F.when(query.rlike(f"(?i){p}"), field) for field, p in cues.items()]))


def segments(cell: Column) -> Column:
    """One struct(name, cas) for each registry number of a cell: its name is what stands between it and the one before."""
    numbers = F.regexp_extract_all(cell, F.lit(f"({CAS})"), F.lit(1))
    names = F.split(cell, CAS, -1)
    pairs = F.zip_with(F.slice(names, F.lit(1), F.size(numbers)), numbers, lambda n, c: F.struct(F.trim(F.regexp_replace(n, r"[\[\](),;\n]+", " ")).alias("name"), F.regexp_replace(c, r"\s", "").alias("cas")))
    return F.when(F.size(numbers) > 0, pairs).otherwise(F.array(F.struct(F.trim(cell).alias("name"), F.lit(None).cast("string").alias("cas"))))


def entities(cell: Column) -> Column:
    """array of struct(cas, name, review): entities of a cell, line by line; without number or name they need review."""
    lines = F.filter(F.split(cell, "\n"), lambda x: F.trim(x) != "")
    each = F.flatten(F.transform(lines, segments))
    return F.transform(each, lambda s: F.struct(s["cas"].alias("cas"), s["name"].alias("name"), (s["cas"].isNull() | is_generic(s["name"])).alias("review")))


def search_variants(c: Column | str) -> Column:
    """The text, its lower case, without brackets, and with its words turned round a comma."""
    text = squeeze(c)
    bare = squeeze(F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", " "))
    turned = F.regexp_replace(text, r"^([^,]+),\s*(.+)$", "$2 $1")
    return F.array_distinct(F.filter(F.array(text, F.lower(text), bare, turned, F.replace(text, F.lit("-"), F.lit(" "))), lambda x: x != ""))


def name_pattern_match(blob: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.contains(F.lower(blob), F.lower(p)))


def ordered_rules(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """First rule that holds."""
    out = reduce(lambda acc, r: F.when(r[0], F.lit(r[1])) if acc is None else acc.when(r[0], F.lit(r[1])), rules, None)
    return out.otherwise(F.lit(otherwise))
