"""Column functions on text. Word characters are letters, digits and `_` of any script."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]"
NOT_WORD = "[^\\p{L}\\p{N}_]"


def collapse(text: Column) -> Column:
    """White space as single spaces, trimmed; null for what is empty then."""
    return F.nullif(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(""))


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of them dots where text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def printf(template: str, number: Column) -> Column:
    """A template with one `%.nf` printed as C and SQL do: the double's exact value, halves to even; null for null.

    format_string rounds the shortest decimal half up instead (0.125 to 0.13, 15.45 to 15.5). From 2^63 on the digits
    are those of the shortest decimal and zeros.
    """
    before, digits, after = re.fullmatch(r"(.*?)%\.([1-9])f(.*)", template).groups()
    plain = lambda t: F.lit(t.replace("%%", "%"))
    shown = lambda x: F.call_function("format_number", x, F.lit("0." + "0" * int(digits)))
    size = F.abs(number)
    part = shown(size - F.floor(size))  # of a long number apart, as its shortest decimal lacks these digits; it may carry
    whole = F.floor(size) + F.substring(part, 1, 1).cast("bigint")
    long = F.concat(F.when(number < 0, "-").otherwise(""), whole.cast("string"), F.substring(part, 2, int(digits) + 1))
    return F.concat(plain(before), F.when((size >= 2.0**40) & (size < 2.0**63), long).otherwise(shown(number)), plain(after))


def title_if_shouting(text: Column) -> Column:
    """Capitals only for first letters where a text has letters and all of them are capitals."""
    shouting = (text == F.upper(text)) & (text != F.lower(text))
    return F.when(shouting, F.initcap(text)).otherwise(text)


def preprocess(text: Column) -> Column:
    """One space for white space, runs of marks cut short, other special characters dropped."""
    out = F.trim(F.regexp_replace(text, "\\s+", " "))
    out = F.regexp_replace(out, "\\.{2,}", "...")
    out = F.regexp_replace(out, "!{2,}", "!")
    out = F.regexp_replace(out, "\\?{2,}", "?")
    return F.regexp_replace(out, "[^\\p{L}\\p{N}_\\s.,!?\\-:()]", "")


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """The non-blank pieces between runs of sentence marks, trimmed."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: s != "")


def readability(text: Column) -> Column:
    """1 at ten words a sentence, 0.05 less for each further word, 0 at least; 0 without sentences."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    add = lambda a, s: F.struct((a["words"] + F.size(F.split(s, " "))).alias("words"), (a["n"] + 1).alias("n"))
    score = lambda a: F.greatest(F.lit(0.0), 1 - (F.try_divide(a["words"].cast("double"), a["n"].cast("double")) - 10) / 20)
    return F.coalesce(F.aggregate(sentences(text), start, add, score), F.lit(0.0))


def length_ratio(original: Column, rewritten: Column) -> Column:
    return F.when(F.length(original) == 0, 1.0).otherwise(F.length(rewritten) / F.length(original))


def grammar_issues(text: Column, compat: bool = True) -> Column:
    """The number of issues: unmarked sentences (compat: every piece but the last counts, as the split drops its
    mark; else the last if it lacks one), two spaces in a row, a sentence that starts in lower case."""
    pieces = F.split(text, "[.!?]+")
    inner = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    unmarked = F.size(F.filter(inner, lambda s: s != "")) if compat else F.when(text.rlike("[^.!?\\s]\\s*$"), 1).otherwise(0)
    spaces = F.when(F.contains(text, F.lit("  ")), 1).otherwise(0)
    lower = F.exists(pieces, lambda s: F.substring(s, 1, 1).rlike("^\\p{Ll}"))
    return unmarked + spaces + F.when(lower, 1).otherwise(0)


def overall_score(ratio: Column, similarity: Column | None, repeats: Column, readable: Column, issues: Column) -> Column:
    """The weighted quality of a rewriting, 0 to 1; without a similarity its part is left out."""
    length = F.when(ratio < 1, ratio).otherwise(1 / ratio)
    score = 0.2 * length + 0.2 * F.greatest(F.lit(0.0), 1 - (repeats - 1) / 5)
    score = score + 0.2 * readable + 0.1 * F.greatest(F.lit(0.0), 1 - issues / 5)
    if similarity is not None:
        score = score + 0.3 * (1 - F.abs(similarity - 0.6))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


#: Patterns of technical terms (fixed values).
TECHNICAL_TERMS = (
    "\\d+[.,]?\\d*\\s*(?:мм|см|м|кг|г|л|мл|Гц|кГц|МГц|Вт|кВт|В|А|ч|°C)",
    "\\b(?:диаметр|длина|ширина|высота|глубина|вес|объем|мощность|напряжение|ток|частота)\\b",
    "\\b(?:материал|цвет|размер|габариты|технические?|характеристики?|параметры?)\\b",
)


def technical_terms(text: Column) -> Column:
    """The distinct technical terms of a text, sorted."""
    found = [F.regexp_extract_all(text, F.lit(f"(?iuU)({p})"), F.lit(1)) for p in TECHNICAL_TERMS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def contains_term(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def is_preserved_word(word: Column, terms: Column) -> Column:
    bare = lambda x: F.regexp_replace(F.lower(x), NOT_WORD, "")
    return F.array_contains(F.transform(terms, bare), bare(word))


def correct_grammar(text: Column) -> Column:
    """A space after sentence marks before Cyrillic, single spaces, capitals at sentence starts, a final mark."""
    out = F.regexp_replace(F.regexp_replace(text, "([.!?])([А-Яа-я])", "$1 $2"), " +", " ")
    marked = F.regexp_replace(out, "([.!?] )", "$1\u0000")
    parts = F.transform(F.split(marked, "\u0000"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))
    out = F.trim(F.array_join(parts, ""))
    return F.when((out == "") | out.rlike("[.!?]$"), out).otherwise(F.concat(out, F.lit(".")))


def preserved(original_terms: Column, rewritten: Column) -> Column:
    return F.filter(original_terms, lambda t: F.contains(F.lower(rewritten), F.lower(t)))


def analyze(text: Column) -> Column:
    """array of struct(text, tokens, n_words, n_numbers): sentences by their marks, tokens as words or single marks."""

    def one(sentence: Column) -> Column:
        tokens = F.regexp_extract_all(sentence, F.lit(f"({WORD}+|[^\\p{{L}}\\p{{N}}_\\s])"), F.lit(1))
        numbers = F.size(F.filter(tokens, lambda t: t.rlike("^\\p{N}+$")))
        return F.struct(sentence.alias("text"), tokens.alias("tokens"), F.size(F.filter(tokens, lambda t: t.rlike(WORD))).alias("n_words"), numbers.alias("n_numbers"))

    pieces = F.split(F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), "([.!?]+) ", "$1\u0000"), "\u0000")
    return F.transform(F.filter(pieces, lambda s: s != ""), one)


def brands(text: Column) -> Column:
    """Words after a brand indicator (a rule in place of a language model), distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?iuU)\\b(?:бренд|марка|производитель|brand|make)\\s*:?\\s+([\\p{L}\\p{N}-]+)"), F.lit(1))))


def models(text: Column) -> Column:
    """Words of letters and digits after a model indicator, distinct and sorted."""
    word = "((?=[^\\s]*\\d)(?=[^\\s]*\\p{L})[\\p{L}\\p{N}-]+)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?iuU)\\b(?:модель|version|тип|model)\\s*:?\\s+{word}"), F.lit(1))))


def lemma(word: Column, lemmas: Column | None = None) -> Column:
    """A word's lemma in a map of lower-case forms; the word itself without one."""
    return word if lemmas is None else F.coalesce(lemmas[F.lower(word)], word)
