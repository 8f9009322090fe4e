"""Rewriting of descriptions as a pure function of (id, position, seed), and its quality checks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.tables import settle
from ..schema import DEFAULTS, Settings

#: The built-in dictionary (fixed values).
SYNONYMS = {
    "хороший": ["отличный", "превосходный", "замечательный", "качественный"], "плохой": ["неудовлетворительный", "низкокачественный", "слабый"],
    "красивый": ["привлекательный", "эстетичный", "изящный"], "большой": ["крупный", "масштабный", "обширный"],
    "маленький": ["небольшой", "компактный", "миниатюрный"], "дорогой": ["ценный", "стоимостный", "премиальный"],
    "дешевый": ["экономичный", "бюджетный", "недорогой"], "новый": ["современный", "актуальный", "свежий"],
    "старый": ["устаревший", "архаичный", "ветхий"], "быстрый": ["скоростной", "оперативный", "шустрый"],
    "медленный": ["неторопливый", "замедленный", "размеренный"], "легкий": ["простой", "нетрудный", "элементарный"],
    "тяжелый": ["сложный", "затруднительный", "напряженный"], "важный": ["значительный", "критический", "приоритетный"],
    "полезный": ["ценный", "практичный", "функциональный"], "интересный": ["увлекательный", "захватывающий", "любопытный"],
    "популярный": ["востребованный", "распространенный", "известный"], "уникальный": ["эксклюзивный", "неповторимый", "особенный"],
    "надежный": ["доверительный", "стабильный", "прочный"], "удобный": ["комфортный", "эргономичный", "практичный"],
}
#: Words that are never replaced, and words that open a sentence (fixed values).
TERMS = (
    "мм", "см", "м", "км", "г", "кг", "л", "мл", "Вт", "кВт", "Гц", "кГц", "МГц", "В", "А", "Ом", "°C", "°F",
    "диаметр", "длина", "ширина", "высота", "глубина", "толщина", "объем", "вес", "мощность", "напряжение", "ток", "сопротивление",
    "частота", "скорость", "давление", "температура", "сталь", "алюминий", "пластик", "дерево", "стекло", "керамика",
    "резина", "силикон", "текстиль", "кожа", "металл", "гарантия", "производитель", "модель", "артикул", "серия",
    "партия", "сборка", "качество", "стандарт", "сертификат",
)
OPENERS = ("качественный", "надежный", "популярный", "современный", "практичный", "функциональный", "стильный")
#: Patterns that keep a whole sentence's words (fixed values).
KEEP_SENTENCE = "(?iuU)(?:\\d+[.,]?\\d*\\s*(?:мм|см|м|кг|г|л|мл|Вт|кВт|В|А|Гц)|\\b(?:диаметр|длина|ширина|высота|вес|мощность)\\b|\\b(?:модель|артикул|серия|гарантия)\\b)"
UNITS = ("mm", "cm", "kg", "g", "l", "ml")


def synonym_table(spark, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    rows = list((SYNONYMS if synonyms is None else synonyms).items())
    return spark.createDataFrame(rows, "word string, synonyms array<string>")


def add_synonyms(table: DataFrame, more: DataFrame) -> DataFrame:
    """Two dictionaries as one; a synonym stands once, in the order it came."""
    joined = table.alias("a").join(more.alias("b"), F.lower("a.word") == F.lower("b.word"), "full_outer")
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("a.synonyms", none), F.coalesce("b.synonyms", none))
    return joined.select(F.lower(F.coalesce("a.word", "b.word")).alias("word"), both.alias("synonyms"))


def dictionary_stats(table: DataFrame) -> DataFrame:
    n = F.size("synonyms")
    return table.agg(F.count("*").alias("entries"), F.sum(n).alias("total_synonyms"), F.avg(n).alias("average_synonyms"))


def lookup_synonyms(words: DataFrame, table: DataFrame) -> DataFrame:
    """words (id, pos, word) with a `synonym` chosen by a hash of (id, pos); null for words without one."""
    d = table.select(F.lower("word").alias("_word"), "synonyms")
    out = words.join(d, F.lower("word") == F.col("_word"), "left")  # broadcast by its size, if it is small
    pick = F.pmod(F.xxhash64("id", "pos"), F.size("synonyms").cast("long")).cast("int")
    return out.select(*words.columns, F.when(F.size("synonyms") > 0, F.get("synonyms", pick)).alias("synonym"))


def is_technical(words: DataFrame, terms: DataFrame) -> DataFrame:
    """words (id, pos, word) with a boolean `technical`: whether the dictionary `terms` (term) has it, case ignored."""
    known = terms.select(F.lower("term").alias("_term")).distinct().withColumn("_known", F.lit(True))
    out = words.join(known, F.lower("word") == F.col("_term"), "left")  # broadcast by its size, if it is small
    return out.select(*words.columns, F.coalesce("_known", F.lit(False)).alias("technical"))


def without_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The words that the dictionary of preserved terms lacks (an anti join)."""
    return words.join(terms.select(F.lower("term").alias("_term")).distinct(), F.lower("word") == F.col("_term"), "left_anti")


def in_context(words: DataFrame, width: int = 2) -> DataFrame:
    """words (id, pos, word) with arrays `before` and `after`: up to `width` neighbours on either side, in order.

    A window over a text's own words, in place of a join of positions.
    """
    w = W.partitionBy("id").orderBy("pos")
    around = lambda a, b: F.collect_list("word").over(w.rowsBetween(a, b))
    return words.withColumns({"before": around(-width, -1), "after": around(1, width)})


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def preserved_terms(text: Column, characteristics: Column | None = None) -> Column:
    """What a rewriting keeps: technical terms, brands and models named as such, characteristics with units."""
    found = F.concat(X.technical_terms(text), X.brands(text), X.models(text))
    if characteristics is not None:
        has_unit = lambda v: F.lower(v).rlike("|".join(UNITS))
        kept = F.filter(F.map_entries(characteristics), lambda e: has_unit(e["value"]))
        found = F.concat(found, F.transform(kept, lambda e: F.concat(e["key"], F.lit(" "), e["value"])))
    return F.array_sort(F.array_distinct(found))


def rewrite(rows: DataFrame, seed: int = 0, settings: Settings = DEFAULTS) -> DataFrame:
    """rows (id, text) with `rewritten`: synonyms, swapped words, turned clauses and sentences, by hashes of (id, place, seed).

    Sentences with a preserved term stay as they are. Sentences are pieces after `. `, `! ` and `? `.
    """
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    terms = F.array(*map(F.lit, TERMS))
    clean = X.preprocess(F.col("text"))
    # written tables, as Catalyst would else compute these per sentence and word
    out = settle(rows.withColumn("_clean", clean))
    out = settle(out.withColumn("_kept", preserved_terms(F.col("_clean"))))
    parts = F.filter(F.split(F.regexp_replace("_clean", "([.!?]) +", "$1\u0000"), "\u0000"), lambda s: s != "")

    def swapped(s: Column, i: Column) -> Column:
        def one(w: Column, j: Column) -> Column:
            bare = F.lower(w)
            chance = _chance(F.col("id").cast("string"), i, j, F.lit(seed))
            choice = F.get(table[bare], F.pmod(F.xxhash64(F.col("id").cast("string"), i, j, F.lit(seed + 1)), F.size(table[bare]).cast("long")).cast("int"))
            use = table[bare].isNotNull() & ~F.array_contains(terms, bare) & (chance < settings.synonym_rate)
            return F.when(use & ~s.rlike(KEEP_SENTENCE), choice).otherwise(w)

        return F.array_join(F.transform(F.split(s, " "), one), " ")

    def turned(s: Column, i: Column) -> Column:
        clauses = F.split(s, "(?<=[,;]) ")
        return F.when(F.size(clauses) > 1, F.array_join(F.reverse(clauses), " ")).otherwise(s)

    def ends(s: Column, i: Column) -> Column:
        w = F.split(s, " ")
        n = F.size(w)
        middle = F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0)))
        return F.when(n > 4, F.concat_ws(" ", F.element_at(w, -1), F.array_join(middle, " "), F.element_at(w, 1))).otherwise(s)

    def opened(s: Column, i: Column) -> Column:
        k = F.pmod(F.xxhash64(F.col("id").cast("string"), i, F.lit(seed + 2)), F.lit(len(OPENERS)).cast("long")).cast("int")
        return F.concat(F.get(F.array(*map(F.lit, OPENERS)), k), F.lit(" "), s)

    def one_sentence(s: Column, i: Column) -> Column:
        c = _chance(F.col("id").cast("string"), i, F.lit(seed + 3))
        short = F.size(F.split(s, " ")) < 5
        kept = X.contains_term(s, F.col("_kept"))
        return F.when(kept, s).when(short | (c < 0.4), swapped(s, i)).when(c < 0.6, turned(s, i)).when(c < 0.8, ends(s, i)).when(c < 0.9, opened(s, i)).otherwise(s)

    made = F.transform(parts, one_sentence)
    turn = _chance(F.col("id").cast("string"), F.lit(seed + 4)) < settings.reorder_rate
    out = settle(out.withColumn("_made", made))
    joined = F.array_join(F.when(turn, F.reverse("_made")).otherwise(F.col("_made")), " ")
    return out.withColumn("rewritten", X.correct_grammar(joined)).drop("_clean", "_kept", "_made")


def change_stats(original: Column, rewritten: Column) -> dict[str, Column]:
    count = lambda t: F.size(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    return {
        "original_length": F.length(original), "rewritten_length": F.length(rewritten),
        "original_words": count(original), "rewritten_words": count(rewritten),
    }


def repeats(text: Column, limit: int = 3) -> Column:
    """struct(most, problems): how often a text's commonest lower-case word of over two characters stands in it, and how
    many words stand over `limit` times. Its words in order, in runs: no word leaves its row."""
    ordered = F.array_sort(F.filter(X.words(text), lambda w: F.length(w) > 2))
    none = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), none.alias("run"), none.alias("most"), none.alias("problems"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        over = F.when(run == limit + 1, acc["problems"] + 1).otherwise(acc["problems"])
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"), over.alias("problems"))

    done = F.aggregate(F.coalesce(ordered, F.array().cast("array<string>")), start, step)
    return F.struct(done["most"].alias("most"), done["problems"].alias("problems"))


def repetition(rows: DataFrame, text: str = "text", key: str = "id", limit: int = 3) -> DataFrame:
    """(key, max_repetition, problem_words) of each row."""
    found = rows.select(key, repeats(F.col(text), limit).alias("r"))
    return found.select(key, F.col("r.most").alias("max_repetition"), F.col("r.problems").alias("problem_words"))


#: Advice on a rewriting (fixed values).
GOOD, PREFIX = "Текст соответствует всем критериям качества", "Рекомендации: "


def recommendation(ratio: Column, sim: Column, repeats: Column, readable: Column, issues: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(ratio < 0.5, "Увеличить длину текста").when(ratio > 2.0, "Уменьшить длину текста"),
            F.when(sim < 0.3, "Увеличить схожесть с оригиналом").when(sim > 0.9, "Уменьшить схожесть с оригиналом"),
            F.when(repeats > 3, "Уменьшить повторения слов"), F.when(readable < 0.6, "Улучшить читабельность"),
            F.when(issues > 0, "Исправить грамматические ошибки"),
        )
    )
    return F.when(F.size(parts) == 0, GOOD).otherwise(F.concat(F.lit(PREFIX), F.array_join(parts, ", ")))


def check_rewriting(rows: DataFrame, key: str = "id", least: float = 0.8) -> DataFrame:
    """rows (key, text, rewritten) with the five checks, the overall score, is_valid and advice."""
    out = rows.withColumn("_r", repeats(F.col("rewritten"))).withColumns({"max_repetition": F.col("_r.most"), "problem_words": F.col("_r.problems")}).drop("_r")
    out = out.withColumn("ratio", X.length_ratio(F.col("text"), F.col("rewritten")))
    out = out.withColumn("similarity", similarity("text", "rewritten")).withColumn("readability", X.readability(F.col("rewritten")))
    out = out.withColumn("issues", X.grammar_issues(F.col("rewritten")))
    c = F.col
    score = X.overall_score(c("ratio"), c("similarity"), c("max_repetition"), c("readability"), c("issues"))
    passed = c("ratio").between(0.5, 2.0) & c("similarity").between(0.3, 0.9) & (c("max_repetition") <= 3) & (score >= least)
    advice = recommendation(c("ratio"), c("similarity"), c("max_repetition"), c("readability"), c("issues"))
    return out.withColumn("overall_score", score).withColumn("is_valid", passed).withColumn("recommendation", advice)


def preservation(terms: Column, rewritten: Column) -> dict[str, Column]:
    """Kept and lost terms, the share kept of all, and whether that is 0.9 or more."""
    kept = X.preserved(terms, rewritten)
    rate = F.coalesce(F.try_divide(F.size(kept).cast("double"), F.size(terms).cast("double")), F.lit(1.0))
    return {"kept_terms": F.size(kept), "lost_terms": F.size(terms) - F.size(kept), "preservation_rate": rate, "preserved": rate >= 0.9}
