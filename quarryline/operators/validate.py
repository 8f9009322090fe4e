"""Data rules on product records: codes and messages per row, quality metrics, error counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import VALID
from ..schema import DEFAULTS, Settings

#: Messages by rule code (fixed values); %s stands for the value at hand.
MESSAGES = {
    "missing": "Отсутствует обязательное поле: %s", "name_short": "Название слишком короткое (мин. %s символов)", "name_long": "Название очень длинное (%s символов)",
    "name_blank": "Название должно содержать буквы или цифры", "name_special": "Название содержит специальные символы", "price_null": "Цена не может быть None",
    "price_negative": "Цена не может быть отрицательной", "price_high": "Цена очень высокая: %s", "price_digits": "Цена имеет более 2 знаков после запятой",
    "url_format": "Неверный формат URL", "url_long": "URL очень длинный", "url_scheme": "URL должен использовать HTTP или HTTPS протокол",
    "images_none": "Нет изображений товара", "images_many": "Слишком много изображений: %s", "image_format": "Неверный формат URL изображения %s",
    "image_extension": "Изображение имеет нестандартное расширение: %s", "keys_none": "Нет характеристик товара", "key_long": "Слишком длинный ключ характеристики: %s",
    "value_long": "Слишком длинное значение характеристики: %s",
}


def finding(code: str, value: Column | None = None, tag: Column | str = "") -> Column:
    """struct(code, message); tag tells rules of one code apart (the field that is missing)."""
    full = F.concat(F.lit(code), F.lit(":"), tag) if isinstance(tag, Column) else F.lit(f"{code}:{tag}" if tag else code)
    message = F.format_string(MESSAGES[code], value.cast("string")) if value is not None else F.lit(MESSAGES[code])
    return F.struct(full.alias("code"), message.alias("message"))


def falsy(column: str, kind: str) -> Column:
    c = F.col(column)
    return c.isNull() | ((c == 0) if kind in ("double", "int", "bigint", "float") else (c == ""))


def validate(products: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """products with `errors` and `warnings` (arrays of code and message) and `is_valid`. A missing column has no rules."""
    kinds = dict(products.dtypes)
    has = kinds.__contains__
    errors: list[Column] = []
    warnings: list[Column] = []
    for f in settings.required:
        gone = falsy(f, kinds[f]) if has(f) else F.lit(True)
        errors.append(F.when(gone, finding("missing", F.lit(f), f)))
    if has("name"):
        name = F.trim("name")
        errors += [F.when(F.length(name) < settings.name_min, finding("name_short", F.lit(settings.name_min))), F.when(~name.rlike("[\\p{L}\\p{N}]"), finding("name_blank"))]
        warnings += [F.when(F.length(name) > settings.name_max, finding("name_long", F.length(name))), F.when(name.rlike("[^\\p{L}\\p{N}_\\s\\-.,!?()]"), finding("name_special"))]
    if has("price"):
        price = F.col("price")
        errors += [F.when(price.isNull(), finding("price_null")), F.when(price < 0, finding("price_negative"))]
        warnings += [F.when(price > settings.price_max, finding("price_high", price)), F.when(price != F.round(price, 2), finding("price_digits"))]
    if has("url"):
        url = F.trim("url")
        errors += [F.when(~url.rlike(VALID), finding("url_format")), F.when(~url.rlike("^https?://"), finding("url_scheme"))]
        warnings.append(F.when(F.length(url) > settings.url_max, finding("url_long")))
    found_e, found_w = F.array_compact(F.array(*errors)), F.array_compact(F.array(*warnings))
    if has("images"):
        images = F.transform("images", F.trim)
        ends = "(?i)(" + "|".join(e.replace(".", "\\.") for e in settings.image_formats) + ")$"
        bad = F.filter(F.transform(images, lambda u, i: F.when(~u.rlike(VALID), finding("image_format", i))), lambda x: x.isNotNull())
        odd = F.transform(F.filter(images, lambda u: ~u.rlike(ends)), lambda u: finding("image_extension", u))
        count = F.array_compact(F.array(F.when(F.size("images") == 0, finding("images_none")), F.when(F.size("images") > settings.images_max, finding("images_many", F.size("images")))))
        none = F.array().cast("array<struct<code:string,message:string>>")
        found_e = F.concat(found_e, F.coalesce(bad, none))
        found_w = F.concat(found_w, F.coalesce(count, none), F.coalesce(odd, none))
    if has("characteristics"):
        entries = F.map_entries("characteristics")
        keys = F.transform(F.filter(entries, lambda e: F.length(e["key"]) > settings.key_max), lambda e: finding("key_long", e["key"]))
        long = F.transform(F.filter(entries, lambda e: F.length(e["value"]) > settings.value_max), lambda e: finding("value_long", e["key"]))
        empty = F.array_compact(F.array(F.when(F.size("characteristics") == 0, finding("keys_none"))))
        none = F.array().cast("array<struct<code:string,message:string>>")
        found_w = F.concat(found_w, F.coalesce(empty, none), F.coalesce(keys, none), F.coalesce(long, none))
    return products.withColumn("errors", found_e).withColumn("warnings", found_w).withColumn("is_valid", F.size("errors") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("is_valid"), validated.where("not is_valid")


def quality_metrics(validated: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if("is_valid")
    share = F.coalesce(F.try_divide(ok.cast("double"), n.cast("double")), F.lit(0.0))
    return validated.agg(
        n.alias("total_products"), ok.alias("valid_products"), (n - ok).alias("invalid_products"),
        share.alias("completeness_score"), share.alias("validity_score"), share.alias("quality_score"),
    )


def error_histogram(validated: DataFrame) -> DataFrame:
    """How often each rule fails, by its code, so that indexes within messages do not split it."""
    return validated.select(F.explode("errors").alias("e")).groupBy("e.code").agg(F.count("*").alias("n"))


#: Advice of the validation report (fixed values).
ADVICE = ("Улучшите качество данных: проверьте обязательные поля и форматы", "Исправьте частые ошибки: ", "Увеличьте полноту данных: добавьте недостающие поля")


def recommendations(metrics: DataFrame, histogram: DataFrame) -> DataFrame:
    """(position, advice); the three most frequent errors, ties by code."""
    top = histogram.orderBy(F.desc("n"), "code").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), lambda x: x["code"]), ", ").alias("top"))
    found = F.array_compact(
        F.array(
            F.when(F.col("quality_score") < 0.8, ADVICE[0]), F.when(F.col("top") != "", F.concat(F.lit(ADVICE[1]), F.col("top"))),
            F.when(F.col("completeness_score") < 0.9, ADVICE[2]),
        )
    )
    both = metrics.unionByName(top, allowMissingColumns=True)  # one row each, folded into one
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select(F.posexplode(found).alias("position", "advice"))


def report(metrics: DataFrame) -> DataFrame:
    return metrics.select("total_products", "valid_products", "invalid_products", F.col("quality_score").alias("data_quality_score"))
