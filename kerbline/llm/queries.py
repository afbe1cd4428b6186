"""Queries of the sampling and text problems (p4, p6 to p8)."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import encoding, leaks, quality, quota


def tokenizer_folder() -> str:
    """Folder of the public vocabulary files: KERBLINE_TOKENIZERS, else the installed package of them."""
    if folder := os.environ.get("KERBLINE_TOKENIZERS"):
        return folder
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or spec.origin is None:
        raise FileNotFoundError("set KERBLINE_TOKENIZERS to the folder of the vocabulary files")
    return str(Path(spec.origin).parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return quota.draw_sample(table(spark, sf_dir, "sequence_sample"), table(spark, sf_dir, "sample_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets the pool cannot meet, as the priorities of its records tell."""
    return quota.unmet_targets(table(spark, sf_dir, "sequence_sample"), table(spark, sf_dir, "sample_targets"))


def p4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with the priority of its category's last record and the records that come first for its minimum."""
    return quota.shortfalls(table(spark, sf_dir, "sequence_sample"), table(spark, sf_dir, "sample_targets")).drop("key")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir)[1]


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encoding.encode(table(spark, sf_dir, "documents"), f"{tokenizer_folder()}/byte_bpe_50k.tiktoken")
    return encoded.withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were changed or dropped because of leaked passages."""
    cleaned = leaks.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return cleaned.filter(F.size("leaked_items") > 0)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.find_non_prose(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_targets, p4_sample, p4_report, p6_ids, p7_found, p7_cleaned, p8_found, p8_statistics)}


_TEXT = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_COUNTED = (
    "with p as (select count(distinct sequence_id) as n from sequence_sample), c as (select sequence_id, 'preferred_camera_rule' as f, preferred_camera_rule as v from sequence_sample "
    "union all select sequence_id, 'approach', approach from sequence_sample union all select sequence_id, 'target_object', target_object from sequence_sample "
    "union all select sequence_id, 'weather_tags', list_filter(string_split(coalesce(weather_tags, ''), '|'), lambda x: trim(x, chr(32) || chr(9)) <> '')[1] from sequence_sample), "
    f"h as (select f, lower({_TEXT.format(x='v')}) as k, count(distinct sequence_id) as n from c group by all), "
    "t as (select t.*, coalesce(h.n, 0)::bigint as available, p.n // 10 as sample_size from sample_targets t left join h on h.f = t.field_name "
    f"and h.k = lower({_TEXT.format(x='t.category')}), p) "
)
_IS_UNMET = "(available * 1000 < target_permille * sample_size or available < min_rows)"
_UNMET = f"{_COUNTED} select field_name, category from t where {_IS_UNMET}"
_TARGETS = (
    f"{_COUNTED} select field_name, category, target_permille, min_rows, available, sample_size, case when available > 0 and target_permille > 0 then (available::double - 0.5::double) * 1000 / target_permille end as last_priority, "
    f"least(available, min_rows)::bigint as floor_rows, {_IS_UNMET} as unmet from t"
)


# fixed values, written out here for themselves: frequent function words of the corpus languages
_FUNCTION_WORDS = """
the a an and or of to in on at by for from with without as is are was were be been it its this that these those he she we i you they
not no but so if then than when while until because although after before between behind under over into near next close what who which
why how our their there here where had has have did do does will would can could up out off all most some any one
der die das den dem des ein eine einen einem einer und oder in im an am auf aus bei beim mit ohne zu zum zur von vom für ist sind war wird
nicht kein keine aber auch als so wenn dann nach vor hinter unter über neben wegen trotz es sie er wir ich was wie warum nur noch bis ab
dazu darum deshalb also etwa nochmals
le la les l un une des du de d et ou à au aux en dans sur sous par pour avec sans est sont était ne pas plus mais donc si que qui quoi ce
cette ces il elle on nous vous je reste après avant derrière près malgré alors personne n c s pendant juste
el la los las un una unos de del y o a al en con sin por para es son era no más pero si que quien esta este esto se lo le su sus nos yo
después antes detrás cerca aunque así durante hasta unos sigue
"""
_BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _statistics_sql() -> str:
    words = ", ".join(f"'{w}'" for w in sorted(set(_FUNCTION_WORDS.split())))
    share = lambda a, b: f"case when {b} > 0 then {a} / {b} else 0.0 end::double"
    tags = "p|div|span|b|i|u|em|strong|br|ul|ol|li|td|th|tr|table|tbody|thead|h[1-6]|a|s|unk|code|pre|blockquote"
    laid_out = "t"
    for pattern, by in (("<tr\\b[^<>]*>", "chr(10)"), ("<t[dh]\\b[^<>]*>", "'|'"), ("<li\\b[^<>]*>", "chr(10) || '- '"), (rf"</?(?:{tags})\b[^<>]*>|<\|[a-z_]+\|>", "''")):
        laid_out = f"regexp_replace({laid_out}, '{pattern}', {by}, 'gi')"
    word = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"
    kana = r"((?:\p{Hiragana}\p{M}*)+|(?:[\p{Katakana}ー]\p{M}*)+|(?:\p{Han}\p{M}*)+)"
    quote = "''" + '"'
    plain = rf".,;:!?{quote}()\-–—…、。！？「」’‘“”¿¡"
    symbol = rf"[^\p{{L}}\p{{M}}\p{{N}}\p{{Cf}}\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2300}}-\x{{23FF}}\x{{2B00}}-\x{{2BFF}}{_BLANK}{plain}]"
    ended = rf"[.!?…。！？:;][{quote}”’)»]*[{_BLANK}]*$"
    n = "len(words)"
    return (
        "with t as (select doc_id, regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g') as t from documents), "
        f"m as (select doc_id, case when contains(t, '<') then {laid_out} else t end as t from t), "
        f"s as (select doc_id, regexp_extract_all(regexp_replace(t, '{kana}', ' \\1 ', 'g'), '{word}(?:[''’]{word})?') as words, "
        f"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) as lines, "
        f"length(regexp_replace(t, '[{_BLANK}]+', '', 'g')) as solid, len(regexp_extract_all(t, '{symbol}')) as symbols from m) "
        f"select doc_id, {n} as n_words, {share(f"length(array_to_string(words, {quote[:2]}))", n)} as mean_word_length, {share("symbols", "solid")} as symbol_ratio, "
        f"{share(f"len(list_filter(lines, lambda x: regexp_matches(x, '{ended}')))", "len(lines)")} as punctuated_lines, "
        f"{share(f"len(list_filter(words, lambda w: lower(w) in ({words}) or regexp_matches(w, '^\\p{{Hiragana}}')))", n)} as common_share from s"
    )


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _UNMET, "p4_targets": _TARGETS, "p8_statistics": _statistics_sql()}
