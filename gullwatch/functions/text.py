"""Text normalisation as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gullwatch.functions.fixed import (
    ATTACK_TERMS,
    ESCAPE_PATTERN,
    OTHER_CHARACTERS_PATTERN,
    SCALE_WORDS,
    SPACES_PATTERN,
    TENS_WORDS,
    UNIT_WORDS,
    URL_PATTERN,
)

WHITESPACE = " \t\n\x0b\f\r"


def remove_stopwords(c: Column, words: Sequence[str]) -> Column:
    """Drop space-separated pieces that equal a stop word.

    For very long lists :func:`gullwatch.operators.features.drop_stopwords` joins instead.
    """
    if not words:
        return c
    stop = F.array(*[F.lit(w) for w in words])
    # rtrim first: trailing empty pieces do not count, interior ones do
    pieces = F.split(F.rtrim(c), " ")
    return F.array_join(F.filter(pieces, lambda w: ~F.array_contains(stop, w)), " ")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(URL_PATTERN), F.lit(""))


def strip_escapes(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(ESCAPE_PATTERN), F.lit(""))


def spell_points(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(" point "))


def spell_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" hyphen "))


def keep_letters(c: Column) -> Column:
    """Only whitespace, a-z and the caret stay."""
    return F.regexp_replace(c, F.lit(OTHER_CHARACTERS_PATTERN + "+"), F.lit(""))


def squeeze_spaces(c: Column) -> Column:
    """Whitespace runs to one space, trimmed. Single plain spaces need no rewriting, so
    the pattern skips them, with the same result as replacing every run."""
    return F.trim(F.regexp_replace(c, F.lit(SPACES_PATTERN), F.lit(" ")))


def _below_thousand(n: Column) -> Column:
    """Words of 1..999; null parts are skipped by ``concat_ws``."""
    units = F.array(*[F.lit(w) for w in UNIT_WORDS])
    tens = F.array(*[F.lit(w) for w in TENS_WORDS])
    hundreds, rest = F.floor(n / 100).cast("int"), n % 100
    return F.concat_ws(
        " ",
        F.when(hundreds > 0, F.concat(F.get(units, hundreds), F.lit(" hundred"))),
        F.when(rest >= 20, F.get(tens, F.floor(rest / 10).cast("int"))),
        F.when((rest >= 20) & (rest % 10 > 0), F.get(units, rest % 10)),
        F.when((rest > 0) & (rest < 20), F.get(units, rest)),
    )


def _spell_group(digits: Column) -> Column:
    """Words of twelve digits, three at a time with their scale words; empty for zero."""
    parts = []
    for i, scale in enumerate(SCALE_WORDS):
        n = F.substring(digits, 3 * i + 1, 3).cast("int")
        words = _below_thousand(n)
        parts.append(F.when(n > 0, F.concat(words, F.lit(f" {scale}")) if scale else words))
    return F.concat_ws(" ", *parts)


def _spell_run(run: Column) -> Column:
    significant = F.ltrim(run, F.lit("0"))
    count = F.ceil(F.length(significant) / 12).cast("int")
    padded = F.lpad(significant, count * 12, F.lit("0"))

    def group(i: Column) -> Column:
        words = _spell_group(F.substring(padded, i * 12 + 1, F.lit(12)))
        scale = F.repeat(F.lit(" trillion"), count - 1 - i)
        return F.when(words != "", F.concat(words, scale))

    groups = F.transform(F.sequence(F.lit(0), count - 1), group)
    return (
        F.when(~run.rlike("^[0-9]"), run)
        .when(significant == "", F.lit(UNIT_WORDS[0] + " "))
        .otherwise(F.concat(F.array_join(groups, " "), F.lit(" ")))
    )


def numbers_to_words(c: Column) -> Column:
    """Each run of digits becomes English words and a space, left to right.

    Twelve digits at a time, of which all but the last twelve are counted in trillions, those
    before them in trillions of trillions and so on: one rule for any length.
    """
    runs = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, _spell_run), "")


def normalised(c: Column, numbers: bool = True, stopwords: Sequence[str] = ()) -> Column:
    """Whole chain. ``numbers=False`` keeps digits and all other characters.

    Every step names its input once: nested expressions are not always shared (filters,
    lambdas), and a step naming it twice would double the work of all steps before it.
    """
    c = strip_urls(remove_stopwords(F.lower(c), stopwords))
    if numbers:
        c = numbers_to_words(c)
    c = spell_hyphens(spell_points(strip_escapes(c)))
    return squeeze_spaces(keep_letters(c) if numbers else c)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a generator.

    The optimizer copies a projected expression into every predicate pushed below it; a
    keyword filter would repeat the whole text chain once per keyword. It does not push
    through a generator.
    """
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def normalise(
    df: DataFrame,
    source: str = "tweet",
    target: str = "processedTweet",
    numbers: bool = True,
    stopwords: Sequence[str] = (),
) -> DataFrame:
    return computed_once(df, target, normalised(F.col(source), numbers, stopwords))


def clean_for_signature(c: Column, stopwords: Sequence[str] = ()) -> Column:
    """Listing clean-up order: no lower-casing, no number words, stop words last."""
    c = strip_escapes(strip_urls(c))
    c = F.replace(F.replace(c, F.lit(".")), F.lit("-"))
    return remove_stopwords(squeeze_spaces(keep_letters(c)), stopwords)


def tokenise(c: Column) -> Column:
    """Lower-cased pieces between single whitespace characters; interior empties stay."""
    return F.split(F.rtrim(F.lower(c), F.lit(WHITESPACE)), r"\s")


def token_signature(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.rtrim(c), " ")), " ")


def signature_line(line: Column) -> Column:
    """``date<TAB>id<TAB>sorted tokens<TAB>original line`` for one listing line."""
    fields = F.split(line, "\t")
    return F.concat_ws(
        "\t", F.get(fields, 0), F.get(fields, 1), token_signature(F.get(fields, 2)), line
    )


def keyword_score(c: Column, terms: Sequence[str] = tuple(ATTACK_TERMS)) -> Column:
    """+1.0 if any term occurs as a substring, else -1.0."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | c.contains(term.lower())
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(-1.0))
