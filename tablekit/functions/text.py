"""Text expressions: cleaning, tokens, stop words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import SPACE, col, strip

# English stop words, fixed values: results of word counts depend on this exact list.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before "
    "being below between both but by can't cannot could couldn't did didn't do does doesn't doing "
    "don't down during each few for from further had hadn't has hasn't have haven't having he he'd "
    "he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in "
    "into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shan't she she'd she'll she's "
    "should shouldn't so some such than that that's the their theirs them themselves then there "
    "there's these they they'd they'll they're they've this those through to too under until up "
    "very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's "
    "which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've "
    "your yours yourself yourselves"
).split()


def _squeezed(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def words(c: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    text = strip(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"[{SPACE}]+"))


def word_count(c: Column) -> Column:
    """Number of the same words."""
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def remove_stopwords(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~stop_word(F.lower(w))), " ")


# Python's \w and \b are Unicode-aware, so the classes are spelled out.
_WORD = r"\p{L}\p{N}_"


def remove_urls(c: Column) -> Column:
    return _squeezed(F.regexp_replace(c, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", " "))


def remove_emails(c: Column) -> Column:
    # starts and ends on a word character, which is what \b asks for at both ends
    address = rf"[{_WORD}][{_WORD}.+-]*@[{_WORD}-]+\.[{_WORD}.-]*[{_WORD}]"
    return _squeezed(F.regexp_replace(c, address, " "))


def remove_punctuation(c: Column) -> Column:
    return _squeezed(F.regexp_replace(c, rf"[^{_WORD}{SPACE}]", " "))


def remove_numbers(c: Column) -> Column:
    return _squeezed(F.regexp_replace(c, rf"(?<![{_WORD}])\p{{Nd}}+(?![{_WORD}])", " "))


TEXT_STEPS = {
    "strip": strip,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "stopwords": remove_stopwords,
    "urls": remove_urls,
    "emails": remove_emails,
    "punctuation": remove_punctuation,
    "numbers": remove_numbers,
}


def edit_text(df: DataFrame, cols: Sequence[str], *steps: str) -> DataFrame:
    """Apply text steps by name to the columns, in one projection."""

    def edited(c: str) -> Column:
        out = col(c).cast("string")
        for s in steps:
            out = TEXT_STEPS[s](out)
        return out.alias(c)

    return df.select(*[edited(c) if c in cols else col(c) for c in df.columns])


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and apostrophes, longer than one character."""
    return F.filter(
        F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1)), lambda w: F.length(w) > 1
    )


def word_frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of the non-stop words of a column: ``word, count``."""
    counts = (
        df.select(F.explode(tokenize(col(column))).alias("word"))
        .filter(~stop_word(F.col("word")))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if top is None:
        return counts
    return counts.orderBy(F.col("count").desc(), "word").limit(top)
