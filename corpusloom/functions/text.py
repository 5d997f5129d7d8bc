"""Text as column expressions: every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of characters that are not white space, by the
# Unicode property ((?U); plain ``\s`` is ASCII only) plus the four separators
# U+001C to U+001F. One negated class with a flag keeps the match loop fast.
WORD_PATTERN = r"(?U)[^\s\x{1c}-\x{1f}]+"

# Fixed value: a term is a run of two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Fixed value: years 2000-2029.
YEAR_PATTERN = "20[0-2][0-9]"

# Bracket escapes used by treebank-style tokenised text.
BRACKET_ESCAPES = (("-lrb-", "("), ("-rrb-", ")"))

# The usual 179 English stop words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def words(text: Column) -> Column:
    """White-space tokens, without the empty edge tokens ``split`` would leave."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def head(items: Column, n: int | None) -> Column:
    """First ``n`` array items; negative ``n`` drops items from the end, None keeps all."""
    if n is None:
        return items
    if n >= 0:
        return F.slice(items, 1, n)
    return F.slice(items, F.lit(1), F.greatest(F.size(items) + F.lit(n), F.lit(0)))


def first_words(text: Column, n: int | None = None) -> Column:
    """Text cut after its first ``n`` words, white space collapsed to single blanks."""
    return F.array_join(head(words(text), n), " ")


def join_segments(segments: Column, separator: str = " ") -> Column:
    return F.array_join(segments, separator)


def paragraphs(text: Column, pattern: str = r"\n{2,}") -> Column:
    """Segments of a text; by default blank lines separate them."""
    return F.split(text, pattern)


def clip_segments(segments: Column, max_segments: int = 64) -> Column:
    return F.slice(segments, 1, max_segments)


def long_document(
    segments: Column, separator: str = "[SEP]", max_segments: int = 64, max_words: int = 128
) -> Column:
    """One string from the first segments, each cut to its first words."""
    cut = F.transform(clip_segments(segments, max_segments), lambda s: first_words(s, max_words))
    return F.array_join(cut, f" {separator} ")


def unescape_brackets(text: Column) -> Column:
    for escape, bracket in BRACKET_ESCAPES:
        text = F.replace(text, F.lit(escape), F.lit(bracket))
    return text


def first_match(text: Column, pattern: str) -> Column:
    """First match of a pattern, null where there is none."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def file_stem(path: Column) -> Column:
    """Last path component up to its first dot."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))


def camel_identifier(name: Column) -> Column:
    """Runs outside a-z become word breaks, words are capitalised and joined."""
    return F.replace(F.initcap(F.regexp_replace(name, "[^a-z]+", " ")), F.lit(" "), F.lit(""))


def pair_text(context: Column, choice: Column) -> Column:
    return F.concat_ws(" ", context, choice)


def terms(text: Column) -> Column:
    """Lower-cased word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def without_stop_words(tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def only_members(items: Column, members: Sequence[str] | None) -> Column:
    """Items outside the member list become null, positions stay; None keeps all."""
    if members is None:
        return items
    return F.transform(items, lambda x: F.when(x.isin(*members), x))


def next_grams(shorter: Column, tokens: Column, n: int) -> Column:
    """Space-joined n-grams from the (n-1)-grams of the same tokens, by position.

    An n-gram is null where one of its two (n-1)-grams is. Linear in the number of
    tokens; empty when there are fewer than n.
    """
    count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    start = F.zip_with(
        F.slice(shorter, F.lit(1), count),
        F.slice(shorter, F.lit(2), count),
        lambda first, second: F.when(second.isNotNull(), first),
    )
    last = F.slice(tokens, F.lit(n), count)
    return F.zip_with(start, last, lambda gram, token: F.concat(gram, F.lit(" "), token))
