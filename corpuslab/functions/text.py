"""Column expressions over text. All run on the JVM, in batch and on streams alike."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def effective_text(translation: Column, source_text: Column) -> Column:
    """The translation, or else the source text; null if both are blank."""
    return F.coalesce(F.nullif(F.trim(translation), F.lit("")), F.nullif(F.trim(source_text), F.lit("")))


def anonymous_id(key: Column, salt: str) -> Column:
    return F.concat(F.lit("PASSAGE_"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), key.cast("string")), 256), 1, 10))


def drop_lines(text: Column, starts: Sequence[str]) -> Column:
    """The text without lines that begin so (case and space aside), trimmed."""
    keep = lambda line: ~reduce(lambda a, b: a | b, [F.startswith(F.lower(F.trim(line)), F.lit(s)) for s in starts])
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), keep), "\n"))


def matching(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that the text matches, case aside, in order."""
    hits = F.array(*[F.when(text.rlike(f"(?iu){p}"), F.lit(p)) for p in patterns])
    return F.filter(hits, lambda p: p.isNotNull())


def containing(text: Column, terms: Sequence[str]) -> Column:
    """The terms that are substrings of the lower-case text, in order."""
    # within the inner lambda the lower-case text is a variable, not an expression for each term
    return F.transform(F.array(F.lower(text)), lambda low: F.filter(literals(terms), lambda t: F.contains(low, t)))[0]


def alternation(terms: Sequence[str], bounded: bool = True) -> str:
    """One pattern for all terms, the longest first."""
    inner = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
    return rf"\b({inner})\b" if bounded else f"({inner})"


def mask(text: Column, terms: Sequence[str], replacement: str = "[MASKED]", bounded: bool = True) -> Column:
    return F.regexp_replace(text, f"(?iu){alternation(terms, bounded)}", replacement)


def mask_edits(text: Column, terms: Sequence[str]) -> Column:
    """What mask() replaces, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?iu){alternation(terms)}"), F.lit(1))


def neutralize(text: Column, mapping: dict[str, str]) -> Column:
    """Each term by its neutral words, the longest first; a capitalised term gives capitalised words."""
    for term in sorted(mapping, key=lambda t: (-len(t), t)):
        new = mapping[term]
        text = F.regexp_replace(text, rf"\b{term.capitalize()}\b", new.capitalize())
        text = F.regexp_replace(text, rf"(?iu)\b{term}\b", new)
    return text


def mentions(text: Column, term: str) -> Column:
    """How often the lower-case text has the term as a substring."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def enclosing_sentence(text: Column, match: Column) -> Column:
    """What stands between the full stops around the first place of match."""
    at = F.position(match, text)
    before = F.substring(text, F.lit(1), at - 1)
    return F.trim(F.concat(F.substring_index(before, ".", -1), F.substring_index(F.substring(text, at, F.length(text)), ".", 1)))


def html_to_text(html: Column) -> Column:
    """Without scripts, styles and tags; common entities decoded, the ampersand last; white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))
