"""Text expressions: tokens, sentences, cleaning, keywords.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: digits with inner marks, underscores, letters with inner marks, in any succession.
WORD = r"(?:\p{N}+(?:[.,;'’]\p{N}+)*|_|\p{L}[\p{L}\p{M}]*(?:['’.:·]\p{L}[\p{L}\p{M}]*)*)+"
#: The same language with possessive loops, which never backtrack into a word.
_WORD_JVM = r"(?:[a-z\p{L}][a-z\p{L}\p{M}]*+(?:['’.:·][a-z\p{L}][a-z\p{L}\p{M}]*+)*+|_|\p{N}++(?:[.,;'’]\p{N}++)*+)++"
#: A sentence's end: marks, closing quotes, blanks, not before lower case after a full stop; or a line's end.
SENTENCE_END = r"""((?:[!?]+["'”’)\]»]*[ \t]*(?![!?.,;:\n])|\.+["'”’)\]»]*[ \t]+(?![!?.,;:\n])(?![^\p{L}\n.!?]*\p{Ll})|\n))(?=[\s\S])"""
COMMA = "c_c"


def tokens(text: Column) -> Column:
    """Lower-case words of a text; what ends in a digit is a number and no word.  Null gives null."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_WORD_JVM), F.lit(0)), lambda t: ~t.rlike(r"\p{N}$"))


def sentences(text: Column) -> Column:
    """The sentences of a text, as written."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\u0001"), "\u0001")


def sentence_tokens(text: Column) -> Column:
    """Tokens of each sentence, commas kept as the word ``c_c``; sentences without words are left out."""
    split = F.transform(sentences(text), lambda s: tokens(F.replace(s, F.lit(", "), F.lit(f" {COMMA} "))))
    return F.filter(split, lambda t: F.size(t) > 0)


def clean(text: Column) -> Column:
    """Deletes tags, double quotes, and all but letters, digits, hyphens, ampersands, full stops, commas and blanks."""
    for pattern in ("<.*?>", '["]', "[^-a-zA-Z0-9,&. ]"):
        text = F.regexp_replace(text, pattern, "")
    return text


def keyword_pattern(keywords: list[str] | str, regex: bool = False) -> str:
    """One pattern for a feature: a regular expression as given, or any of the words between word bounds."""
    if regex:
        if not isinstance(keywords, str):
            if len(keywords) != 1:
                raise ValueError("a regular expression is one pattern for each feature")
            keywords = keywords[0]
        return keywords
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    return "|".join(rf"\b{w}\b" for w in words)
