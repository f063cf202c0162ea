"""Functions on what people write: ordinary words, words shaped like code, and the words of a request that may name a symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that every sentence about code has.
STOPWORDS = (
    "that this with from when then than them they there these those have does done into over only some same such were "
    "will what which while would should could after before about because returns return still just make made much more most "
    "less very also even never always again "
    "test tests error errors value values result results file files line lines call calls type types data code name names case "
    "cases item items list lists null none true false class method function field module package project symbol"
).split()


def is_noise_word(word: Column) -> Column:
    """Fewer than four bytes, or a word that says nothing."""
    low = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (F.octet_length(word) < 4) | low.isin(*STOPWORDS)


def looks_like_code(word: Column) -> Column:
    """Whether a word holds a separator, an underscore inside, or a capital after its first sign; a leading capital alone says nothing."""
    return word.rlike(r"[./#]|::") | F.btrim(word, F.lit("_")).contains("_") | word.rlike(r"(?s)^.+\p{Lu}")


def targets(text: Column) -> Column:
    """The different words of a text that may name a symbol, in order of code points: shaped like code, or plain but no noise.

    Words end at white space and ``, ; " ' ( )`` and lose ``. ? ! :`` at their end; those of two bytes or fewer go. ``a::b`` is offered as ``a#b`` too.
    """
    words = F.transform(F.split(text, r"""[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000},;"'()]"""), lambda w: F.rtrim(w, F.lit(".?!:")))
    kept = F.filter(words, lambda w: (F.octet_length(w) > 2) & (looks_like_code(w) | ~is_noise_word(w)))
    members = F.transform(F.filter(kept, lambda w: w.contains("::")), lambda w: F.regexp_replace(w, "^(.*)::", "$1#"))
    return F.array_sort(F.array_distinct(F.concat(kept, members)))
