"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space at which Python's str.split() cuts, as a Java character class.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
WORD = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
#: Separator of joined token lists; no token holds it.
MARK = "\x01"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """White-space tokens (F5); empty text has none."""
    return F.array_remove(F.split(_c(text), f"{SPACE}+"), "")


def n_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("bigint")


def has_words(text: Column | str) -> Column:
    """Whether words() has any; null for null. Looks no further than the first."""
    return _c(text).rlike(f"[^{SPACE[1:]}")


def squeeze(text: Column | str) -> Column:
    return F.array_join(words(text), " ")


def regex_tokens(text: Column | str, uncased: bool = False) -> Column:
    """Runs of letters, digits and marks, or single other visible characters."""
    t = F.regexp_extract_all(_c(text), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(t, F.lower) if uncased else t


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda would compute it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int, keep=None) -> Column:
    """All runs of 1 to n tokens joined by a blank (F8); keep filters them. A run looks up its own tokens only."""

    def runs(t: Column, k: int) -> Column:
        one = lambda x, i: F.concat_ws(" ", x, *(F.get(t, i + j) for j in range(1, k)))
        full = F.transform(t, lambda x, i: F.when(i + k <= F.size(t), one(x, i)))
        return F.filter(full, lambda x: x.isNotNull()) if k > 1 else t

    out = bound(tokens, lambda t: F.concat(*(runs(t, k) for k in range(1, n + 1))))
    return F.filter(out, keep) if keep else out


# Control characters that go, those that become a blank, and characters with what they become.
CONTROLS = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
SOFT_HYPHEN = "\u00ad"
BLANKS = "\u000b\u000c\u0085"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043"
MINUSES = "\u2212\uff0d\u207b"
SLASHES = "\u2044\u2215"
APOSTROPHES = "\u2019\u055a\ua78b\ua78c\uff07"
SINGLE_QUOTES = "\u2018\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
ACCENTS = "\u0060\u00b4"
PRIMES = {"\u2032": "'", "\u2035": "'", "\u2033": "''", "\u2036": "''", "\u2034": "'''", "\u2037": "'''", "\u2057": "''''"}
ELLIPSES = {"\u2026": "...", " . . . ": " ... "}


def normalize_unicode(text: Column | str) -> Column:
    """Typographic variants to ASCII, control characters away (F1). Other characters stay as they are."""
    pairs = ((BLANKS, " "), (HYPHENS + MINUSES, "-"), (DOUBLE_QUOTES, '"'), (SINGLE_QUOTES + APOSTROPHES + ACCENTS, "'"), (SLASHES, "/"))
    before = "".join(a for a, _ in pairs)
    t = F.translate(_c(text), before + CONTROLS + SOFT_HYPHEN, "".join(b * len(a) for a, b in pairs))
    for a, b in (PRIMES | ELLIPSES).items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _decomposed(x):
    import unicodedata

    return None if x is None else unicodedata.normalize("NFD", x)


def nfd(text: Column | str) -> Column:
    """Canonical decomposition (F14). Only texts with characters beyond ASCII go through Python."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decomposed(x: pd.Series) -> pd.Series:
        return x.map(_decomposed)

    t = _c(text)
    return F.coalesce(decomposed(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t)


def nfd_each(texts: Column | str) -> Column:
    """nfd of every element of an array."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def decomposed(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else [_decomposed(t) for t in a])

    t = _c(texts)
    return F.coalesce(decomposed(F.when(F.exists(t, lambda x: x.rlike(r"[^\x00-\x7f]")), t)), t)


def utf8(text: Column | str) -> Column:
    """Text without the bytes that are no UTF-8 (F17); replacement characters that the text has itself stay."""
    t, kept = _c(text), F.lit("\x01\x02")
    cut = F.replace(F.make_valid_utf8(F.replace(t, F.lit("\ufffd"), kept)), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(t), t).otherwise(F.replace(cut, kept, F.lit("\ufffd")))


def clean_passage(text: Column | str) -> Column:
    """Line breaks to blanks, curly apostrophe to straight, one outer quote off each end (F2)."""
    t = F.translate(_c(text), "\n’", " '")
    return F.regexp_replace(F.regexp_replace(t, '^"', ""), '"$', "")


def normalize_answer(text: Column | str) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    t = F.translate(F.lower(_c(text)), PUNCTUATION, "")
    return squeeze(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def bm25_tokens(text: Column | str) -> Column:
    """ASCII punctuation but the backslash to blanks, lower case, white-space tokens."""
    kept = PUNCTUATION.replace("\\", "")
    return words(F.lower(F.translate(_c(text), kept, " " * len(kept))))


def title_of(text: Column | str, source: Column | str | None = None, most: int = 64, first_line=("Wikipedia", "Pile-CC", "OpenWebText2")) -> Column:
    """First non-empty line, or for other sources the first line of over three words; cut to most words.
    The line is found by one match; only it is squeezed."""
    plain, longer = _line(text, 1), _line(text, 4)
    picked = longer if source is None else F.when(_c(source).isin(*first_line), plain).otherwise(longer)
    return F.array_join(F.slice(words(picked), 1, most), " ")


#: White space within a line, and what is no white space.
_GAP, _INK = r"[\s\p{Z}\x1c-\x1f\x85&&[^\n]]", r"[^\s\p{Z}\x1c-\x1f\x85]"


def _line(text: Column | str, least: int) -> Column:
    """The first line of at least so many words, null where there is none."""
    found = F.regexp_extract(_c(text), rf"(?:^|\n)({_GAP}*+{_INK}++" + rf"(?:{_GAP}++{_INK}++){{{least - 1}}}" + r"[^\n]*+)", 1)
    return F.when(found != "", found)


#: Headings that a paper's or patent's text opens with.
HEADERS = ("abstract", "introduction", "background", "1. Field of the Invention")


def title_v2(text: Column | str, least_chars: int = 16, most: int = 64) -> Column:
    """Like title_of, past leading headings; a short title falls back to the first half of the text's words, at most `most`."""
    t = F.regexp_replace(_c(text), r"(?i)^\s*(" + "|".join(h.replace(".", r"\.") for h in HEADERS) + r")\s*[:.]?\s*", "")
    title = F.coalesce(title_of(t, F.lit("Wikipedia"), most), F.lit(""))
    w = words(t)
    half = F.array_join(F.slice(w, F.lit(1), F.least(F.lit(most), F.greatest(F.lit(1), (F.size(w) / 2).cast("int")))), " ")
    return F.when(F.length(title) >= least_chars, title).otherwise(half)


#: Sections after which an encyclopedia article has no prose.
STOP_SECTIONS = ("See also", "Notes", "References", "Further reading", "External links")


def wiki_sections(text: Column | str, header_chars: int = 30) -> Column:
    """Blank-line blocks up to the first stop section, each with its header if its first line ends within header_chars."""
    blocks = F.split(_c(text), "\n\n")
    is_stop = lambda b: F.trim(F.substring_index(b, "\n", 1)).isin(*STOP_SECTIONS)
    stop = F.array_position(F.transform(blocks, lambda b: F.when(is_stop(b), 1).otherwise(0)), 1)
    kept = F.when(stop > 0, F.slice(blocks, F.lit(1), (stop - 1).cast("int"))).otherwise(blocks)
    at = lambda b: F.locate("\n", b)

    def section(b):
        has = (at(b) > 0) & (at(b) <= header_chars)
        return F.struct(F.when(has, F.substring_index(b, "\n", 1)).alias("header"), F.when(has, b.substr(at(b) + 1, F.length(b))).otherwise(b).alias("body"))

    return F.transform(F.filter(kept, lambda b: F.trim(b) != ""), section)


def contains_tokens(text: Column | str, answer: Column | str) -> Column:
    """Whether the answer's tokens are a contiguous run of the text's, uncased; an answer of no tokens always is,
    a null text never (F14, string mode). Callers decompose both before."""
    joined = lambda x: F.concat(F.lit(MARK), F.array_join(regex_tokens(x, True), MARK), F.lit(MARK))
    none = F.size(regex_tokens(answer)) == 0
    return F.coalesce(none | F.contains(joined(text), joined(answer)), F.lit(False))


def clean_phrase(phrase: Column | str) -> Column:
    """Before the first pipe, without outer brackets."""
    return F.regexp_replace(F.substring_index(_c(phrase), "|", 1), r"^[\[\]]+|[\[\]]+$", "")


def id_suffix(key: Column | str) -> Column:
    return F.substring_index(_c(key), "-", -1)


def titled(title: Column | str, text: Column | str, sep: str = " ", strip: bool = False) -> Column:
    """Title and text with a separator, text alone where there is no title."""
    out = F.when(F.coalesce(F.length(_c(title)), F.lit(0)) > 0, F.concat_ws(sep, _c(title), _c(text))).otherwise(_c(text))
    return F.trim(out) if strip else out


def prefixed(prefix: str, text: Column | str) -> Column:
    """A prompt in front."""
    return F.concat(F.lit(prefix), _c(text))


def source_of(url: Column | str, pile: Column | str) -> Column:
    """Wikipedia by url, else the subset's name with Wikipedia variants unified, else null (P5)."""
    return F.when(F.contains(_c(url), F.lit("wikipedia")), "Wikipedia").when(F.lower(_c(pile)).startswith("wikipedia"), "Wikipedia").otherwise(_c(pile))


def dedup_key(text: Column | str, lines: int = 3, chars: int = 200) -> Column:
    """First non-empty stripped lines joined by "!" and cut."""
    kept = F.filter(F.transform(F.split(_c(text), "\n"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")
    return F.substring(F.array_join(F.slice(kept, 1, lines), "!"), 1, chars)
