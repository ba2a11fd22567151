"""Column functions on text.  All are built-in expressions except where Unicode normalisation is needed."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: patterns of the text classes
WORD = r"[\p{L}]{2,}"
LETTER = r"\p{L}"
URL = r"(?i)(https?://|www\.|@)"
URL_SUFFIX = r"\.(com|nl|org|net|io|de|fr|co|eu)\b"
PRICE = r"^[€$£]?\s*[-+]?\s*[0-9][0-9.,]*\s*[A-Z]?$"
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"
TOKEN = r"[\p{L}\p{N}]+"
MIN_LETTERS = 4


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def eligible(text: Column) -> Column:
    """Prose enough to be translated: no URL or address, four letters or more in words of two or more."""
    t = stripped(text)
    letters = F.length(F.array_join(all_of(t, WORD), ""))
    return (t != "") & ~t.rlike(URL) & (letters >= MIN_LETTERS)


def normalised(text: Column) -> Column:
    """Words of two letters or more, lower-cased, joined by single spaces."""
    return F.array_join(all_of(F.lower(F.coalesce(text, F.lit(""))), WORD), " ")


def text_identity(text: Column) -> Column:
    """128 bits of the normalised text where it is ``eligible``, else null; its words are sought once."""
    low = all_of(F.lower(F.coalesce(text, F.lit(""))), WORD)

    def identity(words: Column) -> Column:
        joined = F.array_join(words, " ")
        # lower case has as many letters but for one letter
        prose = F.when(text.contains("İ"), eligible(text)).otherwise(~text.rlike(URL) & (F.length(joined) - F.size(words) + 1 >= MIN_LETTERS))
        return F.when(prose & (F.size(words) > 0), F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit(1), joined).alias("b")))

    return F.transform(F.array(low), identity)[0]


def nontranslatable(text: Column) -> Column:
    t = stripped(text)
    low = F.lower(t)
    return (t == "") | low.contains("://") | low.startswith("www.") | low.rlike(URL_SUFFIX) | t.rlike(PRICE) | ~t.rlike(LETTER)


def symbolic_label(text: Column) -> Column:
    t = stripped(text)
    return (t == "") | (~t.rlike(r"[一-鿿぀-ヿ가-힯]") & ~t.rlike(r"\p{Ll}") & ~t.rlike(r"\p{L}{2}"))


def noise(text: Column) -> Column:
    t = stripped(text)
    return (F.length(t) <= 2) & t.rlike(r"^[\x00-\x7F]*$")


#: fixed value: separators within a number, which group digits
GROUPING = r"(?<=[0-9])(?:[.,](?=[0-9])|(?<![0-9]{4})[.,]?[\u00a0\u2009 ](?=[0-9]{3}(?![0-9])))"


def signatures(text: Column) -> Column:
    """Digit signatures of ASCII digits in reading order: grouping separators dropped, runs of two digits
    or more, leading zeros dropped, two digits or more kept."""
    t = F.regexp_replace(text, GROUPING, "")
    return F.filter(F.transform(all_of(t, "[0-9]{2,}"), lambda x: F.ltrim(x, F.lit("0"))), lambda x: F.length(x) >= 2)


_CONFUSED = {"o": "0", "O": "0", "l": "1", "I": "1"}
_THROUGH = set(".,\u00a0\u2009")


def fold_confusions(text: str) -> str:
    """Letters that OCR mistakes for digits become digits where they touch one, through separators; a
    letter that has become a digit counts for its neighbours."""
    out = []
    for part in unicodedata.normalize("NFKC", text).split(" "):
        if any(c.isdigit() for c in part) and any(c in _CONFUSED for c in part):
            part = _spread(part)
        out.append(part)
    return " ".join(out)


def _spread(token: str) -> str:
    chars = list(token)
    solid = [i for i, c in enumerate(chars) if c not in _THROUGH and not c.isspace()]
    blocks = "".join(" " if c.isspace() else "x" for c in chars)
    todo = [k for k, i in enumerate(solid) if chars[i].isdigit()]
    while todo:  # from every digit outwards
        k = todo.pop()
        for j in (k - 1, k + 1):
            if 0 <= j < len(solid) and chars[solid[j]] in _CONFUSED and " " not in blocks[min(solid[j], solid[k]) : max(solid[j], solid[k])]:
                chars[solid[j]] = _CONFUSED[chars[solid[j]]]
                todo.append(j)
    return "".join(chars)


@F.pandas_udf(StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and confusion folding, for texts that need either."""
    for s in texts:
        yield s.map(lambda t: None if t is None else fold_confusions(t))


def full_signatures(text: Column) -> Column:
    """Signatures of any text: only what isn't plain goes through Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$") & ~text.rlike("[oOlI][.,]*[0-9]|[0-9][.,]*[oOlI]")
    return signatures(F.when(plain, text).otherwise(folded(text)))


def volume_units(text: Column) -> Column:
    """CJK characters, and word tokens of the rest."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(CJK)) + F.regexp_count(F.regexp_replace(t, CJK, " "), F.lit(TOKEN))




@F.pandas_udf(StringType())
def bare(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case without combining marks."""
    for s in texts:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def bare_text(text: Column) -> Column:
    """As ``bare``; ASCII stays in the JVM, and only other text is sent to Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(text)).otherwise(bare(F.when(~plain, text)))


def token_list(spelt: Column) -> Column:
    """Tokens of text that is spelt already: runs of a-z and digits, and single CJK characters."""
    return F.concat(all_of(spelt, "[a-z0-9]+"), all_of(spelt, "[぀-ヿ㐀-䶿一-鿿豈-﫿가-힣]"))


def spelt(text: Column) -> Column:
    """Lower case without marks, ligatures spelt out; ASCII stays in the JVM."""
    t = bare_text(text)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ß", "ss"), ("þ", "th"), ("ð", "d")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def match_tokens(text: Column) -> Column:
    """Runs of a-z and digits, and single CJK characters, ligatures spelt out; ASCII stays in the JVM."""
    return token_list(spelt(text))


def fuzzy_tokens(text: Column) -> Column:
    return token_list(bare_text(text))


def field_key(text: Column) -> Column:
    return F.regexp_replace(bare_text(text), r"[^\p{L}\p{N}]", "")


def alnum_form(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def text_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(text)), r"\s+", " ")


def safe_token(value: Column, fallback: str = "item", longest: int = 120) -> Column:
    t = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), 1, longest)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def render_template(template: Column, variables: dict[str, Column]) -> Column:
    """{{key}} replaced for every key given; others stay."""
    for k, v in variables.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return template
