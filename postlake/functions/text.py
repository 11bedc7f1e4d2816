"""Text expressions: blanks, entities, HTML to plain text, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.once import bind

# The blanks a browser's regular expressions call white space.
BLANK = (
    r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

#: No text without a match holds a blank to change; two ranges are told much faster than all blanks.
_PERHAPS = r"[\t-\r\x{a0}-\x{ffff}]|  "
#: What `html_text` changes beside spaces at the ends, and a fast test that misses none of it.
_UNCLEAN = f"[<&\\x00-\\x1f\\x7f]|  |(?! ){BLANK}"
_PERHAPS_UNCLEAN = r"[<&\x00-\x1f\x7f\x{a0}-\x{ffff}]|  "

# Named entities decoded in text.
NAMED_ENTITIES = {
    "amp": "&",
    "apos": "'",
    "gt": ">",
    "hellip": "…",
    "ldquo": "“",
    "lsquo": "‘",
    "lt": "<",
    "nbsp": " ",
    "quot": '"',
    "rdquo": "”",
    "rsquo": "’",
}

# Elements whose whole content is dropped, and void elements.
DROPPED_BLOCKS = (
    "script", "style", "form", "iframe", "object", "embed", "svg", "canvas", "video", "audio",
)

#: Stands for a decoded ampersand until decoding is over, so nothing is decoded twice.
_AMP_MARK = "\ue000"


def no_word(before: str = "") -> str:
    """Left edge of an ASCII word."""
    return r"(?<![A-Za-z0-9_])" + before


WORD_END = r"(?![A-Za-z0-9_])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks become one space; ends are stripped.

    A space between words is one already, and most blanks are such: they are not replaced by themselves.
    """
    one = lambda v: F.when(v.rlike(_PERHAPS), F.regexp_replace(v, f"{BLANK}{{2,}}|(?! ){BLANK}", " ")).otherwise(v)
    return F.trim(bind(c, one))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def _code_point(entity: Column) -> Column:
    body = F.regexp_extract(entity, r"^&#[xX]?0*([0-9a-fA-F]+);$", 1)
    is_hex = F.lower(F.substring(entity, 3, 1)) == "x"
    digits = F.when(is_hex, body)
    number = F.when(
        is_hex & (F.length(digits) <= 8), F.conv(digits, 16, 10).cast("long")
    ).when(~is_hex & (F.length(body) <= 10), body.try_cast("long"))
    return number


def _character(number: Column) -> Column:
    return F.when(number == 38, F.lit(_AMP_MARK)).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    )


def decode_entities(c: Column) -> Column:
    """One pass of entity decoding: what an entity stands for is not decoded again."""

    def named(v: Column) -> Column:
        out = v
        for name, text in NAMED_ENTITIES.items():
            if name != "amp":
                out = F.regexp_replace(out, f"(?i)&{name};", text)
        return out

    def numeric(v: Column) -> Column:
        found = F.array_distinct(
            F.regexp_extract_all(v, F.lit(r"(&#(?:[xX][0-9a-fA-F]+|[0-9]+);)"), F.lit(1))
        )
        return F.aggregate(
            found,
            named(v),
            lambda text, entity: bind(
                _code_point(entity),
                lambda n: F.when(n <= 0x10FFFF, F.replace(text, entity, _character(n))).otherwise(text),
            ),
        )

    def last(v: Column) -> Column:
        return F.translate(F.regexp_replace(v, "(?i)&amp;", _AMP_MARK), _AMP_MARK, "&")

    return bind(
        c,
        lambda v: F.when(v.contains("&#"), last(numeric(v))).when(v.contains("&"), last(named(v))).otherwise(v),
    )


def html_text(c: Column, limit: int | None = 1200) -> Column:
    """Visible text of an HTML fragment, cut at ``limit`` characters if one is given.

    Elements in ``DROPPED_BLOCKS`` go with their content, other tags become blanks.
    """
    blocks = "|".join(DROPPED_BLOCKS)

    def bare(v: Column) -> Column:
        out = F.regexp_replace(v, r"(?s)<!--.*?-->", " ")
        out = F.regexp_replace(out, rf"(?is)<({blocks})[^>]*>.*?</\1{BLANK}*>", " ")
        return F.regexp_replace(out, r"<[^>]+>", " ")

    def cleaned(v: Column) -> Column:
        out = bind(decode_entities(v), lambda d: F.when(d.contains("<"), bare(d)).otherwise(d))
        return squeeze(F.regexp_replace(decode_entities(out), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))

    # Texts without markup, entities and blanks to change are most of what stands in links and titles.
    out = bind(F.coalesce(c, F.lit("")), lambda v: F.when(v.rlike(_PERHAPS_UNCLEAN) & v.rlike(_UNCLEAN), cleaned(v)).otherwise(F.trim(v)))
    return out if limit is None else F.rtrim(F.substring(out, 1, limit))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, quoted or bare; blank if absent."""
    part = F.regexp_extract(
        tag, rf"(?i){no_word(name)}{BLANK}*=" + rf"""{BLANK}*("[^"]*"|'[^']*'|[^\s>]+)""", 1
    )
    return F.regexp_replace(part, r"""^(["'])(.*)\1$""", "$2")


def _normal_form(form: str):
    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return normal


def nfkc(c: Column) -> Column:
    """Compatibility composition."""
    return _beyond_ascii("NFKC", c)


def nfkd(c: Column) -> Column:
    """Compatibility decomposition."""
    return _beyond_ascii("NFKD", c)


def _beyond_ascii(form: str, c: Column) -> Column:
    """A normal form. Every row passes the Python node, but ASCII texts, which are their own
    normal form, pass it as NULL."""
    return F.coalesce(_normal_form(form)(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def words(c: Column) -> Column:
    """Lower-case ASCII words parted by single blanks; expects NFKD input."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def words_of(value: str) -> str:
    """``words(nfkd(.))`` of a constant."""
    text = unicodedata.normalize("NFKD", value or "").lower()
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text).split())
