"""Text expressions: white space, tokens, prices, escapes. All are columns; white space and digits are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency signs and codes, and the amounts beside them.
_SIGNS = "[€$£¥₽]"
_CODES = r"(?:\b(?:EUR|USD|GBP|RUB|PLN|CZK|SEK|NOK|DKK|UAH|KZT|TRY|руб\.?)\b)"
_AMOUNT = r"\d{1,3}(?:[\s .,]\d{3})*(?:[.,]\d{1,2})?"
PRICE = rf"(?iuU)(?:{_AMOUNT}\s*(?:{_SIGNS}|{_CODES}))|(?:(?:{_SIGNS}|{_CODES})\s*{_AMOUNT})"
#: Words of engagement counters.
ENGAGEMENT = r"(?iuU)\b(?:like|likes|comment|comments|share|shares|retweet|reply|replies|follow|followers|views|votes|subscribe|подпис|лайк|коммент|репост|просмотр)\b"


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends; '' for NULL."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """One token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def has_price(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(PRICE)


def count_prices(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PRICE))


def round1(value: Column) -> Column:
    """A non-negative double to one decimal: to the nearest of its exact binary value, to the even one of two equally near."""
    m = F.round(value * 20).cast("long")
    # Only odd twentieths lie between two tenths; by how much the value is off one is exact in halves of it.
    off = (value * 16 - m) + value * 4
    up = (off > 0) | ((off == 0) & (F.pmod((m + 1) / 2, F.lit(2)) == 0))
    between = (F.pmod(m, F.lit(2)) == 1) & (F.abs(value * 20 - m) < 1e-9)
    return F.when(between, F.when(up, m + 1).otherwise(m - 1) / 20).otherwise(F.round(value, 1))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def xml_escape(text: Column) -> Column:
    """For attribute values in double quotes."""
    out = F.coalesce(text, F.lit(""))
    for raw, escaped in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def xml_element(name: str, attributes: dict[str, Column], inner: Column | None = None) -> Column:
    """<name a="…"/> or <name a="…">inner</name>; attributes that are NULL are left out."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), F.when(v.isNotNull(), xml_escape(v)), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    head = F.concat(F.lit(f"<{name}"), *parts)
    return F.concat(head, F.lit("/>")) if inner is None else F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>"))


def truncate_at_sentence(text: Column, most: Column) -> Column:
    """`text` cut to `most` characters: after the last `! `, else `? `, else `. ` beyond the middle, else at the last space beyond it."""
    cut = F.substring(text, F.lit(1), most)
    half = F.floor(most / 2)
    out = cut

    def last(mark: str) -> Column:  # 0-based place of the last mark, -1 if there is none
        back = F.instr(F.reverse(cut), mark[::-1])
        return F.when(back > 0, F.length(cut) - back - len(mark) + 1).otherwise(F.lit(-1))

    out = F.when(last(" ") > half, F.substring(cut, F.lit(1), last(" "))).otherwise(cut)
    for mark in (". ", "? ", "! "):
        out = F.when(last(mark) > half, F.substring(cut, F.lit(1), last(mark) + 1)).otherwise(out)
    return F.when(most <= 0, F.lit("")).when(F.length(text) <= most, text).otherwise(out)
