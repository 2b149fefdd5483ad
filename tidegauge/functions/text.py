"""Column functions on identifiers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_tradable(symbol: Column) -> Column:
    """Not empty, no ``- . ^ /``, and not five letters that end in W, U, R, Q or F."""
    plain = (F.length(symbol) > 0) & ~symbol.rlike(r"[-.^/]")
    derived = (F.length(symbol) == 5) & F.upper(F.right(symbol, F.lit(1))).isin("W", "U", "R", "Q", "F")
    return F.coalesce(plain & ~derived, F.lit(False))


def normal_cik(value: Column) -> Column:
    """Trimmed, upper case, without ``CIK`` and leading zeros; null unless digits remain."""
    bare = F.regexp_replace(F.upper(F.trim(value)), r"^CIK", "")
    digits = F.regexp_replace(bare, r"^0+(?=[0-9])", "")
    return F.when(digits.rlike(r"^[0-9]+$"), digits)


def cut_at_sentence(text: Column, limit: int) -> Column:
    """The text up to ``limit`` characters, cut after the last ``.``, ``!`` or ``?`` if that keeps half or more."""
    def cut(text: Column) -> Column:
        head = F.left(text, F.lit(limit))
        back = F.reverse(head)
        first = [F.when(F.locate(mark, back) > 0, F.locate(mark, back)) for mark in ".!?"]
        end = F.length(head) - F.least(*first) + 1
        return F.when(F.length(text) <= limit, text).when(end > limit / 2, F.left(head, end)).otherwise(head)

    return F.transform(F.array(text), cut)[0]  # the text is worked out once, however often the rule names it


def masked_numbers(text: Column) -> Column:
    """Each number becomes N."""
    return F.regexp_replace(text, r"[-+]?[0-9][0-9.,]*", "N")


def contains_any(text: Column, words: list[str]) -> Column:
    """Case-insensitive: any of ``words`` occurs; null for a null text."""
    low = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word.lower())
    return found


def clipped(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts end in an ellipsis within ``limit``."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 1))), F.lit("…")))


def escaped_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def neutral_tags(text: Column, tag: str) -> Column:
    """Opening and closing ``<tag>`` in untrusted text lose their angle brackets."""
    return F.regexp_replace(text, rf"(?i)<(/?\s*{tag}[^>]*)>", "[$1]")


def html_to_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles and comments; tags become spaces; white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def digest_id(*parts: Column, length: int = 12) -> Column:
    """First hexadecimal digits of the SHA-256 of the parts joined by ``|``."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(length))


def csv_field(value: Column) -> Column:
    """Quoted, with doubled quotes, if it holds a comma, a quote or a line break."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text), F.lit(""))


def signed_percent(value: Column) -> Column:
    """With its sign and one digit."""
    return F.concat(F.when(value >= 0, "+").otherwise("-"), F.format_string("%.1f", F.abs(value)), F.lit("%"))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.0f", F.abs(value)))


def interval_text(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "n/a").otherwise(F.format_string("[%.2f, %.2f]", low, high))


def translated(value: Column, phrases: dict[str, str], patterns: tuple[tuple[str, str], ...]) -> Column:
    """The phrase for the whole value, else all patterns replaced in turn."""
    whole = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])[value]
    rest = value
    for pattern, to in patterns:
        rest = F.regexp_replace(rest, pattern, to)
    return F.coalesce(whole, rest)


def json_number(doc: Column, path: str, low: float, high: float) -> Column:
    """The number at ``path`` if it is one (no boolean, text or NaN) and within ``low``..``high``; else null."""
    raw = F.get_json_object(doc, path)
    number = F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), raw.try_cast("double"))
    return F.when(number.between(low, high), number)
