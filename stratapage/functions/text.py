"""Scalar expressions over text, as macro texts: each takes SQL expressions and gives one."""

from __future__ import annotations


def clip01(x: str) -> str:
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST({x} AS DOUBLE)))"


def ratio(a: str, b: str) -> str:
    """Smaller over larger magnitude; 1 where both are about zero."""
    return f"CASE WHEN abs({a}) < 1e-9 AND abs({b}) < 1e-9 THEN 1.0 ELSE least(abs({a}), abs({b})) / greatest(abs({a}), abs({b}), 1e-12) END"


def collapse(x: str) -> str:
    """White space as single spaces, none at the ends."""
    return f"trim(@replace({x}, '[\\s\\x{{00A0}}]+', ' '))"


def share(x: str, pattern: str) -> str:
    """Share of the characters that a negated class leaves."""
    return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE CAST(length(@replace({x}, '{pattern}', '')) AS DOUBLE) / length({x}) END"


DIGITS, UPPER, SPACE = "[^\\p{Nd}]", "[^\\p{Lu}]", "[^\\s]"
#: What is left is neither a letter, a digit nor white space.
PUNCTUATION = "[\\p{L}\\p{N}\\s]"


def tokens(x: str) -> str:
    return f"@extract_all({x}, '[\\p{{L}}\\p{{N}}''-]+')".replace("''", "\\x27")


def first_class(x: str) -> str:
    """E, D, U, L or P by the first character that isn't blank."""
    c = f"substr(@replace({x}, '^\\s+', ''), 1, 1)"
    return f"CASE WHEN {c} = '' THEN 'E' WHEN @like({c}, '^\\p{{Nd}}') THEN 'D' WHEN @like({c}, '^\\p{{Lu}}') THEN 'U' WHEN @like({c}, '^\\p{{L}}') THEN 'L' ELSE 'P' END"


def opener_class(x: str) -> str:
    """D, A or P by the first glyph; empty text is P."""
    c = f"substr(@replace({x}, '^\\s+', ''), 1, 1)"
    return f"CASE WHEN @like({c}, '^\\p{{Nd}}') THEN 'D' WHEN @like({c}, '^\\p{{L}}') THEN 'A' ELSE 'P' END"


_CLOSERS = "[)\\]\"\\x27\\x{201D}\\x{2019}\\s]+$"


def terminal(x: str) -> str:
    return f"@like(@replace({x}, '{_CLOSERS}', ''), '[.!?:;]$')"


def open_ended(x: str) -> str:
    return f"@like({x}, '[(\\[{{\"\\x27\\x{{201C}}\\x{{2018}},-]\\s*$')"


def first_letter(x: str) -> str:
    return f"@extract({x}, '\\p{{L}}')"


def lower_start(x: str) -> str:
    return f"@like({first_letter(x)}, '^\\p{{Ll}}')"


def upper_start(x: str) -> str:
    return f"@like({first_letter(x)}, '^\\p{{Lu}}')"


def marker_depth(x: str) -> str:
    return f"length(@extract({x}, '^\\s*(#{{1,6}})[ \\t]', 1))"


BULLETS = "[\\x{2022}\\x{00B7}\\x{2219}\\x{25CF}\\x{25E6}\\x{25AA}\\x{25B8}]"


def slug(x: str) -> str:
    """A file name as an identifier."""
    bare = f"lower(@replace(@replace({x}, '[^\\p{{L}}\\p{{N}}]+', '_'), '^_+|_+$', ''))"
    return f"CASE WHEN {bare} = '' THEN 'document' ELSE {bare} END"


def cells(x: str) -> str:
    """The cells of a line of a pipe grid."""
    return f"@map(@split(@replace(trim({x}), '^\\||\\|$', ''), '|'), c, {strip_markup('c')})"


#: The tags that are markup wherever they stand; another name in angle brackets is a placeholder of the text.
TAGS = ("a", "b", "br", "div", "em", "i", "li", "ol", "p", "span", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tr", "u", "ul")
_BLANK = "[\\s\\x{00A0}]"
_TO_END = "[^>]*"


def _tag() -> str:
    """What stands between the brackets of a tag: nothing, a declaration, a nameless end, a known name, or a name of letters with attributes."""
    known = f"(?i:{'|'.join(TAGS)})(?:/[^>\\s\\x{{00A0}}=]*)?{_BLANK}*"
    solid = f"{_TO_END}[^>\\s\\x{{00A0}}]{_BLANK}*"
    given = f"\\p{{L}}+(?:={_TO_END}|(?:{_BLANK}|/){_TO_END}={_TO_END}|{_BLANK}{solid}|/{_TO_END}{_BLANK}{solid})"
    named = f"={_TO_END}|{known}|{given}|/{_BLANK}*(?:[=/]{_TO_END}|{known}|{given})"
    return f"{_BLANK}*(?:[!?]{_TO_END}|/?{_BLANK}*|{named})"


def strip_markup(x: str) -> str:
    """Line breaks as spaces, emphasis marks and tags gone; other angle brackets, and what they hold, stay.

    A bracket reaches to the next closing one, so what a placeholder holds is not looked into.
    """
    breaks = f"@replace({x}, '<br>|<br/>|<br />', ' ')"
    marks = f"@replace(@replace({breaks}, '\\*\\*', ''), '__', '')"
    tags = f"@kept({marks}, '(<(?:{_tag()})>)|(<[^>]*>)')"
    return collapse(tags)


def bullet_parts(x: str) -> str:
    """The parts of a text between bullets, none empty; one part is the text itself."""
    parts = f"@keep(@map(@split_at({x}, '{BULLETS}'), q, {collapse('q')}), q, q <> '')"
    return f"CASE WHEN @size({parts}) <= 1 THEN @list({x}) ELSE {parts} END"
