"""NFKC and the comparison form in SQL, for twins of queries that need them; DuckDB has NFC only."""

from __future__ import annotations

import unicodedata

#: White space as Python sees it, as a class of RE2.
SPACES = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def translate(text: str, table: dict[str, str]) -> str:
    """translate() with what becomes one character first and what goes last, as that drops what has no counterpart."""
    order = sorted(table, key=lambda c: (table[c] == "", c))
    wrong, right = ("".join(x).replace("'", "''") for x in (order, (table[c] for c in order)))
    return f"translate({text}, '{wrong}', '{right}')"


def nfkc(text: str) -> str:
    """Every character of the first plane that becomes one other, and of those that become several the three that occur
    in the data."""
    for c in "℃㎡…":
        text = f"replace({text}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
    return f"nfc_normalize({translate(text, {c: f for c, f in forms.items() if len(f) == 1 and f != c})})"


def compare_form(text: str) -> str:
    """Of a text that is NFKC already."""
    return f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def norm(text: str) -> str:
    return compare_form(nfkc(text))


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"
