"""Fixed values about characters: which ones a reader cannot tell apart, and which ones do not show.

The table of look-alike letters is short on purpose; everything that follows from a rule of Unicode (full-width forms,
ligatures, presentation forms, mathematical letters, canonical composition) is derived from ``unicodedata`` at import.
"""

from __future__ import annotations

import sys
import unicodedata

# Letters of other scripts and the plain letters they look like, in pairs of strings of equal length.
LETTERS = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀЬ", "ABESIJKMHOPCTYXYGQWIb"),
    ("аеорсухѕіјһԁԛԝӏ", "aeopcyxsijhdqwl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("ονρϲϳυα", "ovpcjua"),
    # Armenian, Latin extensions and letter-like signs
    ("ՕՏԼօոսցհɑɡıȷ", "OSLonughagij"),
    # Cherokee capitals
    ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCEHJKLMPSTVWZ"),
)

# Hyphens and dashes that are drawn as the plain hyphen.
HYPHENS = "‐‑﹣"

# Characters without a picture that are not in the Unicode category of format characters.
BLANK_LETTERS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


def is_invisible(ch: str) -> bool:
    """A character that takes no room and leaves no mark: format characters, variation selectors and fillers."""
    return unicodedata.category(ch) == "Cf" or ch in BLANK_LETTERS or "︀" <= ch <= "️"


def is_blank(ch: str) -> bool:
    """A character shown as empty room, of any width; line ends count as blanks too."""
    return ch.isspace() and ch != " "


def shape_of(ch: str) -> str | None:
    """The plain string that a compatibility form is drawn as, or None where the form looks different.

    Taken: wide, narrow and presentation forms, ligatures (compatibility forms of letters only), font variants.
    Not taken: superscripts, fractions, circled and squared signs; they look different from their plain text."""
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return unicodedata.normalize("NFKC", ch)
    if kind == "<compat>" and unicodedata.category(ch) in ("Ll", "Lu", "Lt", "Nl"):
        plain = unicodedata.normalize("NFKC", ch)
        return plain if all(c.isalpha() for c in plain) else None
    return None


def base_pairs() -> list[tuple[str, str]]:
    """Every look-alike pair known without looking at data: (form, plain form); an empty plain form means invisible."""
    pairs = [(a, b) for left, right in LETTERS for a, b in zip(left, right, strict=True) if a != b]
    pairs += [(h, "-") for h in HYPHENS]
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        if is_invisible(ch):
            pairs.append((ch, ""))
        elif is_blank(ch):
            pairs.append((ch, " "))
        else:
            plain = shape_of(ch)
            if plain and plain != ch:
                pairs.append((ch, plain))
            elif len(unicodedata.normalize("NFC", ch)) == 1 and unicodedata.normalize("NFC", ch) != ch:
                pairs.append((ch, unicodedata.normalize("NFC", ch)))
    return pairs
