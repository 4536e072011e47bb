"""What a search matches, as a pattern over unfolded text, so that places need no map back."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

SOFT = "­"


@cache
def variants(letter: str) -> str:
    """All letters that are ``letter`` but for case and marks, as the inside of a character class."""
    base = letter.casefold() if len(letter.casefold()) == 1 else letter.lower()
    found = {letter, letter.lower(), letter.upper()} if len(letter.upper()) == 1 else {letter, letter.lower()}
    for code in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(code))
        if whole[0].lower() == base and all(map(unicodedata.combining, whole[1:])):
            found.add(chr(code))
    return "".join(sorted(re.escape(c) for c in found))


def folded_query(query: str) -> str:
    return " ".join(query.replace(SOFT, "").split())


def pattern(query: str, match_case: bool = False) -> str:
    """White space matches any run of it, over line breaks too; soft hyphens count for nothing; unless
    ``match_case`` neither case nor marks count. The same text serves Java's engine and RE2."""
    letters = []
    text = folded_query(query)
    for c in text if match_case else unicodedata.normalize("NFD", text):
        if c == " ":
            letters.append(rf"[\s{SOFT}]*\s[\s{SOFT}]*")
        elif match_case:
            letters.append(re.escape(c))
        elif not unicodedata.combining(c):
            letters.append(f"[{variants(c)}]" + r"\p{M}*")
    return f"{SOFT}*".join(letters)
