"""Segments of a text and their features, in a form that sees through disguised spelling."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјкмтвнԁԛɡαοερτυνικ", "aeopcyxisjkmtbhdqgaoeptuvik")
#: Digits and signs written for letters inside a word.
LEET = str.maketrans("013457@$!|€", "oieastasiie")
#: Characters without width.
ZERO_WIDTH = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")

CODE = re.compile(r"\b[a-z]{2,5}-\d+\b|[#]?\d[\d.,:/\-]*%?(?![^\W\d_]|[@$!|])")
SPLIT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\n\r  ]+")
SPEAKER = re.compile(r"^\s*(?:[-*•>]+\s+|\w+:\s+)")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W_])|(?<![^\W_])(?:[^\W\d_][._\-]){2,}[^\W\d_]+")
WORD = re.compile(r"(?:[^\W_]|[@$!|*#€](?=[^\W_@$!|*#€]|[*#]))+(?:[*#]+[^\W_]*)*")
RUN = re.compile(r"([^\W\d])\1{2,}")
MASK = re.compile(r"[*#]{2,}")
#: What the patterns above can only match with; looked for first, as most segments have none of it.
DIGITS, JOINTS, MASKS = frozenset("0123456789"), frozenset("._-"), frozenset("@$!|*#€")
#: ASCII characters that are no letter or digit become blanks.
PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}


def segments(text: str | None) -> list[str]:
    """Sentences and lines of the whole text, without the name of a speaker."""
    if not text:
        return []
    return [s for part in SPLIT.split(text) if part and (s := SPEAKER.sub("", part).strip())]


def fold(segment: str) -> str:
    """Lower case without accents, invisible characters and look-alikes; numbers and codes become 0; spaced letters are joined."""
    s = segment
    if not s.isascii():
        s = unicodedata.normalize("NFKD", ZERO_WIDTH.sub("", s))
        s = "".join(c for c in s if not unicodedata.combining(c))
    s = s.lower()
    if not s.isascii():
        s = s.translate(LOOKALIKES).replace("ß", "ss")
    chars = set(s)
    if not chars.isdisjoint(DIGITS) or not s.isascii():
        s = CODE.sub("0", s)
    if not JOINTS.isdisjoint(s[:-1]) or sum(len(w) == 1 for w in s.split()) > 3:
        s = SPACED.sub(lambda m: re.sub(r"[ ._\-]", "", m[0]), s)
    return s


def _letters(word: str) -> str:
    """A word with digits or signs in it: masks become ``*``, signs for letters the letters."""
    return MASK.sub("*", word).replace("#", "*").translate(LEET) if any(c.isalpha() for c in word) else word


def words(folded: str) -> list[str]:
    chars = set(folded)
    if folded.isascii() and chars.isdisjoint(MASKS):
        found = folded.translate(PLAIN).split()
        if not chars.isdisjoint(DIGITS):
            found = [w if w.isalpha() or w == "0" else _letters(w) for w in found]
    else:
        found = [w if w.isalpha() or w == "0" else _letters(w) for w in WORD.findall(folded)]
    joined = " ".join(found)
    if any(c * 3 in joined for c in set(joined)):
        joined = RUN.sub(r"\1", joined)
    return joined.split(" ") if found else []


@lru_cache(maxsize=200_000)
def _word_features(w: str) -> tuple[tuple[str, float], ...]:
    out = [("w" + w, 1.0)]
    if len(w) > 2:
        p = f"<{w}>"
        out += [("g" + p[i : i + 4], 0.5) for i in range(len(p) - 3)]
        out.append((f"s{w[0]}{w[-1]}{min(9, len(w))}", 0.3))
    return tuple(out)


def features(ws: list[str]) -> dict[str, float]:
    """How often each word, pair of neighbours, character run of four and (for masked words) first and last letter occurs, times the weight of its kind."""
    out: dict[str, float] = {}
    for w in ws:
        for k, v in _word_features(w):
            out[k] = out.get(k, 0.0) + v
    for a, b in zip(ws, ws[1:]):
        k = f"b{a} {b}"
        out[k] = out.get(k, 0.0) + 0.7
    return out
