"""Cleaning of raw scientific text: brackets become sentences of their own, symbols become names, words become stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .porter2 import stem


def _symbols() -> dict[str, str]:
    """Names of symbols: Greek letters and raised or lowered characters by what Unicode says of them, and a list."""
    out = {}
    for code in [*range(0x391, 0x3AA), *range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA)]:
        if (name := unicodedata.name(chr(code), "")) and "FINAL" not in name:
            out[chr(code)] = name.split()[-1].lower().replace("lamda", "lambda")
    out.pop("΢", None)
    for code in [0xB2, 0xB3, 0xB9, *range(0x2070, 0x20A0), *range(0x1D62, 0x1D66), 0x2C7C]:
        sign, _, base = unicodedata.decomposition(chr(code)).partition(" ")
        if sign in ("<super>", "<sub>") and base:
            low = "^" if sign == "<super>" else "_"
            out[chr(code)] = low + chr(int(base, 16)).replace("−", "-")
    out["ₔ"] = "_@"
    named = (
        "± +/-|÷ div|√ sqrt|∑ sum|∞ inf|≈ approx|≃ approx|≅ approx|≠ neq|≡ identical|⊂ subset|∠ angle|° degree|℃ degreec|‰ %o|§ sec|£ pound|¢ cent|¥ yen|"
        "♀ female|♂ male|↓ down|↑ up|⟶ ->|⇄ <=>|⇆ <=>|⩽ <=|≦ <=|≧ >=|⩾ >=|≲ <~|≳ >~|˂ ^<|⟨ <|⟩ >|〈 >|〉 >|∷ ::|‖ ||═ =|∧ ^|˙ ^dot|⋅ dot|∙ bullet|● bigdot|∘ smallcircle|"
        "о bigcircle|△ bigtri|▵ smalltri|∆ delta|ϵ epsilon|ɛ epsilon|ϕ phi|⋯ ...|· .|ƒ f|ø o|Ø null|ĸ kra|ƞ n|Ƞ n|ı _1|Ӕ ae|Л el|Н en|Ф ef|р er|Е E|С C|"
        "׳ |、 |ᅟ |″ |‬ |‭ |‮ |΄ |？ |‡ |¿ "
    )
    for entry in named.replace("‖ ||", "‖ \x00").split("|"):
        sign, _, name = entry.partition(" ")
        if sign:
            out[sign] = name.replace("\x00", "||")
    return out


SYMBOLS = _symbols()
_OPEN, _CLOSE, _ENDS = "([{", ")]}", "?!;:."
#: Runs of characters that are treated alike, and marks one by one (of which quotes and commas just go).
_RUNS = re.compile(r"(?P<plain>[^\x00-\x20\x7f-\U0010ffff()\[\]{}\-?!;:.\"',]+)|(?P<wide>[\x80-\U0010ffff]+)|(?P<blank>[\x00-\x20\x7f]+)|(?P<mark>.)")
_LETTER = re.compile("[A-Za-z0-9]")
#: Brackets, and blanks that ``str.split`` and this module don't take alike.
_KNOTTY = re.compile(r"[()\[\]{}\x00-\x08\x0e-\x1f\x7f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def ascii_name(ch: str) -> str:
    """Nearest ASCII letters of a character, ``?`` if there are none."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    return plain.encode("ascii", "replace").decode() or "?"


def _blank(ch: str) -> bool:
    return ch in " \t\n\r\x0b\x0c" or ord(ch) < 32 or ord(ch) == 127


def _informs(text: str) -> bool:
    return _LETTER.search(text) is not None


def clean_text(dirty: str | None, stemmer=stem) -> str:
    """The cleaned text; null and empty texts give an empty one.

    A bracket opens a segment unless it directly follows a word; closed before white space or a full stop, or
    never, the segment becomes a sentence, otherwise it goes back into the text around it. Segments that
    were closed last come first. Tokens without a letter or digit go, the others are stemmed.
    """
    text = dirty or ""
    if not _KNOTTY.search(text):
        # Without brackets each word is written by itself; most words of a corpus were seen before.
        return _finished([" ".join(map(_written, text.split()))], stemmer)
    open_: list[list[str]] = [[]]
    done: list[str] = []
    glued = False
    size = len(text)
    for m in _RUNS.finditer(text):
        here = open_[-1]
        run = m[0]
        if m.lastgroup == "plain":
            here.append(run.lower())
            glued = glued or m.end() < size and text[m.end()] in _OPEN
            continue
        if m.lastgroup == "wide":
            here += map(_named, run)
            continue
        after = text[m.end()] if m.end() < size else "\n"
        if m.lastgroup == "blank":
            # Of white space only the last character can count, and not before an opening bracket.
            if after not in _OPEN and m.end() < size:
                here.append(" ")
        elif run in _OPEN:
            if not glued:
                open_.append([])
            glued = False
        elif run in _CLOSE:
            if len(open_) > 1:
                segment = "".join(open_.pop())
                if _blank(after) or after == ".":
                    done.insert(0, segment)
                else:
                    open_[-1].append(segment)
        elif run == "-":
            here.append("_")
        elif run in _ENDS and after in " \t\n\r\x0b\x0c":
            here.append(" . ")
    while open_:
        done.insert(0, "".join(open_.pop()))
    return _finished(done, stemmer)


@lru_cache(maxsize=200_000)
def _written(word: str) -> str:
    """A word of a text without brackets, its symbols named, its hyphens joined, and a full stop by itself after it."""
    out = []
    for m in _RUNS.finditer(word):
        if m.lastgroup == "plain":
            out.append(m[0].lower())
        elif m.lastgroup == "wide":
            out += map(_named, m[0])
        elif m[0] == "-":
            out.append("_")
        elif m[0] in _ENDS and m.end() == len(word):
            out.append(" . ")
    return "".join(out)


def _named(ch: str) -> str:
    name = SYMBOLS.get(ch)
    return name if name is not None and len(name) < 2 else f"{{{ascii_name(ch) if name is None else name}}}"


def _finished(segments: list[str], stemmer) -> str:
    """Segments as sentences, without tokens that have no letter or digit, in stems."""
    words: list[str] = []
    for segment in segments:
        if _informs(segment):
            words += [*segment.lstrip(" _").rstrip(" _.").split(), "."]
    out: list[str] = []
    for w in words:
        if w == ".":
            if not out or out[-1] != ".":
                out.append(w)
        elif _informs(w):
            out.append(stemmer(w).lower())
    return "".join(f"{w} " for w in out)


@F.pandas_udf(StringType())
def clean(text: pd.Series) -> pd.Series:
    """``clean_text`` of a column."""
    return text.map(clean_text)
