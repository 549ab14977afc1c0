"""Text that looks the same brought to one form: folding of characters, and script-aware repair of look-alike letters."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

# Characters without a glyph of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
# Hyphens of the same shape.
HYPHENS = "‐‑﹣－"
# Ranges whose compatibility form has the same shape: widths, ligatures, positional and joined letters, radicals, digraphs.
SAME_SHAPE = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2100, 0x214F), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFDFF), (0xFE30, 0xFE6B), (0xFE70, 0xFEFC), (0xFF00, 0xFFEF), (0x2F800, 0x2FA1F))
# Latin letters and the Cyrillic and Greek letters of the same shape, in the same order.
LATIN_CYRILLIC = ("aceijopsxyhqwdABCEHIJKMOPSTXYQWGëïËÏ", "асеіјорѕхуһԛԝԁАВСЕНІЈКМОРЅТХУԚԜԌёїЁЇ")
LATIN_GREEK = ("oviABEZHIKMNOPTYXj", "ονιΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳ")

_JOINING = "ؠآ-ؿـ-يٮٯٱ-ۓەۮۯۺ-ۼۿݐ-ݿ"
_RIGHT_ONLY = "آ-إاةد-زوٱ-ٳٵ-ٷڈ-ڙۀۃ-ۋۍۏےۓەۮۯ"
_MARKS = "ً-ٰٟ"
_BOTH_SIDES = f"(?![{_RIGHT_ONLY}])[{_JOINING}]"
_PERSIAN = re.compile("[كىي٠-٣٧-٩ھە‌‍]")
_JOINED_NEXT = f"(?=[{_MARKS}]*[{_JOINING}‍])"
_NOT_JOINED_NEXT = f"(?![{_MARKS}]*[{_JOINING}‍])"
_STEPS = [
    (re.compile(f"(?<!{'.'})‌|(?<![{_JOINING}{_MARKS}])‌|(?<=[{_RIGHT_ONLY}])‌|‌(?![{_JOINING}])", re.S), ""),
    (re.compile(f"(?<=[{_JOINING}])(?<![{_RIGHT_ONLY}])‍(?=[{_JOINING}])|(?<![{_JOINING}])‍(?![{_JOINING}])"), ""),
    (re.compile(f"ي{_JOINED_NEXT}"), "ی"),
    (re.compile(f"ى{_NOT_JOINED_NEXT}"), "ی"),
    (re.compile(f"ك{_JOINED_NEXT}"), "ک"),
    (re.compile(f"ھ{_JOINED_NEXT}"), "ه"),
    (re.compile(f"ە{_NOT_JOINED_NEXT}"), "ه"),
]
_DIGITS = str.maketrans("٠١٢٣٧٨٩", "۰۱۲۳۷۸۹")


@cache
def _folding() -> dict[int, str]:
    table = dict.fromkeys(map(ord, INVISIBLE), "") | dict.fromkeys(map(ord, HYPHENS), "-")
    for a, b in SAME_SHAPE:
        for i in range(a, b + 1):
            form = unicodedata.normalize("NFKC", chr(i))
            if i not in table and form != chr(i) and not (0x2100 <= i <= 0x214F and unicodedata.category(chr(i)) != "Lu"):
                table[i] = form
    for i in (*range(0xA0, 0xA1), 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table[i] = " "
    return table


@cache
def _folded_characters() -> re.Pattern[str]:
    """Any character of the basic plane that folding may touch: those of the table, and those that composition may."""
    touched = {i for i in _folding() if i <= 0xFFFF} | {*range(0x0300, 0x0370), 0x0374, 0x037E, 0x0387, *range(0x0653, 0x0656), *range(0x1100, 0x1200), *range(0x1F00, 0x2000), 0x212A, 0x212B, 0x3099, 0x309A}
    touched |= {i for i in range(0xA0, 0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.combining(chr(i))}
    ranges: list[list[int]] = []
    for i in sorted(touched):
        if ranges and i == ranges[-1][1] + 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]")


_ASTRAL_FORMS = re.compile("[\U0002f800-\U0002fa1f]")


def fold(text: str) -> str:
    """One form of widths, accents, invisible characters, blanks, hyphens, joined letters and positional shapes; never of case or words."""
    if text.isascii():
        return text
    if _folded_characters().search(text) or _ASTRAL_FORMS.search(text):
        text = unicodedata.normalize("NFC", text.translate(_folding()))
    if _PERSIAN.search(text):
        for pattern, form in _STEPS:
            text = pattern.sub(form, text)
        text = text.translate(_DIGITS)
    return text


_SCRIPT = {"latin": "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-ͳͶ-Ͽἀ-῿"}
LETTERS = re.compile("[" + "".join(_SCRIPT.values()) + "][" + "".join(_SCRIPT.values()) + "\u0300-\u036f]*")
_HAS = [re.compile(f"[{x}]") for x in _SCRIPT.values()]


@cache
def _letters() -> dict[str, tuple[str, dict[str, str]]]:
    """For each letter with look-alikes: its script, and the letter of the same shape by script."""
    rows: dict[str, dict[str, str]] = {}
    for other, (latin, there) in (("cyrillic", LATIN_CYRILLIC), ("greek", LATIN_GREEK)):
        for a, b in zip(latin, there, strict=True):
            rows.setdefault(a, {"latin": a})[other] = b
    return {x: (script, row) for row in rows.values() for script, x in row.items()}


def _script(letter: str) -> str:
    return next((name for name, has in zip(_SCRIPT, _HAS, strict=True) if has.match(letter)), "")


def _proof(word: str) -> dict[str, int]:
    """How many letters of the word belong to one script only, by script."""
    found: dict[str, int] = {}
    known = _letters()
    for x in word:
        if x not in known and (s := _script(x)):
            found[s] = found.get(s, 0) + 1
    return found


def candidate(word: str, around: str) -> str | None:
    """The word in its dominant script, or None if it is so already or has other letters without look-alike there.

    Dominant is the script of the letters that belong to one script only; in a word without such letters, that of the text around.
    """
    proof = _proof(word)
    target = max(proof, key=lambda s: (proof[s], s)) if proof else around
    known, out = _letters(), []
    for x in word:
        if x in known and known[x][0] != target:
            if target not in known[x][1]:
                return None
            out.append(known[x][1][target])
        elif x not in known and _script(x) != target and not unicodedata.combining(x):
            return None
        else:
            out.append(x)
    form = unicodedata.normalize("NFC", "".join(out))
    return None if form == word else form


def doubtful_words(text: str) -> list[tuple[str, str | None]]:
    """The folded text in pieces, each with its candidate form or None; one piece if no word is in doubt."""
    if text.isascii() or sum(bool(has.search(text)) for has in _HAS) < 2:
        return [(text, None)]
    total: dict[str, int] = {}
    words = list(LETTERS.finditer(text))
    for m in words:
        for s, n in _proof(m[0]).items():
            total[s] = total.get(s, 0) + n
    around = max(total, key=lambda s: (total[s], s)) if total else "latin"
    pieces: list[tuple[str, str | None]] = []
    at = 0
    for m in words:
        form = candidate(m[0], around)
        if form is not None:
            if m.start() > at:
                pieces.append((text[at : m.start()], None))
            pieces.append((m[0], form))
            at = m.end()
    if at < len(text) or not pieces:
        pieces.append((text[at:], None))
    return pieces
