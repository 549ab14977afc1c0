"""Wrong decodings as substitution ciphers: the swaps of code pages, what a token would have been under each, and how likely that is."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache

import numpy as np
from pyspark import Broadcast

from .glyphs import LATIN_CYRILLIC, LATIN_GREEK, fold

# Code pages that text is read with by mistake, and those it may have been written in.
READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1256", "cp437", "cp850", "cp866", "koi8-r", "iso8859-5", "mac-roman", "mac-cyrillic")
WRITTEN_IN = ("cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "mac-roman", "cp437", "cp850", "cp1256", "cp1250")
#: Times that text may have been read wrongly as UTF-8 one after another.
DEPTH = 3
#: Least log-probability of a pair of characters, so that one rare character decides nothing.
FLOOR = -12.0
#: Characters that text has for its layout, which show nothing by themselves: no-break space and soft hyphen.
PLAIN_SIGNS = "\xa0\xad"
#: What well-formed UTF-8 adds to a gain, for it is rare in text that was read rightly.
WELL_FORMED = 3.0


@cache
def high_half(page: str) -> dict[str, int]:
    """Character to byte for the upper half of a code page; bytes without a character are the control characters of the same number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@cache
def on_any_page() -> set[str]:
    """All characters of the upper halves."""
    return {c for page in READ_AS for c in high_half(page)}


@cache
def _sequences(page: str) -> re.Pattern[str]:
    """Characters that are well-formed multi-byte UTF-8 when read as bytes of the page."""
    by_byte = {b: c for c, b in high_half(page).items()}

    def some(a: int, b: int) -> str:
        return "[" + "".join(re.escape(by_byte[i]) for i in range(a, b) if i in by_byte) + "]"

    tail = some(0x80, 0xC0)
    return re.compile(f"{some(0xC2, 0xE0)}{tail}|{some(0xE0, 0xF0)}{tail}{{2}}|{some(0xF0, 0xF5)}{tail}{{3}}")


@cache
def _ends_of_sequences(page: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters that begin and that end a well-formed sequence of the page."""
    by_byte = _by_byte(page)
    return frozenset(by_byte[i] for i in range(0xC2, 0xF5) if i in by_byte), frozenset(by_byte[i] for i in range(0x80, 0xC0) if i in by_byte)


def _pages_of(chars: set[str]) -> list[str]:
    """Pages in which text of these characters may have well-formed sequences: a quick look before the search."""
    return [page for page, (first, last) in _ends_of_pages() if not first.isdisjoint(chars) and not last.isdisjoint(chars)]


@cache
def _ends_of_pages() -> list[tuple[str, tuple[frozenset[str], frozenset[str]]]]:
    return [(page, _ends_of_sequences(page)) for page in READ_AS]


def _from_utf8(token: str, page: str) -> str | None:
    table = high_half(page)

    def one(m: re.Match[str]) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    form = _sequences(page).sub(one, token)
    return None if form == token else form


@cache
def one_for_one(page: str, written: str) -> dict[int, str]:
    """The cipher of text written in one single-byte code page and read in another, as a table for str.translate."""
    back = {b: c for c, b in high_half(written).items()}
    return {ord(c): back[b] for c, b in high_half(page).items()}


@cache
def _runs(page: str) -> re.Pattern[str]:
    return re.compile("[" + "".join(map(re.escape, high_half(page))) + "]{2,}")


def _from_gbk(token: str, page: str) -> str | None:
    table = high_half(page)

    def one(m: re.Match[str]) -> str:
        form = bytes(table[c] for c in m[0]).decode("gbk", "replace")
        return m[0] if form.count("�") * 5 > len(form) else form

    form = _runs(page).sub(one, token)
    return None if form == token else form


def _utf8_read_as_gbk(token: str) -> str | None:
    try:
        form = token.encode("gb18030").decode("utf-8", "replace")
    except UnicodeEncodeError:
        return None
    return None if form == token or form.count("�") * 5 > len(form) else form


@cache
def _by_byte(page: str) -> dict[int, str]:
    return {b: c for c, b in high_half(page).items()}


def misread(text: str, written: str, page: str) -> str | None:
    """What text looks like that was written in one encoding and read in another; None if it can't be written so."""
    try:
        if page == "gbk":
            return text.encode(written).decode("gbk", "replace")
        if written in ("utf-8", "gbk"):
            table = _by_byte(page)
            return "".join(chr(b) if b < 128 else table[b] for b in text.encode(written))
    except UnicodeEncodeError:
        return None
    if not {c for c in text if ord(c) > 127} <= high_half(written).keys():
        return None
    return text.translate(one_for_one(written, page))


_FLAT = {ord(c): "0" for c in "0123456789"} | {ord(c): "۰" for c in "۰۱۲۳۴۵۶۷۸۹"} | {ord(c): " " for c in "\t\r\n"}
_ENDS = ".,;:!?()'\"،。，；：！？、"


_TO_FLATTEN = re.compile("[" + "".join(map(chr, _FLAT)) + "]")


def digits(text: str) -> str:
    """With one digit for all of a kind."""
    return text.translate(_FLAT) if _TO_FLATTEN.search(text) else text


def flat(text: str) -> str:
    """As the language model sees it: lower case, one digit, one blank."""
    return digits(text.lower())


def word(token: str) -> str:
    """A token's entry in the vocabulary: flat, without punctuation at its ends."""
    return flat(token).strip(_ENDS)


#: A wrong decoding is common in a language if so many of its frequent words occur misread too, at such a share of the occurrences.
#: From the greater share on it changes what pairs of characters are likely.
COMMON_WORDS, COMMON_SHARE, HEAVY_SHARE = 8, 0.005, 0.03
#: Frequent words, or pairs of ideographs, that are tried with each wrong decoding.
_TRIED = 500


def _ideograph(c: str) -> bool:
    return "一" <= c <= "鿿"


def without_misread(pairs: dict[str, int], words: dict[str, int], usual: set[str]) -> tuple[dict[str, int], dict[str, int], set[str]]:
    """Counts of a language less what common wrong decodings added to them, else misread text would be as usual as text read rightly.

    A wrong decoding shows in the vocabulary: frequent words occur misread too, less often than as they are (at any share where letters or
    ideographs became several signs, which shows the direction). Misread words and characters that hardly any other word has are left out,
    and pairs if they are many; a few do no harm and keep rare characters from being unheard of. Ideographs have no blanks between words, so
    their pairs stand for words.
    """
    top = sorted((w for w in words if len(w) >= 4 and not w.isascii()), key=lambda w: (-words[w], w))[:_TRIED]
    gone: dict[str, int] = {}
    heavy: set[str] = set()
    for written in ("utf-8", *WRITTEN_IN):
        for page in READ_AS:
            seen = [(words[w], n) for w in top if (g := misread(w, written, page)) is not None and (g := word(g)) != w and (n := words.get(g))]
            right, wrong = sum(x for x, _ in seen), sum(x for _, x in seen)
            utf8 = written == "utf-8"
            if len(seen) < COMMON_WORDS or wrong < COMMON_SHARE * (right + wrong) or wrong >= right and not utf8:
                continue
            for w, n in words.items():
                if not w.isascii():
                    for v in {w, w.capitalize(), w.upper()}:
                        if not v.isascii() and (form := misread(v, written, page)) not in (None, v) and (g := word(form)) != w and (m := words.get(g)):
                            if utf8 or m <= 4 * wrong / right * n + 3 and (len(w) >= 4 or 4 * m * right >= wrong * n):
                                gone[g] = m
                                if wrong >= HEAVY_SHARE * (right + wrong):
                                    heavy.add(g)
    drop: set[str] = set()
    if gone:
        bad: dict[str, int] = {}
        good: dict[str, int] = {}
        for w, n in words.items():
            to = bad if w in gone else good
            for c in w:
                if ord(c) > 127:
                    to[c] = to.get(c, 0) + n
        drop = {c for c, n in bad.items() if good.get(c, 0) < 0.1 * (good.get(c, 0) + n)}
    wrong_signs: set[str] = set()
    double = sorted((p for p in pairs if _ideograph(p[0]) and _ideograph(p[-1])), key=lambda p: (-pairs[p], p))
    if double:
        total: dict[str, int] = {}
        for p, n in pairs.items():
            total[p[0]] = total.get(p[0], 0) + n
        for written, page in [("utf-8", "gbk"), *(("gbk", page) for page in READ_AS)]:

            def times(p: str) -> tuple[str, int]:
                form = flat(misread(p, written, page) or "")  # noqa: B023
                return form, min((pairs.get(a + b, 0) for a, b in zip(form, form[1:])), default=0)

            seen = [(pairs[p], n) for p in double[:_TRIED] if (n := times(p)[1])]
            right, wrong = sum(x for x, _ in seen), sum(x for _, x in seen)
            if len(seen) < _TRIED // 10 or wrong < HEAVY_SHARE * (right + wrong) or wrong >= right and page == "gbk":
                continue
            bad = {}
            for p in double:
                form, n = times(p)
                if n and (n <= pairs[p] or page != "gbk"):
                    for c in form:
                        bad[c] = bad.get(c, 0) + n
            # signs stay: quotation marks and the like are in text that was read rightly too, and the letters beside them are enough
            wrong_signs |= {c for c, n in bad.items() if ord(c) > 127 and c.isalpha() and _ideograph(c) == (page == "gbk") and n >= 0.3 * total.get(c, 0)}
    if not gone and not wrong_signs:
        return pairs, words, usual
    left = dict(pairs)
    for g in heavy:
        padded = f" {g} "
        for p in map("".join, zip(padded, padded[1:])):
            if p in left:
                left[p] -= gone[g]
    left = {p: n for p, n in left.items() if n > 0 and wrong_signs.isdisjoint(p)}
    kept = {w: n for w, n in words.items() if w not in gone and drop.isdisjoint(w)}
    return left, kept, {c for c in usual if flat(c) not in drop | wrong_signs}


#: Scripts that are written together, and the least share of letters from which on a script is a language's own.
TOGETHER, OWN_SCRIPT = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO"), 0.3


def of_own_scripts(pairs: dict[str, int], words: dict[str, int], usual: set[str]) -> tuple[dict[str, int], dict[str, int], set[str]]:
    """Counts of a language less letters of scripts that are not its own and stand beside each other.

    Text misread by a page of another script, listed or not, adds such letters. Letters of another script beside the language's own or ASCII stay.
    """

    def script(c: str) -> str:
        name = _script(c)
        return TOGETHER[0] if name in TOGETHER else name

    mass: dict[str, int] = {}
    for p, n in pairs.items():
        if len(p) == 2 and p[0].isalpha():
            mass[script(p[0])] = mass.get(script(p[0]), 0) + n
    own = {x for x, n in mass.items() if n >= OWN_SCRIPT * sum(mass.values())}
    beside: dict[str, list[int]] = {}
    for p, n in pairs.items():
        if len(p) == 2 and all(map(str.isalpha, p)):
            for c, d in (p, p[::-1]):
                if ord(c) > 127 and script(c) not in own:
                    x = beside.setdefault(c, [0, 0])
                    x[0] += n
                    x[1] += n * (ord(d) > 127 and script(d) not in own)
    # a rare letter does no harm, and its pairs keep foreign words from being unheard of
    strange = {c for c, (n, m) in beside.items() if 2 * m > n} & {flat(c) for c in usual}
    if not strange:
        return pairs, words, usual
    return {p: n for p, n in pairs.items() if strange.isdisjoint(p)}, {w: n for w, n in words.items() if strange.isdisjoint(w)}, {c for c in usual if flat(c) not in strange}


@cache
def _silent(c: str) -> bool:
    """Invisible signs and combining marks that no code page has, which show nothing about the characters beside them."""
    return unicodedata.category(c) in ("Cf", "Mn") and c not in on_any_page()


@cache
def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def _by_shape(token: str, swap: str) -> bool:
    """Whether the form of a token shows misread UTF-8 by itself, whatever the language.

    All characters above ASCII belong to well-formed sequences that stand for letters of one script and hold signs where letters would be:
    several sequences, or one with a small letter beside it, since capitals are followed by closing quotation marks.
    """
    pattern = _sequences(swap.partition("+")[0].removeprefix("utf-8 as "))
    found = list(pattern.finditer(token))
    if not pattern.sub("", token).isascii() or not all(_from_utf8(m[0], swap.partition("+")[0].removeprefix("utf-8 as ")) for m in found):
        return False
    if "+" not in swap:
        letters = [c for m in found for c in _from_utf8(m[0], swap.removeprefix("utf-8 as ")) or ""]
        if not all(map(str.isalpha, letters)) or len({_script(c) for c in letters}) > 1:
            return False
    if 2 * sum(any(not c.isalpha() for c in m[0][1:]) for m in found) < len(found):
        return False
    beside = (c for m in found for c in (token[m.start() - 1 : m.start()], token[m.end() : m.end() + 1]))
    return len(found) > 1 or any("a" <= c <= "z" for c in beside if c)


class Language:
    """A language as the corpus shows it: bigrams of its characters, counts of its words and its usual characters."""

    def __init__(self, pairs: dict[str, int], words: dict[str, int], usual: set[str], pooled: bool = False) -> None:
        self.pairs, self.words, self.usual = pairs, words, usual
        #: Stands for languages with too few texts for a model of their own: several scripts, and usual characters of other languages.
        self.pooled = pooled
        self.first: dict[str, int] = {}
        for pair, n in pairs.items():
            self.first[pair[0]] = self.first.get(pair[0], 0) + n
        self.total = sum(self.first.values()) or 1
        self.seen: dict[str, float] = {}
        letters = [c for c in usual if c.isalpha() and ord(c) > 127]
        scripts: dict[str, list[str]] = {}
        for c in letters:
            scripts.setdefault(_script(c) if pooled else "", []).append(c)
        self.written = [w for w in WRITTEN_IN if any(sum(c in high_half(w) for c in own) >= 0.8 * len(own) for own in scripts.values())]
        self.gbk = any(map(_ideograph, usual))
        #: Whether it has letters above ASCII, and whether most of its letters are ASCII.
        self.high = bool(letters)
        self.latin = 2 * sum(n for c, n in self.first.items() if "a" <= c <= "z") >= sum(n for c, n in self.first.items() if c.isalpha())
        #: One-for-one ciphers: name, table, and the characters that it turns into letters or usual characters.
        self.maps: list[tuple[str, dict[int, str], set[str]]] = []
        for page in READ_AS:
            for w in self.written:
                if w != page:
                    table = one_for_one(page, w)
                    self.maps.append((f"{w} as {page}", table, {chr(i) for i, c in table.items() if c.isalpha() or c in usual}))
        #: A swap may turn usual letters into usual letters, so that no character gives it away.
        self.closed = any(sum(t.get(ord(c)) in usual for c in letters) >= 0.5 * len(letters) for _, t, _ in self.maps)
        #: What was found out about tokens: swaps with their gains, those that show nothing, and those that have unusual characters among
        #: their letters, are no word, and that no listed swap explains.
        self.found: dict[str, dict[str, float]] = {}
        self.sound: set[str] = set()
        self.strange: set[str] = set()

    def pair(self, p: str) -> float:
        x = self.seen.get(p)
        if x is None:
            back = (self.first.get(p[1], 0) + 0.02) / self.total
            x = self.seen[p] = max(FLOOR, math.log((self.pairs.get(p, 0) + back) / (self.first.get(p[0], 0) + 1)))
        return x

    def score(self, token: str) -> float:
        t = f" {flat(token)} "
        return sum(map(self.pair, map("".join, zip(t, t[1:]))))

    def utf8_forms(self, token: str) -> dict[str, str]:
        """What the token would be if UTF-8 had been misread, up to DEPTH times."""
        found: dict[str, str] = {}
        level = {"": token}
        for _ in range(DEPTH):
            nexts = {t: [(page, form) for page in _pages_of(set(t)) if (form := _from_utf8(t, page))] for t in set(level.values())}
            level = {f"{name}+utf-8 as {page}" if name else f"utf-8 as {page}": form for name, t in level.items() for page, form in nexts[t]}
            found |= level
            if not level:
                break
        return found

    def forms(self, token: str) -> dict[str, str]:
        """What the token would be under each swap, by the swap's name."""
        found = self.utf8_forms(token)
        high = {c for c in token if ord(c) > 127}
        odd = {c for c in high - self.usual if not _silent(c)}
        for name, table, sensible in self.maps:
            if odd <= sensible:
                if high <= sensible:
                    form = token.translate(table)
                    if form != token:
                        found[name] = form
                if odd and odd != high:
                    found[f"{name}, in part"] = "".join(table.get(ord(c), c) if c in odd else c for c in token)
        if self.gbk:
            for page in READ_AS:
                if form := _from_gbk(token, page):
                    found[f"gbk as {page}"] = form
            if any("一" <= c <= "鿿" for c in token) and (form := _utf8_read_as_gbk(token)):
                found["utf-8 as gbk"] = form
        return found

    def swaps(self, token: str) -> dict[str, float]:
        """Swaps under which the token is much likelier, with the gain in log-probability.

        What comes out must be a word that the corpus has far more often than the token, or else be likelier by its bigrams alone: by a little
        where bytes formed valid UTF-8 of usual characters, by much otherwise. A token is looked at if it has an unusual character, a sign
        inside a word or a well-formed byte sequence, or if it is unlikely as a whole and its letters could stand for each other.
        """
        if token in self.sound:
            return {}
        x = self.found.get(token)
        if x is None:
            if len(self.found) + len(self.sound) > 200_000:
                self.found.clear()
                self.sound.clear()
                self.strange.clear()
            x = {} if token.isascii() else self._swaps(token)
            if x:
                self.found[token] = x
            elif self._strange(token):
                self.found[token] = x
                self.strange.add(token)
            else:
                self.sound.add(token)
        return x

    def _strange(self, token: str) -> bool:
        """Whether the token may belong to a cipher on no list.

        Foldable characters and look-alikes are what they look like. ASCII letters stay what they are on every code page, so beside them
        nothing can stand for letters of a language that is written without them. Ideographs are no cipher of single symbols.
        """
        inner = token.strip(PUNCTUATION)
        if len(inner) < 3 or inner.isascii() or self.gbk or not self.high or not self.latin and ASCII_LETTER.search(inner):
            return False
        odd = {c for c in inner if ord(c) > 127 and c not in self.usual and ord(c) not in LOOKALIKES and not _silent(c)}
        if not odd or any(map(_ideograph, odd)) or all(fold(c) != c for c in odd):
            return False
        return not any(self.words.get(word(f), 0) >= 3 for f in (inner, fold(inner), inner.translate(LOOKALIKES)))

    def _swaps(self, token: str) -> dict[str, float]:
        x: dict[str, float] = {}
        high = {c for c in token if ord(c) > 127}
        odd = not high <= self.usual or SIGN_INSIDE.search(token) is not None
        # full-width letters and the like come from no code page; a word of look-alikes is what it looks like. Usual characters beside unusual
        # ones may be from anywhere, for the token may be misread in part.
        unusual = {c for c in high - self.usual if not _silent(c)}
        readable = (unusual or high) <= on_any_page() or self.gbk
        alike = False
        if odd and len(token) > 1:
            latin = token.translate(LOOKALIKES)
            alike = latin != token and all(c in self.usual or ord(c) < 128 for c in latin) and self.words.get(word(latin), 0) >= 3
        closed = self.closed and not odd and ASCII_LETTER.search(token) is None
        own = self.score(token) if closed or odd and readable and not alike else 0.0
        if odd and readable and not alike or closed and own < -4.0 * (len(token) + 1):
            forms = self.forms(token)
        elif any(_sequences(page).search(token) for page in _pages_of(high)):
            forms = self.utf8_forms(token)
            own = self.score(token)
        else:
            return x
        count, old = self.words.get(word(token), 0), set(token)
        same: dict[str, str] = {}
        for name, form in forms.items():
            utf8 = "utf-8" in name
            if not utf8 and (first := same.setdefault(form, name)) != name:  # pages that agree on the token
                if first in x:
                    x[name] = x[first]
                continue
            new = {c for c in form if c not in old}
            entry = word(form)
            n = self.words.get(entry, 0)
            likely = n >= 3 and n >= (1 if utf8 else 8) * count and entry.strip("0")
            if likely and (utf8 or len(entry) > 1 and all(c.isalpha() or c in self.usual for c in new)):
                x[name] = max(self.score(form) - own, 0.0) + math.log(n / (count + 1)) + WELL_FORMED * utf8
            elif self.pooled and name.startswith("utf-8") and not name.endswith("gbk") and _by_shape(token, name):
                x[name] = max(self.score(form) - own, 0.0) + 4.0 + WELL_FORMED * (1 + sum(len(u) > 1 for u in units(token, name)))
            elif all(c in self.usual for c in new):
                gone = set(token).difference(form)
                if not any(c not in self.usual and c not in PLAIN_SIGNS for c in gone) and (utf8 or len(gone) < 3):
                    continue
                gain = self.score(form) - own
                several = utf8 and sum(len(u) > 1 for u in units(token, name)) > 1
                if several or gain >= (4.0 if utf8 else 9.0):
                    x[name] = max(gain, 0.0) + WELL_FORMED * (utf8 + several)
        return x


_MADE: dict[str, dict[str, Language]] = {}


def made(name: str, sent: Broadcast) -> dict[str, Language]:
    """The languages of a model, made once per worker process, so that what a task found out about a token serves the next one."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = {lang: Language(*m) for lang, m in sent.value.items()}
    return _MADE[name]


ASCII_LETTER = re.compile("[A-Za-z]")
#: Look-alike letters as the Latin letters of their shape.
LOOKALIKES = str.maketrans(LATIN_CYRILLIC[1] + LATIN_GREEK[1], LATIN_CYRILLIC[0] + LATIN_GREEK[0])
#: Signs around words.
PUNCTUATION = ".,;:!?()[]{}<>'\"«»“”„‘’–—-…·•*/\\|"
#: A sign between two letters.
SIGN_INSIDE = re.compile(r"[^\W\d_][^\w\s\x00-\x7f][^\W\d_]")
LOST = re.compile("[�\x80-\x9f]")
TOKENS = re.compile(r"[^ \t\r\n]+")


def gains(text: str, language: Language) -> tuple[dict[str, float], list[str]]:
    """Sum of gains over the text's tokens by swap, `lost` for characters that only a failed decoding leaves; and the strange tokens, without
    signs around them."""
    found: dict[str, float] = {}
    strange: list[str] = []
    sound = language.sound
    for token in [t for t in TOKENS.findall(text) if t not in sound]:
        swaps = language.swaps(token)
        for name, gain in swaps.items():
            found[name] = found.get(name, 0.0) + gain
        if not swaps and token in language.strange:
            strange.append(token.strip(PUNCTUATION))
    if LOST.search(text):
        found["lost"] = 60.0
    return found, strange


def units(token: str, swap: str) -> list[str]:
    """The token as symbols of the cipher: characters, or well-formed sequences of them where UTF-8 was misread."""
    last = swap.rpartition("+")[2] if "+" in swap else swap
    first = swap.partition("+")[0]
    page = first.partition(" as ")[2].removesuffix(", in part")
    if not last.startswith("utf-8") or page == "gbk":
        return list(token)
    found, at = [], 0
    for m in _sequences(page).finditer(token):
        found += [*token[at : m.start()], m[0]]
        at = m.end()
    return found + list(token[at:])


def plain_of(symbol: str, swap: str) -> str | None:
    """The letter of a symbol by the code pages of the swap, if it is one for one or one level of UTF-8."""
    written, _, page = swap.removesuffix(", in part").partition(" as ")
    if "+" in swap or "gbk" in swap or page not in READ_AS:
        return None
    if written == "utf-8":
        return _from_utf8(symbol, page) if len(symbol) > 1 else None
    form = symbol.translate(one_for_one(page, written))
    return None if form == symbol else form


#: Name of a swap on no list, whose mapping is known only by what was learned.
UNLISTED = "unlisted"
#: Starts of the search for an unlisted mapping, besides the one by frequencies alone.
RESTARTS = 5
#: Places that a symbol of an unlisted cipher needs to be given a letter.
LEAST_SEEN = 5


def _resembling(symbols: list[str], letters: list[str], seen: dict[tuple[str, str], int], language: Language) -> np.ndarray:
    """How well each letter's frequency, also at the ends of words, fits each symbol's; letters above ASCII only, since code pages agree below."""
    count, start, end = ({x: 0 for x in symbols} for _ in range(3))
    for (a, b), n in seen.items():
        if b in count:
            count[b] += n
            start[b] += n * (a == " ")
        if a in end:
            end[a] += n * (b == " ")
    n = np.array([count[x] + 0.5 for x in symbols], float)
    own = np.array([[start[x] / m, end[x] / m] for x, m in zip(symbols, n, strict=True)])
    first = np.array([language.first.get(x, 0) + 0.5 for x in letters], float)
    theirs = np.array([[language.pairs.get(" " + x, 0) / m, language.pairs.get(x + " ", 0) / m] for x, m in zip(letters, first, strict=True)])
    high = np.array([len(x) == 1 and ord(x) > 127 for x in letters])
    apart = np.abs(np.log(n / n.sum())[:, None] - np.log(first / max(first[high].sum(), 1))[None, :]) + 4 * np.abs(own[:, None, :] - theirs[None, :, :]).sum(axis=2)
    return np.where(high[None, :], np.exp(-np.minimum(apart, 30)), 0.0)


def learned(counts: dict[tuple[str, str], int], swap: str, language: Language, rounds: int = 30) -> dict[str, tuple[str, float]]:
    """Letter and certainty of each symbol of a cipher, by expectation-maximisation over its pairs of adjacent symbols.

    The hidden letters follow the language's bigrams. P(symbol | letter) starts from the code pages of the swap, mixed with an even share for
    every letter, and is estimated anew from the expected counts in each round. Usual characters that the swap leaves alone stand for
    themselves. Symbols that no code page answers start from how their frequencies resemble those of letters, several times with some
    noise, and the most likely outcome counts.
    """
    if swap == UNLISTED:
        places: dict[str, int] = {}
        for (_, b), n in counts.items():
            places[b] = places.get(b, 0) + n
        rare = {x for x, n in places.items() if n < LEAST_SEEN and ord(x) > 127}
        counts = {p: n for p, n in counts.items() if rare.isdisjoint(p)}
    symbols = sorted({s for pair in counts for s in pair})
    guesses = {x: flat(g) if (g := plain_of(x, swap)) is not None else None for x in symbols}
    itself = {x for x, g in guesses.items() if g is None and (x.isascii() or x in language.usual)}
    free = [x for x, g in guesses.items() if g is None and x not in itself]
    letters = {g for g in guesses.values() if g is not None} | {flat(x) for x in itself} | {" ", "0"}
    if free:
        letters |= {c.lower() for c in language.usual if c.isalpha()} | {p[0] for p, n in language.pairs.items() if n * 1e4 > language.total and ord(p[0]) > 127}
    letters = sorted(letters)
    place = {c: i for i, c in enumerate(letters)}
    bigrams = np.full((len(letters), len(letters)), 1e-9)
    for p, n in language.pairs.items():
        if len(p) == 2 and p[0] in place and p[1] in place:
            bigrams[place[p[0]], place[p[1]]] += n / language.total
    number = {s: i for i, s in enumerate(symbols)}
    start = np.zeros((len(symbols), len(letters)))
    for s, i in number.items():
        if s in itself:
            start[i, place[flat(s)]] = 1.0
        elif guesses[s] is not None:
            start[i] += 0.1 / len(letters)
            start[i, place[guesses[s]]] += 0.9
    loose = np.array([number[x] for x in free], int)
    if free:
        fit = _resembling(free, letters, counts, language)
        start[loose] = fit / np.maximum(fit.sum(axis=0, keepdims=True), 1e-12) + 1e-6 * (fit > 0)
    fixed = np.array([x in itself for x in symbols])
    seen = np.zeros((len(symbols), len(symbols)))
    for (a, b), n in counts.items():
        seen[number[a], number[b]] += n
    shown = seen > 0

    def climb(emit: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
        likely = -np.inf
        expected = emit
        for _ in range(rounds):
            model = np.maximum(emit @ bigrams @ emit.T, 1e-300)
            now = float((seen[shown] * np.log(model[shown])).sum())
            ratio = seen / model
            expected = emit * (ratio @ emit @ bigrams.T + ratio.T @ emit @ bigrams)
            emit = np.where(fixed[:, None], emit, expected / np.maximum(expected.sum(axis=0, keepdims=True), 1e-300))
            if now - likely < 1e-5 * abs(now):
                break
            likely = now
        return likely, expected, emit

    best = climb(start, rounds)
    if len(free) > 3:
        rng = np.random.default_rng(len(free))
        for _ in range(RESTARTS):
            again = start.copy()
            again[loose] *= np.exp(rng.normal(0, 1.5, again[loose].shape))
            best = max(best, climb(again, rounds), key=lambda x: x[0])
        best = climb(best[2], 10 * rounds)
    expected = best[1]
    sure = expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-300)
    return {s: (letters[int(sure[i].argmax())], float(sure[i].max())) for s, i in number.items() if not fixed[i]}


def capitals(table: dict[str, str], counts: dict[tuple[str, str], int]) -> dict[str, str]:
    """The table with capitals for symbols that begin words mostly, where a more frequent symbol has the same letter."""
    n, start = dict.fromkeys(table, 0), dict.fromkeys(table, 0)
    for (a, b), k in counts.items():
        if b in n:
            n[b] += k
            start[b] += k * (a == " ")
    most: dict[str, str] = {}
    for x in sorted(table):
        if n[x] > n.get(most.get(table[x], ""), -1):
            most[table[x]] = x
    return {x: c.upper() if most[c] != x and 2 * start[x] > n[x] else c for x, c in table.items()}


def deciphered(token: str, table: dict[int, str], language: Language) -> str | None:
    """The word that a token is under a learned table; None if that is no word of the language, or looks like the token anyway."""
    form = token.translate(table)
    if form == token or len(form) < 4 or language.words.get(word(form), 0) < 3:
        return None
    return None if fold(token) == form or flat(token.translate(LOOKALIKES)) == flat(form.translate(LOOKALIKES)) else form


def restore(text: str, language: Language, swap: str, table: dict[str, str]) -> str:
    """The text with each token that is likelier under the swap deciphered; where most are, all tokens that are no less likely so.

    `table` has the letter learned for each symbol, in lower case. It is applied by str.translate where symbols are single characters, and
    yields to the code pages of the swap for a token that they make a more frequent word, or else a likelier one; they also give the case.
    """

    if swap == UNLISTED:
        whole = str.maketrans(table)
        language_of = lambda t: language.words.get(word(t), 0)

        def by_table(m: re.Match[str]) -> str:
            token = m[0]
            if token.isascii():
                return token
            if known := language.swaps(token):
                return language.forms(token).get(max(known, key=lambda k: (known[k], k)), token)
            if token not in language.strange and language_of(token) >= 3:
                return token
            form = token.translate(whole)
            return form if language_of(form) > language_of(token) or language.score(form) > language.score(token) else token

        return TOKENS.sub(by_table, text)

    def letter(symbol: str) -> str:
        page, own = plain_of(symbol, swap), table.get(symbol)
        return page or symbol if own is None or page is not None and flat(page) == own else own

    written, _, page = swap.partition(" as ")
    everywhere: dict[int, str] = {}
    if page in READ_AS and written in WRITTEN_IN:
        # where most tokens show the swap, the text was misread as a whole, and short words and names without a sign of it were too
        tokens = [t for t in TOKENS.findall(text) if not t.isascii()]
        if 2 * sum(swap in language.swaps(t) for t in tokens) > len(tokens):
            everywhere = one_for_one(page, written)

    def one(m: re.Match[str]) -> str:
        token = m[0]
        if token.isascii():
            return token
        if swap not in language.swaps(token):
            form = token.translate(everywhere)
            return form if (language.words.get(word(form), 0), language.score(form)) > (language.words.get(word(token), 0), language.score(token)) else token
        form = language.forms(token).get(swap, token)
        symbols = units(token, swap)
        if language.pooled or not any(s in table for s in symbols):  # letters learned from other languages' bigrams say little
            return form
        own = token.translate({ord(s): letter(s) for s in symbols if s in table or ord(s) > 127}) if all(len(s) == 1 for s in symbols) else "".join(map(letter, symbols))
        return max((form, own), key=lambda f: (language.words.get(word(f), 0), language.score(f)))

    return TOKENS.sub(one, text)
