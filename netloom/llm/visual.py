"""Problem 1: text that reads the same but is stored with different characters.

A transducer walks the grapheme clusters of a text once.  Its tables are
compiled when the module is loaded, from rules over all code points
(compatibility widths, spaces, invisible marks) and over all canonical
compositions (a base with its accents, in every partly composed spelling), plus
short lists of look-alikes.  They are checked for conflicts: no input may have
two outputs, and no output may be changed by an entry.  A cluster takes the
longest matching entry; only clusters whose marks stand in another than the
canonical order, and Hangul letters, are composed by rule.

Look-alikes are settled per word while the walk goes on.  A word in which every
foreign letter has a Latin twin is read as Latin ("pаypal" with a Cyrillic a),
unless it has no Latin letter and stands among words that are proper words of
its script ("ресурс" in a Russian phrase or host); a word that holds a letter
without a twin is a proper word of its script ("почта"), and stray Latin twins
in it are turned to that script.  Joiners stay between letters of scripts that
need them (Persian, Hindi) and vanish elsewhere.  A space that isn't the plain
blank becomes one inside a text and vanishes at its ends, where nobody sees it.

Defined results: null stays null, the empty text stays empty, letter case,
plain blanks, visible punctuation and visible accents are kept, and
``canonical(canonical(x)) == canonical(x)``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    "CYRILLIC": {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
        "ѕ": "s", "ӏ": "l", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ґ": "r",
        "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
        "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W",
    },
    "GREEK": {
        "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y",
        "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
        "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    },
    "ARMENIAN": {
        "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S",
        "Լ": "L", "Ս": "U",
    },
    "CHEROKEE": {
        "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭵ": "i", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T",
        "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
    },
    "COPTIC": {
        "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    },
    "LISU": {
        "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P",
        "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    },
}
# Latin letters that are drawn like a basic one.
LATIN_TWINS = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ƅ": "b", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
# Marks drawn like an ASCII one.
MARKS = {
    "\u2010": "-", "\u2011": "-", "\u2212": "-", "\u00ad": "", "\u2024": ".", "\u3002": ".", "\uff61": ".",
    "\u2044": "/", "\u2215": "/", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u02bc": "'",
}
JOINERS = ("\u200c", "\u200d")
JOINING_SCRIPTS = (
    "ARABIC", "SYRIAC", "MONGOLIAN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU",
    "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR",
)
#: Invisible code points that are letters or marks by category, so the rule below can't find them.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u3164\uffa0"
PLAIN = r"\A[\x00-\x7e]*\z"
#: Marks between words of one phrase, host or name.
BETWEEN = " -_."
_CLUSTER = regex.compile(r"\X")


def script_of(ch: str) -> str:
    """First word of the character's name, enough to tell scripts apart."""
    return unicodedata.name(ch, "").split(" ", 1)[0]


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in FILLERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


#: Code points that the rules look at: everything but the ideographs beyond the compatibility ones.
CODE_POINTS = (range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE01F0))


class Transducer:
    """``single``: the output of each code point that changes; ``root``: a trie over the spellings of composed characters."""

    def __init__(self) -> None:
        self.to_latin = {c: x for table in LOOK_ALIKES.values() for c, x in table.items()}
        self.from_latin: dict[str, dict[str, str]] = {}
        for name, table in LOOK_ALIKES.items():
            back = self.from_latin[name] = {}
            for c, x in table.items():
                back.setdefault(x, c)
        self.single: dict[str, str] = {}
        self.root: dict = {}
        listed = {**MARKS, **LATIN_TWINS}
        for points in CODE_POINTS:
            for ch in map(chr, points):
                out = self._rule(ch, listed)
                if out != ch:
                    self.single[ch] = out
                for spelling in self._spellings(ch):
                    self._add(spelling, ch)
        self.check()

    def _rule(self, ch: str, listed: dict[str, str]) -> str:
        if _invisible(ch):
            return ""
        # a look-alike with a compatibility form (the lunate sigma) is still a look-alike
        form = ch if ch in self.to_latin else unicodedata.normalize("NFKC", ch)
        return "".join(" " if unicodedata.category(x) in ("Zs", "Zl", "Zp") or x == "\x85" else listed.get(x, x) for x in form)

    def _spellings(self, ch: str) -> list[str]:
        """All sequences of more than one code point that compose to ``ch``."""
        parts = unicodedata.decomposition(ch).split()
        if len(parts) != 2 or parts[0].startswith("<"):
            return []
        base, mark = (chr(int(x, 16)) for x in parts)
        if unicodedata.normalize("NFC", base + mark) != ch:
            return []
        return [x + mark for x in (base, *self._spellings(base))]

    def _add(self, src: str, out: str) -> None:
        node = self.root
        for ch in src:
            node = node.setdefault(ch, {})
        if node.get("", out) != out:
            raise ValueError(f"two outputs for {src!r}")
        node[""] = out

    def check(self) -> None:
        """No output may be changed by an entry."""
        twins = [*MARKS.values(), *LATIN_TWINS.values(), *self.to_latin.values()]
        for out in [*self.single.values(), *twins]:
            if any(ch in self.single for ch in out) or (out in twins and any(ch in self.to_latin for ch in out)):
                raise ValueError(f"{out!r} is an output and an input")

    def match(self, cluster: str) -> str:
        out = "".join(self.single.get(ch, ch) for ch in cluster)
        if len(out) < 2:
            return out
        node, done = self.root, ""
        for ch in out:
            if ch not in node:
                return _composed(out)
            node = node[ch]
            done = node.get("", "")
        return done or _composed(out)


@lru_cache(10_000)
def _composed(text: str) -> str:
    return unicodedata.normalize("NFC", text)


_T = Transducer()


class _Word:
    """The letters of one word and what they say about its script."""

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.scripts: dict[str, bool] = {}  # of foreign letters: whether all have a twin
        self.latin = False

    def add(self, ch: str) -> None:
        self.letters.append(ch)
        if ch.isascii():
            self.latin = self.latin or ch.isalpha()
        elif (name := script_of(ch)) in LOOK_ALIKES:
            self.scripts[name] = self.scripts.get(name, True) and (ch in _T.to_latin or not ch.isalpha())

    def settled(self, around: set[str]) -> str:
        """All Latin, or all of its own script; ``around``: the scripts of the proper words beside it."""
        own = [name for name, twins in self.scripts.items() if not twins]
        if not self.scripts or len(own) > 1:
            return "".join(self.letters)
        if not own:
            if not self.latin and set(self.scripts) <= around:
                return "".join(self.letters)
            return "".join(_T.to_latin.get(ch, ch) for ch in self.letters)
        back = _T.from_latin[own[0]]
        return "".join(back.get(_T.to_latin.get(ch, ch), ch) if ch.isalpha() else ch for ch in self.letters)


def _phrase(items: list) -> str:
    """Words and the marks between them."""
    around = {name for w in items if isinstance(w, _Word) for name, twins in w.scripts.items() if not twins}
    return "".join(w if isinstance(w, str) else w.settled(around) for w in items)


def canonical_text(text: str | None) -> str | None:
    """The one form of a text."""
    if text is None or text.isascii():
        return text
    clusters = _CLUSTER.findall(text)
    out: list[str] = []
    phrase: list = []
    word: _Word | None = None
    hidden = 0  # spaces that aren't plain since the last thing seen
    seen = False
    for k, cluster in enumerate(clusters):
        if cluster.isascii():
            new = cluster
        else:
            new = _T.match(cluster)
            if any(j in cluster for j in JOINERS):
                new = _keep_joiners(cluster, clusters[k + 1][0] if k + 1 < len(clusters) else "") or new
            if new.strip(" ") == "" and " " not in cluster:
                # stands for nothing but space: kept only between things that are seen
                hidden += len(new) if seen else 0
                continue
        if hidden:
            phrase.append(" " * hidden)
            word, hidden = None, 0
        seen = True
        for ch in new:
            if ch.isalnum() or unicodedata.category(ch)[0] == "M" or ch in JOINERS:
                if word is None:
                    word = _Word()
                    phrase.append(word)
                word.add(ch)
            elif ch in BETWEEN:
                phrase.append(ch)
                word = None
            else:
                out.append(_phrase(phrase))
                out.append(ch)
                phrase, word = [], None
    out.append(_phrase(phrase))
    done = "".join(out)
    # letters that a vanished mark kept apart may compose now
    return done if unicodedata.is_normalized("NFC", done) else unicodedata.normalize("NFC", done)


def _keep_joiners(cluster: str, after: str) -> str | None:
    """A cluster ending in one joiner between two letters of a joining script keeps it."""
    base = cluster.rstrip("".join(JOINERS))
    rest = cluster[len(base) :]
    if not base or len(rest) != 1 or not after:
        return None
    if any(j in base for j in JOINERS) or script_of(base[0]) not in JOINING_SCRIPTS or script_of(after) not in JOINING_SCRIPTS:
        return None
    return _T.match(base) + rest


@lru_cache(100_000)
def _cached(text: str) -> str | None:
    return canonical_text(text)


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_cached, na_action="ignore")


def canonical(col: Column) -> Column:
    """Column expression; texts of plain characters stay in the JVM and cross to Python as nulls only."""
    plain = col.rlike(PLAIN)
    return F.when(plain, col).otherwise(_canonical_udf(F.when(~plain, col)))
