"""German stems and function words, for full-text search.

The stemmer follows the published description of the German Snowball algorithm: regions R1 and R2, then three steps of
suffixes. It is a function of one word; the index calls it once per distinct word of a batch.
"""

from __future__ import annotations

import re

# ---- fixed values: vowels, endings before which s and st may go
VOWELS, BEFORE_S, BEFORE_ST = "aeiouyäöü", "bdfghklmnrt", "bdfghklmnt"

# ---- fixed values: function words; those that are declined, by their stems
_DECLINED = "all ander dein dies ein einig euer eur ihr jed jen kein manch mein sein solch unser unsr welch"
_OTHERS = """
aber als also am an auch auf aus bei bin bis bist da damit dann das daß dass dasselbe dazu dein dem demselben den denn denselben der derer derselbe derselben des desselben dessen dich die dies
dieselbe dieselben dir doch dort du durch ein einmal er es etwas euch für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen im in indem ins ist jetzt kann können
könnte machen man mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr selbst sich sie sind so sollte sondern sonst über um und uns unter viel vom von vor während war waren
warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen"""


FUNCTION_WORDS = frozenset(_OTHERS.split()) | {stem + ending for stem in _DECLINED.split() for ending in ("", "e", "em", "en", "er", "es")}

_REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_BETWEEN = re.compile(f"([{VOWELS}])([uy])([{VOWELS}])")
_FIRST, _SECOND = re.compile("(?:em|ern|er|en|es|e|s)$"), re.compile("(?:en|er|est|st)$")
_THIRD = re.compile("(?:end|ung|ig|ik|isch|lich|heit|keit)$")
_PLAIN = str.maketrans("UYäöü", "uyaou")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 (at least three letters in) and R2 begin."""
    if len(word) < 3 or not (first := _REGION.match(word)):
        return len(word), len(word)
    second = _REGION.match(word, first.end())
    return max(first.end(), 3), second.end() if second else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = _BETWEEN.sub(lambda m: m[1] + m[2].upper() + m[3], word.replace("ß", "ss"))
    r1, r2 = _regions(word)

    def cut(found: re.Match | None, region: int) -> tuple[str, str]:
        """Suffix and what is before it, if it lies in the region."""
        return (found[0], word[: found.start()]) if found and found.start() >= region else ("", word)

    suffix, rest = cut(_FIRST.search(word), r1)
    if suffix and (suffix != "s" or rest[-1:] in BEFORE_S):
        word = rest[:-1] if suffix in ("e", "en", "es") and rest.endswith("niss") else rest
    suffix, rest = cut(_SECOND.search(word), r1)
    if suffix and (suffix != "st" or (rest[-1:] in BEFORE_ST and len(rest) > 3)):
        word = rest
    suffix, rest = cut(_THIRD.search(word), r2)
    if suffix in ("end", "ung"):
        word = rest[:-2] if rest.endswith("ig") and rest[-3:-2] != "e" and len(rest) - 2 >= r2 else rest
    elif suffix in ("ig", "ik", "isch") and rest[-1:] != "e":
        word = rest
    elif suffix in ("lich", "heit"):
        word = rest[:-2] if rest.endswith(("er", "en")) and len(rest) - 2 >= r1 else rest
    elif suffix == "keit":
        more = next((s for s in ("lich", "ig") if rest.endswith(s) and len(rest) - len(s) >= r2), "")
        word = rest[: len(rest) - len(more)]
    return word.translate(_PLAIN)
