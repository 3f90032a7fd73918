"""Abbreviations and synonyms replaced by their full or canonical forms, with exact spans before and after.

All forms of a table are found in one pass over a text, by an Aho-Corasick automaton that a worker builds once. An
occurrence counts where it is a word of its own, does not touch a protected place (paragraph references, dates, outline
numbers), and, for an entry with context words, one of them is near. Of occurrences that overlap the longest counts, then
the first. All spans refer to the original text, so they never go stale. Protected places are sought only in texts that
hold a form. The pass over a text is a small function in Arrow batches; Spark deals the rows.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: abbreviation, full form, label, context words
_COURT = ["Urteil", "Beschluss", "Az.", "Aktenzeichen"]
ABBREVIATIONS: list[tuple[str, str, str, list[str]]] = [
    ("GG", "Grundgesetz", "GESETZ", ["Artikel", "Art.", "gemäß", "nach", "§"]), ("BGB", "Bürgerliches Gesetzbuch", "GESETZ", []), ("StGB", "Strafgesetzbuch", "GESETZ", []),
    ("VwVfG", "Verwaltungsverfahrensgesetz", "GESETZ", []), ("VwGO", "Verwaltungsgerichtsordnung", "GESETZ", []), ("DSGVO", "Datenschutz-Grundverordnung", "GESETZ", []),
    ("BDSG", "Bundesdatenschutzgesetz", "GESETZ", []), ("TierSchG", "Tierschutzgesetz", "GESETZ", []), ("BImSchG", "Bundes-Immissionsschutzgesetz", "GESETZ", []),
    ("BNatSchG", "Bundesnaturschutzgesetz", "GESETZ", []), ("NHundG", "Niedersächsisches Gesetz über das Halten von Hunden", "GESETZ", []), ("NMG", "Niedersächsisches Meldegesetz", "GESETZ", []),
    ("NPOG", "Niedersächsisches Polizei- und Ordnungsbehördengesetz", "GESETZ", []), ("NKomVG", "Niedersächsisches Kommunalverfassungsgesetz", "GESETZ", []),
    ("BVerwG", "Bundesverwaltungsgericht", "BEHÖRDE", []), ("BVerfG", "Bundesverfassungsgericht", "BEHÖRDE", []), ("BGH", "Bundesgerichtshof", "BEHÖRDE", []),
    ("OVG", "Oberverwaltungsgericht", "BEHÖRDE", []), ("VG", "Verwaltungsgericht", "BEHÖRDE", _COURT), ("AG", "Amtsgericht", "BEHÖRDE", [*_COURT, "Richter"]),
    ("BKA", "Bundeskriminalamt", "BEHÖRDE", []), ("BSI", "Bundesamt für Sicherheit in der Informationstechnik", "BEHÖRDE", []),
    ("BfDI", "Bundesbeauftragter für den Datenschutz und die Informationsfreiheit", "BEHÖRDE", []), ("Nds.", "Niedersachsen", "ORT", []), ("NRW", "Nordrhein-Westfalen", "ORT", []),
    ("BW", "Baden-Württemberg", "ORT", ["Gesetz", "Verordnung", "Ministerium", "gemäß"]), ("GVBl.", "Gesetz- und Verordnungsblatt", "SONSTIGE", []), ("BGBl.", "Bundesgesetzblatt", "SONSTIGE", []),
    ("BAnz.", "Bundesanzeiger", "SONSTIGE", []), ("OIDC", "OpenID Connect", "SONSTIGE", []), ("XÖV", "XML in der öffentlichen Verwaltung", "SONSTIGE", [])]

# ---- fixed values: canonical form, variants, context words
SYNONYMS: list[tuple[str, list[str], list[str]]] = [
    ("Hundehalter", ["Hundehalterin", "Halterin oder Halter", "Halter oder Halterin", "haltende Person", "Halterin und Halter", "Halterinnen und Halter"], ["Hund", "Tier", "Sachkunde", "Register", "halten"]),
    ("Antragsteller", ["Antragstellerin", "Antragstellerin oder Antragsteller", "Antragsteller oder Antragstellerin", "antragstellende Person"], []),
    ("Betroffener", ["Betroffene", "betroffene Person", "betroffene Personen", "betroffene natürliche Person"], []),
    ("Eigentümer", ["Eigentümerin", "Eigentümerin oder Eigentümer", "Eigentümer oder Eigentümerin"], []),
    ("zuständige Behörde", ["zuständige Fachbehörde", "zuständigen Behörde", "zuständigen Fachbehörde", "örtlich zuständige Behörde", "sachlich zuständige Behörde"], []),
    ("Meldebehörde", ["die Meldebehörden", "zuständige Meldebehörde", "zuständigen Meldebehörde"], []),
    ("Sachkundenachweis", ["Nachweis der Sachkunde", "Sachkundeprüfung", "Befähigungsnachweis", "Nachweis über die Sachkunde", "erforderliche Sachkunde"], ["Hund", "Tier", "Halter", "Prüfung"]),
    ("Haftpflichtversicherung", ["Haftpflichtversicherungsschutz", "Versicherungsschutz", "Tierhalterhaftpflichtversicherung", "Hundehaftpflichtversicherung"], ["Hund", "Tier", "Schaden", "Halter"]),
    ("Transponder", ["Mikrochip", "elektronischer Chip", "Chip", "Kennzeichnungschip"], ["Hund", "Tier", "Kennzeichnung", "Identifizierung"]),
    ("Zentrales Hunderegister", ["Hunderegister", "zentrales Register", "das Register", "Zentralregister"], ["Hund", "Anmeldung", "Registrierung", "Halter"]),
    ("anmelden", ["registrieren", "zur Anmeldung verpflichtet", "anzumelden"], ["Hund", "Register", "Halter"]),
    ("Ordnungswidrigkeit", ["Ordnungswidrigkeiten", "Bußgeldtatbestand", "Verwaltungsübertretung"], []),
    ("personenbezogene Daten", ["personenbezogenen Daten", "persönliche Daten", "persönlichen Daten", "Personendaten"], []),
    ("Datenverarbeitung", ["Verarbeitung personenbezogener Daten", "Verarbeitung der Daten", "Datenverarbeitungsvorgänge"], [])]

# ---- fixed values: places that stay as they are
PROTECTED = [r"§\s*\d+\w*(?:\s+Abs\.\s*\d+)?(?:\s+Satz\s*\d+)?", r"Art\.\s*\d+", r"Abs\.\s*\d+", r"Nr\.\s*\d+", r"Satz\s*\d+", r"\d{4}-\d{2}-\d{2}", r"\d+\.\s*\d+\."]
ABBREVIATION_CONTEXT, SYNONYM_CONTEXT = 100, 150

MAPPING = "array<struct<abbrev:string,resolved:string,orig_start:int,orig_end:int,res_start:int,res_end:int,label:string>>"
RESULT = f"struct<text:string,map:{MAPPING}>"


def _folded(text: str) -> str:
    """Lower case, character by character: the length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _cased(found: str, full: str) -> str:
    """The case of what was found: all upper, all lower, or a first capital; else the form as it is."""
    if found.isupper():
        return full.upper()
    if found.islower():
        return full.lower()
    return full[0].upper() + full[1:] if found[0].isupper() else full


class Finder:
    """Forms of a table: form to (full form, label, context words). fold: found in any case, which is carried over."""

    def __init__(self, entries: dict[str, tuple[str, str, list[str]]], window: int, fold: bool):
        self.window, self.fold = window, fold
        self.automaton = ahocorasick.Automaton()
        for form, (full, label, words) in entries.items():
            if form and form != full:
                self.automaton.add_word(_folded(form) if fold else form, (len(form), full, label, [w.lower() for w in words]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def occurrences(self, text: str) -> list[tuple[int, int, str, str]]:
        """start, end, full form and label of all that count on their own."""
        if not len(self.automaton):
            return []
        found = [(end + 1 - entry[0], end + 1, *entry[1:]) for end, entry in self.automaton.iter(_folded(text) if self.fold else text)]
        word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        found = [f for f in found if not word(f[0] - 1) and not word(f[1])]
        covered = [m.span() for p in PROTECTED for m in re.finditer(p, text)] if found else []
        out = []
        for start, end, full, label, words in found:
            if any(a < end and start < b for a, b in covered):
                continue
            if words:
                around = text[max(0, start - self.window) : end + self.window].lower()
                if not any(w in around for w in words):
                    continue
            out.append((start, end, full, label))
        return out

    def resolve(self, text: str) -> tuple[str, list[tuple]]:
        """The text with its forms replaced, and their spans: form, full form, start and end before and after, label."""
        taken: list[tuple[int, int, str, str]] = []
        for one in sorted(self.occurrences(text), key=lambda o: (o[0] - o[1], o[0])):
            at = bisect.bisect(taken, one)
            if (at == 0 or taken[at - 1][1] <= one[0]) and (at == len(taken) or one[1] <= taken[at][0]):
                taken.insert(at, one)
        out, spans, at, size = [], [], 0, 0
        for start, end, full, label in taken:
            full = _cased(text[start:end], full) if self.fold else full
            out += [text[at:start], full]
            size += start - at
            spans.append((text[start:end], full, start, end, size, size + len(full), label))
            size += len(full)
            at = end
        return "".join(out) + text[at:], spans


@functools.lru_cache(16)
def _finder(table: tuple, window: int, fold: bool) -> Finder:
    return Finder({form: (full, label, list(words)) for form, full, label, words in table}, window, fold)


def _column(text: Column, entries: list[tuple[str, str, str, list[str]]], window: int, fold: bool) -> Column:
    table = tuple((form, full, label, tuple(words)) for form, full, label, words in entries)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("abbrev", "resolved", "orig_start", "orig_end", "res_start", "res_end", "label")
        finder = _finder(table, window, fold)
        for texts in batches:
            got = [finder.resolve(t or "") for t in texts]
            yield pd.DataFrame({"text": [g[0] for g in got], "map": [[dict(zip(names, s)) for s in g[1]] for g in got]})

    return run(text)


def abbreviations(text: Column, table=ABBREVIATIONS) -> Column:
    """struct(text, map); null counts as empty."""
    return _column(text, table, ABBREVIATION_CONTEXT, False)


def synonyms(text: Column, table=SYNONYMS) -> Column:
    """struct(text, map); null counts as empty."""
    return _column(text, [(v, canonical, "SYNONYM", words) for canonical, variants, words in table for v in variants], SYNONYM_CONTEXT, True)


def normalised(text: Column) -> Column:
    """struct(text, abbreviations, synonyms): abbreviations first, then synonyms in what they give; each map has the spans of its own step."""
    one = abbreviations(text)
    two = synonyms(one["text"])
    return F.struct(two["text"].alias("text"), one["map"].alias("abbreviations"), two["map"].alias("synonyms"))


def original(text: Column, mapping: Column) -> Column:
    """The text before the replacements, from the resolved one and its spans."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, m: F.struct(F.concat(s["out"], text.substr(s["at"] + 1, m["res_start"] - s["at"]), m["abbrev"]).alias("out"), m["res_end"].alias("at"))
    return F.aggregate(mapping, start, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))


def original_position(position: Column, mapping: Column) -> Column:
    """Where a place of the resolved text was; inside a replacement, its start."""
    inside = F.filter(mapping, lambda m: (m["res_start"] <= position) & (position < m["res_end"]))
    moved = F.aggregate(F.filter(mapping, lambda m: m["res_end"] <= position), F.lit(0), lambda a, m: a + (m["orig_end"] - m["orig_start"]) - (m["res_end"] - m["res_start"]))
    return F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["orig_start"]).otherwise(position + moved)
