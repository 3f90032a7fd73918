"""Fixed values of the rule tables: word lists, patterns and constants that results depend on.

Patterns are matched against lower-cased text between word borders that Spark's and DuckDB's regular expressions agree
on, see `bordered`.
"""

from __future__ import annotations

import re

# ---- fixed values: obligation types, in the order of evaluation, with their confidence boost
NORM_TYPES: list[tuple[str, float, list[str]]] = [
    ("MUST_NOT", 0.05, [
        r"darf\s+nicht", r"dürfen\s+nicht", r"ist\s+untersagt", r"sind\s+untersagt", r"ist\s+verboten", r"ist\s+nicht\s+gestattet",
        r"hat\s+keine\s+aufschiebende", r"keine\s+aufschiebende", r"ist\s+ausgeschlossen", r"sind\s+ausgeschlossen"]),
    ("DEF", 0.1, [r"im\s+sinne\s+dieses", r"im\s+sinne\s+dieser", r"im\s+sinne\s+des", r"gilt\s+als"]),
    ("DEADLINE", 0.05, [r"binnen", r"spätestens", r"unverzüglich", r"innerhalb\s+von", r"fristgerecht", r"vor\s+ablauf"]),
    ("COMPETENCE", 0.0, [
        r"zuständig\s+ist", r"obliegt", r"ist\s+zuständig", r"wird\s+wahrgenommen\s+von", r"überwacht", r"führt", r"wird\s+geführt",
        r"nimmt\s+ab", r"abnimmt", r"erteilt", r"wacht\s+.*\s+über", r"erfüllen", r"erfüllt", r"nehmen\s+wahr"]),
    ("EXCEPT", 0.0, [
        r"es\s+sei\s+denn", r"sofern\s+nicht", r"ausgenommen", r"ausnahmsweise", r"unbeschadet", r"gilt\s+nicht", r"findet\s+nicht",
        r"bleibt\s+unberührt", r"bleibt", r"vorbehaltlich", r"abweichend", r"würde", r"würden", r"wäre", r"wären"]),
    ("MUST", 0.0, [
        r"muss", r"müssen", r"soll", r"sollen", r"hat\s+zu", r"haben\s+zu", r"hat\s+sicherzustellen", r"ist\s+zu", r"sind\s+zu",
        r"ist\s+verpflichtet", r"sind\s+verpflichtet", r"pflichtig", r"erforderlich", r"durchzuführen", r"nachzuweisen", r"anzumelden",
        r"mitzuführen", r"einzuhalten", r"sicherzustellen", r"anzugeben", r"anzuzeigen", r"vorzulegen", r"beizubringen", r"zu\s+machen",
        r"bedarf", r"bedürfen", r"unterl(?:ie|a)gt", r"unterliegen", r"mitführen", r"anmelden", r"nachweisen"]),
    ("MAY", 0.0, [
        r"kann", r"können", r"darf", r"dürfen", r"berechtigt", r"befugt", r"gestattet", r"zulässig", r"erteilt", r"zugelassen", r"anerkannt",
        r"abgewickelt", r"bezogen", r"gilt\s+als"]),
]
NORM_BASE, NORM_UNKNOWN = 0.85, 0.3

# ---- fixed values: chunk types, first match counts, substrings without word borders
CHUNK_TYPES: list[tuple[str, list[str]]] = [
    ("rechtsfolge", [r"darf\s+nicht", r"dürfen\s+nicht", r"ist\s+untersagt", r"sind\s+untersagt", r"ist\s+verboten", r"sind\s+verboten"]),
    ("zustaendigkeit", [r"zuständig\s+ist", r"ist\s+zuständig", r"obliegt", r"wird\s+übertragen", r"liegt\s+bei"]),
    ("tatbestand", [r"binnen", r"spätestens", r"unverzüglich", r"innerhalb\s+von", r"bis\s+zum"]),
    ("ausnahme", [r"es\s+sei\s+denn", r"sofern\s+nicht", r"ausgenommen", r"vorbehaltlich", r"abweichend\s+davon", r"unbeschadet"]),
    ("definition", [r"im\s+sinne", r"gilt\s+als", r"versteht\s+man", r"ist\s+definiert\s+als", r"bedeutet"]),
]
CHUNK_TYPE_DEFAULT = "tatbestand"
VALID_CHUNK_TYPES = ["tatbestand", "rechtsfolge", "definition", "ausnahme", "anforderung", "tabelle", "verweis", "zustaendigkeit"]
CLASS_WEIGHTS = {"A": 1.0, "B": 0.85, "C": 0.65}
SOURCE_TYPES = ["gesetz", "verordnung", "standard", "fachkonzept", "leitfaden", "lastenheft", "auslegung"]

# ---- fixed values: entity types of subjects and objects (exact parts first, then suffixes)
SUBJECT_EXACT = {"gemeinde": "BEHÖRDE", "fachbehörde": "BEHÖRDE", "fachministerium": "BEHÖRDE"}
SUBJECT_SUFFIX = {
    "behörde": "BEHÖRDE", "ministerium": "BEHÖRDE", "amt": "BEHÖRDE", "stelle": "BEHÖRDE", "register": "BEHÖRDE", "halter": "ROLLE",
    "halterin": "ROLLE", "inhaber": "ROLLE", "inhaberin": "ROLLE", "person": "ROLLE", "antragsteller": "ROLLE"}
OBJECT_EXACT = {"sachkunde": "ANFORDERUNG", "transponder": "DATENOBJEKT"}
OBJECT_SUFFIX = {
    "daten": "DATENOBJEKT", "register": "DATENOBJEKT", "nummer": "DATENOBJEKT", "nachweis": "DATENOBJEKT", "bescheinigung": "DATENOBJEKT",
    "erlaubnis": "DATENOBJEKT", "pflicht": "ANFORDERUNG", "pflichten": "ANFORDERUNG", "verbot": "ANFORDERUNG"}

# ---- fixed values: statement filters
STOP_SUBJECTS = [
    "er", "sie", "es", "man", "dies", "diese", "dieser", "dieses", "der", "die", "das", "dem", "den", "wer", "s. 3", "s. 2", "s. 1", "s. 4",
    "abs. 1", "abs. 2", "abs. 3", "nr. 1", "nr. 2", "folgendes", "nachfolgendes", "vorstehende"]
PRONOUNS = ["er", "sie", "es", "man", "wer", "dies", "dieser", "diese", "dieses"]
STOP_OBJECTS = [
    "der", "die", "das", "dem", "den", "dies", "diese", "es", "erforderlich", "zulässig", "gebührenpflichtig", "anmeldepflichtig", "gefährlich",
    "bekannt", "unberührt", "entsprechend", "zuständig", "zuständige", "so erlaubt", "einschlägig", "für Halten", "für Führen", "für Haltung",
    "Aktuell Tiergesundheit", "Aktuell", "Microsoft Word", "für das", "für die", "für den", "im übrigen", "im wesentlichen", "in regel",
    "in der regel", "im einzelfall", "auf antrag", "auf anfrage", "nach maßgabe", "durch gesetz", "durch verordnung", "nach bedarf", "im rahmen",
    "nach lage", "nach art", "nach absatz", "nach satz"]
STOP_PREDICATES = [
    "§", "S.", "Nr.", "Abs.", "Art.", "Hundegesetz", "Hundeführerschein", "Preisfeststellung", "Preisfeststellungen", "Landesamt", "TIERSCHUTZ",
    "Ausnahme", "Voraussetzung", "Grundlage", "Maßgabe", "Aktuell", "Presse", "Veranstaltungen", "Stelle", "Satz", "Hunderegister", "VOR",
    "BHV-Hundeführerscheinprüfung", "DHVE-Hundeführerscheinprüfung", "Bedarfsgegenstände", "Bedarfsgegenstand", "MBl", "Erlaubnisse",
    "Hundeführerscheinprüfung", "Abschlussprüfung", "Wildtierkrankheiten", "Wildtierkrankheite", "Präsidentin", "Lebensmittel", "TABELLE",
    "Verbraucherinformationsgesetz"]
PRONOUN_PENALTY, MIN_CONFIDENCE = 0.3, 0.5

# ---- fixed values: named entities by rule
NER_SUFFIX = {
    "BEHÖRDE": ["behörde", "ministerium", "amt", "register", "stelle", "landesbehörde", "fachbehörde"],
    "ROLLE": ["halter", "halterin", "inhaber", "inhaberin", "antragsteller", "antragstellerin", "beauftragter", "beauftragte"],
    "DATENOBJEKT": ["daten", "nummer", "kennnummer", "nachweis", "bescheinigung", "erlaubnis", "ausweis", "zeugnis"]}
NER_EXACT = {
    "BEHÖRDE": ["gemeinde", "gemeinden", "landkreis", "fachministerium"],
    "ROLLE": ["person", "natürliche person", "juristische person"],
    "DATENOBJEKT": ["transponder", "mikrochip", "sachkundenachweis"]}
NER_REGEX = {
    "FRIST": [r"\d+\s+(?:Tag|Tage|Tagen|Woche|Wochen|Monat|Monate|Monaten|Jahr|Jahre|Jahren)", r"binnen\s+\S+", r"innerhalb\s+von\s+\S+", r"unverzüglich"],
    "GESETZ": [r"§\s*\d+\w*(?:\s+Abs\.\s*\d+)?(?:\s+Satz\s*\d+)?", r"Art\.\s*\d+", r"\b[A-Z][a-zA-Z]+G\b"]}
NER_CONFIDENCE = {"regex": 0.90, "exact": 0.85, "suffix": 0.80}
NER_BLACKLIST = ["Google", "Apple", "Microsoft", "Amazon", "Facebook", "Meta", "Twitter", "Instagram", "YouTube", "LinkedIn", "GmbH", "AG", "GbR", "OHG", "KG", "e.V.", "e. V."]
NER_CORRECTIONS = {
    "Telekom": "SONSTIGE", "Deutsche Post": "SONSTIGE", "Bundespost": "BEHÖRDE", "TÜV": "SONSTIGE", "DEKRA": "SONSTIGE", "Antragsteller": "ROLLE",
    "Antragstellerin": "ROLLE", "Antragstellende": "ROLLE", "Feststellung": "SONSTIGE", "Feststellungen": "SONSTIGE"}
AGNOSTIC_OBJECTS = [
    "Antrag", "Antragstellung", "Bescheid", "Erlaubnis", "Genehmigung", "Zulassung", "Anerkennung", "Ausnahmegenehmigung", "Widerspruch", "Klage",
    "Beschwerde", "Nachweis", "Bescheinigung", "Zertifikat", "Ausweis", "Zeugnis", "Urkunde", "Attest", "Prüfung", "Überprüfung", "Beurteilung",
    "Bewertung", "Meldung", "Anmeldung", "Abmeldung", "Mitteilung", "Anzeige", "Register", "Verzeichnis", "Liste", "Datei", "Datenbank"]
NER_CONTEXT = {
    "BEHÖRDE": ["behörde", "amt", "ministerium", "gericht", "zuständig", "überwacht", "anordnung", "bescheid", "verwaltung", "kommune", "landkreis", "gemeinde"],
    "GESETZ": ["§", "abs", "satz", "gesetz", "verordnung", "richtlinie", "art.", "artikel"]}
NER_CONTEXT_WINDOW = 80

# ---- fixed values: information-model signals
PERSISTENCE_PREDICATES = ["speichern", "führen", "anlegen", "registrieren", "eintragen", "verwalten", "erfassen", "aufnehmen", "archivieren", "dokumentieren", "aufzeichnen"]
ATTRIBUTE_PREDICATES = ["ist anzugeben", "sind anzugeben", "ist mitzuteilen", "sind mitzuteilen", "enthält", "enthalten", "umfasst", "umfassen", "besteht aus", "bestehen aus", "hat", "hat zu enthalten"]

# ---- fixed values: questions
QUESTION_WORDS = ["wer", "was", "wie", "wo", "wann", "warum", "weshalb", "wozu", "welche", "welcher", "welches", "kann", "darf", "muss", "ist", "sind", "haben", "gibt"]
RHETORICAL = ["aber warum", "doch wie", "oder etwa", "wirklich"]
QUESTION_LENGTHS = (10, 300)

# ---- fixed values: query signals
QUERY_NORM = r"(?:^|[^\p{L}\p{N}_])§\s*\d|abs\.\s*\d|absatz\s+\d|satz\s+\d|(?:^|[^\p{L}\p{N}_])(?:muss|darf|soll|bedarf|ist\s+zu|hat\s+zu|unverzüglich|binnen|spätestens)(?:$|[^\p{L}\p{N}_])"
QUERY_IM = ["entit[aä]t", "tabelle", "attribut", "spalte", "datenbank", "feld", "schema", "datenbankfeld", "persistier", "datenmodell"]
QUERY_ENTITY = ["zust[äa]ndig", r"wer\s+ist", r"welche\s+beh[öo]rde", r"welche\s+rolle", r"wer\s+darf", r"wer\s+muss"]

# ---- fixed values: RDF classes of entity labels
RDF_CLASSES = {"BEHÖRDE": "Authority", "ROLLE": "Role", "DATENOBJEKT": "DataObject", "GESETZ": "Law", "ORT": "Location", "SONSTIGE": "Entity"}

# ---- fixed values: retrieval
RRF_K, TOP_PER_CLASS, TOP_PRE, TOP_FINAL = 60, 12, 16, 8
CONTEXT_BUDGET = 2457


def bordered(patterns: list[str]) -> str:
    """One pattern for lower-cased text that is true where any of them stands between word borders."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(patterns) + r")($|[^\p{L}\p{N}_])"


def unbordered(patterns: list[str]) -> str:
    return "(" + "|".join(patterns) + ")"


def needed_words(patterns: list[str]) -> list[list[str]]:
    """For each pattern, letters that every text it matches has: the plain start of each of its words."""
    found = [[re.match(r"[a-zäöüß]*", word)[0] for word in re.split(r"\\s\+", p)] for p in patterns]
    return [[w for w in words if w] for words in found]
