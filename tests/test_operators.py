"""Operators on small rows with results derived by hand."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions import abbreviations as A
from lexspark.functions import rules as R
from lexspark.functions import text as T
from lexspark.operators import chunking, extraction, retrieval, statements, trees
from lexspark.plans import catalog
from lexspark.plans.adapters import Views
from lexspark.sources import files, sinks
from lexspark.streaming import landing


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())).select(column.alias("x")).first()["x"] if names else None


@pytest.mark.parametrize("text, want", [
    ("Dies darf nicht sein", "MUST_NOT"), ("Halter im Sinne dieses Gesetzes", "DEF"), ("binnen einer Woche muss er", "DEADLINE"), ("Es obliegt ihm", "COMPETENCE"), ("Hunde sind ausgenommen", "EXCEPT"),
    ("Er MÜSSEN gehen", "MUST"), ("Sie kann gehen", "MAY"), ("Unmusste und kannte", "UNKNOWN"), ("", "UNKNOWN"),
])
def test_norm_type(spark, text, want):
    assert one(spark, T.norm_type(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [
    ("Verwal-\ntung am Ort.", "Verwaltung am Ort."), ("a b​c", "a b c"), ("siehe https://x.org/a und www.y.de hier", "siehe und hier"), ("eins.\neins.\nzwei.", "eins.\nzwei."),
    ("▪ Punkt", "Punkt"), ("„so“ ‚wie’", '"so" ‚wie\''), ("Sachkunde1) gilt", "Sachkunde gilt"), ("1Wer darf", "Wer darf"), ("ein Satz\nder weitergeht", "ein Satz der weitergeht"), (None, ""),
])
def test_clean(spark, text, want):
    assert one(spark, T.clean(F.col("t")), t=text) == want


def test_references(spark):
    assert one(spark, T.norm_reference(F.col("t")), t="§ 3 Zweck der Regel\n(1) Text") == "§ 3 Zweck der Regel"
    assert one(spark, T.norm_reference(F.col("t")), t="§ 3\nZweck") == "§ 3 Zweck"
    assert one(spark, T.norm_reference(F.col("t")), t="§ 3\n(1) Zweck") == "§ 3"
    assert one(spark, T.norm_reference(F.col("t")), t="Kein Paragraph") is None
    assert one(spark, T.cross_references(F.col("t")), t="nach § 3 Abs. 1 und § 4a, § 3 Abs. 1") == ["§ 3 Abs. 1", "§ 4a"]
    assert one(spark, T.query_reference(F.col("t")), t="Was sagt § 3 Abs. 1 Satz 2 NHundG?") == "§ 3 Abs. 1 Satz 2 NHundG"
    assert one(spark, T.query_reference(F.col("t")), t="Wer ist zuständig?") is None
    assert one(spark, T.query_type(F.col("t")), t="Was muss ein Halter tun?") == "NORM"
    assert one(spark, T.query_type(F.col("t")), t="Welche Tabelle hat das Attribut?") == "IM"
    assert one(spark, T.query_type(F.col("t")), t="Wer ist zuständig?") == "ENTITY"


def test_questions(spark):
    assert one(spark, T.question_type(F.col("t")), t="Wer ist zuständig?") == "direkt"
    assert one(spark, T.question_type(F.col("t")), t="Aber warum denn nicht?") == "rhetorisch"
    assert one(spark, T.question_type(F.col("t")), t="Nun ja?? oder?") == "mehrfach"
    assert not one(spark, T.is_question(F.col("t")), t="Wer?")


def test_abbreviations(spark):
    text = "Nach DSGVO und BGB gilt: AG handelt. § 3 Abs. 1 NHundG. Urteil des AG Celle. DSGVOX."
    got = spark.createDataFrame([(text,), (None,)], "t string").select(A.abbreviations(F.col("t")).alias("r")).select("r.text", "r.map", A.original(F.col("r.text"), F.col("r.map")).alias("back")).collect()
    assert got[0]["back"] == text and got[1]["text"] == ""
    assert got[0]["text"].startswith("Nach Datenschutz-Grundverordnung und Bürgerliches Gesetzbuch gilt") and "DSGVOX" in got[0]["text"]
    assert all(got[0]["text"][m["res_start"] : m["res_end"]] == m["resolved"] and text[m["orig_start"] : m["orig_end"]] == m["abbrev"] for m in got[0]["map"])


def slow_resolve(text, table, window, fold):
    """One entry after the other, the longest first, over text that they have not yet covered."""
    covered, spans = [m.span() for p in A.PROTECTED for m in re.finditer(p, text)], []
    places = sorted(((len(f), f, full, words) for f, full, _, words in table if f != full), key=lambda e: -e[0])
    for size in sorted({e[0] for e in places}, reverse=True):
        found = []
        for _, form, full, words in (e for e in places if e[0] == size):
            for m in re.finditer(r"(?<!\w)(?=(" + re.escape(form) + r")(?!\w))", text, re.I if fold else 0):
                a, b = m.span(1)
                if not any(x < b and a < y for x, y in covered) and (not words or any(w.lower() in text[max(0, a - window) : b + window].lower() for w in words)):
                    found.append((a, b, full))
        for a, b, full in sorted(found):
            if not any(x < b and a < y for x, y, _ in spans):
                old = text[a:b]
                spans.append((a, b, full if not fold else full.upper() if old.isupper() else full.lower() if old.islower() else full[0].upper() + full[1:] if old[0].isupper() else full))
    spans.sort()
    out, at = "", 0
    for a, b, full in spans:
        out, at = out + text[at:a] + full, b
    return out + text[at:], [s[:2] for s in spans]


def test_forms_against_brute_force():
    rng = np.random.default_rng(5)
    variants = [(v, c, "S", w) for c, vs, w in A.SYNONYMS for v in vs]
    others = ["Hund", "Tier", "und", "§ 3 Abs. 1", "Art. 13", "2024-01-31", "1.2.", "Urteil", "İstanbul", "x_", ",", ".", "die", "zuständige", "AGX", "§5BGB", "Nr. 7"]
    for table, window, fold in ((A.ABBREVIATIONS, A.ABBREVIATION_CONTEXT, False), (variants, A.SYNONYM_CONTEXT, True), ([("ab", "X", "", []), ("b c", "Yy", "", []), ("a", "Z", "", []), ("ab c", "ab c", "", [])], 10, True)):
        finder, hits = A.Finder({f: (full, label, words) for f, full, label, words in table}, window, fold), 0
        for _ in range(400):
            words = [str(rng.choice([e[0] for e in table])) if rng.random() < 0.35 else str(rng.choice(others)) for _ in range(rng.integers(0, 40))]
            words = [getattr(w, str(rng.choice(["upper", "lower", "swapcase", "strip", "strip", "strip"])))() for w in words] if fold else words
            text = "".join(w + str(rng.choice([" ", " ", " ", "", "-"])) for w in words)
            got, spans = finder.resolve(text)
            want, places = slow_resolve(text, table, window, fold)
            assert (got, [s[2:4] for s in spans]) == (want, places)
            assert all(got[s[4] : s[5]] == s[1] and text[s[2] : s[3]] == s[0] for s in spans)
            hits += len(spans)
        assert hits > 300
    assert A.Finder({}, 10, True).resolve("abc") == ("abc", [])


@pytest.mark.parametrize("text, want", [("Die haltende Person mit Hund", "Die Hundehalter mit Hund"), ("HUNDEHALTERIN und Hund", "HUNDEHALTER und Hund"), ("hundehalterin, Hund", "hundehalter, Hund"), ("ein Chip allein", "ein Chip allein"), ("ein Chip im Tier", "ein Transponder im Tier"), ("örtlich zuständige Behörde", "zuständige behörde")])
def test_synonyms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(A.synonyms(F.col("t"))["text"]).first()[0].lower() == want.lower()
    assert spark.createDataFrame([(text,)], "t string").select(A.normalised(F.col("t"))["text"]).first()[0] == A.Finder({v: (c, "S", w) for c, vs, w in A.SYNONYMS for v in vs}, A.SYNONYM_CONTEXT, True).resolve(text)[0]


def test_chunkers(spark):
    text = "§ 1 Zweck\n(1) Der Halter muss den Hund immer anmelden.\n(2) Halter im Sinne dieses Gesetzes ist, wer einen Hund hält.\n§ 2 Verbote\n(1) Dies darf nicht ohne Erlaubnis geschehen."
    got = chunking.class_a(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("para", "n").collect()
    assert [(r["norm_reference"], r["hierarchy_level"], r["chunk_type"]) for r in got] == [
        ("§ 1 Zweck", 1, "tatbestand"), ("§ 1 Zweck", 2, "tatbestand"), ("§ 1 Zweck", 2, "definition"), ("§ 2 Verbote", 1, "tatbestand"), ("§ 2 Verbote", 2, "rechtsfolge")]
    sections = "Vorwort\n1 Einleitung ..... 3\n" + "wort " * 500 + "\n1.1 Ziel\nkurz\n2 Ende\nschluss REQ-0042 steht da."
    got = chunking.class_b(spark.createDataFrame([(1, sections)], "doc_id long, text string")).orderBy("section", "part", "n").collect()
    assert [(r["section"], r["part"], r["breadcrumb"], r["hierarchy_level"], r["chunk_type"]) for r in got] == [
        (0, 0, "Einleitung", 1, "tatbestand"), (0, 2, "Einleitung", 2, "tatbestand"), (0, 2, "Einleitung", 2, "tatbestand"), (1, 0, "Einleitung > Ziel", 2, "anforderung"), (1, 2, "Einleitung > Ziel", 3, "tatbestand"),
        (2, 0, "Ende", 1, "tatbestand"), (2, 2, "Ende", 2, "anforderung")]
    assert len(got[1]["content"].split()) == 436 and got[4]["content"].split() == ["wort"] * 64 + ["kurz"] and got[6]["requirement_id"] == "REQ-0042"
    free = " ".join(f"Dies ist der Satz Nummer {i} mit einigen Wörtern darin." for i in range(12))
    got = chunking.class_c(spark.createDataFrame([(1, free), (2, "")], "doc_id long, text string")).orderBy("n").collect()
    assert [r["content"].count("Satz") for r in got] == [10, 4] and got[1]["content"].startswith("Dies ist der Satz Nummer 8")


def slow_class_b(text):
    """Chapter chunks by a plain walk over the sections."""
    size = lambda s: max(1, len(s) // 4)
    found = list(re.finditer(r"^(\d+(?:\.\d+)*)\s+(.+?)(?:\s*\.{3,}.*)?$", text, re.M))
    parts = [(m[1], m[2].strip(), text[m.end() : n].strip()) for m, n in zip(found, [m.start() for m in found[1:]] + [len(text)])] or [("1", "Inhalt", text)]
    stack, before, out = [], [], []
    for i, (path, head, body) in enumerate(parts):
        depth = path.count(".") + 1
        stack = [x for x in stack if x[0] < depth] + [(depth, head[:30])]
        crumb = " > ".join(h for _, h in stack)
        first, used = [], 0
        for s in re.split(r"(?<=[.!?])\s+", body):
            if used + size(s) > 128:
                break
            first.append(s)
            used += size(s)
        first = " ".join(first)
        out.append((i, 0, 0, depth, crumb, "anforderung" if depth > 1 else "tatbestand", None, size(first), f"{head}\n{first}".strip()))
        pattern = r"(?:(?:[^\n]+\|[^\n]+\n){2,}|(?:[^\n]+\t[^\n]+\n){3,})"
        out += [(i, 1, k, depth + 1, crumb, "tabelle", None, size(x), x.strip()) for k, x in enumerate(re.findall(pattern, body))]
        words = re.sub(pattern, "", body).split()
        chunks = [(before[-76:] if at == 0 else []) + words[at : at + 436] for at in range(0, len(words), 436)]
        for k, c in enumerate(chunks):
            named = re.search(r"\b([A-Z]{1,4}-\d{3,})\b", " ".join(c))
            out.append((i, 2, k, depth + 1, crumb, "anforderung" if named else "tatbestand", named and named[1], size(" ".join(c)), " ".join(c)))
        before = chunks[-1] if chunks else before
    return out


def test_class_b_against_brute_force(spark):
    rng = random.Random(3)
    words = ["wort", "Satz.", "REQ-123", "lang", "Ende!", "a|b", "x\ty", "§", "eins"]
    texts = ["kein Abschnitt, nur Text. Und mehr.", ""]
    for _ in range(12):
        lines = []
        for _ in range(rng.randint(3, 30)):
            kind = rng.random()
            if kind < 0.35:
                lines.append(".".join(str(rng.randint(1, 3)) for _ in range(rng.randint(1, 4))) + " Titel " + rng.choice(["A", "B ....... 12", "mit sehr vielen Wörtern in der Überschrift"]))
            elif kind < 0.5:
                lines += [f"| a{k} | b |" for k in range(rng.randint(1, 4))] if rng.random() < 0.5 else [f"s{k}\tt" for k in range(rng.randint(1, 5))]
            else:
                lines.append(" ".join(rng.choice(words[:5] + words[7:]) for _ in range(rng.choice([3, 20, 90, 500, 1000]))))
        texts.append("\n".join(lines))
    columns = ["section", "part", "n", "hierarchy_level", "breadcrumb", "chunk_type", "requirement_id", "token_count", "content"]
    got = chunking.class_b(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        want = sorted(x for x in slow_class_b(text) if x[-1])
        assert sorted((tuple(r[c] for c in columns) for r in got if r["doc_id"] == i), key=lambda x: x[:3]) == want


def test_router(spark):
    texts = ["§ 1 Eins\n(1) Text steht hier lang genug.\n§ 2 Zwei\nText\n§ 3 Drei\nText", "1.1 Ziel\nText steht hier.\n1.2 Zweck\nMehr.", "Freier Text. Mit Sätzen.", "Inhaltsverzeichnis\nText", "GROSSE ZEILE\nText\nNOCH EINE\nText"]
    got = chunking.routed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").agg(F.min("doc_class").alias("c"), F.max("doc_class").alias("d")).orderBy("doc_id").collect()
    assert [(r["c"], r["d"]) for r in got] == [("A", "A"), ("B", "B"), ("C", "C"), ("B", "B"), ("B", "B")]


def test_statement_filters(spark):
    rows = [(1, "Der Halter", "muss", "Hund", 0.9, None), (2, "er", "muss", "Nr", 0.9, None), (3, "Halter", "§", "Hund", 0.9, None), (4, "Halter", "muss", "Hund", 0.4, None), (5, "12", None, "Hund", 0.9, None)]
    got = statements.filtered(spark.createDataFrame(rows, "svo_id long, subject string, predicate string, object string, confidence double, subject_type string")).orderBy("svo_id").collect()
    assert [(r["svo_id"], r["subject"], r["object"]) for r in got] == [(1, "Der Halter", "Hund"), (2, None, None)]


def test_statements_from_tokens(spark):
    words = [("Der", "der", "DET", "nk", 1), ("Halter", "halter", "NOUN", "sb", 2), ("muss", "müssen", "AUX", "ROOT", 2), ("den", "der", "DET", "nk", 4), ("Hund", "hund", "NOUN", "oa", 5), ("anmelden", "anmelden", "VERB", "oc", 2), (".", ".", "PUNCT", "punct", 2)]
    tokens = spark.createDataFrame([(1, i, *w) for i, w in enumerate(words)], "sent_id long, i int, text string, lemma string, pos string, dep string, head int")
    got = trees.statements(tokens, spark.createDataFrame([(1, "Der Halter muss den Hund anmelden.")], "sent_id long, sentence string")).collect()
    assert [(r["subject"], r["predicate"], r["object"], r["norm_type"], r["subject_type"]) for r in got] == [("Halter", "muss anmelden", "Hund", "MUST", "ROLLE")]


def test_answers(spark):
    assert extraction.repaired('```json\n[{"id": "a"}, {"id": "b"}, {"i') == '[{"id": "a"}, {"id": "b"}]'
    assert extraction.repaired("nichts") is None and extraction.repaired(None) is None
    got = spark.createDataFrame([('x {"antwort": "ja", "konfidenz": "hoch"} y',), ("frei",)], "a string").select(extraction.generated_answer(F.col("a")).alias("r")).select("r.*").collect()
    assert [(r["antwort"], r["konfidenz"]) for r in got] == [("ja", "hoch"), ("frei", "niedrig")]
    got = extraction.answered_labels(spark.createDataFrame([(1, '[{"id":"x","norm_type":"MUST","konfidenz":"Hoch"},{"norm_type":"FOO"}]')], "batch long, answer string")).orderBy("n").collect()
    assert [(r["n"], r["norm_type"], r["level"]) for r in got] == [(1, "MUST", "hoch"), (2, "UNKNOWN", None)]


def test_document_type(spark):
    rules = {"gesetz": {"title": ["gesetz"], "signals": ["§"], "min_paragraphs": 2, "minimum": 0.5}, "leitfaden": {"title": ["leitfaden"], "minimum": 0.4}}
    kind = lambda t, x: one(spark, extraction.document_type(F.col("t"), F.lit("f"), F.col("x"), rules), t=t, x=x)
    assert (kind("Hundegesetz", "§ 1 A § 2 B"), kind("Leitfaden", "x"), kind("Gesetz", "x")) == ("gesetz", "leitfaden", "text")


def test_expansion(spark):
    found = spark.createDataFrame([(1, 10, 0.5)], "query_id long, chunk_id long, score double")
    links = spark.createDataFrame([(10, 11), (11, 12), (12, 13), (11, 10)], "chunk_id long, target long")
    assert sorted(r["chunk_id"] for r in retrieval.with_cross_references(found, links).collect()) == [10, 11, 12]
    ranked = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 5)], "query_id long, rank int, token_count long")
    assert [r["rank"] for r in retrieval.within_budget(ranked, 100).collect()] == [1]


def test_sources(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "b.txt").write_text("zwei")
    (tmp_path / "d1" / "a.txt").write_text("eins")
    assert [(r["doc_id"], r["filename"]) for r in files.listing(spark, str(tmp_path)).collect()] == [("d1", "a.txt")]
    assert one(spark, files.content_type(F.col("n")), n="X.PDF") == "application/pdf" and one(spark, files.content_type(F.col("n")), n="x") == "application/octet-stream"
    assert one(spark, files.html_text(F.col("h")), h="<p>A &amp; B</p><script>x</script><li>C</li>") == "A & B\nC"
    assert one(spark, files.joined_parts(F.col("p")), p=[" a ", "", "b"]) == "a\n\nb"
    cells = spark.createDataFrame([("s", 0, ["Name", "Alter"]), ("s", 1, ["Rex", "3"]), ("t", 0, ["1", "2"])], "sheet string, row int, values array<string>")
    assert sorted(r["prose"] for r in files.sheet_tables(cells).collect()) == ['Name "Rex": Alter ist "3".', 'Spalte 1 "1": Spalte 2 ist "2".']
    merged = files.merged_cells(spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "a"), (1, 0, 2, "b")], "table int, row int, col int, text string"))
    assert sorted(r["text"] for r in merged.collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alt", 1), ("b", "bleibt", 1)], "doc_id string, title string, version int")
    new = spark.createDataFrame([("a", "neu", 9), ("c", "dazu", 9)], "doc_id string, title string, version int")
    assert sorted(map(tuple, sinks.upserted(docs, new, "doc_id", ["title"]).collect())) == [("a", "neu", 1), ("b", "bleibt", 1), ("c", "dazu", 9)]
    twice = sinks.replaced(sinks.replaced(docs, new, "doc_id"), new, "doc_id")
    assert sorted(map(tuple, twice.collect())) == [("a", "neu", 9), ("b", "bleibt", 1), ("c", "dazu", 9)]
    sinks.write_csv(docs, str(tmp_path / "csv"))
    assert "".join(p.read_text() for p in (tmp_path / "csv").glob("part*")).startswith("﻿doc_id;title;version")
    chunks = spark.createDataFrame([(1, "A", 0, "x", "FRAGE")], "doc_id long, doc_class string, pos long, content string, chunk_type string")
    stored = sinks.stored_chunks(chunks, chunks.select("doc_id"))
    assert stored.first()["chunk_type"] == "tatbestand"
    with pytest.raises(ValueError):
        sinks.stored_chunks(chunks, chunks.where("false").select("doc_id"))
    for _ in range(2):
        sinks.write_chunks(stored, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 1


def test_landing_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 10)
    events = spark.createDataFrame([(at, "view"), (at, "view"), (at, "error")], "ts timestamp, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    stream = landing.documents(spark, str(tmp_path / "in"), events.schema)
    landing.start(stream, lambda b: landing.job_windows(b), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted((r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("error", 1), ("view", 2)]


def test_rule_entities_against_brute_force(spark):
    texts = ["Binnen zwei Wochen gilt § 12a Abs. 3 Satz 2 und Art. 5 TierSchG, unverzüglich.", "Die Übertragung nach BGB erfolgt innerhalb von drei Tagen; 14 Tage Frist, § 3", "", None, "übung, Größe, Weg."]
    got = statements.rule_entities(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")).collect()
    want = []
    for k, text in enumerate(texts):
        for label, patterns in R.NER_REGEX.items():
            want += [(k, label, i, m[0]) for i, m in enumerate(re.finditer("|".join(f"(?:{p})" for p in patterns), text or "", re.I))]
    assert sorted((r["chunk_id"], r["label"], r["i"], r["text"]) for r in got) == sorted(want)


def test_near_rules_and_strategies_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(5)), int(rng.integers(40)), str(rng.choice(["A", "B"])), str(rng.choice(["rule", "flair"])), float(rng.choice([0.5, 0.6, 0.9]))) for _ in range(400)]
    ner = spark.createDataFrame(rows, "chunk_id long, i long, label string, source string, confidence double").repartition(4)
    near = lambda r: any(m[3] == "flair" and m[0] == r[0] and m[2] == r[2] and abs(m[1] - r[1]) < 5 for m in rows)
    got = lambda s: sorted(map(tuple, statements.combined(ner, s).collect()))
    assert got("merge") == sorted(r for r in rows if r[4] >= 0.6 and (r[3] == "flair" or not near(r)))
    assert got("flair_only") == sorted(r for r in rows if r[4] >= 0.6 and r[3] == "flair") and got("rules_only") == sorted(r for r in rows if r[4] >= 0.6 and r[3] == "rule")
    with pytest.raises(ValueError):
        statements.combined(ner, "x")


@pytest.mark.parametrize("parts, budget", [(1, 0), (7, 0), (3, 9)])
def test_calls_against_a_loop(spark, parts, budget):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(30)) * 7 - 20, str(rng.choice(["kurz", "ein langer Satz mit Wörtern", "noch ein Satz, der lang ist"])), str(rng.choice(["Halten", "gilt", "Ist", None, "GILT1"])), str(rng.choice(["UNKNOWN", "MUST"]))) for i in range(600)]
    want, call = {}, 0
    for doc in sorted({r[1] for r in rows}):
        of = [r for r in rows if r[1] == doc and r[4] == "UNKNOWN"]
        for b in range(0, len(of), 4):
            call, n = call + 1, 0
            for r in of[b : b + 4]:
                pred = r[3] or ""
                reason = "Budget erreicht" if budget and call > budget else "Text zu kurz" if len(r[2]) < 15 else "Prädikat ist Substantiv" if pred and pred[0].isupper() and pred.isalpha() and len(pred) > 3 else None
                n += reason is None
                want[r[0]] = (doc, b // 4, call, n if reason is None else None, reason)
    svo = spark.createDataFrame(rows, "svo_id long, doc_id long, sentence string, predicate string, norm_type string").repartition(parts)
    assert {r["svo_id"]: (r["doc_id"], r["batch"], r["call"], r["n"], r["reason"]) for r in statements.assigned(svo, 4, budget).collect()} == want
    prompts = statements.prompt_batches(svo, 4, budget).collect()
    assert {r["call"]: r["asked"] for r in prompts} == {c: k for c in {v[2] for v in want.values()} if (k := sum(v[2] == c and v[3] is not None for v in want.values()))}
    assert all(r["prompt"].count("\n") + 1 == r["asked"] and r["prompt"].startswith("SVO-001: ") for r in prompts)
    assert statements.prompt_batches(svo.limit(0)).count() == 0


def _long_title(words: int = 20_000) -> str:
    return "§ 5 " + " ".join(["wort"] * words)


def test_reference_of_a_long_line(spark):
    got = spark.createDataFrame([(1, _long_title()), (2, "§ 7a\nTitel dazu"), (3, "§ 8, dann")], "id long, text string").select("id", T.norm_reference(F.col("text")).alias("r")).collect()
    assert {r["id"]: r["r"] for r in got} == {1: _long_title(), 2: "§ 7a Titel dazu", 3: "§ 8"}


def test_paragraph_chunks_of_a_long_title(spark):
    rows = {r["n"]: r for r in chunking.class_a(spark.createDataFrame([(1, _long_title())], "doc_id long, text string")).collect()}
    assert rows["0"]["norm_reference"] == _long_title() and rows["0"]["token_count"] == len(_long_title()) // 4 and "1.1" in rows


def test_routed_document_with_a_long_title(spark):
    text = "\n".join(["§ 1 Anfang", _long_title(), "§ 6 Ende"])
    rows = chunking.routed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r["doc_class"] for r in rows} == {"A"} and [len(r["content"]) for r in rows if r["place"] == "1/0"] == [4096]


def test_merged_labels_of_repeated_ids(spark):
    svo = spark.createDataFrame([(1, "UNKNOWN", 0.3), (1, "UNKNOWN", 0.3), (2, "MAY", 0.85)], "svo_id long, norm_type string, norm_confidence double")
    answers = spark.createDataFrame([(1, "MUST", "hoch"), (1, "MUST", "hoch"), (1, "MAY", "mittel"), (2, "MUST", "hoch")], "svo_id long, norm_type string, level string")
    assert sorted(tuple(r) for r in statements.merged_labels(svo, answers).select("svo_id", "norm_type", "norm_confidence").collect()) == [(1, "MUST", 0.9), (1, "MUST", 0.9), (2, "MAY", 0.85)]


def test_filters_on_confidence_stay_above_its_patterns(spark):
    """A filter below would compute the patterns once more for each test of its column."""
    svo = Views(spark, "/root/testdata/sf0.001").svo
    for df in (statements.filtered(svo).select("svo_id", "confidence"), catalog.QUERIES["fil_08_confident"](spark, "/root/testdata/sf0.001")):
        filters = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert any("confidence" in line for line in filters) and not any("RLIKE" in line and "verpflichtet" in line for line in filters)


@pytest.mark.parametrize("text, want", [("Er geht (heim).", "(heim"), ("a-b c-d ...!", "c-d"), ("...", None), ("wort", "wort"), ("eins\nzwei2 -\n", "zwei2"), ("§ 5 x" + "-" * 30_000 + "y" + " !" * 30_000, "x" + "-" * 30_000 + "y")])
def test_object_is_the_last_word(spark, text, want):
    docs = spark.createDataFrame([(0, text)], "doc_id long, line string")
    views = Views(spark, "")
    views.__dict__["sentences"] = docs.select(F.lit(0).cast("long").alias("chunk_id"), "doc_id", F.lit(0).cast("long").alias("pos"), F.lit("A").alias("doc_class"), F.lit("§ 1").alias("norm_reference"), F.lit(0).cast("long").alias("i"), F.col("line").alias("sentence"))
    assert views.svo.first()["object"] == want


def test_calls_find_types_once_and_batches_once(spark):
    svo = Views(spark, "/root/testdata/sf0.001").svo
    plan = statements.assigned(svo)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("RLIKE" in line and "verpflichtet" in line for line in plan.splitlines() if "Filter" in line)
    rows = spark.createDataFrame([(i, i % 2, "Ein Satz ohne jeden Typ.", "x", "UNKNOWN") for i in range(81)], "svo_id long, doc_id long, sentence string, predicate string, norm_type string")
    assert {(r["doc_id"], r["batch"], r["call"]) for r in statements.assigned(rows).collect()} == {(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5)}
