"""Operators on documents over rows with nulls, empty and long texts, ties, repeats, clashing columns, and none at all."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexspark.llm import bpe_model, common, fingerprints, jaccard_join, language, line_dedup, packing, sharding, token_store, tokens
from lexspark.llm.shingles import shingles
from lexspark.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, shard string, score string, line string, node string, ids string"
BYTE, MULTI = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = "\n".join(f"Zeile {i} " + " ".join(WORDS[(i * 7 + j) % 20] + str((i * j) % 13) for j in range(30)) for i in range(400))
BASE = " ".join(f"{w}{i}" for i in range(5) for w in WORDS)
NEAR = BASE.replace("kappa2", "changed")


def rows():
    texts = [
        (1, "Der Hund und die Katze sind im Garten, das ist gut.\nZweite Zeile hier mit Text.", "de"), (2, None, "de"), (3, "", "en"), (4, LONG, "en"), (5, BASE, "en"), (6, BASE, "en"), (7, NEAR, "en"),
        (8, BASE, None), (None, BASE, "en"), (9, "a b", "en"), (10, "  two  spaces \t tab\r\n\n", "en"), (11, "12345 !!!", None), (12, "日本語のテキスト 🎉 <|endoftext|>", "ja"), (13, " thin", "en"),
        (5, BASE, "en"), (14, "the cat and the dog are in the house and it is good", "en"), (15, "Der Hund und die Katze sind im Garten, das ist sehr gut.", "de"),
    ]
    return [(d, t, g, "s", len(t or ""), "x", "y", "z", "l", "n", "i") for d, t, g in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(BYTE)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_table_s_ids_are_the_library_s(monkeypatch):
    texts = [r[1] for r in rows()] + ["it's  x", "a\n b", " a", "b ", "x\x00y z", "\n", " ", "a\n\nb", "a\n", "a.\nb c.", "“hi” he", "a\u3000 b", "é" * 40 + " é", "x<|endoftext|>y"]
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", 200)
    monkeypatch.setattr(tokens, "_STEP", 60)  # so that the table forgets, again and again
    table = tokens.library_table.__wrapped__(vocabulary_path(BYTE))
    for _ in range(2):
        ids, bounds = table.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [ids_of(t) for t in texts]
    ids, bounds = table.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_token_files(docs, none, tmp_path):
    got = token_store.query(docs, vocabulary_path(BYTE), str(tmp_path / "files")).collect()
    ordered = sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for doc, text in ordered:
        ids = [*ids_of(text), 2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.query(none, vocabulary_path(BYTE), str(tmp_path / "none")).count() == 0


def test_damaged_block_is_found(docs, spark, tmp_path):
    place = str(tmp_path / "files")
    token_store.encode(docs, vocabulary_path(BYTE)).write.parquet(place)
    damaged = spark.read.parquet(place).withColumn("crcs", F.transform("crcs", lambda c: c + 1))
    with pytest.raises(Exception, match="checksum"):
        token_store.decode(damaged).collect()


def test_packing(docs, none):
    got = packing.pack(docs, vocabulary_path(BYTE)).collect()
    texts = {}
    for doc, text in {(r[0], r[1]) for r in rows()}:
        texts[doc] = [*ids_of(text), 0]
    seen, spans = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and ids == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(texts[r["doc_id"]])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(seen[d] == len(t) * (2 if d == 5 else 1) for d, t in texts.items())
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(none, vocabulary_path(BYTE)).count() == 0


def test_levels_minimise_squares():
    packer = packing.SumOfSquares(16)
    for i, size in enumerate([5, 3, 7, 3, 3, 5, 9, 2, 6, 11, 4, 4, 1, 13]):
        before = packer.levels.copy()
        best = min(_after(before, h, size) for h in range(17 - size) if h == 0 or before[h])
        packer.add((i, 0, size, size, b"0000" * size))
        assert int((packer.levels.astype(int) ** 2).sum()) == best


def test_most_items_stay_where_sums_of_squares_put_them():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1500, 4000)
    packer = packing.SumOfSquares(1024)
    made = list(packing.windows(((i, np.full(n, i)) for i, n in enumerate(sizes)), packer))
    assert sum(x[2] for held in made for x in held) == sizes.sum()
    lengths = [sum(x[2] for x in held) for held in made]
    assert all(n == 1024 for n in lengths[:-10]) and all(n & (n - 1) == 0 for n in lengths)
    assert packer.topped < 0.12 * sizes.sum()


def _after(levels, h, size):
    new = levels.copy()
    if h:
        new[h] -= 1
    if h + size < 16:
        new[h + size] += 1
    return int((new.astype(int) ** 2).sum())


def test_byte_bpe_codec(docs, none):
    import public_tokenizers
    import tiktoken

    ranks = bpe_model.read_ranks(vocabulary_path(MULTI))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in ((r[0], r[1] or "") for r in rows()):
        ids = own.encode_ordinary(text)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe_model.query(docs, vocabulary_path(MULTI)).collect()]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe_model.query(none, vocabulary_path(MULTI)).count() == 0


def test_fingerprints(docs, none):
    got = sorted(map(tuple, fingerprints.query(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ordered = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in ordered]
    edited = [t[: len(t) - len(t) // 4] + o[: len(t) // 4] for t, o in zip(texts, texts[1:] + texts[:1])]
    assert [(r[0], r[1], r[2]) for r in got] == [(d, len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, t), e in zip(ordered, edited)]
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got)
    long = next(r for r in got if r[0] == 4)
    assert long[5] > 0.6 and long[6] < 0.1
    assert len({r[3] for r, t in zip(got, texts) if t == BASE}) == 1
    assert fingerprints.query(none).count() == 0


def slow_fingerprint(text):
    """Chunks byte by byte: the end is the first place past the least size that the mask of its size allows."""
    data, out, start = text.encode(), {}, 0
    h, hashes = 0, []
    for b in data:
        h = (h << 1) + int(fingerprints.GEAR[b]) & 0xFFFFFFFF
        hashes.append(h)
    while start < len(data):
        end = start
        while True:
            end += 1
            size = end - start
            mask = int(fingerprints.STRICT) if size <= fingerprints.NORMAL else int(fingerprints.LOOSE)
            if end == len(data) or size == fingerprints.LARGEST or size >= fingerprints.LEAST and hashes[end - 1] & mask == 0:
                break
        digest = xxhash.xxh3_64_hexdigest(data[start:end])
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def slow_likeness(a, b):
    if not a or not b:
        return float(a == b)
    both = sum(min(n, b.get(d, 0)) for d, n in a.items())
    return both / max(sum(a.values()), sum(b.values()))


def test_fingerprints_against_brute_force(docs):
    got = {r["doc_id"]: r for r in fingerprints.query(docs.where("doc_id <> 5")).collect()}
    texts = sorted((r[0], r[1] or "") for r in rows() if r[0] is not None and r[0] != 5)
    for i, (doc, text) in enumerate(texts):
        other = texts[(i + 1) % len(texts)][1]
        k = len(text) // 4
        own, new, its = slow_fingerprint(text), slow_fingerprint(text[: len(text) - k] + other[:k]), slow_fingerprint(other)
        r = got[doc]
        assert r["fingerprint"] == fingerprints.as_text(own) and r["edited_fingerprint"] == fingerprints.as_text(new)
        assert abs(r["near_edited"] - slow_likeness(own, new)) < 1e-12 and abs(r["near_next"] - slow_likeness(own, its)) < 1e-12


def test_chunks_shift_with_their_text():
    mine, shifted = fingerprints.fingerprint(LONG), fingerprints.fingerprint("inserted " + LONG)
    assert fingerprints.containment(mine, shifted) > 0.98
    data = LONG.encode()
    slow = [sum(int(fingerprints.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(200)]
    assert fingerprints.gear_hashes(data)[:200].tolist() == slow


def test_language(docs, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.query(docs).collect()}
    assert {(2, "und"), (3, "und"), (11, "und"), (15, "de"), (14, "en")} <= got
    assert language.query(none).count() == 0


def slow_language(training, texts):
    """Nearest centroids recomputed text by text with dictionaries, for languages of one training text (its own centroid)."""

    def grams(text):
        data = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode().split()) + b" "
        found = {}
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                g = int.from_bytes(data[i : i + n], "big") ^ (n << 28 if n > 1 else 0)
                place = (g * 2654435761 & 0xFFFFFFFF) >> 20
                found[place] = found.get(place, 0) + 1
        return found

    rows = [grams(t) for t, _ in training]
    idf = lambda p: np.log((1 + len(rows)) / (1 + sum(p in r for r in rows))) + 1

    def vector(found):
        v = {p: np.log1p(n) * idf(p) for p, n in found.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {p: x / norm for p, x in v.items()}

    centroids = [(lang, vector(r)) for (_, lang), r in zip(training, rows)]
    out = []
    for t in texts:
        v = vector(grams(t))
        out.append(max((sum(x * c.get(p, 0) for p, x in v.items()), lang) for lang, c in centroids))
    return out


def test_language_against_brute_force(spark):
    training = [("Der Hund und die Katze sind im Garten", "de"), ("the cat and the dog are in the house", "en"), ("le chat et le chien sont là", "fr")]
    texts = ["die Katze ist im Haus", "the house of the dog", "un chien, là!", "Gärten 123"]
    model = language.fit(spark.createDataFrame(training, "text string, lang string"))
    found, score, _ = model.predict(texts)
    for name, s, (want, lang) in zip(found, score, slow_language(training, texts)):
        assert name == lang and abs(s - want) < 1e-4


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.query(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


def jaccard_classes(texts):
    sets = [frozenset(shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(texts)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if (a or b) and 5 * len(a & b) >= 4 * len(a | b) or not a and not b and texts[i] is not None and texts[i] == texts[j]:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return links, [find(i) for i in range(len(texts))]


def test_languages_of_one_copied_text_have_centroids(spark):
    notices = spark.createDataFrame([(f"Hinweis {i} {WORDS[i]} zu {WORDS[i + 6]}", f"l{i}") for i in range(6)], "text string, lang string")
    model = language.fit(notices.crossJoin(spark.range(2000)))
    assert model.languages == [f"l{i}" for i in range(6)]


def test_jaccard_join(docs, none):
    own = [(r[0], r[1]) for r in rows()]
    links, root = jaccard_classes([t for _, t in own])
    got = jaccard_join.classified(docs).collect()
    assert sorted((r["doc_id"] or 0, r["links"]) for r in got) == sorted((d or 0, n) for (d, _), n in zip(own, links))
    assert sum(r["stays"] for r in got) == len(set(root))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert jaccard_join.query(none).count() == 0


def test_jaccard_join_finds_what_brute_force_finds(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    links, root = jaccard_classes([r["text"] for r in table])
    got = sorted(jaccard_join.query(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())
    assert [r["links"] for r in got] == links
    assert [r["class_id"] for r in got] == [table[i]["doc_id"] for i in root]


def test_jaccard_join_broadcasts_nothing(spark):
    before = plans_so_far(spark)
    assert jaccard_join.query(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count() > 100
    plans = {k: x for k, x in plans_so_far(spark).items() if k not in before}
    assert len(plans) > 10 and not [x for x in plans.values() if "Broadcast" in x]


def plans_so_far(spark):
    """The last plan of each execution so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(300)]
    got = jaccard_join.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["links"] for r in got} == {299}


def test_forest_finds_the_links_of_families(spark, monkeypatch):
    """Texts that drift apart word by word: most links are near the threshold. Small chunks, so that clusters form."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    rng = np.random.default_rng(4)
    texts = []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(150)]
        for k in range(30):
            words = list(words)
            words[rng.integers(150)] = f"f{family}n{k}"
            texts.append(" ".join(words))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    links, root = jaccard_classes(texts)
    got = sorted(jaccard_join.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert sum(r["links"] for r in got) >= 0.99 * sum(links) and all(r["links"] <= n for r, n in zip(got, links))
    assert [r["class_id"] for r in got] == root


def test_prefixes_are_shortened_until_the_recall():
    depth = jaccard_join.shortest_prefix(jaccard_join.SIMILARITY, jaccard_join.RECALL)
    assert jaccard_join.chance(0.8, depth) >= jaccard_join.RECALL > jaccard_join.chance(0.8, depth + 1)


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[None] == BASE and got[6] == "" and got[8] == "" and got[2] is None and got[3] == ""
    assert 100 < len(got[4].split("\n")) < 400 and set(got[4].split("\n")) < set(LONG.split("\n"))  # it holds fuzzy copies of its own lines
    assert got[1] == rows()[0][1] and got[15] == rows()[16][1]
    assert line_dedup.query(none).count() == 0


def kept_by_brute_force(texts):
    """The texts that stay, for (doc_id, text) in order."""
    first = {}
    for doc, text in texts:
        for pos, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (doc, pos))
    lines = list(first)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    root = list(range(len(lines)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    where = {}
    for i, s in enumerate(sets):
        near = {}
        for shingle in s:
            for j in where.setdefault(shingle, []):
                near[j] = near.get(j, 0) + 1
            where[shingle].append(i)
        for j, n in near.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    best = {}
    for i, x in enumerate(lines):
        best[find(i)] = min(best.get(find(i), first[x]), first[x])
    stay = set(best.values())
    want = ["\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or (d, p) in stay) for d, t in texts]
    return want


def test_line_dedup_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = kept_by_brute_force(sorted(map(tuple, table.collect())))
    got = [r["text"] for r in sorted(line_dedup.query(table).collect())]
    assert sum(a != b for a, b in zip(got, want)) <= 2  # recall of the bands


def test_line_dedup_recall_in_families(spark):
    """Lines that are edited again and again, so that many pairs lie near the threshold."""
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    made = []
    for _ in range(40):
        line = list(rng.choice(letters, 120))
        for _ in range(25):
            line = list(line)
            line[rng.integers(120)] = rng.choice(letters)
            made.append("".join(line).strip() + ".")
    order = rng.permutation(len(made))
    texts = [(int(i), made[k]) for i, k in enumerate(order)]
    want = kept_by_brute_force(texts)
    got = [r["text"] for r in sorted(line_dedup.query(spark.createDataFrame(texts, "doc_id long, text string")).collect())]
    gone = [i for i, x in enumerate(want) if not x]
    assert len(gone) > 500 and sum(got[i] == "" for i in gone) >= 0.97 * len(gone)
    assert all(a == b or b == "" for a, b in zip(got, want))  # nothing goes without a link


def test_line_dedup_tells_repeated_ids_apart(spark):
    rows = [(None, "the same line stands here\nand one of the first"), (None, "the same line stands here\nand one of the second text"), (None, "the same line stands here\nand one of the first"), (1, None), (1, ""), (1, "the same line stands here")]
    got = [(r[0], r[1]) for r in line_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum("the same line" in (t or "") for _, t in got) in (1, 2)  # two rows that are equal stay alike
    assert len({t for _, t in got if t and "the same line" in t}) == 1 and got.count((1, "")) == 2 and (1, None) in got




def test_line_dedup_links_all_copies_of_a_base(spark):
    base = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(4))[:107]
    edited = [base[: i % 100 + 3] + "#+~"[i // 100] + base[i % 100 + 4 :] for i in range(300)]  # 0.85 like the base, most 0.72 like each other
    table = spark.createDataFrame([(i, x) for i, x in enumerate([*edited[:150], base, *edited[150:]])], "doc_id long, text string")
    assert [r["doc_id"] for r in line_dedup.query(table).where("text <> ''").collect()] == [0]


def test_line_dedup_finds_short_near_copies(spark):
    pairs = []
    for i in range(3000):
        x = "".join(hashlib.md5(str(i).encode()).hexdigest())[:16]  # 9 shingles; one more is 0.9, two more 0.82
        pairs += [x, x + "#+"]
    table = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    assert line_dedup.query(table).where("text <> ''").count() <= 3000 * 1.015  # at 0.82 and 0.9 the bands find 0.994 and more


def test_line_dedup_moves_texts_instead_of_shingle_sets(spark):
    """A set has 8 bytes for each character; what is written for long near copies stays below their texts' size."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    base = ["".join(rng.choice(letters, 20_000)) for _ in range(20)]
    table = spark.createDataFrame([(2 * i + k, x + "#" * k) for i, x in enumerate(base) for k in (0, 1)], "doc_id long, text string").cache()
    tables = []
    own = line_dedup.written
    try:
        line_dedup.written = lambda df, name: tables.append(own(df, name)) or tables[-1]
        assert [r["doc_id"] for r in line_dedup.query(table).where("text <> ''").orderBy("doc_id").collect()] == list(range(0, 40, 2))
    finally:
        line_dedup.written = own
    longs = [c for t in tables for c in t.dtypes if c[1] == "array<bigint>" and c[0] not in ("bits", "buckets")]
    assert not longs


def test_line_dedup_makes_the_sets_of_a_pair_once(spark):
    pairs = spark.createDataFrame([(1, 2, 0)], "hub long, h long, part int")
    texts = spark.createDataFrame([(1, 1, "the same long line of words"), (2, 2, "the same long line of words!")], "h long, g int, line string")
    found = line_dedup.verified(pairs, texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 2  # one a side
    assert [(x.u.h, x.v.h) for x in found.collect()] == [(1, 2)]


def test_line_dedup_rules_out_pairs_below_the_threshold_by_bitmaps(spark):
    """Lines of one family, each pair of which has a similarity of 0.7: all share buckets, and none is worth a look at its text."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    base = "".join(rng.choice(letters, 1007))
    table = spark.createDataFrame([(i, base[: 81 * i] + "".join(rng.choice(letters, 81)) + base[81 * i + 81 :]) for i in range(12)], "doc_id long, text string")
    own, wanted, dealt = line_dedup.written, [], []

    def counted(df, name):
        found = own(df, name)
        {"line-wanted": wanted, "line-chunks": dealt}.get(name, []).append(found.count())
        return found

    try:
        line_dedup.written = counted
        assert line_dedup.query(table).where("text <> ''").count() == 12
    finally:
        line_dedup.written = own
    assert dealt[0] > 12 and wanted == [0]


def test_language_frees_the_table_of_ids():
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    held = tokens.library_table(path)
    tokens.released()
    assert tokens.library_table.cache_info().currsize == 0
    assert tokens.library_table(path) is not held


def test_language_holds_few_vectors_at_a_time():
    texts = [None, "", "12", *(f"{'abcdefgh'[i % 8]}ort und satz {i}" for i in range(1500))]
    idf = np.ones(language.DIMENSIONS, np.float32)
    centroids = np.array([language.vectors([t], idf) for t in ("aort und satz", "gort und satz")], np.float32)
    model = language.Model(["a", "g"], idf, centroids, np.array([0.4, 0.5]))
    tracemalloc.start()
    got = model.predict(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # of all texts at once: over 70 MB
    each = [model.predict([t]) for t in texts]
    assert got[0] == [x[0][0] for x in each] and got[2] == [x[2][0] for x in each] and np.allclose(got[1], [x[1][0] for x in each])


def test_packing_slices_large_batches():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": [f"x{i}" if i % 7 else None for i in range(1000)]})
    parts = list(common.sliced([batch]))
    assert max(p.num_rows for p in parts) == common.ARROW_ROWS and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_sharding(docs, none):
    got = sharding.query(docs).collect()
    assert len(got) == len(rows())
    sizes = sorted((r["doc_id"] or 0, r["size"], r["text_crc32"] or 0) for r in got)
    assert sizes == sorted((r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32(r[1].encode()) if r[1] is not None else 0) for r in rows())
    check_shards(got)
    assert sharding.query(none).count() == 0


def check_shards(got, shards=24):
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def split_rows(labels):
    """Rows outside the shard that holds most of their group: (group, shard) to these rows."""
    where = {}
    for group, shard in labels:
        where.setdefault(group, {}).setdefault(shard, []).append(1)
    return sum(sum(map(len, x.values())) - max(map(len, x.values())) for x in where.values())


def test_sharding_keeps_groups_together(spark):
    texts = [(i, "hot" if i % 3 == 0 else f"pair {i // 4}" if i % 5 else f"own {i}") for i in range(3000)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = sharding.query(table).collect()
    check_shards(got)
    where = {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(where[zlib.crc32(b"hot")]) <= 9  # a third of all rows fills 8 of 24 shards
    assert sum(len(x) > 1 for x in where.values()) < 0.15 * len(where)


def test_label_propagation_lowers_the_cut(spark):
    texts = [(i, f"group {i % 500}" if i % 4 else f"own {i}") for i in range(6000)]
    rows = sharding.nodes(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    cut = [split_rows((r["digest"], r["label"]) for r in sharding.labelled(rows, rounds=n).collect()) for n in (0, 1, 3, 5)]
    assert cut[0] > 1000 > cut[1] >= cut[2] >= cut[3] and cut[3] < 0.05 * cut[0]
    loads = sharding.labelled(rows).groupBy("label").count().collect()
    assert len(loads) == 24 and max(r["count"] for r in loads) < 1.2 * 6000 / 24
