"""Whitening, the source audit and nearest neighbours, against slow versions."""

import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from lexspark.llm import bit_codes, divergence, whitening

VECTORS = "vec_id long, embedding array<float>, x string, key long, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], VECTORS).repartition(5)


def slow_whitening(rows, components=16):
    """(vec_id, component) to (n, deviation, absolute whitened, explained), by eigenvectors of the covariance."""
    whole = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in whole}:
        fit = np.array(sorted({tuple(x) for _, x in whole if len(x) == d}))
        n, sums = len(fit), fit.sum(axis=0)
        c = (n * fit - sums) / n
        e, axes = np.linalg.eigh(c.T @ c / n)
        e, axes = np.where(e > 1e-9 * max(e.max(), 1e-300), e, 0)[::-1], axes[:, ::-1]
        for i, x in whole:
            if len(x) == d:
                above = [n * a - int(b) for a, b in zip(x, sums)]
                for k in range(min(components, d)):
                    w = abs(np.array(above) / n @ axes[:, k]) / np.sqrt(e[k]) if e[k] else None
                    out.append((i, k + 1, n, sum(a * a for a in above), w, e[k] / max(e.sum(), 1e-300)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))


@pytest.mark.parametrize("d", [3, 20])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(x) for x in rng.normal(size=d) * 2.0 ** -np.arange(d) * 4]) for i in range(300)]
    rows += [(7, rows[7][1]), (300, rows[8][1]), (301, None), (302, []), (303, [None] * d), (304, [float("nan")] * d), (305, [float("inf")] * d), (None, rows[9][1]), (306, [1.0, 2.0]), (307, [1.0, 3.0]), (308, [5.0])]
    got = whitening.query(vectors(spark, rows)).collect()
    order = lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["component"], r["n"], r["deviation"])
    want = slow_whitening(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), want):
        assert (g["vec_id"], g["component"], g["n"], g["deviation"]) == w[:4] and g["deviation_exact"] == w[3]
        assert (g["whitened"] is None) == (w[4] is None) and (w[4] is None or abs(abs(g["whitened"]) - w[4]) < 1e-6) and abs(g["explained"] - w[5]) < 1e-9
    for many in {r["n"] for r in got}:
        errors = {r["identity_error"] for r in got if r["n"] == many}
        assert len(errors) == 1 and (errors == {None} or max(errors) < 1e-9)


def test_whitening_of_few_rows(spark):
    assert whitening.query(vectors(spark, [])).collect() == []
    assert whitening.query(vectors(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.query(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(i, k, 1, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)}


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(i, [float(2**40 * i), float(-(2**41) * (i % 3))]) for i in range(40)]
    got = whitening.query(vectors(spark, rows)).collect()
    x = [[64 * int(c) + 1000000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {(r["vec_id"], r["deviation_exact"]) for r in got} == {(i, Decimal(v)) for i, v in want.items()}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None) for r in got) and max(r["identity_error"] for r in got) < 1e-9


def test_whitening_does_not_square_the_condition(spark):
    """A spread of 1 beside one of 10^8, whose square is lost in a covariance."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(2**31), 2**31, 400), rng.integers(-4, 4, 400)
    rows = [(i, [float(np.float32(p)) / 64, float(q) / 64]) for i, (p, q) in enumerate(zip(a, b))]
    got = whitening.query(vectors(spark, rows)).collect()
    assert max(r["identity_error"] for r in got) < 1e-7


def slow_audit(rows):
    docs = [tuple(v or "" for v in r) for r in rows]
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, source, pattern.findall(text.translate(lowered))) for lang, source, text in docs]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for g, _, words in found if g == lang for t in set(words))
        kept = sorted(t for t, n in held.items() if n >= 10)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        counts = {s: Counter(t for g, o, words in found if g == lang and o == s for t in words if t in set(kept)) for s in sources}
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        total = sum(counts.values(), Counter())
        for s in sources:
            pairs = [(-sum(f(share(counts[s], t), share(counts[o], t)) for t in kept), o) for o in sources if o != s]
            own = [(-f(share(counts[s], t), share(total, t)), t) for t in kept if counts[s][t] and share(counts[s], t) > share(total, t)]
            for part, items in (("pair", pairs), ("term", own)):
                ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < 10]
    return sorted(out)


def test_source_audit(spark):
    rng = np.random.default_rng(9)
    words = ["Straße", "straße", "WORT", "wort", "ÄPFEL", "äpfel", "日本", "🎉", "don't", "x1y", "a\x00b", "ﬁ", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for _ in range(400):
        source = None if rng.random() < 0.1 else f"s{min(int(rng.zipf(1.6)), 7)}"
        lang = None if rng.random() < 0.1 else str(rng.choice(["de", "en"]))
        rows.append((lang, source, " ".join(words[min(int(rng.zipf(1.4)) - 1, len(words) - 1)] for _ in range(rng.integers(0, 30)))))
    rows += [("fr", "s1", None), ("fr", "s2", "selten"), ("it", "s1", ""), (None, None, None), ("de", "leer", "123 --"), *[("de", "s1", "immer gleich")] * 12]
    docs = spark.createDataFrame([(g, s, t, "x", 1, 2) for g, s, t in rows], "lang string, source string, text string, term string, count long, p long").repartition(4)
    got = sorted(tuple(r) for r in divergence.query(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == slow_audit(rows)
    assert divergence.query(docs.limit(0)).count() == 0


def test_source_audit_hands_on_what_it_holds(spark, monkeypatch):
    rows = [("de", f"s{i % 3}", f"eins zwei drei{'xyz'[i % 3]} " * (i % 4)) for i in range(60)]
    monkeypatch.setattr(divergence, "HELD", 2)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict(dict(zip("gst", map(list, zip(*rows[i : i + 7]))))) for i in range(0, 60, 7)]
    total = Counter()
    parts = list(divergence._counted(iter(batches)))
    for part in parts:
        for row in part.to_pylist():
            total[row["lang"], row["source"], row["term"]] += row["count"]
    assert len(parts) > 3 and total == Counter((g, s, t) for g, s, text in rows for t in text.split())


def nearest(rows, k=10):
    good = [(i, np.array([np.float32(x) for x in v], float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0 and (i not in asked or tuple(v) < tuple(asked[i])):
            asked[i] = v
    out = []
    for q, w in asked.items():
        best = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(w))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out)


ODD = [(9000, None), (9100, [1.0, None, 2.0, 1.0]), (9200, [float("nan")] * 4), (9300, [float("inf")] * 4), (9400, []), (9500, [0.0] * 4), (None, [1.0] * 4), (9600, [1.0, 2.0]), (9601, [2.0, 2.0]), (9602, [2.0, 2.0]), (9700, [3.0])]


@pytest.mark.parametrize("kind", ["random", "clustered", "ties", "one hot", "few"])
def test_neighbours(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    n, d = (8, 4) if kind == "few" else (1500, 24)
    m = rng.normal(size=(n, d))
    if kind == "clustered":
        m = rng.normal(size=(20, d))[rng.integers(20, size=n)] * 5 + m * 0.2
    if kind == "ties":
        m = rng.integers(0, 2, size=(n, 4)).astype(float)
    if kind == "one hot":
        m[rng.random(n) < 0.35] = m[0]
    monkeypatch.setattr(bit_codes, "TURN", 6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(0, [float(x) for x in m[1]])] * 2 + ODD
    got = sorted(tuple(r) for r in bit_codes.query(vectors(spark, rows)).collect())
    want = nearest(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    exact = {r[:3]: r[3] for r in nearest(rows, len(rows))}
    hit = sum(abs(a[3] - b[3]) < 1e-9 and a[2] == b[2] for a, b in zip(got, want))
    assert hit >= (0.97 * len(want) if kind not in ("ties", "few") else len(want))
    scores = {}
    for (q, _, i), s in exact.items():
        scores.setdefault((q, i), []).append(s)
    assert all(min(abs(s - x) for x in scores[q, i]) < 1e-12 for q, _, i, s in got)


def test_neighbours_of_nothing(spark):
    assert bit_codes.query(vectors(spark, [])).collect() == []
    assert bit_codes.query(vectors(spark, [(1, [1.0, 2.0]), (100, [0.0, 0.0])])).collect() == []
    assert bit_codes.query(vectors(spark, [(100, [1.0, 2.0])])).collect() == []


def test_bounds_hold_and_few_codes_are_reranked():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4000, 64))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    model = bit_codes.Codes.fit(v[:1000])
    near, codes, norm, own, of_centre = model.encode(v)
    assert codes.shape == (4000, bit_codes.BITS // 8)
    lower, upper = model.bounds(near, codes, norm, own, of_centre, v[:40])
    true = bit_codes._squared(v, v[:40])
    assert ((lower <= true + 1e-9) & (true <= upper + 1e-9)).mean() > 0.93
    kept = lower <= np.sort(upper + 9 * (true < 1e-12), axis=0)[9]
    best = np.argsort(true + 9 * (true < 1e-12), axis=0)[:10]
    assert np.take_along_axis(kept, best, 0).mean() > 0.97 and kept.mean() < 0.12
