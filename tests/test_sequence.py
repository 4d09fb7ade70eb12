import math
import random

import pytest

from sitefold.functions import tails
from sitefold.operators import sequence as sq

AA = "ACDEFGHIKLMNPQRSTVWY"


def test_window_padding_and_bounds(spark):
    seqs = spark.createDataFrame([("G", "ABCDEFGHIJKLMNOPQRST")], "id string, seq string")
    sites = spark.createDataFrame([("G", s) for s in (1, 8, 20, 63, 64, -42, -43)] + [("none", 3), (None, 1)], "gene string, site int")
    got = {r.site: r.window for r in sq.site_windows(sites, seqs, "gene").collect()}
    pad = "_" * 50 + "ABCDEFGHIJKLMNOPQRST" + "_" * 50
    want = {s: pad[s - 7 + 50 - 1 : s - 7 + 50 + 14] for s in (1, 8, 20, 63, -42)}
    assert got == want
    assert got[1] == "_______ABCDEFGH" and got[8] == "ABCDEFGHIJKLMNO" and got[63] == "_" * 15


def test_first_or_all_residues(spark):
    df = spark.createDataFrame([("AP[69.9456]GPR", 10), ("GGG", 1)], "seq string, start int")
    every = sq.residue_sites(df, "seq", {"P[69.9456]": "P"}, "start", "P").collect()
    assert sorted(r.site for r in every) == [11, 13]
    first = sq.residue_sites(df, "seq", {"P[69.9456]": "P"}, "start", "P", first_only=True).collect()
    assert [r.site for r in first] == [11]


def test_tagged_site(spark):
    df = spark.createDataFrame([("n[42.0106]AM[15.9949]P[69.9456]K", 5), ("AAK", 1)], "seq string, start int")
    got = sq.tagged_site(df, "seq", {"n[42.0106]": "", "M[15.9949]": "M"}, "start").collect()
    assert [(r.site, r.residue) for r in got] == [(7, "P")]


def test_text_windows_brute(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("aTé\n b") for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(30)]
    df = spark.createDataFrame(texts, "i int, t string")
    got = sorted(tuple(r) for r in sq.text_windows(df, ["i"], "t", "T").collect())
    want = sorted(
        (i, k + 1, ("_" * 7 + t + "_" * 7)[k : k + 15]) for i, t in texts for k, ch in enumerate(t) if ch == "T"
    )
    assert got == want


def windows(rng, n, centre="S", hot=None):
    out = []
    for _ in range(n):
        w = [rng.choice(AA) for _ in range(15)]
        w[7] = centre
        for p, a in (hot or {}).items():
            w[p] = a
        out.append(("".join(w),))
    return out


def brute_motifs(fg, bg, centre, min_seqs, cutoff):
    fg, bg = [w for w in fg if w[7] == centre], [w for w in bg if w[7] == centre]
    out = []
    while len(fg) >= min_seqs and bg:
        f, b, fixed, score = fg, bg, {7: centre}, 0.0
        while True:
            best = None
            if len(f) >= min_seqs and b:
                for p in range(15):
                    for a in AA:
                        if p in fixed:
                            continue
                        n = sum(w[p] == a for w in f)
                        if n < min_seqs:
                            continue
                        pv = max(tails.binom_upper(n, len(f), sum(w[p] == a for w in b) / len(b)), 1e-16)
                        if pv < cutoff and (best is None or (pv, -n, p, a) < best):
                            best = (pv, -n, p, a)
            if best is None:
                break
            pv, _, p, a = best
            fixed[p], score = a, score - math.log10(pv)
            f, b = [w for w in f if w[p] == a], [w for w in b if w[p] == a]
        if len(fixed) == 1:
            break
        hit = lambda w: all(w[p] == a for p, a in fixed.items())
        out.append(("".join(fixed.get(i, ".") for i in range(15)), len(f), len(fg), len(b), len(bg), round(score, 6)))
        fg, bg = [w for w in fg if not hit(w)], [w for w in bg if not hit(w)]
    return out


def test_motif_search_against_brute_force(spark):
    rng = random.Random(5)
    bg = windows(rng, 500)
    fg = windows(rng, 60) + windows(rng, 50, hot={8: "P"}) + windows(rng, 40, hot={4: "R", 5: "R"}) + windows(rng, 25, hot={8: "P", 2: "E"})
    fg += [("short",), ("_" * 7 + "S" + "A" * 7,)]
    s = "window string"
    got = sq.motif_enrich(spark.createDataFrame(fg, s), spark.createDataFrame(bg, s), "S", AA, min_seqs=20, p_cutoff=1e-6)
    rows = [(r.motif, r.fg_matches, r.fg_size, r.bg_matches, r.bg_size, round(r.score, 6)) for r in got.orderBy("ord").collect()]
    want = brute_motifs([w for (w,) in fg if len(w) == 15], [w for (w,) in bg], "S", 20, 1e-6)
    assert rows == want and len(rows) >= 2
    none = sq.motif_enrich(spark.createDataFrame(bg[:50], s), spark.createDataFrame(bg, s), "S", AA, min_seqs=20)
    assert none.count() == 0


def test_motif_steps_read_the_windows_of_their_first_residue(spark, monkeypatch):
    """Only the first step of a search counts over all windows, and motifs with and without
    shared residues come out as by brute force when few indexes are kept."""
    rng = random.Random(8)
    bg = windows(rng, 600)
    fg = windows(rng, 50) + windows(rng, 70, hot={8: "P", 2: "E"}) + windows(rng, 60, hot={8: "P", 4: "R", 5: "R"})
    fg += windows(rng, 50, hot={8: "D", 2: "E"}) + windows(rng, 40, hot={4: "R", 12: "K"}) + windows(rng, 30, hot={8: "P"})
    monkeypatch.setattr(sq, "KEPT_INDEXES", 1, raising=False)
    calls, cells = [], sq._cells

    def counted(index, letters, width, fixed, removed):
        calls.append((len(fixed), index))
        return cells(index, letters, width, fixed, removed)

    monkeypatch.setattr(sq, "_cells", counted)
    s = "window string"
    got = sq.motif_enrich(spark.createDataFrame(fg, s), spark.createDataFrame(bg, s), "S", AA, min_seqs=20, p_cutoff=1e-6)
    rows = [(r.motif, r.fg_matches, r.fg_size, r.bg_matches, r.bg_size, round(r.score, 6)) for r in got.orderBy("ord").collect()]
    assert rows == brute_motifs([w for (w,) in fg], [w for (w,) in bg], "S", 20, 1e-6) and len(rows) >= 4
    whole = calls[0][1]
    assert calls[0][0] == 1 and all(index is not whole for _, index in calls[1:])


def test_text_windows_beyond_the_basic_plane(spark):
    rows = [(1, "🙂T🙂", True), (2, None, None), (3, "", False), (None, "x" * 9 + "T" + "é" * 9 + "T", None)]
    df = spark.createDataFrame(rows, "i int, t string, good boolean")
    got = [tuple(r) for r in sq.text_windows(df, ["i", "good"], "t", "T").collect()]
    want = [(i, g, k + 1, ("_" * 7 + t + "_" * 7)[k : k + 15]) for i, t, g in rows for k, c in enumerate(t or "") if c == "T"]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 3
    first = sq.text_windows(df, ["i"], "t", "T", first_only=True).collect()
    assert sorted((r.i or 0, r.site) for r in first) == [(0, 10), (1, 2)]


def test_position_enrich_brute(spark):
    rng = random.Random(6)
    fg, bg = windows(rng, 40, hot={8: "P"}), windows(rng, 90)
    fg += fg[:10] + [("_" * 7 + "S" + "A" * 7,)]
    s = "window string"
    got = {(r.pos, r.residue): r for r in sq.position_enrich(spark.createDataFrame(fg, s), spark.createDataFrame(bg, s), AA).collect()}
    assert len(got) == 15 * 20
    uf, ub = {w for (w,) in fg}, {w for (w,) in bg}
    for pos in (1, 8, 9):
        fa = sum(w[pos - 1] in AA for w in uf)
        for a in "PSA":
            f, b = sum(w[pos - 1] == a for w in uf), sum(w[pos - 1] == a for w in ub)
            r = got[(pos, a)]
            assert (r.fg, r.bg, r.fg_all, r.bg_all) == (f, b, fa, len(ub))
            assert abs(r.difference - (f / fa - b / len(ub))) < 1e-12
            p = tails.fisher_two_sided(f, fa - f, b, len(ub) - b)
            assert abs(r.p - p) < 1e-12
            assert abs(r.score - (r.difference * 100 if p <= 0.05 else 0.0)) < 1e-9


def test_proteome_background_z(spark):
    rng = random.Random(7)
    prot = spark.createDataFrame([(i, "".join(rng.choice(AA) for _ in range(300))) for i in range(20)], "id int, seq string")
    bg = sq.all_residue_windows(prot, "S")
    assert bg.count() == sum(r.seq.count("S") for r in prot.collect())
    fg = spark.createDataFrame(windows(rng, 40, hot={8: "P"}), "window string")
    rows = {(r.pos, r.residue): r for r in sq.position_enrich_z(fg, bg, AA, "id", subsamples=5).collect()}
    hot = rows[(9, "P")]
    assert hot.n == 40 and hot.z > 3 and hot.p < 0.05 and hot.score > 50
    assert abs(sum(rows[(9, a)].difference for a in AA)) < 1e-9


@pytest.mark.parametrize("unique", [True, False])
def test_position_counts_weights(spark, unique):
    df = spark.createDataFrame([("ab",), ("ab",), ("cb",)], "window string")
    got = {(r.pos, r.residue): r.n for r in sq.position_counts(sq.weighted_windows(df, "window", unique)).collect()}
    k = 1 if unique else 2
    assert got == {(1, "a"): k, (1, "c"): 1, (2, "b"): k + 1}
