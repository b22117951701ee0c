"""Loci against loops that take one gene at a time, and distances by intervals against those by joins."""

import random

from pyspark.sql import functions as F

from weftline.operators import loci, proxies, tree

CANDIDATE = "clan int, ome int, scaffold int, first int, last int, set_id string, score double"


def similarity_frame(spark, known):
    table = spark.createDataFrame([(a, b, s) for (a, b), s in known.items()], "a string, b string, similarity double")
    return lambda asked: asked.join(table, ["a", "b"])


def shares_by_hand(rows):
    """The list surgery: the best goes, the others lose what it holds and fall into runs that keep their place."""
    queue = sorted(rows, key=lambda r: (-r[3], r[0], r[1], r[2]))
    queue = [(list(range(a, b + 1)), s, d) for a, b, s, d in queue]
    out = []
    while queue:
        held, s, d = queue.pop(0)
        out.append((held[0], held[-1], s, d))
        rest = []
        for places, s2, d2 in queue:
            run = []
            for p in [*places, None]:
                if p is not None and p not in held and (not run or run[-1] == p - 1):
                    run.append(p)
                else:
                    if run:
                        rest.append((run, s2, d2))
                    run = [p] if p is not None and p not in held else []
        queue = rest
    return out


def attached_by_hand(singles, placed, known, least):
    """Rounds, all singles of a round at once; placed: {pos: (locus, set)}."""
    joined, open_ = {}, dict(singles)
    at = dict(placed)
    while True:
        new = {}
        for p, s in open_.items():
            beside = [(-known.get((s, at[q][1]), 0.0), at[q]) for q in (p - 1, p + 1) if q in at and known.get((s, at[q][1]), 0.0) > least]
            if beside:
                new[p] = min(beside, key=lambda x: (x[0], x[1][0]))[1]
        if not new:
            return joined, open_
        for p, locus in new.items():
            joined[p], at[p] = locus[0], locus
            del open_[p]


def test_shares_and_loci(spark):
    rng = random.Random(4)
    sets = [f"s{i}" for i in range(8)]
    known = {(a, b): rng.choice([0.1, 0.25, 0.3, 0.5, 0.5, 0.9]) for a in sets for b in sets if rng.random() < 0.9}
    score = {s: float(rng.randint(1, 4)) for s in sets}
    groups = {(c, o, s): sorted({(a, a + rng.randint(0, 4), x, score[x]) for a in (rng.randint(0, 45) for _ in range(30)) for x in [rng.choice(sets)]}) for c in (0, 1) for o in (1,) for s in (1, 2, 3)}
    rows = [(*k, *r) for k, v in groups.items() for r in v]
    df = spark.createDataFrame(rows, CANDIDATE)
    got = {}
    for r in loci.shares(df).collect():
        got.setdefault((r.clan, r.ome, r.scaffold), []).append((r["first"], r["last"], r.set_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(shares_by_hand(v)) for k, v in groups.items()}

    want = {}
    for key, v in groups.items():
        best = {}
        for a, b, s, d in v:
            best[a, b] = max(best.get((a, b), (0.0, "")), (d, s))
        found = shares_by_hand(v)
        placed, rest = [x for x in found if x[1] - x[0] >= 2], [x for x in found if x[1] - x[0] < 2]
        open_ = {p for a, b, *_ in rest for p in range(a, b + 1)}
        while True:
            runs = [p for p in sorted(open_) if p - 1 not in open_]
            ends = [next(q for q in range(p, 99) if q + 1 not in open_) for p in runs]
            again = shares_by_hand([(a, b, s, d) for (a, b), (d, s) in best.items() if b - a >= 2 and any(p <= a and b <= q for p, q in zip(runs, ends, strict=True))])
            if not again:
                break
            placed += [x for x in again if x[1] - x[0] >= 2]
            open_ = {p for a, b, *_ in again if b - a < 2 for p in range(a, b + 1)}
        taken = {p for a, b, *_ in placed for p in range(a, b + 1)}
        placed += [x for x in rest if x[1] - x[0] == 1 and not {x[0], x[1]} & taken]
        taken = {p for a, b, *_ in placed for p in range(a, b + 1)}
        singles = {p: s for a, b, s, _ in rest for p in range(a, b + 1) if p not in taken}
        joined, left = attached_by_hand(singles, {p: (a, s) for a, b, s, _ in placed for p in range(a, b + 1)}, known, 0.25)
        out = [(min([a, *(p for p, x in joined.items() if x == a)]), max([b, *(p for p, x in joined.items() if x == a)])) for a, b, *_ in placed]
        chain = []
        for p in [*sorted(left), None]:
            if chain and p is not None and p == chain[-1] + 1 and known.get((left[chain[-1]], left[p]), 0.0) > 0.25:
                chain.append(p)
                continue
            if len(chain) > 1:
                out.append((chain[0], chain[-1]))
            chain = [p]
        want[key] = sorted(out)
    got = {}
    for r in loci.clan_loci(df, similarity_frame(spark, known), 5).collect():
        got.setdefault((r.clan, r.ome, r.scaffold), []).append((r["first"], r["last"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    for spans in want.values():
        held = [p for a, b in spans for p in range(a, b + 1)]
        assert len(held) == len(set(held))


def test_singles_between_two_loci(spark):
    """Every run of up to six singles between two loci, similar to the left, the right, both or none."""
    rng = random.Random(6)
    known = {(s, t): v for s, pair in {"n": (0.1, 0.1), "l": (0.6, 0.1), "r": (0.1, 0.6), "b": (0.6, 0.6), "c": (0.7, 0.6), "d": (0.6, 0.7)}.items() for t, v in zip("AB", pair, strict=True)}
    singles, placed, want = [], [], []
    for case in range(120):
        n, sides = rng.randint(1, 6), rng.choice(["AB", "A", "B"])
        own = {10 + i: rng.choice("nlrbcd") for i in range(n)}
        at = ({9: (1, "A")} if "A" in sides else {}) | ({10 + n: (2, "B")} if "B" in sides else {})
        singles += [(0, 1, case, p, s) for p, s in own.items()]
        placed += [(0, 1, case, locus, p, p, s) for p, (locus, s) in at.items()]
        joined, _ = attached_by_hand(own, at, known, 0.25)
        want += [(case, p, joined.get(p)) for p in own]
    df = spark.createDataFrame(singles, "clan int, ome int, scaffold int, pos int, set_id string")
    held = spark.createDataFrame(placed, "clan int, ome int, scaffold int, locus int, first int, last int, set_id string")
    got = loci.attached(df, held, similarity_frame(spark, known)).select("scaffold", "pos", "locus").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_extension_by_steps(spark):
    """Both ends are tested against what was missing when the step began, so both may take one group."""
    rng = random.Random(9)
    tracks = {s: [rng.choice([None, *range(8)]) for _ in range(rng.randint(6, 30))] for s in range(40)}
    tracks[99] = [3, 1, 2, 3, 5]
    rows = [(1, s, p, f"{s}_{p}", h) for s, t in tracks.items() for p, h in enumerate(t)]
    genes = spark.createDataFrame(rows, "ome long, scaffold int, pos int, gene string, hg int")
    families = {7: [1, 2, 3], 8: [0, 2, 4, 5, 6, 7], 9: list(range(8))}
    held = [(f, 1, s, a, a + rng.randint(0, 2)) for s, t in tracks.items() if s != 99 for f, a in ((rng.choice([7, 8, 9]), rng.randint(0, 2)), (rng.choice([8, 9]), len(t) - 3))] + [(7, 1, 99, 1, 2)]
    held = [(f, o, s, a, min(b, len(tracks[s]) - 1)) for f, o, s, a, b in held]
    used = {(s, p) for _, _, s, a, b in held for p in range(a, b + 1)}
    want = []
    for f, o, s, a, b in set(held):
        missing, ends, open_ = set(families[f]) - set(tracks[s][a : b + 1]), [a, b], [True, True]
        while any(open_):
            gone = set()
            for side, step in ((1, 1), (0, -1)):
                p = ends[side] + step
                open_[side] = open_[side] and 0 <= p < len(tracks[s]) and (s, p) not in used and tracks[s][p] in missing
                if open_[side]:
                    ends[side] = p
                    gone.add(tracks[s][p])
            missing -= gone
        want.append((f, o, s, a, b, *ends))
    fam = spark.createDataFrame(list(families.items()), "family int, hgs array<int>")
    got = loci.extended(spark.createDataFrame(held, "family int, ome long, scaffold int, first int, last int"), genes, fam)
    assert sorted(map(tuple, got.select("family", "ome", "scaffold", "first", "last", "new_first", "new_last").collect())) == sorted(want)
    assert (7, 1, 99, 1, 2, 0, 3) in want


def test_a_family_of_any_size_is_extended_whole(spark):
    genes = spark.createDataFrame([(1, 1, p, str(p), p) for p in range(200)], "ome long, scaffold int, pos int, gene string, hg int")
    fam = spark.createDataFrame([(1, list(range(200)))], "family int, hgs array<int>")
    row = loci.extended(spark.createDataFrame([(1, 1, 1, 100, 101)], "family int, ome long, scaffold int, first int, last int"), genes, fam).first()
    assert (row.new_first, row.new_last) == (0, 199)


def test_claims_of_scaffold_ends(spark):
    tracks = {1: [1, 2, 9, 9], 2: [1, 2, 9, 9, 9], 3: [9, 3, 4, 9, 9, 5, 3], 4: [3, 4, 3], 5: [3, 4, 5], 6: [3, 4, 9, 3, 4], 7: [4, 5]}
    genes = spark.createDataFrame([(o, s, p, f"{o}{s}{p}", h) for o in (1, 2, 3, 4) for s, t in tracks.items() for p, h in enumerate(t) if (o, s) not in [(3, 3), (3, 4), (4, 3), (4, 4), (4, 5)]], "ome long, scaffold int, pos int, gene string, hg int")
    fam = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4])], "family int, hgs array<int>")
    rows = [(1, 1, 1, 0, 1), (2, 1, 2, 0, 1), (1, 2, 1, 1, 1), (1, 3, 1, 0, 1), (2, 3, 2, 0, 1), (1, 4, 1, 0, 1), (2, 4, 2, 0, 1)]
    grown = spark.createDataFrame([(*r, *r[3:]) for r in rows], "family int, ome long, scaffold int, first int, last int, new_first int, new_last int")
    got = sorted(map(tuple, loci.edge_claims(grown, genes, fam).collect()))
    # Genome 1: scaffold 3's end (5, 3) fits family 1; its start (9, 3) doesn't. Family 2 finds scaffold 4 (3, 4). Genome 2: no locus at an end.
    # Genome 3: both families want scaffold 5's start; family 1 is first and wants its end as well, which shares a gene.
    # Genome 4: both want scaffold 6, whose ends are equal and so one claim.
    assert got == [(1, 1, 3, 5, 6), (1, 3, 5, 0, 1), (1, 4, 6, 0, 1), (2, 1, 4, 0, 1)]


def test_pruning_by_rounds(spark):
    """Genes fall one after another: each has only the next as a hit, and others of its genomes that are no members."""
    members = [(1, 5, "a1", 1), (1, 5, "a2", 2), (1, 5, "a3", 1), (1, 5, "a4", 2), (1, 5, "b1", 3)]
    # a1 hits a2, a2 hits a3, a3 hits a4, a4 hits only a gene of genome 1 that is no member; b1 hits an outsider.
    algn = [(5, "a1", "a2", 2), (5, "a2", "a3", 1), (5, "a3", "a4", 2), (5, "a4", "x", 1), (5, "b1", "z", 9)]
    placed = [(1, 10, "a1", 1), (1, 10, "a2", 2), (1, 11, "a3", 1), (1, 11, "a4", 2), (1, 12, "b1", 3), (1, 12, "c", 3), (1, 12, "d", 4), (1, 13, "e", 5), (1, 13, "f", 5), (1, 13, "g", 6)]
    args = spark.createDataFrame(algn, "hg int, q string, s string, s_ome int"), spark.createDataFrame(members, "hlg int, hg int, gene string, ome int"), spark.createDataFrame(placed, "hlg int, locus int, gene string, ome int")
    got = {r.locus: (r.failed, r.stays) for r in proxies.pruned(*args).collect()}
    # Round by round a4, a3, a2, a1 fall as long as their genomes keep another member; then b1 is alone in its group.
    alive, order = {m[2]: m[3] for m in members}, []
    while True:
        omes = set(alive.values())
        bad = [g for g in alive if len(omes) == 1 or ((hits := [(s, o) for _, q, s, o in algn if q == g]) and not any((s in alive and o != alive[g]) or o not in omes for s, o in hits))]
        if not bad:
            break
        order.append(bad)
        for g in bad:
            del alive[g]
    assert len(order) >= 3
    gone = {g for bad in order for g in bad}
    for locus in (10, 11, 12, 13):
        own = [g for _, x, g, _ in placed if x == locus]
        failed = len(gone & set(own))
        assert got[locus] == (failed, failed == 0 or failed < len(own) - 1)
    # A locus that goes takes its other genes out of their groups.
    more = [(1, 6, "c", 3), (1, 6, "e", 5), (1, 6, "a1", 1)]
    strict = proxies.pruned(args[0], spark.createDataFrame(members + more, args[1].schema), args[2], 3, True)
    assert {r.locus for r in strict.where("stays").collect()} <= {12, 13}


def test_intervals_and_joins_agree(spark, monkeypatch):
    rng = random.Random(1)
    rows, tips, n = [(0, None, 0.0, None)], [], 1
    open_ = [0]
    while open_ and n < 90:
        up = open_.pop(rng.randrange(len(open_)))
        for _ in range(rng.randint(2, 4)):
            leaf = rng.random() < 0.5
            rows.append((n, up, round(rng.random() * 3, 4), f"t{n}" if leaf else None))
            tips += [f"t{n}"] if leaf else []
            open_ += [] if leaf else [n]
            n += 1
    for k, (node, up, length, tip) in enumerate(rows):
        if tip is None and node in open_:
            rows[k] = (node, up, length, f"t{node}")
            tips.append(f"t{node}")
    t = spark.createDataFrame(rows, "node long, parent long, length double, tip string")
    closure = tree.closure(t)
    stats = tree.node_stats(t, closure)
    own = [sorted(rng.sample(tips, rng.randint(1, len(tips)))) for _ in range(150)] + [tips, [tips[0]], [tips[0]] * 3, ["unknown"], ["unknown", tips[1]], [], None]
    sets = spark.createDataFrame(list(enumerate(own)), "set_id int, omes array<string>")

    def answers():
        far = {r.set_id: (r.mrca, round(r.tmd, 9), round(r.mmd, 9), round(r.pds, 9), r.n_missing) for r in tree.set_distances(sets, stats, closure).collect()}
        return far, sorted((r.set_id, r.tip) for r in tree.missing_tips(sets.where("set_id < 40"), stats, closure).collect())

    monkeypatch.setattr(tree, "PIECE", 50)
    by_intervals = answers()
    monkeypatch.setattr(tree, "BROADCAST_NODES", 0)
    assert by_intervals == answers()
    assert len(by_intervals[0]) == 154 and by_intervals[1]
    assert tree.set_distances(sets.limit(0), stats, closure).count() == 0
