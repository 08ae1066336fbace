"""Exact and near duplicates, and boilerplate lines, against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import exact_dedup, line_dedup
from runlens.llm import ngram_jaccard as nj

from .conftest import PLAIN, rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_groups(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[normal(r.text)].append(r.doc_id)
    return groups


@pytest.mark.parametrize("block", [5, 2048])
def test_exact_groups_equal_brute_force(clashing_docs, edge_rows, block):
    groups = exact_groups(edge_rows)
    got = exact_dedup.exact_dedup(clashing_docs, block=block).collect()
    want = []
    for r in edge_rows:
        same = groups[normal(r.text)]
        want.append((r.doc_id, min(same), len(same), hashlib.sha256(normal(r.text).encode()).hexdigest()))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want)
    # one row of each group stays, also of repeated rows
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_block_names_tell_equal_hashes_apart(spark):
    """Names compare contents: texts of one length that differ in any block differ."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(16)) for _ in range(200)] + ["ab" * 8] * 3
    frame = spark.createDataFrame([(i, 16, t) for i, t in enumerate(texts)], "row long, n int, text string")
    names = {r.row: r.identity for r in exact_dedup.name_texts(frame, block=3).collect()}
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (names[i] == names[j]) == (texts[i] == texts[j])


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert line_dedup.remove_boilerplate(no_docs).count() == 0
    assert nj.link_components(no_docs).count() == 0
    assert nj.keep_one(no_docs).count() == 0


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(docs, size, num, den):
    sets = {i: shingles(t, size) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, n):
    """Texts with chains of edits, shared passages, copies and tiny texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(12)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 150]))]
        if rng.random() < 0.3:
            base = base + passage
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(base))
                base[at : at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1])
                base = base or ["w0"]
            texts.append(base)
    return list(enumerate(" ".join(t) for t in texts[:n]))


@pytest.mark.parametrize("size,share,seed", [(4, (85, 100), 1), (5, (80, 100), 2), (1, (50, 100), 3)])
def test_components_equal_brute_force(spark, size, share, seed):
    docs = corpus(seed, 260)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(frame, size=size, share=share).collect()}
    assert got == brute_components(docs, size, *share)


def family(seed, n, edits):
    """Copies of one text, each with its own edits: pairs lie on both sides of the limit."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(edits):
            text[rng.randrange(len(text))] = f"e{i}-{rng.randrange(10**6)}"
        out.append(text)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("earliest", [0, 1, 12])
def test_families_at_the_limit_equal_brute_force(spark, monkeypatch, earliest):
    """Dissimilar relatives share many groups and meet once or twice; no link gets lost."""
    monkeypatch.setattr(nj, "EARLIEST", earliest)
    rng = random.Random(8)
    texts = [t for edits in (2, 3, 4) for t in family(edits, 40, edits)]
    passage = " ".join(f"p{i}" for i in range(6))
    texts += [" ".join(f"q{rng.randrange(4000)}" for _ in range(rng.choice([3, 9, 30]))) + " " + passage for _ in range(200)]
    docs = list(enumerate(texts))
    made = {}

    def saved(df, name, put=nj.saved):
        made[name] = put(df, name)
        return made[name]

    monkeypatch.setattr(nj, "saved", saved)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs, 5, 80, 100)
    assert "crossing" in made


@pytest.mark.parametrize("way", ["near", "twice"])
@pytest.mark.parametrize("size,share,seed", [(4, (85, 100), 6), (1, (50, 100), 7)])
def test_finer_cuts_lose_no_link(spark, monkeypatch, way, size, share, seed):
    """Every band is cut finer, whatever it costs, and the finer groups are kept."""
    made = {}

    def saved(df, name, put=nj.saved):
        made[name] = put(df, name)
        return made[name]

    monkeypatch.setattr(nj, "saved", saved)
    monkeypatch.setattr(nj, "_ways", lambda open_, pairs, bands: {b: way for b in pairs if b})
    monkeypatch.setattr(nj, "_proposed", lambda groups, equal: nj.saved(equal.limit(0), "proposed"))
    real, calls = nj._pairs, []
    monkeypatch.setattr(nj, "_pairs", lambda open_: calls.append(1) or ({} if len(calls) == 2 else real(open_)))
    docs = corpus(seed, 200) + [(1000 + i, t) for i, t in enumerate(family(seed, 30, 3))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(frame, size=size, share=share).collect()}
    assert got == brute_components(docs, size, *share)
    assert made["finer"].count() and "allocated" in made


def test_texts_that_share_a_passage_are_cut_finer(spark, monkeypatch):
    """Half of each text is a passage that all share: where the finer cut costs less, it leaves less than half the pairs."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([30, 40, 60]))) + " " + passage for _ in range(400)]
    texts += [t.replace("p7", "x") for t in texts[:20]]
    docs = list(enumerate(texts))
    real, costs = nj._pairs, []

    def pairs(open_):
        costs.append(real(open_))
        return costs[-1]

    monkeypatch.setattr(nj, "_pairs", pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs, 5, 80, 100)
    assert len(costs) == 2
    assert costs[1] and all(now < 0.5 * costs[0][band] for band, now in costs[1].items())


def test_a_repeated_id_links_by_any_of_its_texts(spark):
    rng = random.Random(4)
    long = lambda name: " ".join(f"{name}{rng.randrange(10**6)}" for _ in range(60))
    texts = {name: long(name) for name in "abcdefgh"}
    docs = [(i, texts[a]) for i, a in enumerate("abcdefgh")]
    near = lambda a: texts[a].rsplit(" ", 1)[0]
    docs += [(20, near("a")), (20, near("b")), (21, near("c")), (21, near("b")), (22, near("e")), (22, near("e"))]
    got = {(r.doc_id, r.component_id) for r in nj.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (20, 0), (21, 0), (3, 3), (4, 4), (22, 4), (5, 5), (6, 6), (7, 7)}


def test_components_of_edges(clashing_docs, edge_rows):
    got = rows(nj.link_components(clashing_docs))
    assert len(got) == len(edge_rows)
    by_id = {r[0]: r for r in got}
    assert [by_id[i][1] for i in (1, 2, 3)] == [0, 0, 0] and [by_id[i][2] for i in (1, 2, 3)] == [1, 2, 3]
    assert by_id[4][2] == by_id[5][2] == by_id[6][2] == 4
    kept = nj.keep_one(clashing_docs)
    assert kept.columns == clashing_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9, 10]


@pytest.mark.parametrize("way", [None, "near", "twice"])
def test_every_similar_pair_meets_in_the_index(way):
    """By the first cut and by the finer ones, with every band cut that way."""
    rng = np.random.default_rng(5)
    ways = way and dict.fromkeys(range(64), way)
    for bands in (nj.Bands(85, 100), nj.Bands(80, 100)):
        for n in [*range(1, 60), 120, 400] * 4:
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = list(x)
            while True:  # up to the least similarity
                z = list(y)
                if rng.random() < 0.5 and len(z) > 1:
                    z.pop(rng.integers(len(z)))
                else:
                    z.append(np.uint64(rng.integers(0, 2**63)))
                both = len(set(map(int, x)) & set(map(int, z)))
                if bands.den * both < bands.num * (len(x) + len(z) - both):
                    break
                y = z
            (sx, kx), (sy, ky) = (nj.signatures(np.unique(np.array(v, np.uint64)), bands, ways) for v in (x, y))
            meets = set(sx[kx == 0].tolist()) & set(sy[ky == 0].tolist())
            held = {s: max(a, b) for s, a, b in ((s, dict(zip(sx.tolist(), kx))[s], dict(zip(sy.tolist(), ky))[s]) for s in set(sx[kx > 0].tolist()) & set(sy[ky > 0].tolist()))}
            assert meets or 2 in held.values()


def brute_lines(docs, min_sites, max_share):
    sites = defaultdict(set)
    for r in docs:
        for line in (r.text or "").split("\n"):
            if r.source is not None:
                sites[line.strip(" ")].add(r.source)
    out = []
    for r in docs:
        lines = (r.text or "").split("\n")
        common = [i for i, line in enumerate(lines) if line.strip(" ") and len(sites[line.strip(" ")]) >= min_sites]
        if max_share is None:
            clean = bool(common) and any(x.strip(" ") and i not in common for i, x in enumerate(lines))
        else:
            clean = bool(common) and sum(len(lines[i].strip(" ")) for i in common) <= max_share * len(r.text)
        text = "\n".join(x for i, x in enumerate(lines) if i not in common) if clean else r.text
        out.append((r.doc_id, len(common), len(common) if clean else 0, text))
    return sorted(out, key=repr)


def test_boilerplate_lines_equal_brute_force(spark, clashing_docs, edge_rows):
    rng = random.Random(2)
    menu = [f"menu line {i}" for i in range(12)]
    docs = []
    for i in range(300):
        site = f"s{rng.randrange(14)}" if rng.random() < 0.9 else None
        lines = [f"text {rng.random()} of its own, long enough to matter" for _ in range(rng.randrange(4))]
        lines += [m for k, m in enumerate(menu) if rng.random() < 0.01 * 2 ** (k / 2)]
        docs.append((i, "\n".join(lines) if rng.random() < 0.97 else None, site))
    docs += [(1000 + i, PLAIN, f"s{i}") for i in range(14)]  # a copy on every site stays whole
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for min_sites, share in ((3, None), (10, None), (10, 0.5)):
        got = line_dedup.remove_boilerplate(frame, min_sites=min_sites, max_share=share)
        want = brute_lines(frame.collect(), min_sites, share)
        assert rows(got, "doc_id", "boilerplate_lines", "removed_lines", "text") == want
    cleaned = line_dedup.remove_boilerplate(clashing_docs, min_sites=2)
    assert set(clashing_docs.columns) <= set(cleaned.columns)
    assert rows(cleaned, "doc_id", "boilerplate_lines", "removed_lines", "text") == brute_lines(
        edge_rows, 2, None
    )


def test_short_pages_lose_their_boilerplate(spark, small):
    """More boilerplate than text: the stage cuts it, and leaves what is nothing else."""
    import corpus_pipeline as cp

    menu = "a long menu line that every site has at its top"
    docs = [(i, f"{menu}\nown {i}\n ", "en", f"s{i}", 0) for i in range(10)] + [(10, f" {menu}\n\n", "en", "s1", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.boilerplate(spark, frame, small).collect()}
    assert got == {**{i: f"own {i}\n " for i in range(10)}, 10: f" {menu}\n\n"}


def test_lines_near_the_limit_are_counted_exactly(spark):
    """Thousands of sites, where a sketch alone would err."""
    n = 3_000
    counts = {f"line {k}": n + k for k in (-2, -1, 0, 1)}
    rows_of = [(line, s) for line, c in counts.items() for s in range(c)]
    frame = spark.createDataFrame(rows_of, "line string, site long").select(
        F.xxhash64("line").alias("h"), F.length("line").alias("n"), "site"
    )
    found = line_dedup.boilerplate(frame, n).count()
    assert found == 2


def test_few_edges_are_followed_without_shuffles(spark, monkeypatch):
    plans, kept = [], nj.saved

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    chain = [(i, i + 1) for i in range(1, 12)] + [(40, 30), (30, 35), (35, 35), (30, 40)]
    edges = kept(spark.createDataFrame(chain, "a long, b long").repartition(3), "edges")
    want = {**{i: 1 for i in range(2, 13)}, 35: 30, 40: 30}
    monkeypatch.setattr(nj, "saved", watched)
    assert {r.id: r.component for r in nj.components(edges).collect()} == want
    assert plans and not any("hashpartitioning" in p for p in plans)
    monkeypatch.setattr(nj, "FEW_EDGES", 2)
    assert {r.id: r.component for r in nj.components(edges).collect()} == want
    assert any("hashpartitioning" in p for p in plans)


def test_more_links_join_known_components(spark):
    known = [(2, 1), (3, 1), (11, 10), (21, 20), (31, 30)]
    links = [(3, 11), (20, 5), (50, 51), (2, 3), (51, 49)]
    frames = [nj.saved(spark.createDataFrame(x, s), "given") for x, s in ((known, "id long, component long"), (links, "a long, b long"))]
    got = sorted((r.id, r.component) for r in nj._joined(*frames).collect())
    assert got == [(2, 1), (3, 1), (10, 1), (11, 1), (20, 5), (21, 5), (31, 30), (50, 49), (51, 49)]


def test_open_groups_are_written_once(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(nj, "saved", lambda df, name: wrote.append(name) or df)
    groups = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 3, 0), (3, 4, 1), (3, 5, 2), (4, 6, 0)], "sig long, id long, kind byte")
    known = spark.createDataFrame([(2, 1), (1, 1), (5, 4)], "id long, component long")
    got = nj._still_open(groups, known)
    assert sorted(map(tuple, got.select("sig", "id", "kind", "c").collect())) == [(2, 1, 0, 1), (2, 3, 0, 3)]
    assert wrote == ["open"]
    again = nj._still_open(got, spark.createDataFrame([(3, 1), (1, 1)], "id long, component long"))
    assert again.columns == got.columns and again.count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    sets = [rng.choice(100_000, n, replace=False).astype(np.uint64) for n in (0, 1, 63, 64, 65, 700, 1500, 3000, 3001)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], s[:1] + np.uint64(200_000)]) for s in sets]
    n = np.array([len(s) for s in sets])
    got = nj.sketches(nj.mix(np.concatenate(sets)), n).to_pylist()
    assert [8 * len(x) for x in got[:9]] == [64, 64, 64, 64, 128, 1024, 2048, 4096, 4096]
    for (x, s), (y, t) in itertools.product(zip(got, sets), repeat=2):
        assert nj.least_difference(x, y) <= len(np.setxor1d(s, t))
        assert x != y or nj.least_difference(x, y) == 0
    # sets without a common element don't pass for similar ones
    assert nj.least_difference(got[7], got[8]) > 0.2 * 6001


def test_texts_are_dealt_out_for_likely_pairs_alone(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(3000)] for _ in range(12)]
    texts.append(texts[0][:-50])
    data = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(12, "another text of this id")]
    docs = spark.createDataFrame(data, "id long, text string").repartition(3)
    pairs = spark.createDataFrame([*itertools.combinations(range(12), 2), (0, 12), (3, 12)], "a long, b long")
    written, saved = {}, nj.saved
    monkeypatch.setattr(nj, "saved", lambda df, name: written.setdefault(name, saved(df, name)))
    bands = nj.Bands(80, 100)
    links = nj._verified(pairs, docs, nj._bits(nj._facts(docs, 5)), 5, bands)
    assert [tuple(r) for r in links.collect()] == [(0, 12)]
    # what has two texts isn't ruled out
    assert sorted(tuple(r) for r in written["likely"].collect()) == [(0, 12), (3, 12)]
