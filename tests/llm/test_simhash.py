import itertools
import random

import numpy as np
import xxhash

from tidegauge.llm import exact_dedup, queries, simhash
from .conftest import words


def _brute_print(text):
    w = [x.lower() for x in (text or "").encode().split()]
    sh = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in sh) * 2 > len(sh):
            out |= 1 << bit
    return out


def _brute_roots(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_match_brute_force(odd_docs):
    rows = odd_docs.where("doc_id <> 6").select("text").collect()
    for r in rows:
        assert simhash.fingerprint_of(r.text) & (2**64 - 1) == _brute_print(r.text)


def test_spark_and_python_hash_alike(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("one two three", 42)


def test_links_connect_what_all_pairs_connect(spark):
    r = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(60):  # random, near-random and dense groups around one centre
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.randint(0, 6)):
            for bit in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    centre = r.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 40, 7)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = [(x.a, x.b) for x in simhash.near_links(df, block=16).collect()]
    at = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert bin(prints[at[a]] ^ prints[at[b]]).count("1") <= 3
        parent[find(at[a])] = find(at[b])
    brute = _brute_roots(prints)
    mine = [find(i) for i in range(len(prints))]
    assert len({*zip(brute, mine, strict=True)}) == len(set(brute)) == len(set(mine))


def test_components_of_odd_rows(odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_print = {}
    for r in out:
        by_print.setdefault(r.fp, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by_print.values())
    assert by_print[0] == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_query_shape_and_survivors(spark, odd_docs, no_docs, stored):
    out = queries.op2_simhash(spark, stored(documents=odd_docs)).collect()
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in out)
    clash = odd_docs.withColumnRenamed("source", "fp").withColumnRenamed("lang", "place")
    left = simhash.without_near_duplicates(clash)
    assert left.columns == clash.columns
    kept = [r.doc_id for r in left.collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 6, 7, 9] and kept.count(None) == 1
    assert simhash.without_near_duplicates(no_docs).count() == 0


def test_long_chain_is_one_component(spark):
    from tidegauge.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert all(roots[i] == 0 for i in range(301)) and roots[1001] == roots[1000] == 1000
    assert np.unique(list(roots.values())).size == 2
    assert connected_components(links.limit(0)).count() == 0


def test_pigeonring_passes_exactly_the_close_fingerprints():
    r = np.random.default_rng(4)
    a = r.integers(-(2**63), 2**63 - 1, (4, 400))
    flips = [r.choice(256, r.integers(0, 140), replace=False) for _ in range(400)]
    b = a.copy()
    for i, bits in enumerate(flips):
        for k in bits.tolist():
            b[k // 64, i] ^= np.int64(np.uint64(1 << (k % 64)).view(np.int64))
    assert (simhash.ring_close(a, b, 66) == [len(x) <= 66 for x in flips]).all()


def test_wide_fingerprints_of_alike_texts_are_close():
    r = random.Random(3)
    for n in (6, 12, 60, 400):
        for seed in range(60):
            a = words(n, 100 * n + seed).split()
            b = a.copy()
            for at in r.sample(range(n), max(n // 50, 1)):
                b[at] = "edited"
            one, two = simhash.shingle_set(" ".join(a)), simhash.shingle_set(" ".join(b))
            if simhash.alike(one, two):
                x, y = (simhash.wide_fingerprint(s)[:, None] for s in (one, two))
                assert simhash.ring_close(x, y, simhash.WIDE_TAU)[0]


def test_near_copies_match_brute_force(spark):
    r, texts = random.Random(8), {}
    for g in range(60):
        base = words(r.choice([8, 20, 60, 150]), 7000 + g).split()
        for k in range(r.randint(1, 5)):
            w = base.copy()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"new{r.randrange(99)}"
            texts[10 * g + k] = " ".join(w)
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(texts, 2):
        if x // 10 == y // 10 and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert {k.doc_id for k in simhash.without_near_copies(docs).collect()} == {i for i in texts if root(i) == i}


def test_near_copies_of_odd_rows_and_clashing_names(spark, odd_docs, no_docs):
    clash = odd_docs.withColumnsRenamed({"lang": "node", "source": "band", "n_chars": "place"})
    out = simhash.without_near_copies(clash)
    assert out.columns == clash.columns
    assert sorted((k.doc_id for k in out.collect()), key=str) == sorted([1, 3, 6, 7, 9, None], key=str)
    assert simhash.without_near_copies(no_docs).count() == 0


def test_reader_options_are_kept(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    for k in range(3):
        spark.createDataFrame([(k, f"text number {k}")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)
    names = sorted(p.name for p in (tmp_path / "t").glob("part-*.parquet"))
    some = spark.read.option("pathGlobFilter", names[0]).parquet(folder)
    assert some.count() == 1
    for f in (simhash.without_near_copies, simhash.without_near_duplicates, exact_dedup.without_copies):
        assert f(some).collect() == some.collect()
        assert f(spark.read.option("pathGlobFilter", "none*").schema(some.schema).parquet(folder)).count() == 0
        assert f(spark.read.parquet(folder)).count() == 3


def test_pages_of_one_template_match_brute_force(spark):
    """Most pairs of these pages look alike without being so: no cap on partners may part the others."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5_000)]
    base, texts = r.choices(vocabulary, k=400), []
    for _ in range(450):
        page = base.copy()
        for at in r.sample(range(400), 6):
            page[at] = r.choice(vocabulary) + "x"
        texts.append(" ".join(page))
    sets = [simhash.shingle_set(t) for t in texts]
    parent, similar = list(range(len(texts))), []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        similar.append(both / (len(sets[x]) + len(sets[y]) - both))
        if similar[-1] >= 0.8:
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    wanted = {k for k in range(len(texts)) if root(k) == k}
    assert 0.7 < np.median(similar) < 0.78 and 50 < len(wanted) < 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {k.doc_id for k in simhash.without_near_copies(docs).collect()} == wanted


def test_pairs_apart_are_all_pairs_of_other_roots():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 57):
        root = r.integers(0, 5, n)
        got = [(int(a), int(b)) for x, y in simhash.pairs_apart(root, step=100) for a, b in zip(x, y, strict=True)]
        assert got == [(a, b) for a in range(n) for b in range(a + 1, n) if root[a] != root[b]]


def test_spanning_links_by_products_and_by_pairs():
    r = np.random.default_rng(3)
    sets = [np.unique(np.append(r.integers(0, 40, k), r.integers(0, 2**62, 2)).astype(np.uint64)) for k in r.integers(1, 90, 80)] + [np.zeros(0, np.uint64)]
    x, y = np.triu_indices(len(sets), 1)
    for some in (slice(None), slice(0, 30)):
        held = np.arange(len(sets))
        links = simhash.spanning(held, sets, x[some], y[some])
        label = list(range(len(sets)))

        def join(a, b):
            old, new = label[b], label[a]
            label[:] = [new if v == old else v for v in label]

        for a, b in zip(x[some].tolist(), y[some].tolist(), strict=True):
            if simhash.alike(sets[a], sets[b]):
                join(a, b)
        wanted, label = label, list(range(len(sets)))
        for a, b in links:
            assert simhash.alike(sets[a], sets[b])
            join(a, b)
        groups = lambda v: sorted(tuple(k for k, w in enumerate(v) if w == u) for u in set(v))
        assert groups(label) == groups(wanted)


def test_cells_bring_all_classes_of_a_group_together(spark):
    rows = [(band, node, 1 if node < 1_300 else node) for band, nodes in ((1, range(0, 1_310)), (2, range(1_305, 1_320)), (3, range(2_000, 2_100))) for node in nodes]
    cells: dict[int, set[int]] = {}
    for r in simhash._cells(spark.createDataFrame(rows, "band bigint, node bigint, root bigint")).collect():
        cells.setdefault(r["cell"], set()).add(r["node"])
    root = {node: x for _, node, x in rows}
    met = {(a, b) for held in cells.values() for a, b in itertools.permutations([k for k in held if k >= 1_300], 2)}
    for band in (1, 2, 3):
        nodes = [n for b, n, _ in rows if b == band]
        assert all((a, b) in met for a, b in itertools.permutations([n for n in nodes if n >= 1_300], 2))
    outsiders = set(range(1_300, 1_310))
    assert all(any(n in held and outsiders <= held for held in cells.values()) for n in range(0, 1_300))
    assert all(len(held) < 2 * 1_000 for held in cells.values()) and not any(len({root[n] for n in held}) == 1 for held in cells.values())
