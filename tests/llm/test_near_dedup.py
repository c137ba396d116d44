import re

import numpy as np
import pytest

from gaugeframe.llm import near_dedup as nd
from gaugeframe.llm.components import components


def brute(rows, width, percent):
    """(id, n_shingles, component_id, kept) by comparing everything with everything."""
    sets = []
    for _, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        spans = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets.append(set(spans))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    out = []
    for i, (key, _) in enumerate(rows):
        if not sets[i]:
            out.append((key, 0, key, True))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        label = min(ids, default=None)
        out.append((key, len(sets[i]), label, key == label))
    return sorted(out, key=repr)


def rows_with_copies(seed, groups=25, edits=6):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(groups):
        words = list(rng.choice(vocabulary, int(rng.integers(3, 400))))
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 9))):
            copy = list(words)
            for _ in range(int(rng.integers(0, edits))):
                copy[int(rng.integers(len(copy)))] = "edit" + str(rng.integers(100))
            texts.append("\n".join(copy) if g % 2 else " ".join(copy).upper().replace("W", "w") + " ")
    texts += ["one two", "ONE  two", "one", "", " \n", None, None, "a b c d e f g h " * 2000, "a b c d e f g h " * 2001]
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts))
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (None, "only here and nameless it is"), (None, "only here and nameless it is")]


@pytest.mark.parametrize("width,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, width, percent, seed):
    rows = rows_with_copies(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, node string")
    got = nd.near_classes(docs, "doc_id", "text", width, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, width, percent)


def test_a_chain_of_copies_that_drift(spark):
    """Neighbours are similar, the ends are not: the component needs links that no hub sees."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        texts.append(" ".join(words))
        words[(i * 3) % 200] = f"x{i}"
    rows = list(zip(rng.permutation(60).tolist(), texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = nd.near_classes(docs, "doc_id", "text", 3, 85)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 3, 85)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = nd.near_classes(docs, "doc_id", "text", 3, 85)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 3, 85)


def test_dropping_keeps_one_row_of_each_component(spark):
    rows = rows_with_copies(3, groups=6)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, more string")
    got = nd.drop_near_copies(docs, "doc_id", "text")
    assert got.columns == docs.columns
    want = sorted({(r[0], r[2]) for r in brute(rows, 5, 80) if r[3] and r[0] is not None and r[1]})
    assert sorted((r.doc_id, r.doc_id) for r in got.collect() if r.doc_id is not None and (r.text or "").strip()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert nd.near_classes(docs, "doc_id", "text").collect() == []


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85):
        got = []
        for size in (40, 400, 4000):
            for _ in range(10):
                every = np.unique(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64) * np.uint64(2))
                both = round(share * 2 * size / (1 + share) / 1)
                both = min(both, size)
                a, b = every[:size], np.concatenate([every[:both], every[size : size + size - both]])
                a, b = np.unique(nd.mix(a)), np.unique(nd.mix(b))
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                x, y = nd.sketch(a, 256)[None], nd.sketch(b, 256)[None]
                got.append(nd.estimate(x, y, np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(got)) < 0.04


def test_leading_zeros_and_bits():
    values = np.array([1 << 63, (1 << 63) | (1 << 62), 1, 0, (1 << 40) | (1 << 39)], np.uint64)
    assert nd.compress(values).tolist() == [0, 1 << 9, 63 << 10, 63 << 10, 23 << 10 | 1 << 9]


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in want:
                want[n] = start
                stack += near[n]
    alone = {a for a in near if near[a] == {a}}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == {n: m for n, m in want.items() if n not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def heavily_edited(seed, copies, words=150, most=40):
    """Copies of one text with very different numbers of edits, some of them shared."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(copies):
        own = list(base)
        for _ in range(int(rng.integers(0, most))):
            place = int(rng.integers(len(own)))
            kind = rng.random()
            if kind < 0.4:
                own[place] = f"new{rng.integers(100000)}"
            elif kind < 0.6:
                del own[place]
            elif kind < 0.8:
                own.insert(place, "and")
            else:
                own[place] = f"often{rng.integers(3)}"
        texts.append(" ".join(own))
    return list(zip(rng.permutation(copies).tolist(), texts))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_a_crowd_of_heavily_edited_copies(spark, width, percent):
    """No link is lost, and far fewer pairs are met than the group has."""
    rows = heavily_edited(4, 500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = nd.near_classes(docs, "doc_id", "text", width, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, width, percent)


def test_difference_filter_keeps_every_link(spark):
    """All links between components are among the pairs, for a hub that is like the texts and for one that is not."""
    rows = [(i, t) for i, (_, t) in enumerate(heavily_edited(7, 120))]
    words = [re.findall(r"\S+", t) for _, t in rows]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    rows.append((1000, " ".join(f"other{i}" for i in range(90))))
    sets.append(set())
    texts = spark.createDataFrame(rows, "node bigint, text string")
    for hub in (min(range(120), key=lambda i: len(sets[i] - sets[0])), 1000):
        apart = spark.createDataFrame([(5, n, n) for n, _ in rows], "band bigint, node bigint, label bigint")
        links = spark.createDataFrame([(hub, hub + 1)], "a bigint, b bigint")
        got = {(r.a, r.b) for r in nd._by_difference(apart, links, texts, 3, 85).collect()}
        for i in range(120):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and hub == 1000:
                    assert (j, i) in got


def test_links_to_the_hub_are_among_the_pairs(spark):
    """Texts that are linked with the hub of their band but were never compared with it: the pairs join all that is linked."""
    rows = [(i, t) for i, (_, t) in enumerate(heavily_edited(7, 120))]
    words = [re.findall(r"\S+", t) for _, t in rows]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    hub = max(range(120), key=lambda i: sum(near(i, j) for j in range(120)))
    texts = spark.createDataFrame(rows, "node bigint, text string")
    apart = spark.createDataFrame([(5, n, n) for n, _ in rows], "band bigint, node bigint, label bigint")
    links = spark.createDataFrame([(hub, 1000), (hub, 1001)], "a bigint, b bigint")
    got = {(r.a, r.b) for r in nd._by_difference(apart, links, texts, 3, 85).collect()}
    assert {(min(hub, j), max(hub, j)) for j in range(120) if j != hub and near(hub, j)} <= got
    joined = lambda pairs: {r.node: r.label for r in components(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()}
    every = {(j, i) for i in range(120) for j in range(i) if near(i, j)}
    assert joined({p for p in got if near(*p)}) == joined(every)


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words have one value under every odd base modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"one {a} two"), (2, f"one {b} two")], "doc_id bigint, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in nd.near_classes(docs, "doc_id", "text", 3, 85).collect()}
    assert got == {1: (1, True), 2: (2, True)}


def test_ids_of_any_size_and_type(spark):
    big = (1 << 62) + 5
    for kind, ids in (("bigint", [big, big + 1, big + 2]), ("string", ["x", "y", "z"])):
        docs = spark.createDataFrame(list(zip(ids, ["a b c d e f", "A b c d e f", "other"])), f"doc_id {kind}, text string")
        got = {r.doc_id: (r.component_id, r.kept) for r in nd.near_classes(docs, "doc_id", "text").collect()}
        assert got == {ids[0]: (ids[0], True), ids[1]: (ids[0], False), ids[2]: (ids[2], True)}
        assert nd.drop_near_copies(docs, "doc_id", "text").count() == 2


def test_columns_with_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8), (2, "a b", 9, 9)], "doc_id bigint, text string, rid int, __rid int")
    left = nd.drop_near_copies(docs, "doc_id", "text")
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "a b", 7, 8)]


def test_recall_on_made_groups(spark):
    """Pairs at 0.80 to 0.90: all of them are found."""
    rng = np.random.default_rng(12)
    rows, wanted = [], 0
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(200)]
        copy = list(words)
        for place in rng.choice(np.arange(10, 190, 6), int(rng.integers(2, 6)), replace=False):
            copy[place] = "edit"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    expected = brute(rows, 5, 80)
    got = nd.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
