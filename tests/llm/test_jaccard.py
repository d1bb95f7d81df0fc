import random
from collections import Counter, defaultdict

import pytest
from tests.llm.edge import edge, empty

from veilwright.llm import jaccard, queries
from veilwright.llm.components import components


def brute(docs, words=5):
    sets = {i: set(jaccard.shingles(t, words).tolist()) for i, t in docs}
    holders = defaultdict(list)
    for i, own in sets.items():
        for shingle in own:
            holders[shingle].append(i)
    links, label = Counter(), {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in sets.items():
        for j, shared in Counter(j for s in own for j in holders[s]).items():
            if j != i and 9 * shared >= 4 * (len(own) + len(sets[j])):
                links[i] += 1
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: (top(i), links[i]) for i in sets}


def near_copies(groups, size, seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(40, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            docs.append((len(docs), " ".join(words)))
    return docs


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in docs])
    got = queries.op5_chosen_path_jaccard(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == want


@pytest.mark.parametrize("limits", [(256, 2048, 1 << 20), (3, 4, 700)])
def test_large_groups_in_blocks(spark, monkeypatch, limits):
    for name, value in zip(("BUCKET", "BLOCK_SETS", "BLOCK_SHINGLES"), limits, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(3, 25) + [(1000 + i, f"all alone number {i} with words of its own {i}") for i in range(5)]
    got = jaccard.join(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == brute(docs)


def test_blocks_without_sets_count_no_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 20)
    docs = near_copies(12, 2)
    got = jaccard.join(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    want = brute(docs)
    assert {r.doc_id: (r.class_id, r.links) for r in got} == want and any(links for _, links in want.values())
    assert all(r.linked_texts <= 1 for r in got)


def test_difficult_rows(spark):
    table = jaccard.join(edge(spark)).toPandas()
    assert len(table) == 13 and table["first"].sum() == 8
    of = table[table.doc_id == 7]
    assert sorted(of.links) == [0, 2, 2, 2]
    assert set(table[table.doc_id.isin([0, 1])].class_id) == {0}
    assert jaccard.join(empty(spark)).count() == 0


def test_one_row_of_each_class_stays(spark):
    kept = jaccard.keep_first(edge(spark))
    assert kept.columns == edge(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 2 and 1 not in ids and 0 in ids and len(ids) == 8


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)], "a bigint, b bigint")
    got = dict(map(tuple, components(links, "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}
