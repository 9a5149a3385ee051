"""Vector operators and topics against brute force."""

import os

import numpy as np
import pyarrow as pa
import pytest

from plumbline.operators import insight, topics, vectors
from plumbline.plans import registry
from plumbline.session import shared_folder

SF = "/root/testdata/sf0.01"
VECTORS = "key long, vector array<double>"


def brute_classes(keys, matrix, least):
    rep, near = dict(zip(keys, keys, strict=True)), np.round(matrix @ matrix.T, 5) >= least
    while True:
        step = {a: min([rep[a], *(rep[keys[j]] for j in np.flatnonzero(near[i]))]) for i, a in enumerate(keys)}
        if step == rep:
            return rep
        rep = step


def test_groups_of_more_copies_than_a_list_holds(spark):
    shared_folder(spark)
    x, y, z = [1.0, 0.0, 0.0], [0.9, 0.19**0.5, 0.0], [0.0, 0.0, 1.0]
    rows = spark.createDataFrame([*((i, x) for i in range(8)), *((i, y) for i in range(8, 16)), (20, z)], VECTORS).repartition(3)
    assert {r.key: r.rep for r in vectors.near_duplicate_groups(rows, 0.9).collect()} == dict.fromkeys(range(16), 0)
    assert {r.key: r.rep for r in vectors.near_duplicate_classes(rows, 0.9).collect()} == dict.fromkeys(range(16), 0) | {20: 20}


@pytest.mark.parametrize("block_bytes", [64 << 20, 2000])
def test_classes_of_all_pairs(spark, monkeypatch, block_bytes):
    shared_folder(spark)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(vectors, "TILE", 300)
    matrix = np.random.default_rng(3).normal(size=(120, 6))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    keys = [7 * i % 997 for i in range(120)]
    rows = spark.createDataFrame([(k, v) for k, v in zip(keys, matrix.tolist(), strict=True)], VECTORS).repartition(3)
    found = {r.key: r.rep for r in vectors.near_duplicate_classes(rows, 0.85).collect()}
    assert found == brute_classes(keys, matrix, 0.85) and len(set(found.values())) > 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_row_has_a_class(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = {r.key: r.rep for r in registry.QUERIES["near_dup_classes"](spark, SF).collect()}
    assert found == brute_classes([r.vec_id for r in rows], np.array([r.embedding for r in rows], float), 0.3)


def brute_passes(found, neighbours, mutual, passes):
    """Topics after so many passes, by the operator's rule."""
    for _ in range(passes):
        step = dict(found)
        for key, near in neighbours.items():
            own = next((w for other, w in near if found[other] is not None and found[other] == found[key]), 0.0)
            away = next(((found[other], w) for other, w in near if found[other] is not None and found[other] != found[key]), None)
            if away and (found[key] is None and key in mutual or found[key] is not None and away[1] > own):
                step[key] = away[0]
        found = step
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_reassigned_until_nothing_moves(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    start = {r.key: r.topic for r in registry.QUERIES["topic_size_floor"](spark, SF).collect()}
    near = {r.vec_id: [] for r in rows}
    lists = vectors.knn(spark.createDataFrame([(r.vec_id, [float(x) for x in r.embedding]) for r in rows], VECTORS), 16).persist()
    for r in lists.orderBy("src", "place").collect():
        near[r.src].append((r.dst, r.weight))
    mutual = {k for r in vectors.mutual_edges(lists).collect() for k in (r.src, r.dst)}
    found = {r.key: r.topic for r in registry.QUERIES["topic_reassign"](spark, SF).collect()}
    assert set(start) == set(found) == {r.vec_id for r in rows} and None in start.values()
    assert found == brute_passes(start, near, mutual, 5) != brute_passes(start, near, mutual, 1)


def test_outliers_move_and_orphans_need_a_mutual_neighbour(spark):
    shared_folder(spark)
    assigned = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, None), (5, None)], "key long, topic long")
    near = [(0, 2, 0.9, 1), (0, 1, 0.8, 2), (1, 0, 0.9, 1), (1, 2, 0.9, 2), (2, 3, 0.7, 1), (3, 5, 0.9, 1), (3, 0, 0.3, 2), (4, 5, 0.9, 1), (4, 1, 0.4, 2), (5, 4, 0.9, 1), (5, 2, 0.5, 2)]
    lists = spark.createDataFrame(near, "src long, dst long, weight double, place int")
    found = topics.reassigned(assigned, lists, spark.createDataFrame([(4,)], "key long"), 1)
    # 0 is nearer to topic 2; 1 has a tie and stays; 3 has nobody of its own nearer than 0.3; 5 has no mutual neighbour
    assert {r.key: r.topic for r in found.collect()} == {0: 2, 1: 1, 2: 2, 3: 1, 4: 1, 5: None}


def test_quality_by_hand(spark):
    near = [(0, 1, 0.9), (0, 2, 0.5), (1, 2, 0.8), (1, 0, 0.7), (2, 3, 0.6), (2, 0, 0.6), (3, 0, 0.4), (3, 1, 0.4)]
    lists = spark.createDataFrame([(a, b, w, 1 + i % 2) for i, (a, b, w) in enumerate(near)], "src long, dst long, weight double, place int")
    communities = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, None)], "key long, community long")
    rows = {r.community: r for r in vectors.cluster_quality(lists, communities).collect()}
    overall = (0.9 + 0.8 + 0.6 + 0.4) / 4
    assert (rows[1].rows, rows[1].misplaced, rows[1].outvoted, rows[1].cohesion) == (2, 1, 0, round((0.9 + 0.7) / 2 / overall, 6))
    assert (rows[2].rows, rows[2].misplaced, rows[2].outvoted, rows[2].cohesion) == (2, 1, 2, round((0.6 + 0.0) / 2 / overall, 6))
    many = spark.createDataFrame([(k, n, 0, 0, c) for k, (n, c) in enumerate([(5, 1.0), (6, 0.5), (9, 1.2), (4, 0.1), (7, 0.9)])], "community long, rows long, misplaced long, outvoted long, cohesion double")
    row = vectors.quality_report(many).first()
    assert (row.scored, row.cohesion_median, row.grab_bags) == (31, 1.0, 1)


def test_a_topic_is_inherited_once(spark):
    before = spark.createDataFrame([(1, m) for m in range(8)] + [(2, m) for m in range(10, 14)], "topic long, member long")
    after = spark.createDataFrame([(11, m) for m in range(4)] + [(12, m) for m in range(4, 8)] + [(13, m) for m in range(10, 14)] + [(14, 99)], "topic long, member long")
    found = {r.new_topic: (r.old_topic, r.jaccard) for r in insight.lineage(before, after).collect()}
    assert found == {11: (1, 0.5), 13: (2, 1.0)}


def unit_rows(draw, n):
    sets = {}
    for k in range(n):
        matrix = draw.normal(size=(int(draw.integers(1, 5)), 6))
        sets[k] = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    return sets


@pytest.mark.parametrize("block_bytes", [64 << 20, 300])
def test_duplicates_by_all_pairs(spark, monkeypatch, block_bytes):
    """One repository and kind, both directions' mean, any chain of links, a linked unit stands for its group."""
    shared_folder(spark)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    draw = np.random.default_rng(5)
    sets = unit_rows(draw, 12)
    for k in range(12, 60):
        base = sets[int(draw.integers(0, 12))]
        moved = base + draw.normal(size=base.shape) * draw.choice([0.0, 0.1, 0.15, 0.5])
        sets[k] = moved / np.linalg.norm(moved, axis=1)[:, None]
    about = {k: (f"r{k % 2}", k % 3 == 0, f"gh:{k}" if k % 5 == 0 and k else None) for k in sets}
    found = spark.createDataFrame([(k, m.ravel().tolist(), len(m)) for k, m in sets.items()], "key long, matrix array<double>, rows long").repartition(3)
    units = spark.createDataFrame([(k, *v) for k, v in about.items()], "key long, repo string, item boolean, linked string")
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and about[a][:2] == about[b][:2]:
                scores = sets[a] @ sets[b].T
                if (scores.max(axis=1).mean() + scores.max(axis=0).mean()) / 2 >= 0.95:
                    root[find(b)] = find(a)
    groups = {}
    for k in sets:
        groups.setdefault(find(k), []).append(k)
    wanted = {k: (min(g, key=lambda x: (about[x][2] is None, x)), len(g)) for g in groups.values() for k in g}
    got = {r.key: (r.rep, r["size"]) for r in vectors.duplicate_units(found, units).collect()}
    assert got == wanted and 5 < len(groups) < 50


@pytest.mark.parametrize("batch", [7, 10_000])
def test_neighbours_in_two_stages(spark, batch):
    """Pooled candidates, then exact MaxSim; what a task emits doesn't depend on the Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        sets = unit_rows(np.random.default_rng(6), 50)
        rows = spark.createDataFrame([(k, m.ravel().tolist(), len(m)) for k, m in sets.items()], "key long, matrix array<double>, rows long").repartition(3)
        pooled = {k: m.mean(axis=0) / np.linalg.norm(m.mean(axis=0)) for k, m in sets.items()}
        wanted = set()
        for a in sets:
            near = sorted((k for k in sets if k != a), key=lambda k: (-round(float(pooled[a] @ pooled[k]), 5), k))[:9]
            scored = sorted(((round(float((sets[a] @ sets[k].T).max(axis=1).sum()), 5), k) for k in near), key=lambda x: (-x[0], x[1]))[:4]
            wanted |= {(a, k, place + 1) for place, (_, k) in enumerate(scored)}
        got = vectors.maxsim_knn(rows, 4, 9)
        assert {(r.src, r.dst, r.place) for r in got.collect()} == wanted
        plain = vectors.knn(rows.select("key", "matrix").where("rows = 3").withColumnRenamed("matrix", "vector"), 3)
        assert plain.count() == 3 * sum(len(m) == 3 for m in sets.values())
        reps = spark.createDataFrame([(k, 0 if k in (3, 8) else k) for k in sets], "key long, rep long")
        kept = vectors.without_duplicates(got, reps).collect()
        assert not {r.src for r in kept} & {3, 8} and not {r.dst for r in kept} & {3, 8} and sorted({r.place for r in kept}) == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("block_bytes", [64 << 20, 100])
def test_search_of_every_query(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    draw = np.random.default_rng(4)
    sets = {k: draw.normal(size=(int(draw.integers(0 if k % 9 else 1, 5)), 3)) for k in range(60)}
    rows = spark.createDataFrame([(k, m.ravel().tolist(), len(m)) for k, m in sets.items()], "key long, matrix array<double>, rows long").repartition(3)
    found = {}
    for r in vectors.maxsim_search(rows, rows.where("key % 9 = 0"), 4).orderBy("query", "place").collect():
        found.setdefault(r.query, []).append((r.key, round(r.score, 5)))
    for query in range(0, 60, 9):
        scores = {k: round(float((sets[query] @ m.T).max(axis=1).sum()), 5) if len(m) else 0.0 for k, m in sets.items()}
        assert found.pop(query) == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert not found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_query_for_every_fiftieth_matrix(spark):
    found = registry.QUERIES["maxsim_topk_all"](spark, SF).groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in found} == {k: 10 for k in range(0, 125, 50)}


class Sent:
    """A broadcast of this process."""

    def __init__(self, value):
        self.value = value


def test_neighbours_by_brute_force(spark, monkeypatch):
    """Copies, vectors that single precision can't tell apart, long ones and zeros: as by all pairs, ties by key."""
    draw = np.random.default_rng(8)
    matrix = draw.normal(size=(300, 8))
    matrix[100:160] = matrix[0] + draw.normal(size=(60, 8)) * 1e-6
    matrix[160:200] = matrix[1]
    matrix[200:210] *= 1000
    matrix[210:214] = 0
    keys = [(i * 7919) % 1009 for i in range(300)]
    wanted = set()
    for a, x in zip(keys, matrix, strict=True):
        near = sorted((-round(float(w), 5), b) for b, w in zip(keys, matrix @ x, strict=True) if a != b)[:5]
        wanted |= {(a, b, place + 1) for place, (_, b) in enumerate(near)}
    rows = spark.createDataFrame([(k, v) for k, v in zip(keys, matrix.tolist(), strict=True)], VECTORS).repartition(3)
    for block_bytes, queries, group, tile in ((64 << 20, 8192, 1024, 4 << 20), (9000, 64, 7, 300), (5000, 64, 7, 600)):
        for name, value in (("BLOCK_BYTES", block_bytes), ("QUERIES", queries), ("GROUP", group), ("TILE", tile)):
            monkeypatch.setattr(vectors, name, value)
        found = vectors.knn(rows, 5).collect()
        assert {(r.src, r.dst, r.place) for r in found} == wanted and len(found) == 1500
        # workers have their own constants: the same in this process
        blocks = [Sent((np.array(keys[at : at + 90]), matrix[at : at + 90])) for at in range(0, 300, 90)]
        batches = pa.Table.from_pydict({"key": keys, "vector": matrix.tolist()}).to_batches(max_chunksize=37)
        own = [r for batch in vectors._nearest(iter(batches), blocks, 5) for r in batch.to_pylist()]
        assert {(r["src"], r["dst"], r["place"]) for r in own} == wanted and len(own) == 1500
    assert vectors.knn(rows.limit(3), 5).count() == 6 and vectors.knn(rows.limit(0), 5).count() == 0


def test_neighbours_are_found_once_by_several_tasks(spark):
    """Vectors in one file are dealt to tasks, and what reads the lists doesn't find them anew."""
    matrix = np.random.default_rng(9).normal(size=(1200, 4))
    rows = spark.createDataFrame(list(enumerate(matrix.tolist())), VECTORS).coalesce(1)
    lists = vectors.knn(rows, 3)
    assert len(lists.inputFiles()) > 1
    assert "MapInArrow" not in vectors.mutual_edges(lists)._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_many_near_copies_grow_with_the_units(spark):
    """A task gives the links that connect, not one for each pair; blocks and single precision lose none."""
    draw = np.random.default_rng(10)
    base = draw.normal(size=(4, 2, 16))
    sets = base[np.arange(240) % 4] / np.linalg.norm(base[np.arange(240) % 4], axis=2)[:, :, None] + draw.normal(size=(240, 2, 16)) * 1e-4
    group = [f"g{i % 8 // 4}" for i in range(240)]
    blocks = [Sent((np.arange(at, at + 60), np.array(group[at : at + 60], object), np.full(60, 2), sets[at : at + 60].reshape(120, 16))) for at in range(0, 240, 60)]
    rows = pa.Table.from_pydict({"key": list(range(240)), "group": group, "matrix": sets.reshape(240, -1).tolist(), "rows": [2] * 240})
    links = [(r["a"], r["b"]) for batch in vectors._duplicates(iter(rows.to_batches(max_chunksize=50)), blocks, 0.95) for r in batch.to_pylist()]
    rep = {i: i for i in range(240)}
    for _ in rep:
        for a, b in links:
            rep[a] = rep[b] = min(rep[a], rep[b])
    assert rep == {i: i % 8 for i in range(240)} and len(links) == 240 - 8


def test_second_stage_sends_no_matrix_for_a_pair(spark):
    """Candidates meet their matrices in blocks, whatever block they are in; units without vectors have weight 0."""
    draw = np.random.default_rng(11)
    sets = {k: draw.normal(size=(k % 4, 5)) for k in range(40)}
    near = {k: [j for j in range(39, -1, -1) if j != k and (j + k) % 3] for k in sets}
    flat = lambda keys: np.concatenate([sets[k] for k in keys])
    blocks = [Sent((np.arange(at, 40, 3), np.arange(at, 40, 3) % 4, flat(range(at, 40, 3)))) for at in range(3)]
    rows = pa.Table.from_pydict({"key": list(sets), "matrix": [m.ravel().tolist() for m in sets.values()], "rows": [len(m) for m in sets.values()], "near": list(near.values())})
    found = [(r["src"], r["dst"], r["weight"], r["place"]) for batch in vectors._pair_maxsim(iter(rows.to_batches(max_chunksize=7)), blocks, 4) for r in batch.to_pylist()]
    wanted = []
    for k, others in near.items():
        scored = [(round(float((sets[k] @ sets[j].T).max(axis=1).sum()), 5) if len(sets[k]) and len(sets[j]) else 0.0, j) for j in others]
        wanted += [(k, j, w, place + 1) for place, (w, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:4])]
    assert found == wanted


class Counted(float):
    """A resolution that counts how often a choice is weighed with it."""

    times = 0

    def __mul__(self, other):
        Counted.times += 1
        return float(self) * other


def test_nodes_are_looked_at_again_after_changes_only():
    """A chain moves in many passes; triangles far from it settle soon and aren't weighed again."""
    chain = [(i, i + 1, 1.0 + i / 60) for i in range(59)]
    triangles = [(60 + 3 * i + a, 60 + 3 * i + b, 1.0) for i in range(300) for a, b in ((0, 1), (0, 2), (1, 2))]
    Counted.times = 0
    found = vectors.communities_of(960, chain + triangles, Counted(0.5))
    alone = Counted.times
    Counted.times = 0
    assert max(vectors.communities_of(60, chain, Counted(0.5))) >= 0 and len(set(found[60:])) == 300
    assert all(len(set(found[60 + 3 * i : 63 + 3 * i])) == 1 for i in range(300))
    assert alone - Counted.times < 900 * 6
