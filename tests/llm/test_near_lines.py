"""Links of near lines: few rounds through the shared folder, components by task, blocks of many families."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weighyard.llm import common, components, families
from weighyard.llm import paragraph_dedup as dedup


@pytest.fixture
def rows(spark):
    common.ship_package(spark)
    return spark


def reach(links):
    """{node: smallest node within reach}, for nodes with another one."""
    top = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in top:
        for a, b in links:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    return top


def test_few_tables_are_written_on_the_way(rows, monkeypatch):
    """Each one costs a shuffle's and a table's files in every partition."""
    rng, texts = random.Random(4), []
    base = [[f"w{n}x{k}" for k in range(60)] for n in range(12)]
    for n in range(150):
        line = list(base[n % 12])
        for at in rng.sample(range(60), rng.randint(0, 3)):
            line[at] = f"changed{n}x{at}"
        texts.append((n, " ".join(line)))
    df = rows.createDataFrame(texts, "doc_id long, text string")
    written, usual = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **b: written.append(1) or usual(self, *a, **b))
    found = dedup.repeated_lines(df).collect()
    assert len({r.doc_id for r in found}) > 70
    assert len(written) <= 30


@pytest.mark.parametrize("most", [1 << 17, 40])
def test_components_joined_by_tasks(rows, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_LINKS", most)
    rng = random.Random(most)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(999, 999)]
    df = rows.createDataFrame([*links, (None, 5), (7, None)], "a long, b long").repartition(5)
    found = components.task_components(df).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.component for r in found} == reach(links)
    assert components.task_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("hits", [2_000_000, 30, 1])
def test_block_links_by_all_pairs(monkeypatch, hits):
    monkeypatch.setattr(families, "_HITS", hits)
    rng, made = random.Random(5), []
    for at in range(60):
        family = rng.randrange(4)
        shingles = sorted(set(range(100 * (at % 5), 100 * (at % 5) + 20)) - {100 * (at % 5) + rng.randrange(20) for _ in range(2)})
        made.append((family, 0, 1000 + at, rng.randrange(6), len(shingles), rng.random() < 0.5, rng.random() < 0.8, shingles))
    names = ["family", "block", "class", "component", "n", "asks", "member", "shingles"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
    parts = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], names=names)
             for part in (made[:25], made[25:])]
    out = families.block_links(parts, 4, 5)
    of = {r[2]: r for r in made}
    found = {(a, of[b][3]) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    near = {(a, b) for a, r in of.items() for b, s in of.items() if r[5] and s[6] and r[0] == s[0] and r[3] != s[3]
            and 9 * len(np.intersect1d(r[7], s[7])) >= 4 * (r[4] + s[4])}
    assert near and set(zip(out["a"].to_pylist(), out["b"].to_pylist())) <= near
    assert found == {(a, of[b][3]) for a, b in near} and out.num_rows == len(found)


def test_packed_links_join_what_family_links_join(rows):
    rng, sets = random.Random(6), {}
    for at in range(80):
        start = 1000 * (at % 7)
        sets[at] = sorted(set(range(start, start + 40)) - {start + rng.randrange(40) for _ in range(rng.randint(0, 6))})
    classes = rows.createDataFrame([(k, len(s), s) for k, s in sets.items()], "class long, n int, shingles array<long>")
    lists = rows.createDataFrame([(k % 7, k, k - k % 3) for k in sets], "shingle long, class long, component long")
    plain = families.family_links(families.family_table(lists, classes), classes, 4, 5).collect()
    table = families.family_table(lists, classes, components.task_components, 64).cache()
    packed = families.packed_links(table, classes, 4, 5).collect()
    assert table.agg({"blocks": "max"}).first()[0] > 1
    grown = [reach([(r.a, r.b) for r in links] + [(k, k - k % 3) for k in sets]) for links in (plain, packed)]
    assert plain and grown[0] == grown[1]
