import random

import numpy as np
import pandas as pd

from veristrand.llm.common import Scratch, min_labels, sorted_groups
from veristrand.llm.components import connected_components


def test_against_union_find(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)]  # a chain
    links += [(1000, 1000 + i) for i in range(1, 300)]  # a hub
    links += [(2000 + r.randrange(200), 2000 + r.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3), (-9, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {x["node"]: x["root"] for x in connected_components(df, Scratch(spark, "test")).collect()}
    known = [(a, b) for a, b in links if a is not None and a != b]
    nodes = sorted({x for p in known for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    lab = min_labels(len(nodes), np.array([at[a] for a, _ in known]), np.array([at[b] for _, b in known]))
    assert got == {x: nodes[lab[i]] for i, x in enumerate(nodes)}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_groups_are_never_cut():
    r = random.Random(4)
    keys = sorted(r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7]) for _ in range(500))
    cuts = sorted(r.sample(range(1, 500), 40))
    batches = [pd.DataFrame({"k": keys[a:b]}) for a, b in zip([0, *cuts], [*cuts, 500], strict=True)]
    parts = list(sorted_groups(iter(batches), ["k"]))
    assert [k for p in parts for k in p["k"]] == keys
    seen = [set(p["k"]) for p in parts]
    assert sum(map(len, seen)) == len(set(keys))
    assert list(sorted_groups(iter([]), ["k"])) == []
