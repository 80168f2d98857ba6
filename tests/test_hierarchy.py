import numpy as np
import pytest

from meterload.config import Config
from meterload.operators import hierarchy
from meterload.operators.rollup import cities_of_communities


def numbered_by_hand(rows, size):
    """Sort by city and id, open a community every `size` rows of a city, keep the full ones."""
    out, community, seen = {}, 0, {}
    members = {}
    for city, home in sorted((c, h) for h, c in rows if c is not None):
        if seen.get(city, 0) % size == 0:
            community += 1
        seen[city] = seen.get(city, 0) + 1
        members.setdefault(community, []).append(home)
    for c, homes in members.items():
        if len(homes) == size:
            out.update({h: c for h in homes})
    return out


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_communities_equal_brute_force(spark, ranges):
    rng = np.random.default_rng(1)
    cities = ["Austin", "Aurora", "Boston", "San Diego", "San Jose", None]
    weights = [0.5, 0.05, 0.2, 0.1, 0.1, 0.05]
    ids = rng.choice(5000, 120, replace=False)
    rows = [(int(i), cities[rng.choice(6, p=weights)]) for i in ids]
    homes = spark.createDataFrame(rows, "dataid int, city string")
    for size in (5, 1):
        got = hierarchy.assign_communities(homes, size, ranges=ranges).collect()
        assert {r.dataid: r.community for r in got} == numbered_by_hand(rows, size)


def test_short_city_skips_an_id(spark):
    rows = [(i, "A") for i in range(7)] + [(100 + i, "B") for i in range(5)]
    homes = spark.createDataFrame(rows, "dataid int, city string")
    got = hierarchy.assign_communities(homes, 5).groupBy("community").count().collect()
    assert {r.community: r["count"] for r in got} == {1: 5, 3: 5}


def test_edges_lists_and_subtree(spark):
    cfg = Config(sensors=("air1", "solar", "grid"))
    meta = spark.createDataFrame(
        [("A", 1, 10, True, False, True), ("A", 1, 11, True, True, False), ("B", 2, 12, False, True, True)],
        "city string, community int, dataid int, air1 boolean, solar boolean, grid boolean")
    edges = {tuple(r) for r in hierarchy.edges(meta, cfg).collect()}
    assert edges == {("A", 1, 10, "air1"), ("A", 1, 11, "air1"), ("A", 1, 11, "solar"), ("B", 2, 12, "solar")}
    assert {tuple(r) for r in hierarchy.presence(meta, cfg).collect()} == {e[2:] for e in edges}
    counts = {r["level"]: r["n"] for r in hierarchy.entity_counts(meta, cfg).collect()}
    assert counts == {"appliance": 4, "household": 3, "community": 2, "city": 2}
    tree = {r.city: r.households for r in hierarchy.nested_cities(meta, cfg).collect()}
    assert tree["A"] == {10: ["air1"], 11: ["air1", "solar"]}
    assert [r.sensor for r in hierarchy.appliances_of(meta, 12, cfg).collect()] == ["solar"]
    part = hierarchy.subtree(meta, city="A", community=1, households=[11])
    assert [r.dataid for r in part.collect()] == [11]


def test_cities_are_summed_from_stored_communities(spark):
    community = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (4, 1, 5.0), (4, 2, 7.0)], "community INT, index INT, total DOUBLE")
    metadata = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (4, "B")], "community INT, city STRING")
    got = {tuple(r) for r in cities_of_communities(community, metadata).select("city", "index", "total").collect()}
    assert got == {("A", 1, 5.0), ("B", 1, 5.0), ("B", 2, 7.0)}
