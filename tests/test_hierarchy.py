import random

from pyspark.sql import functions as F

from knowmill.operators.hierarchy import descendants_of, hierarchies, linked, nested_sets, node_rows, subtree_sums, subtrees, truncations

SCHEMA = "task_id string, parent_id string, rank int, size string, path string"


def nodes(spark, links):
    rows = [(k, p, r, "x", "y") for k, p, r in links]
    return node_rows(spark.createDataFrame(rows, SCHEMA), "tasks", "task_id", "parent_id", F.col("rank"))


def brute(links):
    last = {}
    for k, p, r in sorted(links, key=lambda x: (x[2], x[1] or "")):
        last[k.strip().lower()] = (k, (p or "").strip().lower())
    up = {k: p if p in last else None for k, (_, p) in last.items()}
    below = dict.fromkeys(up, 0)
    ways = {}
    for k in up:
        way, at = [k], up[k]
        while at is not None and at not in way and len(way) <= len(up):
            way.append(at)
            at = up[at]
        ways[k] = None if at is not None else way[::-1]
    for way in ways.values():
        for a in (way or [])[:-1]:
            below[a] += 1
    name = lambda k: last[k][0]
    return {name(k): (name(w[0]), len(w) - 1, ">".join(map(name, w)), below[k]) if w else ("", -1, "", -1) for k, w in ways.items()}


def got(spark, links):
    return {r["node_id"]: (r["root_id"], r["depth"], r["path"], r["n_below"]) for r in hierarchies(nodes(spark, links)).collect()}


def test_seven_nodes(spark):
    links = [("E1", None, 0), ("F1", "E1", 0), ("F2", " e1 ", 0), ("C1", "F1", 0), ("T3", "F2", 0), ("T1", "C1", 0), ("T2", "C1", 0)]
    assert got(spark, links) == brute(links)
    assert got(spark, links)["T1"] == ("E1", 3, "E1>F1>C1>T1", 0)


def test_rings_and_dirt(spark):
    links = [("a", "b", 0), ("b", "a", 0), ("c", "b", 0), ("s", "s", 0), ("u", "nowhere", 0), ("v", "  ", 0), ("w", "V", 0), ("w", "V", 0), ("x", "a", 0), ("x", "w", 1), ("y", "x", 0)]
    assert got(spark, links) == brute(links)


def test_random_forests_with_rings(spark):
    rng = random.Random(5)
    for n in (1, 40, 300):
        links = [(f"n{i}", f"n{rng.randrange(max(1, i))}" if i and rng.random() < 0.9 else None, 0) for i in range(n)]
        links += [(f"r{i}", f"r{(i + 1) % 7}", 0) for i in range(7)] + [(f"q{i}", f"r{i}", 0) for i in range(5)]
        assert got(spark, links) == brute(links)


def test_long_chain_and_hot_parent(spark):
    links = [(f"n{i:04}", f"n{i - 1:04}" if i else None, 0) for i in range(300)] + [(f"k{i}", "n0100", 0) for i in range(700)]
    assert got(spark, links) == brute(links)


def test_ranges_nest(spark):
    rng = random.Random(9)
    links = [(f"n{i}", f"n{rng.randrange(i)}" if i else None, 0) for i in range(120)]
    expected = brute(links)
    sets = nested_sets(nodes(spark, links))
    assert sorted(r["lft"] for r in sets.collect()) == list(range(120))
    below = descendants_of(sets, spark.createDataFrame([("tasks", "n0"), ("tasks", "n3")], "src string, k string")).groupBy("ancestor").count().collect()
    assert {r["ancestor"]: r["count"] for r in below} == {k: expected[k][3] for k in ("n0", "n3") if expected[k][3]}


def test_sums(spark):
    links = [("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("d", "a", 0), ("r", "r", 0)]
    rows = linked(nodes(spark, links)).withColumn("n", F.lit(1).cast("bigint"))
    assert {r["k"]: r["n"] for r in subtree_sums(rows, ["n"]).collect()} == {"a": 4, "b": 2, "c": 1, "d": 1}


def test_empty(spark):
    assert got(spark, []) == {}


def test_all_descendants_of_all_nodes(spark):
    rng = random.Random(3)
    links = [(f"n{i}", f"n{rng.randrange(max(0, i - 6), i)}" if i else None, 0) for i in range(90)] + [("a", None, 0), ("b", "a", 0), ("r", "r", 0)]
    sets = nested_sets(nodes(spark, links))
    ways = {k: way[2].split(">") for k, way in brute(links).items() if way[2]}
    expected = {(a, k) for k, way in ways.items() for a in way[:-1]}
    rows = [(r["ancestor"], r["k"]) for r in descendants_of(sets, sets).collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    assert descendants_of(sets.where("false"), sets).count() == 0


def test_subtrees_stop_at_depth_and_number(spark):
    """A chain of seven, and a root of 300 children made in reverse of their names' order."""
    links = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(7)] + [("top", None)] + [(f"k{i:03}", "top") for i in range(300)]
    at = F.timestamp_seconds(F.when(F.col("k").startswith("k"), 1_000_000 - 86_400 * F.substring("k", 2, 3).cast("int")))
    sets = nested_sets(nodes(spark, [(k, p, 0) for k, p in links]).withColumn("at", at))
    shown = subtrees(sets, 5, 200)
    assert [(r["k"], r["level"], r["place"]) for r in shown.where("start = 'c1'").orderBy("place").collect()] == [(f"c{i}", i - 1, i) for i in range(1, 6)]
    assert [r["k"] for r in shown.where("start = 'top'").orderBy("place").collect()] == ["top", *[f"k{i:03}" for i in range(299, 100, -1)]]
    counts = {r["k"]: (r["shown"], r["hidden"], r["in_tree"]) for r in truncations(sets, shown).collect()}
    assert (counts["top"], counts["c0"], counts["c6"], counts["k000"]) == ((200, 101, 301), (5, 2, 7), (1, 0, 7), (1, 0, 301))
