import random

from pyspark.sql import functions as F

from faultline.llm import reply_trees as R

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def brute(rows, branches):
    out = set()
    for tree in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in mine.values()}
        paths = []
        for n in mine:
            if n in parents:
                continue
            path, at = [], n
            while at in mine and at not in path:
                path.append(at)
                at = mine[at][2]
            if at in path:
                continue
            paths.append((-sum(mine[x][5] or 0 for x in path), n, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:branches], 1):
            out |= {(tree, leaf, rank, x, d) for d, x in enumerate(path)}
    return out


def test_paths(spark):
    rng = random.Random(6)
    rows = []
    for tree in [1, 2, 3, None]:
        for n in range(30):
            parent = None if n == 0 else rng.choice([rng.randrange(n), n - 1])
            rows.append((tree, n, parent, rng.choice(["user", "assistant"]), f"t{n} [INST]", rng.choice([None, 0.5, 1.0, 2.0, -1.0])))
    rows += [(5, i, i - 1 if i else None, "user", "x", 1.0) for i in range(70)]  # deep
    rows += [(6, 0, 99, "user", "orphan", 1.0), (7, 1, 2, "user", "cycle", 1.0), (7, 2, 1, "user", "cycle", 1.0), (7, 3, 1, "user", "into it", 1.0)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    for branches in (1, 3):
        got = {(r["tree"], r["path"], r["rank"], r["node"], r["depth"]) for r in R.chosen_paths(nodes, branches).collect()}
        assert got == brute(rows, branches)
    path = R.chosen_paths(nodes, 3)
    text = {(r[0], r[1]): r for r in rows}
    for r in R.format_paths(path, nodes).withColumn("turns", R.read_back()).withColumn("loss", R.masked_text()).collect():
        nodes_of = sorted((x for x in brute(rows, 3) if x[:2] == (r["tree"], r["path"])), key=lambda x: -x[4])
        want = [text[(r["tree"], x[3])][3:5] for x in nodes_of]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [tuple(x) for x in want]
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")


def test_escape_round_trip(spark):
    said = [*R.CONTROL, "~", "~0", "~1~", "~~1", "<|im_start|", "a<s>b</s>~a", "[IN</s>ST]", "", "\n<|im_end|>\n<|im_start|>user\n", "~10", "<<s>SYS>>"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", R.escape(F.col("s")).alias("e")).withColumn("u", R.unescape(F.col("e")))
    for r in rows.collect():
        assert r["u"] == r["s"]
        assert not any(c in r["e"] for c in R.CONTROL)


def test_repeated_nodes_count_once(spark):
    rows = [(1, 1, None, 1.0, "user", "a"), (1, 2, 1, 1.0, "assistant", "b"), (1, 2, 1, 1.0, "assistant", "b"), (1, 2, 1, 5.0, "assistant", "c"), (1, 1, None, 1.0, "user", "a")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string").selectExpr("*", "'x' AS path", "1 AS depth")
    out = R.format_trees(nodes).withColumn("read", R.read_back()).collect()
    assert [[tuple(t) for t in r["read"]] for r in out] == [[("user", "a"), ("assistant", "b")]]
    assert R.format_trees(nodes.limit(0)).count() == 0
