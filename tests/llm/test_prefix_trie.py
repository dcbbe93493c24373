import hashlib
import random
import zlib

import numpy as np

from subgrade.llm import prefixtrie
from subgrade.llm.listrank import sums_to_end
from tests.conftest import DATA, same_rows

CONVS = "conv_id long, turn long, role string, text string"


def brute(paths):
    """paths: conv_id -> list of (role, text). The nodes as tuples in the query's column order."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def subtree(key):
        own = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        below = [subtree(k) for k in children.get(key, [])]
        return (sum(b[0] for b in below) if below else 1), own + sum(b[1] for b in below)

    out = []
    for key, own in members.items():
        ends = sorted(c for c in own if len(paths[c]) == len(key))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children.get(key, [])), *subtree(key), sha))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_sums_along_lists(spark):
    r = np.random.default_rng(1)
    order = r.permutation(3000) * 3
    rows = [(int(a), int(b) if k % 1000 != 999 else None, 1, int(a) % 7) for k, (a, b) in enumerate(zip(order, np.append(order[1:], 0)))]
    links = spark.createDataFrame(rows, "link long, next long, n long, w long")
    for small in (5000, 40):
        got = {x.link: (x.n, x.w) for x in sums_to_end(links, ["n", "w"], small=small, every=8).collect()}
        assert len(got) == 3000
        for start in range(0, 3000, 1000):
            part = order[start : start + 1000]
            for k, a in enumerate(part):
                assert got[int(a)] == (1000 - k, int((part[k:] % 7).sum()))
    assert sums_to_end(links.limit(0), ["n", "w"]).count() == 0


def test_query_against_sql(spark, duck):
    same_rows(prefixtrie.op11_prefix_trie(spark, str(DATA)).toPandas(), duck.sql(prefixtrie.OP11_SQL).df())


def test_random_tries_against_brute_force(spark):
    r = random.Random(4)
    paths = {c: [(r.choice("ua"), r.choice(["x", "yé", ""])) for _ in range(r.randrange(7))] for c in range(150)}
    paths |= {c: [("u", "same"), ("a", "start")] for c in range(1000, 1100)}  # a group of copies
    paths |= {c: [("u", "same"), ("a", f"fork {c}")] for c in range(2000, 2200)}  # a node with many children
    paths = {c: p for c, p in paths.items() if p}
    rows = [(c, t, *turn) for c, p in paths.items() for t, turn in enumerate(p)]
    df = spark.createDataFrame(rows, CONVS)
    for small in (20_000, 100):
        assert found(prefixtrie.prefix_trie(df, small)) == brute(paths)


def test_long_conversations_nulls_ties_repeats_and_clashing_columns(spark):
    long = [("u", f"t{t}") for t in range(2500)]
    rows = [(1, t, *x) for t, x in enumerate(long)] + [(2, t, *x) for t, x in enumerate(long[:2100])] + [(3, t, *x) for t, x in enumerate([*long[:1500], ("u", "z" * 100_000)])]
    rows += [(4, None, None, None), (5, None, "", ""), (5, None, "", ""), (None, 1, "u", "lost"), (6, 7, "u", "t0"), (6, 9, "u", "t1")]
    paths = {1: long, 2: long[:2100], 3: [*long[:1500], ("u", "z" * 100_000)], 4: [("", "")], 5: [("", ""), ("", "")], 6: long[:2]}
    df = spark.createDataFrame(rows, CONVS).selectExpr("*", "'x' AS digest", "'x' AS span", "'x' AS n_bytes", "'x' AS k1")
    # numbered prefixes, as whole ones of 2,500 turns are too many to hold
    seen, nodes, parent, kids, total, wanted = {}, {}, {}, {}, {}, []
    for c, path in paths.items():
        k = ()
        nodes.setdefault(k, (0, []))[1].append(c)
        for d, turn in enumerate(path, 1):
            up, k = k, seen.setdefault((k, turn), (len(seen),))
            nodes.setdefault(k, (d, []))[1].append(c)
            parent[k] = (up, len(turn[1].encode()))
    for k, (up, _) in parent.items():
        kids.setdefault(up, []).append(k)
    for k, (d, own) in sorted(nodes.items(), key=lambda x: -x[1][0]):
        saved = (len(own) - 1) * (parent[k][1] if d else 0) + sum(total[x][1] for x in kids.get(k, []))
        total[k] = (sum(total[x][0] for x in kids[k]) if k in kids else 1, saved)
    for k, (d, own) in nodes.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == d)
        wanted.append((min(own), d, min(nodes[parent[k][0]][1]) if d else None, len(own), len(kids.get(k, [])), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    assert found(prefixtrie.prefix_trie(df, 500)) == sorted(wanted, key=repr)
    assert prefixtrie.prefix_trie(df.limit(0)).count() == 0


def test_rebuilt_conversations(spark):
    r = random.Random(2)
    convs = {c: [("u", f"{c}-{t}") for t in range(r.randrange(1, 12))] for c in range(40) if c % 7}
    df = spark.createDataFrame([(c, t, *x) for c, p in convs.items() for t, x in enumerate(p)], CONVS)
    turns, ids = prefixtrie.rebuilt(prefixtrie.numbered(prefixtrie.turn_digests(df)))
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    paths = {c: convs.get(c - c % 5, [])[: heads[c]] + convs[c][heads[c] :] for c in convs}
    assert found(prefixtrie.trie_nodes(turns, ids, 50)) == brute(paths)
