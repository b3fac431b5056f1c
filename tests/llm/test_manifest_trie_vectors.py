"""Merkle manifest, prefix trie and near vectors against brute force, on odd rows too."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import prefix_trie as T
from quillon.llm.embedding_dedup import Rows, near_vectors, possible, quantise, unit
from quillon.llm.merkle import FAN, HEIGHT, crc_divides, descend, digest, fold, lower_ascii, merkle_manifest, rise

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels of a tree, from leaves to root, as lists."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // FAN * FAN
        out += [(level[first:at], level[at + 1 : first + FAN])]
        at //= FAN
    return out


def climb(leaf, steps):
    for before, after in steps:
        leaf = H(*before, leaf, *after)
    return leaf


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 700])
def test_sweeps(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = tree(leaves)
    nodes = rise(leaves, len(levels) - 1)
    assert (nodes[-1][3] if nodes else leaves[0]) == levels[-1][0]
    assert sorted((lv, i, d) for lv, i, _, d in nodes) == sorted((lv, i, d) for lv, level in enumerate(levels) if lv for i, d in enumerate(level))
    above = ("x", "y", None)
    for i, proof in enumerate(descend(leaves, nodes, above)):
        assert fold(leaves[i], proof) == digest("x" + levels[-1][0] + "y")
        steps = []
        while proof is not above:
            steps.append(proof[:2])
            proof = proof[2]
        assert steps == [("".join(a), "".join(b)) for a, b in siblings(levels, i)]


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for rows of FIELDS."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        claim = H(*map(said, (*r[:4], low(r[4])))) if tampered else None
        groups[r[2]].append((r[0] is not None, r[0] or 0, H(*map(said, r)), claim, r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = siblings(trees[g], i) + siblings(top, k)
            folded = climb(x[3] or x[2], steps)
            out.append((x[4], x[2], trees[g][-1][0], top[-1][0], H(*(d for a, b in steps for d in (*a, *b))), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest(docs, proofs=False):
    text = F.when(crc_divides(F.col("doc_id"), 3), lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle_manifest(docs, FIELDS, claims={"text": text}, proofs=proofs)


def test_manifest(spark):
    r = random.Random(5)
    rows = [(i, f"s{i % 4}", r.choice(["en", "en", "en", "de", None, "", "ü"]), i * 3, r.choice(["Some Text", "ÄÖ X", "", "plain"]) + (" W" * i if i % 50 == 0 else "") if i % 7 else None) for i in range(900)]
    rows += [(None, None, None, None, None), (3, "s", "en", 1, "Twice"), (3, "s", "en", 1, "Twice"), (3, "s", "en", 2, "Third"), (5000, "s", "solo", 1, "A" * 3_000_000)]
    rows += [(10_000 + i, "s", f"lang{i}", i, "One Each") for i in range(70)]
    docs = spark.createDataFrame([(*x, "k", 1, 2, 3) for x in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, key string, grp int, pos int, leaf int")
    got = manifest(docs.repartition(5), proofs=True).collect()
    assert sorted((tuple(x)[:7] for x in got), key=repr) == brute_manifest(rows)
    assert all(H(*(s["before"] + s["after"] for s in x.proof)) == x.proof_sha256 and climb(x.leaf, [(s["before"], s["after"]) for s in x.proof]) == x.root for x in got)
    assert {x.verified for x in got} == {True, False}
    assert manifest(docs.limit(0)).count() == 0


def test_manifest_of_more_than_one_block(spark):
    """A group of more leaves than a sweep climbs over, and a number that ends at a block's border."""
    for n in (FAN**HEIGHT, FAN**HEIGHT + 1, 2 * FAN**HEIGHT + 77):
        docs = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('Text ', id) AS text")
        got = sorted((tuple(x) for x in manifest(docs).collect()), key=repr)
        assert got == brute_manifest([(i, "s", "en", i, f"Text {i}") for i in range(n)])


# ------------------------------------------------------------------ prefix trie


def brute_trie(paths):
    """Rows of the trie over {conversation: [(said, size)...]}."""
    nodes = defaultdict(lambda: {"members": [], "ends": [], "size": 0})
    for c in sorted(paths):
        p = tuple(paths[c])
        for d in range(len(p) + 1):
            nodes[p[:d]]["members"].append(c)
            nodes[p[:d]]["size"] = p[d - 1][1] if d else 0
        nodes[p]["ends"].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(nodes[p]["members"]) - 1) * nodes[p]["size"]
    return sorted(
        ((n["members"][0], len(p), nodes[p[:-1]]["members"][0] if p else None, len(n["members"]), len(children[p]), leaves[p], saved[p], H(",".join(map(str, n["ends"])))) for p, n in nodes.items()), key=repr
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", range(12))
def test_peeling_in_slabs(seed):
    """Slabs of any size, pass after pass, give the trie of all; open nodes are met in the last pass."""
    r = random.Random(seed)
    record = lambda w: hashlib.md5(str(w).encode()).digest() + (w + 1).to_bytes(8, "big")
    convs = {c: [(w, w + 1) for w in (r.randrange(2) for _ in range(r.choice([0, 1, 2, 3, 9])))] for c in range(r.choice([1, 5, 60]))}
    rows = sorted((b"".join(record(w) for w, _ in p), c) for c, p in convs.items())
    out, cut, i = [], r.choice([1, 3, 10]), 0
    while i < len(rows):
        n = r.randrange(1, cut + 1)
        out += T._conversations([x[0] for x in rows[i : i + n]], [x[1] for x in rows[i : i + n]]).peel(False)
        i += n
    nodes, members = [x for x in out if x["kind"] == "node"], [x for x in out if x["kind"] == "members"]
    left = [x for x in out if x["kind"] == "open"]
    for whole, step in ((False, 3), (False, 4), (True, None)):
        left.sort(key=lambda x: x["path"])
        now = []
        for i in range(0, len(left), step or len(left)):
            part = left[i : i + (step or len(left))]
            own = {s: np.concatenate([np.array(x[s], np.int64) for x in part]) for s in T._SUMS}
            now += T.Slab([x["path"] for x in part], own, None).peel(whole)
        left = [x for x in now if x["kind"] == "open"]
        nodes += [x for x in now if x["kind"] == "node"]
    assert not left
    texts = defaultdict(list)
    for m in sorted(members, key=lambda m: m["conv_id"]):
        texts[m["key"]].append(m["ends"])
    above = {x["key"]: x["conv_id"] for x in nodes if "key" in x}
    for x in nodes:
        x["ends_sha256"] = x["ends"] or H(",".join(texts[x["key"]]))
        x.setdefault("parent_conv_id", above.get(x.get("parent_key")))
    assert sorted((tuple(x[c] for c in COLUMNS) for x in nodes), key=repr) == brute_trie(convs)


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[c].append(((turn is not None, turn or 0, H(said)), (said, len((text or "").encode()))))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def test_trie_on_odd_rows(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "", None, "Hallo Ü", "x" * 50])) for c in range(120) for t in range(r.choice([1, 2, 5, 12]))]
    rows += [(500, None, None, None), (500, None, "user", "first"), (500, 1, None, "b"), (500, 1, "a", "b"), (500, 1, "a", "b"), (None, 1, "user", "lost"), (711, 1, "u", "no donor"), (712, 9, "u", "z" * 2_000_000)]
    rows += [(900 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]
    rows += [(2000, t, "user", f"long {t}") for t in range(700)] + [(2001, t, "user", f"long {t}") for t in range(650)]
    table = spark.createDataFrame([(*x, "p", 1, 2) for x in rows], "conv_id bigint, turn bigint, role string, text string, path string, depth int, key int").repartition(7)
    got = T.prefix_trie(T.donated(table))
    assert sorted((tuple(x[c] for c in COLUMNS) for x in got.collect()), key=repr) == brute_trie(brute_rebuilt(rows))
    assert T.prefix_trie(T.donated(table.limit(0))).count() == 0


# ------------------------------------------------------------------ near vectors


def brute_near(rows, threshold):
    fit = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if fit(a) and fit(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[find(i)].append(k)
    least = [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted(((k, links[i], least[i], k is not None and k == least[i]) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_near_vectors(spark, threshold):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 12))
    rows = [(i, (base[i % 30] + rng.normal(size=12) * rng.choice([0.05, 0.25, 0.6])).tolist()) for i in range(260)]
    rows += [(300 + i, (base[0] * (i + 1)).tolist()) for i in range(20)] + [(400 + i, base[1].tolist()) for i in range(40)]
    rows += [(500, None), (501, [0.0] * 12), (502, [float("nan")] * 12), (503, [1.0, None] + [0.0] * 10), (504, [float("inf")] + [1.0] * 11), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (507, [2.0, 4.0])]
    rows += [(None, base[2].tolist()), (3, base[3].tolist()), (508, [-0.0] + [1.0] + [0.0] * 10), (509, [0.0, 1.0] + [-0.0] * 10), (510, (base[4] * 1e200).tolist()), (511, (base[4] * 1e-200).tolist())]
    brute = [(k, v if v is None or k not in (510, 511) else base[4].tolist()) for k, v in rows]
    table = spark.createDataFrame([(*x, 1, 2, "b") for x in rows], "vec_id bigint, embedding array<double>, node int, root int, vector string").repartition(3)
    got = near_vectors(table, threshold)
    assert got.columns == [*table.columns, "n_links", "component_id", "kept"]
    assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in got.collect()), key=repr) == brute_near(brute, threshold)
    assert near_vectors(table.limit(0)).count() == 0 and near_vectors(table.filter("vec_id IN (500, 501)")).count() == 2


@pytest.mark.parametrize("size", [3, 64, 2100])
def test_bounds_lose_nothing(size):
    """Every pair at the threshold is a possible one, and pairs far from it are not."""
    rng = np.random.default_rng(size)
    base = rng.normal(size=(40, size))
    u = unit(np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0.1, 0.7, (40, 1)), base * rng.uniform(0, 9, base.shape)]))
    rows = Rows(*quantise(u))
    cosine = u @ u.T
    for threshold in (0.05, 0.9, 0.99):
        found = np.zeros(cosine.shape, bool)
        found[possible(rows, 0, rows, 0, threshold)] = True
        assert found[cosine >= threshold].all() and not found[cosine < threshold - 0.25].any()


def test_near_vectors_over_blocks(spark):
    """A large group of near copies, over several tiles and block pairs."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    v = np.concatenate([centre + rng.normal(size=(2600, 24)) * 0.2, rng.normal(size=(900, 24))])
    rows = [(i * 11 % 3500, x.tolist()) for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(table).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    ids = np.array([i for i, _ in rows])
    low = ids.copy()
    while (new := np.where(near, low[None, :], 1 << 60).min(1)).tolist() != low.tolist():
        low = new
    assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1) - 1, low, strict=True)}
