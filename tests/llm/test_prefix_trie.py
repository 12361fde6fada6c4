"""The prefix trie against brute force; contraction of chains and stars against plain recursion."""

import hashlib
import random
import zlib

from tidewall.llm.prefix_trie import _digests, prefix_trie, subtree_sums


def _rebuilt(rows, block=100, most=6):
    of = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            of.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), role, text))
    plain = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in of.items()}
    cut = lambda c: c - (abs(c) % block) * (1 if c > 0 else -1)
    h = lambda c: zlib.crc32(str(c).encode()) % most
    return {c: plain.get(cut(c), [])[: h(c)] + x[h(c) :] for c, x in plain.items()}


def _brute(rows):
    convs = _rebuilt(rows)
    members = {}
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(o) > len(k) and o[: len(k)] == k for o in below)]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(key)))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _rows(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in prefix_trie(df).collect())


SCHEMA = "conv_id long, turn long, role string, text string, part int, depth int, key string"


def test_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "ab", "ünï😀", "x" * 3000]
    rows = []
    for c in [*rng.sample(range(-250, 500), 60), 0, 100, 200]:
        turns = list(range(rng.choice((1, 2, 4, 7, 9))))
        rows += [(c, rng.choice((t, t, t, None, 1)), rng.choice(("user", "assistant", None)), rng.choice(texts)) for t in turns]
    rows += [(None, 1, "user", "lost"), (300, 1, "user", "a"), (300, 1, "user", "a"), (301, None, None, None)]
    got = _rows(spark.createDataFrame([(*r, 9, 9, "z") for r in rows], SCHEMA).repartition(5))
    assert got == _brute(rows)


def test_long_conversations_chains_and_one_hot_prefix(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (100, 101, 102) for t in range(60 + c % 100)]
    rows += [(c, 0, "system", "hot") for c in range(1000, 1150)] + [(c, 1, "user", str(c % 3)) for c in range(1000, 1150)]
    assert _rows(spark.createDataFrame([(*r, 1, 1, "") for r in rows], SCHEMA).repartition(4)) == _brute(rows)


def test_turnless_and_empty(spark):
    missing = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its century has no conversation
    df = spark.createDataFrame([(missing, 1, "user", "a", 0, 0, "")], SCHEMA)
    assert _rows(df) == [(missing, 0, None, 1, 0, 1, 0, hashlib.sha256(str(missing).encode()).hexdigest())]
    assert _rows(df.filter("conv_id < 0")) == [] and _rows(spark.createDataFrame([(None, 1, "a", "b", 0, 0, "")], SCHEMA)) == []


def test_contraction_gives_every_subtree_total(spark):
    """A forest of chains, stars, a random tree, a caterpillar, and a chain whose levels hardly tell nodes apart."""
    rng, n, rows, want = random.Random(7), 300, [(-1, None, 0, 5)], {-1: 5}
    for k, above in enumerate((lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: i - 1 if i % 2 else max(0, i - 2), lambda i: i - 1)):
        parent, depth, value = {0: None}, {0: 0}, {i: rng.randrange(100) for i in range(n)}
        for i in range(1, n):
            parent[i] = above(i)
            depth[i] = depth[parent[i]] + 1
        total = dict(value)
        for i in reversed(range(1, n)):
            total[parent[i]] += total[i]
        rows += [(k * n + i, None if parent[i] is None else k * n + parent[i], rng.randrange(3) if k == 4 else depth[i], value[i]) for i in range(n)]
        want |= {k * n + i: t for i, t in total.items()}
    got = {r.id: r.value for r in subtree_sums(spark.createDataFrame(rows, "id long, parent long, level long, value long"), ("value",)).collect()}
    assert got == want


def test_digests_join_pieces_in_order(spark):
    ends = spark.createDataFrame([(1, 2, c) for c in range(-5, 900)] + [(3, 2, 9)], "node long, depth long, member long").repartition(4)
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in _digests(ends, piece_bytes=64).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, range(-5, 900))).encode()).hexdigest(), (3, 2): hashlib.sha256(b"9").hexdigest()}
