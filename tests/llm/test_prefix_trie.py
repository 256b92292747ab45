"""The trie against one made node by node, in one range and in many."""

import hashlib
import random
import re
import zlib

import pytest

from corpusloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, path string, range int, node string"


def count(text):
    return len([w for w in re.split(r"[ \t-\r]+", text or "") if w])


def code(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows, shared=True):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, code(r[2], r[3]))):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(first, [])[:h] + turns[h:] if shared else turns
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * count(p[-1][1]) if p else 0
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def made(spark, rows, monkeypatch, per_range, shared=True):
    monkeypatch.setattr(prefix_trie, "RANGE_CONVS", per_range)
    df = spark.createDataFrame([(*r, "p", 1, "n") for r in rows], ROWS).repartition(3)
    chains = prefix_trie.chains(df)
    nodes = prefix_trie.trie(prefix_trie.share_beginnings(chains) if shared else chains).collect()
    assert len({(r["conv_id"], r["depth"]) for r in nodes}) == len(nodes)
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in nodes}


def conversations(seed, n=90):
    """Few different turns, so that chains branch, end within others, and are equal."""
    rng = random.Random(seed)
    rows, said = [], [None, "", "yes", "no no", "a b c", "long " * 7]
    for c in rng.sample(range(-30, 400), n):
        rows += [(c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(said[: rng.choice([2, 6])])) for t in range(rng.randint(1, 6))]
    return rows + rows[:5] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("per_range", [1000, 7, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_node_by_node(spark, monkeypatch, per_range, seed):
    rows = conversations(seed)
    assert made(spark, rows, monkeypatch, per_range) == plain(rows)


@pytest.mark.parametrize("per_range", [100, 5])
def test_a_hot_chain_lies_in_many_ranges(spark, monkeypatch, per_range):
    """A third of the conversations are equal, others go on from them or end within them."""
    same = [(t, "user", f"turn {t}") for t in range(6)]
    rows = [(c, *turn) for c in range(20) for turn in same]
    rows += [(100 + c, *turn) for c in range(10) for turn in [*same, (9, "user", f"more {c % 3}")]]
    rows += [(200 + c, *turn) for c in range(10) for turn in same[: c % 6 + 1]]
    rows += [(300 + c, 0, "user", f"own {c}") for c in range(20)]
    assert made(spark, rows, monkeypatch, per_range, shared=False) == plain(rows, shared=False)


@pytest.mark.parametrize("seed", range(60))
def test_ranges_add_up(seed):
    """Chains of two letters, cut into ranges anywhere: what ranges share adds up to what one range finds."""
    rng = random.Random(seed)
    chains = sorted((bytes(b for _ in range(rng.randint(0, 6)) for b in [rng.choice(b"ab")] * prefix_trie.CODE), c) for c in range(rng.randint(1, 30)))
    sizes = [[c % 3 + 1 for c in p[:: prefix_trie.CODE]] for p, _ in chains]
    want = {tuple(r[:2]): r for r in nodes_of(chains, sizes, [len(chains)])}
    cuts = sorted({*rng.sample(range(1, len(chains) + 1), min(len(chains), rng.randint(1, 5))), len(chains)})
    assert {tuple(r[:2]): r for r in nodes_of(chains, sizes, cuts)} == want


def nodes_of(chains, sizes, cuts):
    """(smallest, depth, n, children, leaves, saved, ends) of the trees of ranges, added up by key."""
    out, joint, at = [], {}, 0
    for to in cuts:
        tree = prefix_trie._Tree([c for _, c in chains[at:to]], [p for p, _ in chains[at:to]], sizes[at:to], chains[at - 1][0] if at else None, chains[to][0] if to < len(chains) else None)
        for smallest, depth, n, children, leaves, saved, digest, key, ends in tree.rows:
            if key is None:
                out.append([smallest, depth, n, children, leaves, saved, digest])
            else:
                joint.setdefault(key, []).append((smallest, depth, n, children, leaves, saved, ends))
        at = to
    for rows in joint.values():
        ends = ",".join(r[6] for r in rows if r[6])
        out.append([min(r[0] for r in rows), rows[0][1], *(sum(r[k] for r in rows) for k in (2, 3, 4, 5)), hashlib.sha256(ends.encode()).hexdigest()])
    return out


def test_very_long_conversations_and_texts(spark, monkeypatch):
    rows = [(c, t, "user", f"t{t}" if t < 290 else f"t{t} {c}") for c in (1000, 1001, 1002) for t in range(300)] + [(3, 0, "user", "word " * 50_000)]
    assert made(spark, rows, monkeypatch, 1, shared=False) == plain(rows, shared=False)


def test_no_conversations_no_nodes(spark, monkeypatch):
    assert made(spark, [], monkeypatch, 10) == {}
    assert made(spark, [(None, 0, "user", "x")], monkeypatch, 10) == {}


def test_turnless_conversations_end_in_the_root(spark, monkeypatch):
    """Conversation 1 has h = 3 (of four), its group has no first conversation, and its own turns are fewer."""
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = made(spark, [(turnless, 0, "user", "gone")], monkeypatch, 10)
    assert got == {(turnless, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}
