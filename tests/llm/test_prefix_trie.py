import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import same

from inkwell.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(own[c])] for c in own}
    found = {}
    for c in turns:
        base, h = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        found[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in found.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        return [node] + [x for child in children[node] for x in below(child)]

    out = []
    for node, own in members.items():
        sub = below(node)
        ends = sorted(c for c in own if len(found[c]) == len(node))
        out.append(
            (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), sum(not children[x] for x in sub),
             sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in sub if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, **options).collect()]
    assert sorted(got, key=str) == brute(rows)


def conversations(seed, n, depth=6, words=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"]), " ".join(r.choice("ab") for _ in range(r.randrange(words)))) for c in r.sample(range(4 * n), n) for t in range(r.randrange(1, depth))]


def test_against_brute_force(spark):
    rows = conversations(1, 120)
    check(spark, rows)
    check(spark, rows, light=3, held=2)
    check(spark, rows, light=1, held=1)
    check(spark, rows, light=5, levels=2)
    check(spark, conversations(5, 60, depth=14), light=9, levels=3, held=2)


def test_odd_rows(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(1, None, None, None)])
    rows = [(c, t, "user", "same") for c in (0, 1, 2, 3, 20, 21, 22, 23, -1, -20, -21, -40) for t in (0, 0, None, 3)]
    rows += [(5, 0, "a", "x"), (5, 0, "b", "x"), (5, 0, "a", "x"), (5, None, "", "y"), (40, 1, None, "z"), (45, 1, "user", "long " * 50_000), (None, 0, "user", "x")]
    check(spark, rows)
    check(spark, rows, light=2, held=1)


def test_conversation_of_a_third_of_all_turns(spark):
    """It is cut into parts that are numbered one after another."""
    rows = [(7, t, "user", f"w{t % 3}") for t in range(300)] + conversations(2, 100) + [(27, t, "user", f"w{t % 3}") for t in range(200)]
    check(spark, rows)
    check(spark, rows, levels=32)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    rows = [(c, 0, "user", "hello there") for c in range(400)] + [(c, 1, "bot", "again") for c in range(0, 400, 3)]
    check(spark, rows, light=10)


def test_queue_spills():
    r = random.Random(3)
    for held in (1, 7, 1000):
        queue, want = prefix_trie.SpillingQueue(held), []
        for i in range(500):
            key = (r.randrange(40), r.randrange(3))
            queue.push(key, (i,))
            want.append((key, i))
        got = []
        for a in range(40):
            for b in range(3):
                got += [((a, b), m[0]) for m in queue.pop((a, b))]
        assert sorted(got) == sorted(want) and [k for k, _ in got] == sorted(k for k, _ in want)
        assert not queue.files
        queue.close()


def test_sql(spark):
    same(queries.op11_prefix_trie(spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL["op11_prefix_trie"], "/root/testdata/sf0.01")
