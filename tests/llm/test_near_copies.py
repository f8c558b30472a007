"""Near copies against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import near_copies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_roots(sets):
    """Each set's component, of all pairs with a resemblance of 0.8 or more."""
    up = {s: s for s in sets}

    def find(x):
        while up[x] is not x:
            x = up[x]
        return x

    all_ = list(up)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                up[find(a)] = find(b)
    return {s: find(s) for s in up}


def groups(labels):
    out = collections.defaultdict(list)
    for key, label in labels:
        out[label].append(key)
    return sorted((sorted(v, key=repr) for v in out.values()), key=repr)


def near_corpus():
    rng = random.Random(11)
    prose = lambda n: ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 8))) for _ in range(n)]
    shared, out = prose(60), []
    for size in (12, 40, 150, 400):
        base = prose(size)
        out.append(base)
        for k in (1, 1, 2, 3, 4, 6, 8):  # some above 0.8 and some below, and some only through others
            w = list(out[-1])
            for i in rng.sample(range(len(w)), min(k, len(w))):
                w[i] = "x" + w[i]
            out.append(w)
    out += [prose(rng.randrange(5, 60)) + shared + prose(rng.randrange(5, 60)) for _ in range(25)]  # share a passage alone
    texts = [" ".join(w) for w in out] + ["", None, " \n", "One two", "one  TWO", "one two three", "a b c d e", "a b c d e f", "A\tb c d e"]
    return [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[3], "s"), (None, texts[3] + " end", "s")]


@pytest.mark.parametrize("often", [5, 2])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    data = near_corpus()
    roots = brute_roots({shingles(t) for _, t, _ in data})
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    keyed = df.select("doc_id", F.xxhash64("doc_id", "text").alias("dkey"), "text").distinct().collect()
    text = {(r.doc_id, r.dkey): r.text for r in keyed}
    found = near_copies.classes(spark, df).collect()
    assert len(found) == len(data)
    got = groups({((r.doc_id, r.dkey), r.root) for r in found})
    want = groups({(k, roots[shingles(t)]) for k, t in text.items()})
    assert got == want and 1 < len(want) < len(data) - 10
    kept = near_copies.deduplicated(spark, df)
    assert kept.columns == df.columns
    least = sorted(min((k[0] is None, k[0] or 0) for k in g) for g in want)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == least
    assert near_copies.deduplicated(spark, df.where("doc_id < -1")).count() == 0


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark):
    import corpus_pipeline

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(248)]
    other = [*words]
    other[50], other[120], other[200] = "p", "q", "r"
    a, b = " ".join(words), " ".join(other)
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 2
    df = spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, " ".join(reversed(words)), "s")], SCHEMA)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect()) == [1, 3]


def test_sets_do_not_depend_on_how_texts_are_batched():
    given = [b"a b c d e f", b"", b"a b", b"x A b C d E f g", b"a b c d e f"]
    data, ends = np.frombuffer(b"".join(given), np.uint8), np.cumsum([0, *map(len, given)])
    whole = [s.tolist() for s in near_copies.shingle_sets(data, ends)]
    alone = [next(iter(near_copies.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)])))).tolist() for t in given]
    assert whole == alone and list(map(len, whole)) == [2, 0, 1, 4, 2] and set(whole[0]) < set(whole[3])


def test_simhash_links_are_a_step_of_the_stage(spark, monkeypatch):
    rng = random.Random(4)
    base = [["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)] for _ in range(12)]
    texts = [" ".join(w) for b in base for w in (b, [*b[:150], "p", *b[151:]])]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, texts[0], "", None])], SCHEMA)
    seen, real = [], near_copies.linked
    monkeypatch.setattr(near_copies, "linked", lambda work, nodes: seen.append((nodes, real(work, nodes))) or seen[-1][1])
    assert near_copies.classes(spark, df).select("root").distinct().count() == 13
    nodes, pairs = seen[0]
    fp = {r.node: r.fp & (1 << 64) - 1 for r in nodes.select("node", "fp").collect()}
    node = [near_copies.node_of(next(iter(near_copies.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))))) for t in texts]
    got = {(r.u, r.v) for r in pairs.collect()}
    assert all((fp[u] ^ fp[v]).bit_count() <= near_copies.WIDE for u, v in got)
    twins = {tuple(sorted(node[i : i + 2])) for i in range(0, len(node), 2)}
    close = {p for p in twins if (fp[p[0]] ^ fp[p[1]]).bit_count() <= 2}
    assert close and close <= got
    assert any((fp[u] ^ fp[v]).bit_count() > 2 for u, v in got & twins)


def test_links_of_a_large_group_of_near_copies_grow_with_its_size(spark):
    from tracelens.llm.common import Workspace

    class Counted(Workspace):
        rows = 0

        def table(self, df, name):
            out = super().table(df, name)
            self.rows = out.count() if name == "met" else self.rows
            return out

    rng = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    low, high = rng.getrandbits(32), rng.getrandbits(32)
    # all alike in one half, and within a few bits of each other in the other
    every = [signed(low | (high ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(1, 8)))) << 32) for _ in range(600)]
    for n in (300, 600):
        fps = sorted(set(every[:n]))
        nodes = spark.createDataFrame([(1000 + i, fp, 9) for i, fp in enumerate(fps)], "node long, fp long, n int")
        work = Counted(spark, "links")
        pairs = {(r.u - 1000, r.v - 1000) for r in near_copies.linked(work, nodes).collect()}
        bits = lambda u, v: ((fps[u] ^ fps[v]) & (1 << 64) - 1).bit_count()
        assert work.rows <= 99 * len(fps)  # 34 places and 65 points each; all pairs are 299 or 599 for each
        assert {u for p in pairs for u in p} == set(range(len(fps))) and all(bits(u, v) <= near_copies.WIDE for u, v in pairs)
        linked = {u for p in pairs if bits(*p) <= 2 for u in p}
        assert linked == {u for u in range(len(fps)) if any(u != v and bits(u, v) <= 2 for v in range(len(fps)))}


def test_anchors_are_written_once_and_joined_by_a_merge(spark):
    """A fingerprint has 32 places, which Spark would take for one row and broadcast: 805 MB over the 0.5 GB table."""
    work = simhash.Workspace(spark, "test-anchors")
    nodes = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(work, nodes)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "bit_count((x" in x and "Join" in x]
    assert joins and all("SortMergeJoin" in x for x in joins), plan
    assert "Generate" not in plan, plan
    rows = simhash.anchored(nodes).selectExpr("sum(size(anchors))").first()[0]
    assert simhash.placed(simhash.Workspace(spark, "test-places"), nodes).count() == rows > 100_000
