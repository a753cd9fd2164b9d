"""Clustering, byte-level BPE and conversation repair against brute force, exact round trips and DuckDB."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.llm import bpe, clustering, conversations
from pluviant.llm.queries import ORACLE_SQL

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def oracle(name, **tables):
    import duckdb

    con = duckdb.connect()
    for view, rows in tables.items():
        con.register(view, rows)
    return sorted(con.sql(ORACLE_SQL[name]).fetchall(), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- clustering


def lloyd(rows, k, rounds):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for n, vs in own.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = sum(d for _, d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, n, d, sum(e for _, e, m in found if m == n), inertia, digest[n]) for i, d, n in found], key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    rows = [(k, [rng.gauss(k % 5, 0.2) for _ in range(64)]) for k in range(120)]
    same = [0.5] * 64
    rows += [(200 + k, same) for k in range(40)] + [rows[3], (3, same), (None, same), (None, rows[7][1])]
    return rows + [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + [1.0] * 63), (306, [float("-inf")] + [1.0] * 63)]


def frame(spark, rows, more=()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in more])


@pytest.mark.parametrize("more", [(), ("id", "v", "cluster", "c", "s", "k", "label")])
def test_clusters_are_those_of_brute_force(spark, vectors, more):
    df = clustering.cluster_report(frame(spark, vectors, more), k=12)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(df) == lloyd(vectors, 12, 5)


def test_clusters_of_few_and_of_no_vectors(spark, vectors):
    assert got(clustering.cluster_report(frame(spark, vectors[:3]), k=12)) == lloyd(vectors[:3], 12, 5)
    assert got(clustering.cluster_report(frame(spark, vectors[-3:]))) == got(clustering.cluster_report(frame(spark, []))) == []


def test_great_components_are_held(spark):
    rows = got(clustering.cluster_report(frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]), k=2))
    assert [r[0] for r in rows] == [1, 2, 3] and all(r[2] >= 0 for r in rows)


def test_clusters_of_small_blocks_are_the_same(spark, vectors):
    whole = clustering.whole_vectors(frame(spark, [r for r in vectors if r[0] is not None]), "vec_id", "embedding", 64, 256)
    a, b = (clustering.dual_tree_lloyd(whole, 9, 3, block=n) for n in (7, 4096))
    assert got(a[0]) == got(b[0]) and a[1] == b[1]


@pytest.mark.parametrize("n, dims, scale", [(1, 3, 5), (150, 2, 6), (300, 8, 40)])
def test_cover_tree_invariants_and_nearest(n, dims, scale):
    rng = np.random.default_rng(n)
    points = np.unique(rng.integers(-scale, scale, (n, dims)), axis=0)
    centres = np.unique(rng.integers(-scale, scale, (13, dims)), axis=0)
    rng.shuffle(centres)
    tree = clustering.cover_tree(points)
    for k in range(len(tree.point)):
        below = tree.order[tree.begin[k] : tree.end[k]]
        assert np.sqrt(clustering.squared(points[below], points[tree.point[k]])).max() <= tree.radius[k] + 1e-9
        children = tree.point[tree.first[k] : tree.last[k]]
        apart = np.sqrt(((points[children][:, None] - points[children][None]) ** 2).sum(-1))
        assert (apart[~np.eye(len(children), dtype=bool)] > tree.radius[k] / 2).all()
    who, best = clustering.nearest(points, tree, centres, clustering.cover_tree(centres))
    every = ((points[:, None] - centres[None]) ** 2).sum(-1)
    assert (who == every.argmin(1)).all() and (best == every.min(1)).all()


def test_far_pairs_are_pruned(monkeypatch):
    rng = np.random.default_rng(0)
    groups = rng.integers(-10_000, 10_000, (20, 16))
    points = np.unique(np.repeat(groups, 100, axis=0) + rng.integers(-9, 9, (2000, 16)), axis=0)
    compared = []
    real = clustering.squared
    monkeypatch.setattr(clustering, "squared", lambda a, b: compared.append(len(a)) or real(a, b))
    tree, over = clustering.cover_tree(points), clustering.cover_tree(groups)
    compared.clear()
    clustering.nearest(points, tree, groups, over)
    assert sum(compared) < len(points) * len(groups) / 4


def test_clusters_agree_with_sql(spark, vectors):
    import pandas as pd

    rows = [r for r in dict((r[0], r) for r in vectors).values() if r[0] is not None and (r[1] is None or None not in r[1])]
    table = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [None if r[1] is None else np.array(r[1], np.float32) for r in rows]})
    assert got(clustering.cluster_report(frame(spark, rows))) == oracle("op11_centroid_clusters", embeddings=table)


# -- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("shape", ["docs", "clashing", "none"])
def test_bpe_report_is_that_of_the_library(request, library, shape):
    docs = request.getfixturevalue(shape)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    df = bpe.bpe_report(docs, PATH, P.PATTERN)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got(df) == sorted(want, key=repr)


def test_bpe_of_odd_texts_and_small_blocks(spark, ranks, library):
    rng = random.Random(1)
    texts = ["", " ", "\n\n \t x", "a" * 700, "ab" * 400, "-" * 300, "=" * 5000, "don't we'll I'M", "０１２ ½ x²", "日本語のテキストを分かち書きせずに書く" * 9, "नमस्ते दुनिया", "👩‍👩‍👧 é é ​　\xa0x", "<|endoftext|>"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (13, 50, 255, 256, 257, 3000)]
    texts.append("".join(f"a{chr(c)}1{chr(c)} " for c in range(0x3000) if not 0xD800 <= c < 0xE000))
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, body string, ids string").repartition(2)
    out = bpe.encode(df, ranks, P.PATTERN, "body", block=1000)
    assert out.columns == ["doc_id", "ids"]
    rows = {r.doc_id: r for r in bpe.decode(out, ranks).collect()}
    for k, text in enumerate(texts):
        assert list(rows[k].ids) == library.encode_ordinary(text), text[:40]
        assert bytes(rows[k].decoded).decode() == text


def test_heap_merges_like_the_fold(ranks, library):
    rng = random.Random(2)
    for n in (1, 2, 9, 100, 600):
        piece = "".join(rng.choice("aaabcdeé") for _ in range(n)).encode()
        assert bpe.merged_with_heap(piece, ranks) == library._encode_single_piece(piece)


def test_pieces_merged_together_are_those_of_the_library(spark, docs, ranks, library):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("aaabcdeé the") for _ in range(rng.choice([1, 1, 2, 3, 9, 40]))).encode() for _ in range(500)]
    ids, counts = bpe.merged_pieces(np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces))), bpe.vocabulary(ranks), bpe.rank_map(ranks))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library._encode_single_piece(p) for p in pieces]
    plan = bpe.bpe_report(docs, PATH, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan  # no piece is folded by lambdas, which aren't compiled


def test_every_pair_has_a_slot_of_its_own(ranks):
    shifts, slots, factor = bpe.rank_map(ranks)
    for piece, rank in list(ranks.items())[::97]:
        for k in range(1, len(piece)):
            if piece[:k] in ranks and piece[k:] in ranks:
                a, b = np.int64(ranks[piece[:k]]), np.int64(ranks[piece[k:]])
                group, _ = bpe._slots(a, b, 0, factor)
                assert slots[bpe._slots(a, b, shifts[group], factor)[1]] ^ (a << 34 | b << 17) == rank
    with pytest.raises(ValueError, match="without a rank"):
        bpe.vocabulary({b"a": 0})


# -- conversations


def brute_repair(rows):
    """All states after each row, with every audit compared; rows: (initial, doomed, truncated, role, text)."""
    best = {conversations.EMPTY: (0, "", [])}

    def offer(to, state, x):
        if state not in to or x[:2] < to[state][:2]:
            to[state] = x

    def inserted(best):
        for _ in range(3):
            for q, (c, a, o) in list(best.items()):
                for to in conversations.NEXT[q].values():
                    if to in conversations.ROLES:
                        offer(best, to, (c + 3, a + "I", [*o, conversations.ROLES[to] + ":"]))
        return best

    best = inserted(best)
    for r in rows:
        new = {}
        for q, (c, a, o) in best.items():
            offer(new, q, (c + 4, a + "D", o))
            late = 3 if r.truncated else 0
            if not r.doomed:
                if r.initial in conversations.NEXT[q]:
                    offer(new, conversations.NEXT[q][r.initial], (c + late, a + "K", [*o, f"{r.role}:{r.text}"]))
                for to in conversations.NEXT[q].values():
                    if to in conversations.ROLES:
                        offer(new, to, (c + late + 3, a + "R", [*o, f"{conversations.ROLES[to]}:{r.text}"]))
        best = inserted(new)
    cost, audit, out = min(best[q] for q in conversations.FINAL if q in best)
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_search_in_windows_is_that_of_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        rows = [conversations.Row(rng.choice("suauaux"), rng.random() < 0.15, rng.random() < 0.3, "r", f"t{k}") for k in range(rng.randint(0, 14))]
        rows = [r._replace(truncated=r.truncated and not r.doomed) for r in rows]
        for window in (1, 2, 3, 256):
            repair = conversations.Repair(1, window)
            for r in rows:
                repair.feed(1, r, False, False)
            assert repair.result()[6:] == brute_repair(rows), (rows, window)


def test_long_conversations_are_settled_as_they_go():
    repair = conversations.Repair(1, 16)
    most = 0
    for k in range(4000):
        repair.feed(k, conversations.Row("ua"[k % 2] if k % 11 else "x", k % 17 == 0, False, "r", str(k)), False, False)
        most = max(most, max(len(p.audit) for p in repair.paths.values()))
    assert most < 200 and len(repair.result()[7]) >= 4000


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello there"), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"), (1, None, None, None), (2, 5, "", "x."), (2, 9, "tool", " \n"), (None, 1, "user", "a?"), (None, None, "user", "a?")]
ROWS += [(c, t, random.Random(c * 100 + t).choice(["user", "assistant", "system", "user", "assistant", "other", "Úser"]), random.Random(c * 77 + t).choice(["One. ", "two", "Three?\n", "", "é!", "4..."])) for c in range(3, 40) for t in range(c % 9)]
KIND = "conv_id long, turn long, role string, text string"


def expected_rows():
    """Damage, order and faults in Python; then brute force."""
    out = {}
    for conv, turn, role, text in ROWS:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, lattice, counts = {r[0] for r in rows} - {None}, set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            lattice.append(conversations.Row(role[:1], fault in (0, 1), fault == 2, role, text))
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:], strict=False))
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, *brute_repair(lattice))


@pytest.mark.parametrize("more", [(), ("conv", "key", "gone", "k", "first", "blank")])
def test_repair_is_that_of_brute_force(spark, more):
    df = spark.createDataFrame(ROWS, KIND).repartition(4).select("*", *[F.lit("x").alias(c) for c in more])
    out = conversations.repair_report(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(out) == sorted(expected_rows(), key=repr)


def test_repair_agrees_with_sql(spark):
    import pandas as pd

    table = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert got(conversations.repair_report(spark.createDataFrame(ROWS, KIND))) == oracle("op13_conversation_repair", conversations=table)


def test_repair_of_no_rows_and_of_dropped_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(conversations.repair_report(spark.createDataFrame([(gone, 0, "user", "x")], KIND))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(conversations.repair_report(spark.createDataFrame([], KIND))) == []


def test_one_long_conversation_with_a_very_long_text(spark):
    rows = [(7, k, "user" if k % 2 else "assistant", f"Turn {k % 50}.") for k in range(1500)] + [(7, 5000, "user", "long. " * 100_000)]
    a, b = (got(conversations.repaired(conversations.damaged(spark.createDataFrame(rows, KIND)), window=w)) for w in (64, 10_000))
    assert a == b and len(a) == 1
