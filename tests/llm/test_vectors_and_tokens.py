"""Clustering, piece ids and tokenizer alignment against plain versions over all rows."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shoebox.llm import alignment, bpe, lloyd, pieces, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, block string, row string, codes string"
BYTES, PIECES = queries.tokenizer_path(), queries.piece_path()
PARTS = [" ", " ", " ", "  ", "▁", "a", "B", "the", "é", "日本", "𝔘", "\n", "\t", "\x00", "<s>", "<|endoftext|>", "<0x0A>", "ing", "e", "r", "don't", "#", "12", " ", "ﬁ", "…"]
rnd = random.Random(7)


def odd_texts(n, r=rnd):
    return [None, "", " ", "▁", "  ▁ ", " x", "x "] + ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(n)]


def frame(spark, texts):
    rows = [(None if k % 29 == 3 else k // 2, t, "b", "r", "c") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- clustering --------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, dim, scale):
    ok = [(i, [int((scale * x) // 1) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and abs(x) < float("inf") for x in e)]
    order = sorted(ok, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    at = [v for _, v in order[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        own = {}
        for _, v in ok:
            own.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(at)]
    got = [(i, near(v)[1], near(v)[0]) for i, v in ok]
    sums = Counter()
    for _, c, d in got:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha(",".join(map(str, at[c])))) for i, c, d in got), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_clusters_are_those_of_plain_lloyd(spark, n):
    r = random.Random(n)
    rows = [(None if k % 31 == 7 else k // 2, [r.choice([-2.0, -0.75, 0.5, 1.25]) for _ in range(4)]) for k in range(n)]  # ids and vectors repeat, distances tie
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [1.0, float("inf"), 0.0, 0.0])]
    d = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<float>, cluster string, v int").repartition(3)
    got = lloyd.cluster(d, k=6, rounds=3, dim=4, scale=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows, 6, 3, 4, 4)


def test_huge_components_and_sums_have_results(spark):
    d = spark.createDataFrame([(k, [3e38 * (-1) ** k] * 64) for k in range(8)], "vec_id long, embedding array<float>")
    rows = lloyd.cluster(d, k=1).collect()
    assert len(rows) == 8 and all(r.inertia is None or r.inertia >= 0 for r in rows)


def test_clusters_of_the_driver_are_those_of_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    r = c.execute(queries.ORACLE["op11_centroid_clustering"])
    names = [x[0] for x in r.description]
    got = queries.QUERIES["op11_centroid_clustering"](spark, DATA).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(r.fetchall())


# --- pieces ------------------------------------------------------------------------------


def test_ids_and_texts_are_those_of_the_library(spark):
    texts = odd_texts(400) + ["word " * 30_000, "日" * 20_000, " " * 5_000]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    d = frame(spark, texts)
    want = Counter()
    for r in d.collect():
        ids = sp.encode(r["text"] or "", num_threads=1)
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    got = pieces.encode(d, PIECES)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and Counter(map(tuple, got.collect())) == want
    assert pieces.encode(d.limit(0), PIECES).count() == 0


def test_small_blocks_and_repeated_words(spark, monkeypatch):
    """Documents of many blocks, of which all hold one word; a worker forgets words between batches."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    d = spark.createDataFrame([(k, "hot " * (k % 50) + f"rare{k}") for k in range(300)], "doc_id long, text string").repartition(40)
    want = {k: sha(",".join(map(str, sp.encode("hot " * (k % 50) + f"rare{k}")))) for k in range(300)}
    assert {r["doc_id"]: r["ids_sha256"] for r in pieces.encode(d, PIECES).collect()} == want


def test_models_with_pieces_across_markers_segment_whole_texts(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto.FromString(open(PIECES, "rb").read())
    next(p for p in m.pieces if p.piece == "▁of▁the" or len(p.piece) == 12 and p.type == 1).piece = "e▁t"
    path = tmp_path / "crossing.model"
    path.write_bytes(m.SerializeToString())
    assert pieces.Pieces(open(PIECES, "rb").read()).apart and not pieces.Pieces(path.read_bytes()).apart
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the tide the tree", "", None, " e t", "one e two"]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path)).collect()
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


# --- alignment ---------------------------------------------------------------------------


def plain_alignment(rows):
    """Two pointers, token by token."""
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte = bpe._byte_of_char()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for i, t in rows:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        p, q = [bytes(byte[c] for c in a.id_to_token(k)) for k in x], [piece(k) for k in y]
        if not t or not b"".join(p) == b"".join(q) == (" " + t).encode():
            docs.append((i, 0, 0, [], []))
            continue
        groups, links, m, n, ea, eb, fa, fb = [], [], 0, 0, 0, 0, 0, 0
        while m < len(x) or n < len(y):
            if ea <= eb and m < len(x) or n == len(y):
                ea, m = ea + len(p[m]), m + 1
            else:
                eb, n = eb + len(q[n]), n + 1
            if ea == eb:
                groups.append(",".join(map(str, x[fa:m])) + "|" + ",".join(map(str, y[fb:n])))
                links.append((x[m - 1], y[n - 1]))
                fa, fb = m, n
        docs.append((i, len(x), len(y), groups, links))
        count.update(links)
    of_b, of_a = Counter(), Counter()
    for (k, j), n in count.items():
        of_b[j], of_a[k] = max(of_b[j], n), max(of_a[k], n)
    return Counter(
        (i, x, y, len(g), len(s), sum(count[p] == of_b[p[1]] for p in s), sum(count[p] for p in s), sha(";".join(g)) if g else "", sum(count[p] == of_a[p[0]] for p in s)) for i, x, y, g, s in docs
    )


def test_links_are_those_of_two_pointers(spark, monkeypatch):
    d = frame(spark, odd_texts(300) + ["plain words again and again " * 900, "same text", "same text"])
    want = plain_alignment([(r["doc_id"], r["text"]) for r in d.collect()])
    got = alignment.align(d, BYTES, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"]
    assert Counter(map(tuple, got.collect())) == want and any(r[4] == 0 for r in want)
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)  # counts that are too many to be sent
    assert Counter(map(tuple, alignment.align(d, BYTES, PIECES).collect())) == want
    assert alignment.align(d.limit(0), BYTES, PIECES).count() == 0


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = alignment.byte_side(bpe.ByteBpe(open(BYTES, "rb").read())), alignment.piece_side(pieces.Pieces(open(PIECES, "rb").read()))
    few = alignment.Side([b"ab", b"b", b"cab"]), alignment.Side([b"b", b"ab", b"x", b"b"])
    want = sum(p.endswith(q) or q.endswith(p) for p in few[0].tokens for q in few[1].tokens)
    assert alignment.possible_pairs(*few) == want and alignment.possible_pairs(a, b) < alignment.BROADCAST_ROWS
