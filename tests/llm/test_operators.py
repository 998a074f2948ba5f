"""Edge cases of all operators, and their results against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.llm import common, components, embedding_dedup, exact_dedup, jaccard_join, language, licenses, mixing, packing, substring_dedup, token_ids, toxicity

#: Columns that operators use inside, as extra ones of the input.
CLASH = {"digest": "x", "n": 1, "label": "z", "range": 5, "keep_id": 7, "rate": 0.5, "node": 3, "bucket": 2, "component_id": 9, "copies": 4}
LONG = "lorem ipsum dolor " * 30_000


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    return [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (4, "One two"), (5, "one  two"), (None, "no id"), (6, LONG), (7, "é ñ 中 ½ \x01 İ."), (8, "a" * 50_000)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k != "label"})


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with exact copies, near copies, shared passages; ids out of order."""
    rng = random.Random(4)
    texts = [words(rng, rng.randint(30, 120)) for _ in range(120)]
    base = words(rng, 100).split()
    for _ in range(40):
        w = list(base)
        w[rng.randrange(100)] = "zz"
        texts.append(" ".join(w))
    texts += [texts[3]] * 25 + [texts[5].replace(" ", "  ", 1)]
    passage = ". ".join(words(rng, 9) for _ in range(8)) + "."
    for k in range(6):
        w = words(rng, 60).split()
        texts.append(" ".join([*w[:30], passage, *w[30:]]) if k else passage)
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7).cache()


def roots(n, links):
    at = {i: i for i in n}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


# --- exact dedup


def by_brute_force(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows if i is not None]
    of = defaultdict(list)
    for i, t in norm:
        of[t].append(i)
    return sorted((i, min(of[t]), len(of[t]), i == min(of[t])) for i, t in norm)


@pytest.mark.parametrize("width", [32, 1])
def test_exact_dedup(corpus, width):
    rows, df = corpus
    got = exact_dedup.exact_dedup(df, width=width, memtable_rows=20, range_rows=50)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == by_brute_force(rows)


def test_exact_dedup_edges(spark, edge):
    got = exact_dedup.exact_dedup(edge).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == by_brute_force(edge_rows())
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_never_miss():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert exact_dedup.maybe_in(exact_dedup.bloom(keys), keys).all()


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_compaction_by_levels(fan):
    """Runs of random digests, merged some at a time: smallest ids and counts as if counted at once."""
    rng = np.random.default_rng(fan)
    keys, ids = rng.integers(0, 400, 900).astype(np.uint64) * np.uint64(1 << 50), rng.permutation(900)
    runs = []
    for part in np.array_split(np.arange(900), 23):
        w, i, c = exact_dedup.reduced(np.c_[keys[part], keys[part]], ids[part], np.ones(len(part), np.int64))
        runs.append((w, i, c, exact_dedup.bloom(w[:, 0])))
    w, i, c, _ = exact_dedup.compacted(runs, fan)
    got = {int(k): (int(x), int(n)) for k, x, n in zip(w[:, 0], i, c, strict=True)}
    assert len(got) == len(w) and got == {int(k): (int(ids[keys == k].min()), int((keys == k).sum())) for k in np.unique(keys)}


# --- token ids and packing


def encoded_whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.public_vocabulary())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_words_encode_as_whole_texts_do():
    rng = random.Random(9)
    letters = "aAbBéÉeΣςsS'. ,\n\t12²Ⅷ!?|<>endoftxİıKK̇́  \x01\x85\x1c中ǅͅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["It's <|endoftext|>. x", "o'clock. d'été,"]
    enc = token_ids.WordEncoder(token_ids.public_vocabulary(), most=50)
    got = [np.frombuffer(b, enc.dtype).tolist() for i in range(0, len(texts), 100) for b in enc.encode([t.encode() for t in texts[i : i + 100]])]
    assert got == [x.tolist() for x in encoded_whole(texts)]


def test_latin_words_with_marks_need_no_chain():
    from tokenizers import Tokenizer

    class NoBatch:
        def __init__(self, tok):
            self.encode = tok.encode

        def encode_batch_fast(self, texts, **_):
            assert not texts, texts
            return []

    rng = random.Random(4)
    path = token_ids.public_vocabulary()
    tok, enc = Tokenizer.from_file(path), token_ids.WordEncoder(path)
    letters = [chr(c) for c in range(0xC0, 0x100) if chr(c) not in "\u00d7\u00f7"] + [*"aeinstAEIN"] * 3
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 3]))) for _ in range(60)) for _ in range(50)] + ["\u00catre*** blend!! don' l'' \u00df_"]
    enc._tok = NoBatch(enc._tok)
    assert [np.frombuffer(x, enc.dtype).tolist()[:-1] for x in enc.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_conversations_are_encoded_by_the_slice(spark, monkeypatch):
    """No call to the library for each conversation."""
    calls = []

    class Counted:
        dtype = np.dtype("<u2")

        def encode(self, texts):
            calls.append(len(texts))
            return [np.arange(len(t) + 1, dtype="<u2").tobytes() for t in texts]

    rows = spark.createDataFrame([(c, t, "user", "ab") for c in range(20) for t in range(3)], "conv_id long, turn int, role string, text string")
    monkeypatch.setattr(packing, "WordEncoder", lambda path: Counted())
    run = {}
    monkeypatch.setattr(packing, "_packed", lambda examples, *_: run.setdefault("of", examples) and (lambda batches: iter(())))
    packing.pack_conversations(rows, "")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "speaks": [[False] * 3] * 20, "texts": [["ab"] * 3] * 20})
    (out,) = run["of"](iter([batch]))
    assert calls == [60] and all(len(ids) == 2 + 2 + 3 for _, ids, _ in out)


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import os

    path = os.path.join(os.path.dirname(token_ids.public_vocabulary()), "byte_bpe_50k.json")
    from tokenizers import Tokenizer

    enc, tok = token_ids.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["It's  a Test\n of CASE and  spaces", "", "a" * 300]
    assert not enc.by_word and token_ids.WordEncoder(token_ids.public_vocabulary()).by_word
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_wide_ids_are_read_as_written():
    import zstandard

    raw, ids = b"12345678", np.array([70_000, 1], "<u4")
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(ids.tobytes())
    reader = token_ids.TokenReader(raw)
    shard = {"dict_hash": reader.dict_hash, "width": 4, "offsets": np.array([0, len(frame)], "<i8").tobytes(), "payload": frame}
    assert reader.read(shard, 0).tolist() == [70_000, 1]


def test_token_shards_round_trip(spark, edge, tmp_path):
    token_ids.write_token_shards(edge, f"file://{tmp_path}/t", token_ids.public_vocabulary(), shard_docs=3)
    got = sorted(token_ids.read_token_shards(spark, f"file://{tmp_path}/t", with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted((r for r in edge_rows() if r[0] is not None), key=lambda r: r[0])
    want = encoded_whole([t for _, t in rows])
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    start = 0
    for r, ids in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)


def test_token_shards_close_by_bytes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i} words " * (i % 40)) for i in range(90)], "doc_id long, text string")
    path, out = token_ids.public_vocabulary(), f"file://{tmp_path}/t"
    token_ids.write_token_shards(df, out, path, shard_bytes=500)
    size = [len(r.payload) for r in spark.read.parquet(f"{out}/shards").collect()]
    docs = [len(r.doc_ids) // 8 for r in spark.read.parquet(f"{out}/shards").collect()]
    assert len(size) > 3 and all(n <= 500 or k == 1 for n, k in zip(size, docs, strict=True))
    token_ids.write_token_shards(df, f"{out}2", path)
    assert sorted(map(tuple, token_ids.read_token_shards(spark, out).collect())) == sorted(map(tuple, token_ids.read_token_shards(spark, f"{out}2").collect()))


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 20 << 20, 3 << 20, 3 << 20, 3 << 20, 0, 7)]
    b = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.sliced(iter([b]), 512))
    assert [i for p in parts for i in common.ids_of(p).tolist()] == list(range(7))
    assert all(p.nbytes <= common.SLICE_BYTES or p.num_rows == 1 for p in parts) and len(list(common.sliced(iter([b.slice(0, 0)])))) == 0


def test_token_shards_refuse_another_dictionary():
    with pytest.raises(ValueError, match="another dictionary"):
        token_ids.TokenReader(b"12345678").read({"dict_hash": "x"}, 0)


def test_token_shards_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_ids.write_token_shards(none, f"file://{tmp_path}/t", token_ids.public_vocabulary())
    assert token_ids.read_token_shards(spark, f"file://{tmp_path}/t").count() == 0


def packed_well(pieces, lengths, limits):
    of, seq = defaultdict(list), defaultdict(list)
    for ex, start, n, loss, s in pieces:
        of[ex].append((start, n))
        seq[s].append((n, loss))
    for ex, n in lengths.items():
        at = 0
        for start, m in sorted(of[ex]):
            assert start == at and m > 0
            at += m
        assert at == n
    for s in seq.values():
        n = sum(x for x, _ in s)
        assert n <= limits[0] and len(s) <= limits[1] and sum(x for _, x in s) <= limits[2]
    return seq


@pytest.mark.parametrize("limits", [(64, 5, 40), (64, 64, 64), (16, 1, 3), (1, 1, 1)])
def test_packer_keeps_all_limits(limits):
    rng = np.random.default_rng(2)
    p, out, lengths, flags = packing.Packer(*limits, open_pieces=20), [], {}, {}
    sequences = []
    for ex in range(200):
        loss = rng.random(int(rng.integers(1, 200))) < rng.random()
        lengths[ex], flags[ex] = len(loss), loss
        sequences += p.add(ex, loss)
    sequences += p.finish()
    for s, pieces in enumerate(sequences):
        out += [(ex, st, n, int(flags[ex][st : st + n].sum()), s) for ex, st, n in pieces]
    seq = packed_well(out, lengths, limits)
    padding = sum(0 if (n := sum(x for x, _ in s)) & (n - 1) == 0 else limits[0] - n for s in seq.values())
    assert padding == 0


@pytest.mark.parametrize(("limits", "longest", "most"), [((64, 5, 40), 60, 1.25), ((64, 3, 64), 25, 1.25), ((64, 64, 16), 40, 1.25), ((16, 1, 3), 30, 2.0), ((1, 1, 1), 3, 1.0)])
def test_whole_packer_cuts_only_what_must_be(limits, longest, most):
    rng = np.random.default_rng(4)
    p, lengths, flags, sequences = packing.WholePacker(*limits, open_pieces=50), {}, {}, []
    for ex in range(400):
        loss = rng.random(int(rng.integers(1, longest))) < rng.random()
        lengths[ex], flags[ex] = len(loss), loss
        sequences += p.add(ex, loss)
    sequences += p.finish()
    out = [(ex, st, n, int(flags[ex][st : st + n].sum()), s) for s, pieces in enumerate(sequences) for ex, st, n in pieces]
    seq = packed_well(out, lengths, limits)
    cut = {e for e, c in Counter(x[0] for x in out).items() if c > 1}
    assert cut == {e for e, f in flags.items() if len(f) > limits[0] or f.sum() > limits[2]}
    least = max(sum(lengths.values()) / limits[0], len(out) / limits[1], sum(f.sum() for f in flags.values()) / limits[2])
    assert len(seq) <= most * least + 1


def test_pack_edges(spark, edge):
    got = packing.pack(edge, token_ids.public_vocabulary(), with_ids=True).collect()
    rows = [r for r in edge_rows() if r[0] is not None]
    want = Counter((i, tuple(x.tolist())) for (i, _), x in zip(rows, encoded_whole([t for _, t in rows]), strict=True))
    assert sum(r.length for r in got) == sum(len(k[1]) * c for k, c in want.items())
    for r in got:
        assert any(i == r.doc_id and list(ids[r.start : r.start + r.length]) == r.ids and len(ids) == r.doc_tokens for i, ids in want)
    assert packing.padding(packing.pack(edge, token_ids.public_vocabulary())).head().padding == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), token_ids.public_vocabulary()).count() == 0


def test_pack_conversations(spark):
    """Turns in order, loss on what the assistant says; all three limits hold and the last two bind."""
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", words(rng, rng.randint(0, 60))) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(90, 0, None, "x y"), (90, 1, "assistant", None), (None, 0, "user", "gone"), (91, 0, "assistant", words(rng, 900))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    got = packing.pack_conversations(df, token_ids.public_vocabulary(), max_tokens=512, max_segments=3, max_loss=128, with_ids=True).collect()
    want, whole = {}, dict(zip(texts := sorted({x or "" for *_, x in rows}), encoded_whole(texts), strict=True))
    for c in {r[0] for r in rows if r[0] is not None}:
        said = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        ids = [whole[x][:-1] for _, _, x in said]
        loss = np.concatenate([np.full(len(x), r == "assistant") for x, (_, r, _) in zip(ids, said, strict=True)] + [[said[-1][1] == "assistant"]])
        want[c] = np.concatenate([*ids, [1]]), loss
    for r in got:
        ids, loss = want[r.doc_id]
        assert r.ids == ids[r.start : r.start + r.length].tolist() and r.loss == loss[r.start : r.start + r.length].sum() and r.doc_tokens == len(ids)
    seq = packed_well([(r.doc_id, r.start, r.length, r.loss, r.sequence_id) for r in got], {c: len(i) for c, (i, _) in want.items()}, (512, 3, 128))
    assert any(len(s) == 3 for s in seq.values()) and any(sum(x for _, x in s) == 128 for s in seq.values())


# --- n-gram Jaccard join


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(corpus, k, percent):
    rows, df = corpus
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df, k, percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_join_follows_chains(spark):
    """Each text links with its neighbours only, so the first of a list leads to none of the far ones."""
    rng = random.Random(8)
    w = words(rng, 400).split()
    rows = [(i, " ".join(w[i * 6 : i * 6 + 120])) for i in range(40)]
    sets = {i: shingles(t, 4) for i, t in rows}
    want = roots(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 40


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_of_short_texts(spark, k, percent):
    """Texts of 4 to 15 words and their beginnings and ends, a word or two shorter, with no other text near."""
    rng = random.Random(15)
    texts = []
    for n in range(4, 16):
        for less in (1, 2):
            for _ in range(12):
                w = words(rng, n).split()
                texts += [" ".join(w), " ".join(w[:-less] if rng.random() < 0.5 else w[less:])]
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    want = roots(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, percent).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [50, 80, 85, 90])
@pytest.mark.parametrize("share", [jaccard_join.EXTRA, jaccard_join.MORE])
def test_prefixes_share_what_the_filter_asks_for(spark, percent, share):
    """The filter of a set of n asks for no more than its prefix and any partner's must have in common."""
    asked = [r[0] for r in spark.range(1, 400).toDF("n").orderBy("n").select(jaccard_join.at_least(percent, share)).collect()]
    for n, least in enumerate(asked, 1):
        for m in range(jaccard_join.needed(n, percent), min(100 * n // percent, 699) + 1):
            both = -(-percent * (n + m) // (100 + percent))
            seen = [both - max(0, x - int(jaccard_join.prefix_size(np.int64(x), percent, share))) for x in (n, m)]
            assert both > min(n, m) or least <= min(seen)


def test_jaccard_join_edges(spark, edge):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(edge).collect())
    assert got[:6] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4)]
    assert len(got) == 9
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components(spark, one_task):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 90)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(500, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5), one_task=one_task).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != v}


# --- embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.08
    x = np.r_[base, near, base[:5], base[:1] + rng.normal(size=(80, 16)) * 0.03].astype(np.float32)
    label = [int(i % 3) for i in range(300)] + [int(i % 3) for i in range(60)] + [int(i % 3) for i in range(5)] + [0] * 80
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist(), la) for i, v, la in zip(ids, x, label, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(hit, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)]
    want = roots(ids, links)
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    true = {i: int(h.sum()) for i, h in zip(ids, hit, strict=True)}
    assert all(got[i].n_links <= true[i] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.9 * sum(true.values())
    assert np.mean([got[i].component_id == want[i] for i in ids]) > 0.95
    links = embedding_dedup.near_embeddings(df).select("vec_id", "n_links")
    asked = [i for i in ids if i % 7 == 0]
    assert embedding_dedup.measured_recall(df, links, every=7, block=11) == (sum(got[i].n_links for i in asked), sum(true[i] for i in asked))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"vec": F.lit(1), "cell": F.lit(2), "rep": F.lit(3)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_embeddings(df).collect()}
    assert got == {i: (2, 1) if i in (1, 2, 12) else (0, i) for i in range(1, 13)}
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_doubles_stay_doubles(spark):
    """Beyond the range of floats, and closer to the threshold than floats can tell."""
    c = 0.93
    rows = [(1, [1e200, 0.0], 1), (2, [1e200 * c, 1e200 * (1 - c * c) ** 0.5 * (1 - 1e-12)], 1), (3, [1.0, 0.0], 2), (4, [c, (1 - c * c) ** 0.5 * (1 + 1e-9)], 2)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_multi_sequence_order_is_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    index = embedding_dedup.MultiIndex(x / np.linalg.norm(x, axis=1, keepdims=True), 6, 0.9)
    index.visits = 9
    a, b = index._parts(x[:20])
    for k, cells in enumerate(index.visited(x[:20])):
        total = (a[k][:, None] + b[k][None]).ravel()
        assert np.allclose(np.sort(total[cells]), np.sort(total)[:9])


# --- passages, licences


def test_passages(corpus):
    rows, df = corpus
    got = substring_dedup.repeated_passages(df).collect()
    with_passage = {i for i, _ in rows[-6:]}
    assert with_passage <= {r.doc_id for r in got}
    seen = Counter(w for _, t in rows for w in {tuple(t.lower().split()[k : k + 20]) for k in range(max(0, len(t.split()) - 19))})
    clean = {i for i, t in rows if not any(seen[tuple(t.lower().split()[k : k + 20])] > 1 for k in range(max(0, len(t.split()) - 19)))}
    assert not clean & {r.doc_id for r in got}
    assert all(r.n_words >= 24 for r in got)
    text = dict(rows)
    left = {r.doc_id: r.text for r in substring_dedup.without_passages(df, substring_dedup.repeated_passages(df)).collect()}
    assert sum(len(left[i]) for i in with_passage) < sum(len(text[i]) for i in with_passage)
    assert all(left[i] == text[i] for i in clean)


@pytest.mark.parametrize("kind", ["sentences", "no marks", "few words"])
@pytest.mark.parametrize("n", [50, 51, 60])
def test_paragraphs_are_shared_wherever_a_passage_stands(kind, n):
    rng = random.Random(n)
    pool = words(rng, 4 if kind == "few words" else 5000).split()
    cutter = substring_dedup.Paragraphs(substring_dedup.MIN_WORDS, 5, 4, 2)

    def text(size):
        return [rng.choice(pool) + ("." if kind == "sentences" and rng.random() < 0.1 else "") for _ in range(size)]

    for _ in range(500):
        passage, found = text(n), []
        for _ in range(2):
            before = text(rng.randrange(40))
            _, at, _, _ = cutter.cut([" ".join([*before, *passage, *text(rng.randrange(40))]).encode()])
            found.append({i - len(before) for i in at.tolist() if len(before) <= i and i + substring_dedup.MIN_WORDS <= len(before) + n})
        assert found[0] & found[1]


def test_unaligned_passages(spark):
    """51 shared words, without marks, from the middle of one text to the middle of another."""
    rng = random.Random(51)
    rows = []
    for i in range(0, 200, 2):
        passage = words(rng, 51)
        rows += [(j, f"{words(rng, rng.randint(0, 40))} {passage} {words(rng, rng.randint(0, 40))}") for j in (i, i + 1)]
    got = {(r.doc_id, r.cluster_doc_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, i - i % 2) for i in range(200)}


@pytest.mark.parametrize(("most", "wanted"), [(512, 1000), (3, 0)])
def test_passages_against_brute_force(spark, most, wanted):
    """All pairs of paragraphs by exact Jaccard: near paragraphs differ by a word at their ends, others in the middle."""
    rng = random.Random(77)
    base = [words(rng, 80).split() for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(base[i % 6])
        for _ in range(i % 4):
            w[rng.randrange(80)] = words(rng, 1)
        rows.append((i, " ".join([*words(rng, rng.randrange(30)).split(), *w, *words(rng, rng.randrange(30)).split()])))
    cutter = substring_dedup.Paragraphs(24, 5, *substring_dedup.tuned(0.8, 0.98))
    text, at, grams, _ = cutter.cut([t.encode() for _, t in rows])
    sets = [frozenset(g.tolist()) for g in grams]
    links = [(a, b) for a, b in combinations(range(len(at)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(range(len(at)), links)
    of = defaultdict(set)
    for p, r in root.items():
        of[r].add(int(text[p]))
    want = {(int(text[p]), w, min(of[r])) for p, r in root.items() if len(of[r]) > 1 for w in range(at[p], at[p] + 24)}
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), most=most, wanted=wanted).collect()
    got = {(r.doc_id, w, r.cluster_doc_id) for r in found for w in range(r.first_word, r.first_word + r.n_words)}
    assert len({(p, q) for p, q in links if sets[p] != sets[q]}) > 100
    assert len({x[:2] for x in want} & {x[:2] for x in got}) >= 0.98 * len({x[:2] for x in want}) and len(want & got) >= 0.95 * len(want)
    assert {x[:2] for x in got} <= {x[:2] for x in want}


def test_passages_of_rows_that_repeat_an_id(spark):
    rng = random.Random(31)
    p, a, b, c = (words(rng, n) for n in (60, 7, 40, 50))
    rows = [(1, f"{a} {p}"), (2, f"{b} {p}"), (2, f"{c} {p} {a}"), (3, f"{b} {c}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_id": F.lit(1), "gone": F.lit(2), "row": F.lit(3)})
    found = substring_dedup.repeated_passages(df).cache()
    assert {(r.doc_id, r.cluster_doc_id) for r in found.collect()} >= {(1, 1), (2, 1)}
    left = substring_dedup.without_passages(df, found)
    assert left.columns == df.columns
    texts = [r.text for r in left.orderBy("doc_id").collect()]
    assert p in texts[0] and all(set(x.split()) <= set(t.split()) for x, t in ((b, texts[1]), (c, texts[2]))) or all(p not in t for t in texts[1:])


def test_very_many_paragraphs_of_one_band(spark):
    """Chunks of a band: what is unlike its first class still meets all others."""
    rng = random.Random(12)
    old, substring_dedup.CHUNK = substring_dedup.CHUNK, 4
    try:
        pool = [int(x) for x in np.random.default_rng(1).integers(1, 2**62, 24)]
        sets = [frozenset(rng.sample(pool, 20)) for _ in range(40)]
        shared = spark.createDataFrame([(b, i) for i in range(40) for b in (7, 8 + i % 2)], "band long, of long")
        inside = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "of long, grams array<long>")
        got = {(r.a, r.b) for r in substring_dedup.links_of(shared, inside, 80).collect()}
    finally:
        substring_dedup.CHUNK = old
    want = [(a, b) for a, b in combinations(range(40), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {tuple(sorted(x)) for x in got} <= set(want)
    assert roots(range(40), got) == roots(range(40), want) and len(want) > 40


def test_links_of_a_fold_are_a_forest():
    """Near copies within one fold: fewer links than classes go out, and they connect all that exact Jaccard connects."""
    rng = random.Random(19)
    base, texts = words(rng, 24).split(), []
    for _ in range(60):
        w = list(base)
        w[rng.choice((0, 23))] = words(rng, 1)
        texts.append(" ".join(w))
    make = (24, 5, *substring_dedup.tuned(0.8, 0.98))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts), pa.array(range(60), pa.int64())], names=["doc_id", "text", "text_id"])
    sent = [r for b in substring_dedup.fold(make, 80, 4, 4, 512)(iter([batch])) for r in b.to_pylist()]
    links = [(a, b) for r in sent if r["kind"] == "links" for a, b in zip(*(np.frombuffer(r[k], np.uint64).tolist() for k in ("marks", "more")), strict=True)]
    cutter = substring_dedup.Paragraphs(*make)
    _, _, grams, h = cutter.cut([t.encode() for t in texts])
    sets = {int(n): frozenset(g.tolist()) for n, g in zip(substring_dedup.node_of(*cutter.marks(grams, h)), grams, strict=True)}
    want = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(want) > 2 * len(sets) and 0 < len(links) < len(sets)
    assert roots(sets, links) == roots(sets, want)


def test_places_are_packed_in_few_bytes():
    """Packed places are read back as they were, whatever their ids, and take 28 bytes each where every row has one."""
    rng = np.random.default_rng(5)
    cutter = substring_dedup.Paragraphs(24, 5, 4, 2)

    def places(doc_ids, per_row, most):
        row = np.repeat(np.array([(d, int(x)) for d, x in zip(doc_ids, rng.integers(-(1 << 63), 1 << 63, len(doc_ids)), strict=True)], substring_dedup.ROW), per_row)
        marks = cutter.marks(*(rng.integers(0, 1 << 63, (len(row), n)).astype(np.uint64) * np.uint64(2) for n in (20, 24)))
        return substring_dedup.Places(row, rng.integers(0, most, len(row)).astype(np.int32), *marks)

    for doc_ids, per_row, most in ((range(1000), 1, 60_000), ([-(1 << 63), -1, 0, (1 << 63) - 1], 3, 1 << 31), (range(7, 9), 70_000, 200_000), ([5], 1, 1)):
        p = places(doc_ids, per_row, most).sorted()
        packed = p.packed(3, "lone")
        got = substring_dedup.Places.read([packed]).sorted()
        assert packed[:2] == (3, "lone") and len(packed) == len(substring_dedup.NAMES)
        assert all(np.array_equal(getattr(got, k), getattr(p, k)) for k in ("row", "at", "m1", "m2"))
        if per_row == 1 and len(p.at) == 1000:
            assert sum(len(x) for x in packed[2:]) <= 28 * len(p.at)


@pytest.mark.parametrize("mark", [".", ""])
def test_each_passage_is_kept_once(spark, mark):
    """P1 stands in 5 and 9, P2 in 3 and 5, side by side; P3 in 6, 7 and 8, and in 7 and 8 with more words."""
    rng = random.Random(9)
    p1, p2, p3, more, *rest = (words(rng, 60) + mark for _ in range(14))
    texts = {3: [rest[0], p2, rest[1]], 5: [rest[2], p1, p2, rest[3]], 9: [rest[4], p1, rest[5]], 6: [rest[6], p3], 7: [p3, more, rest[7]], 8: [rest[8], p3, more]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = substring_dedup.repeated_passages(df).cache()
    assert {(r.doc_id, r.cluster_doc_id, r.kept) for r in found.collect()} == {(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (6, 6, True), (7, 6, False), (7, 7, True), (8, 6, False), (8, 7, False)}
    left = {r.doc_id: r.text for r in substring_dedup.without_passages(df, found).collect()}
    assert p1 in left[5] and p1 not in left[9] and p2 in left[3] and p2 not in left[5] and p3 in left[6] and p3 not in left[8]
    assert more in left[7] and more not in left[8]


def test_passages_edges(spark, edge):
    assert substring_dedup.repeated_passages(edge).count() == 0
    assert substring_dedup.repeated_passages(edge.limit(0)).count() == 0


def test_bands_reach_their_recall():
    bands, rows = substring_dedup.tuned(0.8, 0.98)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.98 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_licenses(spark, edge):
    text = "x\n\nReleased under the MIT License.\nother words here\n\nLicensed under the Apache licence, version 2.0"
    rows = [(1, text), (2, None), (3, ""), (None, "All rights reserved."), (4, "All rights reserved."), (5, LONG)]
    got = sorted((r.doc_id, r.unit, r.license_id, r.dice) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def dice(a, b):
        a, b = (Counter(zip(w, w[1:], strict=False)) for w in (re.findall("[a-z0-9]+", x.lower()) for x in (a, b)))
        return round(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())), 6)

    assert [(g[0], g[2]) for g in got if g[1] == "line"] == [(1, "mit"), (4, "all-rights-reserved")]
    assert all(d == 1 for *_, d in got)
    for unit in ("Licensed under the Apache licence, version 2.0", "licensed under cc by 4.0", "licensed under the the MIT"):
        found = dict(licenses.Scanner(licenses.TEMPLATES, 0.5).match(licenses.words(unit.encode())))
        assert {k: round(v, 6) for k, v in found.items()} == {k: d for k, t in licenses.TEMPLATES.items() if (d := dice(unit, t)) >= 0.5}
    assert licenses.scan_licenses(edge).count() == 0
    assert licenses.scan_licenses(edge.limit(0)).count() == 0


def test_license_windows(spark):
    t = licenses.TEMPLATES
    w = t["mit-notice"].split()
    comment = "/*\n * Copyright 2020 Foo Bar\n *\n" + "".join(f" * {' '.join(w[i : i + 9])}\n" for i in range(0, len(w), 9)) + " *\n" + " * No warranty of any kind is given for this code or for any part of it.\n" * 3 + " */\nint main(void);"
    rows = [(1, comment), (2, "Copyright 2020 Foo Bar. Released under the MIT License."), (3, f"This is free. {t['gpl-3.0']} Thanks to all who helped."), (4, "a licence under the terms of the trade"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df, windows=True).collect()
    assert {(r.doc_id, r.unit_no, r.license_id, r.dice) for r in got if r.unit == "window"} == {(1, 4, "mit-notice", 1), (2, 4, "mit", 1), (3, 3, "gpl-3.0", 1)}
    plain = licenses.scan_licenses(df).collect()
    assert not plain and sorted(r for r in got if r.unit != "window") == plain


# --- learned operators


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts in two made-up languages; every fifth is toxic, by inflected stems of its language."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        lang = "xx" if i % 3 else "yy"
        alphabet = "abcdeo" if lang == "xx" else "uvwxyzé"
        text = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(10, 60))]
        if i % 5 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), ("grumpf" if lang == "xx" else "snork") + rng.choice(alphabet) * 2)
        rows.append((i, " ".join(text) + ".", lang, int(i % 5 == 0), int(i % 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int").cache()
    return df.select("doc_id", "text", "lang"), df.select("doc_id", "quality", "toxic"), rows


def test_toxicity_held_out(labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in out) and sum(r.held_out for r in got.values()) == len(out)
    assert np.mean([got[r[0]].predicted == r[3] for r in out]) > 0.95
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.3}


def test_toxicity_grammar():
    g = lambda classes: [s for _, s, _ in toxicity.clause_symbols(classes)]
    assert g(["T", "O", "I"]) == ["tI"] and g(["I", "T"]) == ["tI"] and g(["O", "I"]) == ["I"]
    assert g(["N", "O", "I"]) == ["nI"] and g(["N", "O", "O", "O", "O", "I"]) == ["I"]
    assert g(["T", "R", "O", "T", "I"]) == ["rI"] and g(["V", "T"]) == ["tX"] and g(["W", "V"]) == ["X"] and g([]) == []
    m = toxicity.Lexicon([("idiot", 1e-2, 1e-5)])
    w = toxicity.fit_weights(np.zeros((0, 2 * len(toxicity.SYMBOLS))), np.zeros(0))
    score = lambda t: float(np.r_[m.features(t), 1] @ w)
    assert score("you are an idiot.") > score("an idiot.") > score("never an idiot.") and score("I will kill you") > score("he said: kill time")
    assert score("x " * 400 + "you are an idiot " + "x " * 400) > score("x " * 400 + "said an idiot " + "x " * 400)  # a clause of any length


def test_composed_transducers_are_the_rules_they_stand_for():
    """All clauses of up to six words over the classes, each match read off the clause directly."""
    from itertools import product

    def direct(c):
        x = ["X" if s == "V" else "I" if s == "I" else None for s in c]
        out = []
        for i, kind in enumerate(x):
            if not kind:
                continue

            def reached(trigger, reach, word=i):  # other words use the reach up, matches don't
                left = 0
                for j in range(word):
                    left = reach if c[j] == trigger else left if x[j] else max(0, left - 1)
                return left > 0

            back = [*c[::-1]]
            after, left = len(c) - 1 - i, 0
            for j in range(after):
                left = 4 if back[j] == "T" else left if back[j] in "IV" else max(0, left - 1)
            weight, intent = 0.0, 0
            if kind == "X":
                for j in range(i):
                    intent = 4 if c[j] == "W" else 0 if c[j] == "V" else max(0, intent - 1)
                weight += 2.0 if intent else 1.0
            r, n, t = reached("R", 12), reached("N", 3), reached("T", 4)
            weight += -0.5 * r - 1.0 * n + 1.0 * t
            mark = "r" if r else "n" if n else "t" if t or left else ""
            out.append((i, mark + kind, weight + (mark == "t" and not t)))
        return out

    for size in range(7):
        for c in product("ITNRVWO"[:: 1 if size < 6 else 2], repeat=size):
            assert toxicity.clause_symbols(list(c)) == direct(c), c


def test_no_text_reaches_the_driver(labelled):
    docs, labels, _ = labelled
    m = toxicity.Model(docs, labels)
    assert {s for s, _, _ in m.lexicon.stems} & {"grumpf", "snork"} and len(m.lexicon.stems) <= toxicity.LEXICON
    assert all(len(ws) <= toxicity.CONTEXT for ws in m.lexicon.learned.values()) and len(m.weights) == 2 * len(toxicity.SYMBOLS) + 1


def test_toxicity_edges(spark, edge, labelled):
    _, labels, _ = labelled
    got = toxicity.score_toxicity(edge, labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(edge, labels.limit(0)).filter("predicted = 1").count() == 0
    odd = spark.createDataFrame([(None, 1), (4, None), (4, 7)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(edge, odd).count() == 9
    kept = toxicity.keep_clean(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == 10
    assert toxicity.score_toxicity(edge.limit(0), labels).count() == 0


def test_language_held_out(labelled):
    docs, _, rows = labelled
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if got[r[0]].held_out]) > 0.97


def test_language_edges(spark, edge, labelled):
    docs, _, _ = labelled
    extra = spark.createDataFrame([(9001, None, "xx"), (9002, "12 34 ½", None), (9003, "", "yy"), (None, "abc", "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs.union(extra)).collect()}
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and len(got) == 603
    one = language.identify(edge).collect()
    assert len(one) == 9 and {r.lang_pred for r in one} == {"en", "und"}
    assert language.identify(edge.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 9, 40])
def test_codewords_differ(k):
    c = language.codewords(k)
    assert len({r.tobytes() for r in c}) == k or k == 1


def test_mixing_meets_its_targets(labelled):
    docs, labels, _ = labelled
    domains = mixing.quality_domains(docs, labels)
    got = mixing.mix(docs, domains, weights={"xx/high": 1, "xx/low": 1, "yy/high": 1, "yy/low": 1})
    of, names = mixing.posteriors(docs, domains)
    rows = {r.doc_id: r for r in of.collect()}
    totals = np.zeros(len(names))
    for r in got.collect():
        assert r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1)
        totals += r.rate * r.tokens * np.array(rows[r.doc_id].posterior)
    aim = np.full(len(names), totals.sum() / 4)
    # quality is noise here, so only the languages can be told apart
    by_lang = lambda v: [sum(x for x, n in zip(v, names, strict=True) if n[:2] == la) for la in ("xx", "yy")]
    assert np.allclose(by_lang(totals), by_lang(aim), rtol=0.05)


def test_fit_of_rates_is_least_squares(spark):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3] * 3, 200), rng.integers(1, 100, 200)
    of = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "doc_id long, tokens long, posterior array<double>")
    want = np.array([0.5, 0.3, 0.2]) * n.sum()
    steps, totals = mixing.fit_rates(of, 3, want)
    assert np.allclose(totals, want, rtol=1e-3) and (mixing.rates_after(p, steps, 0.0) >= 0).all()
    steps, _ = mixing.fit_rates(of, 3, want * 2, floor=1.0)
    assert (mixing.rates_after(p, steps, 1.0) >= 1).all()


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_targets_that_cannot_be_met(spark, floor):
    """Bounds hold some rates: the sum of squares is that of a plain solver run to its end, and what is unmet is told."""
    rng = np.random.default_rng(8)
    p, n = rng.dirichlet([4.0] * 3, 150), rng.integers(1, 100, 150)
    rows = [(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))]
    want = np.array([0.9, 0.08, 0.02]) * n.sum()
    inverse = np.linalg.inv(p.T @ (p * n[:, None]))
    value = lambda r: (r * n @ p - want) @ inverse @ (r * n @ p - want)
    r = np.ones(150)
    for _ in range(50_000):
        r = np.maximum(floor, r - p @ (inverse @ (r * n @ p - want)))
    steps, totals = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>").coalesce(1), 3, want, floor)
    fitted = mixing.rates_after(p, steps, floor)
    assert np.allclose(fitted * n @ p, totals) and (np.isclose(r, floor)).any() and value(r) > 1
    assert value(fitted) <= 1.03 * value(r) and mixing.unmet(totals, want) > 0.01


def test_mixing_edges(spark, edge, labelled):
    docs, labels, _ = labelled
    none = spark.createDataFrame([], "doc_id long, text string, domain string")
    got = mixing.mix(edge, none).collect()
    assert len(got) == 9 and all(r.rate == 1 and r.domain is None and r.copies == 1 for r in got)
    assert mixing.mix(edge, mixing.quality_domains(docs, labels)).count() == 9
    assert mixing.mix(edge.limit(0), mixing.quality_domains(docs, labels)).count() == 0


def test_samples_are_bounded(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert common.sample_of(df, 100).count() == 100 and common.sample_of(df, 9000).count() == 5000 and common.sample_of(df.limit(0), 5).count() == 0
