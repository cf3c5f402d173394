import base64
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from casario.llm import byte_bpe, encoders, packing, token_output
from casario.llm.common import shared_dir
from casario.llm.encoders import Encoder

HARD = ["", " ", "\n", "a", "  a  b\n\n c\n", "\x1ca \x1c b", "É é\n\nÉ ̈ x", "it's 'll the's foo's. A's", "\tab\t c\t\n d", "x\r\ny z\xa0\xa0w q　 r \xa0b a\xa0 \xa0b",
        "a\n\n\nb \n c", "<|endoftext|> a <|endoftext|>", "a <|ENDOFTEXT|>b <|startoftext|> c<|", "<| x |>", "ªº 12 3²45 ½ x×y", "don't, \"quoted\" -- yes!!! $$$ a_b", "naïve 😀😀 é", "日本語のテキスト" * 9]


def library(name, special=True):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = not special
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_the_library(corpus, name, blanks, special):
    texts = HARD + [t or "" for _, t, *_ in corpus]
    coder = Encoder(P.path(name), blanks, special)
    for _ in range(2):  # with an empty and a filled memo
        assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in texts] == library(name, special)(texts)


def test_chunks_are_those_of_the_cut():
    rng = np.random.default_rng(4)
    for _ in range(20_000):
        text = "".join(rng.choice(list("ab,é \n\t\xa0\u3000\x1c"), rng.integers(1, 14)))
        if text.strip():
            assert encoders._CHUNK.findall(text) == encoders._CUT.split(text), repr(text)


def test_special_tokens_by_default():
    assert np.frombuffer(Encoder(P.path("byte_bpe_50k.json"), True).encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    assert np.frombuffer(Encoder(P.path("word_bpe_49k.json"), False).encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


def test_token_files(spark, docs, corpus):
    to = shared_dir(spark, "t")
    token_output.write_tokens(docs, to, P.path("byte_bpe_50k.json"), keep=("lang",))
    ids = {i: [*x, 0] for (i, *_), x in zip(corpus, library("byte_bpe_50k.json")([t or "" for _, t, *_ in corpus]), strict=True)}
    rows = token_output.read_tokens(spark, to).collect()
    assert len(rows) == len(corpus) and all(r.tokens == ids[r.doc_id] for r in rows)
    read = token_output.crc_of_ids(token_output.read_tokens(spark, to, ("doc_id", "n_tokens", "part", "at", "tokens")))
    done = token_output.with_starts(read, token_output.read_tokens(spark, to, ("n_tokens", "part"))).orderBy("start").collect()
    assert [r.doc_id for r in done] == sorted(i for i, *_ in corpus)
    at = 0
    for r in done:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())
        at += r.n_tokens
    meta = token_output.read_tokens(spark, to, ("doc_id", "lang"))
    assert "tokens" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_token_files_have_dictionaries_indexes_and_small_groups(spark, tmp_path, monkeypatch):
    """What a reader of a few documents or of metadata alone relies on."""
    monkeypatch.setitem(token_output.FILES, "parquet.block.size", str(256 << 10))
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 60))) for i in range(6000)]
    to = f"file://{tmp_path}/t"
    token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), to, P.path("byte_bpe_50k.json"))
    groups = [f.row_group(i) for p in sorted(tmp_path.glob("t/*.parquet")) for f in [pq.ParquetFile(p).metadata] for i in range(f.num_row_groups)]
    assert len(groups) > 4 and all(g.num_rows < 6000 for g in groups)
    for g in groups:
        cols = {g.column(i).path_in_schema.split(".")[0]: g.column(i) for i in range(g.num_columns)}
        assert set(cols) == set(token_output.OWN)
        assert any("DICTIONARY" in e for e in cols["tokens"].encodings) and cols["tokens"].has_dictionary_page
        assert all(c.has_offset_index for c in cols.values()) and cols["doc_id"].has_column_index
        assert cols["doc_id"].statistics.max - cols["doc_id"].statistics.min == g.num_rows - 1
    some = spark.read.parquet(to).where("doc_id BETWEEN 100 AND 110").select("doc_id", "tokens")
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 11


def test_token_files_with_clashing_columns_repeats_and_null_ids(spark):
    to = shared_dir(spark, "t")
    rows = [(1, "b c", "k"), (1, "a", "k"), (1, "a", "k"), (None, "x y z", None), (0, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS n_tokens", "1 AS at", "2 AS part")
    token_output.write_tokens(df, to, P.path("byte_bpe_50k.json"), keep=("n_tokens", "at", "part", "lang"))
    out = token_output.read_tokens(spark, to, ("doc_id", "lang", "n_tokens", "part", "at", "tokens"))
    done = token_output.with_starts(out, out).orderBy("start").collect()
    assert [r.doc_id for r in done] == [None, 0, 1, 1, 1] and [r.lang for r in done] == [None, *"kkkk"]
    assert [r.start for r in done] == [0, *np.cumsum([len(r.tokens) for r in done])[:-1].tolist()]
    files = [r.tokens for r in spark.read.parquet(to).where("doc_id = 1").orderBy("part", "at").select("tokens").collect()]
    assert files == [r.tokens for r in done[2:]]


def test_token_files_of_nothing(spark, nothing):
    to = shared_dir(spark, "t")
    token_output.write_tokens(nothing, to, P.path("byte_bpe_50k.json"))
    assert token_output.read_tokens(spark, to).count() == 0


def test_byte_bpe_against_the_library(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, *HARD, "x" * 3000 + " " + "=-" * 700 + "\n" * 300 + " " * 50, "a" * 640]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    out = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, P.PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(text), repr(text[:30])
        assert bytes(r.decoded) == text.encode()
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path, P.PATTERN).count() == 0
    for w in ("ab" * 300, "the" * 100, "é" * 200):
        assert byte_bpe.merge_heap(w.encode(), ranks) == enc.encode_ordinary(w)


def test_byte_bpe_folds_numbers(spark):
    """The fold's state is one array of numbers: no step joins or copies pieces."""
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    words = ["aaaa", "aaaaaaa", " ofanwhtiti", "ñueasñ", " \u4f60\u597d\U0001f600", "x" * byte_bpe.LONG, "ab" * 100, "zqxj", "\n", "-=" * 60]
    latin = F.decode(F.col("w").cast("binary"), "ISO-8859-1")
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold(latin, byte_bpe.literal(ranks)).alias("ids"))
    assert {r.w: r.ids for r in df.collect()} == {w: byte_bpe.merge_heap(w.encode(), ranks) for w in words}
    plan = byte_bpe.fold(latin, F.array(F.create_map(F.lit("a"), F.lit(0))))
    plan = spark.range(1).select(F.lit("ab").alias("w")).select(plan)._jdf.queryExecution().analyzed().toString()
    assert "concat(" not in plan
    with pytest.raises(ValueError):
        byte_bpe.literal({b"a": byte_bpe.NO_RANK})


def test_byte_bpe_cuts_only_new_pieces(monkeypatch):
    asked = []
    monkeypatch.setattr(byte_bpe, "is_chunk", lambda p, f=byte_bpe.is_chunk: asked.append(p) or f(p))
    first, rest, new = byte_bpe.cut("to be or\nnot to be", {"be": b"", "to": b""})
    assert (first, rest, new) == ("to", ["be", "or", "\nnot", "to", "be"], {"or", "\nnot"}) and set(asked) == new
    for text in [t for t in HARD if t]:
        assert byte_bpe.cut(text, {})[:2] == encoders.pieces_of(text)
    assert byte_bpe.cut(None, {}) == ("", [], set())


def packed_items(counts, size):
    bins = []
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            room = [i for i, r in enumerate(bins) if r >= k]
            if room:
                bins[min(room, key=lambda i: bins[i])] -= k
            else:
                bins.append(size - k)
    return len(bins)


def test_plan_is_no_worse_than_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(40):
        size = int(rng.choice([20, 50, 2048]))
        counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, size + 1, rng.integers(1, 60))}
        fixed, left = packing.reduce(dict(counts), size)
        sets = fixed + packing.best_fit(dict(left), size)
        assert all(sum(x) <= size for x, _ in sets)
        used = {}
        for x, n in sets:
            for k in x:
                used[k] = used.get(k, 0) + n
        assert used == counts
        assert sum(n for _, n in sets) <= packed_items(counts, size)


def test_dominance_fixes_perfect_pairs():
    assert packing.reduce({7: 2, 3: 1}, 10) == ([((7, 3), 1), ((7,), 1)], {})
    assert packing.reduce({5: 3}, 10)[0] == [((5, 5), 1), ((5,), 1)]


def test_packing(docs, corpus, nothing):
    rows = packing.packed(docs, P.path("word_bpe_49k.json"), 256).collect()
    ids = [(i, [*x, 0]) for (i, *_), x in zip(corpus, library("word_bpe_49k.json")([t or "" for _, t, *_ in corpus]), strict=True)]
    want = sorted((i, k, at, min(256, len(x) - at), zlib.crc32(np.array(x[at : at + 256], "<u4").tobytes())) for i, x in ids for k, at in enumerate(range(0, len(x), 256)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 256
    assert packing.packed(nothing, P.path("word_bpe_49k.json")).count() == 0
