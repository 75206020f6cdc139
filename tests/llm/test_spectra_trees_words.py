"""Whitening, Merkle manifests and word BPE against plain versions, with nulls, empty texts, repeats and empty tables."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import merkle, whitening, word_bpe
from tallyframe.llm.pieces import tokenizer_path

from test_llm import make

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- op11


def _scatter(x):
    c = x - x.mean(0)
    return c.T @ c


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(0)
    for _ in range(60):  # whole numbers: many equal eigenvalues, constant places and repeats
        dims = int(rng.integers(1, 10))
        x = rng.integers(0, 3, (int(rng.integers(1, 40)), dims)) * rng.integers(0, 2, dims)
        held, left, right = (whitening.Spectrum(dims) for _ in range(3))
        for i, row in enumerate(x.astype(np.int64)):
            held.add(row)
            (left if i % 3 else right).add(row, 2)
        left.merge(right)
        for s, times in ((held, 1), (left, 2)):
            want = _scatter(x) * times
            assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - want).max() < 1e-11 * max(1, want.max())
            assert np.abs(s.basis.T @ s.basis - np.eye(dims)).max() < 1e-12 and (np.diff(s.values) >= 0).all()
            assert s.n == len(x) * times and (s.sums == x.sum(0) * times).all()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(1)
    for scale in (1e-9, 1e-3, 1.0, 1e5):
        d, z = np.sort(rng.random(30)) * scale, rng.random(30) + 0.01
        roots = d - np.diagonal(whitening.secular_roots(d, z))
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(roots - want).max() < 1e-13 * want.max() and (roots > d).all() and (roots[:-1] < d[1:]).all()


def _whitened_plain(vectors, k):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s).astype(object) ** 2).sum(1), ((x - s / n) @ u / np.sqrt(e))[:, :k], e / e.sum()


def test_whitening_against_a_plain_version(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = whitening.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    n, deviation, want, share = _whitened_plain(np.stack(rows.sort_values("vec_id")["embedding"]), 32)
    w = got["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert (got[got.component == 1]["deviation"].to_numpy() == deviation).all() and set(got["n"]) == {n}
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32)[0], share[:32], rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<float>, component string"
    rng = np.random.default_rng(2)
    good = [(i if i else None, [float(v) for v in rng.normal(size=3)], "x") for i in range(20)]
    bad = [(90, None, ""), (91, [1.0, None, 2.0], ""), (92, [nan, 0.0, 0.0], ""), (93, [1.0, -inf, 0.0], ""), (94, [], ""), (95, [1.0, 2.0], "")]
    df = make(spark, [*good, good[3], *bad], kind).repartition(5)
    got = whitening.whitened(df).toPandas()
    _, deviation, want, _ = _whitened_plain([g[1] for g in [*good, good[3]]], 3)
    assert len(got) == 21 * 3 and sorted(got[got.component == 1]["deviation"]) == sorted(deviation.tolist())
    for c in range(3):
        assert np.allclose(np.sort(np.abs(got[got.component == c + 1]["whitened"])), np.sort(np.abs(want[:, c])), atol=1e-9)
    assert whitening.whitened(make(spark, bad[:5], kind)).collect() == [] == whitening.whitened(make(spark, [], kind)).collect()
    one = whitening.whitened(make(spark, good[1:2] * 3, kind)).collect()  # no spread: nothing to divide by
    assert len(one) == 9 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    flat = whitening.whitened(make(spark, [(i, [float(i), 1.0], "") for i in range(5)], kind)).toPandas()
    assert flat[flat.component == 2]["whitened"].isna().all() and flat[flat.component == 1]["whitened"].notna().all()
    far = whitening.whitened(make(spark, [(1, [2e7], ""), (2, [-2e7], "")], "vec_id long, embedding array<double>, component string")).collect()
    assert [r["deviation"] for r in far] == [(2 * 64 * 20_000_000) ** 2] * 2
    beyond = whitening.whitened(make(spark, [(1, [2e9], ""), (2, [-2e9], "")], "vec_id long, embedding array<double>, component string")).collect()
    assert [r["deviation"] for r in beyond] == [None, None] and abs(abs(beyond[0]["whitened"]) - 1) < 1e-12


# --- op12


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _fold_plain(leaves, i):
    """Root of a tree, and the siblings and sides of leaf i, level by level."""
    path = []
    while len(leaves) > 1:
        if i ^ 1 < len(leaves):
            path.append((leaves[i ^ 1], i & 1))
        else:
            path.append(None)
        leaves, i = [h(*leaves[j : j + 2]) for j in range(0, len(leaves), 2)], i // 2
    return leaves[0], path


def _manifest_plain(rows):
    """{(doc_id, leaf): the query's other columns} of rows (doc_id, source, lang, n_chars, text)."""
    import zlib

    leaf = lambda r, more=0: h(*map(_field, (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:2])
    tops = [_fold_plain([x[1] for x in trees[k]], 0)[0] for k in langs]
    out = []
    for at, k in enumerate(langs):
        root, over = _fold_plain(tops, at)
        for i, (_, own, r) in enumerate(trees[k]):
            path = _fold_plain([x[1] for x in trees[k]], i)[1] + over
            now = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for step in path:
                now = h(now) if step is None else h(step[0], now) if step[1] else h(now, step[0])
            out.append((r[0], own, tops[at], root, h("".join(s[0] for s in path if s)), now, now == root))
    return out


ROWS = "doc_id long, source string, lang string, n_chars long, text string, path string"


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_against_a_plain_version(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "s", "é:1", ""]), rng.choice([None, "en", "en", "en", "fr", "", "-", "é"]), rng.choice([None, 3, 70]), rng.choice([None, "", "naïve text", "x" * 5000])) for _ in range(150)]
    rows += rows[:10] + [(7, "s", "only", 1, "alone")]
    df = make(spark, [(*r, "clash") for r in rows], ROWS).repartition(3)
    made = merkle.document_manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, height)
    text = lambda b: bytes(b).hex()
    got = [(r["key"], text(r["leaf"]), text(r["subroot"]), text(r["root"]), h(text(r["proof"])), text(r["folded"]), r["folded"] == r["root"]) for r in made.collect()]
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=order) == sorted(_manifest_plain(rows), key=order)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_one_part_and_of_nothing(spark):
    assert merkle.document_manifest(make(spark, [], ROWS)).collect() == []
    (one,) = merkle.document_manifest(make(spark, [(None,) * 6], ROWS)).collect()
    assert one["leaf"] == one["root"] == one["subroot"] == one["folded"] and bytes(one["proof"]) == b"" and one["path"] == ""
    assert bytes(one["leaf"]).hex() == h("-----")


@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=40), st.data())
@settings(max_examples=60, deadline=None)
def test_every_proof_folds_to_its_root_and_no_other_leaf_does(leaves, data):
    tree = merkle.levels(leaves)
    i = data.draw(st.integers(0, len(leaves) - 1))
    proof, path = merkle._inside(tree, i)
    assert merkle.fold(leaves[i], proof, path) == tree[-1][0]
    other = bytes([leaves[i][0] ^ 1]) + leaves[i][1:]
    assert merkle.fold(other, proof, path) != tree[-1][0]


def test_manifest_query_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(merkle.ORACLE)
    names = [c[0] for c in res.description]
    want = sorted(tuple(r) for r in res.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in merkle.op12_merkle_manifest(spark, SF).collect()) == want


# --- op13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def coder():
    return word_bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))


def test_words_and_special_strings_as_the_library(library, coder):
    rng = random.Random(5)
    alphabet = [*"abcXYZ'sdlrevmtTI  \n\t\r\x0b\x1c\x85\xa0　 ", *"0123456789½²Ⅷé́̈Σσςİǅßﬁ中日한글🙂‍️!?.,-_<|>&#@ाि് ͅ𝒳\x00", "<|endoftext|>", "<|startoftext|>", "'ll ", "don't ", "Å", "≠", "x" * 70]
    texts = ["", " ", "\n", "<|endoftext|>", "a" * 5000, "ab" * 300 + "é" * 90, "word " * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids, n = coder.encode(pa.array(texts))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert lists.to_pylist() == want
    assert coder.decode(lists).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_library(library, coder, text):
    ids, _ = coder.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_as_short_ones_do(coder, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    want = [coder.word(w) for w in words]
    monkeypatch.setattr(word_bpe, "SHORT", 0)
    assert [coder.word(w) for w in words] == want


def test_words_of_one_length_merge_together_as_each_does(coder):
    rng = random.Random(10)
    for size in (1, 2, 3, 7, 20, 64):
        words = list({"".join(rng.choice("etaoinshrdlu" if i % 2 else "thé") for _ in range(size)).replace("é", "\u00c3\u00a9"[i % 2]) for i in range(300)})
        made = coder._together(words)
        assert {w: np.frombuffer(b, np.int32).tolist() for w, b in made.items()} == {w: coder.word(w) for w in words}
    assert coder._together(["a\u4e2d", "at"]).keys() == {"at"}  # a letter that stands for no byte


def test_forgetting_changes_nothing(library):
    small = word_bpe.WordBpe(tokenizer_path("word_bpe_49k.json"), limit=3)
    for t in ["one two three four five", "one two six", "", "seven one"]:
        assert small.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_chunks_of_letters_do_not_pass_the_rules_again(library, monkeypatch):
    coder, seen = word_bpe.WordBpe(tokenizer_path("word_bpe_49k.json")), []
    pieces = coder._pieces
    monkeypatch.setattr(coder, "_pieces", lambda text: seen.append(text) or pieces(text))
    texts = ["Plain LETTERS only", "it's e\u0301 \u0130x  tab\tbed x\x00y a<|endoftext|>b", "<|startoftext|> 12ab \u212a \ufb01n", "q" * 70 + " Z" * 3, ""]
    ids, n = coder.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    assert coder.letters_stay and not any(w in " ".join(seen) for w in ("Plain", "LETTERS", "only"))
    coder.letters_stay, coder.known = False, {}
    coder._forget()
    assert coder.encode(pa.array(texts))[0].tolist() == ids.tolist()


def test_word_bpe_query_and_odd_rows(spark, library):
    def want(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return len(ids), h(" ".join(map(str, ids))), h(library.decode(ids, skip_special_tokens=False))

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.op13_word_bpe(spark, SF).collect()}
    assert got == {d: want(t) for d, t in zip(docs["doc_id"].tolist(), docs["text"], strict=True)}
    rows = [(1, None, "a"), (None, "", "b"), (2, "Ab 12 <|endoftext|>\n", "c"), (2, "Ab 12 <|endoftext|>\n", "c"), (3, "long " * 100_000, "d")]
    df = make(spark, rows, "doc_id long, text string, ids string")
    made = word_bpe.encode(df).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in made) == sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert word_bpe.encode(df.where("false")).collect() == []
    held = make(spark, [(None, "x"), ([], "y"), ([49407, -1, 10**6, 320], "z")], "ids array<int>, c1 string")
    assert {r["c1"]: r["decoded"] for r in word_bpe.decode(held).collect()} == {"x": None, "y": "", "z": library.decode([49407, 320], skip_special_tokens=False)}
