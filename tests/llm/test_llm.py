"""The training-data operators against brute force, and on nulls, empties, ties, repeats, long texts and extra columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontam, hashing, html_blocks, html_extract, line_dedup, media, mixing, shingle_join, simhash, substring_dedup, token_counts, token_output, toxicity
from tallyframe.llm.pieces import PieceEncoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts, sources=None):
    return make(spark, [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, white and long texts, repeated rows, one id twice."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "a b c d e f", "en", "s0", 11), (1, "a b c d e f", "en", "s0", 11), (1, "other words for the same id", "en", "s1", 3), (None, "no id here", None, None, None),
        (None, None, None, None, None), (2, "", "en", "s0", 0), (3, " \n\t ", "en", "s1", 4), (4, long, "en", "s2", len(long)), (5, None, "de", "s2", 0), (6, "Ünïcödé 漢字 🤦🏼 <|endoftext|> x", "fr", "s2", 9),
    ]
    return make(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def ids(df):
    return sorted((str(r["doc_id"]) for r in df.collect()))


# 1: token ids as planes


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 60_000, n).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 40_000, 7])]
    data = token_output.write_segment(docs, 123, kind)
    names, back, before = token_output.read_segment(data)
    assert before == 123 and names["n"].tolist() == [0, 1, 40_000, 7]
    assert back.tobytes() == b"".join(d for _, d in docs)
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(Exception):
        token_output.read_segment(bytes(broken))


def test_token_output(spark, odd):
    enc = PieceEncoder(tokenizer_path()).tok
    got = token_output.token_output(spark, odd).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda i: (i is not None, i or 0)) and len(got) == odd.count()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = collections.Counter((r["doc_id"], zlib.crc32(np.array([*enc.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in token_output.digest(token_output.token_output(spark, odd)).collect()) == want


def test_token_output_empty(spark, none):
    assert token_output.token_output(spark, none).count() == 0


# 2: mixing


def test_water_fill(spark):
    w = make(spark, [("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0), ("d", 0, 5.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(w).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got["d"] == 0
    assert got["c"] == pytest.approx(1.5 * 1110 - 220)


def test_mix(spark, odd):
    got = mixing.mix(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(odd.repartition(5)).collect()), key=str)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        by[r["source"]][0] += r["mix_taken"]
        by[r["source"]][1] = r["mix_target"]
    assert all(abs(a - b) <= 1 for a, b in by.values())
    made = mixing.materialise(got, odd.columns)
    assert made.columns == odd.columns
    size = collections.Counter()
    for r in made.collect():
        size[r["source"]] += len(r["text"].encode().split())
    assert all(size[s] == v[0] for s, v in by.items())


def test_mix_empty_and_clash(spark, none, odd):
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd.withColumn("mix_size", F.lit(1)))


# 3: decontamination


def _tiles_brute(doc, item, n):
    """Greedy tiling by trying every pair of starts."""
    n = min(n, len(item))
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while n:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and fi[a + k] and fd[b + k]:
                    k += 1
                if k >= n and (best is None or (-k, a, b) < best):
                    best = (-k, a, b)
        if best is None:
            return out
        k, a, b = -best[0], best[1], best[2]
        out.append((a, b, k))
        for j in range(k):
            fi[a + j] = fd[b + j] = False
    return out


def test_tiles_against_brute_force():
    rng = random.Random(2)
    for _ in range(120):
        item, doc = [rng.choice("abc") for _ in range(rng.randint(0, 14))], [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        h = lambda ws: hashing.word_hashes([" ".join(ws).encode()])[0]
        assert decontam.tiles(h(doc), h(item), 3) == _tiles_brute(doc, item, 3)


def test_decontamination(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    texts = [
        f"before {item} after", "x " + " ".join(w[6:] + ["y"] + w[:6]) + " z", " ".join(w[:6]) + " and no more", "ONE two Three four five six seven eight nine ten eleven twelve", None, "", "tiny item",
    ]
    bench = make(spark, [(7, item), (8, None), (9, ""), (10, "tiny item"), (None, "never seen words")], "item_id long, text string")
    for how in (True, False):
        got = {r["doc_id"]: sorted(m["item_id"] for m in r["matches"] if m["n_covered"] >= 0.8 * m["n_item_words"]) for r in decontam.find_matches(docs_of(spark, texts), bench, broadcast=how).collect()}
        assert got == {0: [7], 1: [7], 2: [], 3: [7], 4: [], 5: [], 6: [10]}
        assert decontam.find_matches(odd, bench, broadcast=how).count() == odd.count()
        assert decontam.find_matches(none, bench, broadcast=how).count() == 0
        assert all(not r["matches"] for r in decontam.find_matches(odd, bench.limit(0), broadcast=how).collect())
    with pytest.raises(ValueError):
        decontam.find_matches(odd.withColumn("matches", F.lit(1)), bench)


def test_repeated_benchmark_rows_are_items_of_their_own_on_both_paths(spark):
    words = "a b c d e f g h"
    items = spark.createDataFrame([(2, words), (1, words), (1, words), (None, words), (None, words), (3, "not in it at all is this")], "item_id long, text string")
    docs = docs_of(spark, [f"x {words} y", "nothing of it"])
    got = [{r["doc_id"]: r["matches"] for r in decontam.find_matches(docs, items, broadcast=b).collect()} for b in (True, False)]
    assert [m["item_id"] for m in got[0][0]] == [1, 1, 2, None, None]
    assert got[0] == got[1] and got[0][1] == []


# 4: HTML


def test_blocks():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a><li>Two</ul></nav><p>One <b>bold</b> &amp; &eacute;<br>line<p>Next<script>var a='<p>no</p>'</script> end<!-- <p>no --></div><table><tr><td>c1<td>c2</table>tail"
    assert [b.text for b in html_blocks.blocks(page)] == ["Home", "Two", "One bold & é line", "Next end", "c1", "c2", "tail"]
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("<p") != None  # noqa: E711
    assert [b.text for b in html_blocks.blocks("a < b and <p class='x>y'>c")][-1] == "c"


@pytest.mark.parametrize("icon", ['<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<SVG a='x>y' />", "<math/>", "<svg width=1 />"])
def test_text_after_a_self_closed_icon(icon):
    assert [b.text for b in html_blocks.blocks(f"<p>a</p>{icon}<p>article</p>")] == ["a", "article"]
    assert [b.text for b in html_blocks.blocks(f"<p>a</p><svg><g/>{icon}<text>no</text></svg>{icon}<p>b</p><svg>no</svg>c")] == ["a", "b", "c"]


@pytest.mark.parametrize("icon", ["<svg><path d='x'/></svg>", "<svg width=1/><text>no</text></svg>", '<svg a="/"><text>no</text></svg>'])
def test_icons_with_an_end_tag(icon):
    assert [b.text for b in html_blocks.blocks(f"<p>a</p>{icon}<p>article</p>")] == ["a", "article"]


def test_gradients():
    model = html_extract.Labeller(5, 3, 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, n, y = np.random.default_rng(0).standard_normal((2, 4, 5)), np.array([4, 3]), np.array([[1, 0, 1, 0], [0, 1, 1, 0.0]])

    def loss():
        z, _ = model.scores(x, n)
        mask = np.arange(4) < n[:, None]
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    grads = model.gradients(x, n, y)
    for k, p in model.p.items():
        flat = p.ravel()
        for j in range(0, flat.size, max(1, flat.size // 6)):
            old = flat[j]
            flat[j] = old + 1e-3
            up = loss()
            flat[j] = old - 1e-3
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-3 - np.ravel(grads[k])[j]) < 1e-5


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_labeller_on_layouts_not_seen(labeller):
    texts = ["some words of a text that goes on for a while, as texts do.", "short one", "another sentence with a few more words in it."]
    xs, ys = html_extract.training_set(texts, 120, seed=991)
    got, want = np.concatenate(labeller.predict(xs)), np.concatenate(ys) > 0.5
    assert (got == want).mean() > 0.95


def test_extract(spark, labeller):
    body = "<article><h1>Title &amp; more</h1><p>First   paragraph\n of text.</p><p>Second one, with <i>markup</i>.</p></article>"
    page = f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>{body}<div class='ad'>Buy now</div><footer>&copy; site</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<html><script>x</script></html>")]
    df = make(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df, labeller).collect()
    assert sorted(r["text"] for r in got) == ["", "", ""] + ["Title & more\n\nFirst paragraph of text.\n\nSecond one, with markup."] * 2
    assert html_extract.extract(df.limit(0), labeller).count() == 0


# 5: repeated passages


def _passages_brute(texts, window):
    seen = collections.Counter()
    docs = [(t or "").encode().split() for t in texts]
    for w in docs:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("window,seed", [(35, 9), (7, 2), (11, 3)])
def test_passages_against_brute_force(spark, window, seed):
    rng = random.Random(window)
    texts = [None, "", " \n "]
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(60)] for _ in range(4)]
    for _ in range(40):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 25))] if rng.random() < 0.3 else [str(rng.randrange(500)) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([0, 1, 2])):
            p, at, k = rng.choice(shared), rng.randint(0, len(w)), rng.randint(0, 30)
            w[at:at] = p[k : k + rng.randint(5, 50)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += texts[5:9]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.dedup_passages(docs_of(spark, texts).repartition(5), window, seed).collect()}
    assert got == dict(enumerate(_passages_brute(texts, window)))


def test_passages_odd(spark, odd, none):
    rows = substring_dedup.dedup_passages(odd).collect()
    want = collections.Counter((r[0], r[2]) for r in _passages_brute([r["text"] for r in odd.collect()], 35))
    assert collections.Counter((r["n_words"], r["text"]) for r in rows) == want
    assert substring_dedup.dedup_passages(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_passages(none, 50, 9)


# 6: token counts


def test_prefix_counts_are_those_of_the_tokenizer():
    counter = token_counts.PrefixCounter(tokenizer_path())
    rng = random.Random(1)
    bits = ["a", "b", "th", "e", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "'r", "1", "23", "é", "漢", "🤦🏼", "!", "?!", "<|endoftext|>", "<|end", "　", "\x85", "\x1c", "x'll", " ", "ñ", "​", "²", "़"]
    for _ in range(600):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert counter.prefix(t).tolist() == [len(counter.tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], repr(t)


def test_token_counts(spark, odd, none):
    enc = PieceEncoder(tokenizer_path()).tok
    tables = token_counts.prefix_tables(odd)
    got = token_counts.answers(tables, limit=3).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(enc.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    seen = collections.Counter()
    for r in tables.collect():
        p = token_counts.unpack_counts(r["prefix_counts"])
        cut = token_counts.cut_within(p, 3)
        assert p[cut] <= 3 and (cut == len(p) - 1 or (p[cut + 1 :] > 3).all())
        assert token_counts.count_within(r["prefix_counts"], 0, len(p) - 1) == p[-1]
        seen[r["doc_id"], int(p[-1]), cut] += 1
    assert seen == collections.Counter((r["doc_id"], r["n_tokens"], r["cut_chars"]) for r in got)
    assert token_counts.answers(token_counts.prefix_tables(none)).count() == 0


# 7: SimHash


def _classes_brute(prints, radius=3):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                parent[root(b)] = root(a)
    return {p: root(p) for p in prints}


def test_links_and_components_against_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:30]:
        x = b
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    rows = make(spark, [(i, p) for i, p in enumerate(sorted(signed))], "doc_id long, fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert {tuple(r) for r in simhash.links(rows).collect()} == want
    roots = _classes_brute(signed)
    got = {r["fp"]: r["component_id"] for r in simhash.classes(rows).collect()}
    first = {}
    for i, p in enumerate(sorted(signed)):
        first.setdefault(roots[p], i)
    assert got == {p: first[roots[p]] for p in signed}


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    t = "The quick Brown fox\tjumps ÄÖ"
    w = "the quick brown fox jumps ÄÖ".split()
    hs = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)
    assert simhash.fingerprint(t) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates_odd(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r["fp"] for r in got})  # no two of these are linked; the rows alike in all columns are one
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


# near-duplicates of the pipeline


def _kept_brute(texts, least=0.8, k=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return sorted(set(root))


@pytest.mark.parametrize("options", [{}, {"most": 0, "rounds": 2}, {"most": 1 << 40}])
def test_near_duplicates_of_the_pipeline_against_brute_force(spark, options):
    rng = random.Random(8)
    texts = ["", " ", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(8):
            at = rng.randrange(len(base))
            base = base[:at] + ["new" + str(rng.random())] + base[at + rng.randrange(2) :]
            texts.append(" ".join(base))
    rng.shuffle(texts)
    got = shingle_join.drop_near_duplicates(docs_of(spark, texts).repartition(3), **options)
    assert sorted(r["doc_id"] for r in got.collect()) == _kept_brute(texts)


def test_near_duplicates_of_the_pipeline_reach_a_similarity_of_08(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(words), " ".join(words[:40] + ["x"] + words[41:80] + ["y"] + words[81:])]
    bits = bin((simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])) & (2**64 - 1)).count("1")
    assert bits > 3 and _kept_brute(texts) == [0]
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, texts), "")) == ["0"]


def test_near_duplicates_of_the_pipeline_look_at_few_pairs_of_a_group(spark, monkeypatch):
    rng, rows, whole = random.Random(5), {}, shingle_join.stage
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(200), 3):
            words[j] = f"new{i}x{j}"
        texts.append(" ".join(words))
    texts += [texts[7] + " end", texts[7] + " end of it"]

    def counted(df, name):
        made = whole(df, name)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(shingle_join, "stage", counted)
    got = shingle_join.drop_near_duplicates(docs_of(spark, texts), rounds=0)
    # most pairs share rare shingles and are below 0.8, so there are about 1,800 of them to look at without sketches
    assert sorted(r["doc_id"] for r in got.collect()) == _kept_brute(texts) and rows["shinglefound"] <= 6 * len(texts)


def test_rounds_of_the_pipeline_try_one_close_pair_a_post_and_end_when_they_take_little_away(spark, monkeypatch):
    rng, live, whole = random.Random(6), [], shingle_join.stage
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(40):  # these share rare shingles, but no two are similar
        words = list(base)
        for j in rng.sample(range(200), 12):
            words[j] = f"new{i}x{j}"
        texts.append(" ".join(words))

    def kept(df, name):
        made = whole(df, name)
        if name == "shinglelive":
            live.append(made.agg(F.count("*").alias("posts"), F.count("near").alias("tried")).first())
        return made

    monkeypatch.setattr(shingle_join, "stage", kept)
    got = shingle_join.drop_near_duplicates(docs_of(spark, texts), most=0)
    assert sorted(r["doc_id"] for r in got.collect()) == _kept_brute(texts)
    # five pairs a post were tried in each of three rounds
    assert 1 <= len(live) <= 2 and all(r["tried"] <= r["posts"] for r in live)


def test_a_round_tries_the_nearest_of_other_components(spark):
    posts = spark.createDataFrame([(k, 100, fp, root, 0, 1) for k, fp, root in [(1, 0, 1), (2, 0b111, 2), (3, 0b1, 3), (4, 0, 3), (5, (1 << 40) - 1, 5)]], "key long, n int, fp long, root long, pos int, t long")
    near = {r["key"]: r["near"] for r in shingle_join._live(posts, 0, 0.8).collect()}
    # in the order of keys: none before 1; 3 is nearer to 1 than to 2; 4 is in the component of 3; 5 is close to none
    assert near == {1: None, 2: 1, 3: 1, 4: 1, 5: None}


def test_texts_are_hashed_in_runs_of_bounded_size():
    sizes = [10] * 450 + [300_000] * 3 + [2_000_000, 0, 5]
    runs = list(shingle_join.runs_of(sizes))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes))) and not list(shingle_join.runs_of([]))
    assert all(b - a <= shingle_join.AT_ONCE and (b - a == 1 or sum(sizes[a:b]) <= shingle_join.BYTES) for a, b in runs)


def test_near_duplicates_of_the_pipeline_odd(spark, odd, none):
    kept = shingle_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and ids(kept) == ids(simhash.drop_near_duplicates(odd))
    assert shingle_join.drop_near_duplicates(none).count() == 0


# 8: toxicity


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    e, moves = rng.standard_normal(6), rng.standard_normal(4)
    weights = np.zeros((6, 2))
    for path in np.ndindex(*[2] * 6):
        s = sum(e[t] * y for t, y in enumerate(path)) + moves[path[0]] + sum(moves[2 * a + b] for a, b in zip(path, path[1:], strict=False))
        for t, y in enumerate(path):
            weights[t, y] += np.exp(s)
    got = toxicity.marginals([e, e[:0], e[:2]], moves)
    assert np.allclose(got[0], weights[:, 1] / weights.sum(1)) and len(got[1]) == 0


def test_toxicity(spark):
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randint(0, len(w)), rng.choice(["nasty", "vile,", "grim"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = docs_of(spark, texts)
    labels = make(spark, [(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= 0.5) == bool(toxic[i]) for i in held]) > 0.97
    hit = next(r for i, r in got.items() if toxic[i])
    assert all(texts[hit["doc_id"]][s["start"] : s["end"]].strip(",") in ("nasty", "vile", "grim") for s in hit["spans"]) and hit["spans"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and ids(kept) == sorted(str(i) for i, r in got.items() if r["score"] < 0.5)


def test_toxicity_odd(spark, odd, none):
    labels = make(spark, [(1, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels.limit(0))
    assert model is None and all(r["score"] == 0 for r in toxicity.tag(odd, model).collect())
    got = toxicity.tag(odd, toxicity.train(odd, labels))
    assert got.count() == odd.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.tag(none, None).count() == 0 and toxicity.drop_toxic(none, labels).count() == 0


# 9: lines


def _lines_brute(rows, t):
    places = []
    for i, text in rows:
        for n, line in enumerate([] if text is None else text.split("\n")):
            s = frozenset(x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x)
            places.append(((i is None, i or 0, n), line, s))
    gone = set()
    for a, _, s in places:
        for b, _, u in places:
            if s and u and b < a and len(s & u) >= t * len(s | u) - 1e-9:
                gone.add(a)
                break
    return {i: None if text is None else "\n".join(x for (p, x, _) in places if p[:2] == (i is None, i or 0) and p not in gone) for i, text in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(40)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(25)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(pool).split()
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(40, None), (41, ""), (None, "v1 v2 v3\n\nv1 v2 v3")]
    df = make(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == _lines_brute(rows, 0.8)


def test_lines_odd(spark, odd, none):
    made = line_dedup.dedup_lines(odd.withColumn("line", F.lit(1)).withColumn("key", F.lit(2)))
    assert made.count() == odd.count()
    assert line_dedup.dedup_lines(none).count() == 0


# 10: media


def test_png_of_every_filter():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (6, 9)).astype(np.uint8)
    assert (media.read_png(media.write_png(px)) == px).all()
    rows, above = [], np.zeros(9, np.int64)
    for i, row in enumerate(px.astype(np.int64)):
        kind = i % 5
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        rows.append(np.r_[kind, (row - [0, left, above, (left + above) // 2, paeth][kind]) % 256])
        above = row
    assert (media.unfilter(np.array(rows, np.uint8)) == px).all()
    data = bytearray(media.write_png(px))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(data))


def test_media(spark, odd, none):
    got = media.read_media(media.write_media(odd)).collect()
    want = collections.Counter((r["doc_id"], hashlib.sha256(media.payload(r["text"])).digest()) for r in odd.collect())
    assert collections.Counter((r["doc_id"], hashlib.sha256(r["payload"]).digest()) for r in got) == want
    by = collections.defaultdict(set)
    for r in got:
        by[bytes(r["payload"])].add((bytes(r["media"]), r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert media.read_media(media.write_media(none)).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, d), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == docs.count()
    total = last.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    assert total == last.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for rows in (odd, none):
        docs = rows
        for name, step in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(step(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.count() >= 0
