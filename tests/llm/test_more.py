"""Further tests of the training-data operators: column names, large groups, bounds, and the pipeline against brute force."""

import collections
import hashlib
import random
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontam, hashing, html_blocks, line_dedup, media, mixing, shingle_join, simhash, toxicity
from tallyframe.llm.common import free_names, likely
from tallyframe.llm.pieces import PieceEncoder, tokenizer_path

from test_llm import _kept_brute, _lines_brute, _tiles_brute, docs_of, make

NAMES = "_h _id _row _key _text _items _doc _gone target rest whole source_size _level line_marks row key a b t gone _dup_row".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(3)
    texts = ["one two three four five six seven eight", None, "", "one two three four five six seven eight", *(" ".join(f"w{rng.randrange(50)}" for _ in range(20)) for _ in range(6))]
    rows = docs_of(spark, texts)
    return rows.select("*", *[F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def _unchanged(made, columns):
    assert made.columns[: len(columns)] == columns
    rows = made.collect()
    assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in NAMES)
    return rows


def test_columns_of_any_name_pass_through(spark, clashing):
    bench = make(spark, [(1, "one two three four five six seven")], "item_id long, text string")
    labels = make(spark, [(4, 1, 1), (5, 1, 0), (6, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for how in (True, False):
        assert len(_unchanged(decontam.find_matches(clashing, bench, broadcast=how), clashing.columns)) == 10
    mixed = mixing.mix(clashing)
    assert len(_unchanged(mixed, clashing.columns)) == 10
    _unchanged(mixing.materialise(mixed, clashing.columns), clashing.columns)
    assert len(_unchanged(simhash.drop_near_duplicates(clashing), clashing.columns)) == 8
    assert len(_unchanged(shingle_join.drop_near_duplicates(clashing), clashing.columns)) == 8
    assert len(_unchanged(line_dedup.dedup_lines(clashing, removed="cut"), clashing.columns)) == 10
    _unchanged(toxicity.drop_toxic(clashing, labels), clashing.columns)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(clashing, removed="Row")
    assert free_names(["_A", "_a_0"], "a", "b") == ["_a_1", "_b"]


def test_rows_with_a_map_column(spark):
    df = spark.createDataFrame([(1, "a b", {"x": 1}), (2, "a b", {"y": 2})], "doc_id long, text string, m map<string,int>")
    assert [(r["doc_id"], r["m"]) for r in simhash.drop_near_duplicates(df).collect()] == [(1, {"x": 1})]


def test_likely_never_drops_a_wanted_row(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("k"))
    wanted = rows.where("id % 50 = 0").select(F.col("k").alias("w"))
    kept = {r["id"] for r in likely(rows, "k", wanted, "w").collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 1000
    assert likely(rows, "k", wanted.limit(0), "w").count() == 0


# decontamination


def test_long_tiles_against_brute_force():
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    number = {w: i for i, w in enumerate(base)}
    for _ in range(60):
        item = [rng.choice(base) for _ in range(rng.randint(5, 40))]
        doc = [rng.choice(base) for _ in range(rng.randint(0, 20))]
        for _ in range(3):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randint(1, 20)] + [rng.choice(base)] * rng.randint(0, 2)
        ids = lambda ws: np.array([number[w] for w in ws], np.uint64)
        assert decontam.tiles(ids(doc), ids(item), 5) == _tiles_brute(doc, item, 5)


def test_tiles_of_one_word_texts_stay_within_memory():
    doc, item = np.zeros(1_000_000, np.uint64), np.zeros(200, np.uint64)
    tracemalloc.start()
    began = time.time()
    assert decontam.tiles(doc, item) == [(0, 0, 200)]
    assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


def test_equal_hashes_of_different_words_do_not_match(monkeypatch):
    low = lambda x: x & np.uint64(31)
    runs = hashing.run_hashes
    monkeypatch.setattr(decontam, "mix", low)
    monkeypatch.setattr(decontam, "run_hashes", lambda w, n: runs(low(w), n))
    doc = np.array([*range(39, 44), 99, *range(7, 12), 98], np.uint64)  # 39 to 43 hash like 7 to 11
    item = np.array([50, 7, 8, 9, 10, 11, 60], np.uint64)
    assert decontam.tiles(doc, item) == [(1, 6, 5)]
    assert decontam.tiles(doc[:6], item) == []


# HTML


class _Plain(HTMLParser):
    """Text blocks of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.raw = [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_blocks.RAW.split():
            self.raw += 1
        if tag in html_blocks.BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in html_blocks.RAW.split():
            self.raw -= 1
        if tag in html_blocks.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


def test_blocks_are_those_of_the_standard_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    same = 0
    for page in pages:
        plain = _Plain()
        plain.feed(page)
        plain.close()
        plain.flush()
        same += [" ".join(b.text.split()) for b in html_blocks.blocks(page)] == plain.out
    assert len(pages) > 100 and same == len(pages)


def test_deep_pages_take_linear_time():
    page = '<div class="a">x' * 100_000
    began = time.time()
    found = html_blocks.blocks(page)
    assert len(found) == 100_000 and found[2].path == ("div a",) * 3
    html_blocks.vectors(found)
    assert time.time() - began < 30
    for odd in ("<div>" * 4000 + "<li>a</li>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, '<a "' * 40_000, "<!--" * 40_000):
        began = time.time()
        html_blocks.blocks(odd)
        assert time.time() - began < 10


def test_ends_of_pages():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<p>a</p><!-- never closed <p>b</p>") == ["a"]
    assert texts("<p>a</p><script>x <p>b</p> y") == ["a"]
    assert texts("<p>a</p>tail <!-- no") == ["a", "tail"]
    assert texts("<p>a</p>tail <b") == ["a", "tail <b"]


# SimHash


def test_near_links_are_links(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = set(base) | {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(15)}
    rows = make(spark, [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))], "doc_id long, fp long")
    for blocks in (5, 7):
        every, near = ({tuple(sorted(r)) for r in f(rows, blocks=blocks).collect()} for f in (simhash.links, simhash.near_links))
        assert near <= every and len(every) > 100
        assert every == {tuple(sorted(r)) for r in simhash.links(rows).collect()}
        roots = lambda es: {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(sorted(es), "a long, b long")).collect()}
        assert len(set(roots(near).values())) <= 1.5 * len(set(roots(every).values()))
    assert [simhash.choose_blocks(n) for n in (0, 1000, 10**9, 10**10, 10**11, 10**13)] == [5, 5, 6, 6, 7, 8]


def test_set_fingerprint():
    found = np.array([0b1011, 0b0011, 1 << 63], np.uint64)
    assert shingle_join.set_fingerprint(found) == 0b0011 and shingle_join.set_fingerprint(found[2:]) == -(1 << 63)


# lines


def test_lines_of_large_groups_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}x{i}" for i in range(rng.choice([12, 40]))]
        for i in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((g * 1000 + rng.randrange(900), " ".join(w) + rng.choice(["", "\nshared line of five words"])))
    seen = {i: t for i, t in rows}
    rows = sorted(seen.items())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(spark, [(i, t, "en", "s", 0) for i, t in rows]).repartition(3)).collect()}
    assert got == _lines_brute(rows, 0.8)


def test_lines_at_equal_places_stay(spark):
    rows = [(1, "same words here now\nother"), (1, "same words here now"), (2, "same words here now"), (None, "same words here now"), (None, None)]
    got = collections.Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(make(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect())
    assert got == collections.Counter([(1, "same words here now\nother"), (1, "same words here now"), (2, ""), (None, ""), (None, None)])


# media


@pytest.mark.parametrize("height", [1, 2, 3, 7, 8, 20, 5000])
def test_cosine_hash_against_sums(height):
    px = np.random.default_rng(height).integers(0, 256, (height, 24)).astype(np.uint8)
    down = min(height, 8)
    across = min(24, -(-64 // down))
    want = np.zeros((down, across))
    for u in range(down):
        for v in range(across):
            rows = np.cos(np.pi * u * (2 * np.arange(height) + 1) / (2 * height))
            cols = np.cos(np.pi * v * (2 * np.arange(24) + 1) / 48)
            want[u, v] = sum(float(rows[y]) * float((px[y] * cols).sum()) for y in range(height)) / height / 24
    assert np.allclose(media.low_frequencies(px), want)
    flat = np.round(want.ravel()[:64], 6)
    bits = flat > np.median(flat[1:])
    bits[0] = False
    assert media.cosine_hash(px) == np.packbits(bits).tobytes().hex()


def test_hashes_of_short_texts_differ():
    hashes = {media.cosine_hash(np.frombuffer(media.payload(t), np.uint8).reshape(-1, media.WIDTH)) for t in ("a", "hello world", "some other short text", "b")}
    assert len(hashes) >= 3


# the pipeline


def _mix_brute(rows):
    """(row, words taken) of the mix of (doc_id, text, source) rows: targets by water-filling, then whole and fractional repetitions."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        left = mixing.SHARE * sum(total.values()) - sum(2.0 * total[s] for s in full)
        level = left / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and weight[s] * level > 2.0 * total[s]}
        if not more:
            break
        full |= more
    target = {s: min(weight[s] * level, 2.0 * total[s]) for s in sources}
    out = []
    for s in sources:
        if not total[s]:
            continue
        own = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r[0]}:{r[1] or ''}".encode()).hexdigest())
        whole = int(target[s] // total[s])
        rest = round(target[s] - whole * total[s])
        for i, t, _ in own:
            part = max(0, min(size(t), rest))
            rest -= size(t)
            words = (t or "").encode().split()
            out += [(i, t)] * (whole if words else 0)
            if part and part == len(words):
                out.append((i, t))
            elif part:
                out.append((i, b" ".join(words[:part]).decode()))
    return out


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    model = toxicity.train(docs, labels)
    tagger = toxicity.Tagger(model)
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    a, b = model.line
    score = lambda t: 1 / (1 + np.exp(-(a + b * np.log(tagger.run([t or ""])[0].sum() + 1e-3))))
    rows = [r for r in rows if score(r[1]) < 0.5]
    rows = [rows[i] for i in _kept_brute([t or "" for _, t, _ in rows])]
    h = lambda t: hashing.word_hashes([(t or "").encode().lower()])[0]
    items = [h(t) for t in bench if (t or "").split()]

    def leaks(text):
        doc = h(text)
        for item in items:
            # only words of seeds that both have can be tiled; brute force on what is left of long texts
            if set(hashing.run_hashes(item, min(5, len(item))).tolist()) & set(hashing.run_hashes(doc, min(5, len(item))).tolist()):
                if sum(x[2] for x in decontam.tiles(doc, item)) >= 0.8 * len(item):
                    return True
        return False

    rows = [r for r in rows if not leaks(r[1])]
    enc = PieceEncoder(tokenizer_path()).tok
    want = collections.Counter()
    for i, t in _mix_brute(rows):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, d).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_fingerprints_and_their_tables_stay_off_one_machine(spark):
    """No text waits in the JVM for its fingerprint, and the tables of the fingerprints, many times their files, are not broadcast."""
    docs = spark.createDataFrame([(i, None if i == 3 else f"a b c{i} d e") for i in range(40)], "doc_id long, text string")
    made = simhash.with_fingerprint(docs)
    assert made.columns == ["doc_id", "fp"]
    assert {r["doc_id"]: r["fp"] for r in made.collect()} == {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(made)
    joined = plan(simhash.links(made.select("fp").distinct()))
    assert "SortMergeJoin" in joined and "BroadcastHashJoin" not in joined
