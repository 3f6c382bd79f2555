"""The operators of lexiloom.llm against plain Python on small tables, with nulls, empties, ties, repeats and odd names."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lexiloom.llm import bilstm, crf_quality, exact_dedup, mixing, ngram_join, packing, pii, quality_rules, sharding, shingles, token_counts, tokenizer, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(6000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "a"),
    (2, "the quick  brown fox\tjumps over the lazy dog and runs far away from here", "a"),
    (3, None, "b"),
    (4, "", "b"),
    (5, " \n\t ", None),
    (6, "One", "c"),
    (7, "a line\na line\nother line\n\na line", "c"),
    (8, LONG, "c"),
    (9, "spam spam spam spam spam spam spam spam spam spam spam spam", "a"),
    (10, "I'll say 'tis <|endoftext|> — naïve façade 漢字 \u0378 1,234.5", "a"),
    (11, LONG + " tail", None),
    (12, "### $$$ what %% is <this> & that | ok", "b"),
]


def frame(spark, rows=TEXTS, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names clash with those that operators return or use inside."""
    from pyspark.sql import functions as F

    return frame(spark).withColumns({"kept": F.lit("x"), "row": F.lit(1), "h": F.lit(2), "shard": F.lit(None).cast("string"), "__words": F.lit(3), "group_size": F.lit("y")})


def empty(spark):
    return frame(spark, [])


# --- URL filter


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://x.net/", "x.net", "/", "net/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("https://my-example.com/de/", "my-example.com", "/de/", None, "allow"),
        ("https://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
        ("ftp://b.org/fr/?casino", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://x.de/casino", "x.de", "/casino", None, "block"),
        ("http://x.de/casinos", "x.de", "/casinos", None, "allow"),
        ("http://x.de/bet-bet", "x.de", "/bet-bet", None, "allow"),
        ("http://x.de/bet/poker", "x.de", "/bet/poker", None, "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://É.de?a://b/c", "É.de", "", None, "allow"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    r = url_filter.url_filter(spark.createDataFrame([(1, url, 5)], "page_id long, url string, host int")).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/"), (2, "http://x.de/"), (2, "http://x.de/"), (None, None)], "page_id long, url string")
    assert sorted(r[0] or 0 for r in url_filter.allowed_pages(pages).collect()) == [0, 2, 2]
    assert url_filter.url_filter(pages.limit(0)).count() == 0


# --- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer.default_path())


def test_ids_are_the_librarys(library):
    bpe = tokenizer.byte_bpe(tokenizer.default_path())
    odd = ["", " ", "\n\n x", "a  b", "don't WE'LL 's", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "\u0378a", "é\u00a0b\x85c\x1c d", "😀 ½² ٣", LONG]
    odd += ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}'s" for c in range(lo, lo + 97) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 977)]
    for text in odd:
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.ids(text).tolist() == want
        assert sum(bpe.n_pieces(p) for part, _ in bpe.parts(text) for p in bpe.pre_tokens(part)) + sum(s is not None for _, s in bpe.parts(text)) == len(want)


def test_token_counts(spark, docs, library):
    rows = token_counts.token_counts(docs.union(docs.where("doc_id = 1")), limit=10, buckets=3).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in [*TEXTS, TEXTS[0]]]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 10) for r in rows)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_packing(spark, docs, library):
    rows = packing.pack(docs.union(docs.where("doc_id = 8")), pieces_a_task=5).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, text, _ in TEXTS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert [p[0] for p in own] == list(range(len(own)))
        assert sum(p[2] for p in own) == len(ids) and (len(own) == 1 or all(p[2] == 2048 for p in own[1:]))
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own)
    assert packing.pack(empty(spark)).count() == 0


def test_sequences_round_trip(spark, library):
    d = frame(spark)
    placed = packing.pack(d)
    made = {r.sequence_id: r.ids for r in packing.sequences(d, placed).collect()}
    for r in placed.collect():
        ids = [*library.encode(dict((i, t) for i, t, _ in TEXTS)[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert made[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def test_packing_is_tight(spark):
    """Against the least number of sequences that the tokens could fill."""
    rng = np.random.default_rng(7)
    slim = spark.createDataFrame([(i, int(n), i) for i, n in enumerate(np.minimum(2048, rng.lognormal(5.5, 1, 4000).astype(int) + 1))], "doc_id long, length long, row long")
    got = packing.place(slim, 2048, 4096, 50_000).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert len(got) <= 1.01 * sum(r[1] for r in got) / 2048 + 2 and max(r[1] for r in got) <= 2048


def test_open_bins_are_bounded_and_best_fit():
    bins = packing.OpenBins(10, 3)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    rng = np.random.default_rng(1)
    for n in rng.integers(1, 11, 500):
        bins.put(int(n))
        assert bins.n_open <= 3 and bins.n_open == sum(map(len, bins.by_free))


# --- exact dedup and sharding


def test_exact_groups(spark, docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _ in TEXTS}
    for content_hash in (exact_dedup.md5_128, lambda c: __import__("pyspark").sql.functions.length(c)):  # the second collides
        rows = exact_dedup.exact_groups(docs, content_hash=content_hash).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            same = [i for i in norm if norm[i] == norm[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(same), len(same), r.doc_id == min(same), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())


def test_exact_dedup_rows(spark, docs):
    out = exact_dedup.exact_dedup(docs.union(docs.where("doc_id in (1, 8)")))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    nulls = frame(spark, [(None, "x", "a"), (None, "x", "a"), (None, "y", None), (3, "y", "b")])
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.exact_dedup(nulls).collect()) == [(0, "x"), (3, "y")]
    spaced = spark.createDataFrame([(2, "a  b", 1), (2, "a b", 2), (3, "a b", 3), (4, "c\t\nd", 4), (5, "", 5), (6, None, 6)], "doc_id long, text string, __norm int")
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(spaced).collect())
    assert got[0][0] == 2 and got[0][1:] in (("a  b", 1), ("a b", 2)) and got[1:] == [(4, "c\t\nd", 4), (5, "", 5)]
    assert [tuple(r) for r in exact_dedup.exact_dedup(spaced.where("doc_id = 6")).collect()] == [(6, None, 6)]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.exact_groups(empty(spark)).count() == 0


def test_sharding(spark, docs):
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 * 7 as int)) as text", "'s' as source")
    for d in (many, docs.union(docs.where("doc_id = 1"))):
        rows = sharding.shard(d).collect()
        assert len(rows) == d.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.place for r in own) == list(range(len(own))) for own in by.values())
    sizes = collections.Counter()
    for r in sharding.shard(many).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 and len(sizes) == 16
    assert sharding.shard(empty(spark)).count() == 0


def test_slot_map_is_stored(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id as doc_id", "repeat('x', cast(id % 89 * 5 as int)) as text")
    path = str(tmp_path / "map")
    first = {r.doc_id: (r.virtual_slot, r.shard, r.version) for r in sharding.shard(rows, map_path=path).collect()}
    again = {r.doc_id: (r.virtual_slot, r.shard, r.version) for r in sharding.shard(rows, map_path=path).collect()}
    assert first == again and {v for *_, v in first.values()} == {2}  # balanced already: no new version
    more = rows.union(spark.range(5000, 5400).selectExpr("id as doc_id", "repeat('y', 3000) as text"))
    grown = {r.doc_id: (r.virtual_slot, r.shard, r.version) for r in sharding.shard(more, map_path=path).collect()}
    maps = [sharding.load_map(spark, path, v)[1] for v in (1, 2, 3)]
    assert sharding.load_map(spark, path) == (3, maps[2]) and maps[0] == sharding.first_map(16) and sharding.load_map(spark, str(tmp_path / "none")) is None
    still = [s for s in range(sharding.SLOTS) if maps[1][s] == maps[2][s]]
    assert len(still) > sharding.SLOTS // 2 and all(grown[i][0] == s and grown[i][1] == maps[2][s] for i, (s, _, _) in first.items())


def test_sharding_figures(spark):
    rows = [(i, t) for i, t, _ in TEXTS] + [(7, "again")] * 300
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), slots=64).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert len({r.virtual_slot for r in got if r.doc_id == 7}) > 30  # repeats of a row fill many slots


def test_slot_maps():
    first = sharding.first_map(16)
    grown = sharding.add_shard(first, 16)
    assert all(a == b or b == 16 for a, b in zip(first, grown, strict=True))
    assert abs(grown.count(16) - 4096 / 17) < 17
    weight = [1000, *([1] * 99)]
    load = sharding.loads(sharding.rebalance(sharding.first_map(4, 100), weight, 4), weight, 4)
    assert sorted(load) == [33, 33, 33, 1000]


# --- mixing


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 100), ("c", 0)])
    # Weights in order: a 5, b 2, c 1, null 5. a stops at 30; of the other 180, b has 2 parts and null 5.
    assert got == {"a": 30.0, "c": 0.0, "b": pytest.approx(180 * 2 / 7), None: pytest.approx(180 * 5 / 7)}
    assert sum(got.values()) == pytest.approx(210) and all(got[s] <= 3 * n + 1e-9 for s, n in [("b", 100), ("a", 10), (None, 100), ("c", 0)])


def test_cube_draws_by_brute_force():
    """Means of many draws are the fractions, sums hold in every draw, landings stand against all ways and all exchanges."""
    rng = np.random.default_rng(21)
    p, size = rng.uniform(0.05, 0.95, 12), rng.integers(1, 60, 12).astype(float)
    draws = []
    for seed in range(4000):
        q = mixing.fly(p, size, np.random.default_rng(seed))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-4
        draws.append(q)
    assert np.abs(np.mean(draws, axis=0) - p).max() < 5 * 0.5 / np.sqrt(len(draws))
    for q in draws[:200]:
        left = np.flatnonzero((q > mixing.EDGE) & (q < 1 - mixing.EDGE))
        off = lambda x: abs(float((x - q) @ size))  # noqa: B023, E731
        ways = []
        for w in range(1 << len(left)):
            x = np.round(q)
            x[left] = [(w >> k) & 1 for k in range(len(left))]
            ways.append(off(x))
        got = mixing.land(q, size)
        assert set(got) <= {0.0, 1.0} and off(got) <= min(ways) + 1e-9
        for gone in np.flatnonzero(got == 1):
            for come in np.flatnonzero(got == 0):
                other = got.copy()
                other[gone], other[come] = 0, 1
                assert off(other) >= off(got) - 1e-6


def test_mixing(spark, docs):
    d = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * id % 113 as int)) as text", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end as source")
    a, b = (sorted(map(tuple, mixing.mix(d, block=200).drop("row").collect()), key=str) for _ in range(2))
    assert a == b
    taken, target = collections.Counter(), {}
    for _, source, size, source_size, t, copies, words in a:
        taken[source] += words
        target[source] = t
        assert words == copies * size <= 3 * size
    assert all(abs(taken[s] - t) <= 60 for s, t in target.items())
    # of the same blocks: how many documents a target's words take hangs on the draws
    assert mixing.mix_documents(d, block=200).count() == sum(x[5] for x in a)
    rows = mixing.mix(docs.union(docs.where("doc_id = 8"))).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.size == len(WORD.findall(dict((i, t) for i, t, _ in TEXTS)[r.doc_id] or "")) for r in rows)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_documents(docs).columns == docs.columns


def test_landing_is_near():
    """Two long documents are left by the flight; exchanges bring the words to within a few of what was wanted."""
    rng = np.random.default_rng(11)
    for _ in range(20):
        size = np.concatenate([rng.integers(1, 300, 200), [20_011, 9_013]]).astype(float)
        p = np.concatenate([rng.integers(0, 2, 200), [0.4, 0.7]]).astype(float)
        out = mixing.land(p, size)
        assert set(out) <= {0.0, 1.0} and abs((out * size).sum() - (p * size).sum()) < 300
    few = mixing.land(np.array([0.5, 0.5]), np.array([10.0, 10.0]))
    assert few.sum() == 1


def test_repeated_rows_fill_blocks(spark):
    d = spark.createDataFrame([(1, "one two three", "a")] * 900 + [(2 + i, "w " * (i % 50 + 1), "b") for i in range(300)], "doc_id long, text string, source string")
    sized = mixing.spread(mixing.sizes(d, "doc_id", "text", "source", __import__("pyspark").sql.functions.monotonically_increasing_id()))
    assert sized.count() == 1200 == sized.select("row").distinct().count()


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 500, 300).astype(float)
    p = mixing.fly(np.full(300, 0.37), size, rng)
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
    assert p.sum() == pytest.approx(0.37 * 300) and (p * size).sum() == pytest.approx(0.37 * size.sum())


# --- quality rules


def figures(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    rows = quality_rules.quality_rules(docs).collect()
    text = {i: t for i, t, _ in TEXTS}
    assert len(rows) == len(TEXTS)
    for r in rows:
        n, chars, symbols, lines, repeats = want = figures(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and (not r.base_failed or not r.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_frequent_lines(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows = [(i, "Shared   line of ten words that many documents of host hold\n" + (own(i) if i % 2 else "tail"), "h") for i in range(60)]
    rows += [(100 + i, "copied text that stands in many rows but is one single document only", "h") for i in range(60)]
    rows += [(200, "shared line of ten words that many documents of host hold", "other")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), limits=quality_rules.Limits(0.1, 20)).collect()}
    assert all(got[i].kept == bool(i % 2) and got[i].lost_words == 11 for i in range(60))
    assert all(got[100 + i].kept for i in range(60)) and got[200].kept
    kept = quality_rules.quality_filter(frame(spark, rows), limits=quality_rules.Limits(0.1, 20))
    assert kept.count() == 91 and kept.columns == ["doc_id", "text", "source"]


def test_documents_that_are_mostly_shared_lines_are_rejected(spark):
    """The verdict of the method alone, by brute force: base rules pass, and it hangs on the share of words that are left."""
    line = "please subscribe to our weekly newsletter and never miss a story again"  # 12 words, in 31 of 131 texts
    rows = [(i, line + "\n" + " ".join(f"own{i}x{k}" for k in range(i)), "h") for i in range(31)] + [(100 + i, " ".join(f"only{i}x{k}" for k in range(20)), "h") for i in range(100)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    rejected = {i for i in got if not got[i].kept}
    assert rejected == {i for i in range(31) if i < 0.5 * (i + 12)} and not any(r.base_failed for r in got.values()) and 5 < len(rejected) < 31
    assert {r.doc_id for r in quality_rules.quality_filter(frame(spark, rows)).collect()} == got.keys() - rejected


def test_lines_are_removed(spark):
    """The filter's texts, by brute force over hosts, lines and distinct texts."""
    rng = np.random.default_rng(3)
    common = ["Subscribe to  our newsletter", "all rights reserved by the owners of this very site and its partners", "subscribe TO our newsletter "]
    rows = []
    for i in range(240):
        own = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 11)) for _ in range(int(rng.integers(0, 4)))]
        lines = own + [common[int(k)] for k in rng.integers(0, 3, int(rng.integers(0, 3)))] + ([""] if i % 5 == 0 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) if i % 40 else None, "abc"[i % 3] if i % 7 else None))
    rows += [(500 + i, rows[1][1], rows[1][2]) for i in range(30)]
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    for limits in (quality_rules.Limits(), quality_rules.Limits(max_share=0.9, min_docs=3, max_docs=12)):
        hosts, held = collections.defaultdict(set), collections.defaultdict(set)
        for _, t, h in rows:
            hosts[h].add(t or "")
            for x in (t or "").split("\n"):
                if WORD.search(x):
                    held[h, norm(x)].add(t)
        above = {k for k, d in held.items() if len(d) > limits.min_docs and (len(d) > limits.max_share * len(hosts[k[0]]) or len(d) > limits.max_docs)}
        want = {}
        for i, t, h in rows:
            n, *_, repeats = figures(t)
            left = [x for x in (t or "").split("\n") if (h, norm(x)) not in above]
            lost = n - sum(len(WORD.findall(x)) for x in left)
            if n >= 10 and 100 * repeats <= 20 * n and not n - lost < limits.min_left * n:
                want[i] = "\n".join(left)
        for near_lines in (0, quality_rules.NEAR_LINES):  # by a join of verdicts, and where rows lie
            got = {r.doc_id: r.text for r in quality_rules.quality_filter(frame(spark, rows), limits=limits, near_lines=near_lines).collect()}
            assert above and got == want
        assert any(t != dict((i, t) for i, t, _ in rows)[k] for k, t in got.items())


# --- n-gram join


def brute(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def varied(seed, n, copies):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(1, 160)))]
        for _ in range(int(rng.integers(1, copies))):
            own = list(w)
            for _ in range(int(rng.integers(0, 1 + len(w) // 25))):
                own[int(rng.integers(len(own)))] = f"n{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own).replace("v1", "V1") if rng.random() < 0.3 else " ".join(own)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_join_is_exact(spark, k, percent):
    rows = varied(k, 60, 9) + [(10_000 + i, " ".join([*(f"c{x}" for x in range(40)), f"z{i % 7}", *(f"d{i}x{x}" for x in range(i % 12))])) for i in range(60)]
    rows += [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "ONE"), (20_004, LONG), (20_005, LONG + " tail")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


def test_join_edges(spark, docs):
    rows = ngram_join.components(docs.union(docs.where("doc_id = 1")), shingle=3, percent=90).collect()
    assert len(rows) == len(TEXTS) + 1 and {r.doc_id: r.component_id for r in rows}[2] == 1
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    null = ngram_join.components(frame(spark, [(None, "a b c d", "x"), (1, "a b c d", "x")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in null if r.doc_id) == [(1, 1)] and [r.component_id for r in null if r.doc_id is None] == [None]
    assert ngram_join.components(empty(spark)).count() == 0
    out = ngram_join.near_dedup(docs)
    assert out.columns == docs.columns and 2 not in {r.doc_id for r in out.collect()}


def test_segments_keep_the_promise():
    """Sets at the limit share a list under the scheme, whatever shingles they differ in."""
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        scheme = ngram_join.Scheme(percent)
        for _ in range(150):
            n = int(rng.integers(3, 300))
            whole = np.unique(rng.integers(0, 2**64, 2 * n + 9, dtype=np.uint64))
            rng.shuffle(whole)
            a = set(whole[:n].tolist())
            out = int(rng.integers(0, n // 5 + 1))
            b = set(list(a)[out:]) | set(whole[n : n + int(rng.integers(0, n // 6 + 1))].tolist())
            if 100 * len(a & b) < percent * len(a | b) or a == b:
                continue
            sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
            got = ngram_join.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate(sets), scheme)
            assert set(got["sig"][got["place"] == 0].tolist()) & set(got["sig"][got["place"] == 1].tolist())


def test_crowded_segments_keep_the_promise():
    """8 and 10 hashes, the one set inside the other (Jaccard 0.8), all in the first segment of every band."""
    larger = np.arange(1, 11, dtype=np.uint64)
    for smaller in (larger[:8], larger[2:]):
        got = ngram_join.signatures(np.array([0, 10, 18]), np.concatenate([larger, smaller]), ngram_join.Scheme(80))
        assert set(got["sig"][got["place"] == 0]) & set(got["sig"][got["place"] == 1])


def test_word_hashes_follow_words():
    texts = [b"The  cat\tsat", b"the CAT sat", b"", b"\xc3\x89t\xc3\xa9", b"\xc3\xa9t\xc3\xa9"]
    got = [w.tolist() for w in shingles.words_by_document(texts)]
    assert got[0] == got[1] and got[2] == [] and got[3] != got[4]
    shingles_part, whole = shingles.PART, shingles.words_by_document([LONG.encode()])[0]
    try:
        shingles.PART = 1000
        assert (shingles.words_by_document([LONG.encode()])[0] == whole).all()
    finally:
        shingles.PART = shingles_part


# --- quality classifier and personal data


def plain_figures(line, earlier):
    words = WORD.findall(line)
    n, c = max(len(words), 1), max(len(line), 1)
    letters = sum(ch.isascii() and ch.isalpha() or ord(ch) >= 0xC0 for ch in line)
    some = lambda marks: sum(ch in marks for ch in line)
    return [
        np.log1p(len(line)), np.log1p(len(words)), sum("A" <= ch <= "Z" for ch in line) / max(letters, 1), some("0123456789") / c, some("#*$%&<>@^~=+\\{}[]_") / n, some("|") / n, some("!?") / n,
        some(".,;:") / n, sum(v == w for v, w in zip(words, words[1:], strict=False)) / n, 1 - len(set(words)) / n, len(line) / n, sum(ord(ch) > 127 for ch in line) / c, letters / c, float(line in earlier), float(len(words) < 8),
    ]


def plain_score(field, text):
    """A text's score from all labelings of its lines, one by one."""
    import itertools

    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")] or [""]
    x = [(np.array(plain_figures(line, lines[:i])) - field.mean) / field.scale for i, line in enumerate(lines)]
    none = np.zeros(crf_quality.N_FIGURES)
    e = []
    for i in range(len(x)):
        before, after = x[i - 1] if i else none, x[i + 1] if i + 1 < len(x) else none
        e.append(float(np.concatenate([x[i], before, after, [i == 0, i + 1 == len(x), 1]]) @ field.weights))
    weight = {y: np.exp(sum(v for v, good in zip(e, y, strict=True) if good) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=len(e))}
    long = [max(len(line), 1) for line in lines]
    good = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(len(e))]
    return sum(g * n for g, n in zip(good, long, strict=True)) / sum(long)


def test_quality_scores_by_brute_force():
    rng = np.random.default_rng(12)
    texts = ["", " \n\t\n", "one", "A line.\nA line.\nother | line!!\n\nA line.", "é ü 中文 字\nÀ la carte, 12 12 12 %\n<b> #tag = {x}", "buy buy buy NOW\n" * 7, "the quick brown fox jumps over the lazy dog today\n 3.14 \nend", "a\tb\vc\fd\re\nx"]
    field = crf_quality.Field(rng.normal(0.5, 0.2, 15), rng.uniform(0.5, 2, 15), rng.normal(0, 0.4, 48), rng.normal(0, 1, (2, 2)))
    want = [plain_score(field, t) for t in texts]
    np.testing.assert_allclose(field.score([t.encode() for t in texts]), want, atol=1e-9)
    for t, w in zip(texts, want, strict=True):
        assert abs(field.score([t.encode()])[0] - w) < 1e-9


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(4)
    e, moves, bounds = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, pairs, _ = crf_quality.marginals(e, bounds, moves)
    want, wanted_pairs = np.zeros(7), np.zeros((2, 2))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        total, part, pp = 0.0, np.zeros(hi - lo), np.zeros((2, 2))
        for code in range(1 << (hi - lo)):
            y = [(code >> i) & 1 for i in range(hi - lo)]
            w = np.exp(sum(e[lo + i] for i, v in enumerate(y) if v) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            part += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pp[a, b] += w
        want[lo:hi] = part / total
        wanted_pairs += pp / total
    assert np.allclose(good, want) and np.allclose(pairs, wanted_pairs)


def test_quality_classifier(spark):
    rng = np.random.default_rng(5)
    words = ["river", "stone", "light", "Garden", "quiet", "window", "letter", "bread", "morning", "of", "and", "the"]
    line = lambda: " ".join(rng.choice(words, 14)) + "."
    bad = lambda: " ".join(f"{w}{c}" for w, c in zip(rng.choice(words, 12), rng.choice(["###", "$$$", "%%%"], 12), strict=True))
    rows = [(i, "\n".join((line if i % 2 else bad)() for _ in range(int(rng.integers(1, 6)))), i % 2) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "\n \n"), (1002, LONG)], "doc_id long, text string")
    y = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = crf_quality.scored(d, y, max_train=200).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held) > 0
    assert {r.score for r in crf_quality.scored(d, y.limit(0)).collect()} == {0.5}
    assert crf_quality.scored(d.limit(0), y).count() == 0


def test_training_takes_one_row_an_id(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(40)] + [(k, t) for k in range(40) for t in ("one copy more", f"text {k}")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(40)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(crf_quality, "fit", lambda bounds, x, y: taken.append((bounds[1:], y.tolist())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [r[0] for r in spark.range(40).where(~crf_quality.held_out("id")).collect()]
    crf_quality.train(docs, labels)
    crf_quality.train(docs, labels, 10)
    crf_quality.train(docs, labels, 10, max_lines=7)  # every text is one line
    assert taken[0][1] == [i % 2 for i in sorted(ids)] and len(taken[1][0]) == 10 and len(taken[2][0]) == 7


def test_gradient_is_the_slope():
    rng = np.random.default_rng(6)
    x, y = rng.integers(32, 127, (3, 12)), np.zeros((3, 12), np.int64)
    y[0, 2], y[0, 3:6], y[1, 0] = 1, 2, 3
    tagger = bilstm.train(x, y, hidden=3, steps=1)
    for p in tagger.params:
        tagger.params[p] = tagger.params[p].astype(np.float64)
    _, grad = tagger.gradient(x, y)
    for name in ("wf", "ub", "v", "c", "m"):
        flat = tagger.params[name].reshape(-1)
        k = int(np.argmax(np.abs(grad[name].reshape(-1))))
        kept, step = flat[k], 1e-2
        flat[k] = kept + step
        up, _ = tagger.gradient(x, y)
        flat[k] = kept - step
        down, _ = tagger.gradient(x, y)
        flat[k] = kept
        assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-3)


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_tagger_finds_held_out_spans(tagger):
    samples = pii.labelled_samples(150, 77)
    hit = wrong = missed = 0
    for (_, gold), (_, found) in zip(samples, pii.tag([t for t, _ in samples], tagger), strict=True):
        hit += len(set(gold) & set(found))
        wrong += len(set(found) - set(gold))
        missed += len(set(gold) - set(found))
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9


WRITTEN = {  # lines by hand, and what the base patterns miss in them
    "Write to maria dot lopez at hospital dot org before noon.": [("maria dot lopez at hospital dot org", "email")],
    "Reach us: support [at] widgets [dot] com or call (212) 555-0187 today.": [("support [at] widgets [dot] com", "email"), ("(212) 555-0187", "phone")],
    "The server 192[.]168[.]10[.]4 answers; see john_smith(at)mailbox.net": [("192[.]168[.]10[.]4", "ip"), ("john_smith(at)mailbox.net", "email")],
    "Pay with 4111.1111.1111.1111 please": [("4111.1111.1111.1111", "card")],
    "call 415-555-2671 now, or 030.123.4567": [("415-555-2671", "phone"), ("030.123.4567", "phone")],
    "we met at home. dot it down at once, at noon or at 10:30 on 2024-01-02": [],
    "Look at the dot com boom, a dot on the map; version 2.0.1 came at 9.30.": [],
}


def test_tagger_adds_what_the_patterns_miss(tagger):
    for (text, wanted), (base, found) in zip(WRITTEN.items(), pii.tag(list(WRITTEN), tagger), strict=True):
        assert [(text[a:b], k) for a, b, k in found if (a, b, k) not in base] == wanted, text


def plain_tags(text, tagger):
    """All spans by one window at a time, every path kept by a table, every pair of spans compared."""
    start, move = bilstm.allowed()
    move = move + tagger.params["m"]
    found = {}
    a = 0
    while text:
        piece = text[a : a + pii.WINDOW]
        x = np.array([[ord(c) if ord(c) < 128 else bilstm.LETTER if c.isalpha() else bilstm.OTHER for c in piece]])
        both = np.concatenate([tagger.states(x, "f")[0], tagger.states(x, "b")[0]], axis=2)[0]
        e = both @ tagger.params["v"] + tagger.params["c"]
        score, came = [list(e[0] + start)], []
        for t in range(1, len(piece)):
            came.append([max(range(bilstm.N_LABELS), key=lambda i: (score[-1][i] + move[i, j], -i)) for j in range(bilstm.N_LABELS)])
            score.append([score[-1][i] + move[i, j] + e[t, j] for j, i in enumerate(came[-1])])
        y = [max(range(bilstm.N_LABELS), key=lambda i: (score[-1][i], -i))]
        for back in reversed(came):
            y.append(back[y[-1]])
        y = y[::-1]
        for s in [i for i, label in enumerate(y) if label % 2 == 1]:
            e_ = s + 1
            while e_ < len(y) and y[e_] and y[e_] % 2 == 0:
                e_ += 1
            far = min(s if a else pii.WINDOW, pii.WINDOW - e_ if a + pii.WINDOW < len(text) else pii.WINDOW)
            span = (a + s, a + e_, pii.KINDS[(y[s] - 1) // 2])
            found[span] = max(far, found.get(span, 0))
        if a + pii.WINDOW >= len(text):
            break
        a += pii.STRIDE
    out = pii.base_spans(text)
    for (a, b, kind), _ in sorted(found.items(), key=lambda f: (-f[1], f[0])):
        inside = (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
        if not inside and all(b <= p or q <= a for p, q, _ in out) and pii.valid(kind, text[a:b]):
            out.append((a, b, kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_tags_by_brute_force(tagger):
    samples = [t for t, _ in pii.labelled_samples(60, 91)]
    texts = ["", "x", *WRITTEN, *samples[:10], "\n".join(samples[10:24]), "é中\ud800 ".join(samples[24:40]), "q " * 225 + "anna at firma dot de " + "r " * 300, "+1 " * 500, "".join(samples[40:60])]
    got = [spans for _, spans in pii.tag(texts, tagger)]
    assert got == [plain_tags(t, tagger) for t in texts]
    assert [spans for t in texts for _, spans in pii.tag([t], tagger)] == got  # whatever else is in the block
    assert sum(len(set(g) - set(pii.base_spans(t))) for t, g in zip(texts, got, strict=True)) > 20


def test_pii_digest(spark, tagger):
    texts = {1: "mail a.b+c@x-y.example.com, now 10.0.300.1 or 10.0.0.1 and 4111 1111-1111 1111 é +1 (886) 555-7964.", 2: None, 3: "", 4: "1234567890123 none @ here", 5: ("x" * 300) + " 10.0.0.2 " + ("y" * 500) + " +49 30 1234567"}
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tagger=tagger)).collect()}
    for i, t in texts.items():
        base = pii.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(got[i].spans.split(","))
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and got[3].spans == "" and got[4].n_card == 0
    out = pii.redact(spark.createDataFrame([(1, texts[1]), (2, None)], "doc_id long, text string"), tagger=tagger).collect()
    assert "<email>" in out[0].text and "@" not in out[0].text and out[1].text is None
    assert pii.find_pii(empty(spark), tagger=tagger).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    """Base spans by the patterns as they are stated."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_follow_the_patterns():
    rng = np.random.default_rng(12)
    parts = ["a", "Z9", ".", "@", "@@", "-", "+", "+1", "1.2.3.4", "300.1.1.1", "12", "4111 1111 1111 1111", " ", "(", ")", "x@y.z", "a.b@c", "%", "é", "0.0.0.0.0", "5500-0000-0000-0004", "..", "_"]
    for _ in range(3000):
        t = "".join(parts[int(k)] for k in rng.integers(0, len(parts), int(rng.integers(1, 14))))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time(spark):
    """A megabyte of one kind of character: patterns that look again from each character would take hours."""
    import time

    n = 1 << 20
    runs = ["x" + " " * n + "y", "x" * n, "7" * n, "x@ " + "a" * n, "@" * n, "1." * (n // 2), "<|endoftext|>" * (n // 13), "+" * n, "\n" * n, "a@" * (n // 2)]
    began = time.time()
    for t in runs:
        pii.base_spans(t)
    d = frame(spark, [(i, t, "h") for i, t in enumerate(runs)]).repartition(4)
    assert mixing.mix(d).count() == len(runs)
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(d).collect()} == {i: len(WORD.findall(t)) for i, t in enumerate(runs)}
    assert quality_rules.quality_filter(d).count() == 0
    bpe = tokenizer.byte_bpe(tokenizer.default_path())
    assert bpe.parts(runs[6]) == [("", bpe.special["<|endoftext|>"])] * (n // 13) + [("", None)]
    assert time.time() - began < 240


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        w = [f"p{x}" for x in rng.integers(0, 5000, 60)]
        rows.append((len(rows), " ".join(w), "en", f"s{i % 3}", 0))
        if i % 4 == 0:
            rows.append((len(rows), "  ".join(w), "en", "s9", 0))
            rows.append((len(rows), " ".join([*w, "extra"]), None, None, None))
    rows += [(900, None, None, None, None), (901, "too short", "en", "s1", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = d, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns
        docs.write.parquet(f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(docs.count())
    assert kept[:3] == [60, 50, 40]
    assert corpus_pipeline.run(spark, str(tmp_path)).groupBy("sequence_id").count().count() >= 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
