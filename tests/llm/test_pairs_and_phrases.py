"""Collocations, near vectors and token alignment against plain Python, with nulls, empties, ties, repeats and odd names."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import alignment, near_vectors, phrases
from lexiloom.llm.tokenizer import byte_alphabet

# --- Phrases


def collocations_by_hand(rows, least, inside=80, top=2000):
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            if words:
                sizes[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    longer = collections.Counter()
    for (lang, w), n in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], n)
    by_lang = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        score, _, left, right = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * longer[lang, w] < inside * a:
            by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


PHRASE_ROWS = [
    ("en", "New York is New York, new york city. In New York City it rains"),
    ("en", "new\tyork  city; the new york city marathon! the new york city marathon"),
    ("en", None),
    ("en", ""),
    (None, "a b a b a b a b\na b a b"),
    ("und", "b a b a"),
    ("fr", "Ça va ça va ça va, été. ÇA VA Ça va"),
    ("fr", "une_phrase sans fin " * 3000),
    ("de", ". , ; : ! ? \n\r\x0b\x0c"),
]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (3, 2000), (2, 3)])
def test_collocations_equal_brute_force(spark, least, top):
    df = spark.createDataFrame(PHRASE_ROWS, "lang string, text string").repartition(3).withColumns({"n": F.lit("x"), "block": F.lit(1), "words": F.lit(2), "doc_id": F.lit(None).cast("long")})
    got = {tuple(r) for r in phrases.collocations(df, least=least, top=top).collect()}
    assert got == collocations_by_hand(PHRASE_ROWS, least, top=top)
    assert any(x[0] == "und" for x in got)


def test_scores_pass_64_bits(spark):
    got = spark.range(1).select(F.lit(9 * 10**15).alias("a"), F.lit(9 * 10**15).alias("l"), F.lit(10**16).alias("r")).select(F.expr(phrases.SCORE)).first()[0]
    assert got == 2000000 * 9 * 10**15 // (9 * 10**15 + 10**16)


def test_collocations_of_several_blocks(spark, monkeypatch):
    """Lists of many small blocks give what one block gives."""
    rows = [("en", f"the big red fox w{i % 7} ran over the big red dog w{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(16)
    assert {tuple(r) for r in phrases.collocations(df, least=20).collect()} == collocations_by_hand(rows, 20)


def test_collocations_without_words(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " ")], none.schema)).count() == 0


# --- Near vectors


def vectors_by_hand(rows, least=0.95):
    good = [(i, np.array(v, dtype=np.float64)) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = collections.defaultdict(set)
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                near[a].add(b)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(near[i]), low, vec_id == low))
    return sorted(out, key=str)


def planted(seed=3, dim=64, n=600):
    """Vectors at random, chains and clusters of near ones, copies, scaled copies, and what is no vector."""
    rng = np.random.default_rng(seed)
    out = list(rng.normal(size=(n, dim)))
    for _ in range(20):
        base = rng.normal(size=dim)
        out += [base + rng.normal(size=dim) * s for s in rng.uniform(0.02, 0.25, 12)]
    out += [out[0], out[0] * 3.5, out[5], -out[5]]
    step = rng.normal(size=dim)
    walk = rng.normal(size=dim) * 2
    for _ in range(15):  # each is near the next, the ends are not
        out.append(walk)
        walk = walk + step * 0.55
    rows = [(int(i) + 1, [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(len(out)), out, strict=True)]
    nan, inf = float("nan"), float("inf")
    rows += [(9001, None), (9002, []), (9003, [0.0] * dim), (9004, [nan] + [1.0] * (dim - 1)), (9005, [inf] + [1.0] * (dim - 1)), (9006, [None, *[1.0] * (dim - 1)])]
    rows += [(9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (9009, [1.0]), (9010, [-3.0]), (None, rows[3][1]), (None, [7.0]), (rows[4][0], rows[4][1]), (9011, [1e30, 1e-30, 5.0]), (9012, [1e30, 0.0, 4.0])]
    return rows


@pytest.mark.parametrize(("block", "names"), [(4096, None), (20, None), (4096, 1)])
def test_near_vectors_equal_brute_force(spark, block, names):
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumns({"n": F.lit("x"), "class": F.lit(1), "bucket": F.lit(2), "v": F.lit(3)})
    got = sorted(map(tuple, near_vectors.near_vectors(df, block=block, names=names).collect()), key=str)
    want = vectors_by_hand(rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert got == want


def test_near_vectors_in_a_large_group_count_each_pair_once(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    rows = [(i, [float(x) for x in base + rng.normal(size=32) * 0.05]) for i in range(700)] + [(1000 + i, [float(x) for x in base]) for i in range(50)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=100).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(749, 0)}
    assert [r.vec_id for r in got if r.kept] == [0]


@pytest.mark.parametrize("names", [2, 3, 4])
def test_recall_at_the_threshold(names):
    """Pairs that are exactly as near as asked, by tables and buckets: over 0.99 are found."""
    rng = np.random.default_rng(8)
    u = near_vectors.normalised(rng.normal(size=(2000, 64)))
    w = rng.normal(size=u.shape)
    w = near_vectors.normalised(w - (w * u).sum(1, keepdims=True) * u)
    shape = (names, *near_vectors.TABLES[names])
    x, y = near_vectors.codes(u, *shape), near_vectors.codes(0.95 * u + np.sqrt(1 - 0.95**2) * w, *shape)
    met = (x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)
    assert met.any(1).mean() > 0.99
    assert (near_vectors.codes(u[7:8], *shape) == x[7]).all()


def test_near_vectors_of_an_empty_table(spark):
    got = near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.count() == 0
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "boolean"]


# --- Alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_piece_path())


def aligned_by_hand(rows, libraries):
    tokenizer, pieces = libraries
    to_byte = {c: b for b, c in byte_alphabet().items()}
    out, df = [], collections.Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        e = tokenizer.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text or "")]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out.append((doc_id, 0, 0, 0, collections.Counter(), ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
        links = collections.Counter()
        for (i, x), p in zip(a, ends_a, strict=True):
            for (j, y), q in zip(b, ends_b, strict=True):
                if p - len(x) < q and q - len(y) < p:
                    links[i, j] += 1
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        names = [",".join(str(i) for (i, _), p in zip(side, ends, strict=True) if lo < p <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False) for side, ends in ((a, ends_a), (b, ends_b))]
        digest = ";".join(f"{x}|{y}" for x, y in zip(names[::2], names[1::2], strict=True))
        out.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(digest.encode()).hexdigest()))
        df.update(links.keys())
    best = {a: max(n for (x, _), n in df.items() if x == a) for a in {x for x, _ in df}}
    return sorted(((i, na, nb, ng, sum(links.values()), sum(m for p, m in links.items() if df[p] == best[p[0]]), sum(m * df[p] for p, m in links.items()), h) for i, na, nb, ng, links, h in out), key=str)


ALIGN_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, doesn't it?"),
    (2, "the quick brown fox  jumps\n\nover   the lazy dog \n "),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "naïve façade 漢字 🙂 ͸ 1,234.5 <|endoftext|> <s> </s> <0x41> <unk>"),
    (7, "a ▁ piece sign"),
    (8, "x▁y "),
    (9, "tab\tand\x0bother\xa0 white　 space \x1f end\x00"),
    (10, "the quick brown fox jumps over the lazy dog"),
    (10, "the quick brown fox jumps over the lazy dog"),
    (None, "\n \n \n  \n"),
    (12, "internationalisation " * 300 + "end"),
    (13, "x" * 3000),
]


@pytest.mark.parametrize(("buckets", "part"), [(4, 1 << 20), (1, 1 << 20), (7, 100)])
def test_alignment_equals_brute_force(spark, libraries, buckets, part):
    df = spark.createDataFrame(ALIGN_ROWS, "doc_id long, text string").repartition(3).withColumns({"row": F.lit("x"), "block": F.lit(1), "own": F.lit(2), "a": F.lit(3)})
    got = sorted(map(tuple, alignment.alignment(df, buckets=buckets, part_postings=part).collect()), key=str)
    assert got == aligned_by_hand(ALIGN_ROWS, libraries)


def test_units_are_tokenized_as_texts_are(libraries):
    """Cutting a text into units changes neither side's ids."""
    tokenizer, pieces = libraries
    for _, text in ALIGN_ROWS:
        if text and "▁" not in text:
            units = alignment.UNIT.findall(" " + text)
            assert "".join(units) == " " + text
            assert [i for u in units for i in tokenizer.encode(u, add_special_tokens=False).ids] == tokenizer.encode(" " + text, add_special_tokens=False).ids
            assert [i for u in units for i in pieces.encode(u[1:])] == pieces.encode(text)


def test_alignment_of_an_empty_table(spark):
    got = alignment.alignment(spark.createDataFrame([], "doc_id string, text string"))
    assert got.count() == 0
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
