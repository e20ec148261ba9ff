import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import html, jaccard, packing, quality, tokens, toxicity, warc
from quillstone.llm.common import shared_dir

WORDS = [f"w{i:03d}" for i in range(300)]


def sets_of(docs):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().decode().split()
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(docs):
    sets = sets_of(docs)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    line = " ".join(r.choice(WORDS) for _ in range(12))
    docs = []
    for size in (3, 5, 7, 12, 30, 90, 400):
        for _ in range(8):
            base = [r.choice(WORDS) for _ in range(size)]
            docs.append(base)
            for _ in range(4):
                near = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                    near[r.randrange(len(near))] = r.choice(WORDS)
                docs.append(near + [r.choice(WORDS)] * r.choice([0, 0, 1]))
    out = [(i, (line + "\n" if r.random() < 0.3 else "") + " ".join(x)) for i, x in enumerate(docs)]
    base = docs[-1]
    out += [(1000 + i, " ".join(base[: i % 40] + ["z"] + base[i % 40 + 1 :])) for i in range(60)]
    return out + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "A B C"), (2004, "a  b\nc"), (7, out[7][1]), (2005, out[3][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("c", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(docs) and jaccard.jaccard_components(df).count() == len(docs)
    kept = jaccard.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c) and kept.columns == df.columns


def test_join_keys_meet_for_every_linked_pair():
    """Random sets of all sizes with as many differences as a link allows share a key, whatever the order's ranks."""
    rng = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            d = len(x) // 5
            cut = rng.integers(0, d + 1)
            keep = rng.permutation(x)[: len(x) - cut]
            most = (len(keep) * 100) // 80 - len(x)
            add = rng.integers(0, 2**63, rng.integers(0, most + 1) if most > 0 else 0, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            y = np.unique(np.concatenate([keep, add]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            seen, often = np.unique(np.concatenate([x, y, rng.choice(x, len(x) // 3), np.unique(rng.choice(y, len(y) // 4))]), return_counts=True)
            keys = []
            for h in (x, y):
                n = often[np.searchsorted(seen, h)]
                keys.append(set(jaccard.keys_of(n[n > 1], h[n > 1], len(h)).tolist()))
            assert keys[0] & keys[1], size


def test_shingles_of_slices_and_long_texts_are_those_of_the_words(monkeypatch):
    import pyarrow as pa

    texts = ["", None, "A b", "one Two three four five six", " \n\t", "é a\x0bb c\x0cd É e f", "x" * 3000 + " a b c d e", "w " * 2000 + "z", *(t for _, t in corpus(1)[:80])]
    whole = [jaccard.Shingler()(x) for x in texts]
    assert [len(h) for h in whole] == [len(s) for s in sets_of(enumerate(texts)).values()]
    monkeypatch.setattr(jaccard, "SLICE", 256)
    small = jaccard.Shingler()
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, small.sets(pa.array(texts)), strict=True))
    assert all((a == small(x)).all() for a, x in zip(whole, texts, strict=True))


def test_all_links_equal_brute_force(spark):
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, classes = jaccard.similar_classes(df)
    sets = sets_of(docs)
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    got = {(r["doc_id"], r["class"]) for r in classes.collect()}
    assert got == {(d, first[x] if x else None) for d, x in sets.items()}
    reps = [(d, x) for x, d in first.items() if x]
    due = {(a, b) for a, x in reps for b, y in reps if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    found = pairs.collect()
    assert {(r["a"], r["b"]) for r in found} == due and len(found) == len(due) > 50


def test_components_of_chains_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in jaccard.components(edges, "t").collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = jaccard.jaccard_components(spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (1, 1)}


ODD = ["", None, "İstanbul ΣΑΣ", "e\u0301cole ÉCOLE", "<|endoftext|> x", "don't I'LL x's 12a3 ½²ª", "\xa0a\x85b\x1cc", "Ǆ ŉ ß \xad soft", "日本 語", "a_b--c!!", "word " * 9000, "\ud800" if False else "😀"]


def plain_ids(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_the_tokenizer():
    e = tokens.Encoder(tokens.tokenizer_path(), keep=3)
    for text in ODD + ODD[::-1]:
        assert e(text) == plain_ids(text, 0)[:-1].tobytes()


def test_coder_round_trips_and_checks(tmp_path):
    rng = np.random.default_rng(0)
    for ids in (np.zeros((1, 1)), np.full((3, 50), 2**20 - 2), rng.integers(0, 2**20 - 1, (7, 300)), rng.zipf(1.3, (4, 500)) % 49408):
        found, cumulated = tokens.alphabet_of(ids.astype(np.uint32))
        symbols = np.searchsorted(found, ids)
        assert (tokens.decode_blocks(tokens.encode_blocks(symbols, cumulated), ids.shape[1], cumulated) == symbols).all()
    with open(tmp_path / "x", "wb") as f:
        w = tokens.TokenWriter(f)
        docs = [(1, 5), (None, 0), (3, 7000), (4, 1)]
        for d, n in docs:
            w.add(d, rng.integers(0, 49408, n).astype("<u4").tobytes())
        w.close()
    parts = list(tokens.read_groups(open(tmp_path / "x", "rb")))
    assert parts[-1] == ("index", docs) and sum(len(x) for k, x in parts if k == "ids") == 7006
    data = bytearray((tmp_path / "x").read_bytes())
    data[300] ^= 1
    (tmp_path / "y").write_bytes(data)
    with pytest.raises(ValueError):
        list(tokens.read_groups(open(tmp_path / "y", "rb")))


def test_blocks_decode_alone():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, (5, 700)) % 3000).astype(np.uint32)
    found, cumulated = tokens.alphabet_of(ids)
    symbols = np.searchsorted(found, ids)
    coded = tokens.encode_blocks(symbols, cumulated)
    assert all((tokens.decode_blocks([x], 700, cumulated)[0] == row).all() for x, row in zip(coded, symbols, strict=True))


def test_the_coder_beats_order_0_and_zlib(tmp_path):
    """Bits an id over real ids, alphabets, checksums and index included."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    encode = tokens.Encoder(tokens.tokenizer_path())
    ids = np.frombuffer(b"".join(encode(x) + b"\2\0\0\0" for x in pq.read_table(path)["text"].to_pylist()), "<u4")
    with open(tmp_path / "x", "wb") as f:
        writer = tokens.TokenWriter(f)
        writer.add(1, ids.tobytes())
        writer.close()
    often = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * os.path.getsize(tmp_path / "x") / len(ids)
    assert bits < -(often * np.log2(often)).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_the_coder_is_cheap_and_learns_across_a_block():
    """Seconds an id as times of a plain loop's, both ways, and bits an id: 225,000 ids, a file of four of sf0.01."""
    import time

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    encode = tokens.Encoder(tokens.tokenizer_path())
    ids = np.frombuffer(b"".join(x + b"\2\0\0\0" for x in encode.each(pq.read_table(path, columns=["text"])["text"].combine_chunks()[:260])), "<u4")[:225_000]
    found, cumulated = tokens.alphabet_of(ids)
    symbols = np.searchsorted(found, ids)[None]

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    coded = []
    loop = min(seconds(lambda: sum(range(500_000))) for _ in range(5)) / 500_000
    took = min(seconds(lambda: coded.append(tokens.encode_blocks(symbols, cumulated))) for _ in range(2))
    took += min(seconds(lambda: tokens.decode_blocks(coded[0], len(ids), cumulated)) for _ in range(2))
    assert (tokens.decode_blocks(coded[0], len(ids), cumulated) == symbols).all()
    assert len(ids) == 225_000 and took / len(ids) < 150 * loop and 8 * len(coded[0][0]) / len(ids) < 7.3


def test_texts_encoded_together_equal_the_tokenizer():
    chars = [chr(k) for k in [*range(32, 127), *range(0xA1, 0x250)] if k != 0x130]
    words = [a + b + c for a in ("", "x", "Q'") for b in chars for c in ("", "s", "Ç.", "2@", "--")]
    texts = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)] + [*ODD, None, " lead", "trail \n", "a,b 'll x's,' ''s"]
    e = tokens.Encoder(tokens.tokenizer_path(), keep=300)
    want = [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for at in (0, 50, 0):
        assert e.each(pa.array(texts[at:])) == want[at:]
    assert e.each(pa.array([], pa.string())) == [] and e.each(pa.array([None, "a"], pa.large_string())) == [b"", plain_ids("a", 0)[:-1].tobytes()]


def test_token_files_round_trip(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "null id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("x"))
    folder = f"file://{tmp_path}/out"
    files = tokens.write_tokens(df, folder, tokens.tokenizer_path(), 2)
    got = tokens.read_tokens(files, folder, with_ids=True).orderBy("start").collect()
    want = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc"] for r in got] == [d for d, _ in want]
    at = 0
    by = collections.defaultdict(list)
    for d, t in docs:
        by[d].append(plain_ids(t, 2))
    for r in got:
        ids = np.array(r["ids"], "<u4")
        assert any((ids == x).all() for x in by[r["doc"]] if len(x) == len(ids)) and r["start"] == at and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += r["n_tokens"]
    empty = tokens.write_tokens(df.where("false"), folder + "2", tokens.tokenizer_path(), 2)
    assert tokens.read_tokens(empty, folder + "2").count() == 0


def test_pieces_are_whole_and_sequences_gapless(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again")] + [(100 + i, "word " * (i * 37 % 3000)) for i in range(80)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1)), tokens.tokenizer_path()).collect()
    want = collections.Counter()
    for d, t in docs:
        ids = plain_ids(t, 1)
        want.update((d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokens.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    r = random.Random(seed)
    h = collections.Counter(min(4096, int(r.lognormvariate(6.5, 1)) + 1) for _ in range(5000 * (seed + 1)))
    kinds, bound, programmed = packing.plan(dict(h))
    assert programmed >= 0.75 and bound <= sum(n for n, _ in kinds) <= 1.01 * bound + 1
    held = collections.Counter()
    for n, kind in kinds:
        assert sum(x * m for x, m in kind) <= 4096
        for x, m in kind:
            held[x] += n * m
    assert held == h
    assert sum(n for n, _ in kinds) <= -(-sum(x * n for x, n in h.items()) // 4096) * 1.01 + 1


@pytest.mark.parametrize("times", [1, 1000])
def test_program_places_all_but_the_stated_rest(times):
    r = random.Random(5)
    h = collections.Counter(min(4095, int(r.lognormvariate(6.5, 1)) + 1) for _ in range(3000))
    lengths = np.array(sorted(h))
    counts = np.array([h[x] * times for x in lengths.tolist()])
    left = counts.copy()
    found, value, bound = packing.solve(lengths, counts, 4096, packing.ROUNDS)
    assert bound <= value <= (1 + packing.GAP) * bound
    for chosen, n in found:
        for i, copies in chosen.items():
            left[i] -= copies * n
    assert (left >= 0).all() and (left * lengths).sum() <= packing.REST * (counts * lengths).sum()
    kinds = packing.plan({int(x): int(n) for x, n in zip(lengths, counts, strict=True)}).kinds
    assert sum(n for n, _ in kinds) <= -(-int((lengths * counts).sum()) // 4096) * 1.005 + 1


def test_the_bound_knows_pieces_over_half():
    """Pieces of which no two fit: the tokens ask for 60 sequences, the program for 100."""
    found, value, bound = packing.solve(np.array([3, 60]), np.array([5, 100]), 100, 50)
    kinds, least, _ = packing.plan({60: 100, 3: 5}, 100)
    assert 95 < bound <= value and least <= 100 == sum(n for n, _ in kinds)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_in_bulk_is_best_fit(seed):
    r = random.Random(seed)
    rest = {r.randrange(1, 60): r.randrange(1, 30) for _ in range(12)}
    free = []
    for x in sorted((x for x, n in rest.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 100) - x)
    kinds = packing.best_fit(rest, 100, {})
    assert sorted(f for kind, n in kinds.items() for f in [100 - sum(x * m for x, m in kind)] * n) == sorted(free)
    held = collections.Counter()
    for kind, n in kinds.items():
        for x, m in kind:
            held[x] += n * m
    assert held == rest


def test_hot_lengths_are_numbered_in_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 10)
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("length"))
    got = packing.numbered(df, ["doc_id"]).collect()
    assert sorted(r["_k"] for r in got) == list(range(200))


def pages(spark):
    long = "<p>" + "é" * 700_000 + "</p>"
    rows = [(1, "http://a/\r\nX: y", "x" * 999), (2, None, "x" * 999), (3, "u", "y" * 1000), (9, "u", "y" * 1000), (5, "u", "y" * 1000), (6, "é", long), (7, "", None), (8, "u", ""), (9, "u", "y" * 1000), (10, "u", "WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("chunk_no", F.lit(2)), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    folder = f"file://{shared_dir(spark).removeprefix('file://')}/warc-test"
    files = warc.write_archives(warc.chunk_rows(warc.plan_records(df), chunk=100_000), folder)
    got = warc.read_archives(files, folder, with_data=True).collect()
    whole = collections.defaultdict(bytes)
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        if r["page_id"] != 9:
            whole[r["page_id"]] += bytes(r["data"])
    assert whole[6].decode() == rows[5][2] and whole[10].decode() == rows[9][2] and whole[7] == whole[8] == b"" and max(len(r["data"]) for r in got) <= warc.CHUNK
    ends = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["is_last"]}
    assert ends[1] == ("response", None, 999) and ends[3] == ("revisit", 9, 1000) == ends[5] and ends[9] == ("response", None, 1000) and ends[6][2] == 1_400_007
    assert sum(r["is_last"] for r in got) == len(rows)
    empty = warc.write_archives(warc.chunk_rows(warc.plan_records(df.where("false"))), folder + "2")
    assert warc.read_archives(empty, folder + "2").count() == 0


def test_html_leaves_out_what_is_not_the_article():
    page = """<html><head><title>x</title></head><body class="home has-sidebar"><header><h1>Site</h1></header><div id="sidebar"><p>Side</p></div>
      <div class="content"><h2>T &amp; U</h2><p>First&nbsp; para
      with <b>bold</b> words, and a good many of them at that.<p>Two<ul><li>item one</ul><form><p>Mail<input></form><div class="cookie-notice"><p>We use cookies</div>
      <script>var a = "</p>";</script><p>Third</div><section id="comments"><h3>3 comments</h3><p>nice post</section><footer>c</footer>"""
    assert html.main_text(page) == "T & U\nFirst para with bold words, and a good many of them at that.\nTwo\nitem one\nThird"
    assert html.main_text("<nav>menu</nav><article><p>Hi.</p><aside>ad</aside></article><p>other</p>") == "Hi."
    assert [html.main_text(x) for x in (None, "", "<nav>x</nav>", "plain  text", "<p>a<script>b", "<!-- x", "<")] == ["", "", "", "plain text", "a", "", "<"]
    assert html.main_text("<p>" + "x" * 2_000_000 + "</p>") == "x" * 2_000_000


def test_html_windows_cut_what_nothing_marks():
    one = "The first paragraph of the story says at some length what has happened here."
    two = "The second one, which is longer than a window's threshold too, tells the rest of it."
    links = "".join(f'<li><a href="/{x}">{x} and more</a></li>' for x in ("Home", "News", "Sport", "Weather", "Travel"))
    want = f"Title\n{one}\nYes.\nNo.\n{two}"
    body = f"<h1>Title</h1><p>{one}</p><p>Yes.</p><ul><li>No.</li></ul><p>{two}</p>"
    # menus and footers of links or of plain short lines, in containers of their own, as siblings and as source lines
    assert html.main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div><div><p>Contact us</p><p>Copyright 2024 Example Inc. All rights reserved.</p></div></body>") == want
    assert html.main_text(f"<body>\n<div>\nHome<br>\nNews<br>\nAbout<br>\n</div>\n\n<div>\n{body}\n</div>\n\n<div>\nContact us today<br>\nImprint\n</div></body>") == want
    assert html.main_text(f"<div>Home</div><div>News</div><h1>Title</h1><p>{one}</p><p>Yes.</p><p>No.</p><p>{two}</p><div>Contact</div><div>Imprint</div>") == want
    assert html.main_text(f"<table><tr><td>Home</td><td>News</td></tr></table>{body}<table><tr><td>Imprint</td></tr></table>") == want
    assert html.main_text(f"<ul>{links}</ul><div>{body}</div><div>We use cookies on this site. <a href='/ok'>Accept</a></div>") == want
    # a notice and a link list between two parts of the text
    assert html.main_text(f"<div><h1>Title</h1><p>{one}</p><p>Yes.</p><div><div>Advertisement</div></div><ul>{links}</ul><p>No.</p><p>{two}</p></div>") == want
    # article and main support: an unmarked link list in them goes, short text stays; a teaser in article is not the page
    assert html.main_text(f"<article>{body}<p>End.</p><ul>{links}</ul></article><p>{one}</p>") == want + "\nEnd."
    assert html.main_text(f"<div>{body}</div><article>Next story</article>") == want + "\nNext story"
    # paragraphs broken into source lines stay whole, as do pages of short lines only
    assert html.main_text("<p>" + one.replace(" ", "\n") + f"</p><p>{two}</p>") == f"{one}\n{two}"
    assert html.main_text("<p>Roses are red<p>Violets are blue") == "Roses are red\nViolets are blue"
    assert html.main_text(f"<ul>{links}</ul>").count("\n") == 4


def brute_repeats(words):
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(win)
    return len({i + k for i, w in enumerate(win) if often[w] > 1 for k in range(5)})


def test_quality_statistics_equal_brute_force():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "b ", "c\n", " ", "é", "#$", "\t", "\x85", "a b a b a ", "\n"]) for _ in range(r.randrange(60)))
        words = [w for w in "".join(" " if c in quality.SPACE else c for c in text).split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(quality.SPACE)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(words))
        assert quality.statistics(text) == want


def labelled(spark, n=240):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 2
        text = " ".join(r.choice(WORDS) + ("!!" if bad else "") for _ in range(40))
        toxic = i % 3 == 0
        docs.append((i, text.upper() if bad else text + (" you idiot" if toxic else "")))
        labels.append((i, 1 - bad, int(toxic and not bad)))
    docs += [(n, None), (n + 1, ""), (n + 2, "word " * 50_000)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_learn_and_score_every_row(spark):
    docs, labels = labelled(spark)
    q = quality.with_quality(docs.withColumn("kept", F.lit("x")), quality.train(docs, labels))
    rows = {r["doc_id"]: r for r in q.collect()}
    right = sum(rows[r["doc_id"]]["kept"] == bool(r["quality"]) for r in labels.collect())
    assert right >= 0.97 * 240 and rows[240]["base_failed"] and rows[241]["n_words"] == 0 and rows[242]["base_failed"]
    t = toxicity.with_toxicity(docs.withColumn("score", F.lit("x")), toxicity.train(docs, labels))
    got = {r["doc_id"]: r for r in t.collect()}
    assert sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels.collect()) >= 0.97 * 240
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 243


def test_classifiers_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 10)
    none = labels.where("false")
    assert {r["predicted"] for r in toxicity.with_toxicity(docs, toxicity.train(docs, none)).collect()} == {0}
    assert quality.with_quality(docs, quality.train(docs, none)).where("kept").count() == 10
    assert quality.with_quality(docs.where("false"), quality.train(docs, none)).count() == 0


def test_held_out_accuracy(spark):
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    q = quality.op9_quality_rules(spark, d).join(labels, "doc_id").where("NOT base_failed").select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert q > 0.95
    t = toxicity.op4_toxicity(spark, d).join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert t > 0.9


@pytest.mark.parametrize("bad", ['<a title="x ', "<b ", "<svg>", "</svg <svg ", "<div></x>", "<p class='y\" ", "<!-- ", "<script "])
def test_broken_markup_takes_time_in_proportion(bad):
    import time

    took = []
    for size in (100_000, 800_000):
        began = time.process_time()
        html.main_text(bad * (size // len(bad)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def brute_spans(blocks):
    """The window rule in words: line by line, the sum over it and the next two; a surge opens a span, a dive closes it."""
    lines = []
    for k, b in enumerate(blocks):
        lines += [(0, None)] * b.gap + [(n, k) for n in b.sizes]
    kept, within = set(), False
    for i, (n, k) in enumerate(lines):
        window = sum(x for x, _ in lines[i : i + html.WINDOW])
        owner = next((j for _, j in lines[i::-1] if j is not None), None)
        low = owner is not None and blocks[owner].support > 0
        within = window >= (1 if low else html.DIVE) if within else n > 0 and window >= (1 if low else html.SURGE)
        if within and k is not None:
            kept.add(k)
    return [k in kept for k in range(len(blocks))]


@pytest.mark.parametrize("seed", range(6))
def test_spans_equal_brute_force(seed):
    r = random.Random(seed)
    blocks = [html.Block("x", [r.choice([0, 3, 10, 25, 70, 200]) for _ in range(r.randrange(1, 4))], r.choice([0, 0, 1, 2, 5]), 0, r.choice([0, 0, 0, 1, 2]), False) for _ in range(60)]
    assert html.main_spans(blocks) == brute_spans(blocks)


def test_extraction_of_empty_tables_repeated_rows_and_clashing_names(spark):
    rows = [(1, "u", "<p>One two three.</p>"), (1, "u", "<p>One two three.</p>"), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = df.withColumn("text", html.extract(df)).collect()
    assert sorted((x["page_id"], x["text"]) for x in got) == [(1, "One two three."), (1, "One two three."), (2, "")]
    assert df.where("false").withColumn("text", html.extract(df)).count() == 0
