"""The operators against brute force, and the defined results of odd inputs."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import bpe, chat, exact_dedup, html_text, mixing, quality, sharding, simhash, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC).repartition(3)


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    long = words(rng, 40_000)
    rows = [(1, "same text here", "a"), (2, "same text here", "a"), (2, "same text here", "a"), (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (None, "no id", "b"), (None, None, None), (6, long, "c"), (7, "Ünïcödé 😀 日本 " * 30, "c"), (8, "x" * 70_000, "d")]
    return docs_of(spark, rows)


def empty(df):
    return df.limit(0)


def clashing(df):
    """Columns with names that operators use."""
    names = ("size", "h", "fp", "digest", "shard", "part", "row", "score", "label", "kept", "copies", "target", "sha", "id", "winner", "out", "maybe", "tied", "named", "bytes")
    return df.withColumns({n: F.lit("clash") for n in names})


# Mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (total - sum(3 * sizes[s] for s in full)) / free if free else 0
        new = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(0, 60)), rng.choice(["big", "big", "big", "mid", None, "tiny"] if i % 50 else ["Zed"])) for i in range(1500)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(targets[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 60
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).join(docs.select("doc_id", "source"), "doc_id").collect()))
    copies = mixing.mixed_documents(clashing(docs))
    assert copies.count() == sum(r["n_copies"] for r in got) and copies.columns == clashing(docs).columns


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mix(clashing(odd)).count() == odd.count()
    assert mixing.mix(empty(odd)).count() == 0


# Toxicity


def test_toxicity_is_learned_from_positives_and_unlabelled(spark):
    rng = random.Random(2)
    bad = ["vile", "rotten", "filthy", "nasty"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        text = words(rng, 60) + (" " + " ".join(rng.sample(bad, 2)) if toxic else "")
        rows.append((i, text, "s"))
        if i // 6 % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs, labels = docs_of(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (99_999, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    right = [r["predicted"] == int(r["doc_id"] % 6 == 0) for r in got if r["held_out"]]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r["predicted"] for r in got)


def brute_risk(w, positive, unlabelled, prior):
    g = lambda x: w[-1] + sum(w[c] for c in x)
    loss = lambda z: np.log1p(np.exp(-z))
    mean = lambda xs: sum(xs) / len(xs)
    return prior * mean([loss(g(x)) for x in positive]) + max(0.0, mean([loss(-g(x)) for x in unlabelled]) - prior * mean([loss(-g(x)) for x in positive]))


def test_non_negative_step_keeps_the_unseen_risk_up():
    rng = np.random.default_rng(0)
    n, hidden = 400, 60  # 60 of the unlabelled are positives
    positive = [[0]] * 100
    unlabelled = [[0]] * hidden + [[int(c)] for c in rng.integers(1, 6, n - hidden)]
    w = toxicity.train(positive, unlabelled, 6, hidden / n)
    assert w[0] + w[-1] >= 0 and all(w[k] + w[-1] < -1 for k in range(1, 6))
    least = brute_risk(w, positive, unlabelled, hidden / n)
    for k in (0, 1):  # no large step along a weight betters the estimator
        for step in (-2.0, 2.0):
            assert least <= brute_risk(w + step * np.eye(7)[k], positive, unlabelled, hidden / n) + 0.05


def test_toxicity_is_the_same_for_any_partitions(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 30) + (" vile rotten" if i % 4 == 0 else "") + (" rottenness" * (i % 3)), "s") for i in range(600)]
    rows += [(1000 + k, rows[k % 8][1], "s") for k in range(300)]  # copies, toxic and not
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    one = toxicity.fit(docs, labels)
    other = toxicity.fit(docs.orderBy(F.desc("doc_id")).coalesce(1), labels.repartition(5))
    assert one.features.upto == other.features.upto and (one.weights == other.weights).all() and len(one.weights) > 2


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(clashing(odd), toxicity.fit(odd, none)).collect()
    assert len(got) == odd.count() and all(r["predicted"] == 0 for r in got)
    some = spark.createDataFrame([(i, 1, 1) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, some)).count() == odd.count()
    assert toxicity.score(empty(odd), toxicity.fit(empty(odd), some)).count() == 0


def test_toxicity_counts_repeated_rows_once(spark):
    rng = random.Random(13)
    rows = [(i, words(rng, 30) + (" vile rotten" if i % 4 == 0 else ""), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    once, often = toxicity.fit(docs_of(spark, rows), labels), toxicity.fit(docs_of(spark, rows + rows[:40] * 5), labels)
    assert len(once.weights) > 2 and once.features.upto == often.features.upto and (once.weights == often.weights).all()


def test_toxicity_settings_are_chosen_by_folds_of_learned_rows(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, 30) + (f" vile{rng.randrange(10**6)}" if i % 4 == 0 else ""), "s") for i in range(800)]
    truth = [(i, 1, int(i % 4 == 0)) for i in range(800)]
    labels, held = (spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (truth, [t for t in truth if zlib.crc32(str(t[0]).encode()) % 5]))
    grid = (toxicity.Settings(prefixes=(9,)), toxicity.Settings(prefixes=(4,)))  # only the beginning of 4 characters tells
    errors = toxicity.fold_errors(docs_of(spark, rows), labels, grid, folds=2)
    assert errors == toxicity.fold_errors(docs_of(spark, rows), held, grid, folds=2)  # held-out labels have no part in it
    n = sum(t[2] for t in truth if zlib.crc32(str(t[0]).encode()) % 5)
    assert all(e[1] + e[3] == n for e in errors) and errors[1][1] > 0.9 * n and toxicity.best(errors) == grid[1]
    assert toxicity.best([(grid[0], 3, 1, 1), (grid[1], 3, 1, 1)]) == grid[0]


# Byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers")


def reference(vocabulary):
    import tiktoken

    with open(vocabulary.path("byte_bpe_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_of_odd_rows_is_the_librarys(spark, odd, vocabulary):
    own, ranks = reference(vocabulary), bpe.load_ranks(spark, vocabulary.path("byte_bpe_50k.tiktoken"))
    want = []
    for r in odd.collect():
        ids = np.array(own.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        want.append(repr((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())))
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (512, 64)):
        got = bpe.digests(clashing(odd), ranks, vocabulary.PATTERN, chunk, overlap)
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)
    assert bpe.digests(empty(odd), ranks, vocabulary.PATTERN).count() == 0
    parts = bpe.encode_documents(odd.filter("doc_id = 6"), ranks, vocabulary.PATTERN, 4096, 256).orderBy("piece").collect()
    assert len(parts) > 20 and b"".join(bytes(p["decoded"]) for p in parts).decode() == odd.filter("doc_id = 6").first()["text"]


def test_stitched_chunks_encode_alike(vocabulary):
    with open(vocabulary.path("byte_bpe_50k.tiktoken")) as f:
        own = bpe.Encoder(f.read(), vocabulary.PATTERN)
    library, rng = reference(vocabulary), random.Random(3)
    alphabet = ["a", "B", "é", "日", " ", "  ", "\n", "\t", "1", "'s", "'", "!", "😀", " ", "\xa0", "the ", "zzzzzzzzzz"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        chunk, overlap = rng.choice([(12, 6), (20, 8), (9, 5)])
        at = stitched(own, text, chunk, overlap)
        assert at == sorted(set(at))
        ids = b"".join(own.encode(text[a:b]) for a, b in zip(at, [*at[1:], len(text)]))
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def stitched(own, text, chunk, overlap):
    chunks = []
    for s in bpe.chunk_starts(len(text), chunk, overlap):
        part = text[s : s + chunk]
        ends = list(own.ends(part))
        chunks.append((s, [s + e for e in ends if e <= overlap - bpe.LOOKAHEAD], [s + e for e in ends if len(part) - overlap < e <= len(part) - bpe.LOOKAHEAD]))
    return bpe.stitches(text, chunks, own, chunk)


@pytest.mark.parametrize("run, least", [(" " * 800, 36), ("x" * 800, 36), ("\n" * 900, 36), ("y" * 20_000, 36), (" " * 20_000, 36)])
def test_stitching_goes_on_after_overlaps_without_a_boundary(vocabulary, run, least):
    with open(vocabulary.path("byte_bpe_50k.tiktoken")) as f:
        own = bpe.Encoder(f.read(), vocabulary.PATTERN)
    rng = random.Random(13)
    text = words(rng, 900) + run + words(rng, 24_000) + run + words(rng, 24_000)
    at = stitched(own, text, 6553, 409)
    assert len(at) >= least
    ids = b"".join(own.encode(text[a:b]) for a, b in zip(at, [*at[1:], len(text)]))
    assert list(memoryview(ids).cast("I")) == reference(vocabulary).encode_ordinary(text)


# Chat


def part(kind, **more):
    return {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more


def test_chat_round_trip(spark):
    tricky = ["</turn>", "\\", "\\<", "<image 0>", "<turn user>\n", "a\n</turn>\n<turn assistant>\nb", "", "\\\\<\\", chat.FORGED, "é😀"]
    rows = [(k, n, r, t) for k in range(3) for n, (r, t) in enumerate((r, t) for t in tricky for r in ("user", "assistant", "odd <role>\n"))]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert len(got) == 3
    for g in got:
        own = [(r, t) for k, _, r, t in rows if k == g["conv_id"]]
        assert [(r, "".join(x for _, x in parts)) for r, parts in chat.parse(g["formatted"])] == own
        assert [chat.unescape(g["formatted"][s["start"] : s["end"]]) for s in g["loss_spans"]] == [t for r, t in own if r == "assistant"]


def test_chat_parts(spark):
    rows = [(1, 0, "user", [part("text", text="see <image 0>"), part("image", ref="s3://a", width=600, height=512), part("document", ref="d", pages=2)]), (1, 1, "assistant", [part("audio", ref="b", seconds=2.0), part("text", text="ok")]), (None, None, None, None)]
    got = {g["conv_id"]: g for g in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()}
    one = got[1]
    assert chat.parse(one["formatted"]) == [("user", [("text", "see <image 0>"), ("image", "0"), ("document", "1")]), ("assistant", [("audio", "2"), ("text", "ok")])]
    assert [(a["type"], a["ref"], a["number"], a["tokens"]) for a in one["attachments"]] == [("image", "s3://a", 0, 340), ("document", "d", 1, 1200), ("audio", "b", 2, 50)] and one["expanded_tokens"] == 1590
    assert chat.parse(got[None]["formatted"]) == [("", [])]
    with pytest.raises(Exception, match="unknown type"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [part("video")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", None), (1, None, "user", "x"), (None, 2, "assistant", "y"), (None, 2, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1)).withColumn("attachments", F.lit(2))
    df = df.withColumn("parts", F.lit(3))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.render(chat.with_parts(df)))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 2
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert chat.read_back(chat.format_turns(chat.render(chat.text_parts(df.limit(0))))).count() == 0


def test_chat_pieces_of_a_long_conversation(spark):
    rows = [(1, n, "assistant" if n % 2 else "user", f"turn {n} <") for n in range(3000)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.render(chat.text_parts(df)))).collect()}
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    loss = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["n_turns"] == 3000
    whole = chat.format_conversations(df).filter("conv_id = 1").first()
    assert len(whole["formatted"]) == got[1]["formatted_chars"] and len(whole["loss_spans"]) == 1500


# SimHash


def near_docs(rng):
    rows = [(i, words(rng, rng.randint(1, 120)), "s") for i in range(150)]
    base = words(rng, 400)
    for k in range(60):  # a cluster of near copies, and of exact ones
        copy = base.split()
        for _ in range(k % 4):
            copy[rng.randrange(400)] = f"edit{k}"
        rows.append((1000 + k, " ".join(copy).upper() if k % 2 else " ".join(copy), "s"))
    return rows


def brute_components(fps, ids, radius):
    names = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = names[i], names[j]
                names = [min(a, b) if x in (a, b) else x for x in names]
    least = {n: min(i for m, i in zip(names, ids) if m == n) for n in set(names)}
    return [least[n] for n in names]


@pytest.mark.parametrize("radius, blocks, shard, part", [(4, 3, 2048, 8192), (4, 3, 8, 7), (6, 2, 16, 9), (12, 5, 16, 50)])
def test_simhash_against_all_pairs(spark, monkeypatch, radius, blocks, shard, part):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "PART_HOMES", part)
    monkeypatch.setattr(simhash, "PART_QUERIES", part)
    docs = docs_of(spark, near_docs(random.Random(4)))
    got = sorted(simhash.near_duplicates(docs, radius, blocks).collect())
    fps = [int(r["fingerprint"], 16) for r in got]
    assert [r["component_id"] for r in got] == brute_components(fps, [r["doc_id"] for r in got], radius)


def test_fingerprint_is_the_majority_of_shingle_hashes():
    import xxhash

    rng = random.Random(9)
    for n in (0, 1, 3, 4, 5, 50):
        text = words(rng, n, 9).upper()
        shingles = [" ".join(text.lower().split()[i : i + 4]) for i in range(max(1, n - 3))] if n else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) % 2**64 == want


def test_simhash_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(clashing(odd)).collect()}
    zero = "0" * 16
    assert got[(3, zero)] == got[(4, zero)] == got[(5, zero)] == got[(None, zero)] == 3
    kept = simhash.one_of_each(clashing(odd)).collect()
    assert len(kept) == len(set(got.values())) and sum(r["text"] == "same text here" for r in kept) == 1
    assert simhash.near_duplicates(empty(odd)).count() == 0


# Exact dedup


def test_perfect_hash_is_minimal_and_finds_nothing_else():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), "<u8").reshape(-1, 4)
    widths, bits = exact_dedup.build_function(keys[:4000])
    ranks = np.cumsum(bits) - bits
    slots = exact_dedup.find_slots(keys, widths, bits, ranks)
    assert sorted(slots[:4000]) == list(range(4000)) and slots.max() < 4000
    with pytest.raises(ValueError):
        exact_dedup.build_function(np.concatenate([keys[:5], keys[:1]]))


def test_history_takes_members_and_leaves_the_rest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 15)
    old = docs_of(spark, [(i, f"text {i % 40}", "s") for i in range(100)])
    new = docs_of(spark, [(1000 + i, f"text {i % 80}", "s") for i in range(240)])
    got = {r["doc_id"]: r for r in exact_dedup.decide(new, exact_dedup.build_index(old)).collect()}
    for i in range(240):
        r, k = got[1000 + i], i % 80
        if k < 40:
            assert not r["kept"] and r["keep_id"] == max(j for j in range(100) if j % 40 == k)
        else:
            assert r["keep_id"] == 1000 + 160 + k and r["kept"] == (i >= 160) and r["group_size"] == 3
    assert exact_dedup.deduplicated(new, exact_dedup.build_index(old)).count() == 40


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_exact_dedup_against_brute_force(spark, monkeypatch, broadcast):
    from corrobora.llm import common

    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 15)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)  # 0: bitmaps and shuffled joins
    rng = random.Random(14)
    rows = [(i, f"text {rng.randrange(120)}" if i % 3 else "hot", f"s{i % 7}") for i in range(600)] + [(5000, "twice", "b"), (5000, "twice", "a"), (5001, None, "c"), (5001, "", "b")]
    docs = docs_of(spark, rows)
    best, size = {}, {}
    for i, t, _ in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
        size[t or ""] = size.get(t or "", 0) + 1
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(docs).collect())
    assert got == sorted((i, best[t or ""], size[t or ""], i == best[t or ""]) for i, t, _ in rows)
    kept = [sorted((r["doc_id"], r["text"], r["source"]) for r in exact_dedup.deduplicated(docs.repartition(n)).collect() if r["text"] is not None) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and (5000, "twice", "a") in kept[0] and (5000, "twice", "b") not in kept[0]
    assert exact_dedup.deduplicated(docs).count() == len(best)


def test_exact_dedup_of_odd_rows(spark, odd):
    got = exact_dedup.decide(clashing(odd)).collect()
    empties = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(got) == odd.count() and len(empties) == 3 and all(r["keep_id"] == 4 and r["group_size"] == 3 for r in empties)
    kept = exact_dedup.deduplicated(clashing(odd))
    assert kept.count() == len({r["text_sha256"] for r in got}) and kept.columns == clashing(odd).columns
    assert exact_dedup.decide(empty(odd)).count() == 0


# HTML


def page(host, n, body, more=""):
    return n, f"https://{host}/p/{n}", f'<html><head><title>t {n}</title><script>var a="</p><article>";</script></head><body><nav><a href="/">Home</a></nav>{more}{body}<footer>&copy; {host}</footer></body></html>'


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    return {r["page_id"]: r for r in html_text.extract(df.withColumns({c: F.lit("clash") for c in ("text", "host", "template", "out", "page")})).collect()}


def test_html_main_text(spark):
    body = "<article><h1>T &amp; {n}</h1><p><b>One\n two<br>three<p>Four &lt;x&gt; &#233;</p><div class='ad'>Buy</div><section class=comments><p>First!</p></section><ul><li>five<li>six</ul></article>"
    got = texts(spark, [page("a.com", n, body.replace("{n}", str(n))) for n in range(8)])
    assert all(r["text"] == f"T & {n}\n\nOne two three\n\nFour <x> é\n\nfive\n\nsix" for n, r in got.items())
    assert all(r["n_chars"] == len(r["text"]) and r["n_classes"] > 0 for r in got.values())


def test_html_without_article_drops_the_template(spark):
    same = "<div>Welcome to our site</div><div id=x>Call us</div>"
    got = texts(spark, [page("b.com", n, f"<div><p>Story {n} begins.</p><p>It ends {n}.</p></div>", same) for n in range(9)])
    assert all(r["text"] == f"Story {n} begins.\n\nIt ends {n}." for n, r in got.items())


@pytest.mark.parametrize("n_pages", [1, 3, 4, 12, 40])
def test_html_what_repeats_in_articles_stays(spark, n_pages):
    """Headings and last lines that all pages of a host have; its own words around the article go."""
    body = "<article><h1>T {n}</h1><h2>Ingredients</h2><p>{n} eggs.</p><h2>Method</h2><p>Boil {n}.</p><p>Serves four.</p></article><div>All rights kept.</div>"
    got = texts(spark, [page("d.com", n, body.replace("{n}", str(n))) for n in range(n_pages)])
    assert all(r["text"] == f"T {n}\n\nIngredients\n\n{n} eggs.\n\nMethod\n\nBoil {n}.\n\nServes four." for n, r in got.items())


@pytest.mark.parametrize("n_pages", [1, 6])
def test_html_names_are_whole_words(spark, n_pages):
    parts = {"<section id='related-work'>": True, "<div class='search-engines'>": True, "<div class='notice-period'>": True, "<div class='related-posts'>": False, "<div id=comments>": False, "<div class='x ad-box-2'>": False}
    body = "<article><p>Story {n} at length, longer than the rest of it is by far, all of that being short.</p>" + "".join(f"{tag}<p>Part {k} of {{n}}.</p></{tag[1:].split()[0]}>" for k, tag in enumerate(parts)) + "</article>"
    got = texts(spark, [page("k.com", n, body.replace("{n}", str(n))) for n in range(n_pages)])
    want = [f"Part {k} of " for k, kept in enumerate(parts.values()) if kept]
    assert all([x[: len(want[0])] for x in r["text"].split("\n\n")[1:]] == want for r in got.values())


def test_html_boxes_of_one_page_go_by_their_names(spark):
    body = "<article><p>Story {n} that is long enough to be most of what its page says, told anew.</p>{x}</article>"
    boxes = "<div class=comments><p>First, says {n}!</p></div><div class=ad>Buy {n}</div><div class='share widget'>Only here {n}</div>"
    got = texts(spark, [page("g.com", n, body.replace("{x}", boxes if n == 3 else "").replace("{n}", str(n))) for n in range(6)])
    assert all(r["text"].endswith("told anew.") and r["text"].startswith(f"Story {n}") for n, r in got.items())


def test_html_names_dont_speak_against_most_of_an_article(spark):
    body = "<article><h1>T {n}</h1><section class=notice><p>Story {n}, which is nearly all that the article holds.</p></section></article>"
    got = texts(spark, [page("l.com", n, body.replace("{n}", str(n))) for n in range(6)])
    assert all(r["text"] == f"T {n}\n\nStory {n}, which is nearly all that the article holds." for n, r in got.items())


def test_html_classes_nest_also_with_one_round():
    # 1 to 3 are on all pages, 7 and 8 interleave with them, 5 and 6 lie in one slot, 4 and 9 enclose them. Classes that aren't valid are divided.
    assert html_text.valid_places([1, 7, 2, 5, 6, 3, 8], [[1, 2, 3], [7, 8], [5, 6]]) == ({0, 1, 2, 3, 4, 5, 6}, 2)
    assert html_text.valid_places([4, 1, 2, 3, 9], [[1, 2, 3], [4, 9]]) == ({0, 1, 2, 3, 4}, 2)
    assert html_text.valid_places([4, 1, 2, 3, 9], [[1, 3], [8]]) == ({1, 3}, 1)


def test_html_classes_against_literal_occurrence_vectors(spark):
    rng = random.Random(15)
    rows = []
    for n in range(40):
        host = f"h{n % 3}.com"
        body = "<article>" + "".join(f"<p>Said {rng.randrange(10**6)}</p>" for _ in range(rng.randrange(4))) + ("<p>Same on most.</p>" if n % 7 else "") + "</article>"
        rows.append(page(host, n, body, "<div class=ad>x</div>" if n % 2 else ""))
    rows.append(rows[0])  # a repeated row is a page of its own
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["host"]: {frozenset(c) for c in r["template"]} for r in html_text.templates(df).collect()}
    for host in got:
        own = [list(html_text.read(h)) for _, u, h in rows if host in u]
        vectors = {}
        for k, items in enumerate(own):
            for token, text, _ in items:
                vectors.setdefault((html_text.signed(token), text is not None), [0] * len(own))[k] += 1
        n, classes = len(own), {}
        for (token, is_text), v in vectors.items():
            support = sum(x > 0 for x in v)
            if support >= n * (0.5 + n**-0.5) if is_text else support >= max(2, 0.01 * n):
                classes.setdefault(tuple(v), set()).add(token)
        assert got[host] == {frozenset(c) for c in classes.values()}


def alone(html):
    """main_text of the only page of its host: its tags are the template."""
    return html_text.main_text(html, [[html_text.signed(t) for t, text, _ in html_text.read(html) if text is None]])[0]


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div class='page no-comments'>", "</div>"),
        ("<div id=search-layout><section class=header-fixed>", "<div class=sidebar>Links</div></section></div>"),
        ("<main class=with-sidebar>", "<aside>Links</aside></main>"),
        ("<div class=has-sidebar>", "<div class=related><article>Another story that is far longer than the one here.</article></div></div>"),
        ("", "<div class=related><article>Another story.</article></div>"),
    ],
)
def test_html_layout_words_around_the_article(before, after):
    assert alone(f"<html class=no-share><body class='has-sidebar'>{before}<article><p>The story.</p><div class=ad>Buy</div></article>{after}</body></html>") == "The story."


def test_html_words_still_speak_against_their_own_elements():
    assert alone("<body><p>A story of some length.</p><div id=comments><article>First!</article></div></body>") == "A story of some length."
    assert alone("<body><article>Story.</article><article class=comment>First!</article><aside><article>Ad</article></aside></body>") == "Story."


def test_html_names_and_titles_leave_headings_and_paragraphs(spark):
    inside = "<h2 id='search-results'>Search results</h2><h2 id=comments-on-style class=comments>On style</h2><p class='related-work'>Related.</p><p class='lead notice-period'>Notice.</p><h2 title='The hidden cost of tea'>Tea</h2><p><img alt=\"5\" disk\" src=x>Shown.</p><p class=ad>Buy</p><p hidden>no</p>"
    want = "Search results\n\nOn style\n\nRelated.\n\nNotice.\n\nTea\n\nShown."
    assert alone(f"<body><nav>Home</nav><article>{inside}</article></body>") == want


def test_html_template_decides_most_pages(spark):
    rows = [page("i.com", n, f"<div class=ad>Buy {n}</div><article><p>Story {n}</p></article>") for n in range(8)]
    assert all(r["text"] == f"Story {n}" for n, r in texts(spark, rows).items())
    assert all(html_text.main_text(h)[0] == f"Buy {n}\n\nStory {n}" for n, _, h in rows)


def test_html_long_pages_are_linear():
    for bad in ("<a " * 200_000, "<p title=\"" * 100_000, "<" * 200_000, "<!--" * 100_000, "<script" * 50_000, "<div class='x" * 50_000):
        html_text.main_text(bad)


def test_html_slots_decide_under_layout_words(spark):
    got = texts(spark, [page("f.com", n, f"<div class='page no-comments'><div class=sidebar>Links {n}</div><p>Story {n}.</p></div>") for n in range(8)])
    assert all(r["text"] == f"Story {n}." for n, r in got.items())


def test_html_of_odd_rows(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (None, None, "<article>x"), (4, "http://c.com", "a < b & c"), (5, "http://c.com", "<!-- <p>no</p> --><p>yes"), (5, "http://c.com", "<!-- <p>no</p> --><p>yes"), (6, "http://c.com", "<p>" * 5000 + "deep"), (7, "http://c.com", "<div>" * 5000 + "deep")]
    got = texts(spark, rows)
    assert got[1]["text"] == got[2]["text"] == "" and got[None]["text"] == "x" and got[4]["text"] == "a < b & c" and got[5]["text"] == "yes" and got[6]["text"] == got[7]["text"] == "deep"
    assert texts(spark, rows[:0] or [(1, None, None)])[1]["n_chars"] == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Sharding


def check_shards(rows, shards=24):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return by


def test_shards_are_near_equal(spark):
    rng = random.Random(6)
    rows = [(i, "hot copy of a text" if i % 3 == 0 else words(rng, rng.randint(1, 40)), "s") for i in range(1500)]
    for part_rows in (sharding.PART_ROWS, 9):
        placed = sharding.find_splitters(sharding.measured(docs_of(spark, rows)), part_rows=part_rows)
        assert len(placed[0]) == 24 * placed[1] - 1
    got = sharding.assign(docs_of(spark, rows)).collect()
    by = check_shards(got)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_splitters_against_sorted_prefix_sums(spark):
    rng = random.Random(16)
    docs = docs_of(spark, [(i, "hot" if i % 3 == 0 else words(rng, rng.randint(0, 50), 40), "s") for i in range(900)] + [(5000, words(rng, 4000), "s")])  # one row is larger than a shard
    rows = sorted((r["h"], r["id"], r["size"]) for r in sharding.measured(docs).collect())
    bounds, parts = sharding.find_splitters(sharding.measured(docs))
    assert parts == 1
    total, at = sum(r[2] for r in rows), 0
    sums = np.cumsum([0] + [r[2] for r in rows])
    for k, b in enumerate(bounds, 1):
        below = sum(1 for h, i, _ in rows if (h, i) < b.splitter)
        assert b.counts == (sums[below], below)
        wanted = total * k / 24
        assert abs(sums[below] - wanted) <= min(abs(x - wanted) for x in sums) + sharding.TOLERANCE * total / 24


def test_a_text_larger_than_a_shard_stays_whole(spark):
    rows = [(k, "some words", "s") for k in range(100)] + [(500, "long " * 100_000, "s")]
    got = sharding.assign(docs_of(spark, rows)).collect()
    check_shards(got)
    assert len(got) == 101 and max(r["size"] for r in got) == 500_008


def test_many_boundaries_are_quick_on_the_driver():
    """50,000 boundaries in 200,000 buckets, the buckets' sums looped over once for all of them."""
    import time

    n, buckets = 50_000, 200_000
    h = sharding.Histogram(list(range(buckets)), {i: (10 + i % 7, 1, 100 * i, 100 * i + 50) for i in range(buckets)})
    sums = np.cumsum([0] + [10 + i % 7 for i in range(buckets)])
    bounds = [sharding.Boundary(float(sums[-1]) * k / n, 0.0) for k in range(1, n)]
    began = time.process_time()
    for b in bounds:
        h.narrow(b, (0, 0))
    assert time.process_time() - began < 10
    for b in bounds[:: n // 50]:
        k = int(np.searchsorted(sums[1:], b.wanted, "left"))
        assert (b.below, b.upto, b.low, b.high) == ((sums[k], k), (sums[k + 1], k + 1), 100 * k, 100 * k + 51)


def test_shards_of_many_parts_keep_slots_gapless(spark, monkeypatch):
    rng = random.Random(7)
    docs = docs_of(spark, [(i % 90, words(rng, rng.randint(0, 9), 30), "s") for i in range(900)])
    find = sharding.find_splitters
    monkeypatch.setattr(sharding, "find_splitters", lambda rows, shards: find(rows, shards, part_rows=11))
    check_shards(sharding.assign(docs).collect())


def test_sharding_of_odd_rows(spark, odd, tmp_path):
    import zlib

    got = sharding.assign(clashing(odd)).collect()
    check_shards(got)
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((r["text"] or "").encode()) for r in odd.collect())
    assert sharding.assign(empty(odd)).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


# URLs


def test_urls(spark):
    urls = ["https://m.casino-win.example.com/fr/1", "http://free-bets.example.com/de/1", "http://winter.example.org/adsl/", "http://x.example.com/en/7", "http://x.example.com/en/8", "http://EXAMPLE.NET/de/8#f", "http://a.org/es/?x=1", "http://a.org?x=casino", "http://com/en/", "ads track", "casino", None, "", "http://bet.example.fr/bet/bet"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("m.casino-win.example.com", "/fr/1", None, "block")
    assert got[1][3] == "block" and got[2][3] == "allow" and got[3][2:] == ("example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[5] == ("example.net", "/de/8", "example.net/de/8", "block") and got[6] == ("a.org", "/es/", "org/es/", "block") and got[7] == ("a.org", "", None, "block") and got[8][2] == "com/en/"
    assert got[9] == ("", "", None, "block") and got[10][3] == "block" and got[11] == got[12] == ("", "", None, "allow") and got[13][3] == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_rules_of_the_contract(spark):
    assert dict((rule, verdict) for verdict, rule in url_filter.RULES) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://casino.net/de/1", "http://casino.net/fr/1", "http://m.example.net/de/80", "http://example.net/de/7?casino"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: ("net/de/", "allow"), 1: (None, "block"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow")}


def test_vocabulary_from_a_file(spark, tmp_path):
    path = tmp_path / "terms.tsv"
    path.write_text("Roulette\tstrict\nwin\tsoft\nspin\tsoft\nspin\tsoft\n")
    strict, soft = url_filter.load_vocabulary(spark, str(path))
    assert (strict, soft) == (["roulette"], ["spin", "win"])
    df = spark.createDataFrame([(1, "http://a.fr/roulette"), (2, "http://a.fr/win"), (3, "http://a.fr/win/spin"), (4, "http://a.fr/casino"), (5, "http://a.fr/" + "x" * 200_000 + "/roulette")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, (), strict, soft).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}
    assert url_filter.judge_urls(df, (), (), ()).filter("verdict = 'block'").count() == 0
    path.write_text("x\thard\n")
    with pytest.raises(ValueError, match="kinds"):
        url_filter.load_vocabulary(spark, str(path))


# Quality


def brute_repeats(ids):
    longest = []
    for p in range(len(ids)):
        best = 0
        for q in range(len(ids)):
            k = 0
            while q != p and p + k < len(ids) and q + k < len(ids) and ids[p + k] == ids[q + k]:
                k += 1
            best = max(best, k)
        longest.append(best)
    return longest


def test_suffix_array_against_all_pairs():
    rng = random.Random(8)
    for _ in range(150):
        ids = [rng.randrange(rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 30))]
        order, lcp = quality.suffix_array(np.array(ids, dtype=np.int64))
        assert list(order) == sorted(range(len(ids)), key=lambda i: ids[i:])
        longest = brute_repeats(ids)
        assert list(quality.longest_from(order, lcp)) == longest
        union = {x for w, places in maximal_repeats(order, lcp, ids, 3) for p in places for x in range(p, p + w)}
        assert union == {x for p, w in enumerate(longest) if w >= 3 for x in range(p, p + w)}


def maximal_repeats(order, lcp, ids, least):
    """(words, places) of each LCP interval, listed one by one, of at least `least` words that can't be extended to the left."""
    found, open_ = [], []  # open intervals: (words, first place in the order)
    for at in range(len(lcp) + 1):
        now, first = (int(lcp[at]) if at < len(lcp) else 0), at - 1
        while open_ and open_[-1][0] > now:
            n, first = open_.pop()
            places = sorted(int(x) for x in order[first:at])
            before = {ids[p - 1] if p else None for p in places}
            if n >= least and (len(before) > 1 or None in before):
                found.append((n, places))
        if now and (not open_ or open_[-1][0] < now):
            open_.append((now, first))
    return found


def test_quality_base_against_brute_windows():
    rng = random.Random(17)
    for _ in range(200):
        lines = [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 12))) for _ in range(4)]
        text = "\n".join(rng.choice(lines + ["#a *", " \t", ""]) for _ in range(rng.randint(0, 9)))
        w, space = text.split(), " \t\n\v\f\r"
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for i, v in enumerate(windows) if windows.count(v) > 1 for x in range(i, i + 8)}
        split = text.split("\n")
        dup = sum(1 for i, x in enumerate(split) if x.strip(space) and x in split[:i])
        got = quality.measure(text)
        assert got[:6] == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), dup, len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w))


def test_quality_base_and_verdicts(spark):
    rng = random.Random(10)
    fresh = " ".join(f"u{k}" for k in range(300))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, fresh, "s"), (2, fresh + " " + passage + " x " + passage, "s"), (3, "line one\nline one\n \n \nb#*$", "s"), (4, "same " * 500, "s"), (5, words(rng, 19), "s")]
    got = {r["doc_id"]: r for r in quality.rate(clashing(docs_of(spark, rows))).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"] and got[1]["word_chars"] == len(fresh.replace(" ", ""))
    assert not got[2]["base_failed"] and not got[2]["kept"] and got[2]["longest_repeat"] == 60 and got[2]["n_repeat_words"] == 120
    assert (got[3]["n_dup_lines"], got[3]["n_symbols"], got[3]["n_words"]) == (1, 3, 5)
    assert got[4]["base_failed"] and got[4]["n_covered"] == 500 and got[4]["longest_repeat"] == 499 and got[5]["base_failed"]


def test_repeats_too_short_for_the_base_are_rejected():
    """Runs of a word, which no window of eight words holds twice; half of the words in such runs are still kept, more aren't."""
    rng = random.Random(6)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered"]
    for runs, singles, kept in ((10, 0, False), (10, 71, True), (10, 69, False), (0, 70, True)):
        words_ = [f"r{k}" for k in range(runs) for _ in range(7)] + rng.sample([f"w{k}" for k in range(1000)], singles)
        got = dict(zip(names, quality.measure(" ".join(words_))))
        assert got["n_repeat_words"] == 0 and not got["base_failed"] and got["n_covered"] == 7 * runs and got["kept"] is kept
    line = rng.sample([f"v{k}" for k in range(1000)], 12)
    for least, kept in ((90, False), (110, True)):  # a line of 12 words, twice, in more than a fifth of the words or less
        got = dict(zip(names, quality.measure(" ".join(line + [f"w{k}" for k in range(least - 12)] + line))))
        assert not got["base_failed"] and got["kept"] is kept


def test_quality_of_odd_rows(spark, odd):
    got = quality.rate(clashing(odd)).collect()
    assert len(got) == odd.count() and not any(r["kept"] for r in got if not r["n_words"])
    assert quality.rate(empty(odd)).count() == 0


# Long numbers next to nulls


def test_large_and_null_ids_stay_as_they_are(spark, vocabulary):
    big = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]
    docs = spark.createDataFrame([(i, f"text {k} of some words", "en", "s", 1) for k, i in enumerate(big)], DOC).coalesce(1)
    pages = spark.createDataFrame([(i, f"http://a.com/{k}", f"<article>{k}</article>") for k, i in enumerate(big)], "page_id long, url string, html string").coalesce(1)
    turns = spark.createDataFrame([(i, 2**60 + 5 if k else None, "user", "x") for k, i in enumerate(big)], "conv_id long, turn long, role string, text string").coalesce(1)
    labels = spark.createDataFrame([(2**60 + 1, 1, 1)], "doc_id long, quality int, toxic int")
    ranks = bpe.load_ranks(spark, vocabulary.path("byte_bpe_50k.tiktoken"))
    results = [
        (mixing.mix(docs), "doc_id"), (toxicity.score(docs, toxicity.fit(docs, labels)), "doc_id"), (bpe.digests(docs, ranks, vocabulary.PATTERN), "doc_id"), (bpe.digests(docs, ranks, vocabulary.PATTERN, 12, 6), "doc_id"),
        (bpe.encode_documents(docs, ranks, vocabulary.PATTERN), "doc_id"), (chat.read_back(chat.format_turns(chat.render(chat.text_parts(turns)))), "conv_id"), (chat.format_conversations(turns), "conv_id"), (simhash.near_duplicates(docs), "doc_id"),
        (exact_dedup.decide(docs), "doc_id"), (exact_dedup.decide(docs), "keep_id"), (exact_dedup.decide(docs, exact_dedup.build_index(docs)), "keep_id"), (html_text.extract(pages), "page_id"), (sharding.assign(docs), "doc_id"), (url_filter.judge_urls(pages), "page_id"), (quality.rate(docs), "doc_id"),
    ]
    for df, name in results:
        assert sorted(map(str, (r[name] for r in df.collect()))) == sorted(map(str, big)), df.columns
