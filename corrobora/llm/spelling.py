"""Grouping of spelling variants by PartEnum signatures.

Words are the runs of letters of all texts, counted. A word's letters, as a multiset, are a binary vector: it has one
dimension for each letter and number of its occurrence (the first e, the second e, ...). One inserted or deleted
letter changes one bit, a replaced one two, so near words have vectors at a Hamming distance of two or less; words with
equal vectors (anagrams) are never near. Partition and enumerate: dimensions are dealt by hash to PARTS parts; two
vectors at distance two or less agree outside some two parts, so each vector gives one signature for each choice of two
parts to leave out, the projection on the rest. Vectors, not words, are joined on equal signatures. A pair that meets
under several signatures is taken under one of them, which the parts in which it differs fix, so nothing needs to be
made distinct. Pairs whose vectors are within two are joined with their words, and words verified by edit distance.
Every join is shuffled: from the files' sizes Spark would take tables of millions of rows, and an exploded one as if it
had the rows before, to be small enough to broadcast.

A word's form is its near word with the largest count, if that is at least TIMES its own; forms lead to larger counts,
so following them ends at a root. Pointers are doubled: a chain of n forms takes log n rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the thinning; a very long
text is one row of words, a very long run is one word of as many letters; of near words with equal counts the smallest
in code-point order is the form; repeated rows count each; an empty table gives no rows. Only doc_id and text are read,
so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fewest letters and occurrences of a word; how much more frequent its form is; one run in THINNED loses a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, THINNED = 5, 3, 2, 97
LETTER = r"[A-Za-zÀ-ÿ]"
#: Parts of the dimensions; the largest Hamming distance, which is the number of parts that a signature leaves out.
PARTS, DISTANCE = 8, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def thinned(doc_id: Column, run: Column) -> Column:
    """A run; where THINNED divides the CRC-32 of "doc_id:run", without the letter at that number modulo its length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % THINNED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words. Runs of fewer than LEAST_LETTERS letters, which can't become words, aren't extracted."""
    runs = F.regexp_extract_all(common.text_or_empty(), F.lit(f"{LETTER}{{{LEAST_LETTERS},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = rows.select(thinned(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def vector(word: Column) -> Column:
    """The set bits of a word's vector, in order: each letter with the number of its occurrence."""
    letters = F.array_sort(F.split(word, ""))
    return F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x) + 1).cast("string")))


def signatures(vectors: DataFrame) -> DataFrame:
    """vectors (v, bits) as (sig, out, v, p0, p1, ...): a row for each signature, with the bits of the parts that it leaves out and the hashes of all parts."""
    part = lambda k: F.hash(F.filter("bits", lambda x: F.pmod(F.xxhash64(x), F.lit(PARTS)) == k))
    names = [f"p{k}" for k in range(PARTS)]
    rows = vectors.select("v", *[part(k).alias(p) for k, p in enumerate(names)])
    left_out = [(sum(1 << k for k in left), [p for k, p in enumerate(names) if k not in left]) for left in combinations(range(PARTS), DISTANCE)]
    each = F.explode(F.array(*[F.struct(F.lit(out).alias("out"), F.xxhash64(F.lit(out), *rest).alias("sig")) for out, rest in left_out])).alias("s")
    return rows.select("v", *names, each).select("s.sig", "s.out", "v", *names)


def taken_under() -> list[int]:
    """By the bits of the parts in which two vectors differ: the parts that the one signature leaves out under which the pair is taken, the differing and the first others; 0 for more than DISTANCE of them."""
    chosen = [sum(1 << k for k in left) for left in combinations(range(PARTS), DISTANCE)]
    return [min((out for out in chosen if mask & out == mask), default=0) for mask in range(1 << PARTS)]


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(va, vb), va < vb, of all pairs of vectors (v, bits) at a Hamming distance of DISTANCE or less, each once. v: the letters in order, in which such vectors are at most as many edits apart; some pairs at twice the distance are too, and come along."""
    one = signatures(vectors)
    two = one.toDF(*[f"{c}_" for c in one.columns])
    mask = reduce(lambda x, y: x + y, [F.when(F.col(f"p{k}") != F.col(f"p{k}_"), 1 << k).otherwise(0) for k in range(PARTS)])
    own = F.get(F.array(*[F.lit(out) for out in taken_under()]), mask)
    met = one.join(common.shuffled(two), (F.col("sig") == F.col("sig_")) & (F.col("out") == F.col("out_")) & (F.col("v") < F.col("v_")) & (F.col("out") == own))
    return met.filter(F.levenshtein("v", "v_", DISTANCE) >= 0).select("v", "v_").toDF("va", "vb")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n): both directions of all pairs of words (word, n) that differ by one inserted, deleted or replaced code point; n is the other's."""
    keyed = words.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("v"))
    vectors = common.materialise(keyed.select("v").distinct().select("v", vector(F.col("v")).alias("bits")))
    pairs = near_vectors(vectors)
    left, right = (keyed.select(F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    met = pairs.join(common.shuffled(left), "va").join(common.shuffled(right), "vb").filter(F.levenshtein("word_a", "word_b", 1) == 1)
    ways = F.explode(F.array(F.struct(F.col("word_a").alias("word"), F.col("word_b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("word_b").alias("word"), F.col("word_a").alias("other"), F.col("n_a").alias("n"))))
    return met.select(ways.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): where following the forms ends."""
    state = common.materialise(forms.select("word", F.col("form").alias("at")).filter("at IS NOT NULL"))
    while True:
        further = state.select(F.col("word").alias("of"), F.col("at").alias("on"))
        moved = common.materialise(state.join(common.shuffled(further), F.col("at") == F.col("of"), "left").select("word", F.coalesce("on", "at").alias("at"), F.col("on").isNotNull().alias("moved")))
        state = moved.select("word", "at")
        if moved.filter("moved").isEmpty():
            return state.withColumnRenamed("at", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    words = common.materialise(count_words(docs))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("most"), F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("best"))
    joined = words.join(common.shuffled(best), "word", "left")
    has = F.col("most") >= TIMES * F.col("n")
    rows = common.materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("most")).alias("form_n")))
    return rows.join(common.shuffled(roots(rows)), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir) -> DataFrame:
    return group_variants(common.table(spark, sf_dir, "documents"))


#: CRC-32 by a table of 256 steps, near words by equal deletions: of one letter at the same place, or of one letter of the longer word.
OP12_SQL = f"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
    coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM counted),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h FROM coded, crc),
    thin AS (SELECT CASE WHEN h % {THINNED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM thin WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    pairs AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words a JOIN cuts b ON a.word = b.rest),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM pairs GROUP BY word),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN other END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
    paths(word, cur) AS (SELECT word, form FROM formed WHERE form IS NOT NULL UNION SELECT p.word, f.form FROM paths p JOIN formed f ON f.word = p.cur WHERE f.form IS NOT NULL),
    ends AS (SELECT p.word, p.cur FROM paths p JOIN formed f ON f.word = p.cur WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(e.cur, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN ends e ON e.word = f.word"""
