"""Disease ontology: terms from text, replacement of obsolete ids, semantic similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_curie
from ..storage import materialise, small
from .graph import ancestors

EXCLUDED_PREFIXES = ("PR", "OBA")


def parse_terms(stanzas: DataFrame) -> DataFrame:
    """(id, name, is_obsolete, is_a, replaced_by, consider) of each [Term] stanza of column `value`; tags are split at the first ": "."""
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x))
    rows = stanzas.select(lines.alias("lines")).filter(F.array_contains("lines", "[Term]"))

    def values(tag: str):
        return F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(f"{tag}: "))), lambda x: F.substr(x, F.lit(len(tag) + 3)))

    first = lambda tag: F.get(values(tag), 0)
    word = lambda tag: F.transform(values(tag), lambda x: F.split_part(x, F.lit(" "), F.lit(1)))
    return rows.select(first("id").alias("id"), first("name").alias("name"), (F.coalesce(first("is_obsolete"), F.lit("false")) == "true").alias("is_obsolete"), word("is_a").alias("is_a"), word("replaced_by").alias("replaced_by"), word("consider").alias("consider"))


def scan_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each stanza, from its "[" on, and of the header before the first one.

    A line that begins with "[" begins a stanza, with or without a blank line before, and whether lines end with LF or
    CRLF. Spark cuts the file into byte ranges and finds the first such line of each, so a large file is many tasks'.
    Lines that end in a backslash go on in the next one.
    """
    rows = spark.read.text(path, lineSep="\n[").select(F.regexp_replace("value", r"\\\r?\n", "").alias("value"))
    return rows.select(F.when(F.col("value").rlike(r"^[A-Za-z]+\][ \t]*(?:\r?\n|$)"), F.concat(F.lit("["), "value")).otherwise(F.col("value")).alias("value"))


def scan_terms(spark: SparkSession, path: str) -> DataFrame:
    return parse_terms(scan_stanzas(spark, path))


def scan_version(spark: SparkSession, path: str) -> DataFrame:
    """(version) of a file's header."""
    return ontology_version(scan_stanzas(spark, path).filter(~F.startswith(F.col("value"), F.lit("["))))


def ontology_version(header: DataFrame) -> DataFrame:
    """(version) of the header stanza: x.y.z where the tag holds /vx.y.z/."""
    raw = F.regexp_extract("value", r"(?m)^data-version: ([^\r\n]*)", 1)
    short = F.regexp_extract(raw, r"/v(\d+\.\d+\.\d+)/", 1)
    return header.filter(F.col("value").contains("data-version: ")).select(F.when(short != "", short).otherwise(raw).alias("version"))


def is_a_edges(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))


def mesh_descriptors(records: DataFrame, category: str) -> DataFrame:
    """(id) of descriptors, one record a row of column `value`, that have a tree number under the category."""
    numbers = F.regexp_extract_all("value", F.lit(r"(?m)^MN = (\S+)"), 1)
    own = records.filter(F.exists(numbers, lambda x: F.startswith(x, F.lit(category))))
    return own.select(F.regexp_extract("value", r"(?m)^UI = (\S+)", 1).alias("id")).filter("id <> ''").distinct()


def resolve_replacements(live: DataFrame, replaced_by: DataFrame) -> DataFrame:
    """(id, successor) of obsolete ids that lead to exactly one live term; splits, cycles and dead ends have none.

    live: (id). replaced_by: (id, successor). A chain follows single successors; of several, the live ones alone count and must be one. Pointers are doubled, so a chain of n takes log n rounds.
    """
    live = live.select("id").distinct()
    edges = replaced_by.select(F.col("id").alias("old"), to_curie(F.col("successor")).alias("to")).dropna().distinct().join(live, F.col("old") == F.col("id"), "left_anti")
    edges = edges.join(small(live.withColumnRenamed("id", "to").withColumn("alive", F.lit(True))), "to", "left")
    choice = edges.groupBy("old").agg(F.collect_set("to").alias("all"), F.collect_set(F.when(F.col("alive"), F.col("to"))).alias("living"))
    step = F.when(F.size("all") == 1, F.get("all", 0)).when(F.size("living") == 1, F.get("living", 0))
    state = materialise(choice.select("old", step.alias("at")).dropna())
    # After k rounds a pointer has made 2^k steps; one that is still among obsolete ids after n steps is in a cycle.
    steps, n = 1, state.count()
    while steps <= n:
        onward = state.select(F.col("old").alias("at"), F.col("at").alias("further"))
        after = materialise(state.join(onward, "at", "left").select("old", "at", F.coalesce("further", "at").alias("next")))
        state, steps = after.select("old", F.col("next").alias("at")), 2 * steps
        if after.filter("at <> next").isEmpty():
            break
    done = state.join(small(live.withColumnRenamed("id", "at")), "at", "left_semi")
    return done.select(F.col("old").alias("id"), F.col("at").alias("successor"))


def remap(df: DataFrame, replacements: DataFrame, obsolete: DataFrame, column: str = "efo_id", labels: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """Obsolete ids replaced by their successors (with the successor's label), those without one dropped; live, unknown and null ids pass.

    obsolete: (id). replacements: (id, successor). labels: (id, name).
    """
    kept = df.columns
    hop = small(replacements.select(F.col("id").alias("_old"), F.col("successor").alias("_new")))
    gone = small(obsolete.select("id").subtract(replacements.select("id")).withColumnRenamed("id", "_gone"))
    out = df.join(gone, F.col(column) == F.col("_gone"), "left_anti").join(hop, F.col(column) == F.col("_old"), "left")
    if labels is not None and label:
        out = out.join(small(labels.select(F.col("id").alias("_id"), F.col("name").alias("_name"))), F.col("_new") == F.col("_id"), "left")
        out = out.withColumn(label, F.when(F.col("_new").isNotNull(), F.coalesce("_name", label)).otherwise(F.col(label)))
    return out.withColumn(column, F.coalesce("_new", column)).select(*kept)


def remap_report(df: DataFrame, replacements: DataFrame, obsolete: DataFrame, known: DataFrame, column: str = "efo_id") -> DataFrame:
    """One row: rows and distinct ids that are replaced, dropped and unknown."""
    what = replacements.select("id", F.lit("replaced").alias("fate")).union(obsolete.select("id").subtract(replacements.select("id")).select("id", F.lit("dropped"))).union(known.select("id").subtract(obsolete.select("id")).select("id", F.lit("live")))
    rows = df.filter(F.col(column).isNotNull()).join(small(what), F.col(column) == F.col("id"), "left").withColumn("fate", F.coalesce("fate", F.lit("unknown")))
    fates = ("replaced", "dropped", "unknown")
    return rows.agg(*[F.count_if(F.col("fate") == f).alias(f"rows_{f}") for f in fates], *[F.count_distinct(F.when(F.col("fate") == f, F.col(column))).alias(f"ids_{f}") for f in fates])


def valid_terms(terms: DataFrame, excluded=EXCLUDED_PREFIXES) -> DataFrame:
    """Named, live terms with a plausible prefix that isn't excluded."""
    prefix = F.split_part("id", F.lit(":"), F.lit(1))
    plausible = (F.length(prefix).between(2, 20) & prefix.rlike("^[A-Za-z_0-9]+$")) & (prefix.rlike("^[A-Z]+$") | prefix.rlike("[A-Z].*[A-Z]") | prefix.rlike("[_0-9]") | prefix.isin("efo", "Orphanet"))
    return terms.filter((F.trim("name") != "") & ~F.col("is_obsolete") & F.col("id").contains(":") & plausible & ~prefix.isin(*excluded))


def information_content(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, number, ic), (number, above)): -ln of the share of all terms that are at or below a term, and each term's ancestors by number."""
    names, above = ancestors(edges)
    n = names.count()
    counted = above.select(F.explode("above").alias("number")).groupBy("number").agg((0.0 - F.ln(F.count("*") / n)).alias("ic"))
    return materialise(names.join(counted, "number").select("id", "number", "ic")), above


#: Terms on either side of the pairs that one group compares.
BLOCK_TERMS = 1000
#: Pairs that one batch of results has at most, beyond those of one row; groups that one partition may have; blocks that a task packs, or compares with one.
BATCH_PAIRS, MOST_PARTITIONS, TASK_BLOCKS = 100_000, 4000, 32
#: Terms of a block that all its queries meet before the next ones: many such cycles fit a page of a file (20,000 rows).
CYCLE_TERMS = 256


def ranked_ancestors(edges: DataFrame) -> tuple[DataFrame, float]:
    """((number, id, ic, up), top): all terms with their ancestors, (less, number) with less = -ic, by falling information content, then by number; the largest content."""
    ic, above = information_content(edges)
    top = ic.agg(F.max("ic")).first()[0] or 0.0
    each = above.select(F.col("number").alias("of"), F.explode("above").alias("number")).join(small(ic.select("number", (-F.col("ic")).alias("less"))), "number")
    lists = each.groupBy(F.col("of").alias("number")).agg(F.sort_array(F.collect_list(F.struct("less", "number"))).alias("up"))
    return materialise(ic.join(lists, "number").select("number", "id", "ic", "up")), top


def packed(rows: DataFrame, side: str) -> DataFrame:
    """rows of ranked_ancestors as rows of BLOCK_TERMS terms at most, columns named by side: ids, numbers, contents; known: all their ancestors, with their less; places and sizes: each term's ancestors among these.

    Terms are put in order by their ancestors, the least informative first, so that those of a block have most ancestors in common.
    """
    size = BLOCK_TERMS
    parts = max(1, -(-rows.count() // (size * TASK_BLOCKS)))
    path = F.transform(F.reverse("up"), lambda x: x["number"])
    ordered = rows.withColumn("path", path).repartitionByRange(parts, "path", "number").sortWithinPartitions("path", "number").drop("path")
    names = [f"{side}_{c}" for c in ("ids", "numbers", "ics", "known", "less", "places", "sizes")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for start in range(0, given.num_rows, size):
                rows = pa.Table.from_batches([given.slice(start, size)]).combine_chunks()
                ids, number, ic, sizes, above, less = unpacked(rows)
                known, first, places = np.unique(above, return_index=True, return_inverse=True)
                columns = (ids, number, ic, known, less[first], places.astype(np.int32), sizes.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(c.type)) if isinstance(c, pa.Array) else pa.ListArray.from_arrays([0, len(c)], pa.array(c)) for c in columns], names)

    kinds = ("string", "long", "double", "long", "double", "int", "int")
    return materialise(ordered.select("number", "id", "ic", "up").mapInArrow(pack, ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds))))


def similarity_rows(edges: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """(efo_id_1, efo_id_2, similarity): rows of the full matrix, each of the queries (id) against all terms that share an ancestor with it; 1 on the diagonal. digits: rounded to as many.

    Each block of queries meets each block of terms that shares an ancestor with it, where the written blocks are read:
    no block is shuffled or kept for another. In two blocks, terms whose ancestors among those in common are the same
    are one class, and classes are compared. Rows come by CYCLE_TERMS terms, in their order, for a query after the other,
    so that files hold runs of queries and of similarities, which near terms share, and short cycles of terms.
    """
    rows, top = ranked_ancestors(edges)
    terms, asked = packed(rows, "t"), packed(rows.join(small(queries.select("id").distinct()), "id", "left_semi"), "q")
    n, n_asked = terms.count(), asked.count()
    each = min(TASK_BLOCKS, max(1, n * n_asked // (4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    met = asked.repartition(max(1, n_asked)).hint("shuffle_replicate_nl").join(terms.repartition(-(-n // each) or 1), F.arrays_overlap("q_known", "t_known"))
    most, cycle = BATCH_PAIRS, CYCLE_TERMS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for at in range(given.num_rows):
                side = lambda s: [given[f"{s}_{c}"].slice(at, 1).flatten() for c in ("ids", "numbers", "ics", "known", "less", "places", "sizes")]  # noqa: B023, E731
                (q_ids, q_number, q_ic, *q), (ids, number, ic, *t) = side("q"), side("t")
                q_number, q_ic, number, ic = (x.to_numpy() for x in (q_number, q_ic, number, ic))
                q_class, t_class, m = best_of_classes(*(x.to_numpy() for x in (*q, *t)))
                whole = bool((m >= 0).all())
                for first in range(0, len(ids), cycle):
                    part = slice(first, first + cycle)
                    some = ids.slice(first, cycle)
                    step = max(1, most // len(some))
                    often = pa.concat_arrays([some] * min(step, len(q_ids)))
                    for start in range(0, len(q_ids), step):
                        own = slice(start, start + step)
                        best = m[q_class[own][:, None], t_class[part]]
                        near = np.where(q_number[own][:, None] == number[part], 1.0, similarity(q_ic[own][:, None], ic[part], best, top))
                        near = near if digits is None else np.round(near, digits) + 0.0
                        if whole:
                            i, near, to = np.repeat(np.arange(start, start + len(near)), len(some)), near.ravel(), often.slice(0, near.size)
                        else:
                            i, j = np.nonzero(best >= 0)
                            i, near, to = i + start, near[i, j], some.take(pa.array(j))
                        if len(i):
                            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), to, pa.array(near)], ["efo_id_1", "efo_id_2", "similarity"])

    return met.mapInArrow(compare, "efo_id_1 string, efo_id_2 string, similarity double")


def best_of_classes(q_known, q_less, q_places, q_sizes, t_known, t_less, t_places, t_sizes):
    """(class of each query, class of each term, content of the most informative ancestor in common by classes, -1 for none) of two blocks of `packed`."""
    common, q_at, _ = np.intersect1d(q_known, t_known, assume_unique=True, return_indices=True)
    order = np.argsort(q_less[q_at], kind="stable")
    contents, common = np.r_[-q_less[q_at][order], -1.0], common[order]

    def classes(known, places, sizes):
        column = np.full(len(known), -1)
        _, mine, theirs = np.intersect1d(known, common, assume_unique=True, return_indices=True)
        column[mine] = theirs
        has = np.zeros((len(sizes), len(common)), dtype=bool)
        row, at = np.repeat(np.arange(len(sizes)), sizes), column[places]
        has[row[at >= 0], at[at >= 0]] = True
        bits = np.ascontiguousarray(np.packbits(has, axis=1))
        _, first, of = np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_index=True, return_inverse=True)
        return has[first], of.ravel()

    (q_has, q_class), (t_has, t_class) = classes(q_known, q_places, q_sizes), classes(t_known, t_places, t_sizes)
    m = np.empty((len(q_has), len(t_has)))
    for k, own in enumerate(q_has):
        columns = np.flatnonzero(own)
        met = np.c_[t_has[:, columns], np.ones(len(t_has), dtype=bool)].argmax(axis=1)  # the last is met if no other is
        m[k] = contents[np.r_[columns, len(common)]][met]
    return q_class, t_class, m


def similarity(a, b, m, top: float):
    """The mean of Lin's and Resnik's over the largest information content, of arrays of the contents of two terms and of a common ancestor."""
    both = a + b
    return (np.divide(2 * m, both, out=np.zeros(np.shape(both)), where=both > 0) + (m / top if top else 0.0)) / 2


def unpacked(rows: pa.Table):
    """(id, number, ic, sizes of the lists, ancestors, their less) of rows of ranked_ancestors."""
    ids, up = (rows[c].combine_chunks() for c in ("id", "up"))
    flat = up.flatten()
    return ids, rows["number"].to_numpy(), rows["ic"].to_numpy(), up.value_lengths().to_numpy(zero_copy_only=False), flat.field("number").to_numpy(), flat.field("less").to_numpy()


def semantic_similarity(edges: DataFrame, threshold: float, terms: DataFrame | None = None) -> DataFrame:
    """(efo_id_1, efo_id_2, similarity), both directions and the diagonal: the mean of Lin's and Resnik's over the largest information content.

    With m the most informative common ancestor, a pair can only reach the threshold if on each side
    (2 ic_m / (ic_a + ic_m) + ic_m / max_ic) / 2 does, as ic_b >= ic_m: ancestors m of a below it are dropped before the
    terms meet. A term's earlier ancestors are more informative and pass if one does, so the first common one is kept.

    Terms meet below each ancestor, and a pair counts at the first that both have: those that have an earlier one in
    common are marked by it. The terms below an ancestor are dealt out in blocks of BLOCK_TERMS, each pair of blocks a
    group; ancestors of few terms are packed into groups of as many pairs.
    """
    rows, top = ranked_ancestors(edges)
    if terms is not None:
        rows = rows.join(small(terms.select("id").distinct()), "id", "left_semi")
    m, a = -F.col("x.less"), F.col("ic")
    ratio = F.when(a + m > 0, 2 * m / F.when(a + m > 0, a + m)).otherwise(0.0)
    enough = (ratio + (m / top if top else F.lit(0.0))) / 2 >= threshold - 1e-12
    each = rows.select("number", "id", "ic", F.transform("up", lambda x: x["number"]).alias("numbers"), F.posexplode("up").alias("k", "x")).filter(enough)
    each = each.select(F.col("x.number").alias("ancestor"), "number", "id", "ic", m.alias("ic_m"), F.slice("numbers", F.lit(1), F.col("k")).alias("before"))
    reach = materialise(each)
    sizes = materialise(reach.groupBy("ancestor").agg(F.count("*").alias("n")).filter("n > 1"))
    work = sizes.filter(F.col("n") <= BLOCK_TERMS).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    packs = max(1, work // BLOCK_TERMS**2)
    below = sizes.select("ancestor", F.ceil(F.col("n") / BLOCK_TERMS).cast("int").alias("blocks"))
    met = reach.join(small(below), "ancestor").withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other).withColumn("group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("ancestor"), F.lit(packs))).otherwise(F.xxhash64("ancestor", F.least("block", "other"), F.greatest("block", "other"))))
    met = met.select("group", "ancestor", "block", "other", "number", "id", "ic", "ic_m", "before")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, lists = given["id"].combine_chunks(), given["before"].combine_chunks()
        block, other, ancestor, ic, ic_m = (given[c].to_numpy() for c in ("block", "other", "ancestor", "ic", "ic_m"))
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
        low, high = np.minimum(block, other), np.maximum(block, other)
        # Terms of equal content side by side: a row's similarities then come in runs, which take little room in files.
        order = np.lexsort((given["number"].to_numpy(), ic, block, high, low, ancestor))
        new = np.flatnonzero(np.r_[True, (np.diff(ancestor[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)])
        found: list = []
        for own in np.split(order, new[1:]):
            within = low[own[0]] == high[own[0]]
            cut = len(own) if within else int(np.searchsorted(block[own], high[own[0]]))
            left, right = (own, own) if within else (own[:cut], own[cut:])
            met_here = first_met(left, right, lengths, ends, flat)
            met_here &= (near := similarity(ic[left][:, None], ic[right][None, :], ic_m[own[0]], top)) >= threshold
            if within:
                met_here = np.triu(met_here, 1)
            i, j = np.nonzero(met_here)
            found.append((left[i], right[j], near[i, j]))
            if sum(len(x[0]) for x in found) >= BATCH_PAIRS:
                yield batch(ids, found)
                found = []
        if found:
            yield batch(ids, found)

    def batch(ids: pa.Array, found: list) -> pa.RecordBatch:
        i, j, near = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.r_[i, j])), ids.take(pa.array(np.r_[j, i])), pa.array(np.r_[near, near])], ["efo_id_1", "efo_id_2", "similarity"])

    groups = packs + (sizes.filter(F.col("n") > BLOCK_TERMS).agg(F.sum(F.pow(F.ceil(F.col("n") / BLOCK_TERMS), 2))).first()[0] or 0)
    dealt_out = met.repartition(int(max(1, min(groups, MOST_PARTITIONS))), "group")
    pairs = dealt_out.groupBy("group").applyInArrow(compare, "efo_id_1 string, efo_id_2 string, similarity double")
    return pairs.union(rows.select("id", "id", F.lit(1.0)))


def first_met(left, right, lengths, ends, flat):
    """Of all pairs of two lists of rows below one ancestor, those without an earlier one in common. before of row r: flat[ends[r] - lengths[r]:ends[r]]."""
    alone = np.ones((len(left), len(right)), dtype=bool)

    def earlier(rows):
        n = lengths[rows]
        at = np.arange(n.sum()) + np.repeat(ends[rows] - n - (np.cumsum(n) - n), n)
        of = np.repeat(np.arange(len(rows)), n)
        order = np.argsort(flat[at], kind="stable")
        names, starts = np.unique(flat[at][order], return_index=True)
        return names, of[order], np.r_[starts, len(of)]

    a_names, a_rows, a_starts = earlier(left)
    b_names, b_rows, b_starts = (a_names, a_rows, a_starts) if left is right else earlier(right)
    _, i, j = np.intersect1d(a_names, b_names, assume_unique=True, return_indices=True)
    for x, y in zip(i, j):
        own, others = a_rows[a_starts[x] : a_starts[x + 1]], b_rows[b_starts[y] : b_starts[y + 1]]
        if left is not right or len(own) > 1:
            alone[own[:, None], others[None, :]] = False
    return alone
