"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own start; a chunk that
starts inside a pre-token finds wrong boundaries at first, but from the first boundary that it shares with the chunk
before, both agree for good: the pattern looks only ahead. Neighbours are stitched at that boundary, well before the
earlier chunk's end, so that nothing that the pattern saw was cut off. Where an overlap has no shared boundary (a run
of letters or white space longer than it), the text is walked on from the last boundary that holds, next to the later
chunk from its start, until the two meet; there the chunks are stitched, and the later one holds from there on. A run
longer than a chunk is walked on into the chunk after. The pieces between stitches are then encoded independently: each
pre-token by the merge ranks, remembered by its bytes. Decoding concatenates the raw bytes of ids.

A text of at most one chunk is one piece, without an exchange; both kinds go through the same code from there.

Defined cases: null text counts as empty and has no ids; very long texts are encoded piece by piece, and what one task
holds of them is the text itself; rows with equal doc_id and text have equal results, and are all returned; a null
doc_id is kept. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 12
#: A pre-token's match looks this many characters past its end at most.
LOOKAHEAD = 2
#: Pre-tokens whose ids a worker remembers, of at most so many characters each.
REMEMBERED, SHORT = 250_000, 64
#: Pre-tokens of at most so many bytes are merged by scanning, longer ones by a heap.
SCANNED = 32


def load_ranks(spark: SparkSession, path: str):
    """Broadcasts a vocabulary: the file's lines "base64 rank" as one string (bounded by the vocabulary: under 1 MB), read where the driver finds it."""
    with open(path) as f:
        return spark.sparkContext.broadcast(f.read())


class Encoder:
    """Ids of pre-tokens by merge ranks. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, lines: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines.splitlines())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def scan(self, raw: bytes) -> bytes:
        """merge() for short pre-tokens, by scanning all pairs each time."""
        get, none = self.ranks.get, len(self.ranks)
        cuts = list(range(len(raw) + 1))
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            del cuts[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = get(raw[cuts[k] : cuts[k + 2]], none)
            if k:
                pairs[k - 1] = get(raw[cuts[k - 1] : cuts[k + 1]], none)
        return array("I", [self.ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:])]).tobytes()

    def merge(self, raw: bytes) -> bytes:
        """Merges the adjacent pair of the lowest rank, leftmost first, until none is in the ranks. A heap of pairs keeps long pieces near-linear."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(raw) <= SCANNED:
            return self.scan(raw)
        n, get = len(raw), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that starts here; 0: merged into another
        back = list(range(-1, n - 1))  # start of the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has changed since
            end[middle], end[i] = 0, stop
            if stop < n:
                back[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := back[i]) >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        ids, at = array("I"), 0
        while at < n:
            ids.append(self.ranks[raw[at : end[at]]])
            at = end[at]
        return ids.tobytes()

    def __missing(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, missing = self.known.get, self.__missing
        return b"".join([known(p) or missing(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))

    def ends(self, text: str, start: int = 0, stop: int | None = None) -> Iterator[int]:
        """Where pre-tokens of text[start:stop] end, other than in or after white space: what white space matches depends on what follows it."""
        for m in self.pattern.finditer(text, start, len(text) if stop is None else stop):
            end = m.end()
            if not text[end - 1].isspace():
                yield end


@lru_cache(maxsize=2)
def encoder(lines: str, pattern: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(lines, pattern)


def chunk_starts(n: int, chunk: int, overlap: int) -> list[int]:
    """Starts of the chunks of a text of n characters; each ends `chunk` characters later or with the text."""
    return [0] if n <= chunk else list(range(0, n - overlap, chunk - overlap))


def stitches(text: str, chunks, own: Encoder, chunk: int) -> list[int]:
    """Where pieces start. chunks: in order, each's start, and the absolute boundaries that it found in its overlap with the chunk before and with the one after."""
    starts, trusted, walk, ahead = [0], [], None, None
    for k, (start, head, tail) in enumerate(chunks):
        if k:
            shared = set(trusted).intersection(head)
            if shared:
                at = min(shared)
            else:
                if walk is None:
                    walk = own.ends(text, max(trusted, default=starts[-1]))
                    ahead = next(walk, None)
                at, stop = None, min(start + chunk, len(text))
                for end in own.ends(text, start, stop):
                    if end > stop - LOOKAHEAD and stop < len(text):
                        break
                    while ahead is not None and ahead < end:
                        ahead = next(walk, None)
                    if ahead is None or ahead >= stop:
                        break
                    if ahead == end:
                        at = end
                        break
            if at is None:  # the run goes on through this chunk
                trusted = []
                continue
            if at > starts[-1]:
                starts.append(at)
            tail, walk = [e for e in tail if e >= at], None
        trusted = tail
    return starts


def pieces(docs: DataFrame, ranks, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(row, id, unnamed, n_pieces, piece, text) of texts of at most one chunk, and of the rest. row tells the latter apart; id is the doc_id, 0 if that is null (unnamed), as pandas rounds long numbers next to nulls."""
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("unnamed"), common.text_or_empty().alias("text"))
    one = texts.filter(F.length("text") <= chunk).select(F.lit(-1).cast("long").alias("row"), "id", "unnamed", F.lit(1).alias("n_pieces"), F.lit(0).alias("piece"), "text")
    rows = common.materialise(texts.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"]):
                starts = chunk_starts(len(text), chunk, overlap)
                for at in range(0, len(starts), 100):
                    some = starts[at : at + 100]
                    yield pd.DataFrame({"row": row, "start": some, "text": [text[s : s + chunk] for s in some]})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks.value, pattern)
        for pdf in batches:
            head, tail = [], []
            for start, text in zip(pdf["start"], pdf["text"]):
                ends = list(own.ends(text))
                head.append([start + e for e in ends if e <= overlap - LOOKAHEAD])
                # Those near the end of the chunk may have been cut off.
                tail.append([start + e for e in ends if len(text) - overlap < e <= len(text) - LOOKAHEAD])
            yield pd.DataFrame({"row": pdf["row"], "chunk": [(int(s), h, t) for s, h, t in zip(pdf["start"], head, tail)]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks.value, pattern)
        for pdf in batches:
            for row, doc_id, unnamed, text, chunks in zip(pdf["row"], pdf["id"], pdf["unnamed"], pdf["text"], pdf["chunks"]):
                at = stitches(text, [(int(c["start"]), [int(e) for e in c["head"]], [int(e) for e in c["tail"]]) for c in chunks], own, chunk)
                texts = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
                yield pd.DataFrame({"row": row, "id": doc_id, "unnamed": unnamed, "n_pieces": len(at), "piece": range(len(at)), "text": texts})

    spread = rows.select("row", "text").mapInPandas(cut, "row long, start long, text string").repartition("row", "start")
    found = spread.mapInPandas(find, "row long, chunk struct<start: long, head: array<long>, tail: array<long>>")
    bounds = found.groupBy("row").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    cuts = rows.join(bounds, "row").select("row", "id", "unnamed", "text", "chunks")
    return one, cuts.mapInPandas(split, "row long, id long, unnamed boolean, n_pieces int, piece int, text string").repartition("row", "piece")


def encoded(some: DataFrame, ranks, pattern: str) -> DataFrame:
    """Pieces with raw ids and decoded bytes instead of their text."""

    @F.pandas_udf("ids binary, decoded binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks.value, pattern)
        for part in texts:
            ids = [own.encode(t) for t in part]
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]})

    return some.withColumn("bytes", run("text")).select("row", "id", "unnamed", "n_pieces", "piece", "bytes.ids", "bytes.decoded")


def named():
    return F.when(~F.col("unnamed"), F.col("id")).alias("doc_id")


def encode_documents(docs: DataFrame, ranks, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, n_pieces, piece, ids, decoded): raw ids and decoded bytes, a row for each piece. row tells texts of several pieces apart, -1 for others."""
    common.small_batches(docs.sparkSession)
    one, many = (encoded(x, ranks, pattern) for x in pieces(docs, ranks, pattern, chunk, overlap))
    return one.unionByName(many).select("row", named(), "n_pieces", "piece", "ids", "decoded")


def digests(docs: DataFrame, ranks, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    common.small_batches(docs.sparkSession)
    one, many = (encoded(x, ranks, pattern) for x in pieces(docs, ranks, pattern, chunk, overlap))

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        ids, raw = hashlib.sha256(), hashlib.sha256()
        for x, y in zip(pdf["ids"], pdf["decoded"]):
            ids.update(x)
            raw.update(y)
        return pd.DataFrame({"id": pdf["id"][:1], "unnamed": pdf["unnamed"][:1], "n_tokens": pdf["ids"].map(len).sum() // 4, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()})

    alone = one.select("id", "unnamed", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    joined = many.groupBy("row").applyInPandas(join_up, "id long, unnamed boolean, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return alone.unionByName(joined).select(named(), "n_tokens", "ids_sha256", "decoded_sha256")


def op3_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
