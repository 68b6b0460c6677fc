"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-gram incidence.

A document's set is its distinct 3-word shingles, as sorted 64-bit hashes. Two documents link at a Jaccard similarity of `percent` or more.

Blocks. Sets that link differ in at most D elements, where D follows from the larger one's size class. So of D + 1 + z ranges of the
hash space at least z + 1 hold the same elements in both: documents are blocked by the content of a range, not by single n-grams, which
makes common passages harmless. z makes up for ranges that are empty.

Products. In a block, overlap counts of a row of documents with a block's documents are accumulated by their common n-grams; pairs
whose sizes alone, or whose counts, are below the bound for a link are discarded. First every document is multiplied with one centre of each
of its blocks (linear in the block, however many copies it has). Blocks whose documents these links join are done; the
documents of the rest are multiplied with one another, in chunks of bounded size.

Equal sets are one class throughout and only their least doc_id goes on. Components come from alternating star steps on the links.

Empty or null texts and texts without words have empty sets and link with nothing. Rows that share a doc_id are one document: their
links are joined. A row without a doc_id links nothing and has no component. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import DOCUMENT, map_rows, materialize
from sieveline.llm.components import connected_components, merged_components
from sieveline.llm.filters import as_it_is, filter_of, in_filter
from sieveline.llm.words import A, mixed, words_in

#: Documents that a centre is multiplied with in a task, bytes of sets and documents of a chunk of a cluster.
CHUNK, CHUNK_BYTES, CHUNK_ROWS = 192, 8_000_000, 1_000
#: Sets that a task remembers as seen; it forgets them all when there are more.
SEEN = 100_000


class Shingler:
    """Sets of texts, as sorted hashes."""

    def __init__(self, width: int = 3) -> None:
        self.width = width

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The set of each text of a column."""
        _, _, _, h, at = words_in(column)
        whole = self._windows(h, self.width) if len(h) >= self.width else None
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= self.width:
                sets.append(np.unique(whole[a : b - self.width + 1]))
            else:
                sets.append(self._windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        return sets

    @staticmethod
    def _windows(h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total = mixed(total * A + h[k : n + k])
        return total


class Sizes:
    """Size classes, and how many ranges documents of a class are cut into."""

    def __init__(self, percent: int) -> None:
        self.percent, self.starts = percent, [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return bisect_right(self.starts, n) - 1

    def ranges(self, size_class: int) -> tuple[int, int]:
        """Number of ranges, and empty ones that are allowed for. Sets of sizes n and m that link differ in (n + m)(100 - p)/(100 + p) elements at most."""
        self.of(self.starts[-1])
        while len(self.starts) < size_class + 2:
            self.of(self.starts[-1])
        largest = self.starts[size_class + 1] - 1
        differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
        spare = 0 if differ == 0 else 1 + differ // 400
        return differ + 1 + spare, spare


def signatures(own: np.ndarray, sizes: Sizes) -> np.ndarray:
    """64-bit signatures of the set's ranges, as a set of its own size class and as the smaller of a pair with one of the next."""
    ahead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(own + A), dtype=np.uint64)))
    found, mine = [], sizes.of(len(own))
    for size_class in (mine, mine + 1):
        k, spare = sizes.ranges(size_class)
        edges = (np.arange(1, k, dtype=np.uint64)) * np.uint64((1 << 64) // max(2, k))
        at = np.concatenate(([0], np.searchsorted(own, edges), [len(own)]))
        sums = ahead[at[1:]] - ahead[at[:-1]]
        marks = mixed(sums + mixed(np.arange(k, dtype=np.uint64) + np.uint64(size_class << 32)))
        filled = at[1:] > at[:-1]
        found.append(marks if k - filled.sum() > spare else marks[filled])
    return np.concatenate(found)


def links(size_a, size_b, overlap, percent: int):
    """Whether overlap is at least percent of the union."""
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def block_product(rows: list[np.ndarray], columns: list[np.ndarray], percent: int, row_parts: np.ndarray | None = None, column_parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(row, column) of the pairs that link: overlap counts of a row at a time with all columns, by their common n-grams.

    Pairs of the same part, where parts are given, are known to be joined and are left out.
    """
    if not rows or not columns:
        return []
    sizes = np.array([len(c) for c in columns])
    grams = np.concatenate(columns)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], np.repeat(np.arange(len(columns)), sizes)[order]
    found = []
    for i, row in enumerate(rows):
        near = 100 * np.minimum(sizes, len(row)) >= percent * np.maximum(sizes, len(row))
        if row_parts is not None:
            near &= column_parts != row_parts[i]
        if not near.any():
            continue
        first, last = np.searchsorted(grams, row, "left"), np.searchsorted(grams, row, "right")
        n = last - first
        some = n > 0
        if not some.any():
            continue
        first, n = first[some], n[some]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        overlap = np.bincount(owner[at], minlength=len(columns))
        found += [(i, j) for j in np.flatnonzero(near & links(sizes, len(row), overlap, percent)).tolist()]
    return found


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, grams of the documents in ids(doc), and of a few others. Joins on doc_id leave the others out."""

    def make():
        shingled = Shingler()
        return lambda batch: {"doc_id": batch.column("doc_id"), "grams": [own.tobytes() for own in shingled(batch.column("text"))]}

    return in_filter(docs, "doc_id", filter_of(ids), ["doc_id", "text"], "doc_id long, grams binary", make, text="text")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, and a 128-bit hash of the set as h1, h2."""

    def make():
        shingled = Shingler()

        def step(batch):
            own = shingled(batch.column("text"))
            hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in own), np.int64).reshape(-1, 2)
            return {"doc_id": batch.column("doc_id"), "n": [len(x) for x in own], "h1": hashes[:, 0], "h2": hashes[:, 1]}

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n long, h1 long, h2 long")


def _entries(docs: DataFrame, percent: int) -> DataFrame:
    """mark, doc: the signatures of the documents' ranges. Of the equal sets that a task remembers one stands for all, so a text
    that a third of all rows repeat leaves few entries."""

    def make():
        shingled, sizes, seen = Shingler(), Sizes(percent), set()

        def step(batch):
            marks, ids = [], []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), shingled(batch.column("text")), strict=True):
                key = xxhash.xxh3_128_digest(own.tobytes())
                if not len(own) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                found = signatures(own, sizes)
                marks.append(found)
                ids.append(np.full(len(found), doc_id, np.int64))
            return {"mark": np.concatenate(marks).view(np.int64), "doc": np.concatenate(ids)} if marks else None

        return step

    return map_rows(docs, ["doc_id", "text"], make, "mark long, doc long")


def _blocks(entries: DataFrame) -> DataFrame:
    """block, doc: the documents of each mark that two or more have. Marks of the same least and greatest document and number of entries
    are one block: nearly always they have the same documents, and a block of more documents loses nothing.

    Marks are counted before they move, so a very frequent one is a row a task; then only the entries of shared marks move to be joined,
    where a very frequent mark can be split.
    """
    counted = entries.groupBy("mark").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count("*").alias("c")).where("x <> y")
    shared = materialize(counted.select("mark", F.xxhash64("x", "y", "c").alias("block")), "shared-marks")
    some = in_filter(entries, "mark", filter_of(shared.select("mark")), ["mark", "doc"], "mark long, doc long", as_it_is(["mark", "doc"]), text="mark")
    return some.join(shared, "mark").select("block", "doc").distinct()


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (doc, centre) that link. A centre's documents are dealt out in chunks, each with the centre's set."""
    chunks = pairs.groupBy("centre").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = materialize(pairs.join(materialize(chunks, "chunks"), "centre").select("doc", "centre", F.pmod(F.xxhash64("doc"), F.col("chunks")).alias("chunk")), "dealt")
    members = dealt.join(sets, dealt.doc == sets.doc_id).select("centre", "chunk", F.lit(1).alias("role"), "doc", "grams")
    heads = dealt.select("centre", "chunk").distinct().join(sets, F.col("centre") == sets.doc_id).select("centre", "chunk", F.lit(0).alias("role"), F.col("centre").alias("doc"), "grams")

    def make():
        state = {"key": None, "head": []}

        def step(batch):
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("centre", "chunk", "role", "doc", "grams")]
            waiting: list = []

            def multiply():
                for i, j in block_product(state["head"], [g for _, g in waiting], percent):
                    del i
                    a.append(waiting[j][0])
                    b.append(state["key"][0])
                waiting.clear()

            for centre, chunk, role, doc, grams in zip(*columns, strict=True):
                if state["key"] != (centre, chunk):
                    multiply()
                    state["key"], state["head"] = (centre, chunk), []
                if role == 0:
                    state["head"].append(np.frombuffer(grams, np.uint64))
                else:
                    waiting.append((doc, np.frombuffer(grams, np.uint64)))
            multiply()
            return {"a": a, "b": b} if a else None

        return step

    rows = members.unionByName(heads).repartition(F.col("centre"), F.col("chunk")).sortWithinPartitions("centre", "chunk", "role")
    return map_rows(rows, ["centre", "chunk", "role", "doc", "grams"], make, "a long, b long", text="grams")


def _rest_links(open_blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of all further links within the open blocks (block, doc, component): the clusters that these form are multiplied chunk by chunk."""
    heads = materialize(open_blocks.groupBy("block").agg(F.min("doc").alias("head")), "heads")
    cluster = connected_components(open_blocks.join(heads, "block").select("doc", "head"), "doc", "head").withColumnRenamed("component", "cluster")
    parts = open_blocks.select("doc", F.col("component").alias("part")).distinct()
    sized = cluster.join(parts, cluster.node == parts.doc).select("cluster", "doc", "part").join(sets.select("doc_id", F.octet_length("grams").alias("b")), F.col("doc") == F.col("doc_id"))
    sized = materialize(sized.select("cluster", "doc", "part", "b"), "clusters")
    chunks = materialize(sized.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("b") / CHUNK_BYTES, F.count("*") / CHUNK_ROWS)).cast("int").alias("chunks")), "chunks")
    placed = sized.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("chunks")).cast("int"))
    # A document goes to the pairs of chunks (i, j), i <= j, that have its own: as many as its cluster has chunks.
    pairs = placed.select("cluster", "doc", "part", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    task = pairs.select("cluster", "doc", "part", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk")
    rows = task.join(sets, task.doc == sets.doc_id).select("cluster", "i", "j", "chunk", "doc", "part", "grams")

    def product(rows):
        import pandas as pd

        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        # Pairs within the largest part are known to be joined: only the other documents are rows, against all columns.
        largest = rows["part"].mode().iloc[0]
        own, other = rows[rows["chunk"] == i], rows[rows["chunk"] == j]
        found = _links_between(own[own["part"] != largest], other, percent)
        if i != j:
            found += _links_between(other[other["part"] != largest], own[own["part"] == largest], percent)
        return _forest(pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64"))

    return rows.groupBy("cluster", "i", "j").applyInPandas(product, "a long, b long")


def _links_between(own, other, percent: int) -> list[tuple[int, int]]:
    found = block_product(*([np.frombuffer(g, np.uint64) for g in x["grams"]] for x in (own, other)), percent, own["part"].to_numpy(), other["part"].to_numpy())
    a, b = own["doc"].to_numpy(), other["doc"].to_numpy()
    return [(int(a[x]), int(b[y])) for x, y in found]


def _forest(edges):
    """Edges that join the same documents as all the edges do, one less than documents at most."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(True)
        else:
            kept.append(False)
    return edges[kept]


def jaccard_components(docs: DataFrame, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    return _components(docs, materialize(_sets(docs), "sets"), percent)


def _components(docs: DataFrame, figures: DataFrame, percent: int) -> DataFrame:
    ids = figures.where("doc_id IS NOT NULL AND n > 0")
    classes = materialize(ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("lead")), "classes")
    # Rows of a doc_id that has several texts are one document: its least class stands for it, and its other classes are linked to it below.
    members = materialize(ids.join(classes, ["h1", "h2"]).select("doc_id", "n", "lead"), "members")

    known = docs.where(F.col("doc_id").isNotNull())
    blocks = materialize(_blocks(materialize(_entries(known, percent), "entries")), "blocks")
    firsts = blocks.join(members, blocks.doc == members.doc_id).select("block", F.col("lead").alias("doc"), "n").distinct()
    firsts = materialize(firsts, "firsts")
    # The document of the most blocks is a block's centre: what others are copies of is in most blocks, so there are few pairs.
    degree = firsts.groupBy("doc").agg(F.count("*").alias("degree"))
    ordered = firsts.join(materialize(degree, "degree"), "doc")
    best = F.max_by(F.struct("doc", "n"), F.struct("degree", F.xxhash64("doc"), "doc"))
    centres = ordered.groupBy("block").agg(F.count("*").alias("size"), best.alias("best")).where("size > 1")
    centres = materialize(centres.select("block", "size", F.col("best.doc").alias("centre"), F.col("best.n").alias("m")), "centres")
    # Sizes alone rule out pairs: the overlap is at most the lesser size, the union at least the greater.
    sizes_fit = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pairs = materialize(firsts.join(centres, "block").where((F.col("doc") != F.col("centre")) & sizes_fit).select("doc", "centre").distinct(), "pairs")

    active = firsts.join(centres.select("block"), "block", "left_semi").select("doc").distinct()
    sets = materialize(_sets_of(known, active), "grams")
    same_id = members.groupBy("doc_id").agg(F.min("lead").alias("b"), F.max("lead").alias("a")).where("a <> b").select("a", "b")
    found = materialize(_star_links(pairs, sets, percent).unionByName(same_id), "links")

    joined = materialize(connected_components(found, "a", "b"), "components")
    # Blocks of three or more whose documents aren't in one component yet may hold more links.
    placed = firsts.join(centres.where("size > 2").select("block"), "block").join(joined, firsts.doc == joined.node, "left").select("block", "doc", F.coalesce("component", "doc").alias("component"))
    placed = materialize(placed, "placed")
    undone = materialize(placed.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("block"), "undone")
    rest = materialize(placed.join(undone, "block").select("block", "doc", "component"), "open-blocks")
    if rest.limit(1).count():
        more = materialize(_rest_links(rest, sets, percent), "more-links")
        joined = materialize(merged_components(joined, more, "a", "b"), "components")

    named = figures.join(classes, ["h1", "h2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("lead")).otherwise(F.col("doc_id")).alias("lead"))
    named = named.join(joined, named.lead == joined.node, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "lead"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 90) -> DataFrame:
    """The document of the least doc_id of each component, with the columns of documents; rows without a doc_id stay. Of the rows of a
    doc_id the least one by text, lang, source and n_chars stays.

    Texts move only where a row may have to go: of a document that isn't its component's least or of a doc_id that repeats.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    figures = materialize(_sets(docs), "sets")
    found = materialize(_components(docs, figures, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "verdicts")
    doubtful = found.where("doc_id <> component_id OR rows > 1")
    known = docs.where("doc_id IS NOT NULL")
    ids = filter_of(doubtful.select("doc_id"))
    some = materialize(in_filter(known, "doc_id", ids, columns, DOCUMENT, as_it_is(columns), text="text"), "doubtful")
    # The filter lets a few others pass: they come with their verdicts too.
    heads = some.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*columns[1:])).alias("row"))
    rest = in_filter(known, "doc_id", ids, columns, DOCUMENT, as_it_is(columns), text="text", inside=False)
    return rest.unionByName(heads.select("doc_id", "row.*").select(columns)).unionByName(docs.where("doc_id IS NULL").select(columns))
