"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives every element its own random permutation of the signature's slots; an
element's rank j reaches the slot at place j with a value in [j, j + 1).  A slot keeps the
least value it meets, and a document is finished at the first rank at which all its slots are
filled.  ``superminhash`` goes through the ranks for many documents at once and drops those
that are finished.

The steps, each over all rows:

1. One pass over the texts: shingle count, fingerprint of the word sequence, band keys.
2. Equal sequences form one class, led by its least doc_id.  Only leaders go on.
3. In each band bucket every leader is paired with the least one there (a star, not all pairs).
   Set sizes and parity bitmaps of the sets rule most false pairs out, without loss: two sets
   differ in as many shingles at least as their bitmaps differ in bits.  The other pairs are
   confirmed on their whole shingle sets.
4. Buckets that still hold leaders of different components get every pair across components
   that has not been tried, under the same tests, so no link that the bands show is lost.  A
   leader is in thirty buckets with centres of their own, so few are still apart by then.
5. Confirmed links are reduced by union-find inside each task and joined into components by
   alternating star steps.  Nodes with over a ``HUB_SHARE``-th of the links are few by their
   count, so what a step tells their neighbours is broadcast, and no task takes all links of one;
   no list of links or components is gathered on the driver.

With 30 bands of 5 rows a pair at similarity 0.8 misses every band with a chance of 7e-6.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; a text
shorter than a shingle is one shingle; very long texts are read whole; of documents that tie
the least doc_id stays; rows that repeat a doc_id count as one document with
all their texts and are each reported; a null doc_id links with nothing, has a null component
and is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import settle, values

BANDS = 30
ROWS = 5
SIMILARITY_PCT = 80
SHINGLE_WORDS = 5
#: A hub has more than this share of all links, and so at most twice as many hubs exist.
HUB_SHARE = 10_000
HUB_LINKS = 256

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8; bytes split where [\\x20\\x09-\\x0D] stands."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], k: int) -> set:
    """Distinct k-word shingles; of fewer words, the whole sequence as one; of none, none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def shingle_hashes(words: list[bytes], k: int, known: _WordHashes) -> np.ndarray:
    """A 64-bit hash of each distinct shingle."""
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    if not k:
        return codes
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _A + codes[i : len(words) - k + 1 + i])
    return np.unique(out)


def superminhash(elements: np.ndarray, owner: np.ndarray, documents: int, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of the sets whose elements, with their owners, are given.

    Rank j of an element draws one word of randomness: its high half is the value's fraction,
    its low half the Fisher-Yates choice of a place in [j, slots).  Documents without elements
    stay unset.
    """
    found = np.full(documents * slots, _UNSET, np.uint64)
    base = owner.astype(np.int64) * slots
    order = None
    low = np.uint64(0xFFFFFFFF)
    for rank in range(slots):
        draw = _mix(elements + np.uint64((rank + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF))
        place = rank + (((draw & low) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = place
        else:
            rows = np.arange(len(elements))
            slot = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, rank]
        np.minimum.at(found, base + slot, (np.uint64(rank) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_ = (found.reshape(documents, slots) == _UNSET).any(axis=1)
        active = open_[owner]
        if not active.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint16), (int(active.sum()), 1))
            order[np.arange(len(order)), place[active]] = 0  # place 0 is never read again
        else:
            order = order[active]
        elements, owner, base = elements[active], owner[active], base[active]
    return found.reshape(documents, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands never share keys by design."""
    parts = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, parts.shape[:2])
    for i in range(rows):
        keys = _mix(keys * _A + parts[:, :, i])
    return keys.view(np.int64)


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits an element, in 64-bit words: a bit is on if an odd number of elements falls on it."""
    size = max(64, 1 << int(2 * len(elements) - 1).bit_length()) if len(elements) else 64
    odd = np.bincount((elements >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_similar(n: str, m: str, x: str, y: str, pct: int) -> str:
    """SQL: can sets of sizes n and m with parity bitmaps x and y reach the similarity?  Unknown sizes may."""
    longer, shorter = f"if(size({x}) >= size({y}), {x}, {y})", f"if(size({x}) >= size({y}), {y}, {x})"
    folded = f"if(size({x}) = size({y}), {x}, zip_with(slice({longer}, 1, size({shorter})), slice({longer}, 1 + size({shorter}), size({shorter})), (p, q) -> p ^ q))"
    differ = f"aggregate(zip_with({folded}, {shorter}, (p, q) -> bit_count(p ^ q)), 0, (s, b) -> s + b)"
    sizes = f"100 * least({n}, {m}) >= {int(pct)} * greatest({n}, {m})"
    return f"coalesce({sizes} and (size({x}) > 2 * size({y}) or size({y}) > 2 * size({x}) or {100 + int(pct)} * {differ} <= {100 - int(pct)} * ({n} + {m})), true)"


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, print (of the word sequence, null without words), keys (of the bands), bits (parity bitmap) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            part: list[tuple] = []
            size = 0
            for doc_id, text in zip(values(batch.column(0)), values(batch.column(1))):
                words = words_of(text)
                part.append((doc_id, shingle_hashes(words, k, known), xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else None))
                size += len(part[-1][1])
                if size > 60_000:
                    yield emit(part)
                    part, size = [], 0
            if part:
                yield emit(part)
            if len(known) > 200_000:
                known.clear()

    def emit(part: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(x[1]) for x in part])
        signatures = superminhash(np.concatenate([x[1] for x in part]), np.repeat(np.arange(len(part)), sizes), len(part), bands * rows)
        keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(signatures, bands, rows).ravel()), bands).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in part], pa.int64()), pa.array(sizes, pa.int64()), pa.array([x[2] for x in part], pa.string()), keys, pa.array([parity_bits(x[1]) for x in part], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "print", "keys", "bits"],
        )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print string, keys array<long>, bits array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets reach the similarity.

    Members' texts are joined first, then centres', whose side may be skewed and is split by
    adaptive execution.
    """
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(*(values(c) for c in batch.columns)):
                if last != text_a:
                    last, left = text_a, shingles(words_of(text_a), k)
                right = shingles(words_of(text_b), k)
                common = len(left & right)
                if common and 100 * common >= pct * (len(left) + len(right) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def union_find(links: DataFrame) -> DataFrame:
    """The links (a, b) of each task replaced by (node, least node it is joined to there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node reachable from each node that has a link with a lesser one.

    Alternates large-star and small-star steps over tables in the shared folder until every node
    has one root and no root has another; a step moves one row for each link.
    """
    now = settle(union_find(links).distinct(), "links")
    while True:
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(now.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("child").alias("children"), F.max("parent").alias("parent")).where("children + parent > 1").agg(F.count("*")).first()[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = with_least(both).select("u", "v", F.least("m", "u").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large, "large-star")
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
        now = settle(small.select("x.a", "x.b").where("a <> b").distinct(), "links")


def with_least(links: DataFrame) -> DataFrame:
    """The links (u, v) with m, the least v of their u."""
    counted = settle(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least-neighbours")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hub = f"n > {max(HUB_LINKS, total // HUB_SHARE)}"
    hubs = F.broadcast(counted.where(hub).select("u", "m"))  # at most HUB_SHARE rows
    others = counted.where(f"not ({hub})").select("u", "m").hint("merge")
    return links.join(hubs, "u").union(links.join(hubs, "u", "left_anti").join(others, "u"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity_pct: int = SIMILARITY_PCT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept (the least itself)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = settle(sketch(docs, shingle_words, bands, rows), "sketches")
    named = every.where("print is not null and doc_id is not null")
    leads = settle(
        named.groupBy("print").agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "leaders"
    )
    # a doc_id that stands on rows of several classes joins them
    placed = named.join(leads.select("print", "lead"), "print").select("doc_id", "lead")
    torn = placed.groupBy("doc_id").agg(F.min("lead").alias("a"), F.max("lead").alias("z")).where("a <> z").select("doc_id", "a")
    repeated = placed.join(torn, "doc_id").where("a <> lead").select("a", F.col("lead").alias("b")).distinct()

    entry = leads.select("lead", F.explode("keys").alias("key"))
    centre = entry.groupBy("key").agg(F.min("lead").alias("a"), F.count("*").alias("size")).where("size > 1").select("key", "a")
    shared = settle(entry.join(centre, "key"), "shared-buckets")
    wanted = shared.select(F.col("lead").alias("doc_id")).distinct()  # grows with the input: never broadcast
    texts = settle(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "near-texts")
    own = leads.join(wanted.hint("merge"), F.col("lead") == F.col("doc_id"), "left_semi")
    # a leader of two classes has no single set: nothing is ruled out for it
    facts = settle(own.groupBy("lead").agg(F.when(F.count("*") == 1, F.first("n")).alias("n"), F.when(F.count("*") == 1, F.first("bits")).alias("x")), "set-facts")
    other_facts = facts.toDF("lead_2", "m", "y")
    similar = may_be_similar("n", "m", "x", "y", similarity_pct)

    star = shared.where("lead <> a").select("lead", F.col("a").alias("lead_2")).distinct().join(facts, "lead").join(other_facts, "lead_2").where(similar)
    tried = settle(star.select(F.col("lead_2").alias("a"), F.col("lead").alias("b")), "star-pairs")
    links = settle(confirm(tried, texts, shingle_words, similarity_pct).union(repeated), "star-links")
    root = components(links)

    member = shared.select("key", "lead").join(root.withColumnRenamed("node", "lead"), "lead", "left").withColumn("root", F.coalesce("root", "lead"))
    mixed = member.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("size > 2 and x < y").select("key")
    full = settle(member.join(mixed, "key", "left_semi").join(facts, "lead"), "mixed-buckets")  # buckets of one component are done
    across = full.join(full.toDF("lead_2", "key", "root_2", "m", "y"), "key").where(f"root < root_2 and {similar}")
    across = across.select(F.least("lead", "lead_2").alias("a"), F.greatest("lead", "lead_2").alias("b")).distinct()
    pairs = settle(across.join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    involved = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    more = confirm(pairs, texts.join(involved, "doc_id", "left_semi"), shingle_words, similarity_pct)
    more = settle(more, "cross-links")  # a second Python step in one stage would double its workers
    root = components(root.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))

    label = leads.join(root.withColumnRenamed("node", "lead"), "lead", "left").select("print", F.coalesce("root", "lead").alias("component"))
    out = every.join(label, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
