"""Near-duplicate search: SimHash fingerprints, and covering locality-sensitive hashing over them.

A fingerprint has 64 bits. For a radius r every bit position gets a non-zero vector of r + 1 bits; for each non-zero
vector v of that space, the mask of v keeps the positions whose vector has an odd product with v. The vectors of any r
positions span a proper subspace, so some v is orthogonal to all of them: its mask leaves out all r positions, and two
fingerprints that differ there agree under the mask. With 2^(r+1) - 1 tables no pair within the radius is missed.

Inside a bucket pairs are compared in blocks of bounded size, and a block returns a spanning forest of its links, never
all its pairs. A bucket of any size is dealt as pairs of blocks, so none lands in one task and none is cut.

similar_documents() links texts whose fingerprints are within the radius, found as above, if their sets of shingles confirm
it; beside these it links sets of a Jaccard similarity: banded min-hashes bring them together wherever their texts differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH, stored
from .graph import components

SEED = 42
BLOCK = 1024
BANDS, BAND_ROWS = 30, 5  # sets of similarity 0.8 share no band with a chance of (1 - 0.8 ** 5) ** 30 = 7e-6
CONFIRMED = 0.5  # least Jaccard similarity of texts whose fingerprints link: one phrase that both repeat often makes fingerprints alike too
SLACK = 5.0  # deviations by which the share of equal min-hashes may fall short of the similarity before the sets are compared
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; white space is space and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words, joined by spaces; of the whole sequence if it is shorter; none for no words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[i:j], SEED) for i, j in zip(first, last, strict=True)), np.uint64, len(first))


def majority(h: np.ndarray) -> np.ndarray:
    """One 64-bit word for each column of h: a bit is set if it is set in over half the rows."""
    if h.ndim == 1:
        h = h[:, None]
    n, width = h.shape
    slots = width * 8
    counts = np.zeros(slots * 256, np.int64)
    at = np.arange(slots, dtype=np.int64) * 256
    for i in range(0, n, 1 << 16):
        part = np.ascontiguousarray(h[i : i + (1 << 16)].astype(">u8")).view(np.uint8).reshape(-1, slots)
        counts += np.bincount((part + at).ravel(), minlength=slots * 256)
    bits = counts.reshape(slots, 256) @ _BYTE_BITS
    return np.packbits((2 * bits > n).reshape(width, 64), axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint(text: str | None, k: int = 4) -> int:
    """The 64-bit SimHash of the text's shingles of k words, repeats included; 0 for a text without words."""
    h = shingle_hashes(words_of(text), k)
    return int(majority(h)[0]) if len(h) else 0


def _plain(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The hashes of the text's shingles of k words, each once, in order."""
    return np.unique(shingle_hashes(words_of(text), k))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """For each factor the least product with a shingle's upper half: two sets agree in one with the chance of their Jaccard similarity."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (_FACTORS[:, None] * x[None, i : i + 1024]).min(axis=1), out=out)
    return out


def _signed(batches: Iterator[pa.RecordBatch], k: int, print_k: int | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, same, keys, signature, fp) of rows (doc_id, text, th): equal sets have the same `same`; a set without
    shingles has no keys. fp is null without print_k, the words of a fingerprint's shingles."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part, same, keys, signature, prints = batch.slice(start, BATCH), [], [], [], []
            for t in part.column(1):
                text = t.as_py()
                own = shingle_set(text, k)
                least = min_hashes(own)
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands = least.reshape(BANDS, BAND_ROWS) if len(own) else least[:0].reshape(0, BAND_ROWS)
                keys.append(np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in bands], np.uint64).view(np.int64).tolist())
                signature.append((least & 0xFF).astype(np.uint8).tobytes())
                prints.append(None if print_k is None else int(np.uint64(fingerprint(text, print_k)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signature, pa.binary()), pa.array(prints, pa.int64())], ["doc_id", "th", "same", "keys", "signature", "fp"])


def _as_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(key, rep, shingles) of rows (key, rep, text, prints): the number of fingerprints, these, and the set."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            prints = [np.array(x, np.int64) for x in part.column(3).to_pylist()]
            found = [np.int64(len(p)).tobytes() + p.tobytes() + shingle_set(t.as_py(), k).tobytes() for t, p in zip(part.column(2), prints, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["key", "rep", "shingles"])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long of the same 64 bits."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _plain(it, k), "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 covering masks of 64 bits, as signed longs."""
    m = (1 << (radius + 1)) - 1
    vectors = [i % m + 1 for i in range(64)]
    out = []
    for v in range(1, m + 1):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _forest(n: int, close) -> list[tuple[int, int]]:
    """A spanning forest of the links among 0..n-1; close(i, others) says which of the others i links to."""
    left, queue, out = np.arange(n), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        hit = close(i, left)
        if hit.any():
            found = left[hit].tolist()
            out += [(i, j) for j in found]
            queue += found
            left = left[~hit]
    return out


def _close(block: np.ndarray, radius: int):
    """block: a 64-bit word for each fingerprint."""
    return lambda i, others: np.bitwise_count(block[others] ^ block[i]) <= radius


def _alike(block: np.ndarray, similarity: float):
    """block: signatures of min-hashes; close are those whose share of equal ones is within SLACK of the similarity."""
    rows = np.frombuffer(b"".join(block.tolist()), np.uint8).reshape(len(block), -1)
    least = rows.shape[1] * similarity - SLACK * (rows.shape[1] * similarity * (1 - similarity)) ** 0.5
    return lambda i, others: (rows[others] == rows[i]).sum(axis=1) >= least


def _shared_enough(block: np.ndarray, bound: tuple[float, int]):
    """block: fingerprints and sets of shingles, as _as_sets() writes them; close are sets of a Jaccard similarity, and those
    of CONFIRMED similarity that have fingerprints within a radius."""
    similarity, radius = bound
    rows = [np.frombuffer(x, np.uint64) for x in block]
    n_prints = np.array([x[0] for x in rows], np.int64)
    prints, owner = np.concatenate([x[1 : n + 1] for x, n in zip(rows, n_prints.tolist(), strict=True)]), np.repeat(np.arange(len(rows)), n_prints)
    sets = [x[n + 1 :] for x, n in zip(rows, n_prints.tolist(), strict=True)]
    size = np.array([len(x) for x in sets], np.int64)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    first, mark = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(name) + 1, bool)

    def close(i: int, others: np.ndarray) -> np.ndarray:
        least = np.full(len(block), similarity)
        for own in prints[owner == i]:
            least[owner[np.bitwise_count(prints ^ own) <= radius]] = min(similarity, CONFIRMED)
        least = least[others]
        mark[own := name[first[i] : first[i + 1]]] = True
        fit = np.flatnonzero(np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i]))
        both = np.zeros(len(others), np.int64)
        both[fit] = [np.count_nonzero(mark[name[first[j] : first[j + 1]]]) for j in others[fit].tolist()]
        mark[own] = False
        return both >= least * (size[others] + size[i] - both)

    return close


def _link_blocks(batches: Iterator[pa.RecordBatch], close_of, bound) -> Iterator[pa.RecordBatch]:
    """(a, b): links within each run of rows that share (table, key, i, j); the rows come sorted by these.

    close_of(block, bound) gives what _forest() asks, for a run's array of fingerprints or of bytes.
    """

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
        rep = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
        block = batch.column(5).to_numpy(zero_copy_only=False)
        return group, rep, block if block.dtype == object else block.astype(np.int64).view(np.uint64)

    def links(group: np.ndarray, rep: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        first, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(rep)]]))
        plain = block.dtype != object
        two = first[size == 2] if plain else first[:0]
        two = two[_close(block, bound)(two, two + 1)] if len(two) else two
        a, b = [rep[two]], [rep[two + 1]]
        more = size > (2 if plain else 1)
        for s, n in zip(first[more].tolist(), size[more].tolist(), strict=True):
            if pairs := _forest(n, close_of(block[s : s + n], bound)):
                x = np.array(pairs)
                a.append(rep[s + x[:, 0]])
                b.append(rep[s + x[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = split(batch)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        ends = np.flatnonzero((now[0][1:] != now[0][:-1]).any(axis=1)) + 1
        last = int(ends[-1]) if len(ends) else 0  # the last run may go on in the next batch
        if last:
            yield links(*(x[:last] for x in now))
        held = tuple(x[last:] for x in now)
    if held is not None and len(held[1]):
        yield links(*held)


def _tables(keys: list[Column], radius: int, level: int) -> Column:
    """Every key under every mask. A level has masks of its own: those of the first level with the bits in another order."""
    shuffled = np.random.default_rng(level).permutation(64) if level else np.arange(64)

    def spread(mask: int) -> int:
        out = sum(1 << int(shuffled[i]) for i in range(64) if mask >> i & 1)
        return out - (1 << 64) if out >> 63 else out

    return F.array(*[F.struct(F.lit(t * 1000 + i).alias("table"), k.bitwiseAND(F.lit(spread(m))).alias("key")) for t, k in enumerate(keys) for i, m in enumerate(masks(radius))])


def covering_links(rows: DataFrame, keys: list[Column], key_radius: int, compare: str, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the reps of rows(rep long, compare long, ...).

    rows: one row for each distinct fingerprint. Rows meet where one of the keys agrees under a covering mask of
    key_radius, and link where compare differs in at most radius bits. A bucket of more rows than there are masks times
    blocks is not compared as it is: its rows meet again inside it, under masks of another order, which cover as well; so
    a row of a large bucket is copied once for each mask, not once for each block. What is large again is dealt in blocks.
    """
    named = rows.where(F.col("rep").isNotNull()).select("rep", compare, *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    own = [F.col(f"_k{i}") for i in range(len(keys))]
    first = named.select("rep", compare, *own, F.explode(_tables(own, key_radius, 0)).alias("t")).select("t.*", "rep", compare, *own)
    sizes = stored(first.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    many = len(keys) * len(masks(key_radius)) * block
    members = first.join(sizes, ["table", "key"])
    links = _dealt_links(members.where(F.col("n") <= many), "n", rows, compare, _close, radius, block)
    if sizes.where(F.col("n") > many).limit(1).count():
        inner = members.where(F.col("n") > many).select(F.col("table").alias("t0"), F.col("key").alias("k0"), "rep", compare, F.explode(_tables(own, key_radius, 1)).alias("t"))
        again = inner.select((F.col("t0") * 1_000_000 + F.col("t.table")).alias("table"), F.xxhash64("k0", "t.key").alias("key"), "rep", compare)
        links = links.union(bucket_links(again, rows, compare, _close, radius, block))
    return links.distinct()


def bucket_links(members: DataFrame, rows: DataFrame, compare: str, close_of, bound: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members(table int, key long, rep long) that share a bucket, by what rows(table, key, rep, compare)
    or rows(rep, compare) say of them; members may have the column compare themselves.

    The sizes of buckets are aggregated and written before they are joined, and rows are dealt into blocks by their hash,
    so that a bucket of any size can be split.
    """
    sizes = stored(members.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return _dealt_links(members.join(sizes, ["table", "key"]), "n", rows, compare, close_of, bound, block).distinct()


def _dealt_links(shared: DataFrame, size: str, rows: DataFrame, compare: str, close_of, bound: float, block: int) -> DataFrame:
    """bucket_links() of members whose buckets have the sizes in a column; a link may repeat."""
    last = F.ceil(F.col(size) / block).cast("int") - 1
    own = F.pmod(F.xxhash64("rep", F.lit(block)), last + 1).cast("int")
    others = F.when(last == 0, F.array(own)).otherwise(F.array_except(F.sequence(F.lit(0), last), F.array(own)))
    paired = shared.withColumn("own", own).withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    run = ["table", "key", "i", "j"]
    if compare not in paired.columns:
        paired = paired.join(rows, [c for c in ("table", "key", "rep") if c in rows.columns])
    sorted_rows = paired.select(*run, "rep", compare).repartition(*run).sortWithinPartitions(*run)
    return sorted_rows.mapInArrow(lambda it: _link_blocks(it, close_of, bound), "a long, b long")


def near_copies(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprints of k-word shingles link at radius or fewer differing bits.

    component_id is the smallest doc_id that can be reached over links. A null or wordless text has fingerprint 0, which
    links like any other. A null doc_id takes part in no link: its row gets the component of its own fingerprint's
    documents, or null if there are none. Repeated ids and rows are kept, one result row for each input row.
    """
    prints = stored(fingerprints(docs, k), "prints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps", prints.count())
    found = components(covering_links(reps, [F.col("fp")], radius, "fp", radius))
    named = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8, block: int = BLOCK, radius: int | None = None, print_k: int = 4) -> DataFrame:
    """(doc_id, th, component_id, is_first, n_rows): documents whose SimHash fingerprints of print_k-word shingles differ in
    radius or fewer bits link, if their sets of k-word shingles have CONFIRMED Jaccard similarity; without a radius none. So
    do those whose sets have the similarity named, or more, whatever their fingerprints.

    Equal sets are one. Fingerprints meet under the covering masks of near_copies(). Sets meet where one of BANDS runs of
    BAND_ROWS min-hashes agrees, which depends on nothing but their similarity: not on where the texts differ, nor on how
    often a text repeats a shingle. What either brings together forms groups, with some slack; inside each group the
    fingerprints and sets themselves are compared, in blocks, and decide what links.

    One row for each doc_id and text, told by its hash th, with the number of its rows: several texts of one id are
    documents of their own. component_id is the smallest doc_id of a group; is_first marks the one row of the group that
    is first by id and th. Null ids have no row; null and wordless texts are one group; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").withColumn("th", F.xxhash64("text"))
    own_k = None if radius is None else print_k
    rows = stored(texts.select("doc_id", "text", "th").mapInArrow(lambda it: _signed(it, k, own_k), "doc_id long, th long, same binary, keys array<long>, signature binary, fp long"), "signed")
    one = F.xxhash64("same").alias("rep")  # a set's number in links and groups
    reps = stored(rows.groupBy("same").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.first("keys").alias("keys"), F.first("signature").alias("signature"), F.collect_set("fp").alias("prints")).select(one, "of", "keys", "signature", "prints"), "reps")
    bands = reps.select("rep", F.posexplode("keys").alias("table", "key")).select("table", "key", "rep").distinct()
    links = bucket_links(bands, reps.select("rep", "signature"), "signature", _alike, similarity, block)
    if radius is not None:
        links = links.union(_print_links(reps.select("rep", F.explode("prints").alias("fp")), radius, block))
    groups = stored(components(links), "groups")
    members = groups.select(F.lit(0).alias("table"), F.col("component").alias("key"), F.col("node").alias("rep"))
    wanted = members.select("key", "rep").join(reps.select("rep", "of.doc_id", "of.th", "prints"), "rep")
    asked = wanted.join(texts.dropDuplicates(["doc_id", "th"]) if _repeats(rows) else texts, ["doc_id", "th"]).select("key", "rep", "text", "prints")
    sets = stored(asked.mapInArrow(lambda it: _as_sets(it, k), "key long, rep long, shingles binary"), "sets")
    found = components(bucket_links(members, sets.select("rep", "shingles"), "shingles", _shared_enough, (similarity, -1 if radius is None else radius), block))
    named = reps.join(found, reps.rep == found.node, "left").select("rep", F.coalesce("component", "rep").alias("grp"), "of")
    first = stored(named.groupBy("grp").agg(F.min("of").alias("first")), "first")
    placed = stored(named.join(first, "grp").select("rep", "first"), "placed")
    own = rows.groupBy("doc_id", "th", one).agg(F.count("*").alias("n_rows")).join(placed, "rep")
    return own.select("doc_id", "th", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("first")).alias("is_first"), "n_rows")


def _print_links(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """Links (a, b) that join all reps of prints(rep, fp) whose fingerprints are within the radius, one rep for each fingerprint."""
    lead = stored(prints.groupBy("fp").agg(F.min("rep").alias("rep")), "leads")
    equal = prints.join(lead.withColumnRenamed("rep", "b"), "fp").where("rep <> b").select(F.col("rep").alias("a"), "b")
    return equal.union(covering_links(lead, [F.col("fp")], radius, "fp", radius, block))


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count())


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each group of similar_documents(): that of the smallest id, and of its texts that of the
    smallest hash; of rows that repeat both one stays. Null ids stay. Columns stay as they are, whatever their names."""
    kept = stored(similar_documents(docs, **parameters).where("is_first").select(F.col("doc_id").alias("id"), F.col("th").alias("hash"), F.col("n_rows").alias("n")), "kept")
    # The rows travel as one struct, so that no column of theirs clashes.
    own = docs.select(F.struct(*docs.columns).alias("d"))
    rest = own.join(kept, (F.col("d.doc_id").cast("long") == F.col("id")) & (F.xxhash64("d.text") == F.col("hash")))
    out = rest.where("n = 1").select("d.*").union(docs.where("doc_id is null"))
    if kept.where("n > 1").limit(1).count():
        # Rows of one id and text: numbered in each, after a first pass within each task.
        place = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.xxhash64("d")))
        out = out.union(rest.where("n > 1").withColumn("place", place).where("place = 1").select("d.*"))
    return out
