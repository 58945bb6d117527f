"""N-gram Jaccard join: links between documents whose shingle sets have a Jaccard similarity of 0.75 or more.

1. Every document's set is hashed.  In hash order, two linked sets share at least ``least(n)`` of their
   first n - ceil(0.75 n) + least(n) shingles.  How many of these any other document has too is counted
   exactly, by bucket of the hash; a shingle costs one row for a task however frequent it is there.
   Documents with fewer shared ones than any partner would need have no link.  The others go on.
2. Equal sets are one class with one representative.
3. The representatives' shingles are counted, and each representative keeps its n - ceil(0.75 n) + 1 rarest.
   Linked sets share one of these; of a shingle's documents each task passes on one and links the others
   to it.  The components of these star links are the candidate groups.  Shared passages are frequent, so
   they come last in this order and do not chain groups together.
4. Groups are cut into tiles by size band (bands a factor of 4/3 apart: links stay within a band or go to
   the next) and, where a band is large, by hash.  In a tile, hashed bitmaps bound the overlap from above
   by a bit count, and only what passes is intersected exactly; pairs that are connected already are
   skipped.
5. Large groups first link each tile and a few leaders of the neighbouring bands.  Documents outside the
   largest class so far are then compared with all tiles of their own and the neighbouring bands.
   So no link between different texts is lost, and no all-pairs work is done inside a connected class.

No step holds a group in one task: a tile has about ``TILE`` documents, whatever the group's size.

Whole sets are 8 bytes a shingle, about twice the compressed input, and every document may have to be
compared.  So whole sets are never written or shuffled: texts are, and each task hashes its own.  Step 1 sends
prefixes straight to where they are counted.  Parts of step 3 send 5 bytes a shingle and get a one-byte level
of its count back, in the same order.  Texts that are to be compared may be all of them, and the copies for the
cross tiles of step 5 many times the input; so steps 3 to 5 go in turns of ``TURN`` inputs of text, by bucket,
part or tile, and texts that a turn does not need are left out before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.batches import pieces, texts_of
from quern.llm.components import components, local_roots
from quern.llm.hashing import shingle_sets
from quern.operators.joins import BROADCAST_IDS, BROADCAST_ROWS
from quern.sources.stage import release, stage

SHINGLE = 5
BITS = 2048
TILE = 224
LEADERS = 16
FLUSH = 1_000_000  # shingles that a task holds at once
PART = 8 << 20  # bytes of text whose shingles a task ranks at once
TURN = 0.5  # text that one turn may copy, as a multiple of all documents
BITMAP = 1 << 27  # bits that know the documents of a turn at most: 16 MB, broadcast


def need(a, b):
    """The smallest overlap o of sets of a and b elements with 100 o >= 75 (a + b - o)."""
    return -((-3 * (a + b)) // 7)


def least(n: int) -> int:
    """Shared shingles that the counting prefix asks for."""
    return 1 + n // 5


def part_number(flush: int) -> int:
    """A number for what a task held at once; the same when the task is run again."""
    return TaskContext.get().partitionId() << 24 | flush


def bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as bucket and 32 more bits.  Distinct keys may meet, which only makes one seem shared."""
    return (keys >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def by_bucket(codes: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, packed 32-bit keys and columns) of rows."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    bucket = (codes >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    parts = [np.split(c[order].astype(np.int32), cut[1:]) for c in columns]
    keys = np.split((codes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), cut[1:])
    return [(int(bucket[k]), np.stack([keys[i], *[p[i] for p in parts]]).tobytes()) for i, k in enumerate(cut.tolist())]


def packed_table(batches, columns: int):
    """Codes, columns and the row's part of packed rows (bucket, part, packed)."""
    codes, cols, parts = [], [[] for _ in range(columns)], []
    for b in batches:
        for bucket, part, packed in zip(b.column("bucket").to_pylist(), b.column("part").to_pylist(), b.column("packed").to_pylist()):
            rows = np.frombuffer(packed, np.int32).reshape(1 + columns, -1)
            codes.append(rows[0].view(np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            for c, r in zip(cols, rows[1:]):
                c.append(r)
            parts.append(np.full(rows.shape[1], part, np.int64))
    if not codes:
        return np.zeros(0, np.uint64), [np.zeros(0, np.int32)] * columns, np.zeros(0, np.int64)
    return np.concatenate(codes), [np.concatenate(c) for c in cols], np.concatenate(parts)


def shared_rows(docs: DataFrame, buckets: int, n: int) -> DataFrame:
    """Rows with a bucket below 0: a document, its place (part, place), set size and fingerprint, and shared prefix shingles so far; from 0: packed prefix shingles and places (-1: shared already)."""
    schema = "bucket int, part long, place int, doc_id long, n long, fp_a long, fp_b long, shared long, packed binary"
    types = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("shared", pa.int64()), ("packed", pa.binary())])

    def rows(**cols):
        size = len(cols["bucket"])
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in types], schema=types)

    def flush(number, ids, sums, keys, places):
        part = part_number(number)
        shared = np.zeros(len(ids), np.int64)
        if keys:
            k, x = np.concatenate(keys), np.concatenate(places)
            order = np.argsort(k, kind="stable")
            k, x = k[order], x[order]
            head = np.concatenate([[True], k[1:] != k[:-1]])
            many = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] > 1
            np.add.at(shared, x[many], 1)
            sent = by_bucket(bucketed(k[head], buckets), np.where(many[head], -1, x[head]))
            yield rows(bucket=[b for b, _ in sent], part=[part] * len(sent), packed=[p for _, p in sent])
        yield rows(bucket=[-1 - part % buckets] * len(ids), part=[part] * len(ids), place=list(range(len(ids))), doc_id=ids, n=[s[0] for s in sums], fp_a=np.array([s[1] for s in sums], np.uint64).view(np.int64), fp_b=np.array([s[2] for s in sums], np.uint64).view(np.int64), shared=shared)

    def run(batches):
        number, held = 0, 0
        ids, sums, keys, places = [], [], [], []
        for b in pieces(batches):
            for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(texts_of(b), n)):
                sums.append((len(s), int(np.bitwise_xor.reduce(s)), int((s * (s >> np.uint64(7) | np.uint64(1))).sum())) if len(s) else (0, 0, 0))
                if len(s) and i is not None:
                    p = len(s) - -(-3 * len(s) // 4) + least(len(s))
                    keys.append(s[:p])
                    places.append(np.full(p, len(ids), np.int64))
                    held += p
                ids.append(i)
            if held >= FLUSH or len(ids) >= FLUSH:
                yield from flush(number, ids, sums, keys, places)
                number, held = number + 1, 0
                ids, sums, keys, places = [], [], [], []
        if ids:
            yield from flush(number, ids, sums, keys, places)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shared_elsewhere(rows: DataFrame) -> DataFrame:
    """The documents of ``rows``, without counts; and (part, counts): packed places of a part and how many prefix shingles of each another part has too, a row for each part and task at most."""
    schema = "part long, counts binary, place int, doc_id long, n long, fp_a long, fp_b long, shared long"
    names = ["place", "doc_id", "n", "fp_a", "fp_b", "shared"]
    kinds = [pa.int32(), *[pa.int64()] * 5]

    def run(batches):
        places = []

        def packed():
            for b in batches:
                place = pc.less(b.column("bucket"), 0)
                places.append(b.filter(place).select(["part", *names]))
                yield b.filter(pc.invert(place))

        codes, (place,), part = packed_table(packed(), 1)
        for b in places:
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.nulls(b.num_rows, pa.binary()), *[b.column(c) for c in names]], names=["part", "counts", *names])
        order = np.argsort(codes, kind="stable")
        codes, place, part = codes[order], place[order], part[order]
        head = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
        group = np.cumsum(head) - 1
        live = (np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)) & (place >= 0)
        part, place = part[live], place[live]
        order = np.lexsort((place, part))
        part, place = part[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (place[1:] != place[:-1])])[: len(part)])
        count = np.diff(np.concatenate([cut, [len(part)]])).astype(np.int32)
        part, place = part[cut], place[cut]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        rows = [np.stack([p, c]).tobytes() for p, c in zip(np.split(place, cut[1:]), np.split(count, cut[1:]))] if len(cut) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array(rows, pa.binary()), *[pa.nulls(len(rows), k) for k in kinds]], names=["part", "counts", *names])

    return rows.repartition("bucket").mapInArrow(run, schema)


def alive_rows(places: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n, fp_a, fp_b) of the documents that share enough of their prefix to have a link."""

    def run(mine: pa.Table, shared: pa.Table) -> pa.Table:
        n = mine.column("n").to_numpy()
        place = mine.column("place").to_numpy()
        total = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
        total[place] = mine.column("shared").to_numpy()
        for x in shared.column("counts").to_pylist():
            p, c = np.frombuffer(x, np.int32).reshape(2, -1)
            total[p] += c
        stay = (n > 0) & (total[place] >= least(-(-3 * n // 4))) & mine.column("doc_id").is_valid().to_numpy()
        return mine.select(["doc_id", "n", "fp_a", "fp_b"]).filter(pa.array(stay))

    return places.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(run, "doc_id long, n long, fp_a long, fp_b long")


def star(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v) from equal keys to the smallest node of each; and the distinct keys with those nodes."""
    order = np.lexsort((nodes, keys))
    k, x = keys[order], nodes[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    first = x[head][np.cumsum(head) - 1]
    other = x != first
    return x[other], first[other], k[head], x[head]


def roots_only(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, roots = local_roots(u, v)
    return nodes[nodes != roots], roots[nodes != roots]


def sets_of(mine: pa.Table, wanted: pa.Table, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """doc_ids in order and sets of the rows whose doc_id is wanted; of rows that repeat one, the smallest text, so that two readings agree."""
    mine = mine.filter(pc.is_in(mine.column("doc_id"), value_set=wanted.column("doc_id").combine_chunks().drop_null()))
    ids, once = np.unique(mine.column("doc_id").to_numpy(), return_index=True)
    if len(ids) < mine.num_rows:
        mine = mine.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids, once = np.unique(mine.column("doc_id").to_numpy(), return_index=True)
    sets = []
    for b in pieces(mine.take(pa.array(once)).select(["text"]).to_batches()):
        sets += shingle_sets(texts_of(b), n)
    return ids, sets


def starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def set_keys(texts: DataFrame, reps: DataFrame, buckets: int, n: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(bucket, part, packed): the shingles of a part's sets in order, 32 bits each, and how many of them have each, up to 255, in 8 bits; of the buckets of a turn."""

    def mine_now(codes: np.ndarray) -> np.ndarray:
        return codes if turns == 1 else codes[(codes >> np.uint64(32)) % np.uint64(turns) == turn]

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        sets = [s for s in sets_of(mine, known, n)[1] if len(s)]
        codes, c = np.unique(mine_now(bucketed(np.concatenate(sets), buckets)), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bucket, c = (codes >> np.uint64(32)).astype(np.int32), np.minimum(c, 255).astype(np.uint8)
        cut = starts(bucket)
        packed = [k.tobytes() + x.tobytes() for k, x in zip(np.split(codes.astype(np.uint32), cut[1:]), np.split(c, cut[1:]))] if len(cut) else []
        part = known.column("part")[0].as_py() if len(cut) else 0
        return pa.table({"bucket": pa.array(bucket[cut], pa.int32()), "part": pa.array([part] * len(cut), pa.int64()), "packed": pa.array(packed, pa.binary())})

    return texts.groupBy("part").cogroup(reps.groupBy("part")).applyInArrow(run, "bucket int, part long, packed binary")


def rarity(total: np.ndarray) -> np.ndarray:
    """A level from 0 (up to two sets) to 255 for how many sets have a shingle: exact up to 64, then eight for each doubling."""
    return np.where(total <= 64, np.maximum(total - 2, 0), np.minimum(62 + 8 * np.log2(np.maximum(total, 64) / 64), 255)).astype(np.uint8)


def shingle_levels(packed: DataFrame) -> DataFrame:
    """(part, buckets, levels): the levels of a part's shingles, in the order of ``set_keys``; a row for each part and task at most."""

    def run(batches):
        chunks = []
        for b in batches:
            chunks += zip(b.column("part").to_pylist(), b.column("bucket").to_pylist(), b.column("packed").to_pylist())
        if not chunks:
            return
        chunks.sort(key=lambda x: x[:2])
        size = np.array([len(x) // 5 for _, _, x in chunks])
        codes = np.concatenate([np.frombuffer(x, np.uint32, k).astype(np.uint64) | np.uint64(bucket << 32) for (_, bucket, x), k in zip(chunks, size.tolist())])
        count = np.concatenate([np.frombuffer(x, np.uint8, k, 4 * k) for (_, _, x), k in zip(chunks, size.tolist())])
        part, bucket = np.array([p for p, _, _ in chunks], np.int64), np.array([b for _, b, _ in chunks], np.int32)
        del chunks
        order = np.argsort(codes, kind="stable")
        head = starts(codes[order])
        level = np.zeros(len(codes), np.uint8)
        level[order] = np.repeat(rarity(np.add.reduceat(count[order], head, dtype=np.int64)), np.diff(np.append(head, len(codes))))
        cut = starts(part)
        at = np.concatenate([[0], np.cumsum(size)])[cut]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array([x.tobytes() for x in np.split(bucket, cut[1:])], pa.binary()), pa.array([x.tobytes() for x in np.split(level, at[1:])], pa.binary())], names=["part", "buckets", "levels"])

    return packed.repartition("bucket").select("bucket", "part", "packed").mapInArrow(run, "part long, buckets binary, levels binary")


def rarest_rows(texts: DataFrame, known: DataFrame, buckets: int, n: int) -> DataFrame:
    """Rows with bucket -2: packed links; from 0: packed rare prefix shingles with one document each.

    ``known`` has the wanted doc_ids of a part and the levels of its shingles.
    """

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        ids, sets = sets_of(mine, known, n)
        filled = [(i, s) for i, s in zip(ids.tolist(), sets) if len(s)]
        if not filled:
            return pa.table({"bucket": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
        codes = np.unique(bucketed(np.concatenate([s for _, s in filled]), buckets))
        level = np.zeros(len(codes), np.uint8)
        of = np.frombuffer(b"".join(x for x in known.column("buckets").to_pylist() if x), np.int32).astype(np.uint64)
        told = np.frombuffer(b"".join(x for x in known.column("levels").to_pylist() if x), np.uint8)
        first, last = np.searchsorted(codes, of << np.uint64(32)), np.searchsorted(codes, of + np.uint64(1) << np.uint64(32))
        size = last - first
        if not size.sum() == len(told) == len(codes):
            raise ValueError("the texts of a part changed between two readings")
        level[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(told))] = told
        keys, nodes = [], []
        for i, s in filled:
            p = len(s) - -(-3 * len(s) // 4) + 1
            keys.append(s[np.lexsort((s, level[np.searchsorted(codes, bucketed(s, buckets))]))[:p]])
            nodes.append(np.full(p, i, np.int64))
        u, v, k, x = star(np.concatenate(keys), np.concatenate(nodes))
        out = []
        if len(u):
            of, roots = local_roots(u, v)
            out.append((-2, np.stack([of[of != roots], roots[of != roots]]).tobytes()))
            at = np.minimum(np.searchsorted(of, x), len(of) - 1)
            x = np.where(of[at] == x, roots[at], x)
        to = (k >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        k, x, to = k[order], x[order], to[order]
        cut = starts(to)
        out += [(int(to[c]), np.stack([a.view(np.int64), b]).tobytes()) for c, a, b in zip(cut, np.split(k, cut[1:]), np.split(x, cut[1:]))]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "packed": pa.array([b for _, b in out], pa.binary())})

    return texts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, "bucket int, packed binary")


def bucket_links(packed: DataFrame) -> DataFrame:
    """Links (u, v) from the packed prefix shingles, brought together by bucket."""

    def link(batches):
        keys, nodes = [], []
        for b in batches:
            for p in b.column("packed").to_pylist():
                k, x = np.frombuffer(p, np.int64).reshape(2, -1)
                keys.append(k)
                nodes.append(x)
        if keys:
            u, v, _, _ = star(np.concatenate(keys), np.concatenate(nodes))
            u, v = roots_only(u, v) if len(u) else (u, v)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return packed.repartition("bucket").select("packed").mapInArrow(link, "u long, v long")


def unpacked_links(packed: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for p in b.column("packed").to_pylist():
                u, v = np.frombuffer(p, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return packed.select("packed").mapInArrow(run, "u long, v long")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the elements of a set in each of BITS hashed positions."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def tile_links(ids, sets, label, rows, cols) -> tuple[list[int], list[int]]:
    """Verified links of a tile, enough to connect what is linked: rows against cols (indices), pairs with equal labels skipped."""
    n = np.array([len(s) for s in sets], np.int64)
    maps = np.stack([bitmap(s) for s in sets])
    label = np.unique(label, return_inverse=True)[1]
    cols = cols[np.argsort(n[cols], kind="stable")]
    sizes = n[cols]
    u, v = [], []
    for i in rows.tolist():
        lo, hi = np.searchsorted(sizes, -(-3 * n[i] // 4)), np.searchsorted(sizes, 4 * n[i] // 3, "right")
        c = cols[lo:hi]
        c = c[label[c] != label[i]]
        if not len(c):
            continue
        apart = np.bitwise_count(maps[c] ^ maps[i]).sum(axis=1, dtype=np.int64)
        most = (n[c] + n[i] - apart) // 2
        fits = most >= need(n[c], n[i])
        c = c[fits][np.argsort(-most[fits], kind="stable")]
        while len(c):
            j = c[0]
            c = c[1:]
            if overlap(sets[i], sets[j]) >= need(n[i], n[j]):
                u.append(ids[i])
                v.append(ids[j])
                label[label == label[j]] = label[i]
                c = c[label[c] != label[i]]
    return u, v


def verified(tiles: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Links of every tile; rows have doc_id, label, side (0: compared with all, 1: only with side 0) and text."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        _, once = np.unique(ids, return_index=True)
        table = table.take(pa.array(once))
        sets = []
        for b in pieces(table.select(["text"]).to_batches()):
            sets += shingle_sets(texts_of(b), n)
        ids, side = table.column("doc_id").to_pylist(), table.column("side").to_numpy()
        u, v = tile_links(ids, sets, table.column("label").to_numpy(), np.flatnonzero(side == 0), np.arange(len(ids)))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return tiles.groupBy(*keys).applyInArrow(run, "u long, v long")


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` of the doc_ids in ``ids`` (staged, as they are counted); beyond BROADCAST_IDS some others too, as one bit of a hash knows them."""
    n = ids.count()
    if n <= BROADCAST_IDS:
        return texts.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    spot = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(min(BITMAP, 8 * n)))
    maps = ids.select(spot.alias("s")).groupBy(F.expr("s div 32768").alias("map_at")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("map"))
    held = texts.withColumn("s", spot).join(F.broadcast(maps), F.expr("s div 32768 = map_at"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(s % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return held.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(s % 8 as int))")) != 0).select(*texts.columns)


def with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of documents (staged, as they are counted) with their texts; the texts are not sorted for it."""
    if rows.count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(rows), "doc_id")
    return only(texts, rows).join(rows.hint("shuffle_hash"), "doc_id")


def in_turns(texts: DataFrame, tiles: DataFrame, keys: list[str], n: int, most: float, label: str) -> DataFrame:
    """The links of ``tiles`` (staged; deleted here), whose texts have ``size`` bytes; a turn's texts have about ``most``."""
    turns = max(1, -int(-(tiles.agg(F.sum("size")).first()[0] or 0) // max(1, most)))
    links = []
    for k in range(turns):
        some = stage(tiles.where(F.pmod(F.xxhash64(*keys), F.lit(turns)) == k), f"{label}-turn") if turns > 1 else tiles
        links.append(stage(verified(with_texts(texts, some.drop("size")), keys, n), f"{label}-links", [some]))
    release(tiles)
    return reduce(DataFrame.union, links)


def linked_components(docs: DataFrame, n: int = SHINGLE, tile: int = TILE, part: int = PART, turn: float = TURN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``, which is read several times."""
    spark = docs.sparkSession
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stage(shared_elsewhere(shared_rows(docs, 8 * tasks, n)), "prefixes")
    places = stage(rows.where("counts IS NULL").drop("counts"), "places")
    alive = stage(alive_rows(places, rows.where("counts IS NOT NULL").select("part", "counts")), "alive", [rows])

    # classes of equal sets; one representative each
    classes = stage(alive.groupBy("n", "fp_a", "fp_b").agg(F.min("doc_id").alias("rep")), "classes")
    same = stage(alive.join(classes, ["n", "fp_a", "fp_b"]).select("doc_id", "rep").where("doc_id <> rep").distinct(), "same", [alive])
    ids = stage(classes.select(F.col("rep").alias("doc_id")).distinct(), "rep-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    wide = only(texts, ids)
    lengths = stage(wide.groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("size")), "lengths")
    size = lengths.agg(F.sum("size")).first()[0] or 0
    most = turn * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts, turns = max(2 * tasks, size // part), max(1, -int(-size // max(1, most)))
    dealt = lambda x: x.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    levels = [stage(shingle_levels(set_keys(dealt(wide), dealt(ids), 2 * tasks, n, k, turns)), "levels") for k in range(turns)]
    known = dealt(ids).select("part", "doc_id", F.lit(None).cast("binary").alias("buckets"), F.lit(None).cast("binary").alias("levels"))
    known = known.union(reduce(DataFrame.union, levels).select("part", F.lit(None).cast("long"), "buckets", "levels"))
    rare = [stage(rarest_rows(dealt(wide).where(F.col("part") % turns == k), known.where(F.col("part") % turns == k), 2 * tasks, n), "rarest") for k in range(turns)]
    release(*levels, ids)
    rares, rare = rare, reduce(DataFrame.union, rare)
    groups = stage(components(unpacked_links(rare.where("bucket = -2")).union(bucket_links(rare.where("bucket >= 0")))), "groups", rares)

    reps = classes.join(groups.withColumnRenamed("node", "rep"), "rep")
    reps = reps.select(F.col("rep").alias("doc_id"), F.col("root").alias("group"), "n", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int").alias("band")).distinct()
    sized = reps.groupBy("group").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    bands = reps.join(sized, "group").groupBy("group", "band", "m").agg(F.count(F.lit(1)).alias("k"))
    cut = F.when(F.col("m") <= tile, 1).otherwise(F.ceil(F.col("k") / tile)).cast("int")
    bands = stage(bands.select("group", F.when(F.col("m") <= tile, -9).otherwise(F.col("band")).alias("tile_band"), "band", "m", "k", cut.alias("cut")), "bands")
    reps = reps.join(bands, ["group", "band"]).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("cut")).cast("int")).withColumn("lead", (F.col("m") > tile) & (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.greatest(F.lit(1), F.floor(F.col("k") / LEADERS))) == 0))
    held = stage(reps.join(lengths, "doc_id").select("doc_id", "size", "group", "tile_band", "sub", "cut", "m", "lead"), "grouped", [lengths])

    own = held.select("group", "tile_band", "sub", "doc_id", F.col("doc_id").alias("label"), F.lit(0).alias("side"), "size")
    near = bands.where(F.col("m") > tile).select("group", F.col("tile_band").alias("to_band"), "cut").distinct()
    leaders = held.where("lead").drop("cut", "sub").join(near, "group").where("abs(to_band - tile_band) <= 1")
    leaders = leaders.select("group", F.col("to_band").alias("tile_band"), F.explode(F.expr("sequence(0, cut - 1)")).alias("sub"), "doc_id", F.col("doc_id").alias("label"), F.lit(0).alias("side"), "size")
    tiles = stage(own.union(leaders), "tiles")
    links = in_turns(texts, tiles, ["group", "tile_band", "sub"], n, most, "tile")

    if not near.isEmpty():
        label = components(links)
        big = held.where(F.col("m") > tile)
        big = stage(big.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root"), "labelled", [held])
        core = big.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("group").agg(F.max_by("label", F.struct("c", "label")).alias("core"))
        rest = big.join(F.broadcast(core) if core.count() <= BROADCAST_ROWS else core, "group").where("label <> core")
        rest_cut = stage(rest.groupBy("group", "tile_band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("rest_cut")).withColumnRenamed("tile_band", "rest_band"), "rest")
        near = stage(near, "near")
        a = rest.join(rest_cut, (rest["group"] == rest_cut["group"]) & (rest["tile_band"] == rest_cut["rest_band"])).select(rest["group"], "rest_band", F.pmod(F.xxhash64(F.lit(3), "doc_id"), "rest_cut").cast("int").alias("rest_sub"), "doc_id", "size", "label")
        a = a.join(near, "group").where("abs(to_band - rest_band) <= 1").select("group", "rest_band", "rest_sub", "to_band", F.explode(F.expr("sequence(0, cut - 1)")).alias("sub"), "doc_id", "size", "label", F.lit(0).alias("side"))
        b = big.join(rest_cut, "group").where("abs(tile_band - rest_band) <= 1").select("group", "rest_band", F.explode(F.expr("sequence(0, rest_cut - 1)")).alias("rest_sub"), F.col("tile_band").alias("to_band"), "sub", "doc_id", "size", "label", F.lit(1).alias("side"))
        keys = ["group", "rest_band", "rest_sub", "to_band", "sub"]
        cross = stage(a.union(b), "cross", [big])
        links = links.union(in_turns(texts, cross, keys, n, most, "cross"))

    final = components(links.union(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    final = stage(final, "components", [links]).withColumnRenamed("node", "doc_id")
    joined = places.join(F.broadcast(final) if final.count() <= BROADCAST_ROWS else final, "doc_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest doc_id of its component, with all their columns."""
    found = linked_components(docs)
    gone = stage(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id.

    A NULL or empty text has an empty set and is its own component.  Rows that repeat a doc_id
    are one node of the links; of unequal ones with one doc_id any may be the one that is compared.  A NULL
    doc_id is linked with nothing.  An empty table gives no rows.
    """
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
