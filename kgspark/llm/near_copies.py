"""N-gram Jaccard join with set-relation skipping, as classes of linked documents.

Documents are sets of word shingles; two link at Jaccard similarity >=
`percent` / 100, and a class is what links reach. Every link is honoured, yet
no list of pairs is ever made:

1. Equal sets are one set, named by a 64-bit hash of it (different sets share
   a name with a chance of 2^-64 a pair). All later steps see each set once.
2. The inverted index holds each set's prefix: its first tokens in one global
   order, rare tokens before frequent ones, with their positions, as many as
   any linked pair must share `need` of. How frequent a token is comes from
   counts over all documents; they only choose the order, any order gives the
   same links.
3. Index-level skipping: a list is cut into blocks by size and position. From
   an entry's position follows the largest partner that it can still link
   with here (its reach); a block keeps its extreme sizes and its largest
   reach, and an entry skips the blocks that these rule out. Entries that skip
   every block go; a set left with fewer entries than a link needs goes with
   all its entries, which skips further ones.
4. Every list elects a leader, its set with the largest share of entries left.
   Sets that share a list meet in the group of its leader, so every candidate
   pair meets in some group, and each member is compared with the leader.
5. Answer-level skipping: a member's answers follow from the leader's. Members
   linked to the leader are in its class, and aren't compared with each other.
   The Jaccard distance obeys the triangle inequality, so members whose
   distances to the leader differ by more than 1 - percent / 100 can't link:
   distances are cut into bands of that width, and only members of equal or
   neighbouring bands are compared, the band of the linked ones with the next
   alone. Bands are cut into blocks by number and by tokens, a task takes a
   pair of blocks, and only a spanning forest of its links leaves the task.

Null and empty texts are empty sets: linked with nothing, a class each. A very
long text is one large set: a task holds two blocks of BLOCK_TOKENS tokens and
the leader, or the sets themselves where they are larger. Repeated rows are
linked rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.extras import extras_aside
from kgspark.operators.components import components
from kgspark.session import written

WORDS = 5
PERCENT = 75
#: Tokens that count as frequent: in at least so many documents, by a lower estimate.
FREQUENT = 64
#: Least and most bits of a hash that place it in the table of frequencies, and of a set's name in the filter of names.
TABLE_BITS = (16, 26)
#: Documents whose tokens are counted together where they are read.
SCAN_ROWS = 2500
#: Sets and tokens in a block; a task holds two blocks at most.
BLOCK, BLOCK_TOKENS = 512, 1 << 20
#: Columns of a strip of the matrix that counts overlaps.
STRIP = 4096
#: Rows of the index that a task works on at once, and entries of one list that it holds at most.
CHUNK_ROWS, LIST_ROWS = 1 << 17, 1 << 20
#: Parts into which the positions of a prefix are cut for the blocks of a list.
STRIPES = 4
#: Share of a set's size by which its prefix is longer than it must be; a link then shares as many tokens more.
LONGER = 0.05


def extra(n: np.ndarray) -> np.ndarray:
    return (np.asarray(n) * LONGER).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """First tokens of a set of n of which any linked pair has one in common, and extra(n) more."""
    return min(n, n - -(-percent * n // 100) + 1 + int(extra(n)))


def _unsigned(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: doc_id, size, name of each document's set, and a hash of its text; kind 1: tokens met more than once in a task, with the count."""

    def read(batches):
        from kgspark.llm.words import shingle_sets, slices

        for batch in (b.slice(at, SCAN_ROWS) for b in batches for at in range(0, b.num_rows, SCAN_ROWS)):
            texts, ids, seen, sizes, names = batch.column("text").to_pylist(), batch.column("doc_id"), [], [], []
            for _, encoded in slices(texts):
                for tokens in shingle_sets(encoded, words):
                    seen.append(tokens)
                    sizes.append(len(tokens))
                    names.append(name(tokens))
            yield _rows(pa.array(np.zeros(len(ids), np.int8)), ids, pa.array(np.array(sizes, np.int64)), pa.array(np.array(names, np.int64)), batch.column("hash"))
            every = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
            every.sort()
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            counts = np.diff(np.append(edge, len(every)))
            more = counts > 1
            nothing = pa.array(np.zeros(more.sum(), np.int64))
            yield _rows(pa.array(np.ones(more.sum(), np.int8)), _unsigned(every[edge[more]]), pa.array(counts[more]), nothing, nothing)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(read, "kind byte, id long, n long, name long, hash long")


def _rows(kind, ids, n, names, hashes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([kind, ids, n, names, hashes], names=["kind", "id", "n", "name", "hash"])


def name(tokens: np.ndarray) -> int:
    """A set's name: 64 bits of a cryptographic hash of its sorted tokens."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def place_table(rows: DataFrame, key: str, value=None) -> np.ndarray:
    """Bytes by place: the largest value (or 1) among the rows whose key's first bits name the place.

    The table has some eight places a row, 2^26 at most: where there are more
    rows than that, a place speaks for several of them.
    """
    low, high = TABLE_BITS
    bits = min(high, max(low, (8 * rows.count()).bit_length()))
    place = F.shiftrightunsigned(key, 64 - bits).cast("int")
    found = rows.groupBy(place.alias("place")).agg((F.lit(1) if value is None else F.max(value)).cast("int").alias("v")).toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[found.column("place").to_numpy()] = found.column("v").to_numpy()
    return table


def placed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What the table holds for each unsigned hash."""
    return table[(hashes >> np.uint64(65 - len(table).bit_length())).astype(np.int64)]


def _entries(docs: DataFrame, words: int, percent: int, frequency) -> DataFrame:
    """(token, name, n, pos) of each set's prefix."""

    def read(batches):
        from kgspark.llm.words import shingle_sets, slices

        table, done = frequency.value, set()
        for batch in batches:
            for _, encoded in slices(batch.column("text").to_pylist()):
                tokens, names, sizes, lengths = [], [], [], []
                for x in shingle_sets(encoded, words):
                    if not len(x) or (k := name(x)) in done:
                        continue
                    if len(done) > 200_000:
                        done.clear()
                    done.add(k)
                    how = placed(table, x)
                    first = (x[np.argsort(how, kind="stable")] if how.any() else x)[: prefix_length(len(x), percent)]
                    tokens.append(first)
                    names.append(k)
                    sizes.append(len(x))
                    lengths.append(len(first))
                if tokens:
                    each = lambda v, kind, lengths=lengths: pa.array(np.repeat(np.array(v, kind), lengths))
                    pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
                    yield pa.RecordBatch.from_arrays([_unsigned(np.concatenate(tokens)), each(names, np.int64), each(sizes, np.int32), pa.array(pos)], names=["token", "name", "n", "pos"])

    return docs.select("text").mapInArrow(read, "token long, name long, n int, pos int")


def _sets(docs: DataFrame, words: int, wanted) -> DataFrame:
    """(name, tokens) of the sets whose name the filter lets through, once each."""

    def read(batches):
        from kgspark.llm.words import shingle_sets, slices

        table, done = wanted.value, set()
        for batch in batches:
            for _, encoded in slices(batch.column("text").to_pylist()):
                found = {}
                for x in shingle_sets(encoded, words):
                    k = name(x) if len(x) else None
                    if k is None or k in done or not placed(table, np.array([k], np.int64).view(np.uint64))[0]:
                        continue
                    if len(done) > 200_000:
                        done.clear()
                    done.add(k)
                    found[k] = x
                if found:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), _unsigned(np.concatenate(list(found.values()))))
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), lists], names=["name", "tokens"])

    return docs.select("text").mapInArrow(read, "name long, tokens array<long>").groupBy("name").agg(F.first("tokens").alias("tokens"))


def answered(token: np.ndarray, block: np.ndarray, n: np.ndarray, reach: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by list (token) and block, some block of their list may answer.

    A block is known by its extreme sizes and its largest reach. An entry
    skips a block whose sizes don't fit its own, or lie beyond its reach, or
    whose reach ends before it.
    """
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (block[1:] != block[:-1])]))
    held = np.diff(np.append(first, len(token)))
    low, high, most = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.maximum.reduceat(reach, first)
    of, lists = np.repeat(np.arange(len(first)), held), token[first]
    live = held[of] > 1
    for step in range(1, len(first)):  # as far as the blocks of the longest list go
        beside = False
        for other in (of + step, of - step):
            there = np.flatnonzero((other >= 0) & (other < len(first)))
            there = there[lists[other[there]] == token[there]]
            beside |= len(there) > 0
            there = there[~live[there]]
            k = other[there]
            live[there] = (100 * high[k] >= percent * n[there]) & (low[k] <= reach[there]) & (most[k] >= n[there])
        if not beside:
            break
    return live


def _live(entries: DataFrame, percent: int) -> DataFrame:
    """Entries (token, name, n, pos, held) that some block of their list may answer, of sets with enough of them (held) for a link.

    A linked pair x, y has percent * n_y <= 100 * n_x, and shares at least
    1 + extra(smaller) tokens of the prefixes. At one of these, at place pos of
    x, the overlap is at most extra(n_x) + n_x - pos, which bounds n_y: the
    reach of x there. Skipping only saves work: of a list of more than
    LIST_ROWS entries, all are kept, so that no task holds it.
    """
    size = F.col("n").cast("long")
    longest = size - F.ceil(size * percent / 100) + 1 + F.floor(size * LONGER)
    stripe = F.least(F.floor(F.col("pos") * STRIPES / longest), F.lit(STRIPES - 1))
    block = (F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99))) * STRIPES + stripe).cast("int")
    rows = entries.select("token", "name", "n", "pos", block.alias("block")).repartition("token").sortWithinPartitions("token", "block", "name")
    names = ["token", "name", "n", "pos", "block"]

    def kept(columns: list[np.ndarray]) -> pa.RecordBatch:
        token, name, n, pos, block = columns
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])]) if len(token) else np.zeros(0, bool)
        token, name, n, pos, block = (c[once] for c in columns)
        if len(token):
            wide = n.astype(np.int64)
            reach = np.minimum(100 * wide // percent, (wide - pos + extra(wide)) * (100 + percent) // percent - wide)
            live = answered(token, block, wide, reach, percent)
            token, name, n, pos = token[live], name[live], n[live], pos[live]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (token, name, n, pos)], names=names[:4])

    def walk(batches):
        waiting, rows, large = [], 0, None  # rows of whole lists and of one begun; the list that is too large to hold
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in names]
            if large is not None:
                same = columns[0] == large
                if same.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[same]) for c in columns[:4]], names=names[:4])
                    columns = [c[~same] for c in columns]
                if not len(columns[0]):
                    continue
                large = None
            waiting.append(columns)
            rows += len(columns[0])
            if rows < CHUNK_ROWS:
                continue
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            begun = int(np.searchsorted(columns[0], columns[0][-1]))
            yield kept([c[:begun] for c in columns])
            waiting, rows = [[c[begun:] for c in columns]], len(columns[0]) - begun
            if rows > LIST_ROWS:
                large = waiting[0][0][0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in waiting[0][:4]], names=names[:4])
                waiting, rows = [], 0
        if waiting:
            yield kept([np.concatenate(c) for c in zip(*waiting, strict=True)])

    found = written(rows.mapInArrow(walk, "token long, name long, n int, pos int"), "join-live")
    need = F.floor(F.floor(F.col("n") * percent / 100) * LONGER) + 1
    enough = found.groupBy("name", "n").agg(F.count("*").alias("held")).where(F.col("held") >= need).select("name", "held")
    return found.join(enough, "name")


def band(overlap: np.ndarray, n: np.ndarray, leader: int, percent: int) -> np.ndarray:
    """0 for sets linked to the leader, k for a Jaccard distance above k and at most k + 1 times the largest that links."""
    union = leader + n - overlap
    return np.maximum(-(-100 * (union - overlap) // np.maximum((100 - percent) * union, 1)) - 1, 0)


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `block`: of each key's rows, by number and by tokens."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    sizes = written(sizes, "join-blocks")
    return rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))


def _compared(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(leader, name, n, band) of each member (leader, name, n): its distance to the leader."""
    dealt = _spread(groups, ["leader"])
    heads = dealt.select("leader", "block").distinct().select("leader", "block", F.col("leader").alias("name"), F.lit(True).alias("leads"))
    members = dealt.where("leader <> name").select("leader", "block", "name", F.lit(False).alias("leads"))
    rows = members.unionByName(heads).join(sets, "name").repartition("leader", "block").sortWithinPartitions("leader", "block", F.desc("leads"))

    def compare(batches):
        leader, tokens = None, None
        for batch in batches:
            lists = batch.column("tokens")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.asarray(lists.flatten()).view(np.uint64)
            names, leads = batch.column("name").to_numpy(), batch.column("leads").to_numpy(zero_copy_only=False)
            # Runs of members, each behind its leader's row (or behind that of an earlier batch).
            cuts, bands, of = [*np.flatnonzero(leads).tolist(), len(names)], np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for at, (first, last) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
                if at:
                    leader, tokens = names[first], flat[ends[first] : ends[first + 1]].copy()
                    first += 1
                if first >= last:
                    continue
                here = flat[ends[first] : ends[last]]
                near = np.minimum(np.searchsorted(tokens, here), len(tokens) - 1)
                overlap = np.add.reduceat((tokens[near] == here).astype(np.int64), ends[first:last] - ends[first])
                bands[first:last], of[first:last] = band(overlap, sizes[first:last], len(tokens), percent), leader
            out = [pa.array(of), pa.array(names), pa.array(sizes), pa.array(bands.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["leader", "name", "n", "band"]).filter(pa.array(~leads))

    return rows.select("name", "leads", "tokens").mapInArrow(compare, "leader long, name long, n long, band int")


def solve(rows: list[tuple[int, bool, np.ndarray]], percent: int, across: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows (name, side, tokens); if across, of those between the two sides alone."""
    n = np.array([len(r[2]) for r in rows], np.int64)
    side = np.array([r[1] for r in rows])
    tokens, owner = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), n)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    overlap = np.zeros((len(rows), len(rows)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        first, last = np.searchsorted(column, (low, low + STRIP))
        held = np.zeros((len(rows), STRIP), np.float32)  # sums within a strip stay far below 2^24, so they are whole
        held[owner[first:last], column[first:last] - low] = 1
        overlap += np.rint(held @ held.T).astype(np.int64)
    linked = np.triu(100 * overlap >= percent * (n[:, None] + n[None, :] - overlap), 1)
    if across:
        linked &= side[:, None] != side[None, :]
    root, edges = list(range(len(rows))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in np.argwhere(linked).tolist():
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            edges.append((rows[a][0], rows[b][0]))
    return edges


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that span what members have in common beyond their leader, from (leader, name, n, band)."""
    apart = near.where("band > 0").select("leader").distinct()
    rows = _spread(near.join(apart, "leader", "left_semi"), ["leader", "band"])
    per = rows.select("leader", "band", "blocks").distinct().groupBy("leader").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("all"))  # as many entries as bands
    per = written(per, "join-bands")  # so that Spark can split a hot leader in the join below
    beside = F.filter(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda b: (b >= 0) & ((b > 0) | (F.col("band") > 0)) & F.map_contains_key("all", b))
    others = F.flatten(F.transform(beside, lambda b: F.transform(F.sequence(F.lit(0), F.element_at("all", b) - 1), lambda k: F.struct(b.alias("band"), k.alias("block")))))
    mine = F.struct("band", "block")
    met = rows.join(per, "leader").select("leader", "name", mine.alias("mine"), F.explode(others).alias("other"))
    key = ["leader", "low", "high"]
    met = met.select("leader", "name", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") == F.least("mine", "other")).alias("side"))
    met = met.join(sets, "name").withColumn("across", F.col("low") != F.col("high")).repartition(*key).sortWithinPartitions(*key)
    names = ["task", "name", "side", "across", "tokens"]
    met = met.select(F.xxhash64(*key).alias("task"), *names[1:])

    def pair_batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def tasks(batches):
        now, held, across = None, [], False
        for batch in batches:
            lists, out = batch.column("tokens"), []
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            tokens = np.asarray(lists.flatten()).view(np.uint64)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names[:4]), strict=True)):
                if row[0] != now:
                    if len(held) > 1:
                        out += solve(held, percent, across)
                    now, held, across = row[0], [], row[3]
                held.append((row[1], row[2], tokens[ends[i] : ends[i + 1]].copy()))
            yield pair_batch(out)
        if len(held) > 1:
            yield pair_batch(solve(held, percent, across))

    return met.mapInArrow(tasks, "a long, b long")


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, hash, n, class) of every row: hash is its text's, class the least name that links reach; null for empty sets."""
    context = docs.sparkSession.sparkContext
    scanned = written(_scan(docs, words), "join-scan")
    members = scanned.where("kind = 0").select(F.col("id").alias("doc_id"), "hash", "n", "name")
    often = scanned.where("kind = 1").groupBy("id").agg(F.sum("n").alias("times")).where(F.col("times") >= FREQUENT)
    frequency = context.broadcast(place_table(written(often, "join-frequent"), "id", F.floor(F.log2("times"))))

    entries = _live(_entries(docs, words, percent, frequency), percent)
    entries = written(_live(entries, percent), "join-entries")
    lead = F.max(F.struct((F.col("held") / F.col("n")).alias("share"), "name"))["name"]
    heads = written(entries.groupBy("token").agg(lead.alias("leader")), "join-heads")
    groups = entries.join(heads, "token").select("leader", "name", F.col("n").cast("long").alias("n")).distinct()
    many = groups.groupBy("leader").agg(F.count("*").alias("members")).where("members > 1").select("leader")
    groups = written(groups.join(many, "leader", "left_semi"), "join-groups")

    wanted = context.broadcast(place_table(groups.select("name").distinct(), "name"))
    sets = written(_sets(docs, words, wanted), "join-sets")
    near = written(_compared(groups, sets, percent), "join-near")
    edges = near.where("band = 0").select(F.col("leader").alias("a"), F.col("name").alias("b")).unionByName(_links(near, sets, percent))
    classes = written(components(edges, "a", "b"), "join-classes").withColumnsRenamed({"node": "name"})
    keyed = members.where("n > 0").join(classes, "name", "left").select("doc_id", "hash", "n", F.coalesce("component", "name").alias("class"))
    for held in (frequency, wanted):
        held.unpersist()
    return written(keyed.unionByName(members.where("n = 0").select("doc_id", "hash", "n", F.lit(None).cast("long").alias("class"))), "join-members")


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach; one row per row of docs."""
    rows = _classes(docs, words, percent)
    # Written, so that the join below reads both sides from plain exchanges, of which Spark splits a hot class.
    least = written(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id")), "join-least")
    out = rows.where("n > 0").join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionAll(empty)


@extras_aside("doc_id", "text")
def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose class has another one before them, by doc_id, then by a hash of the text.

    Rows of one doc_id with texts that aren't linked all stay. Of rows equal in
    doc_id and text, one stays: that of the least hash of all its columns. Rows
    without a doc_id, and empty sets, stay. Columns are those of docs.
    """
    rows = _classes(docs, words, percent).where("n > 0 and doc_id is not null")
    kept = rows.groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("k.*")
    kept = written(rows.join(kept, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.count("*").alias("_rows")), "join-kept")
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    found = hashed.join(kept.withColumnsRenamed({"doc_id": "_kept", "hash": "_kept_hash"}), (F.col("doc_id") == F.col("_kept")) & (F.col("_text_hash") == F.col("_kept_hash")))
    once = found.where("_rows = 1").select(*docs.columns)
    whole = F.struct(*docs.columns)
    again = found.where("_rows > 1").groupBy("doc_id", "_text_hash").agg(F.min_by(whole, F.struct(F.hash(F.to_json(whole)), F.to_json(whole))).alias("r")).select("r.*")
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return once.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull() | ~blank))
