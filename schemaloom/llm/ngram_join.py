"""N-gram Jaccard join: which texts share at least 80 % of their distinct word 5-grams.

Exact at every size. The steps:

1. Every text becomes its sorted set of shingle hashes. Equal sets form one class, kept by its smallest id.
2. Only texts that share a token of their prefix can link: of n tokens in one global order, the first
   n - ceil(0.8 n) + 1. The order puts tokens that many texts hold last, so that a passage shared by thousands
   of texts brings none of them together. How many hold a token is told by counts within blocks of texts, of all tokens.
3. Hashed bitmaps bound the overlap of a pair from above: a bit of A that B lacks is a token of A that B lacks.
   First the texts with one of their first tokens in common are chained by a spanning forest of likest bitmaps, in chunks
   of bounded size. That joins groups of copies by a number of pairs linear in their size.
4. Prefix tokens are counted. Those that only one text has lead nowhere; a filter of the others keeps them out of the shuffle.
   All texts of one prefix token and size band form tiles, in which only texts not yet in the same component are compared:
   by size, by the token's place, and by bitmaps.
5. What is left is decided by intersecting the sorted sets: on the upper bytes of the tokens first, and on whole tokens where a link hangs on few of them.

Any token order gives the same links, so the table of frequent tokens may be bounded and its counts may be low without losing any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import fresh, partitions, saved, short_batches, tidy
from .words import mix, shingle_sets

SHARE_OF_100 = 80
BITS = 2048
#: Bits of the signatures inside tiles: bitmaps folded to this width.
TILE_BITS = 512
CENTRES = 4
#: Frequent tokens that are put last in the order: at most so many (8 MB). A token is counted where at least FREQUENT_FROM of the texts
#: of a block, of about BLOCK_TOKENS tokens, hold it.
FREQUENT, FREQUENT_FROM = 500_000, 4
BLOCK_TOKENS = 4_000_000
#: Rows compared at a time; a token that more texts hold is spread over tiles.
TILE = 1_024
#: Slots, as a power of two, of the table that says over how many tiles a frequent token is spread (4 MB).
SPREAD_SLOTS = 22
#: Bits of the filter that finds the texts named by some pair; fuller filters pass more, never fewer.
SIEVE_BITS = 1 << 22
#: The filter of repeated tokens has 8 to 16 bits for each, from 2**20 and up to 2**27 (16 MB) in all; fuller ones pass more, never fewer.
TOKEN_BITS = (20, 27)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap that a set of n needs with any partner."""
    return (n * SHARE_OF_100 + 99) // 100


def _list(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(tokens >> np.uint64(20)).astype(np.int64) % BITS] = True
    return np.packbits(bits)


def bitmap_bound(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From above, the overlap of sets of n_a and n_b tokens with bitmaps a and b (a row each)."""
    only_a = np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def links(n_a: np.ndarray, n_b: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    return 100 * overlap >= SHARE_OF_100 * (n_a + n_b - overlap)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    gathered, filled = np.empty(BLOCK_TOKENS * 9 // 8, np.uint64), 0

    def tally() -> tuple[np.ndarray, np.ndarray]:
        nonlocal filled
        whole, filled = gathered[:filled], 0
        whole.sort()
        values = whole[FREQUENT_FROM - 1 :][whole[FREQUENT_FROM - 1 :] == whole[: max(0, len(whole) - FREQUENT_FROM + 1)]]
        values = values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values  # they are sorted
        return values, np.searchsorted(whole, values, "right") - np.searchsorted(whole, values)

    def with_tally(columns: list[pa.Array], found: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
        """The counts of a block go with the last row."""
        rows = len(columns[0])
        extra = [pa.array([None] * (rows - 1) + [None if found is None else found[k].view(np.int64)], pa.list_(pa.int64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, *extra], ["doc_id", "n", "key", "bits", "centres", "hot", "held"])

    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            yield with_tally(waiting, tally() if filled >= BLOCK_TOKENS else None)
        n, keys, bits, centres = [], [], [], []
        for tokens in shingle_sets(batch.column("text")):
            n.append(len(tokens))
            keys.append(xxhash.xxh3_128_hexdigest(tokens) if len(tokens) else None)
            bits.append(bitmap(tokens).tobytes())
            centres.append(tokens[: min(CENTRES, len(tokens) - needed(len(tokens)) + 1)] if len(tokens) else tokens)
            if filled + len(tokens) > len(gathered):
                gathered = np.concatenate([gathered[:filled], np.empty(len(tokens) + BLOCK_TOKENS // 8, np.uint64)])
            gathered[filled : filled + len(tokens)] = tokens
            filled += len(tokens)
        waiting = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bits, pa.binary()), _list(centres)]
    if waiting is not None:
        yield with_tally(waiting, tally())


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, bits, centres, hot, held) of every text: set size, name of the set, bitmap, the first tokens of the plain prefix; and
    on some rows tokens that several texts of a block hold, with how many."""
    return docs.select("doc_id", "text").mapInArrow(_describe, "doc_id long, n long, key string, bits binary, centres array<long>, hot array<long>, held array<long>")


def _sieve(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap with the bit of every value's lowest bits; bits is a power of two of 2**15 at least."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    slots = values.select(F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit((1 << 15) - 1)).alias("position")).repartition(partitions(values.sparkSession), "bucket")
    whole = np.zeros((bits >> 15, 4096), np.uint8)
    for bucket, own in slots.groupBy("bucket").agg(F.bitmap_construct_agg("position")).toLocalIterator():
        whole[bucket] = np.frombuffer(own, np.uint8)
    return whole.reshape(-1)


def _passes(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.int64) & (8 * len(sieve) - 1)
    return (sieve[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _slot(column: str) -> F.Column:
    return F.xxhash64(F.col(column).cast("long")).alias("slot")


#: Bytes of a token that the first check looks at, and how many tokens two sets may share there by chance: a pair whose link hangs on so few is
#: checked again on whole tokens. Two sets of 250 share one by chance in one of 4 * 10**9 pairs, so three in one of 10**29.
SHORT_TOKEN, CHANCE = 6, 2


def _packed(tokens: np.ndarray, width: int) -> bytes:
    """The upper bytes of sorted tokens."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def _unpacked(data: pa.Buffer, width: int) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, 8 - width :] = own
    return out.reshape(-1).view(np.uint64)


def _arrays_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, tokens) of at least the documents in ids, from the texts; the sieve keeps the others' sets out of the shuffle."""
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(ids.select(_slot("id")), "slot", SIEVE_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.filter(pa.array(_passes(sieve.value, batch.column("slot").to_numpy())))
            found = [_packed(x, width) for x in shingle_sets(named.column("text"))]
            yield pa.RecordBatch.from_arrays([named.column("doc_id"), pa.array(found, pa.binary())], ["id", "tokens"])

    return docs.select("doc_id", "text", _slot("doc_id")).mapInArrow(sets, "id long, tokens binary")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        a, b = _bit_rows(batch.column("bits_a")), _bit_rows(batch.column("bits_b"))
        kept = links(n_a, n_b, bitmap_bound(n_a, n_b, a, b))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(kept)), batch.column("b").filter(pa.array(kept))], ["a", "b"])


def shared_tokens(p: np.ndarray, q: np.ndarray) -> int:
    """How many of p are in q; both sorted, q not empty."""
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int(np.count_nonzero(q[at] == p))


def _bound_passing(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by sizes and whole bitmaps."""
    sizes = sets.select("doc_id", "n", "bits")
    pairs = (
        pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
        .join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
        .filter(f"100 * na >= {SHARE_OF_100} * nb and 100 * nb >= {SHARE_OF_100} * na")
    )
    return pairs.mapInArrow(_bounded, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, width: int = SHORT_TOKEN) -> DataFrame:
    """(a, b, sure) of the pairs that link, by their sets; not sure where tokens that are shared by chance could make the link.

    Tokens that differ may be equal in their upper bytes, never the other way round, so pairs that don't link are out for good.
    """
    chance = CHANCE if width < 8 else 0

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sure = [], []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                p, q = _unpacked(x.as_buffer(), width), _unpacked(y.as_buffer(), width)
                both = shared_tokens(p, q)
                kept.append(bool(links(len(p), len(q), both)))
                sure.append(bool(links(len(p), len(q), both - chance)))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(sure, pa.bool_()).filter(mask)], ["a", "b", "sure"])

    pairs = saved(pairs)
    arrays = _arrays_of(docs, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")), width)
    both = pairs.join(arrays.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(arrays.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return saved(both.mapInArrow(exact, "a long, b long, sure boolean"))


def _bit_rows(column: pa.Array, bits: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bits // 64)


def _spanning_forest(like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that joins all rows which likeness over 0 joins, by the largest likenesses."""
    n = len(like)
    best, partner = np.zeros(n), np.zeros(n, np.int64)
    ends, starts = [], []
    for _ in range(n):
        k = int(best.argmax())
        if best[k] > 0:
            ends.append(k)
            starts.append(partner[k])
        else:
            k = int((best == 0).argmax())
        best[k] = -1
        nearer = (like[k] > best) & (best >= 0)
        best[nearer], partner[nearer] = like[k][nearer], k
    return np.array(ends, np.int64), np.array(starts, np.int64)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk (rows of one token and salt, sorted so) a spanning forest by the bitmaps' bound, as far as the bounds allow
    links, and its most central row with the token's centre."""

    def pairs(doc: np.ndarray, n: np.ndarray, bits: np.ndarray, centre: int) -> pa.RecordBatch:
        found = []
        like = np.zeros((len(doc), len(doc)))
        for k in range(len(doc)):
            bound = np.maximum(bitmap_bound(n[k], n, bits[k], bits), 0)
            like[k] = np.where(links(n[k], n, bound), bound / (n[k] + n - bound), 0)
        np.fill_diagonal(like, 0)
        middle = int(like.sum(1).argmax())
        i, j = _spanning_forest(like)
        x, y = np.append(doc[i], doc[middle]), np.append(doc[j], centre)
        both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
        both = both[:, both[0] != both[1]]
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        token, salt, doc, n, centre = (batch.column(c).to_numpy() for c in ("token", "salt", "doc_id", "n", "centre"))
        bits = _bit_rows(batch.column("bits"))
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(token)], strict=True):
            if held and (name != (token[lo], salt[lo]) or sum(len(x[0]) for x in held) >= TILE):
                yield pairs(*[np.concatenate(x) for x in zip(*[x[:3] for x in held], strict=True)], held[0][3])
                held = []
            name = (token[lo], salt[lo])
            for k in range(lo, hi, TILE):
                end = min(hi, k + TILE)
                held.append((doc[k:end], n[k:end], bits[k:end], int(centre[lo])))
                if end < hi:
                    yield pairs(*[np.concatenate(x) for x in zip(*[x[:3] for x in held], strict=True)], held[0][3])
                    held = []
    if held:
        yield pairs(*[np.concatenate(x) for x in zip(*[x[:3] for x in held], strict=True)], held[0][3])


def _centre_pairs(sets: DataFrame) -> DataFrame:
    """A few likely pairs of each text among the texts that share one of its first tokens."""
    tokens = sets.select("doc_id", F.explode("centres").alias("token"))
    centres = tokens.groupBy("token").agg(F.min("doc_id").alias("centre"), F.count("*").alias("held")).filter("held > 1")
    salt = F.pmod(F.xxhash64("doc_id", "token"), F.ceil(F.col("held") / (TILE // 2))).alias("salt")
    rows = tokens.join(centres, "token").select("token", salt, "doc_id", "centre").join(sets.select("doc_id", "n", "bits"), "doc_id")
    return rows.repartition(partitions(sets.sparkSession), "token", "salt").sortWithinPartitions("token", "salt", "n").mapInArrow(_near, "a long, b long").distinct()


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that most texts hold, with their counts, sorted by token; counted in blocks of all texts."""
    found = sets.filter("hot is not null").select(F.explode(F.arrays_zip("hot", "held")).alias("x")).groupBy(F.col("x.hot").alias("token")).agg(F.sum("x.held").alias("held"))
    rows = found.orderBy(F.desc("held"), "token").limit(FREQUENT).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("held").to_numpy()[order].astype(np.int32)


def band_of(n: np.ndarray | int) -> np.ndarray:
    """Size band: sizes whose ratio is 0.8 or more are in the same or in neighbouring bands."""
    return (np.log(np.maximum(n, 1)) / np.log(100 / SHARE_OF_100)).astype(np.int64)


def _spread_slot(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    return (mix(token.view(np.uint64) + mix(band.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - SPREAD_SLOTS)).astype(np.int64)


def _spots(token: int, n: int, doc: int, salts: np.ndarray) -> list[int]:
    """Where a text goes whose token more than TILE texts hold: tile * 2 + side, for every tile that its chunk takes part in.

    A chunk is a size band, cut by a hash of the id into as many parts as salts (2 ** salts[slot of token and band]) says for the band. Chunks of the same
    and of neighbouring bands meet in a tile of their own, so no task gets a whole frequent token.
    """
    band = int(band_of(n))
    slots = _spread_slot(np.full(3, token, np.int64), np.arange(band - 1, band + 2))
    below, own, above = (1 << int(x) for x in salts[slots])
    salt = int(mix(np.array([doc], np.int64).view(np.uint64))[0]) & own - 1
    tile = lambda b, s, t: 1 + (b << 48) + (s << 24) + t
    out = [tile(3 * band, min(salt, s), max(salt, s)) * 2 + (salt > s) for s in range(own)]
    out += [tile(3 * band + 1, salt, s) * 2 for s in range(above)]
    return out + [tile(3 * band - 2, s, salt) * 2 + 1 for s in range(below)]


def _spread(prefixes: DataFrame, large: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sieve of the tokens that more than TILE texts hold, by slot of token and band the salts as a power of two).

    Both have a fixed size, however many such tokens there are: tokens that share a bit or a slot with a larger one are spread like it, which costs
    rows but loses no link.
    """
    spark = prefixes.sparkSession
    sieve = _sieve(large, "token", 1 << SPREAD_SLOTS)
    shared = spark.sparkContext.broadcast(sieve)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            tokens = column.flatten().to_numpy()
            bands = np.repeat(band_of(batch.column("n").to_numpy()), column.value_lengths().to_numpy())
            hot = _passes(shared.value, tokens)
            slot, times = np.unique(_spread_slot(tokens[hot], bands[hot]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(times)], ["slot", "times"])

    counts = prefixes.mapInArrow(slots, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("held")).filter(F.col("held") > TILE)
    rows = counts.select(F.col("slot").cast("int").alias("slot"), F.ceil(F.log2(F.col("held") / TILE)).cast("byte").alias("salts")).toArrow()
    salts = np.zeros(1 << SPREAD_SLOTS, np.uint8)
    salts[rows.column("slot").to_numpy()] = rows.column("salts").to_numpy()
    return sieve, salts


def _prefixes(docs: DataFrame, heads: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, tokens, bits): of at least heads, each text's prefix in the order that puts frequent tokens last, by how many hold them,
    and its signature for tiles."""
    context = docs.sparkSession.sparkContext
    shared, sieve = context.broadcast(frequent), context.broadcast(_sieve(heads.select(_slot("doc_id")), "slot", SIEVE_BITS))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_passes(sieve.value, batch.column("slot").to_numpy())))
            sizes, out, bits = [], [], []
            for tokens in shingle_sets(batch.column("text")):
                n = len(tokens)
                sizes.append(n)
                bits.append(np.bitwise_or.reduce(bitmap(tokens).reshape(-1, TILE_BITS // 8)).tobytes())
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    rank = np.where(hot[at] == tokens, held[at], 0)
                    if rank.any():
                        tokens = tokens[np.argsort(rank, kind="stable")]
                out.append(tokens[: n - needed(n) + 1] if n else tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), _list(out), pa.array(bits, pa.binary())], ["doc_id", "n", "tokens", "bits"])

    return docs.select("doc_id", "text", _slot("doc_id")).mapInArrow(prefixes, "doc_id long, n long, tokens array<long>, bits binary")


def _placed(prefixes: DataFrame) -> DataFrame:
    """(doc_id, tokens, spots, sizes, bits) of prefixes: tokens that several texts hold, where each one's row goes (see _spots; 0 for the
    usual token), and set size (from bit 31) with the token's place in the order."""
    spark = prefixes.sparkSession
    counts = saved(prefixes.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1"))
    bits = min(max((8 * counts.count()).bit_length(), TOKEN_BITS[0]), TOKEN_BITS[1])
    large = counts.filter(F.col("count") > TILE).select("token")
    spread = _spread(prefixes, large) if large.limit(1).count() else None
    shared = spark.sparkContext.broadcast((_sieve(counts, "token", 1 << bits), spread))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, spread = shared.value
        for batch in batches:
            column = batch.column("tokens")
            all_tokens, first = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            repeated = _passes(sieve, all_tokens)
            out, spots, sizes, kept = [], [], [], []
            for k, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                place = np.flatnonzero(repeated[first[k] : first[k + 1]])
                if not len(place) or doc is None:
                    continue
                tokens, size, spot = all_tokens[first[k] + place], n << 31 | place, np.zeros(len(place), np.int64)
                if spread is not None and (hot := _passes(spread[0], tokens)).any():
                    where = [_spots(int(t), n, doc, spread[1]) if h else [0] for t, h in zip(tokens, hot, strict=True)]
                    lengths = [len(x) for x in where]
                    tokens, size, spot = np.repeat(tokens, lengths), np.repeat(size, lengths), np.array([x for own in where for x in own], np.int64)
                kept.append(k)
                out.append(tokens)
                spots.append(spot)
                sizes.append(size)
            named = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([named.column("doc_id"), _list(out), _list(spots), _list(sizes), named.column("bits")], ["doc_id", "tokens", "spots", "sizes", "bits"])

    return prefixes.mapInArrow(placed, "doc_id long, tokens array<long>, spots array<long>, sizes array<long>, bits binary")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile that may link and are in different components. Rows come sorted by token and tile.

    Both sizes must fit, and so must the places of the token in both orders: if it is the first common one, the overlap
    is at most what follows it in either set.
    """

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, doc, n, rest, component, bits = rows
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        inner = not len(right)
        if inner:
            right = left
        if len(left) < 2 and inner or component.min() == component.max():
            return
        for k in range(0, len(left), TILE):
            i = left[k : k + TILE, None]
            for m in range(k if inner else 0, len(right), TILE):
                j = right[m : m + TILE]
                ok = links(n[i], n[j], np.minimum(rest[i], rest[j])) & (component[i] != component[j])
                if inner and m == k:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if len(x):
                    p, q = i[x, 0], j[y]
                    near = np.concatenate([links(n[p[z]], n[q[z]], bitmap_bound(n[p[z]], n[q[z]], bits[p[z]], bits[q[z]])) for z in np.split(np.arange(len(p)), range(TILE * 16, len(p), TILE * 16))])
                    x, y = x[near], y[near]
                if len(x):
                    a, b = doc[i[x, 0]], doc[j[y]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    held: list[list[np.ndarray]] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, spot, doc, size, component = (batch.column(c).to_numpy() for c in ("token", "spot", "doc_id", "size", "component"))
        tile, n = spot >> 1, size >> 31
        columns = [spot & 1, doc, n, n - (size & 0x7FFFFFFF), component, _bit_rows(batch.column("bits"), TILE_BITS)]
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (tile[1:] != tile[:-1])) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(token)]])
        # tiles of one row that neither begin nor end the batch meet nothing
        tell = np.flatnonzero((last - first > 1) | (first == 0) | (last == len(token)))
        for lo, hi in zip(first[tell], last[tell], strict=True):
            if held and name != (token[lo], tile[lo]):
                yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            name = (token[lo], tile[lo])
            held.append([c[lo:hi] for c in columns])
    if held:
        yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])


def _tile_pairs(docs: DataFrame, sets: DataFrame, joined: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Pairs from different components (joined: node, component) that share a prefix token."""
    spark = docs.sparkSession
    keep = sets.select("doc_id").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    rows = _placed(saved(_prefixes(docs, sets, frequent))).join(keep, "doc_id").select("doc_id", "component", "bits", F.explode(F.arrays_zip("tokens", "spots", "sizes")).alias("x"))
    rows = rows.select(F.col("x.tokens").alias("token"), F.col("x.spots").alias("spot"), "doc_id", F.col("x.sizes").alias("size"), "component", "bits")
    tile = F.shiftright("spot", 1)
    return rows.repartition(partitions(spark), "token", tile).sortWithinPartitions("token", tile).mapInArrow(_meet, "a long, b long").distinct()


def similarity_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id long, text string; other columns are ignored).

    n_shingles is the set size; component_id the smallest doc_id reached by links, the row's own if none.
    Null and empty texts, and texts without words, have no shingles and link with nothing. Repeated rows give
    repeated results; rows of one doc_id with different texts all count as that document. A null doc_id keeps a null
    component. Texts are read whole, however long; a similarity of exactly 80 % links. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with tidy(docs.sparkSession):
        sets = saved(described(docs), keep=True)
        classes = saved(sets.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class")), keep=True)
        heads = sets.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").filter("key is not null").drop("hot", "held").dropDuplicates(["doc_id", "key"])
        heads = saved(heads)
        first = _verified(docs, _centre_pairs(heads))
        joined = components(first.filter("sure"))
        second = _verified(docs, _bound_passing(heads, _tile_pairs(docs, heads, joined, _frequent(sets))))
        found = first.unionAll(second)
        close = _verified(docs, found.filter("not sure").select("a", "b").distinct(), 8)
        whole = components(found.filter("sure").unionAll(close).select("a", "b"), keep=True)
    of_class = classes.join(whole.withColumnRenamed("node", "class"), "class", "left").select("key", F.coalesce("component", "class").alias("component"))
    rows = sets.select("doc_id", "n", "key").join(of_class, "key", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without the documents that a smaller doc_id stands for: of every class of similar texts the smallest id stays.

    Rows that repeat both id and text stay once, the one with the least hash of its other columns; rows of a kept id with different texts all
    stay. Null and empty texts link with nothing, so their documents stay, and so do all rows without a doc_id, for which no other can stand.
    An empty table stays empty. The columns are docs' own, whatever their names.
    """
    names = docs.columns
    head, text, rest, times = (fresh(docs, x) for x in ("_head", "_text", "_rest", "_times"))
    heads = similarity_classes(docs).filter("component_id = doc_id").select(F.col("doc_id").alias(head)).distinct()
    others = [F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]
    known = docs.filter("doc_id is not null").join(heads, F.col("doc_id") == F.col(head), "left_semi")
    known = known.withColumns({text: F.coalesce(F.sha2("text", 256), F.lit("")), rest: F.xxhash64(*others) if others else F.lit(0)})
    known = known.withColumn(times, F.row_number().over(Window.partitionBy("doc_id", text).orderBy(rest))).filter(F.col(times) == 1)
    return known.select(*[f"`{c}`" for c in names]).unionByName(docs.filter("doc_id is null"))
