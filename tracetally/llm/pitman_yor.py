"""Language-model scores from a hierarchical Pitman-Yor model of words.

Every training token is a customer of the restaurant of its predecessor; a table there is a customer of
the one parent that all contexts share, and the parent's base is uniform. Words with at least ``share``
of the training tokens are dishes and contexts of their own, so there are at most 1 / ``share`` of them
and per-context and per-dish totals are arrays of bounded size. All other words are one dish and one
context, inside which a third restaurant tells them apart; its menu, like the counts of pairs, grows
with the corpus and stays in tables. Its base is uniform over these words and one unseen word.

Seating is sampled by Gibbs sweeps: all customers of a dish leave a restaurant and are seated again,
given the tables of the other dishes and the parent's probability. Their number of tables is drawn from
its exact distribution (generalised Stirling numbers) up to ``EXACT`` customers; later ones join in
groups of a thirty-second of those seated, whose new tables round their mean by chance. A sweep updates
all dishes against the totals of the sweep before, which is one pass over the counts. Random numbers
come from the key and the sweep, so a lost task gives the same rows again. Predictive probabilities are
averaged over the sweeps after ``burn`` ones: the seated part, the context's share for the parent and
the parent's probability each, which keeps the sum over all words at one.

Scoring sends every chunk of documents' distinct pairs and rare words, with the documents that hold
them, to the part of the model that knows them, and adds up the parts' sums per document. Words are
compared by 64-bit hashes.

Defined results: null text counts as empty, an empty text is its end alone; a null id counts as empty
text in the split; repeated rows count as often as they occur and get a row each; with no training rows
every token has probability one (there is a single unseen word); an empty table gives an empty result;
only the id and the text are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, texts

FOLDS, HELD_OUT = 5, 1
SHARE = 2e-6  # a word with this share of the training tokens is a dish and context of its own
SWEEPS, BURN = 4, 2
THETA = 1.0
CHUNK = 3_000_000  # tokens whose counts are added up before they leave a task
SHARD = 8_000_000  # training tokens for a part of the model
SEGMENT = 1 << 19  # bytes hashed at a time
EXACT = 128


# ---- words of texts as 64-bit hashes -----------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of UTF-8 texts, A-Z in lower case, split at ASCII white space."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        value = np.arange(256, dtype=np.uint64)
        value[65:91] += np.uint64(32)
        self.byte = mixed(value + np.uint64(1))
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(SEGMENT + 1, self.BASE, np.uint64)) * np.uint64(pow(self.BASE, -1, 2**64))
            self.down = np.cumprod(np.full(SEGMENT + 1, pow(self.BASE, -1, 2**64), np.uint64)) * np.uint64(self.BASE)

    def raw(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unscrambled hash, start and end of every run of characters that are not white space."""
        edges = np.flatnonzero(np.diff(np.concatenate(([True], self.white[data], [True])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.up[: len(data)])))
        return (sums[ends] - sums[starts]) * self.down[starts], starts, ends

    def of_long(self, text: bytes) -> Iterator[np.ndarray]:
        """Hashes of a long text, segment by segment; words across borders are put together."""
        carry, size = 0, 0
        data = np.frombuffer(text, np.uint8)
        for a in range(0, len(data), SEGMENT):
            part = data[a : a + SEGMENT]
            hashes, starts, ends = self.raw(part)
            if size and (self.white[part[0]] or not len(hashes)):
                yield mixed(np.array([carry], np.uint64))
                carry, size = 0, 0
            if size:  # the first word goes on from the segment before
                hashes[0] = (carry + pow(self.BASE, size, 2**64) * int(hashes[0])) % 2**64
            if len(hashes) and not self.white[part[-1]]:
                size = (size if len(hashes) == 1 else 0) + int(ends[-1] - starts[-1]) if starts[-1] == 0 else int(ends[-1] - starts[-1])
                carry, hashes = int(hashes[-1]), hashes[:-1]
            else:
                carry, size = 0, 0
            yield mixed(hashes)
        if size:
            yield mixed(np.array([carry], np.uint64))


END = int(mixed(np.array([0x20], np.uint64))[0])  # no word: the scramble of a raw value is one-to-one


class Tokens:
    """Tokens of a stream of texts, each text closed by ``END``, with the number of their text."""

    def __init__(self):
        self.words, self.texts, self.parts, self.held = Words(), 0, [], 0

    def _add(self, hashes: np.ndarray, of: np.ndarray) -> None:
        if len(hashes):
            self.parts.append((hashes, of))
            self.held += len(hashes)

    def add(self, rows: list[bytes], chunk: int) -> Iterator[None]:
        """Takes texts in; yields whenever a chunk is full."""
        a = 0
        end = np.array([END], np.uint64)
        while a < len(rows):
            b, size = a, 0
            while b < len(rows) and size + len(rows[b]) + 1 <= SEGMENT:
                size, b = size + len(rows[b]) + 1, b + 1
            if b == a:
                for part in self.words.of_long(rows[a]):
                    self._add(part, np.full(len(part), self.texts))
                    if self.held >= chunk:
                        yield
                self._add(end, np.array([self.texts]))
                self.texts, a = self.texts + 1, a + 1
            else:
                hashes, starts, _ = self.words.raw(np.frombuffer(b"\n".join(rows[a:b]), np.uint8))
                limits = np.cumsum([len(r) + 1 for r in rows[a:b]])
                upto = np.searchsorted(starts, limits)
                counts = np.diff(np.concatenate(([0], upto))) + 1
                self._add(np.insert(mixed(hashes), upto, end[0]), np.repeat(np.arange(self.texts, self.texts + b - a), counts))
                self.texts, a = self.texts + b - a, b
            if self.held >= chunk:
                yield

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.concatenate([h for h, _ in self.parts] or [np.zeros(0, np.uint64)])
        of = np.concatenate([o for _, o in self.parts] or [np.zeros(0, np.int64)])
        self.parts, self.held = [], 0
        return hashes, of


def _chunks(batches: Iterator[pa.RecordBatch], column: int, chunk: int, seen=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    tokens = Tokens()
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            if seen:
                seen(part, tokens.texts)
            for _ in tokens.add([t.encode() for t in part.column(column).to_pylist()], chunk):
                yield tokens.take()
    if tokens.held:
        yield tokens.take()


def held_out(doc_id: Column | str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % FOLDS == HELD_OUT


# ---- seating -------------------------------------------------------------------------------------


def stirling_logs(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: ways to seat c customers at t tables, row c, column t."""
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            logs[c + 1, 1 : c + 2] = np.logaddexp(logs[c, t - 1], np.log(np.maximum(c - discount * t, 0)) + logs[c, t])
    return logs


def chance(key: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from keys."""
    with np.errstate(over="ignore"):
        bits = mixed(key.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52


def seat_again(key: np.ndarray, customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, sweep: int, logs: np.ndarray) -> np.ndarray:
    """Number of tables of dishes whose customers are all seated anew.

    ``others``: tables of the restaurant's other dishes; ``base``: the parent's probability of the dish.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    small = np.minimum(customers, EXACT)
    for c in np.unique(small[small > 1]):
        at = np.flatnonzero(small == c)
        for a in range(0, len(at), 1 + 2_000_000 // int(c)):
            rows = at[a : a + 1 + 2_000_000 // int(c)]
            new = np.log(THETA + discount * (others[rows, None] + np.arange(c))) + np.log(base[rows, None])
            weight = np.cumsum(new, axis=1) + logs[c, 1 : c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[rows] = 1 + (weight < (chance(key[rows], sweep) * weight[:, -1])[:, None]).sum(1)
    rows = np.flatnonzero(customers > EXACT)
    seated, step = np.full(len(rows), EXACT, np.int64), 0
    while len(rows):
        group = np.minimum(seated // 32, customers[rows] - seated)
        new = (THETA + discount * (others[rows] + tables[rows])) * base[rows]
        mean = group * new / (new + seated - discount * tables[rows])
        tables[rows] += np.floor(mean + chance(key[rows], sweep * 1000 + step + 7)).astype(np.int64)
        seated, step = seated + group, step + 1
        rows, seated = rows[seated < customers[rows]], seated[seated < customers[rows]]
    return tables


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05


# ---- training --------------------------------------------------------------------------------------


@dataclass
class Model:
    tokens: int  # training tokens
    words: int  # distinct ones
    head: np.ndarray  # sorted hashes of the words that are dishes of their own
    head_counts: np.ndarray
    parent: np.ndarray  # the parent's probability of every dish; the last one stands for all rare words
    customers: np.ndarray  # per context
    shared: np.ndarray  # per context: weight of the parent
    rare: tuple[float, float]  # customers of the rare words' restaurant, probability of an unseen word there
    discounts: tuple[float, float]  # of pairs, of rare words
    counts: DataFrame  # rare: whether a rare word or a pair; key, c, kept (customers less discounted tables)
    shards: int

    def dish(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.head, hashes)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == hashes, at, len(self.head)) if len(self.head) else np.zeros(len(hashes), np.int64)


def _counted(rows: DataFrame, keys, chunk: int) -> DataFrame:
    """Counts of the keys that a function makes of chunks of tokens, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = keys()
        for hashes, _ in _chunks(batches, 0, chunk):
            key, c = np.unique(make(hashes), return_counts=True)
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)].astype(np.int64)), pa.array(c[a : a + (1 << 16)].astype(np.int64))], names=["key", "c"])

    return rows.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _pairs(head: np.ndarray):
    """Pairs of a token and its predecessor, as predecessor's dish * dishes + dish; a text's first word follows an end."""

    def make():
        finder = Model(0, 0, head, head, head, head, head, (0, 0), (0, 0), None, 0)
        last = int(finder.dish(np.array([END], np.uint64))[0])

        def pairs(hashes: np.ndarray) -> np.ndarray:
            nonlocal last
            dish = finder.dish(hashes)
            before = np.concatenate(([last], dish[:-1]))
            last = int(dish[-1])
            return before * (len(head) + 1) + dish

        return pairs

    return make


def _totals(df: DataFrame, group: Column, value: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.groupBy(group.alias("g")).agg(F.sum(value).alias("s")).collect():
        out[r["g"]] = r["s"]
    return out


def fit(docs: DataFrame, share: float = SHARE, sweeps: int = SWEEPS, burn: int = BURN, chunk: int = CHUNK, shard: int = SHARD) -> Model:
    """The model of the rows that are not held out; docs: doc_id, text."""
    train = docs.filter(~held_out()).select("text")
    words = stored(_counted(train, lambda: lambda h: h.view(np.int64), chunk))
    one = words.agg(F.sum("c"), F.count("c")).first()
    tokens, distinct = int(one[0] or 0), int(one[1])
    least = max(1, int(np.ceil(tokens * share)))
    top = words.filter(F.col("c") >= least).collect()  # at most 1 / share rows
    order = np.argsort(np.array([r["key"] for r in top], np.int64).view(np.uint64))
    head = np.array([r["key"] for r in top], np.int64).view(np.uint64)[order]
    head_counts = np.array([r["c"] for r in top], np.int64)[order]
    dishes = len(head) + 1

    pairs = _counted(train, _pairs(head), chunk).withColumn("rare", F.lit(False))
    rare = words.filter(F.col("c") < least).withColumn("rare", F.lit(True))
    state = pairs.unionByName(rare).select("rare", "key", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("kept_tables"))
    state = stored(state)
    few = {(r["rare"], r["c"]): r["n"] for r in state.filter("c <= 2").groupBy("rare", "c").agg(F.count("c").alias("n")).collect()}
    discounts = tuple(discount_of(few.get((kind, 1), 0), few.get((kind, 2), 0)) for kind in (False, True))
    hidden = distinct - len(head)  # rare words
    rare_customers = float(tokens - head_counts.sum())
    of_pair = state.filter("NOT rare")
    customers = _totals(of_pair, F.expr(f"key div {dishes}"), "c", dishes)

    sums = {"shared": np.zeros(dishes), "parent": np.zeros(dishes), "rare": 0.0}
    seats = np.zeros(dishes, np.int64)
    for sweep in range(sweeps + 1):
        of_pair = state.filter("NOT rare")
        tables = _totals(of_pair, F.expr(f"key div {dishes}"), "t", dishes)
        guests = _totals(of_pair, F.expr(f"key % {dishes}"), "t", dishes).astype(np.int64)
        rare_tables = float(state.filter("rare").agg(F.sum("t")).first()[0] or 0)
        if sweep == 0:
            seats, parent_discount = np.minimum(guests, 1), discount_of(int((guests == 1).sum()), int((guests == 2).sum()))
        base = np.full(dishes, 1 / dishes)
        seats = seat_again(np.arange(dishes), guests, seats.sum() - seats, base, parent_discount, sweep + 500, stirling_logs(parent_discount))
        parent = (guests - parent_discount * seats + (THETA + parent_discount * seats.sum()) * base) / (THETA + guests.sum())
        if sweep > burn:
            sums["shared"] += (THETA + discounts[0] * tables) / (THETA + customers) / (sweeps - burn)
            sums["parent"] += parent / (sweeps - burn)
            sums["rare"] += (THETA + discounts[1] * rare_tables) / (THETA + rare_customers) / (hidden + 1) / (sweeps - burn)
        if sweep < sweeps:
            state = stored(_sweep(state, tables, parent, rare_tables, 1 / (hidden + 1), discounts, sweep, sweep >= burn))
    weight = F.when(F.col("rare"), discounts[1]).otherwise(discounts[0])
    counts = state.select("rare", "key", "c", (F.col("c") - weight * F.col("kept_tables") / (sweeps - burn)).alias("kept"))
    shards = max(1, -(-tokens // shard))
    return Model(tokens, distinct, head, head_counts, sums["parent"], customers, sums["shared"], (rare_customers, sums["rare"]), discounts, counts, shards)


def _sweep(state: DataFrame, tables: np.ndarray, parent: np.ndarray, rare_tables: float, rare_base: float, discounts: tuple, sweep: int, keep: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = [stirling_logs(d) for d in discounts]
        dishes = len(parent)
        for batch in batches:
            rare, key, c, t, kept = (col.to_numpy(zero_copy_only=False) for col in batch.columns)
            new = t.copy()
            for kind in (False, True):
                at = np.flatnonzero((rare == kind) & (c > 1))
                total = np.full(len(at), rare_tables) if kind else tables[key[at] // dishes]
                base = np.full(len(at), rare_base) if kind else parent[key[at] % dishes]
                new[at] = seat_again(key[at], c[at], total - t[at], base, discounts[kind], sweep, logs[kind])
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(new), pa.array(kept + new if keep else kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["rare", "key", "c", "t", "kept_tables"])

    return state.mapInArrow(run, "rare boolean, key long, c long, t long, kept_tables long")


# ---- scoring -------------------------------------------------------------------------------------


def _base(c: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return np.log10((c + 0.5) / (tokens + 0.5 * (words + 1)))


def _cells(key: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """Order by scrambled key, and where each shard's keys begin in it."""
    code = mixed(key.view(np.uint64))
    order = np.argsort(code, kind="stable")
    limits = [0, *np.searchsorted(code[order], np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)).tolist(), len(key)]
    return order, limits


KNOWN, ASKED, ROWS = range(3)  # parts of the model come before what asks for them
GATHERED = 1_000_000  # rows of the model that are sent together


def _narrow(values: np.ndarray) -> bytes:
    """Small whole numbers in one, two or four bytes each."""
    top = int(values.max(initial=0))
    return values.astype("u1" if top < 2**8 else "u2" if top < 2**16 else "u4").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers with their first bytes, second bytes, ... side by side, so that leading zeros compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1)


def score(docs: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType
    arrow_id, id_name = to_arrow_type(id_type), id_type.simpleString()
    small = {k: getattr(model, k) for k in ("tokens", "words", "head", "head_counts", "parent", "customers", "shared", "rare", "shards")}
    dishes = len(model.head) + 1
    texts_of_task = [("ids", pa.list_(arrow_id)), ("held", pa.list_(pa.bool_()))]
    message = [("shard", pa.int32()), ("kind", pa.int32()), ("rare", pa.bool_()), ("task", pa.int64()), ("low", pa.int64()),
               ("keys", pa.binary()), ("counts", pa.binary()), ("values", pa.binary()), *texts_of_task]
    sums = [("task", pa.int64()), ("low", pa.int64()), ("n", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary()), *texts_of_task]
    lists = f"ids array<{id_name}>, held array<boolean>"

    def one(fields, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in fields], names=[n for n, _ in fields])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**small, discounts=(0, 0), counts=None)
        task, waiting, listed = TaskContext.get().partitionId(), [], 0
        pairs = _pairs(own.head)()
        head_base = _base(own.head_counts, own.tokens, own.words)

        def seen(part: pa.RecordBatch, _: int) -> None:
            waiting.append((part.column(0).to_pylist(), part.column(2).to_pylist()))

        def rows(low: int, stats: np.ndarray, base: np.ndarray, **lists) -> pa.RecordBatch:
            return one(message, shard=task % own.shards, kind=ROWS, rare=False, task=task, low=low, counts=stats.tobytes(), values=base.tobytes(), **lists)

        def names() -> Iterator[pa.RecordBatch]:
            nonlocal listed
            if waiting:
                ids, held = [i for a, _ in waiting for i in a], [h for _, b in waiting for h in b]
                waiting.clear()
                yield rows(listed, np.zeros(0, np.int64), np.zeros(0), ids=ids, held=held)
                listed += len(ids)

        for hashes, of in _chunks(batches, 1, chunk, seen):
            dish = own.dish(hashes)
            hidden = dish == len(own.head)
            for rare, key, text in ((False, pairs(hashes), of), (True, hashes[hidden].view(np.int64), of[hidden])):
                order, limits = _cells(key, own.shards)
                for s, (a, b) in enumerate(zip(limits, limits[1:])):
                    if a < b:
                        k, t = key[order[a:b]], text[order[a:b]]
                        begins = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                        counts = np.diff(np.concatenate((begins, [len(k)])))
                        low = int(t.min())
                        yield one(message, shard=s, kind=ASKED, rare=rare, task=task, low=low, keys=_planes(k[begins]), counts=_narrow(counts), values=_narrow(t - low))
            low, n = int(of[0]), int(of[-1] - of[0]) + 1
            stats = np.stack([np.bincount(of - low, minlength=n), np.bincount(of[~hidden] - low, minlength=n)]).astype(np.int64)
            base = np.bincount(of[~hidden] - low, head_base[dish[~hidden]], n) if len(head_base) else np.zeros(n)
            yield rows(low, stats, base)
            yield from names()
        yield from names()

    def known_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            rare, key, c, kept = (np.concatenate(col) for col in zip(*held))
            for kind in (False, True):
                here = np.flatnonzero(rare == kind)
                order, limits = _cells(key[here], small["shards"])
                for s, (a, b) in enumerate(zip(limits, limits[1:])):
                    if a < b:
                        rows = here[order[a:b]]
                        yield one(message, shard=s, kind=KNOWN, rare=kind, task=0, low=0, keys=_planes(key[rows]), counts=_narrow(c[rows]) if kind else None, values=kept[rows].tobytes())

        for batch in batches:
            held.append([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            n += batch.num_rows
            if n >= GATHERED:
                yield from dealt()
                held, n = [], 0
        if n:
            yield from dealt()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_customers, unseen = small["rare"]
        shard, parts, table = None, [], None
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            here, kind, rare, task, low, keys, counts, values = (row.column(k)[0].as_py() for k in range(8))
            if kind == ROWS:
                stats = np.frombuffer(counts, np.int64)
                half = len(stats) // 2
                out = one(sums, task=task, low=low, n=stats[:half].tobytes(), known=stats[half:].tobytes(), base=values, score=np.zeros(half).tobytes())
                yield pa.RecordBatch.from_arrays([*out.columns[:6], row.column(8), row.column(9)], names=out.schema.names)
                continue
            if (here, rare) != shard:
                shard, parts, table = (here, rare), [], None
            keys = _whole(keys)
            if kind == KNOWN:
                parts.append([keys, _wide(counts, len(keys)) if rare else np.zeros(0, np.int64), np.frombuffer(values, np.float64)])
                continue
            if table is None:
                table = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                order = np.argsort(table[0])
                table, parts = [c[order] if len(c) else c for c in table], []
            counts = _wide(counts, len(keys))
            text = _wide(values, int(counts.sum()))
            at = np.minimum(np.searchsorted(table[0], keys), max(0, len(table[0]) - 1))
            found = table[0][at] == keys if len(table[0]) else np.zeros(len(keys), bool)
            kept = np.where(found, table[2][at], 0) if len(table[2]) else np.zeros(len(keys))
            add = lambda v: np.bincount(text, np.repeat(v, counts)).astype(np.float64).tobytes()  # noqa: B023, E731
            if rare:
                c = np.where(found, table[1][at], 0) if len(table[1]) else np.zeros(len(keys))
                known = np.bincount(text, np.repeat(found, counts)).astype(np.int64).tobytes()
                value = np.log10(kept / (THETA + rare_customers) + unseen)
                yield one(sums, task=task, low=low, known=known, base=add(_base(c, small["tokens"], small["words"])), score=add(value))
            else:
                before, dish = keys // dishes, keys % dishes
                value = np.log10(kept / (THETA + small["customers"][before]) + small["shared"][before] * small["parent"][dish])
                yield one(sums, task=task, low=low, score=add(value))

    final = [("doc_id", arrow_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.float64, np.float64)
        current, totals, texts_of = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            at = 0
            for ids, held in texts_of:
                upto = slice(at, at + len(ids))
                yield pa.RecordBatch.from_arrays([ids, held, *[pa.array(v[upto]) for v in totals]], names=[n for n, _ in final])
                at += len(ids)

        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            task, low = row.column(0)[0].as_py(), row.column(1)[0].as_py()
            if task != current:
                yield from done()
                current, totals, texts_of = task, [np.zeros(0, k) for k in kinds], []
            for k, kind in enumerate(kinds):
                part = np.frombuffer(row.column(2 + k)[0].as_py() or b"", kind)
                if len(totals[k]) < low + len(part):
                    totals[k] = np.concatenate((totals[k], np.zeros(max(low + len(part), 2 * len(totals[k])) - len(totals[k]), kind)))
                totals[k][low : low + len(part)] += part
            if row.column(6)[0].is_valid:
                texts_of.append((row.column(6)[0].values, row.column(7)[0].values))
        yield from done()

    asked = docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(ask, f"shard int, kind int, rare boolean, task long, low long, keys binary, counts binary, values binary, {lists}")
    stream = asked.unionByName(model.counts.select("rare", "key", "c", "kept").mapInArrow(known_parts, asked.schema))
    dealt = stream.repartition(model.shards, "shard").sortWithinPartitions("shard", "rare", "kind")
    parts = dealt.mapInArrow(answer, f"task long, low long, n binary, known binary, base binary, score binary, {lists}")
    ordered = parts.repartition("task").sortWithinPartitions("task", F.col("ids").isNull(), "low")  # texts in their order
    kinds = f"doc_id {id_name}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    total = ordered.mapInArrow(add_up, kinds)
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    rows = texts(docs, id_col, text_col)
    return score(rows, fit(rows, **settings))
